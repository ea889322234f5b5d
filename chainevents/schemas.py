"""Fixed table schemas (Spark DDL)."""

EVENT_COLUMNS = [
    "contract", "event_name", "topic0", "block_number", "block_hash", "tx_hash", "tx_index",
    "log_index", "raw_topics", "raw_data", "decoded", "source", "timestamp",
]
EVENT_KEY = ["block_number", "tx_index", "log_index"]

EVENTS = (
    "contract string, event_name string, topic0 string, block_number bigint, block_hash string, "
    "tx_hash string, tx_index bigint, log_index bigint, raw_topics string, raw_data string, "
    "decoded string, source string, timestamp bigint"
)
ROLLUP = "contract string, event_name string, topic0 string, n bigint, min_block bigint, max_block bigint"
CONTRACTS = "address string, name string, abi_json string"
COVERED_RANGES = "contract string, from_block bigint, to_block bigint, source string, recorded_at timestamp"
SCOPES = (
    "name string, address string, events array<string>, from_block bigint, to_block bigint, "
    "abi_override string, impl_address string"
)

RAW_BLOCKS = (
    "path string, block_number bigint, header binary, body binary, receipts binary, "
    "total_difficulty binary, error string"
)
LOG = "struct<address:binary,topics:array<binary>,data:binary>"
RECEIPTS = (
    "array<struct<type:int,status:binary,cumulative_gas:bigint,logs_bloom:binary,"
    f"logs:array<{LOG}>>>"
)
HEADER_FIELDS = (
    "number bigint, hash binary, parent_hash binary, timestamp bigint, receipts_root binary, "
    "logs_bloom binary, gas_used bigint, base_fee_per_gas bigint"
)
BLOCKS = f"path string, block_number bigint, {HEADER_FIELDS}, receipts {RECEIPTS}, tx_hashes array<binary>, error string"

# Blocks per archive file; also the width of the block buckets that the stored
# events are partitioned by and that range joins and windows are split on.
BUCKET = 8192
