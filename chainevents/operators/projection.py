"""Log shape, API shape, row quality and the two read modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainevents.functions.expressions import bytes_or_null, decoded_json, is_hex_bytes, topics_array

# A dollar sign would let a final line break pass.
_HASH = r"\A(0x)?[0-9a-fA-F]{64}\z"
_ADDRESS = r"\A(0x)?[0-9a-fA-F]{40}\z"
# One to four well-formed topics as they are stored: nothing to parse.
_TOPICS = r'\A\["(0x)?[0-9a-fA-F]{64}"(,"(0x)?[0-9a-fA-F]{64}"){0,3}\]\z'
_LOSSY_DATA = "raw_data hex decode failed"
_LOSSY_JSON = "decoded JSON parse failed"
API_FIELDS = [
    "contract", "event_name", "topic0", "block_number", "block_hash", "tx_hash", "tx_index",
    "log_index", "decoded", "source", "timestamp",
]


def _otherwise_true(condition: Column) -> Column:
    """A missing value fails its check."""
    return ~F.coalesce(condition, F.lit(False))


def invalid_reason() -> Column:
    """Why the log shape cannot be built from a stored row; NULL when it can."""
    topics = topics_array("raw_topics")
    ids = ["block_number", "tx_index", "log_index"]
    return (
        F.when(
            F.least(*ids) < 0,
            F.format_string("negative identity field (block %d, tx %d, log %d)", *[F.col(c) for c in ids]),
        )
        .when(_otherwise_true(F.col("contract").rlike(_ADDRESS)), "contract address parse failed")
        .when(_otherwise_true(F.col("tx_hash").rlike(_HASH)), "tx_hash parse failed")
        .when(_otherwise_true(F.col("block_hash").rlike(_HASH)), "block_hash parse failed")
        .when(F.col("raw_topics").rlike(_TOPICS), F.lit(None))
        .when(topics.isNull(), "raw_topics JSON parse failed")
        .when(_otherwise_true(F.forall(topics, lambda t: t.rlike(_HASH))), "topic value parse failed")
        .when(F.size(topics) > 4, "log shape invalid: more than four topics")
    )


def log_shape(events: DataFrame) -> DataFrame:
    """The log fields of every row with ``quality`` and ``quality_reason`` for that shape."""
    invalid = F.col("_invalid")
    lossy = F.when(_otherwise_true(is_hex_bytes("raw_data")), _LOSSY_DATA)
    return (
        events.withColumn("_invalid", invalid_reason())
        .withColumn("topics", topics_array("raw_topics"))
        .withColumn("data", F.coalesce(bytes_or_null("raw_data"), F.unhex(F.lit(""))))
        .withColumn("quality", F.when(invalid.isNotNull(), "invalid").when(lossy.isNotNull(), "lossy").otherwise("valid"))
        .withColumn("quality_reason", F.coalesce(invalid, lossy))
        .drop("_invalid")
    )


def row_quality(events: DataFrame) -> DataFrame:
    """Add ``quality`` and ``quality_reason`` as the API shape reports them.

    Invalid beats lossy beats valid; unreadable ``decoded`` text makes only this shape lossy.
    """
    lossy_data = F.when(_otherwise_true(is_hex_bytes("raw_data")), _LOSSY_DATA)
    lossy_json = F.when(decoded_json("decoded").isNull(), _LOSSY_JSON)
    lossy = F.concat_ws("; ", lossy_data, lossy_json)
    return (
        events.withColumn("_invalid", invalid_reason())
        .withColumn("_lossy", F.when(F.length(lossy) > 0, lossy))
        .withColumn(
            "quality",
            F.when(F.col("_invalid").isNotNull(), "invalid").when(F.col("_lossy").isNotNull(), "lossy").otherwise("valid"),
        )
        .withColumn("quality_reason", F.coalesce("_invalid", "_lossy"))
        .drop("_invalid", "_lossy")
    )


def event_shape(events: DataFrame) -> DataFrame:
    """The eleven API fields, ``decoded`` parsed or null, and the quality of degraded rows."""
    graded = row_quality(events)
    degraded = F.when(F.col("quality") != "valid", F.struct("quality", F.col("quality_reason").alias("reason")))
    fields = [decoded_json("decoded").alias("decoded") if c == "decoded" else F.col(c) for c in API_FIELDS]
    return graded.select(*fields, degraded.alias("decode_quality"))


def strict_violations(events: DataFrame) -> DataFrame:
    """Rows that strict reading refuses, in result order."""
    bad = log_shape(events).where(F.col("quality") != "valid")
    return bad.select("block_number", "log_index", "tx_index", "quality", "quality_reason")


class StoredRowError(ValueError):
    """A stored event cannot be given the log shape."""


def read_strict(events: DataFrame) -> DataFrame:
    """Log shapes of every row; raises on the first degraded row in result order."""
    first = strict_violations(events).orderBy("block_number", "log_index").limit(1).collect()
    if first:
        row = first[0]
        raise StoredRowError(
            f"stored event failed projection (block {row.block_number}, log {row.log_index}): {row.quality_reason}"
        )
    return log_shape(events).drop("quality", "quality_reason")


def read_flagged(events: DataFrame) -> DataFrame:
    """API shapes of every row; degraded rows carry ``decode_quality``."""
    return event_shape(events)
