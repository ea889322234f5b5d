"""The stored tables: idempotent appends, upserts and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainevents.operators.coverage import new_coverage
from chainevents.operators.ranges import bucket_of
from chainevents.schemas import BUCKET, CONTRACTS, COVERED_RANGES, EVENT_COLUMNS, EVENT_KEY, EVENTS, ROLLUP


def first_per_key(incoming: DataFrame, arrival: list, dealt: tuple[str, ...] = ()) -> DataFrame:
    """The first row of every event key in order of ``arrival`` (names or column expressions).

    One exchange moves the rows as they come in, and one sort by key puts them together. The arrival columns are worked
    out behind it, only for rows that share their key, and compared there, so neither they nor columns that are derived
    from the outcome are moved or sorted. ``dealt`` are columns that follow from the key; rows that are dealt by them
    already are not moved again.
    """
    # The order within a key is left open: a part of the key is the same for all of its rows.
    lined = Window.partitionBy(*EVENT_KEY, *dealt).orderBy(EVENT_KEY[0])
    same = lined.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = incoming.withColumns({"_n": F.count(F.lit(1)).over(same), "_at": F.row_number().over(lined)})
    order = F.struct(*[(F.col(a) if isinstance(a, str) else a).alias(f"_{i}") for i, a in enumerate(arrival)], "_at")
    earliest = F.min(F.when(F.col("_n") > 1, order)).over(same)
    return placed.withColumn("_first", earliest["_at"]).where("_at = coalesce(_first, 1)").drop("_n", "_at", "_first")


def in_buckets(rows: DataFrame) -> DataFrame:
    """Rows with ``block_bucket``, those of a bucket in one task."""
    return rows.withColumn("block_bucket", bucket_of("block_number")).repartition("block_bucket")


def new_events(existing: DataFrame, incoming: DataFrame, arrival: list) -> DataFrame:
    """Incoming rows an insert-or-ignore would add."""
    return first_per_key(incoming, arrival).join(existing.select(*EVENT_KEY), EVENT_KEY, "left_anti")


def upsert_contracts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Contracts after an upsert: a new name only where given, the ABI always replaced."""
    old = existing.select("address", F.col("name").alias("old_name"), F.col("abi_json").alias("old_abi"))
    new = incoming.select("address", F.col("name").alias("new_name"), F.col("abi_json").alias("new_abi"), F.lit(True).alias("given"))
    return old.join(new, "address", "full").select(
        "address",
        F.coalesce("new_name", "old_name").alias("name"),
        F.when(F.col("given"), F.col("new_abi")).otherwise(F.col("old_abi")).alias("abi_json"),
    )


def lookup_abi(requests: DataFrame, contracts: DataFrame) -> DataFrame:
    """(address, abi_json, found) for every requested address; text must match exactly."""
    known = contracts.select("address", "abi_json")
    joined = requests.select("address").join(known, "address", "left")
    return joined.withColumn("found", F.col("abi_json").isNotNull())


def dataset_size(table: DataFrame) -> DataFrame:
    """Bytes of the files behind a table, from file metadata."""
    files = table.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    return files.groupBy("path").agg(F.max("size").alias("size")).agg(
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("size_bytes")
    )


class Store:
    """Parquet tables under one root on a shared file system.

    ``events`` is partitioned by block bucket and sorted by contract and topic, so
    that filters on them skip files and row groups. Every write can be repeated.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _read(self, name: str, schema: str) -> DataFrame:
        hadoop, path = self._hadoop(name)
        if not hadoop.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _versions(self) -> list[int]:
        """Written versions of the contracts table, oldest first; one without its success marker does not count."""
        hadoop, path = self._hadoop("contracts")
        if not hadoop.exists(path):
            return []
        names = [s.getPath().getName() for s in hadoop.listStatus(path) if s.isDirectory()]
        numbers = sorted(int(n.removeprefix("v")) for n in names if n.removeprefix("v").isdigit())
        return [v for v in numbers if hadoop.exists(self._hadoop(f"contracts/v{v}/_SUCCESS")[1])]

    @property
    def events(self) -> DataFrame:
        """Stored events, with the ``block_bucket`` partition column."""
        return self._read("events", EVENTS + ", block_bucket bigint")

    @property
    def rollup(self) -> DataFrame:
        """Counts and block range of the stored events per bucket, contract, event name and first topic."""
        return self._read("rollup", ROLLUP + ", block_bucket bigint")

    @property
    def bucket_counts(self) -> DataFrame:
        """The roll-up as look-ups of many requests read it."""
        return self.rollup.select("contract", "event_name", "topic0", F.col("block_bucket").alias("bucket"), "n")

    @property
    def contracts(self) -> DataFrame:
        """The newest complete version."""
        versions = self._versions()
        return self._read(f"contracts/v{versions[-1]}" if versions else "contracts/none", CONTRACTS)

    @property
    def covered_ranges(self) -> DataFrame:
        return self._read("covered_ranges", COVERED_RANGES)

    def append_events(self, incoming: DataFrame, low: int, high: int, shape: dict[str, Column] | None = None) -> None:
        """Insert-or-ignore rows of blocks ``low .. high``; only their partitions are compared.

        ``shape`` has the event columns as expressions over ``incoming``, where that holds them in a narrower form. Rows
        are compared, moved and sorted as they come in, and take their shape where they are written.
        """
        shape = shape or {c: F.col(c) for c in EVENT_COLUMNS}
        existing = self.events.where(F.col("block_bucket").between(low // BUCKET, high // BUCKET)).select(*EVENT_KEY)
        # Without stored rows to compare with, rows are moved once: to the task that writes their bucket.
        fresh = incoming if existing.isEmpty() else incoming.join(existing, EVENT_KEY, "left_anti")
        # A rerun hands over the same row for a key, except that several scopes may decode it alike.
        added = first_per_key(in_buckets(fresh), [shape[c] for c in ("contract", "event_name", "decoded")], ("block_bucket",))
        (
            added.withColumns({"_contract": shape["contract"], "_topic0": shape["topic0"]})
            .sortWithinPartitions("block_bucket", "_contract", "_topic0", "block_number", "log_index")
            .select(*[shape[c].alias(c) for c in EVENT_COLUMNS], "block_bucket")
            .write.mode("append")
            .option("compression", "zstd")  # hashes as hex text come down to half
            .partitionBy("block_bucket")
            .parquet(f"{self.root}/events")
        )
        self.roll_up(low, high)

    def roll_up(self, low: int, high: int) -> None:
        """Count the stored events of the buckets of blocks ``low .. high`` anew, in place of what was counted before.

        It reads four narrow columns of those partitions and moves them once, in the order of their files, to the task that
        counts and writes their bucket. Done twice it changes nothing, and it mends the roll-up of a
        run that broke off between its two writes.
        """
        stored = self.events.where(F.col("block_bucket").between(low // BUCKET, high // BUCKET))
        dealt = stored.select("block_bucket", "contract", "event_name", "topic0", "block_number").repartition("block_bucket")
        counts = dealt.groupBy("contract", "event_name", "topic0", "block_bucket").agg(
            F.count(F.lit(1)).alias("n"), F.min("block_number").alias("min_block"), F.max("block_number").alias("max_block")
        )
        (
            counts.sortWithinPartitions("block_bucket", "contract", "topic0")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("block_bucket")
            .parquet(f"{self.root}/rollup")
        )

    def append_coverage(self, incoming: DataFrame) -> None:
        """Record ranges (contract, from_block, to_block) that are not recorded yet."""
        stamped = incoming.withColumn("recorded_at", F.current_timestamp())
        new_coverage(self.covered_ranges, stamped).write.mode("append").parquet(f"{self.root}/covered_ranges")

    def upsert_contracts(self, incoming: DataFrame) -> None:
        """Write the upserted contracts as a new version; readers change to it when it is complete.

        The version before stays for readers that have begun; older ones are removed.
        """
        versions = self._versions()
        upsert_contracts(self.contracts, incoming).write.mode("overwrite").parquet(f"{self.root}/contracts/v{max(versions, default=0) + 1}")
        for old in versions[:-1]:
            hadoop, path = self._hadoop(f"contracts/v{old}")
            hadoop.delete(path, True)
