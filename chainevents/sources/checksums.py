"""Checksum lists and the per-file checksum audit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainevents.operators.ranges import numbered
from chainevents.sources.archive import open_file, prune_files, scan_directory

_HASHING_BUFFER = 64 << 10
#: The file that lists the checksums of an archive directory.
LIST_NAME = "checksums.txt"


def read_checksum_list(spark: SparkSession, path: str) -> DataFrame:
    """(list_id, line_no, line) of one small list file; each file is one row until it is split."""
    whole = spark.read.text(path, wholetext=True).select(F.lit("").alias("list_id"), "value")
    return whole.select("list_id", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def parse_checksum_lines(lines: DataFrame) -> DataFrame:
    """(list_id, ordinal, sha256, filename): the valid lines of every list, numbered in line order."""
    words = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    digest = F.regexp_replace(F.get(words, F.lit(0)), "^0x", "")
    valid = lines.where(digest.rlike("^[0-9a-fA-F]{64}$")).select(
        "list_id", "line_no", F.lower(digest).alias("sha256"), F.get(words, F.lit(1)).alias("filename")
    )
    return numbered(valid, ["list_id"], ["line_no"], "ordinal").select("list_id", "ordinal", "sha256", "filename")


def hash_files(files: DataFrame) -> DataFrame:
    """Add ``sha256`` by streaming each file through a fixed buffer inside its task."""
    keep = files.columns
    out = pa.schema([("path", pa.string()), ("sha256", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                digest = hashlib.sha256()
                with open_file(path) as handle:
                    while piece := handle.read(_HASHING_BUFFER):
                        digest.update(piece)
                yield pa.RecordBatch.from_pylist([{"path": path, "sha256": digest.hexdigest()}], schema=out)

    hashed = files.select("path").mapInArrow(read, "path string, sha256 string")
    return files.join(hashed, "path").select(*keep, "sha256")


def audit_checksums(files: DataFrame, checksums: DataFrame, lists: DataFrame) -> DataFrame:
    """Status of every file: verified, mismatched, missing or unavailable.

    ``files`` has (list_id, filename, epoch, sha256); ``lists`` names the list_ids
    that have a list at all. A line with the file's name wins over the line at
    the file's epoch; of several lines with one name the last wins.
    """
    by_name = (
        checksums.where(F.col("filename").isNotNull())
        .groupBy("list_id", "filename")
        .agg(F.max_by("sha256", "ordinal").alias("named"))
    )
    by_place = checksums.select("list_id", F.col("ordinal").alias("epoch"), F.col("sha256").alias("placed"))
    present = lists.select("list_id").distinct().withColumn("available", F.lit(True))
    joined = (
        files.join(by_name, ["list_id", "filename"], "left")
        .join(by_place, ["list_id", "epoch"], "left")
        .join(present, "list_id", "left")
    )
    expected = F.coalesce("named", "placed")
    status = (
        F.when(F.col("available").isNull(), "unavailable")
        .when(expected == F.col("sha256"), "verified")
        .when(expected.isNotNull(), "mismatched")
        .otherwise("missing")
    )
    return joined.select(
        *files.columns,
        status.alias("checksum_status"),
        F.when(status == "mismatched", expected).alias("expected_sha256"),
    )


def checked_manifest(spark: SparkSession, directory: str, ranges: DataFrame | None = None, network: str | None = None) -> DataFrame:
    """The manifest of an archive directory with ``sha256``, ``checksum_status`` and ``expected_sha256``.

    Files outside ``ranges`` are left out by their block index first, and files are read and hashed only where the
    directory has a checksum list; without one every status is ``unavailable`` and the hash is empty.
    """
    manifest = scan_directory(spark, directory, network)
    files = manifest if ranges is None else prune_files(manifest, ranges)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/{LIST_NAME}")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        unknown = {"sha256": F.lit(""), "checksum_status": F.lit("unavailable"), "expected_sha256": F.lit(None).cast("string")}
        return files.withColumns(unknown)
    lists = read_checksum_list(spark, f"{directory}/{LIST_NAME}")
    hashed = hash_files(files).withColumn("list_id", F.lit(""))
    return audit_checksums(hashed, parse_checksum_lines(lists), lists).drop("list_id")
