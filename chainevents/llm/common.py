"""What the operators of this package share: registration, table access, written intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from chainevents.session import shared_folder, ship_package

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

#: Most bytes that Spark hands to a Python worker at once; rows of whole texts are large.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """The package for the Python workers, and batches of a bounded size."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its own name, with the DuckDB text that gives the same rows."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return function(spark, sf_dir)

        run.__name__, run.__doc__ = function.__name__, function.__doc__
        QUERIES[function.__name__] = (run, sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(rows: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that, when done, gives freed memory back to the system: Python workers live on."""

    def run(batches: Iterator) -> Iterator:
        yield from rows(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return run


def in_pandas(frame: DataFrame, rows: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``mapInPandas`` that keeps every digit of ids beside null ones, where pandas would make them floating point."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            given = batch.to_pandas()
            for name in {"id", "doc_id", "page_id"} & set(batch.schema.names):
                if batch.column(name).null_count:
                    given[name] = pd.array(batch.column(name).to_pylist(), "Int64")
            yield given

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in rows(frames(batches)):
            yield pa.RecordBatch.from_pandas(found, schema=arrow, preserve_index=False)

    return frame.mapInArrow(tidy(run), schema)


class Scratch:
    """Tables written to the shared folder: they cut the lineage, so a lost executor costs no earlier stage.

    As nothing reads a write's own shuffles once it is done, Spark removes their files at its end.
    """

    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        before = self.spark.conf.get(self.CLEAN, "false")
        self.spark.conf.set(self.CLEAN, "true")
        try:
            frame.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(self.CLEAN, before)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that no later result reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text`` (null: empty) and the whole row as ``row``, so that no column of the input can clash with ours."""
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct("*").alias("row")
    )


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
