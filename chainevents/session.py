"""Session settings for local runs; a cluster session is used as it comes."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, name: str = "chainevents") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for written intermediate tables; a local session that names none gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not named and not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-"))
    return (named or _own[0]).rstrip("/")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="chainevents-")
    with zipfile.ZipFile(f"{folder}/chainevents.zip", "w") as bundle:
        for source in package.rglob("*.py"):
            bundle.write(source, source.relative_to(package.parent))
    context.addPyFile(f"{folder}/chainevents.zip")
    _shipped.add(context.applicationId)
