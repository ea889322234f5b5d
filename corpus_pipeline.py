"""From raw documents to packed training sequences, in stages that each read what the one before wrote.

Toxic documents go, of exact copies the one with the largest doc_id stays, of near copies (word shingles of five, a
similarity of 0.8) the one with the smallest, byte strings that an earlier document has are cut out, and what is left
is packed into sequences. A document that a cut leaves without text stays, as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainevents.llm import exact_dedup, jaccard, packing, suffix_dedup, toxicity
from chainevents.llm.common import Scratch, prepare, table
from chainevents.llm.queries import QUERIES


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), Scratch(spark, "toxicity"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs, Scratch(spark, "copies"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard.near_dedup(docs, Scratch(spark, "near"), n=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    cut = suffix_dedup.without_repeats(docs, Scratch(spark, "repeats"))
    return cut.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))) if "n_chars" in cut.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.packed_documents(docs, Scratch(spark, "packing"), remembered=60_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: The stages learn a classifier and tokenize, which SQL cannot express; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


REGISTERED = QUERIES | {"pipeline": (run, ORACLE_SQL)}
