"""Importance resampling towards a target distribution, over hashed n-grams.

A text's bytes go through one table of 256 entries that lower-cases A-Z and blanks separators; ``bytes.split`` then
yields the words, and a ``zlib.crc32`` seeded with that of the n-gram before extends it by one word. Each batch counts
its buckets in one ``Counter``, and only bucket counts leave a task, ``buckets`` rows of it at most. The gain of each
bucket (log of the smoothed ratio of target to source) is a table of ``buckets`` numbers that goes back to the tasks.

Drawing k documents without replacement, each in proportion to exp(weight / 1000), is taking the k highest of weight
plus Gumbel noise. The noise comes from a hash of the document's id. Counts per score give the score below which
nothing is drawn; only the rest is sorted, by range, and ranks are places in the sorted partitions plus the sizes of the
partitions before.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainevents.llm.common import Scratch, narrow, query, table, tidy

#: A-Z as a-z; every other ASCII byte but 0-9 and a-z is a blank; bytes of longer characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Words of a text that are taken in hand at once.
_AT_ONCE = 1 << 16


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def bucket_counts(words: list[bytes], n: int, buckets: int) -> Counter:
    """How many n-grams of 1 to ``n`` words fall into each bucket."""
    counts: Counter = Counter()
    crc32, last = zlib.crc32, [0] * n
    if n == 1:
        for word, times in Counter(words).items():
            counts[crc32(word) % buckets] += times
        return counts
    for start in range(0, len(words), _AT_ONCE):
        found = []
        for i in range(start, min(start + _AT_ONCE, len(words))):
            spaced = b" " + words[i]
            seeds = [crc32(words[i]), *[crc32(spaced, last[k]) for k in range(min(n - 1, i))]]
            found += seeds
            last[: len(seeds)] = seeds
        counts.update(c % buckets for c in found)
    return counts


def _counted(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """``bucket, times`` of all n-grams of all texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update(bucket_counts(words_of(text.as_py()), n, buckets))
        pairs = sorted(counts.items())
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in pairs], pa.int32()), pa.array([c for _, c in pairs], pa.int64())], ["bucket", "times"])

    counted = texts.select("text").mapInArrow(tidy(rows), "bucket int, times long")
    return counted.groupBy("bucket").agg(F.sum("times").alias("times"))


def bucket_gains(docs: DataFrame, target: DataFrame, n: int, buckets: int) -> np.ndarray:
    """floor(1000 * ln of the smoothed share in ``target`` by that in ``docs``) for each bucket; both hold ``text``."""

    def counts(texts: DataFrame) -> np.ndarray:
        held = np.zeros(buckets, np.float64)
        for bucket, times in _counted(texts, n, buckets).collect():
            held[bucket] = times
        return held

    s, t = counts(docs), counts(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weighed(texts: DataFrame, gains: np.ndarray, n: int) -> DataFrame:
    buckets = len(gains)
    by_bucket = gains.tolist()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, weights, lengths = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                counts = bucket_counts(words, n, buckets)
                total = sum(counts.values())
                features.append(total)
                lengths.append(len(words))
                weights.append(sum(by_bucket[b] * times for b, times in counts.items()) // total if total else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(features, pa.int64()), pa.array(lengths, pa.int64()), pa.array(weights, pa.int64())], ["id", "features", "words", "weight"]
            )

    return texts.mapInArrow(tidy(rows), "id long, features long, words long, weight long")


def gumbel(seed: int, id_col: Column) -> Column:
    """floor(-1000 * ln(-ln(u))), u from the first 32 bits of a hash of the id (null: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.log(-F.log(u)) * -1000)


def importance_resample(
    docs: DataFrame, target: DataFrame, scratch: Scratch, n: int = 2, buckets: int = 10_000, seed: int = 0, percent: int = 10, least_words: int = 20,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, n_features, weight, score, rank``; rank 1 is the first drawn, null is not drawn.

    ``percent`` per cent (rounded down) of the texts with at least ``least_words`` words are drawn, by highest score,
    ties to the smaller id, null ids last; rows that repeat an id share its noise and are drawn one by one. Null and
    empty texts have no features and the weight 0. An empty ``target`` or ``docs`` counts as one without features; an
    empty ``docs`` gives an empty result. Other columns are ignored. Features are counted over all rows of both.
    """
    texts = narrow(docs, id_col, text_col)
    aim = target.select(F.coalesce(F.col(target_col), F.lit("")).alias("text"))
    weighed = _weighed(texts, bucket_gains(texts, aim, n, buckets), n)
    scored = scratch.write(weighed.withColumn("score", F.col("weight") + gumbel(seed, F.col("id"))), "scored")

    able = scored.where(F.col("words") >= least_words)
    wanted = able.count() * percent // 100
    # One row per score, whose range a bucket's gain and 32 bits of noise bound; the window runs over these alone.
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    reached = able.groupBy("score").agg(F.count(F.lit(1)).alias("times")).withColumn("before", F.coalesce(F.sum("times").over(higher), F.lit(0)))
    cut = reached.where(F.col("before") < wanted).agg(F.min("score")).first()[0]

    columns = [F.col("id").alias("doc_id"), F.col("features").alias("n_features"), "weight", "score"]
    near = F.lit(False) if cut is None else (F.col("words") >= least_words) & (F.col("score") >= cut)
    undrawn = scored.where(~near).select(*columns, F.lit(None).cast("long").alias("rank"))
    order = [F.desc("score"), F.asc_nulls_last("id")]
    ordered = scored.where(near).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = scratch.write(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("held"))
    starts = sizes.select("part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start"))
    place = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    drawn = ordered.withColumn("part", part).join(F.broadcast(starts), "part").select(*columns, F.when(place <= wanted, place).alias("rank"))
    return undrawn.union(drawn)


_CRC = (
    "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT)))"
)
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    f"WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark), "
    "dw AS (SELECT doc_id, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b), "
    "names AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)), "
    f"crc AS (SELECT {_CRC} AS t), "
    "raw AS (SELECT word, hex(encode(word)) AS h FROM names), "
    "bytes AS (SELECT word, list_transform(range(len(h) // 2), lambda i: CAST((strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1 AS BIGINT)) AS x FROM raw), "
    "hashed AS (SELECT word, xor(list_reduce(x, lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket FROM bytes, crc), "
    "s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (word) GROUP BY bucket), "
    "sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS s_all, (SELECT coalesce(sum(n), 0) FROM t) AS t_all), "
    "gains AS (SELECT k.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain "
    "FROM (SELECT DISTINCT bucket FROM hashed) k CROSS JOIN sums LEFT JOIN s ON s.bucket = k.bucket LEFT JOIN t ON t.bucket = k.bucket), "
    "sized AS (SELECT doc_id, count(*) AS n, sum(gain) AS g FROM dw JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id), "
    "weighed AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(CAST((g - (g % n + n) % n) // n AS BIGINT), 0) AS weight FROM d LEFT JOIN sized ON d.doc_id = sized.doc_id), "
    "scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM weighed), "
    "placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20) "
    "SELECT scored.doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM scored LEFT JOIN placed ON scored.doc_id = placed.doc_id"
)
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op13"), n=1, seed=2024)
