"""Centroid clustering of integer vectors in JVM expressions.

The centroids of a round are one literal array of arrays. ``zip_with`` and ``aggregate`` give a vector's squared distance
to each, ``array_min`` of (distance, number) picks the cluster, and one aggregation of component sums and counts, summed
up in each task before anything moves, gives the next centroids. What reaches the driver per round is one row of sums
per cluster. Vectors are read from a written table of integers in every round; no vector is ever shuffled.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainevents.llm.common import Scratch, query, table

Centroids = list[list[int]]


def whole_vectors(vectors: DataFrame, size: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``id, v``: vectors of exactly ``size`` finite components as floor(scale * x); all others are left out."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    kept = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == size) & finite)
    return kept.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> Centroids:
    """The ``k`` vectors with the smallest hash of their id, in order of it; null ids come last, equal ids go by vector."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [list(r.v) for r in rows.orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").collect()]


def _literal(centroids: Centroids) -> Column:
    """One literal: Spark folds the reading of a constant text while it plans."""
    return F.from_json(F.lit(json.dumps(centroids)), "array<array<bigint>>")


def _squared(v: Column, c: Column) -> Column:
    return F.aggregate(F.zip_with(v, c, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda total, x: total + x)


def assigned(rows: DataFrame, centroids: Centroids) -> DataFrame:
    """``rows`` with ``cluster`` and ``distance`` of the nearest centroid; of equal distances the smaller number."""
    distances = F.transform(_literal(centroids), lambda c, i: F.struct(_squared(F.col("v"), c).alias("distance"), i.alias("cluster")))
    return rows.withColumn("nearest", F.array_min(distances)).select(*rows.columns, F.col("nearest.cluster").alias("cluster"), F.col("nearest.distance").alias("distance"))


def moved(rows: DataFrame, centroids: Centroids) -> Centroids:
    """The centroids after one round: exact floored means of their vectors; those without vectors stay."""
    sums = [F.sum(F.col("v")[i]).alias(f"sum_{i}") for i in range(len(centroids[0]))]
    after = [list(c) for c in centroids]
    for cluster, held, *total in assigned(rows, centroids).groupBy("cluster").agg(F.count(F.lit(1)), *sums).collect():
        after[cluster] = [x // held for x in total]
    return after


def centroid_clusters(
    vectors: DataFrame, scratch: Scratch, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: int = 0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, Centroids]:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` per kept vector, and the final centroids.

    Vectors of another size, null vectors and vectors with null or non-finite components are left out; null ids and
    rows that repeat an id are clustered like others. Fewer than ``k`` vectors give as many centroids; none give an
    empty result. Distances are 64-bit sums: components beyond about 2**28 raise Spark's overflow error instead of
    giving a wrong cluster. Other columns are ignored.
    """
    rows = scratch.write(whole_vectors(vectors, size, scale, id_col, vector_col), "vectors")
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return rows.select(F.col("id").alias("vec_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]), []
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    found = scratch.write(assigned(rows, centroids).select("id", "cluster", "distance"), "assigned")
    inertia = [0] * len(centroids)
    for cluster, total in found.groupBy("cluster").agg(F.sum("distance")).collect():
        inertia[cluster] = total
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values: F.get(F.array(*[F.lit(x) for x in values]), F.col("cluster"))
    result = found.select(
        F.col("id").alias("vec_id"), "cluster", "distance", of(inertia).cast("long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), of(digests).alias("centroid_sha256")
    )
    return result, centroids


def _sql(k: int, rounds: int, size: int, scale: int, seed: int) -> str:
    """The rounds written out, one pair of tables each."""
    parts = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        f"WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c FROM kept ORDER BY cluster LIMIT {k})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, v, n.cluster, n.distance FROM (SELECT vec_id, v, min({{'distance': list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'cluster': cluster}}) AS n "
            f"FROM kept, c{r} GROUP BY vec_id, v))"
        )
        if r < rounds:
            parts.append(
                f"m{r} AS (SELECT cluster, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {size + 1}) AS x(i) GROUP BY cluster, i) GROUP BY cluster)"
            )
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (cluster))")
    return (
        f"WITH {', '.join(parts)} SELECT a.vec_id, a.cluster, a.distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} USING (cluster)"
    )


@query(_sql(40, 5, 64, 256, 2))
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"), Scratch(spark, "op11"), k=40, rounds=5, size=64, scale=256, seed=2)[0]
