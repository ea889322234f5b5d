"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

A node's ball (center c, radius r) bounds the score of a query q in it by q.c + |q| r. Each query visits leaves in the
order of their bounds and stops where the bound falls below its kth score so far. Shards share that score: the first
shard is searched before the others, which start with the kth scores found there. Shards and blocks of queries have a
fixed size, so a task holds the same whatever the size of the table; as every query must meet every shard, their
number of pairs is that of the tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainevents.llm.common import Scratch, query, table

#: Vectors of a shard, queries of a block, and vectors of a leaf.
SHARD, BLOCK, LEAF = 16_384, 1024, 128


class BallTree:
    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.spans, self.parents = [(0, len(points))], [-1]
        k = 0
        while k < len(self.spans):
            low, high = self.spans[k]
            if high - low > leaf:
                own = points[self.order[low:high]]
                far = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))]
                other = own[np.argmax(((own - far) ** 2).sum(1))]
                middle = (high - low) // 2
                self.order[low:high] = self.order[low:high][np.argpartition(own @ (far - other), middle)]
                self.spans += [(low, low + middle), (low + middle, high)]
                self.parents += [k, k]
            k += 1
        self.points = points[self.order]
        self.centers = np.stack([self.points[a:b].mean(0) for a, b in self.spans])
        self.radii = np.array([np.sqrt(((self.points[a:b] - c) ** 2).sum(1).max()) for (a, b), c in zip(self.spans, self.centers, strict=True)])
        self.leaves = np.array([k for k, (a, b) in enumerate(self.spans) if b - a <= leaf])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and leaf, the least bound on the way down to it; a little is added for rounding."""
        bound = queries @ self.centers.T + np.sqrt((queries**2).sum(1))[:, None] * self.radii
        for k, parent in enumerate(self.parents):
            if parent >= 0:
                bound[:, k] = np.minimum(bound[:, k], bound[:, parent])
        return bound[:, self.leaves] + 1e-6 * (1 + np.abs(bound[:, self.leaves]))


def search(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, vector id and score of the k best of each query that reach its ``known`` kth score."""
    tree = BallTree(points)
    ids = ids[tree.order]
    bounds = tree.bounds(queries)
    visit = np.argsort(-bounds, 1, kind="stable")
    best = np.full((len(queries), k), -np.inf)
    kth, active = known.astype(float).copy(), np.arange(len(queries))
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for step in range(len(tree.leaves)):
        leaf = visit[active, step]
        ahead = bounds[active, leaf] >= kth[active]
        active, leaf = active[ahead], leaf[ahead]
        if not len(active):
            break
        order = np.argsort(leaf, kind="stable")
        first = np.flatnonzero(np.diff(leaf[order], prepend=-1))
        for part in np.split(order, first[1:]):
            who = active[part]
            low, high = tree.spans[tree.leaves[leaf[part[0]]]]
            scores = queries[who] @ tree.points[low:high].T
            scores[query_ids[who][:, None] == ids[None, low:high]] = -np.inf
            row, column = np.nonzero((scores >= kth[who][:, None]) & np.isfinite(scores))
            hits.append((who[row], ids[low + column], scores[row, column]))
            best[who] = -np.partition(-np.hstack([best[who], scores]), k - 1, 1)[:, :k]
            kth[who] = np.maximum(kth[who], best[who].min(1))
    if not hits:
        return (np.empty(0, np.int64),) * 3
    who, found, score = (np.concatenate(x) for x in zip(*hits, strict=True))
    kept = score >= kth[who]
    who, found, score = who[kept], found[kept], score[kept].astype(np.int64)
    order = np.lexsort((found, -score, who))
    who, found, score = who[order], found[order], score[order]
    within = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[within], found[within], score[within]


_HITS = "query_id long, vec_id long, score long"


def _met(vectors: DataFrame, queries: DataFrame, shards: int, blocks: int, k: int) -> DataFrame:
    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        right = right.sort_values("id")
        points, asked = (np.stack(x["vector"].to_list()).astype(float) for x in (left, right))
        who, found, score = search(left["id"].to_numpy(), points, right["id"].to_numpy(), asked, right["known"].to_numpy(float), k)
        return pd.DataFrame({"query_id": right["id"].to_numpy()[who], "vec_id": found, "score": score})

    keys = ["size", "shard", "block"]
    each = vectors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("shard", F.explode(F.array([F.lit(s) for s in range(shards)]) if shards < 100 else F.sequence(F.lit(0), F.lit(shards - 1))))
    return each.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(met, _HITS)


def exact_top_k(vectors: DataFrame, is_query, scratch: Scratch, k: int = 20, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k highest inner products of each query with all rows of other ids.

    ``vector_col`` holds whole numbers. Ties go to the smaller id; fewer rows give fewer results. Null ids, null
    vectors and vectors with null components take no part; vectors of different sizes do not meet; rows that repeat id
    and vector count once. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.where("id is not null and vector is not null and size(vector) > 0 and forall(vector, x -> x is not null)").distinct()
    rows = scratch.write(rows.withColumn("size", F.size("vector")), "vectors")
    n, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query(F.col("id")), 1))).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-asked // BLOCK))
    place = F.xxhash64("id", F.lit(7))
    dealt = rows.withColumn("shard", F.pmod(place, F.lit(shards)).cast("int"))
    queries = rows.where(is_query(F.col("id"))).withColumn("block", F.pmod(place, F.lit(blocks)).cast("int"))

    start = queries.withColumn("known", F.lit(float("-inf")))
    hits = scratch.write(_met(dealt.where("shard = 0"), start, 1, blocks, k), "first")
    if shards > 1:
        known = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), F.col("least").cast("double").alias("known"))
        better = scratch.write(queries.join(known, "id", "left").fillna(float("-inf"), ["known"]), "queries")
        hits = hits.union(_met(dealt.where("shard > 0").withColumn("shard", F.col("shard") - 1), better, shards - 1, blocks, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def floored(embeddings: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, vector``: components as floor(scale * x); vectors that are null or hold null or non-finite components are left out."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    return embeddings.where(F.col(vector_col).isNotNull() & finite).select(F.col(id_col).alias("vec_id"), whole.alias("vector"))


@query(
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings "
    "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
    "s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0), "
    "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) "
    "SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"
)
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(floored(table(spark, sf_dir, "embeddings")), lambda i: i % 20 == 0, Scratch(spark, "op3"))
