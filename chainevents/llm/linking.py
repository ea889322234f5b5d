"""Components of near copies from candidate keys, without meeting all pairs of a key.

``given`` says which nodes share a key; only nodes that do are compared. In each of a few rounds, the nodes of a key meet
one of them (another one in each round), and what links becomes one component: a round costs one pair per row of
``given`` at most, and a group of near copies is mostly one component after it. Then all pairs of a key that are still in
different components are met, and links found there complete the components, so they are exact for the candidates.

Before that last step, nodes that can link to no other component any more are left out: a shingle that only one
component's candidates hold is in no intersection with another one, and a node with too few other shingles cannot
reach the similarity. In a family of texts with edits of their own, that takes out the distant ones, whose pairs are
the many that come close to the threshold without reaching it. A pair that shares many keys comes out of the join once.

Pairs are refused early by parity sketches of the sets: each shingle flips one bit, so bits that differ are never more
than shingles that differ. A sketch has at least two bits per shingle (up to ``WORDS`` words, beyond which it only
refuses less), so few pairs below the threshold are left for the full sets to decide.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainevents.llm.common import Scratch, packed, tidy
from chainevents.llm.components import components
from chainevents.llm.shingles import mixed, shingle_sets
from chainevents.llm.tokens import slices

_U = np.uint64

#: Rounds of stars; their number only moves work, never a result.
ROUNDS = 3
#: Smallest keys of a node that tell whether a pair has met before; their number only moves work.
FIRSTS = 32
#: Most 64-bit words of a parity sketch.
WORDS = 1024

SETS = "node long, n long, parity array<long>, half array<long>, hashes array<long>"


#: Characters of text whose shingles are hashed at once.
AT_ONCE = 1 << 19


def keyed(texts: DataFrame) -> DataFrame:
    """128 bits that stand for a text."""
    return texts.withColumn("key1", F.xxhash64("text")).withColumn("key2", F.xxhash64(F.lit(1), "text"))


def set_names(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit hashes of each set, 0 of empty ones."""
    sizes = np.array([len(s) for s in sets], np.int64)
    names, full = np.zeros((2, len(sets)), _U), np.flatnonzero(sizes)
    if len(full):
        every, begins = np.concatenate(sets), (np.cumsum(sizes) - sizes)[full]
        for k in range(2):
            names[k, full] = mixed(np.add.reduceat(mixed(every ^ _U(0xA5A5A5A5 + k)), begins) + sizes[full].astype(_U))
    return names


def lone_sets(names: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the first of equal sets, in order; empty sets have none."""
    _, first = np.unique(names, axis=1, return_index=True)
    return np.sort(first[sizes[first] > 0])


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values, pa.int64()))


def set_rows(nodes: Sequence[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of ``SETS``; ``half`` is the sketch folded once, for partners with half as many words."""
    sizes = np.array([len(s) for s in sets], np.int64)
    hashes = np.concatenate([*sets, np.empty(0, _U)])
    words = np.minimum(WORDS, 2 ** np.ceil(np.log2(np.maximum(2, sizes / 32))).astype(np.int64))
    starts, codes, owner = np.cumsum(words) - words, mixed(hashes), np.repeat(np.arange(len(sets)), sizes)
    sketches = []
    for begin, width in ((starts, words), (starts // 2, words // 2)):
        sketch = np.zeros(int(width.sum()), _U)
        at = begin[owner] + ((codes >> _U(6)) & (width[owner] - 1).astype(_U)).astype(np.int64)
        np.bitwise_xor.at(sketch, at, _U(1) << (codes & _U(63)))
        sketches.append(lists(sketch.view(np.int64), width))
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array(sizes), *sketches, lists(hashes.view(np.int64), sizes)], ["node", "n", "parity", "half", "hashes"]
    )


def alike(percent: int) -> Column:
    """Whether sizes and parity sketches of u and v allow the similarity."""
    own = lambda x, y: F.when(F.size(f"parity_{x}") > F.size(f"parity_{y}"), F.col(f"half_{x}")).otherwise(F.col(f"parity_{x}"))
    distance = F.aggregate(F.zip_with(own("u", "v"), own("v", "u"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    sizes = F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent
    return sizes & (distance * (100 + percent) <= (F.col("n_u") + F.col("n_v")) * (100 - percent))


def _sides(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table as left and right partner: its columns get the endings ``_u`` and ``_v``."""
    return tuple(frame.select(*[F.col(c).alias(f"{c}_{x}") for c in frame.columns]) for x in "uv")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs ``node_u, node_v``, those whose sets (``node, n, hashes``) reach the similarity."""
    left, right = _sides(sets.select("node", "n", "hashes"))
    met = pairs.join(left, "node_u").join(right, "node_v").withColumn("both", F.size(F.array_intersect("hashes_u", "hashes_v")))
    return met.where(F.col("both") * (100 + percent) >= (F.col("n_u") + F.col("n_v")) * percent).select("node_u", "node_v")


def _rooted(given: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return given.withColumn("root", F.col("node"))
    return given.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _united(roots: DataFrame | None, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The roots after ``links`` between nodes."""
    if roots is None:
        return scratch.write(components(links.select(F.col("node_u").alias("u"), F.col("node_v").alias("v")), scratch, name), f"{name}-roots")
    at = roots.select(F.col("node").alias("at"), "root")
    u = links.join(at, F.col("node_u") == F.col("at"), "left").select("node_v", F.coalesce("root", "node_u").alias("u"))
    edges = u.join(at, F.col("node_v") == F.col("at"), "left").select("u", F.coalesce("root", "node_v").alias("v"))
    upper = scratch.write(components(edges, scratch, name).select(F.col("node").alias("old"), F.col("root").alias("top")), f"{name}-upper")
    raised = roots.join(upper, F.col("root") == F.col("old"), "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = upper.join(roots, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("top").alias("root"))
    return scratch.write(raised.union(fresh), f"{name}-roots")


def _able(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The nodes with enough shingles that candidates of another component hold too."""
    places = apart.select("node", "root").distinct()
    spread = sets.join(places, "node").select("node", "n", "root", F.explode("hashes").alias("shingle"))
    shared = spread.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    held = spread.join(shared, "shingle", "left_semi").groupBy("node", "n").agg(F.count(F.lit(1)).alias("held"))
    return held.where(F.col("held") * 100 >= F.col("n") * percent).select("node")


def _mixed(rooted: DataFrame) -> DataFrame:
    """The keys that nodes of several components share."""
    return rooted.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("sig")


def _firsts(given: DataFrame) -> DataFrame:
    """The ``FIRSTS`` smallest keys of each node."""
    return given.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, FIRSTS).alias("firsts"))


def _apart_pairs(rest: DataFrame, likely: Column) -> DataFrame:
    """Likely pairs of nodes of different components that share a key.

    Copies share most of their keys; of the keys that are among the first ones of both, only the smallest gives the pair.
    A pair that shares none of these comes with each key that it shares, so none is lost.
    """
    a, b = _sides(rest)
    once = F.coalesce(F.array_min(F.array_intersect("firsts_u", "firsts_v")), "sig_u") >= F.col("sig_u")
    return a.join(b, (F.col("sig_u") == F.col("sig_v")) & (F.col("root_u") < F.col("root_v")) & likely & once).select("node_u", "node_v")


def _sets(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``SETS`` of the texts with the keys of ``wanted``, each node once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            _, first = np.unique(node, return_index=True)
            texts = batch.column("text").take(pa.array(first)).to_pylist()
            for a, b in slices(texts, AT_ONCE):
                yield set_rows(node[first[a:b]], shingle_sets(texts[a:b], n))

    found = texts.join(wanted, ["key1", "key2"]).select("node", "text")
    return found.mapInArrow(tidy(rows), SETS).dropDuplicates(["node"])


def candidates(signed: DataFrame, texts: DataFrame, n: int, keys: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows with the node of their set, all nodes, the keys that nodes share, and the sets of nodes that share one.

    ``signed`` has ``id, key1, key2`` of each row, size ``n`` and ``name1, name2`` of its set, and an array of candidate
    ``keys``, empty but for the first of equal sets in a batch; it may have more. A set's node is the smallest row that
    has it, which is the first one of its batch.
    """
    rows = scratch.write(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    names = scratch.write(rows.where("n > 0").groupBy("name1", "name2").agg(F.min("row").alias("node")), "names")
    placed = rows.select("id", "key1", "key2", "n", "name1", "name2").join(names, ["name1", "name2"], "left").select("id", "key1", "key2", "n", "node")
    placed = scratch.write(placed, "placed")
    nodes = rows.join(names.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    spread = nodes.select(F.explode(keys).alias("sig"), "node")
    shared = spread.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("sig")
    given = scratch.write(spread.join(shared, "sig", "left_semi"), "given")
    wanted = nodes.join(given.select("node").distinct(), "node", "left_semi").select("node", "key1", "key2")
    return placed, nodes, given, scratch.write(_sets(texts, wanted, n), "sets")


def one_row_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each ``top`` of ``found`` (``id, key1, key2, top``) one row, that with the smallest id (nulls last), and all rows without a top."""
    named = found.where("top is not null")
    least = named.groupBy("top").agg(F.min("id").alias("least"))
    winners = named.join(least, "top").where(F.col("id").eqNullSafe(F.col("least"))).groupBy("top").agg(F.min(F.struct("id", "key1", "key2")).alias("x"))
    winners = winners.select(*[F.col(f"x.{c}").alias(f"_{c}") for c in ("id", "key1", "key2")])
    rows = keyed(packed(docs, id_col, text_col))
    same = rows["id"].eqNullSafe(winners["_id"]) & (rows["key1"] == winners["_key1"]) & (rows["key2"] == winners["_key2"])
    chosen = rows.join(winners, same, "left_semi").dropDuplicates(["id", "key1", "key2"])
    wordless = found.where("top is null").select("key1", "key2").distinct()
    return chosen.select("row.*").union(rows.join(wordless, ["key1", "key2"], "left_semi").select("row.*"))


def linked(given: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, outlines: DataFrame | None = None, near: Callable[[], Column] | None = None) -> DataFrame:
    """``node, root`` of all nodes that a link ties to another one; ``root`` is the smallest node of the component.

    ``given`` has ``sig, node``, ``sets`` the columns ``SETS``, one row per node of ``given``. ``outlines`` (``node`` and
    more) and ``near`` may refuse pairs before the sketches do; ``near`` sees its columns with the endings ``_u`` and
    ``_v``. All tables are read several times: give written ones.
    """
    outline = sets.drop("hashes") if outlines is None else sets.drop("hashes").join(outlines, "node")
    likely = (lambda: alike(percent)) if near is None else (lambda: near() & alike(percent))
    roots = None
    left, right = _sides(outline)
    for k in range(ROUNDS):
        order = random.Random(k).getrandbits(62)
        rooted = _rooted(given, roots)
        first = F.min(F.col("node").bitwiseXOR(F.lit(order))).bitwiseXOR(F.lit(order))
        centers = rooted.groupBy("sig").agg(first.alias("node_v"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("sig", "node_v")
        pairs = rooted.join(centers, "sig").where("node <> node_v").select(F.col("node").alias("node_u"), F.col("root").alias("root_u"), "node_v").distinct()
        if roots is not None:
            at = roots.select(F.col("node").alias("node_v"), F.col("root").alias("root_v"))
            pairs = pairs.join(at, "node_v", "left").where(F.col("root_u") != F.coalesce("root_v", "node_v"))
        met = pairs.select("node_u", "node_v").join(left, "node_u").join(right, "node_v").where(likely()).select("node_u", "node_v")
        links = scratch.write(verified(met, sets, percent), f"links-{k}")
        roots = _united(roots, links, scratch, f"stars-{k}")

    rooted = scratch.write(_rooted(given, roots), "rooted")
    apart = scratch.write(rooted.join(_mixed(rooted), "sig", "left_semi"), "apart")
    able = scratch.write(_able(apart, sets, percent), "able")
    rest = apart.join(able, "node", "left_semi")
    rest = rest.join(_mixed(rest), "sig", "left_semi")
    rest = scratch.write(rest.join(_firsts(rest), "node").join(outline, "node"), "rest")
    pairs = _apart_pairs(rest, likely()).distinct()
    links = scratch.write(verified(scratch.write(pairs, "pairs"), sets, percent), "links-last")
    return _united(roots, links, scratch, "last")
