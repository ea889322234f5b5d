"""Similarity join of texts on word shingles, by parity sketches.

**Signatures.** Texts whose sets have Jaccard similarity of at least t differ in at most d shingles, d being given by
their sizes. Sizes fall into bands; a band of smaller partners fixes p > d parts of the hash range. Each part of a set
is a parity sketch: shingles are XOR-ed in, so a shingle in both sets cancels out of the difference, and Hamming
distance never exceeds the symmetric difference. By the pigeonhole principle at least p - d parts of two similar texts
hold no difference, so their sketches are equal. A text gives the d + 1 parts that hold most shingles outside a list of
common ones: of any p - d equal parts, the best in that order is among them on both sides. Where empty parts would be
among them, the text also gives its d + 1 smallest shingles, which two such texts must share one of. The list only
orders parts, so that passages many texts hold seldom make a signature; it has at most ``COMMON`` shingles.

**Components.** Texts with the same set are one node, told apart by 128 bits. Texts that share a signature are candidates;
``linking`` verifies them in rounds of stars and then pair by pair where two components still share a signature, refusing
pairs by parity sketches of whole sets. Links within a component do not change it, so components are exact although a
group of near copies costs about one pair per text.

**Links.** A link joins two nodes of one component, so all links are found by comparing all nodes of each component. A
large one is cut into blocks, each pair of blocks is a group of its own, and a group counts common shingles by a product
of 0/1 matrices; only links or their numbers leave it. Components alone (``near_dedup``) leave this step out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainevents.llm.common import Scratch, narrow, query, table, tidy
from chainevents.llm.linking import candidates, keyed, linked, lists, lone_sets, one_row_each, set_names
from chainevents.llm.shingles import mixed, shingle_sets
from chainevents.llm.tokens import slices

_U = np.uint64
#: Parts beyond the needed ones.
SPARE = 1.2
#: Common shingles that are told apart, and texts of a batch that must hold one.
COMMON, OFTEN = 65_536, 4
#: Nodes and shingles of a component that make one block; shingles that are compared at once.
BLOCK, BLOCK_SHINGLES, AT_ONCE = 1024, 2_000_000, 4096


class Bands:
    """Size bands for a similarity of ``percent`` per cent, and how many differences and parts each allows."""

    def __init__(self, percent: int, largest: int):
        self.percent, self.tops = percent, [1]
        while self.tops[-1] < largest:
            self.tops.append(self.tops[-1] * 10_000 // percent**2 + 1)
        self.tops = np.array(self.tops, np.int64)
        self.parts = (SPARE * (self.tops * (100 - percent) // percent + 1)).astype(np.int64)

    def schemes(self, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Which sets take part, under which band, with how many differences: as smaller partner and as larger one."""
        band = np.searchsorted(self.tops, sizes)
        own = sizes * (100 - self.percent) // self.percent
        below = np.maximum(band - 1, 0)
        top = self.tops[below]
        larger = (band > 0) & (sizes * self.percent <= top * 100)
        across = (sizes + top) * (100 - self.percent) // (100 + self.percent)
        return [(np.flatnonzero(own > 0), band, own), (np.flatnonzero(larger & (across > 0)), below, across)]


def common_shingles(docs: DataFrame, n: int, text_col: str) -> np.ndarray:
    """The shingles that most texts hold, counted over all batches where several different texts hold them; sorted."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(dict.fromkeys(batch.column("text").to_pylist()))
            for a, b in slices(texts):
                found, times = np.unique(np.concatenate([*shingle_sets(texts[a:b], n), np.empty(0, _U)]), return_counts=True)
                often = times >= OFTEN
                yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(times[often])], ["shingle", "times"])

    counted = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(tidy(rows), "shingle long, times long")
    most = counted.groupBy("shingle").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "shingle").limit(COMMON)
    return np.sort(most.toPandas()["shingle"].to_numpy(np.int64).view(_U))


def signatures(sets: list[np.ndarray], bands: Bands, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set number and signature, for all sets; a set's signatures are distinct."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owners, keys = [], []
    for members, band, differences in bands.schemes(sizes):
        if not len(members):
            continue
        hashes = np.concatenate([sets[k] for k in members])
        owner = np.repeat(members, sizes[members])
        part = ((hashes >> _U(32)) * bands.parts[band[owner]].astype(_U)) >> _U(32)
        begins = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(part.astype(np.int64), prepend=-1) != 0))
        codes = mixed(hashes)
        parity = np.bitwise_xor.reduceat(_U(1) << (codes & _U(63)), begins)
        code = np.bitwise_xor.reduceat(codes, begins)
        count, of = np.diff(np.append(begins, len(hashes))), owner[begins]
        rare = count
        if len(common):
            at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
            rare = np.add.reduceat((common[at] != hashes).astype(np.int64), begins)
        where = mixed((band[of].astype(_U) << _U(40)) + part[begins])
        key = mixed(code ^ mixed(parity ^ where))
        order = np.lexsort((key, -count, -rare, of))
        of, key = of[order], key[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        wanted = differences[of] + 1
        owners.append(of[place < wanted])
        keys.append(key[place < wanted])
        held = np.bincount(of, minlength=len(sets))
        for k in members[held[members] <= differences[members]].tolist():
            few = mixed(sets[k][: differences[k] + 1] ^ mixed(np.array([band[k] + (1 << 50)], _U)))
            owners.append(np.full(len(few), k))
            keys.append(few)
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(owners), np.concatenate(keys).view(np.int64)


def signed(texts: DataFrame, n: int, percent: int, common: np.ndarray) -> DataFrame:
    """``id, key1, key2`` of each row, size and two hashes of its set, and signatures; equal sets of a batch give them once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], n)
                sizes = np.array([len(s) for s in sets], np.int64)
                names = set_names(sets)
                lone = np.zeros(len(sets), bool)
                lone[lone_sets(names, sizes)] = True
                owner, sig = signatures([s if k else s[:0] for s, k in zip(sets, lone, strict=True)], Bands(percent, int(sizes.max())), common)
                order = np.argsort(owner, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c)[a:b] for c in ("id", "key1", "key2")], pa.array(sizes), *[pa.array(h.view(np.int64)) for h in names], lists(sig[order], np.bincount(owner, minlength=b - a))],
                    ["id", "key1", "key2", "n", "name1", "name2", "sigs"],
                )

    return texts.mapInArrow(tidy(rows), "id long, key1 long, key2 long, n long, name1 long, name2 long, sigs array<long>")


def _blocks(names: DataFrame, sets: DataFrame) -> DataFrame:
    """The nodes of all components with their sets, each in every pair ``i, j`` of blocks that its ``block`` belongs to."""
    sized = names.join(sets.select("node", "n"), "node")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES))
    placed = sized.join(sized.groupBy("top").agg(parts.alias("parts")), "top").select("top", "node", "parts", F.pmod(F.xxhash64("node"), "parts").alias("block"))
    paired = placed.join(sets.select("node", "n", "hashes"), "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return paired.select("top", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "hashes")


def _compared(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the first and of the second block, their numbers of common shingles, and which pairs reach the similarity."""
    block, node, n = (group.column(x).to_numpy() for x in ("block", "node", "n"))
    shingle = pa.concat_arrays(x.flatten() for x in group.column("hashes").chunks).to_numpy()
    _, code, times = np.unique(shingle, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    owner, code = np.repeat(np.arange(len(node)), n)[shared], (np.cumsum(times > 1) - 1)[code[shared]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    left, right = (np.flatnonzero(block == group.column(x)[0].as_py()) for x in "ij")  # one of them may be empty
    both = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, AT_ONCE):
        a, b = np.searchsorted(code, [at, at + AT_ONCE])
        held = np.zeros((len(node), min(AT_ONCE, int(code[-1]) + 1 - at)), np.float32)
        held[owner[a:b], code[a:b] - at] = 1
        both += (held[left] @ held[right].T).astype(np.int64)
    reached = both * (100 + percent) >= (n[left][:, None] + n[right][None, :]) * percent
    return node[left], node[right], both, reached & (node[left][:, None] != node[right][None, :])


def _links(blocks: DataFrame, percent: int) -> DataFrame:
    """``set_u, set_v, n_both`` of all links, each once."""

    def rows(group: pa.Table) -> pa.Table:
        first, second, both, reached = _compared(group, percent)
        once = reached if group.column("i")[0] != group.column("j")[0] else reached & (first[:, None] < second[None, :])
        x, y = np.nonzero(once)
        u, v = first[x], second[y]
        return pa.table({"set_u": np.minimum(u, v), "set_v": np.maximum(u, v), "n_both": both[x, y]})

    return blocks.groupBy("top", "i", "j").applyInArrow(rows, "set_u long, set_v long, n_both long")


def _link_counts(blocks: DataFrame, percent: int) -> DataFrame:
    """``node, n_links`` of all nodes of components; pairs do not leave their group."""

    def rows(group: pa.Table) -> pa.Table:
        first, second, _, reached = _compared(group, percent)
        if group.column("i")[0] == group.column("j")[0]:
            return pa.table({"node": first, "n_links": reached.sum(axis=1, dtype=np.int64)})
        return pa.table({"node": np.concatenate([first, second]), "n_links": np.concatenate([reached.sum(axis=1, dtype=np.int64), reached.sum(axis=0, dtype=np.int64)])})

    counted = blocks.groupBy("top", "i", "j").applyInArrow(rows, "node long, n_links long")
    return counted.groupBy("node").agg(F.sum("n_links").alias("n_links"))


def _grouped(docs: DataFrame, scratch: Scratch, n: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``id, key1, key2, n, node`` of each row; ``node, top`` of the nodes that have a link; ``node, n, hashes``."""
    texts = keyed(narrow(docs, id_col, text_col))
    rows, _, given, sets = candidates(signed(texts, n, percent, common_shingles(docs, n, text_col)), texts, n, "sigs", scratch)
    return rows, linked(given, sets, percent, scratch).withColumnRenamed("root", "top"), sets.select("node", "n", "hashes")


def _topped(rows: DataFrame, names: DataFrame) -> DataFrame:
    return rows.join(names, "node", "left").withColumn("top", F.coalesce("top", "node"))


def _report(rows: DataFrame, names: DataFrame) -> DataFrame:
    found = _topped(rows, names)
    smallest = found.where("top is not null").groupBy("top").agg(F.min("id").alias("least"))
    return found.join(smallest, "top", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), F.col("node").alias("set_id"))


def jaccard_components(docs: DataFrame, scratch: Scratch, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Two texts link when 100 * |intersection| >= percent * |union| of their distinct n-word shingles; fewer words count
    as one shingle, texts without words (null, empty) link with nothing and are their own component. The component is
    the smallest doc_id that links reach (null ids count only if there is no other). Repeated rows and equal texts are
    one component; an empty table gives an empty result.
    """
    rows, names, _ = _grouped(docs, scratch, n, percent, id_col, text_col)
    return _report(rows, names).drop("set_id")


def jaccard_join(docs: DataFrame, scratch: Scratch, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The whole join: rows as of ``jaccard_components`` with ``set_id, n_links`` added, and the links ``set_u, set_v, n_both``.

    ``set_id`` (null without words) is the same for texts with the same set, ``n_links`` the number of other sets that
    reach the similarity; ``n_both`` is the size of the intersection. Links stand for all pairs of texts of their two
    sets; texts of one set are not linked with each other one by one. ``set_u < set_v``, and each link comes once.
    """
    rows, names, sets = _grouped(docs, scratch, n, percent, id_col, text_col)
    blocks = _blocks(names, sets)
    counts = scratch.write(_link_counts(blocks, percent), "link-counts").withColumnRenamed("node", "set_id")
    report = _report(rows, names).join(counts, "set_id", "left")
    return report.select("doc_id", "n_shingles", "component_id", "set_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), _links(blocks, percent)


def near_dedup(docs: DataFrame, scratch: Scratch, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per component, that with the smallest id (nulls last), with all its columns.

    Rows are told apart by id and text, so rows that share an id are decided one by one; of rows that repeat both one
    stays. All rows without words stay. An empty table gives an empty result.
    """
    rows, names, _ = _grouped(docs, scratch, n, percent, id_col, text_col)
    found = scratch.write(_topped(rows, names).select("id", "key1", "key2", "top"), "found")
    for name in ("signed", "names", "placed", "given", "sets", "rooted", "apart", "able", "rest", "pairs", "links-last"):
        scratch.drop(name)  # else they lie beside all later stages
    return one_row_each(docs, found, id_col, text_col)


@query()
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), Scratch(spark, "op5"), n=4, percent=85)[0]
