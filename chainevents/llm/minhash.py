"""Near-duplicate detection by b-bit MinHash.

A text's set of word shingles has ``MINIMA`` minima, one under each of as many hash functions. Minima of a band are
hashed together; sets that share a band are candidates. Of each minimum the lowest ``BITS`` bits (of a scrambled copy)
are kept, packed into 64-bit words: two sets agree in a minimum with the probability of their similarity, and in its
bits by chance in 2**-BITS of the other cases, so the share of agreeing fields, counted by bit operations and corrected
for chance, estimates the similarity. Candidates whose estimate lies more than ``SIGMAS`` standard deviations below the
threshold are refused; of the others, links are confirmed on their full sets.

Bands are as long as they can be while two sets right at the threshold miss all of them in at most ``MISSED`` of all
cases (56 bands of 8 minima at 0.85, which 2 in 10**8 pairs miss), and the estimate refuses such a pair in 1 of 10**9.
More similar pairs are lost less often still, and a lost pair only matters where no other link ties the two. Sets are
told apart by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainevents.llm.common import Scratch, narrow, query, table, tidy
from chainevents.llm.linking import AT_ONCE, candidates, keyed, linked, lists, lone_sets, one_row_each, set_names
from chainevents.llm.shingles import mixed, shingle_sets
from chainevents.llm.tokens import slices

_U = np.uint64
MINIMA, BITS, SIGMAS, MISSED = 448, 2, 6, 5e-8

_HASHES = mixed(np.arange(1, 2 * MINIMA + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_TURN, _TIMES = (_HASHES[:MINIMA] >> _U(32)).astype(np.uint32), (_HASHES[MINIMA:] >> _U(32)).astype(np.uint32) | np.uint32(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row per set (none may be empty), one 32-bit minimum per hash function."""
    begins = np.cumsum([0, *map(len, sets)])[:-1]
    every = (np.concatenate(sets) >> _U(32)).astype(np.uint32)
    found, hashed = np.empty((MINIMA, len(sets)), np.uint32), np.empty_like(every)
    for i in range(MINIMA):
        np.bitwise_xor(every, _TURN[i], out=hashed)
        np.multiply(hashed, _TIMES[i], out=hashed)
        np.minimum.reduceat(hashed, begins, out=found[i])
    return found.T


def band_rows(percent: int) -> int:
    """How many minima make a band."""
    missed = lambda rows: (1 - (percent / 100) ** rows) ** (MINIMA // rows)
    return max((rows for rows in range(1, 33) if missed(rows) <= MISSED), default=1)


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per set and band of ``rows`` minima."""
    bands = MINIMA // rows
    grouped = least[:, : bands * rows].reshape(len(least), bands, rows).astype(_U)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), grouped.shape[:2])
    for r in range(rows):
        key = mixed(key ^ (grouped[:, :, r] + _U((r + 1) << 32)))
    return key.view(np.int64)


def packed_bits(least: np.ndarray) -> np.ndarray:
    """The low bits of all minima of each set, packed into 64-bit words."""
    fields = ((least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(_U)
    each = 64 // BITS
    shifts = np.arange(each, dtype=_U) * _U(BITS)
    return np.bitwise_or.reduce(fields.reshape(len(least), MINIMA // each, each) << shifts, axis=2).view(np.int64)


def _unlike_fields(x: Column, y: Column) -> Column:
    """How many fields of two words differ."""
    differ = x.bitwiseXOR(y)
    any_bit = differ
    for k in range(1, BITS):
        any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(differ, k))
    return F.bit_count(any_bit.bitwiseAND(F.lit(sum(1 << at for at in range(0, 63, BITS)))))


def estimated(bits_u: Column, bits_v: Column) -> Column:
    """The similarity that two packed signatures speak for, corrected for fields that agree by chance."""
    unlike = F.aggregate(F.zip_with(bits_u, bits_v, _unlike_fields), F.lit(0), lambda total, x: total + x)
    return 1 - unlike / (MINIMA * (1 - 2.0**-BITS))


def least_estimate(percent: int) -> float:
    """Estimates below this are refused: the threshold less ``SIGMAS`` standard deviations of the estimate there."""
    chance = 2.0**-BITS
    agree = chance + (1 - chance) * percent / 100
    return percent / 100 - SIGMAS * math.sqrt(agree * (1 - agree) / MINIMA) / (1 - chance)


def _signed(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """``id, key1, key2`` of each row, size and two hashes of its set, band keys and bits; equal sets of a batch give them once."""
    band = band_rows(percent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts, AT_ONCE):
                sets = shingle_sets(texts[a:b], n)
                sizes = np.array([len(s) for s in sets], np.int64)
                names = set_names(sets)
                lone = lone_sets(names, sizes)
                held = np.zeros(len(sets), np.int64)
                held[lone] = 1
                least = minima([sets[k] for k in lone]) if len(lone) else np.empty((0, MINIMA), np.uint32)
                signs = [lists(values.ravel(), held * width) for width, values in ((MINIMA // band, band_keys(least, band)), (MINIMA * BITS // 64, packed_bits(least)))]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c)[a:b] for c in ("id", "key1", "key2")], pa.array(sizes), *[pa.array(h.view(np.int64)) for h in names], *signs],
                    ["id", "key1", "key2", "n", "name1", "name2", "bands", "bits"],
                )

    return texts.mapInArrow(tidy(rows), "id long, key1 long, key2 long, n long, name1 long, name2 long, bands array<long>, bits array<long>")


def _components(docs: DataFrame, scratch: Scratch, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``id, key1, key2, n, top`` of each row: ``top`` names its component, null without words."""
    texts = keyed(narrow(docs, id_col, text_col))
    placed, nodes, given, sets = candidates(_signed(texts, n, percent), texts, n, "bands", scratch)
    near = lambda: estimated(F.col("bits_u"), F.col("bits_v")) >= least_estimate(percent)
    bits = scratch.write(nodes.join(sets.select("node"), "node", "left_semi").select("node", "bits"), "bits")
    roots = linked(given, sets, percent, scratch, bits, near)
    return placed.join(roots, "node", "left").select("id", "key1", "key2", "n", F.coalesce("root", "node").alias("top"))


def minhash_components(docs: DataFrame, scratch: Scratch, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Two texts link when 100 * |intersection| >= percent * |union| of their distinct n-word shingles; fewer words count
    as one shingle, texts without words (null, empty) link with nothing and are components of their own. The component
    is the smallest doc_id that links reach, itself included (null ids count only if there is no other), and ``kept`` marks
    rows with that id. Repeated rows and equal texts are one component; an empty table gives an empty result; other
    columns are ignored.
    """
    found = scratch.write(_components(docs, scratch, n, percent, id_col, text_col), "found")
    smallest = found.where("top is not null").groupBy("top").agg(F.min("id").alias("least"))
    component = F.coalesce("least", "id")
    return found.join(smallest, "top", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def minhash_dedup(docs: DataFrame, scratch: Scratch, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per component, that with the smallest id (nulls last), with all its columns; all rows without words stay."""
    found = scratch.write(_components(docs, scratch, n, percent, id_col, text_col), "found")
    return one_row_each(docs, found, id_col, text_col)


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


@query(
    f"WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents), "
    "s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w), "
    "each AS MATERIALIZED (SELECT doc_id, hash(unnest(s)) AS x FROM s), "
    "pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY u, v), "
    "links AS MATERIALIZED (SELECT u, v FROM pairs JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v WHERE 100 * common >= 85 * (len(a.s) + len(b.s) - common)), "
    "ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links), "
    "reach AS (SELECT doc_id AS u, doc_id AS v FROM s UNION SELECT reach.u, ways.v FROM reach JOIN ways ON reach.v = ways.u) "
    "SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least AS component_id, s.doc_id = least AS kept FROM s JOIN (SELECT u, min(v) AS least FROM reach GROUP BY u) ON u = doc_id"
)
def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"), Scratch(spark, "op12"), n=3, percent=85)
