"""Token-id files under Re-Pair: each shard repeatedly replaces frequent id pairs by nonterminals, and stores the rules
and their expansion lengths, so any document is decoded without the ones before it.

A file row is one shard: its documents in ascending id order, where each begins in the compressed sequence and among
the shard's ids, the rules, and the sequence. No rule crosses the end of a document. Files are written by Spark (Parquet
carries the binary fields), so a lost executor leaves no half-written shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainevents.llm.common import Scratch, in_pandas, narrow, query, table
from chainevents.llm.tokens import encoder, slices

#: Ends each document.
END = 1
#: Rounds of replacement, pairs replaced in one, and occurrences that a rule must have in its shard.
ROUNDS, PAIRS, LEAST = 4, 4096, 16
_SLOTS = 18

_FILE = "shard int, block int, n_ids long, doc_ids binary, starts binary, places binary, base long, rules binary, lengths binary, sequence binary"


def _frequent(sequence: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the most frequent pairs, which pair each is, and the pairs; counted by hash slot first, then exactly."""
    left, right = sequence[:-1], sequence[1:]
    slot = (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA6B)) >> np.uint32(32 - _SLOTS)
    counts = np.bincount(slot[may], minlength=1 << _SLOTS)
    least = max(LEAST, int(np.partition(counts, -PAIRS)[-PAIRS]))
    at = np.flatnonzero((counts >= least)[slot] & may)
    key = (left[at].astype(np.uint64) << np.uint64(32)) | right[at]
    pairs, which, times = np.unique(key, return_inverse=True, return_counts=True)
    chosen = np.lexsort((pairs, -times))[:PAIRS]
    chosen = chosen[times[chosen] >= LEAST]
    rank = np.full(len(pairs), -1)
    rank[chosen] = np.arange(len(chosen))
    kept = rank[which] >= 0
    return at[kept], rank[which[kept]], pairs[chosen]


def compress(ids: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sequence with nonterminals from ``base`` on, where documents end in it, the rules as rows (left, right), and
    their expansion lengths. ``ends`` are the places just behind each document."""
    last = np.zeros(len(ids), bool)
    last[ends - 1] = True
    sequence, rules, lengths = ids.astype(np.uint32), [np.empty((0, 2), np.uint32)], [np.ones(base, np.int64)]
    made = base
    for _ in range(ROUNDS):
        if len(sequence) < 2:
            break
        at, rank, pairs = _frequent(sequence, ~last[:-1])
        if not len(pairs):
            break
        # of occurrences that overlap, every second one of a run is replaced
        begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        run = np.repeat(begins, np.diff(np.append(begins, len(at))))
        taken = (np.arange(len(at)) - run) % 2 == 0
        at, rank = at[taken], rank[taken]
        sequence[at] = made + rank
        last[at] = last[at + 1]
        stays = np.ones(len(sequence), bool)
        stays[at + 1] = False
        sequence, last = sequence[stays], last[stays]
        both = np.stack([(pairs >> np.uint64(32)), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        known = np.concatenate(lengths)
        rules.append(both)
        lengths.append(known[both].sum(1))
        made += len(pairs)
    return sequence.astype("<u4"), np.flatnonzero(last) + 1, np.concatenate(rules).astype("<u4"), np.concatenate(lengths)[base:].astype("<u4")


def expansions(rules: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols' ids one behind the other, with each symbol's start and length; a rule uses earlier symbols only."""
    pool = [np.arange(base, dtype=np.uint32), *[np.empty(int(n), np.uint32) for n in lengths]]
    for k, (left, right) in enumerate(rules.tolist()):
        a, b = (x if isinstance(x, np.ndarray) else np.array([x], np.uint32) for x in (pool[left - base + 1] if left >= base else left, pool[right - base + 1] if right >= base else right))
        pool[k + 1][: len(a)], pool[k + 1][len(a) :] = a, b
    sizes = np.concatenate([np.ones(base, np.int64), lengths.astype(np.int64)])
    return np.concatenate(pool), np.cumsum(sizes) - sizes, sizes


def expand(sequence: np.ndarray, pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of any part of a compressed sequence."""
    each = sizes[sequence]
    ends = np.cumsum(each)
    return pool[np.repeat(starts[sequence] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]


def write_token_files(docs: DataFrame, path: str, vocabulary: str, base: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts (null: empty), end each with END and write the ids in ascending id order, shard by shard.

    ``base`` is the vocabulary's size. Null ids come first, rows that share an id are ordered by text; an empty table
    makes an empty folder of files.
    """

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, shard, block = encoder(vocabulary, spaces_kept=False).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, names = batch["text"].tolist(), batch["id"].astype("Int64")
            for a, b in slices(texts, 1 << 23):
                ids, bounds = encode(texts[a:b])
                ids = np.insert(ids, bounds[1:], END)
                starts = bounds + np.arange(len(bounds))
                sequence, ends, rules, lengths = compress(ids, starts[1:], base)
                places = np.concatenate([[0], ends])
                own = names.iloc[a:b]
                packed_ids = own.fillna(0).to_numpy(np.int64).astype("<i8").tobytes() + np.packbits(own.isna().to_numpy()).tobytes()
                fields = (packed_ids, starts.astype("<i8").tobytes(), places.astype("<i8").tobytes(), base, rules.tobytes(), lengths.tobytes(), sequence.tobytes())
                yield pd.DataFrame([(shard, block, len(ids), *fields)], columns=[x.split()[0] for x in _FILE.split(", ")])
                block += 1

    ordered = narrow(docs, id_col, text_col).repartitionByRange("id").sortWithinPartitions("id", "text")
    in_pandas(ordered, shards, _FILE).write.option("compression", "zstd").parquet(path)


def documents_of(row) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Id, start among the shard's ids, and ids of each document of a file row, each by random access."""
    starts, places = np.frombuffer(row.starts, "<i8"), np.frombuffer(row.places, "<i8")
    n = len(starts) - 1
    names, nulls = np.frombuffer(row.doc_ids[: 8 * n], "<i8"), np.unpackbits(np.frombuffer(row.doc_ids[8 * n :], np.uint8))[:n]
    tables = expansions(np.frombuffer(row.rules, "<u4").reshape(-1, 2), np.frombuffer(row.lengths, "<u4"), row.base)
    sequence = np.frombuffer(row.sequence, "<u4")
    for k in range(n):
        yield None if nulls[k] else int(names[k]), int(starts[k]), expand(sequence[places[k] : places[k + 1]], *tables)


def token_file_report(spark: SparkSession, path: str) -> DataFrame:
    """Read files back: ``doc_id, start, n_tokens, ids_crc32`` per document."""
    files = spark.read.schema(_FILE).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = files.select("shard", "block", "n_ids").withColumn("in_shard", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    begins = begins.join(totals, "shard").select("shard", "block", (F.col("shard_start") + F.col("in_shard")).alias("begin"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                found = [(row.shard, row.block, name, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for name, start, ids in documents_of(row)]
                frame = pd.DataFrame(found, columns=["shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])
                yield frame.assign(doc_id=pd.array([x[2] for x in found], "Int64"))

    rows = in_pandas(files, decode, "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(begins, ["shard", "block"]).select("doc_id", (F.col("begin") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


@query()
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = Scratch(spark, "op7").folder
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 49408)
    return token_file_report(spark, path)
