"""Best-fit packing in rounds: pieces are dealt evenly, so that each partition holds long and short ones in the mix of the
whole table and packs them, and the bins that may still merge go on as items of the next best-fit round.

A bin is known by a number and its pieces are rows ``bin, at`` (place in the bin), so merging two bins moves one of
them behind the other. No bin is closed that could make the result shorter. Two bins over half full never fit together,
so each merge saves one bin of at most half, and n of those can save n bins at most, with n fuller partners; where a
fuller partner serves, an emptier one does too. So the 2n emptiest bins of all partitions are all that a round needs.
Best fit leaves at most one bin of at most half per task, so a round reads at most two bins for each task of the one
before; it gets as many tasks as their rows need.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainevents.llm.common import Scratch, in_pandas, narrow, query, table
from chainevents.llm.tokens import encoder, slices

#: Rows that make one task of a merge round (more where a bin may have more).
MERGED = 16_384
#: Ends each document.
END = 0

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: for each item its bin (from 0) and the place where it starts there.

    Open bins stand in one stack per free space; a bit mask over the stacks that are not empty finds the tightest fit.
    """
    bins, starts = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            into = stacks[free].pop()
            if not stacks[free]:
                mask &= ~(1 << free)
        else:
            free, into, made = capacity, made, made + 1
        bins[i], starts[i] = into, capacity - free
        if free > size:
            stacks[free - size].append(into)
            mask |= 1 << (free - size)
    return bins, starts


def _pack(rows: pd.DataFrame, capacity: int, number: int) -> pd.DataFrame:
    """One best-fit round over the bins in ``rows``; ``number`` is the first free bin number of this task."""
    names, first, item = np.unique(rows["bin"].to_numpy(), return_index=True, return_inverse=True)
    sizes = rows["filled"].to_numpy()[first]
    into, shift = best_fit(sizes, capacity)
    filled = np.bincount(into, sizes, int(into.max()) + 1 if len(into) else 0).astype(np.int64)
    return rows.assign(bin=number + into[item], at=rows["at"].to_numpy() + shift[item], filled=filled[into[item]])


def _whole(batches: Iterator[pd.DataFrame]) -> list[pd.DataFrame]:
    """A partition's rows in one frame; none if it is empty."""
    full = [b for b in batches if len(b)]
    return [pd.concat(full, ignore_index=True)] if full else []


def _numbers(level: int) -> int:
    """Bin numbers of a task start here: level, partition and a counter share 63 bits."""
    return (level << 58) | (TaskContext.get().partitionId() << 32)


def cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, start and length of each piece: whole items, longer ones in full pieces behind a shorter first one."""
    pieces = np.maximum(1, -(-lengths // capacity))
    item = np.repeat(np.arange(len(lengths)), pieces)
    place = np.arange(len(item)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    head = lengths - (pieces - 1) * capacity
    start = np.where(place == 0, 0, head[item] + (place - 1) * capacity)
    return item, start, np.where(place == 0, head[item], capacity)


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", remembered: int = 250_000) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document, its end id included."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary, spaces_kept=True, limit=remembered).encode
        for batch in batches:
            texts, names = batch["text"].tolist(), batch["id"]
            for a, b in slices(texts):
                ids, bounds = encode(texts[a:b])
                ends = np.append(ids, np.uint32(END)) if len(ids) else np.array([END], "<u4")
                lengths = np.diff(bounds) + 1
                item, start, length = cut(lengths, capacity)
                crc = np.empty(len(item), np.int64)
                for k, (i, s, n) in enumerate(zip(item.tolist(), start.tolist(), length.tolist(), strict=True)):
                    base = int(bounds[i])
                    stop = min(s + n, int(lengths[i]) - 1)
                    crc[k] = zlib.crc32(ends[base + s : base + stop].tobytes() + (ends[-1:].tobytes() if stop < s + n else b""))
                place = np.arange(len(item)) - np.searchsorted(item, item)
                yield pd.DataFrame({"doc_id": names.iloc[a:b].iloc[item].array, "piece": place.astype(np.int32), "start": start, "length": length, "ids_crc32": crc})

    return in_pandas(narrow(docs, id_col, text_col), pieces, _PIECES)


def _mergeable(rows: DataFrame, capacity: int) -> F.Column | None:
    """Which rows are of the bins that another round needs; None if all bins are over half full."""
    bins = rows.where("at = 0").select("filled", "bin")
    half = bins.where(F.col("filled") * 2 <= capacity).count()
    if not half:
        return None
    last = bins.orderBy("filled", "bin").limit(2 * half).agg(F.max(F.struct("filled", "bin")).alias("last")).first()["last"]
    return (F.col("filled") < last.filled) | (F.col("filled") == last.filled) & (F.col("bin") <= last.bin)


def pack(pieces: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset`` added.

    Other columns are carried along. Equal rows are separate items; an empty table gives an empty result.
    """
    columns = [f"`{x.name}` {x.dataType.simpleString()}" for x in pieces.schema]
    schema = ", ".join([*columns, "bin long", "at long", "filled long"])

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole(batches):
            yield _pack(rows.assign(bin=np.arange(len(rows)), at=0, filled=rows["length"]), capacity, _numbers(0))

    parts, level, done = max(1, pieces.rdd.getNumPartitions()), 0, []
    dealt = pieces.repartition(parts) if parts > 1 else pieces
    rows = scratch.write(in_pandas(dealt, local, schema), "level-0")
    while parts > 1 and (needed := _mergeable(rows, capacity)) is not None:
        level += 1

        def merge(batches: Iterator[pd.DataFrame], level: int = level) -> Iterator[pd.DataFrame]:
            for rows in _whole(batches):
                yield _pack(rows, capacity, _numbers(level))

        going = rows.where(needed)
        parts = -(-going.count() // max(MERGED, 8 * capacity))
        done.append(rows.where(~needed))
        going = going.repartition(parts, "bin") if parts > 1 else going.repartition(1)
        rows = scratch.write(in_pandas(going, merge, schema), f"level-{level}")
    for closed in done:
        rows = rows.unionByName(closed)
    return rows.select(*[F.col(x) for x in pieces.columns], F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))


def packed_documents(docs: DataFrame, scratch: Scratch, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", remembered: int = 250_000) -> DataFrame:
    """Documents as token ids in as few sequences of at most ``capacity`` ids as best fit finds, one row per piece.

    Null text counts as empty and makes a piece of the end id alone; null ids and repeated rows are packed like others.
    ``remembered`` is the number of text parts whose ids a worker keeps: memory against time.
    """
    import public_tokenizers

    return pack(tokenized_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity, id_col, text_col, remembered), capacity, scratch)


@query()
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), Scratch(spark, "op1"))
