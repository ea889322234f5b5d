"""Removal of byte strings that an earlier document has too, by distributed suffix sorting.

Suffixes must meet where they share 50 bytes. So every window of 50 bytes is dealt by 29 of its bytes, its sample: the
eight bytes in it whose hash is smallest and the 21 before them, or behind them where fewer stand before. Equal windows
have equal samples, and neighbouring windows mostly share theirs, so they travel as one string. Only samples that
several different texts have are followed up; 29 bytes are seldom shared by chance, so what is followed up grows with what is
really repeated. Different texts are packed into slices; a slice sends the hashes of its samples, narrow and in order,
and gets two bits back for each. A string that a smaller document of the same task had before is removed at once; the
others meet in the task of their sample, where the suffixes of all different strings are sorted (suffixes.py) and each
class of equal windows learns its smallest document. Windows of samples in more than ``OFTEN`` texts are dealt by their
own hash instead, equal ones merged beforehand, so no group grows with the corpus. Of equal whole texts only the
smallest document takes part; the others lose all their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainevents.llm.common import Scratch, query, table, tidy
from chainevents.llm.shingles import mixed
from chainevents.llm.suffixes import DEPTH, suffix_array, words

_U = np.uint64
#: Bytes that a sample is found by, and bytes that it has beside them: any window that holds them has so many on one side.
ANCHOR = 8
BESIDE = (DEPTH - ANCHOR) // 2
#: Most windows in one string, and texts from which a sample is frequent.
LONGEST, OFTEN = 64, 2000
#: Strings that a task remembers at once; when more, it starts anew, and what it then finds again is only sent again.
SEEN = 300_000
#: Stands for a null id: later than all others.
LAST = (1 << 63) - 1
#: Bytes of the texts of a slice (one text more at most), slices whose samples meet in one bucket, and most buckets.
SLICE, MET, BUCKETS = 2_000_000, 8, 4096
#: A text's number is its slice's number and its place there: texts of 50 bytes and more, so a slice has fewer than 2^16.
PLACE = 16
_GROUP = 1 << 21


class Windows:
    """The windows of many texts: ``begin`` and ``end`` of each run of windows with one sample, its text and the sample's hash."""

    def __init__(self, raw: list[bytes]):
        self.data = np.frombuffer(b"".join([*raw, b"\0" * 64]), np.uint8)
        sizes = np.array([len(r) for r in raw], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        n = int(self.starts[-1])
        eight = words(self.data)
        # the place in the lower bits: of equal hashes the leftmost counts, whatever stands before the window
        least = (mixed(eight) & ~_U((1 << 40) - 1)) | np.arange(len(eight), dtype=_U)
        for step in (1, 2, 4, 8, 16):
            least = np.minimum(least[:-step], least[step:])
        spare = DEPTH - ANCHOR + 1 - 32
        at = (np.minimum(least[:-spare], least[spare:])[:n] & _U((1 << 40) - 1)).astype(np.int64)
        sample = np.where(at - np.arange(n) >= BESIDE, at - BESIDE, at)
        valid = np.zeros(n + 1, bool)
        edge = np.zeros(n + 2, np.int64)
        long = sizes >= DEPTH
        np.add.at(edge, self.starts[:-1][long], 1)
        np.add.at(edge, self.starts[1:][long] - DEPTH + 1, -1)
        valid[:n] = np.cumsum(edge)[:n] > 0
        fresh = np.zeros(n + 1, bool)
        fresh[1:n] = sample[1:] != sample[: n - 1] if n else False
        fresh[self.starts[:-1][long]] = True
        begin = np.flatnonzero(fresh & valid)
        stop = np.flatnonzero((fresh | ~valid)[1:]) + 1
        end = stop[np.searchsorted(stop, begin, side="right")] if len(begin) else begin
        first = sample[begin]
        hashes = mixed(eight[first + BESIDE + ANCHOR - 8])
        for k in range(0, BESIDE + ANCHOR - 8, 8):
            hashes = mixed(hashes + eight[first + k])
        alone = np.ones(len(begin), bool)  # in periodic text equal samples follow each other
        alone[1:] = (begin[1:] != end[:-1]) | (hashes[1:] != hashes[:-1])
        self.begin, self.hashes = begin[alone], hashes[alone]
        self.end = end[np.append(np.flatnonzero(alone)[1:], len(begin)) - 1] if len(begin) else end
        self.text = np.searchsorted(self.starts, self.begin, side="right") - 1

    def strings(self, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
        """The bytes of the windows ``begin`` to ``end``."""
        whole = self.data.tobytes()
        return [whole[a : b + DEPTH - 1] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """The 48 higher bits of the different samples' hashes, in order, and how many texts have each."""
        pairs = np.sort((self.hashes & ~_U((1 << PLACE) - 1)) | self.text.astype(_U))
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
        return np.unique(pairs >> _U(PLACE), return_counts=True)


def _ranges(owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each owner, merged where they touch; sorted by owner and place."""
    order = np.lexsort((low, owner))
    owner, low, high = owner[order], low[order], high[order]
    if not len(owner):
        return owner, low, high
    base = owner.astype(np.int64) * (1 << 40)
    reach = np.maximum.accumulate(base + high)
    new = np.concatenate([[True], (base + low)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], low[first], reach[last] - base[last]


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), text.alias("text")).select("*", *_identity(F.col("text")))


def _identity(text: F.Column) -> list[F.Column]:
    """``key`` and ``check``: 128 bits that tell whole texts apart, as two hashes with different seeds."""
    return [F.xxhash64(text).alias("key"), F.xxhash64(F.lit(7), text).alias("check")]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of texts, a compressed row each, by id; numbers tell the slices of all tasks apart."""
    number = TaskContext.get().partitionId() << 20
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def row() -> pa.RecordBatch:
        held.sort(key=lambda r: r[0])
        ids, keys, checks, raw = zip(*held, strict=True)
        texts = pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (ids, keys, checks)), pa.array(raw, pa.large_binary())], ["id", "key", "check", "text"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(texts)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["slice", "data"])

    for batch in batches:
        ids, keys, checks = (batch.column(c).to_pylist() for c in ("id", "key", "check"))
        for text in zip(ids, keys, checks, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            held.append(text)
            size += len(text[3])
            if size >= SLICE:
                yield row()
                held, size, number = [], 0, number + 1
    if held:
        yield row()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Ids, both hashes and bytes of a slice's texts."""
    texts = pa.ipc.open_stream(pa.py_buffer(data)).read_all()
    return *(texts.column(c).to_numpy() for c in ("id", "key", "check")), texts.column("text").to_pylist()


def _dealt(values: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of the buckets begins in the ordered ``values`` of 48 bits, and the last one ends."""
    return np.searchsorted((values * _U(buckets)) >> _U(48), np.arange(buckets + 1, dtype=_U))


def _samples(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Six bytes of each different sample of a slice, and the number of its texts in two; the rows of a bucket by byte, so that they shrink."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("slice").to_pylist(), batch.column("data"), strict=True):
                values, counts = Windows(_unpacked(data.as_py())[3]).samples()
                cuts = _dealt(values, buckets)
                bytes_of = ((values << _U(16)) | counts.astype(_U)).astype(">u8").view(np.uint8).reshape(-1, 8)
                full = np.flatnonzero(np.diff(cuts)).tolist()
                each = [bytes_of[cuts[b] : cuts[b + 1]].T.tobytes() for b in full]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array(each, pa.binary())], ["slice", "at", "data"])

    return rows


def _recurring(often: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each row of samples a bit for each that several texts have, then one for each that more than ``often`` have; rows come sorted by bucket."""

    def answers(bucket: int, slices: list[int], rows: list[bytes]) -> pa.RecordBatch:
        joined = np.concatenate([np.frombuffer(r, np.uint8).reshape(8, -1).T for r in rows])
        joined = np.ascontiguousarray(joined).view(">u8").ravel().astype(_U)
        values, counts = joined >> _U(16), (joined & _U(0xFFFF)).astype(np.int64)
        order = np.argsort(values)
        new = np.append(True, values[order][1:] != values[order][:-1])
        total = np.empty(len(order), np.int64)
        total[order] = np.add.reduceat(counts[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        ends = np.cumsum([len(r) // 8 for r in rows]).tolist()
        bits = [np.packbits(np.concatenate([t > 1, t > often])).tobytes() for t in (total[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True))]
        return pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array(bits, pa.binary())], ["slice", "at", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, slices, held = -1, [], []
        for batch in batches:
            for number, bucket, data in zip(*(batch.column(c).to_pylist() for c in ("slice", "at", "data")), strict=True):
                if bucket != now and held:
                    yield answers(now, slices, held)
                    slices, held = [], []
                now = bucket
                slices.append(number)
                held.append(data)
        if held:
            yield answers(now, slices, held)

    return run


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, list[pa.RecordBatch]]]:
    """Each slice with the other rows that came for it; rows come sorted by ``slice`` and ``at``, which is -1 for its texts."""
    number, data, rest = -1, None, []
    for batch in batches:
        heads = np.flatnonzero(batch.column("at").to_numpy() == -1).tolist()
        rest.append(batch.slice(0, heads[0] if heads else batch.num_rows))
        for k, end in zip(heads, [*heads, batch.num_rows][1:], strict=True):
            if data is not None:
                yield number, data, rest
            number, data, rest = batch.column("slice")[k].as_py(), batch.column("data")[k].as_py(), [batch.slice(k + 1, end - k - 1)]
    if data is not None:
        yield number, data, rest


def _times(found: Windows, rows: list[pa.RecordBatch], buckets: int) -> np.ndarray:
    """Of each run of windows: 0 if one text has its sample, 1 if several have it, 2 if it is frequent."""
    values, _ = found.samples()
    cuts = _dealt(values, buckets)
    times = np.zeros(len(values), np.int64)
    for batch in rows:
        for b, data in zip(batch.column("at").to_pylist(), batch.column("data").to_pylist(), strict=True):
            n = int(cuts[b + 1] - cuts[b])
            times[cuts[b] : cuts[b + 1]] = np.unpackbits(np.frombuffer(data, np.uint8), count=2 * n).reshape(2, n).sum(axis=0)
    return times[np.searchsorted(values, found.hashes >> _U(PLACE))]


def _strings(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Strings to be met elsewhere (``bytes`` set), and ranges that a smaller document of the task has already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for number, data, rows in _sliced(batches):
            ids, _, _, raw = _unpacked(data)
            found = Windows(raw)
            times = _times(found, rows, buckets)
            step = np.where(times > 1, 1, LONGEST)
            keep = times > 0
            begin, end, step, text, hashes = (x[keep] for x in (found.begin, found.end, step, found.text, found.hashes.view(np.int64)))
            pieces = -(-(end - begin) // step)
            which = np.repeat(np.arange(len(begin)), pieces)
            place = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            low = begin[which] + place * step[which]
            high = np.minimum(low + step[which], end[which])
            text, hashes, alone = text[which], hashes[which], step[which] == 1
            strings = found.strings(low, high)
            if len(seen) > SEEN:
                seen.clear()
            first = np.fromiter((seen.setdefault(s, i) for s, i in zip(strings, ids[text].tolist(), strict=True)), np.int64, len(strings))
            at, docs = low - found.starts[text], (number << PLACE) + np.arange(len(raw))
            gone = ids[text] > first
            owner, lo, hi = _ranges(text[gone], at[gone], at[gone] + (high - low)[gone] + DEPTH - 1)
            yield _found(docs[owner], lo, hi)
            sent = np.flatnonzero(~gone)
            deal = np.where(alone[sent], np.fromiter((hash_bytes(strings[k]) if alone[k] else 0 for k in sent.tolist()), np.int64, len(sent)), hashes[sent])
            for k in range(0, len(sent), 50_000):
                s = sent[k : k + 50_000]
                place = pa.array(at[s].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[text[s]]), place, place, pa.array(deal[k : k + 50_000]), pa.array(ids[text[s]]), pa.array([strings[j] for j in s.tolist()], pa.binary())],
                    ["doc", "low", "high", "deal", "id", "bytes"],
                )

    return run


def hash_bytes(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _found(docs: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    n, none = len(docs), pa.nulls
    return pa.RecordBatch.from_arrays(
        [pa.array(docs, pa.int64()), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.binary())],
        ["doc", "low", "high", "deal", "id", "bytes"],
    )


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of one deal, several at a time; rows come sorted by deal."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        deals = batch.column("deal")
        if size > _GROUP and (deals[0] != deals[-1] or len(held) > 1 and held[-2].column("deal")[-1] != deals[0]):
            deal = deals.to_numpy()
            cut = int(np.searchsorted(deal, deal[-1]))
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held, size = [batch.slice(cut)], batch.slice(cut).nbytes
    if held:
        yield pa.Table.from_batches(held)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _sorted_groups(batches):
        deal, doc, low, number = (rows.column(c).to_numpy() for c in ("deal", "id", "low", "doc"))
        low = low.astype(np.int64)
        texts = rows.column("bytes").to_pylist()
        first: dict[bytes, int] = {}  # equal strings have equal samples, and so one deal
        same = np.fromiter((first.setdefault(x, k) for k, x in enumerate(texts)), np.int64, len(texts))
        least = np.full(len(texts), LAST)
        np.minimum.at(least, same, doc)
        different = np.unique(same)
        owners = [np.flatnonzero(doc > least[same])]
        lows, highs = [low[owners[0]]], [low[owners[0]] + np.array([len(texts[k]) for k in owners[0].tolist()], np.int64)]
        # strings that share a group with another one: their suffixes are sorted
        _, group, members = np.unique(deal[different], return_inverse=True, return_counts=True)
        met = different[members[group] > 1]
        if len(met):
            sizes = np.array([len(texts[k]) for k in met.tolist()], np.int64)
            data = np.frombuffer(b"".join(texts[k] for k in met.tolist()), np.uint8)
            counts = sizes - DEPTH + 1
            string = np.repeat(np.arange(len(met)), counts)
            inside = np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts)
            starts = (np.cumsum(sizes) - sizes)[string] + inside
            order, label = suffix_array(data, starts, group[members[group] > 1][string])
            smallest = np.full(label[-1] + 1, LAST)
            np.minimum.at(smallest, label, least[met][string[order]])
            window = np.empty(len(order), np.int64)
            window[order] = smallest[label]
            # each row of a string is held against the windows of the string
            place = np.full(len(texts), -1)
            place[met] = np.arange(len(met))
            row = np.flatnonzero((place[same] >= 0) & (doc == least[same]))
            of = place[same[row]]
            each = counts[of]
            at = np.repeat((np.cumsum(counts) - counts)[of], each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            row = np.repeat(row, each)
            gone = window[at] < doc[row]
            owners.append(row[gone])
            lows.append(low[row[gone]] + inside[at[gone]])
            highs.append(lows[-1] + DEPTH)
        owner, lo, hi = (np.concatenate(x) for x in (owners, lows, highs))
        numbers, text = np.unique(number, return_inverse=True)
        owner, lo, hi = _ranges(text[owner], lo, hi)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[owner]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["doc", "low", "high"])


def _cut_out(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What is left of each text that loses bytes: as ``kept`` if ``whole``, else counts and hash only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, rows in _sliced(batches):
            given = pa.Table.from_batches(rows)
            if not given.num_rows:
                continue
            _, keys, checks, raw = _unpacked(data)
            text, low, high = _ranges(*(given.column(c).to_numpy().astype(np.int64) for c in ("at", "low", "high")))
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1])).tolist()
            removed, hashes, kept = [], [], []
            for a, b in zip(first, [*first[1:], len(text)], strict=True):
                full = raw[text[a]]
                rest = b"".join(full[x:y] for x, y in zip([0, *high[a:b].tolist()], [*low[a:b].tolist(), len(full)], strict=True))
                removed.append(len(full) - len(rest))
                kept.append(rest.decode("utf-8", "ignore") if whole else None)
                hashes.append(None if whole else hashlib.sha256(rest).hexdigest())
            spans, at = np.diff([*first, len(text)]), text[first]
            yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(checks[at]), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(hashes, pa.string()), pa.array(kept, pa.string())], ["key", "check", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _together(slices: DataFrame, others: DataFrame) -> DataFrame:
    """Slices, each with the rows for it behind it."""
    first = [F.lit(-1).cast("int").alias("at") if c == "at" else F.col(c) if c in slices.columns else F.lit(None).alias(c) for c in others.columns]
    return slices.select(*first).unionByName(others).repartition("slice").sortWithinPartitions("slice", "at")


def removed_ranges(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Slices of the different texts (``slice, data``), and ``slice, at, low, high, data`` (null) of what goes from the text at a place in its slice."""
    rows = _identified(docs, id_col, text_col).where(F.octet_length("text") >= DEPTH)
    own = ["key", "check", "id"]
    texts = rows.join(rows.groupBy("key", "check").agg(F.min("id").alias("id")), own).dropDuplicates(own)
    slices = scratch.write(texts.select("id", "key", "check", "text").mapInArrow(tidy(_packed), "slice long, data binary"), "slices")
    buckets, row = min(BUCKETS, 1 + slices.count() // MET), "slice long, at int, data binary"
    samples = slices.mapInArrow(tidy(_samples(buckets)), row).repartition("at").sortWithinPartitions("at")
    marks = scratch.write(samples.mapInArrow(tidy(_recurring(OFTEN)), row), "marks")
    strings = scratch.write(_together(slices, marks).mapInArrow(tidy(_strings(buckets)), "doc long, low int, high int, deal long, id long, bytes binary"), "strings")
    scratch.drop("marks")
    sent = strings.where("bytes is not null").select("doc", "low", "deal", "id", "bytes").repartition("deal").sortWithinPartitions("deal")
    ranges = scratch.write(strings.where("bytes is null").select("doc", "low", "high").union(sent.mapInArrow(tidy(_meet), "doc long, low int, high int")), "ranges")
    scratch.drop("strings")
    number = F.call_function("shiftright", "doc", F.lit(PLACE))
    place = F.col("doc").bitwiseAND((1 << PLACE) - 1).cast("int")
    return slices, ranges.select(number.alias("slice"), place.alias("at"), "low", "high", F.lit(None).cast("binary").alias("data"))


def _verdicts(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, whole: bool) -> tuple[DataFrame, DataFrame]:
    """By ``key`` and ``check`` of the text: the document that keeps it (``first``); and what was cut out of that document's text."""
    slices, ranges = removed_ranges(docs, scratch, id_col, text_col)
    cut = _together(slices, ranges).mapInArrow(tidy(_cut_out(whole)), "key long, check long, n_removed long, n_spans long, kept_sha256 string, kept string")
    cut = scratch.write(cut, "cut")
    scratch.drop("slices")
    scratch.drop("ranges")
    firsts = _identified(docs, id_col, text_col).groupBy("key", "check").agg(F.min("id").alias("first"))
    return firsts, cut


def _copy() -> F.Column:
    """A later document with a text that an earlier one has: all of it goes."""
    return (F.col("id") > F.col("first")) & (F.col("n_bytes") >= DEPTH)


def _own() -> F.Column:
    return (F.col("id") == F.col("first")) & F.col("n_removed").isNotNull()


def suffix_dedup(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A byte goes if a 50-byte string covers it that also starts in a document with a smaller id. Null text counts as
    empty, null ids are later than all others and not smaller than each other, rows of one id never act on each other;
    an empty table gives an empty result.
    """
    firsts, cut = _verdicts(docs, scratch, id_col, text_col, False)
    rows = _identified(docs, id_col, text_col).select("id", "key", "check", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    met = rows.join(firsts, ["key", "check"]).join(cut.drop("kept"), ["key", "check"], "left")
    pick = lambda all_gone, some, none: F.when(_copy(), all_gone).when(_own(), some).otherwise(none)
    return met.select(
        F.when(F.col("id") < LAST, F.col("id")).alias("doc_id"),
        "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept_sha256"), F.col("whole")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text; characters that a cut leaves incomplete go too.

    Rules as in :func:`suffix_dedup`; every row and every other column stays.
    """
    firsts, cut = _verdicts(docs, scratch, id_col, text_col, True)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), *_identity(text), F.octet_length(text).alias("n_bytes"))
    met = rows.join(firsts, ["key", "check"]).join(cut.select("key", "check", "n_removed", "kept"), ["key", "check"], "left")
    left = F.when(_copy(), F.lit("")).when(_own(), F.col("kept")).otherwise(F.col("row")[text_col])
    return met.select(*[left.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


@query()
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))
