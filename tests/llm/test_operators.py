"""Each operator against a plain version, on awkward rows, on an empty table, and with clashing columns."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from cases import CLASHES, awkward_rows, crc, documents, plain_components, plain_repeats, prose, shingles_of
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chainevents.llm import bpe, exact_dedup, html_text, jaccard, packing, quality, suffix_dedup, token_files, topk, toxicity
from chainevents.llm.common import Scratch
from chainevents.llm.components import components
from chainevents.llm.suffixes import BlindTrie, multikey_quicksort, suffix_array
from chainevents.llm.tokens import PartEncoder, slices

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "  a  b\n c \n\n d  ", "x <|endoftext|>  y", " <|endoftext|>", "a ́b I'M it's 'S  ΑΣ ΣΑ", "\x1c a\x1cb \x85   　 z", "a\t b\r\n", "İstanbul ﬁ ǅ", " ", "   ",
    "é é 한 한", "<|startoftext|> 12 34 <|endoftext|>", "a.b, c., d'., e.'s .. ,", "a" * 700, "=" * 500, "-_" * 300, "x" * 99 + " " * 70 + "y", "abc\n" * 60, "日本語" * 80,
]


@pytest.fixture
def scratch(spark):
    class Fresh:  # a new folder for each operator call
        def write(self, frame, name):
            return Scratch(spark, "test").write(frame, name)

        def drop(self, name):
            pass

        folder = Scratch(spark, "test").folder

    return Fresh()


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def clashing(spark):
    return documents(spark, clashes=True)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


# --- exact dedup -----------------------------------------------------------------


def test_exact_dedup(docs, empty, scratch):
    got = exact_dedup.dedup_report(docs, scratch).collect()
    rows = [(r.doc_id, r.text or "") for r in awkward_rows()]
    sizes = Counter(t for _, t in rows)
    best = {t: max((i for i, x in rows if x == t and i is not None), default=None) for t in sizes}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(((i, best[t], sizes[t], digest(t)) for i, t in rows), key=key)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(map(digest, sizes))
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.dedup_report(empty, scratch).collect() == []


def test_exact_dedup_rows(clashing, scratch):
    got = exact_dedup.exact_dedup(clashing, scratch)
    assert got.columns == clashing.columns
    rows = got.collect()
    assert Counter(r.text or "" for r in rows) == Counter({r.text or "" for r in awkward_rows()})
    assert all(r[name] == name for r in rows for name in CLASHES)


def test_heavy_digests_do_not_reach_the_window(spark, scratch):
    rows = [Row(doc_id=k, text="same" if k % 3 else f"text {k}", lang="", source="", n_chars=0) for k in range(900)]
    winners = exact_dedup.heavy_winners(exact_dedup._digested(documents(spark, rows).selectExpr("doc_id AS id", "text"))).collect()
    assert [(r.heavy_keep, r.heavy_size) for r in winners if r.heavy_size > 5] == [(899, 600)]


# --- packing ---------------------------------------------------------------------


def test_packing(docs, empty, scratch):
    got = [r.asDict() for r in packing.packed_documents(docs, scratch, capacity=256).collect()]
    tokenizer = Tokenizer.from_file(BYTES)
    ids = [(r.doc_id, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in awkward_rows()]
    want = Counter()
    for name, own in ids:
        head = len(own) - 256 * ((len(own) - 1) // 256)
        at = 0
        for piece, size in enumerate([head, *[256] * ((len(own) - 1) // 256)]):
            want[name, piece, at, size, crc(own[at : at + size])] += 1
            at += size
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-sum(r["length"] for r in got) // 256) + 1
    assert packing.packed_documents(empty, scratch).collect() == []


def test_packing_rounds_merge_bins(spark, scratch):
    sizes = [random.Random(5).randint(1, 100) for _ in range(3000)]
    pieces = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "item long, length long").repartition(20)
    got = packing.pack(pieces, 100, scratch).collect()
    assert sorted(r.item for r in got) == list(range(3000))
    alone = packing.best_fit(np.array(sizes), 100)[0].max() + 1
    assert len({r.sequence_id for r in got}) <= 1.03 * alone


def test_packing_fills_bins_of_a_hot_partition(spark, scratch):
    """One partition holds 10,000 long items, the others only short ones that fit beside them."""
    long, short = (F.lit(a) + F.pmod(F.xxhash64("id"), F.lit(b)) for a, b in ((1100, 801), (50, 151)))
    pieces = spark.range(0, 40_000, 1, 4).select(F.col("id").alias("item"), F.when(F.col("id") < 10_000, long).otherwise(short).alias("length"))
    got = packing.pack(pieces, 2048, scratch).toPandas()
    assert sorted(got["item"]) == list(range(40_000))
    ends = got.groupby("sequence_id").agg({"length": "sum", "offset": "nunique", "item": "size"})
    assert (ends["length"] <= 2048).all() and (ends["offset"] == ends["item"]).all()
    alone = packing.best_fit(got["length"].to_numpy(), 2048)[0].max() + 1
    assert len(ends) <= 1.005 * alone


def test_merge_rounds_leave_no_two_bins_that_fit(spark, scratch, monkeypatch):
    """Also where a round has several tasks."""
    monkeypatch.setattr(packing, "MERGED", 20)
    pieces = spark.range(0, 120, 1, 60).select(F.col("id").alias("item"), (F.lit(1) + F.pmod(F.xxhash64("id"), F.lit(3))).alias("length"))
    got = packing.pack(pieces, 8, scratch).toPandas()
    filled = sorted(got.groupby("sequence_id")["length"].sum())
    assert filled[-1] <= 8 < filled[0] + filled[1] and got["item"].is_unique and len(got) == 120


def test_best_fit_takes_the_tightest_bin():
    bins, starts = packing.best_fit(np.array([6, 5, 4, 5, 3]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 2] and starts.tolist() == [0, 0, 6, 5, 0]


# --- suffix sorting --------------------------------------------------------------


def test_suffix_dedup(docs, empty, scratch):
    texts = [(r.doc_id, r.text) for r in awkward_rows()]
    want = Counter()
    for (i, _), (raw, mark) in zip(texts, plain_repeats(texts), strict=True):
        rest = bytes(b for b, m in zip(raw, mark, strict=True) if not m)
        spans = sum(m and (k == 0 or not mark[k - 1]) for k, m in enumerate(mark))
        want[i, len(raw), sum(mark), spans, hashlib.sha256(rest).hexdigest()] += 1
    assert Counter(tuple(r) for r in suffix_dedup.suffix_dedup(docs, scratch).collect()) == want
    assert suffix_dedup.suffix_dedup(empty, scratch).collect() == []


def test_suffix_dedup_texts(clashing, scratch):
    got = suffix_dedup.without_repeats(clashing, scratch)
    assert got.columns == clashing.columns
    texts = [(r.doc_id, r.text) for r in awkward_rows()]
    want = Counter()
    for (i, text), (raw, mark) in zip(texts, plain_repeats(texts), strict=True):
        rest = bytes(b for b, m in zip(raw, mark, strict=True) if not m).decode("utf-8", "ignore")
        want[i, text if not any(mark) else rest] += 1
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want


def test_texts_of_one_hash_keep_their_bytes(spark, scratch, monkeypatch):
    """Texts are told apart by both hashes: where the first is equal, nothing that differs goes."""
    both = suffix_dedup._identity
    monkeypatch.setattr(suffix_dedup, "_identity", lambda text: [F.lit(5).cast("long").alias("key"), both(text)[1]])
    a, b = "".join(f"first {k} " for k in range(20)), "".join(f"second {k} " for k in range(20))
    frame = spark.createDataFrame([(1, a), (2, b), (3, a), (4, b)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(frame, scratch).collect()}
    assert got == {1: 0, 2: 0, 3: len(a), 4: len(b)}
    assert {r.doc_id: r.text for r in suffix_dedup.without_repeats(frame, scratch).collect()} == {1: a, 2: b, 3: "", 4: ""}


def test_suffix_array_orders_and_classes():
    chance = random.Random(3)
    data = np.frombuffer("".join(chance.choice("ab") * chance.randint(1, 30) for _ in range(300)).encode() + b"q" * 60, np.uint8)
    starts, group = np.arange(len(data) - 60), np.arange(len(data) - 60) % 3
    order, label = suffix_array(data, starts, group)
    raw = data.tobytes()
    prefix = [(int(group[k]), raw[k : k + 50]) for k in range(len(starts))]
    ordered = [prefix[k] for k in order.tolist()]
    assert ordered == sorted(prefix)
    assert all((ordered[k] == ordered[k - 1]) == (label[k] == label[k - 1]) for k in range(1, len(order)))


def test_multikey_quicksort_splits_large_segments():
    chance = np.random.default_rng(1)
    keys = [chance.integers(0, n, 30_000).astype(np.uint64) for n in (3, 5, 1 << 60)]
    order = multikey_quicksort(keys)
    rows = list(zip(*[k[order].tolist() for k in keys], strict=True))
    assert rows == sorted(rows) and sorted(order.tolist()) == list(range(30_000))


def test_blind_trie():
    trie, texts = BlindTrie(), [b"aab", b"aaa", b"bba", b"aab", b"abb", b"bbb"]
    for k, t in enumerate(texts):
        trie.insert(t, [k])
    assert [[texts[k] for k in m] for m in trie.leaves()] == [[b"aaa"], [b"aab", b"aab"], [b"abb"], [b"bba"], [b"bbb"]]


def test_frequent_anchors_go_by_window(spark, scratch, monkeypatch):
    passage = prose(77, 40)
    rows = [(k, prose(100 + k, 12) + " " + passage + " " + prose(300 + k, 9)) for k in range(30)]
    frame = documents(spark, [Row(doc_id=i, text=t, lang="", source="", n_chars=0) for i, t in rows])
    monkeypatch.setattr(suffix_dedup, "OFTEN", 4)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(frame, scratch).collect()}
    assert got == {i: sum(m) for (i, _), (_, m) in zip(rows, plain_repeats(rows), strict=True)}


def test_phrases_shared_by_chance_are_not_sent(spark, scratch):
    """A string travels if texts share 29 bytes around its anchor, not for a phrase of 16 that many texts have."""
    phrases = [prose(900 + k, 3)[:20] for k in range(8)]
    rows = [(k, " ".join(f"{phrases[(k + j) % 8]} {hashlib.sha256(bytes([k, j])).hexdigest()[:12]}" for j in range(40))) for k in range(30)]
    passage = prose(78, 30)
    rows += [(40, passage), (41, f"{rows[0][1]} {passage}")]
    sent = []

    class Kept:
        def write(self, frame, name):
            written = scratch.write(frame, name)
            if name == "strings":
                sent.append(written.select("bytes").where("bytes is not null").collect())
            return written

        drop = scratch.drop

    frame = documents(spark, [Row(doc_id=i, text=t, lang="", source="", n_chars=0) for i, t in rows])
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(frame, Kept()).collect()}
    assert got == {i: sum(m) for (i, _), (_, m) in zip(rows, plain_repeats(rows), strict=True)} and got[41] > 1_000
    shared = [bytes(r.bytes) for r in sent[0]]
    assert shared and all(any(r in t.encode() for k, t in rows if k in (0, 40, 41)) for r in shared)


def test_slices_of_many_batches(spark, scratch, monkeypatch):
    """Also where a slice's rows come in several batches, and slices and buckets are many."""
    for name, value in (("SLICE", 3_000), ("MET", 1)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = [(k, " ".join(prose((k * 7 + j) % 23, 25) for j in range(3)) + " " + "=-" * (k % 5 * 40)) for k in range(60)]
    frame = documents(spark, [Row(doc_id=i, text=t, lang="", source="", n_chars=0) for i, t in rows]).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(frame, scratch).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: sum(m) for (i, _), (_, m) in zip(rows, plain_repeats(rows), strict=True)}


# --- similarity join -------------------------------------------------------------


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 60)])
def test_jaccard_components(docs, empty, scratch, n, percent):
    got = jaccard.jaccard_components(docs, scratch, n, percent)
    key = lambda x: str(x)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain_components([(r.doc_id, r.text) for r in awkward_rows()], n, percent), key=key)
    if n == 4:
        assert jaccard.jaccard_components(empty, scratch, n, percent).collect() == []


def test_near_dedup_leaves_no_large_tables(spark):
    """What is left beside the result, and so beside later stages of a pipeline, holds no texts, sets or signatures."""
    own = Scratch(spark, "near")
    frame = documents(spark, [Row(doc_id=k, text=prose(k // 3, 60) + (" more" if k % 3 == 1 else ""), lang="", source="", n_chars=0) for k in range(60)])
    left = jaccard.near_dedup(frame, own)
    assert {p.name for p in Path(own.folder).iterdir()} & {"signed", "names", "placed", "given", "sets"} == set()
    assert sorted(r.doc_id for r in left.collect()) == list(range(0, 60, 3))


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_components_on_varied_copies(spark, scratch, seed):
    chance = random.Random(seed)
    texts = []
    for k in range(25):
        words = prose(seed * 100 + k, chance.choice([3, 6, 9, 14, 25, 60, 200])).split(" ")
        for _ in range(chance.randint(1, 6)):
            texts.append(" ".join(words))
            for _ in range(chance.randint(0, 1 + len(words) // 40)):
                words[chance.randrange(len(words))] = f"new{chance.randint(0, 99)}"
            words = words[: len(words) - chance.randint(0, len(words) // 15)]
    chance.shuffle(texts)
    rows = list(enumerate(texts))
    frame = documents(spark, [Row(doc_id=i, text=t, lang="", source="", n_chars=0) for i, t in rows])
    got = jaccard.jaccard_components(frame.repartition(5), scratch, 2, 80).collect()
    assert sorted(tuple(r) for r in got) == plain_components(rows, 2, 80)


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_join_has_every_link(spark, scratch, monkeypatch, block):
    """Different near copies of a few texts, also where a component has several blocks; equal texts are one set."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "AT_ONCE", 50)
    chance, texts = random.Random(4), ["", None, "one"]
    for k in range(4):
        words = prose(700 + k, 60).split(" ")
        for j in range(9):
            texts.append(" ".join(f"new{j}" if chance.random() < 0.03 else w for w in words))
    rows = list(enumerate(texts + texts[-5:]))
    frame = documents(spark, [Row(doc_id=i, text=t, lang="", source="", n_chars=0) for i, t in rows])
    report, links = jaccard.jaccard_join(frame.repartition(5), scratch, 2, 80)
    got, found = report.collect(), links.collect()
    sets = {i: frozenset(shingles_of(t, 2)) for i, t in rows}
    both = {frozenset((a, b)): len(a & b) for a in sets.values() for b in sets.values() if a != b and 100 * len(a & b) >= 80 * len(a | b)}
    named = {r.set_id: sets[r.doc_id] for r in got if r.set_id is not None}
    assert len(set(named.values())) == len(named) == len({s for s in sets.values() if s})
    assert len(found) == len(both) > len(named) and all(r.set_u < r.set_v for r in found)
    assert {frozenset((named[r.set_u], named[r.set_v])): r.n_both for r in found} == both
    assert all(r.n_links == sum(sets[r.doc_id] in pair for pair in both) for r in got)
    assert sorted(tuple(r)[:3] for r in got) == plain_components(rows, 2, 80)


def test_near_dedup_keeps_columns(clashing, scratch):
    got = jaccard.near_dedup(clashing, scratch)
    assert got.columns == clashing.columns
    texts = [(r.doc_id, r.text) for r in awkward_rows()]
    # One row of each component; rows without words are linked with nothing and all stay.
    keep = Counter(i for i, n, _ in plain_components(texts, 5, 80) if not n) + Counter({c for _, n, c in plain_components(texts, 5, 80) if n})
    assert Counter(r.doc_id for r in got.collect()) == keep


def test_near_dedup_decides_by_row(spark, scratch):
    near = prose(1, 120).split(" ")
    near[60] = "changed"
    texts = [(1, prose(1, 120)), (2, " ".join(near)), (2, prose(9, 80)), (None, prose(1, 120)), (None, prose(30, 40)), (None, prose(30, 40))]
    kept = jaccard.near_dedup(documents(spark, [Row(doc_id=i, text=t, lang="", source="", n_chars=0) for i, t in texts]), scratch).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([texts[0], texts[2], texts[4]])


def test_components_of_a_chain(spark, scratch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40) if k != 17] + [(60, 50), (50, 60), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges, scratch, "c").collect()}
    assert got == {k: 0 if k <= 17 else 18 for k in range(41)} | {50: 50, 60: 50}


# --- tokens ----------------------------------------------------------------------


@pytest.mark.parametrize("path,kept", [(BYTES, True), (WORDS, False)])
def test_part_encoder_equals_library(path, kept):
    plain, ours = Tokenizer.from_file(path), PartEncoder(path, kept, limit=50)
    texts = [*ODD, *[r.text or "" for r in awkward_rows()], *[prose(k, 30) for k in range(20)]] * 2
    for a, b in slices(texts, 2000):
        ids, bounds = ours.encode(texts[a:b])
        for k in range(b - a):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == plain.encode(texts[a + k], add_special_tokens=False).ids
    assert ours.encode([])[0].tolist() == []


def test_streaming_bpe_equals_library():
    plain, ours, chance = Tokenizer.from_file(BYTES), bpe.StreamingEncoder(BYTES), random.Random(2)
    texts = [*ODD, *["".join(chance.choice("aeinrst AB.é'1\n-") for _ in range(chance.randint(1, 300))) for _ in range(60)]]
    for text in texts:
        want = plain.encode(text, add_special_tokens=False).ids
        got = np.fromiter(ours.stream(text), np.int64)
        assert got.tolist() == want
        assert "".join(ours.decoded(got, step=3)) == plain.decode(want, skip_special_tokens=False)


def test_transducer_holds_bounded_state_and_emits_early():
    ours = bpe.StreamingEncoder(BYTES)
    machine, word, emitted = bpe.Transducer(ours.merges), b"abcab" * 3000, []
    for k in range(0, len(word), 500):
        emitted += machine.feed(word[k : k + 500])
        assert len(machine.recent) <= 2 * ours.merges.lookahead + 1
        assert sum(map(len, emitted)) >= k - 2 * ours.merges.lookahead
    emitted += machine.finish()
    assert b"".join(emitted) == word and emitted == ours.merges.merged(word)


def test_bpe_rows(docs, empty):
    plain = Tokenizer.from_file(BYTES)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for r in awkward_rows():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(plain.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(docs, BYTES).collect()) == want
    assert bpe.round_trip(empty, BYTES).collect() == []
    back = bpe.decode_documents(bpe.encode_documents(docs, BYTES), BYTES).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r.doc_id, r.text or "") for r in awkward_rows())


def test_token_files(spark, docs, empty, scratch):
    token_files.write_token_files(docs, f"{scratch.folder}/files", WORDS, 49408)
    got = token_files.token_file_report(spark, f"{scratch.folder}/files").collect()
    plain, start, want = Tokenizer.from_file(WORDS), 0, []
    for r in sorted(awkward_rows(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, (r.text or "").encode())):
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    token_files.write_token_files(empty, f"{scratch.folder}/none", WORDS, 49408)
    assert token_files.token_file_report(spark, f"{scratch.folder}/none").collect() == []


def test_re_pair_is_lossless_and_random_access():
    chance = np.random.default_rng(4)
    ids = np.concatenate([np.tile([5, 6, 7, 1, 1, 1], 300), chance.integers(0, 50, 4000), np.full(101, 9)]).astype(np.uint32)
    ends = np.array([7, 1800, 3000, len(ids)])
    sequence, places, rules, lengths = token_files.compress(ids, ends, 50)
    assert len(rules) and len(sequence) < len(ids)
    tables = token_files.expansions(rules, lengths, 50)
    begin = np.concatenate([[0], places])
    for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        assert token_files.expand(sequence[begin[k] : begin[k + 1]], *tables).tolist() == ids[a:b].tolist()


# --- search ----------------------------------------------------------------------


def plain_top(rows, k):
    out = []
    for q, x in rows:
        if q % 2 == 0:
            best = sorted((-int(np.dot(x, y)), v) for v, y in rows if v != q)[:k]
            out += [(q, n + 1, v, -s) for n, (s, v) in enumerate(best)]
    return sorted(out)


def test_exact_top_k(spark, scratch, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "BLOCK", 30)
    chance = random.Random(6)
    rows = [(k, [chance.randint(-3, 3) for _ in range(4)]) for k in range(150)] + [(200 + k, [1, 1, 1, 1]) for k in range(30)]
    odd = [(301, None), (302, []), (303, [1, None, 2, 3]), (None, [1, 2, 3, 4]), rows[3], (304, [9, 9])]
    frame = spark.createDataFrame([*rows, *odd], "vec_id long, vector array<long>").selectExpr("*", "1 AS shard", "2 AS block", "3 AS known", "4 AS size")
    got = topk.exact_top_k(frame, lambda i: i % 2 == 0, scratch, k=5)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, 5)
    assert topk.exact_top_k(frame.where("1 = 0"), lambda i: i % 2 == 0, scratch).collect() == []


def test_ball_tree_prunes():
    chance = np.random.default_rng(0)
    centers = chance.normal(0, 60, (12, 8))
    points = np.round(np.concatenate([c + chance.normal(0, 1, (300, 8)) for c in centers]))
    tree = topk.BallTree(points)
    bounds = tree.bounds(points[:40])
    scores = points[:40] @ points.T
    for k, leaf in enumerate(tree.leaves):
        low, high = tree.spans[leaf]
        assert (points[:40] @ tree.points[low:high].T <= bounds[:, k][:, None]).all()
    kth = -np.sort(-scores, 1)[:, 19]
    assert (bounds >= kth[:, None]).mean() < 0.5


def test_floored(spark):
    rows = [(1, [0.5, -0.01]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 0.0])]
    got = topk.floored(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in got] == [(1, [32, -1])]


# --- classifiers -----------------------------------------------------------------


def rated(spark):
    """Texts of which every fifth has telling words or is junk, and their labels."""
    rows, marks = [], []
    for k in range(400):
        text = prose(k, 60 + k % 90)
        toxic, junk = k % 5 == 0 and k % 7 != 0, k % 7 == 0
        if toxic:
            words = text.split(" ")
            for j in range(1 + k % 4):
                words[(7 * j + k) % len(words)] = f"grumble{'xyz'[j % 3]}"
            text = " ".join(words)
        if junk:
            text = " ".join(w + "%%%" for w in text.split(" ")) if k % 2 else ("same " * len(text.split(" "))).strip()
        rows.append(Row(doc_id=k, text=text, lang="", source="", n_chars=0))
        marks.append((k, int(not junk), int(toxic)))
    return documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), marks


def test_toxicity(spark, scratch, labels, docs, empty, clashing):
    texts, known, marks = rated(spark)
    got = {r.doc_id: r for r in toxicity.toxicity(texts, known.where("doc_id < 300"), scratch).collect()}
    held = [(got[k].predicted, toxic) for k, _, toxic in marks if k >= 300]
    assert len(got) == 400 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and 0 <= r.p_severe <= 1 and r.toxic == (r.score >= 0.5) for r in got.values())
    assert toxicity.toxicity(empty, known, scratch).collect() == []
    assert {r.toxic for r in toxicity.toxicity(docs, labels, scratch).collect()} == {False}
    kept = toxicity.without_toxic(clashing.unionByName(texts.limit(0), allowMissingColumns=True), known, scratch)
    assert kept.columns == clashing.columns and kept.count() == len(awkward_rows())
    assert {r.doc_id for r in toxicity.without_toxic(texts, known, scratch).collect()} == {k for k, r in got.items() if not r.toxic}


def test_chain_feeds_earlier_categories():
    chance = np.random.default_rng(0)
    x = chance.normal(0, 1, (600, 3))
    first = (x[:, 0] > 0).astype(float)
    chain = toxicity.Chain(x, [first, first])
    assert [len(w) for w in chain.weights] == [4, 5]
    assert abs(chain.weights[1][3]) > 0.5
    assert ((chain.predict(x)[:, 1] > 0.5) == first).mean() > 0.97


def test_quality(spark, scratch, labels, docs, empty):
    texts, known, marks = rated(spark)
    got = {r.doc_id: r for r in quality.quality(texts, known, scratch).collect()}
    assert all(r.held_out == quality.held_out(k) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for k, r in got.items())
    held = [(got[k].predicted, good) for k, good, _ in marks if got[k].held_out]
    assert len(held) > 40 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert quality.quality(empty, known, scratch).collect() == []
    odd = quality.quality(docs, known, scratch).collect()
    assert len(odd) == len(awkward_rows()) and all(r.held_out for r in odd if r.doc_id is None) and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in quality.quality(docs, labels, scratch).collect()} == {0.5}


def test_quality_ignores_held_out_labels(spark, scratch):
    texts, known, _ = rated(spark)
    turned = known.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    scores = [sorted((r.doc_id, r.score) for r in quality.quality(texts, labels, scratch).collect()) for labels in (known, turned)]
    assert scores[0] == scores[1]


# --- pages -----------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body>
<header><h1>Site</h1></header><div id="main-menu"><a href=x>Home</a></div><nav><ul><li><a href=/>Go</a></ul></nav><article><h1>Title &eacute;</h1>
<p><b>Short.<br>More &lt;text&gt;<p>And   a <a href="?a=1>2">link</a>.</p><!-- <p>no</p> --><table><tr><td>a<td>b</table><form><label>Mail</label><input></form>
<section class="comments"><p>Nice post, I like it very much and so on.</p></section><ul><li>one<li>two</ul></article>
<aside>Buy this now, it is cheap and good</aside><div class="cookie-notice">We use cookies for long texts.</div><div class="ad">Cheap things here.</div><footer>&copy; us</footer></body>"""


def test_html_extraction(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>unclosed <b"), (1, "u", PAGE), (4, "x", "<article>" + "<div>" * 3000 + "deep" + "</article>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "1 AS n_chars")
    got = html_text.extract(frame).collect()
    want = "Title é Short. More <text> And a link. a b one two"
    assert Counter((r.page_id, r.url) for r in got) == Counter((a, b) for a, b, _ in rows)
    assert [r.text for r in got if r.page_id == 1] == [want, want]
    assert all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 2 or r.page_id is None] == ["", ""]
    assert [r.text for r in got if r.page_id == 4] == ["deep"]
    assert html_text.extract(frame.where("1 = 0")).collect() == []


LONG = "These are the words of a long article that nobody may lose. " * 5


@pytest.mark.parametrize(
    "page",
    [
        '<div style="overflow: hidden"><p>%s</div>', '<div title="the hidden valley"><p>%s</div>', '<div data-hidden="false"><p>%s</div>',
        '<div class="page has-sidebar"><p>%s</div>', '<div class="page no-sidebar"><article><p>%s</article></div>', "<form><main><p>%s</main></form>",
        "<html><head><title>T</title><meta charset=utf-8><body><p>%s", "<head><title>T</title><link rel=x><p>%s", "<head><style>p{}</style>%s",
    ],
)
def test_layout_and_open_head_lose_no_article(page):
    assert html_text.main_text(page % LONG, html_text.trained_tree()) == LONG.strip()


@pytest.mark.parametrize(
    "page", ["<div hidden><p>%s</div>", "<div class='x sidebar'><p>%s</div>", "<div id=site-footer><p>%s</div>", "<article><div class=comments><article>%s</article></div></article>", "<head><title>%s</title><template>%s</template>"]
)
def test_furniture_still_goes(page):
    assert html_text.main_text(page.replace("%s", LONG), html_text.trained_tree()) == ""


def test_tree_fits_its_table():
    known = np.array(html_text.LABELLED, float)
    assert (html_text.trained_tree().predict(known[:, :-1]) == known[:, -1]).all()
