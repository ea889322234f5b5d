"""Centroid clusters, b-bit MinHash and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import CLASHES, awkward_rows, documents, plain_components, prose
from pyspark.sql import Row
from pyspark.sql import functions as F

from chainevents.llm import centroids, linking, minhash, resampling
from chainevents.llm.common import Scratch
from chainevents.llm.shingles import shingle_sets


@pytest.fixture
def scratch(spark):
    class Fresh:
        def write(self, frame, name):
            return Scratch(spark, "test").write(frame, name)

        def drop(self, name):
            pass

        folder = "unused"

    return Fresh()


# --- centroid clusters -----------------------------------------------------------


def plain_clusters(rows, k, rounds, size, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)) + sorted(("z", v) for i, v in kept if i is None)
    centers = [v for _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, members in groups.items():
            centers[n] = [sum(x) // len(members) for x in zip(*members)]
    return sorted(((i, *near(v)[::-1]) for i, v in kept), key=repr), centers


def vectors(spark, clashes=False):
    random.seed(5)
    rows = [(i, [float(np.float32(random.gauss(i % 3, 0.4))) for _ in range(4)]) for i in range(60)]
    rows += [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [1.0, 2.0]), (103, []), (104, [float("nan")] * 4), (105, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(None, [0.5, 0.5, 0.5, 0.5]), (7, rows[7][1]), (7, rows[7][1]), (107, [-0.001, 0.0, -2.5, 1.0]), (108, [0.0] * 4), (109, [0.0] * 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("id", "v", "cluster", "distance", "nearest") if clashes else ():
        frame = frame.withColumn(name, F.lit(name))
    return rows, frame


@pytest.mark.parametrize("k, rounds", [(5, 4), (1, 2), (200, 1)])
def test_centroid_clusters(spark, scratch, k, rounds):
    rows, frame = vectors(spark, clashes=k == 5)
    found, centers = centroids.centroid_clusters(frame.repartition(4), scratch, k, rounds, 4, 16, 3)
    want, plain = plain_clusters(rows, k, rounds, 4, 16, 3)
    got = found.collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == want
    assert centers == plain
    inertia = Counter()
    for _, cluster, distance in want:
        inertia[cluster] += distance
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (inertia[r.cluster], sum(inertia.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, plain[r.cluster])).encode()).hexdigest()


def test_centroid_clusters_of_nothing(spark, scratch):
    _, frame = vectors(spark)
    for rows in (frame.limit(0), frame.where("vec_id between 100 and 105")):
        found, centers = centroids.centroid_clusters(rows, scratch, 3, 2, 4, 16, 3)
        assert found.collect() == [] and centers == [] and len(found.columns) == 6


def test_centroid_rounds_move_no_vector(spark, scratch):
    """Only one row of sums per cluster and task goes through a shuffle."""
    _, frame = vectors(spark)
    rows = scratch.write(centroids.whole_vectors(frame, 4, 16, "vec_id", "embedding"), "v")
    summed = centroids.assigned(rows, [[0, 0, 0, 0], [9, 9, 9, 9]]).groupBy("cluster").agg(F.sum(F.col("v")[0]))
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("partial_sum") and "Python" not in plan and "Pandas" not in plan


# --- b-bit MinHash ---------------------------------------------------------------


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80), (1, 50)])
def test_minhash_components(spark, scratch, n, percent):
    got = minhash.minhash_components(documents(spark, clashes=n == 3), scratch, n, percent).collect()
    want = plain_components([(r.doc_id, r.text) for r in awkward_rows()], n, percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def varied_copies(seed, families=6, each=12):
    """Families of copies with edits of their own: similarities on both sides of the threshold."""
    random.seed(seed)
    rows = []
    for f in range(families):
        base = prose(seed * 100 + f, 60 + 25 * f).split(" ")
        for _ in range(each):
            words = list(base)
            for _ in range(random.randrange(0, 5)):
                words[random.randrange(len(words))] = f"edit{random.randrange(10**6)}"
            rows.append(Row(doc_id=len(rows), text=" ".join(words), lang="", source="", n_chars=0))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_minhash_components_on_varied_copies(spark, scratch, seed):
    rows = varied_copies(seed)
    got = minhash.minhash_components(documents(spark, rows).repartition(5), scratch, 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(plain_components([(r.doc_id, r.text) for r in rows], 3, 85))


def test_minhash_of_nothing(spark, scratch):
    assert minhash.minhash_components(documents(spark, []), scratch).collect() == []
    assert minhash.minhash_dedup(documents(spark, []), scratch).collect() == []


def test_minhash_dedup_decides_by_row(spark, scratch):
    near = prose(1, 120).split(" ")
    near[60] = "changed"
    texts = [(1, prose(1, 120)), (2, " ".join(near)), (2, prose(9, 80)), (None, prose(1, 120)), (4, None), (5, ""), (None, prose(30, 40)), (None, prose(30, 40))]
    rows = [Row(doc_id=i, text=t, lang="", source="", n_chars=0) for i, t in texts]
    kept = minhash.minhash_dedup(documents(spark, rows, clashes=True), scratch, 5, 80)
    assert kept.columns == documents(spark, rows, clashes=True).columns
    assert all(r[c] == c for r in kept.collect() for c in CLASHES)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([texts[0], texts[2], texts[4], texts[5], texts[6]])


def test_estimate_is_close_and_keeps_links(spark):
    random.seed(3)
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base)]
    for edits in (0, 1, 3, 8, 20, 60, 200):
        words = list(base)
        for at in random.sample(range(400), edits):
            words[at] = f"e{edits}-{at}"
        texts.append(" ".join(words))
    sets = shingle_sets(texts, 3)
    bits = minhash.packed_bits(minhash.minima(sets)).tolist()
    frame = spark.createDataFrame([(bits[0], b) for b in bits], "u array<long>, v array<long>")
    guessed = [r[0] for r in frame.select(minhash.estimated(F.col("u"), F.col("v"))).collect()]
    true = [len(np.intersect1d(sets[0], s)) / len(np.union1d(sets[0], s)) for s in sets]
    assert all(abs(a - b) < 0.1 for a, b in zip(guessed, true)), (guessed, true)
    assert guessed[0] == guessed[1] == 1.0


@pytest.mark.parametrize("percent", [60, 85])
def test_parity_sketches_refuse_no_link(spark, percent):
    random.seed(percent)
    universe = np.unique(np.array([random.getrandbits(64) for _ in range(4000)], np.uint64))
    sets = []
    for size in (1, 2, 7, 60, 130, 900):
        base = np.sort(np.random.default_rng(size).choice(universe, size, replace=False))
        sets += [base, base[: max(1, int(size * 0.9))], np.union1d(base, universe[: size // 12]), np.union1d(base[size // 4 :], universe[-(size // 9) - 1 :])]
    rows = linking.set_rows(list(range(len(sets))), sets).to_pylist()
    frame = spark.createDataFrame([(r["node"], r["n"], r["parity"], r["half"], r["hashes"]) for r in rows], linking.SETS)
    u, v = linking._sides(frame.drop("hashes"))
    passed = {(r.node_u, r.node_v) for r in u.crossJoin(v).where(linking.alike(percent)).collect()}
    both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    linked = {(a, b) for a in range(len(sets)) for b in range(len(sets)) if 100 * both(a, b) >= percent * (len(sets[a]) + len(sets[b]) - both(a, b))}
    assert linked <= passed
    assert len(passed - linked) < len(linked)


# --- importance resampling ---------------------------------------------------------


def plain_resample(docs, target, n, buckets, seed, percent, least):
    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return words, [zlib.crc32(" ".join(words[i - k : i + 1]).encode()) % buckets for i in range(len(words)) for k in range(n) if i - k >= 0]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(grams(text)[1])
    for text in target:
        t.update(grams(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        words, found = grams(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    return rows, [r[:4] for r in able[: len(able) * percent // 100]]


@pytest.mark.parametrize("n, percent, least", [(1, 30, 20), (3, 60, 1), (2, 100, 0), (1, 0, 20)])
def test_importance_resample(spark, scratch, n, percent, least):
    target = [prose(2, 50), None, "", "Word WORD ünï"]
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.importance_resample(documents(spark, clashes=n == 1).repartition(4), aim, scratch, n, 97, 2024, percent, least).collect()
    docs = [(r.doc_id, r.text) for r in awkward_rows()]
    rows, drawn = plain_resample(docs, target, n, 97, 2024, percent, least)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=repr) == sorted((r[:4] for r in rows), key=repr)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.score, r.doc_id) for r in ranked] == [(r[3], r[0]) for r in drawn]


def test_importance_resample_of_nothing(spark, scratch):
    aim = spark.createDataFrame([], "text string")
    assert resampling.importance_resample(documents(spark, []), aim, scratch).collect() == []
    assert resampling.importance_resample(documents(spark), aim, scratch).count() == len(awkward_rows())


def test_long_text_is_counted_in_parts(monkeypatch):
    words = [f"w{k % 50}".encode() for k in range(1000)]
    whole = resampling.bucket_counts(words, 3, 1000)
    monkeypatch.setattr(resampling, "_AT_ONCE", 7)
    assert resampling.bucket_counts(words, 3, 1000) == whole and whole.total() == 3 * 1000 - 3
