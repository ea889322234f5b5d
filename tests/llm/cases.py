"""Small tables with the awkward rows every operator must bear, and plain versions of the operators."""

import re
import zlib
from collections import defaultdict

from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators use inside.
CLASHES = ("id", "key", "digest", "row", "node", "n", "kept", "low", "place", "score")

_WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper kapok larch maple nutmeg oak pine quince rowan spruce teak".split()


def prose(seed, words):
    state, out = seed * 7919 + 13, []
    for _ in range(words):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(_WORDS[(state >> 8) % len(_WORDS)] + str((state >> 16) % 97))
    return " ".join(out)


def awkward_rows():
    """Nulls, empty and very long texts, copies, near copies, shared passages, repeated rows, odd characters."""
    passage = prose(1000, 70)
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    texts = [base, base, " ".join(near), None, "", "   ", "one", "one two", passage, prose(2, 40) + " " + passage + " " + prose(3, 50), prose(4, 30) + "\n" + passage]
    texts += ["é" * 80 + prose(5, 20), "é" * 80 + "ß" + prose(6, 20), "word " * 400, "x" * 3000, prose(7, 6000), "<|endoftext|> a  b\n\n c ", "Ünï\t日本語 " * 30]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, base), (None, None), (2, " ".join(near)), (2, " ".join(near))]
    return [Row(doc_id=i, text=t, lang=None if k % 3 else "en", source="s", n_chars=None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


def documents(spark, rows=None, clashes=False):
    frame = spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA)
    if clashes:
        for name in CLASHES:
            frame = frame.selectExpr("*", f"'{name}' AS {name}")
    return frame


def words_of(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", folded)


def shingles_of(text, n):
    words = words_of(text)
    if len(words) >= n:
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    return {tuple(words)} if words else set()


def plain_components(texts, n, percent):
    """Component of each of (id, text); ids may be null and may repeat."""
    sets = [shingles_of(t, n) for _, t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = defaultdict(list)
    for k, (i, _) in enumerate(texts):
        least[root(k)] += [] if i is None else [i]
    return [(i, len(sets[k]), min(least[root(k)], default=None)) for k, (i, _) in enumerate(texts)]


def plain_repeats(texts, depth=50):
    """Marked bytes of each of (id, text): covered by a string that also starts in a document with a smaller id."""
    first = {}
    last = 1 << 63
    named = [(last if i is None else i, (t or "").encode()) for i, t in texts]
    for i, raw in named:
        for k in range(len(raw) - depth + 1):
            s = raw[k : k + depth]
            first[s] = min(first.get(s, last), i)
    marks = []
    for i, raw in named:
        mark = bytearray(len(raw))
        for k in range(len(raw) - depth + 1):
            if first[raw[k : k + depth]] < i:
                mark[k : k + depth] = b"\1" * depth
        marks.append((raw, mark))
    return marks


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
