"""Document quality by Bradley-Terry ranking.

A text has a feature vector x and a worth w.x. Of a pair, the text labelled good is preferred with probability
sigmoid(w.(x - x')); w minimises the logistic loss over preference pairs. A text passes if its worth reaches a quantile
of the labelled worths: the one below which the labelled table's share of bad texts lies. ``score`` is a sigmoid of the
worth, shifted so that this quantile gets the score ``CUT``.

Fitting uses at most ``ROWS`` labelled rows, picked by hash of their id, and ``PAIRS`` pairs, both documented bounds of
what reaches the driver. All documents are scored, whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainevents.llm.common import Scratch, in_pandas, narrow, query, table, tidy
from chainevents.llm.linear import logistic, sigmoid
from chainevents.llm.shingles import word_hashes
from chainevents.llm.tokens import slices
from chainevents.llm.toxicity import labelled_sample

ROWS, PAIRS, CUT, FOLDS = 20_000, 60_000, 0.3, 5

#: Byte classes whose shares are features.
_CLASSES = {
    "upper": [range(65, 91)], "lower": [range(97, 123)], "digit": [range(48, 58)], "space": [[32]], "line": [[10]],
    "stop": [[ord(c)] for c in ".,;:"], "shout": [[ord("!"), ord("?")]], "bar": [[ord("|")]], "sign": [[ord(c) for c in "#$%&*@^~_=+<>{}[]\\/"]],
    "mark": [[ord(c) for c in "\"'()-`"]], "high": [range(128, 256)],
}
_OF = np.full(256, len(_CLASSES), np.int64)
for _k, _spans in enumerate(_CLASSES.values()):
    for _span in _spans:
        _OF[list(_span)] = _k


def features(texts: Sequence[str]) -> np.ndarray:
    """What a text looks like: shares of byte classes, word lengths, repetition of words and lines, length."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    n, kinds = len(raw), len(_CLASSES) + 1
    owner = np.repeat(np.arange(n), sizes)
    counts = np.bincount(owner * kinds + _OF[np.frombuffer(b"".join(raw), np.uint8)], minlength=n * kinds).reshape(n, kinds)
    share = counts / np.maximum(1, sizes)[:, None]
    words, bounds = word_hashes(texts)
    numbers = np.diff(bounds)
    of = np.repeat(np.arange(n), numbers)
    many = np.maximum(1, numbers)
    order = np.lexsort((words, of))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (of[order][1:] != of[order][:-1])
    different = np.bincount(of[order][new], minlength=n) / many
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    stutter = np.bincount(of[again], minlength=n) / many
    first = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, of[order][first], np.diff(np.append(first, len(words))))
    lines = [t.split("\n") for t in texts]
    repeated = np.array([1 - len(set(x)) / len(x) for x in lines])
    mean = (sizes - counts[:, 3] - counts[:, 4]) / many
    length = np.log1p(sizes)
    rooted = np.sqrt(share)
    return np.column_stack([
        rooted, different, np.sqrt(stutter), np.sqrt(most / many), repeated, np.minimum(mean, 40) / 10, np.abs(np.minimum(mean, 40) - 5.5) / 10,
        length, np.minimum(length, 5), rooted[:, :2] ** 4, different**3, (numbers == 0).astype(float),
    ])


class Ranking:
    """Worth of a text from preference pairs, and the quantile that a text must reach."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS):
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        z, good, bad = self.standard(x), np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        chance = np.random.default_rng(0)
        better, worse = chance.choice(good, pairs), chance.choice(bad, pairs)
        self.w = logistic(z[better] - z[worse], np.ones(pairs), ridge=1.0, bias=False)
        worth = z @ self.w
        # between the classes where they part, else where as many texts lie below as are bad
        self.cut = float(np.quantile(worth, len(bad) / len(y)))
        self.slope = 2.0 / max(1e-9, float(np.std(worth)))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid((self.standard(x) @ self.w - self.cut) * self.slope + np.log(CUT / (1 - CUT)))


def held_out(doc_id: int | None) -> bool:
    """Rows that no model may learn from: crc32 of the id as text leaves 0 when divided by FOLDS. Null ids never train."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Ranking | None:
    """From the labelled rows of ``docs`` (``id, text``) that are not held out; nothing without both labels."""

    def shaped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in slices(batch["text"].tolist(), 1 << 21):
                yield pd.DataFrame({"id": batch["id"].iloc[a:b].to_numpy(), "y": batch["y"].iloc[a:b].to_numpy(), "x": list(features(batch["text"].tolist()[a:b]))})

    train = labels.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    rows = labelled_sample(docs, train, "quality", ROWS).mapInPandas(tidy(shaped), "id long, y int, x array<double>").toPandas()
    rows = rows.sort_values("id", kind="stable")
    if rows["y"].nunique() < 2:
        return None
    return Ranking(np.stack(rows["x"].to_list()), rows["y"].to_numpy())


def quality(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Null text counts as empty and is scored like any other; null ids are held out; of several labels of one id the
    largest counts. Without labels of both kinds every score is 0.5. An empty table gives an empty result.
    """
    texts = narrow(docs, id_col, text_col)
    ranking = fit(texts, labels, scratch)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = batch["text"].tolist()
            for a, b in slices(every, 1 << 21):
                score = np.full(b - a, 0.5) if ranking is None else ranking.score(features(every[a:b]))
                yield pd.DataFrame({"doc_id": batch["id"].iloc[a:b].astype("Int64").to_numpy(object), "score": score})

    found = in_pandas(texts, rows, "doc_id long, score double")
    apart = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(True))
    return found.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op4"))
