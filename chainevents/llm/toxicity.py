"""Toxicity by a classifier chain.

The labelled table knows toxic texts only; two categories are read from it: ``severe`` (toxic texts that hold at least
as many telling terms as the median toxic text) and ``toxic``. Each link of the chain is a linear model over the
presence of telling terms (words and word beginnings) and over the log-odds that the earlier links gave. Later links
are trained on out-of-fold predictions of the earlier ones, as they will meet predictions for texts never seen.

Fitting uses at most ``ROWS`` labelled rows, picked by hash of their id, and ``TERMS`` terms, picked by likelihood
ratio; both bound what reaches the driver. All documents are scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainevents.llm.common import Scratch, in_pandas, narrow, query, table, tidy
from chainevents.llm.linear import applied, logistic, sigmoid
from chainevents.llm.tokens import slices

ROWS, TERMS, FOLDS, LEAST = 20_000, 160, 5, 3
THRESHOLD = 0.5
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¿¡«»„“”‘’–—…"


def terms_of(word: str) -> list[str]:
    """A word without case and marks around it, and how it begins."""
    word = word.lower().strip(_EDGES)[:40]
    return [word, *[word[:k] + "*" for k in (4, 5) if len(word) > k]] if word else []


def present(texts: list[str], wanted: dict[str, int] | None) -> tuple[np.ndarray, list]:
    """Text number and term of each term in each text, once; only wanted terms (their numbers) if given."""
    column = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
    coded = column.values.dictionary_encode()
    words = [terms_of(w) for w in coded.dictionary.to_pylist()]
    numbers = {} if wanted is None else wanted
    if wanted is None:
        for word in words:
            for t in word:
                numbers.setdefault(t, len(numbers))
    words = [[numbers[t] for t in word if t in numbers] for word in words]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((t for word in words for t in word), np.int64, int(counts.sum()))
    at = coded.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(column.offsets.to_numpy()))
    each, begin = counts[at], (np.cumsum(counts) - counts)[at]
    total = int(each.sum())
    found = flat[np.repeat(begin - (np.cumsum(each) - each), each) + np.arange(total)]
    pairs = np.unique(np.repeat(text, each) * max(1, len(numbers)) + found)
    return pairs // max(1, len(numbers)), pairs % max(1, len(numbers)), list(numbers)


class Chain:
    """Linear models in a row; each sees the log-odds of those before it."""

    def __init__(self, x: np.ndarray, labels: list[np.ndarray], ridge: float = 1.0):
        fold = np.arange(len(x)) % FOLDS
        self.weights, unseen = [], np.empty((len(x), 0))
        for y in labels:
            wide = np.hstack([x, unseen])
            self.weights.append(logistic(wide, y, ridge=ridge))
            odds = np.zeros(len(x))
            for k in range(FOLDS):
                if (fold == k).any():
                    odds[fold == k] = applied(wide[fold == k], logistic(wide[fold != k], y[fold != k], ridge=ridge))
            unseen = np.hstack([unseen, np.clip(odds, -15, 15)[:, None] / 5])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of each category, one column each."""
        earlier = np.empty((len(x), 0))
        out = []
        for w in self.weights:
            odds = applied(np.hstack([x, earlier]), w)
            out.append(sigmoid(odds))
            earlier = np.hstack([earlier, np.clip(odds, -15, 15)[:, None] / 5])
        return np.stack(out, 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``id, text, y`` of at most ``rows`` labelled documents; the sample of labels is small enough to broadcast."""
    sample = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    return docs.join(F.broadcast(sample.orderBy(F.xxhash64("id"), "id").limit(rows)), "id")


def _likelihood_ratio(a: np.ndarray, b: np.ndarray, na: float, nb: float) -> np.ndarray:
    """Twice the log-likelihood gain of separate rates a/na, b/nb over one rate."""
    h = lambda k, n: np.where((k > 0) & (k < n), k * np.log(np.maximum(k, 1) / n) + (n - k) * np.log(np.maximum(n - k, 1) / n), 0.0)
    return 2 * (h(a, na) + h(b, nb) - h(a + b, na + nb))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[dict[str, int], Chain | None]:
    """Terms and chain from ``docs`` (``id, text``); no chain without both labels."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in slices(batch["text"].tolist()):
                text, term, names = present(batch["text"].tolist()[a:b], None)
                own = [[names[t] for t in ts] for ts in np.split(term, np.searchsorted(text, np.arange(1, b - a)))]
                yield pd.DataFrame({"y": batch["y"].iloc[a:b].to_numpy(), "terms": own})

    sample = scratch.write(labelled_sample(docs, labels, "toxic", ROWS).mapInPandas(tidy(listed), "y int, terms array<string>"), "toxicity-sample")
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}, None
    counts = sample.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    a, b = F.col("a"), F.col("b")
    ranked = counts.where((a >= LEAST) & (a * clean > b * toxic)).withColumn("gap", a / toxic - b / clean)
    best = ranked.orderBy(F.desc("gap"), "term").limit(20 * TERMS).toPandas()
    gain = _likelihood_ratio(best["a"].to_numpy(float), best["b"].to_numpy(float), toxic, clean)
    terms = best["term"].to_numpy()[np.lexsort((best["term"].to_numpy().astype(str), -gain))[:TERMS]]
    wanted = {str(t): k for k, t in enumerate(terms)}
    held = F.filter("terms", lambda t: t.isin(list(wanted)))
    rows = sample.select("y", held.alias("terms")).toPandas()
    rows = rows.assign(key=[",".join(sorted(t)) for t in rows["terms"]]).sort_values(["key", "y"], kind="stable")
    x = np.zeros((len(rows), len(wanted)))
    for k, own in enumerate(rows["terms"]):
        x[k, [wanted[t] for t in own]] = 1
    y = rows["y"].to_numpy(float)
    severe = y * (x.sum(1) >= np.median(x[y == 1].sum(1)))
    return wanted, Chain(x, [severe, y])


def _scorer(wanted: dict[str, int], chain: Chain | None):
    def scored(texts: list[str]) -> np.ndarray:
        if chain is None:
            return np.zeros((len(texts), 2))
        x = np.zeros((len(texts), len(wanted)))
        text, term, _ = present(texts, wanted)
        x[text, term] = 1
        return chain.predict(x)

    return scored


def toxicity(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, p_severe, score, toxic, predicted``.

    Null text counts as empty. Null or repeated ids are scored like others; of several labels of one id the largest
    counts. Without labels of both kinds nothing is toxic. An empty table gives an empty result.
    """
    texts = narrow(docs, id_col, text_col)
    scored = _scorer(*fit(texts, labels, scratch))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = batch["text"].tolist()
            for a, b in slices(every):
                p = scored(every[a:b])
                yield pd.DataFrame({"doc_id": batch["id"].iloc[a:b].astype("Int64").to_numpy(object), "p_severe": p[:, 0], "score": p[:, 1]})

    found = in_pandas(texts, rows, "doc_id long, p_severe double, score double")
    return found.withColumn("toxic", F.col("score") >= THRESHOLD).withColumn("predicted", F.col("toxic").cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    scored = _scorer(*fit(narrow(docs, id_col, text_col), labels, scratch))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            size = max(1, batch.num_rows * (1 << 22) // max(1, texts.nbytes))
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                score = scored(["" if t is None else t for t in texts.slice(k, size).to_pylist()])[:, 1]
                yield part.filter(pa.array(score < THRESHOLD))

    return docs.mapInArrow(tidy(clean), docs.schema)


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op9"))
