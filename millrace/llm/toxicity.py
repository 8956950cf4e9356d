"""Toxicity by a classifier chain: linear models, one for each category in order, each fed the earlier categories' probabilities.

In training the earlier probabilities are out-of-fold predictions, so that a later model sees them as they will be on new
documents. The models are fitted on a bounded sample of labelled rows; the chain then scores whole texts where they lie.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import bound_batches, stored

#: Categories in the order of the chain: name, and condition on a row of labels. The labels have these two; the verdict is the last link's,
#: which the ones before it feed. Tables with more categories are trained with more conditions.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
VERDICT = "toxic"
#: Labelled rows that the models are fitted on at most: those of the smallest hash of their id.
SAMPLE_ROWS = 8000
#: Features for each category at most, how often they occur in the sample at least, and how surprising their share of positive rows is.
FEATURES, LEAST_ROWS, LEAST_Z = 256, 4, 4.0
FOLDS, PENALTY = 5, 0.05
#: Texts whose features a worker holds at once.
PART_ROWS = 500

#: Stands after a feature that a text has twice or more, which is a feature of its own.
TWICE = " 2"
#: Letters of the beginnings of words that are features.
STEMS = (4, 5)
_WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str | None) -> set[str]:
    """The features of a whole text: its distinct words, which are runs of letters in lower case, and the beginnings of longer
    ones, so that an inflected word is known by its stem; what occurs again also with TWICE."""
    counts = Counter(_WORD.findall((text or "").lower()))
    for w, n in list(counts.items()):
        for k in STEMS:
            if len(w) > k:
                counts[w[:k] + "-"] += n
    return {*counts, *[f + TWICE for f, n in counts.items() if n > 1]}


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 25) -> np.ndarray:
    """Weights with the intercept last, by Newton's method; the intercept isn't penalised but by 1e-3."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class Chain:
    """weights[k]: of the words in columns[k], then of the earlier categories' log-odds, then the intercept.
    cuts[k]: the probability from which on a document is of category k."""

    names: tuple[str, ...]
    vocabulary: Mapping[str, int]
    columns: tuple[np.ndarray, ...]
    weights: tuple[np.ndarray, ...]
    cuts: tuple[float, ...] = ()

    def cut(self, category: str) -> float:
        return self.cuts[self.names.index(category)] if self.cuts else 0.5

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """[rows, categories] for the presence of words [rows, vocabulary]. A chain that saw no labels says 0."""
        out = np.zeros((len(x), len(self.names)))
        for k, (columns, w) in enumerate(zip(self.columns, self.weights, strict=True)):
            out[:, k] = _sigmoid(np.column_stack([x[:, columns], _odds(out[:, :k])]) @ w[:-1] + w[-1])
        return out

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        """[rows, categories] of whole texts, so many at a time. A text without words, or null, is of no category."""
        parts = [self._of_part(texts.slice(at, PART_ROWS)) for at in range(0, len(texts), PART_ROWS)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.names)))

    def _of_part(self, texts: pa.Array) -> np.ndarray:
        x, empty = np.zeros((len(texts), len(self.vocabulary)), dtype=np.float32), np.zeros(len(texts), dtype=bool)
        for i, text in enumerate(texts):
            found = words_in(text.as_py())
            empty[i] = not found
            x[i, [self.vocabulary[w] for w in found & self.vocabulary.keys()]] = 1
        out = self.probabilities(x)
        out[empty] = 0
        return out


def _odds(p: np.ndarray, least: float = 1e-4) -> np.ndarray:
    p = np.clip(p, least, 1 - least)
    return np.log(p / (1 - p))


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that tells the rows apart with the fewest errors; of several the middle of the widest gap, in log-odds."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(p, kind="stable")
    odds, y = _odds(p[order], 1e-9), y[order]
    gap = np.diff(odds)
    errors = (np.cumsum(y) + (1 - y).sum() - np.cumsum(1 - y))[:-1]  # of a cut after each row
    errors = np.where(gap > 0, errors, np.inf)
    if not np.isfinite(errors).any() or errors.min() >= y.sum():
        return 0.5
    i = np.argmax(np.where(errors == errors.min(), gap, -1))
    return float(_sigmoid((odds[i] + odds[i + 1]) / 2))


def fit_chain(names: tuple[str, ...], vocabulary: Mapping[str, int], columns: tuple[np.ndarray, ...], x: np.ndarray, y: np.ndarray) -> Chain:
    """x: presence of words; y: [rows, categories] of 0 and 1. Rows are dealt to folds in turn; cuts too come from out-of-fold predictions."""
    fold, earlier, weights = np.arange(len(x)) % FOLDS, np.zeros((len(x), 0)), []
    for k in range(len(names)):
        own = np.column_stack([x[:, columns[k]], _odds(earlier)])
        weights.append(fit_logistic(own, y[:, k]))
        held = np.full(len(x), y[:, k].mean())
        for f in range(FOLDS):
            if (fold != f).any() and (fold == f).any():
                w = fit_logistic(own[fold != f], y[fold != f, k])
                held[fold == f] = _sigmoid(own[fold == f] @ w[:-1] + w[-1])
        earlier = np.column_stack([earlier, held])
    return Chain(names, vocabulary, columns, tuple(weights), tuple(best_cut(earlier[:, k], y[:, k]) for k in range(len(names))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: Mapping[str, str] = CATEGORIES, rows: int = SAMPLE_ROWS) -> Chain:
    """Fits the chain on at most so many labelled rows of docs. Label rows with a null are left out; of repeated ones the larger values count,
    and of documents that share an id the one whose words come first in order."""
    bound_batches(docs.sparkSession)
    names = tuple(categories)
    flags = [F.max(F.expr(c).cast("int")).alias(f"y{k}") for k, c in enumerate(categories.values())]
    ys = [f"y{k}" for k in range(len(names))]
    labelled = labels.groupBy(F.col(id_col).alias("id")).agg(*flags).dropna()
    labelled = labelled.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")  # before the limit: labels of other documents don't count
    some = stored(labelled.orderBy(F.xxhash64("id"), "id").limit(rows), "labelled")  # bounded, so it is broadcast

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([sorted(words_in(t)) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], ["id", *ys, "words"])

    text = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id")).join(F.broadcast(some), "id")
    kind = dict(text.dtypes)["id"]
    sample = stored(text.select("text", "id", *ys).mapInArrow(read, f"id {kind}, {', '.join(f'{y} int' for y in ys)}, words array<string>").groupBy("id", *ys).agg(F.min("words").alias("words")), "sample")
    seen = sample.agg(F.count(F.lit(1)).alias("n"), *(F.sum(y).alias(y) for y in ys)).first()
    if not seen["n"]:
        return Chain(names, {}, (), ())
    counts = stored(sample.select(F.explode("words").alias("w"), *ys).groupBy("w").agg(F.count(F.lit(1)).alias("n"), *(F.sum(y).alias(y) for y in ys)).filter(F.col("n") >= LEAST_ROWS), "counts")
    chosen = []
    for y in ys:
        share = min(max(seen[y] / seen["n"], 1e-6), 1 - 1e-6)
        z = F.abs(F.col(y) - share * F.col("n")) / F.sqrt(share * (1 - share) * F.col("n"))
        chosen.append([r["w"] for r in counts.withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "w").limit(FEATURES).collect()])
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws in chosen for w in ws}))}
    present = sample.select("id", *ys, F.array_intersect("words", F.lit(list(vocabulary)) if vocabulary else F.array().cast("array<string>")).alias("words"))
    got = sorted(present.collect(), key=lambda r: str(r["id"]))
    x = np.zeros((len(got), len(vocabulary)))
    for i, r in enumerate(got):
        x[i, [vocabulary[w] for w in r["words"]]] = 1
    y = np.array([[r[c] for c in ys] for r in got], dtype=float)
    columns = tuple(np.array([vocabulary[w] for w in ws], dtype=int) for ws in chosen)
    return fit_chain(names, vocabulary, columns, x, y)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None, verdict: str = VERDICT) -> DataFrame:
    """One row for each row of docs: id_col, p_<category> for each category, toxic, kept.

    Whole texts are read. A null or empty text has no words: it gets 0 and stays. Repeated rows give repeated
    rows; extra columns are not read. A chain without labels says 0 for all. Without a threshold the chain's own cut holds.
    """
    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    names, at = [f"p_{n}" for n in chain.names], chain.names.index(verdict)
    threshold = chain.cut(verdict) if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chain.of_texts(batch.column(1))
            toxic = p[:, at] >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in p.T), pa.array(toxic), pa.array(~toxic)], [id_col, *names, "toxic", "kept"])

    schema = f"`{id_col}` {kind}, {', '.join(f'{n} double' for n in names)}, toxic boolean, kept boolean"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float | None = None, verdict: str = VERDICT) -> DataFrame:
    """The rows of docs that score() keeps, with all their columns; no shuffle, whatever the ids are."""
    bound_batches(docs.sparkSession)
    at = chain.names.index(verdict)
    threshold = chain.cut(verdict) if threshold is None else threshold
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(chain.of_texts(batch.column(text_at))[:, at] < threshold))

    return docs.mapInArrow(run, docs.schema)
