"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into at most ``BINS`` bins at quantiles of the learning
sample. Boosting visits the features in turn (cyclic) and fits a shallow tree
to the present gradient, which adds to that feature's table of one value per
bin. Afterwards the pairs with the strongest remaining signal get two-way tables
in the same manner. A text's logit is the sum of its table entries: scoring is
a binning and a vectorised addition.

Labels are learned from at most ``LEARN_ROWS`` documents (those whose ids have
the smallest hashes), never from held-out ones; lang, source and doc_id are no
inputs. Edge cases: null and empty texts score as a text without words; repeated
documents are scored one by one; an empty table gives an empty result; extra
columns are ignored; without labels, or with one class only, all scores are the
(smoothed) share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features, kernels, shared

LEARN_ROWS, BINS, PAIR_BINS, PAIRS = 16384, 64, 12, 8
THRESHOLD = 0.7


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 3, least: float = 2.0) -> np.ndarray:
    """Bin values of a tree of few leaves over ordered bins, from their sums of gradients and weights."""
    g, w = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    parts = [(0, len(gradient))]
    score = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            cut = np.arange(a + 1, b)
            cut = cut[(w[cut] - w[a] >= least) & (w[b] - w[cut] >= least)]
            if len(cut):
                gain = score(a, cut) + score(cut, b) - score(a, b)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), (a, b), int(cut[k])), key=lambda t: t[0])
        if best[1] is None:
            break
        (a, b), c = best[1], best[2]
        parts = [p for p in parts if p != (a, b)] + [(a, c), (c, b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1)
    return out


@dataclass
class AdditiveModel:
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    #: (first feature, second feature, their coarser cuts, table)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            out += table[np.searchsorted(cuts, x[:, k], "right")]
        for a, b, ca, cb, table in self.pairs:
            out += table[np.searchsorted(ca, x[:, a], "right"), np.searchsorted(cb, x[:, b], "right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    q = np.unique(np.quantile(x, np.arange(1, bins) / bins, method="lower"))
    return q[q > x.min()] if len(q) else q


def train(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, pairs: int = PAIRS) -> AdditiveModel:
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    model.cuts = [_cuts(x[:, k], BINS) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(model.cuts)]
    logit = np.full(len(y), model.base)

    def sums(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return np.bincount(at, y - p, n), np.bincount(at, p * (1 - p), n)

    for _ in range(rounds):
        for k, at in enumerate(bins):
            if len(model.tables[k]) > 1:
                step = rate * np.clip(_tree(*sums(at, len(model.tables[k]))), -4, 4)
                model.tables[k] += step
                logit += step[at]
    coarse = [_cuts(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    small = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(coarse)]
    found = []
    for a, b in combinations(range(x.shape[1]), 2):
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        if min(shape) > 1:
            g, w = sums(small[a] * shape[1] + small[b], shape[0] * shape[1])
            found.append((float((g**2 / (w + 5)).sum()) - shape[0] * shape[1] * 0.2, a, b))
    for _, a, b in sorted(found, reverse=True)[:pairs]:
        model.pairs.append((a, b, coarse[a], coarse[b], np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))))
    for _ in range(rounds // 4):
        for a, b, ca, cb, table in model.pairs:
            at = small[a] * table.shape[1] + small[b]
            g, w = (s.reshape(table.shape) for s in sums(at, table.size))
            # the best split of one feature, each side split along the other
            first = _tree(g.sum(axis=1), w.sum(axis=1), 2)
            step = np.zeros_like(table)
            for value in np.unique(first):
                rows = first == value
                step[rows] = _tree(g[rows].sum(axis=0), w[rows].sum(axis=0), 2)
            step = rate * np.clip(step, -4, 4)
            table += step
            logit += step.reshape(-1)[at]
    return model


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled, not held-out documents: those with the smallest id hashes.

    A label is the rounded mean of its rows, and an id is one row, however often it is repeated: that of the smallest text.
    """
    known = labels.where(f"doc_id IS NOT NULL AND {label} IS NOT NULL").where(~shared.held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")  # at most `most` ids
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features.features(kernels.text_array(batch.column(1)))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(features.NAMES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), flat, batch.column(2)], ["doc_id", "x", "label"])


def fit(docs: DataFrame, labels: DataFrame, most: int = LEARN_ROWS) -> AdditiveModel:
    rows = learning_rows(docs, labels, "quality", most).mapInArrow(_measured, "doc_id long, x array<double>, label int").collect()
    rows.sort(key=lambda r: r[0])
    return train(np.array([r[1] for r in rows]).reshape(-1, len(features.NAMES)), np.array([r[2] for r in rows], float))


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """(doc_id, score) of every whole text."""

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features.features(kernels.text_array(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(model.scores(x))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def judged(scored: DataFrame, threshold: float, *more: str) -> DataFrame:
    held = F.coalesce(shared.held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)


def query(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return judged(score(docs, fit(docs, shared.table(spark, sf_dir, "labels"))), THRESHOLD)
