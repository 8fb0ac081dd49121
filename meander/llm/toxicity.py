"""Toxicity: a linear-chain conditional random field over tokens.

Tokens are runs of letters and digits, lower-cased; a line is a chain of two
states (clean, toxic). Token labels come from document labels: of words and
beginnings of words (4 to 7 bytes, also as found at least twice in a document),
those that toxic learning documents hold far more often than others are chosen:
the common ones, and greedily more until they explain the toxic documents. Their
occurrences there are labelled toxic, all other tokens clean. The field (hashed
features of a word, its neighbours, beginnings and end, and state transitions) is
trained on windows of these documents by gradient steps on the exact log-likelihood.

Every token's marginal comes from forward-backward over its whole line. A
document's score is a logistic function of its largest marginal, of the
expected number of toxic tokens and of the number of tokens, calibrated on the learning documents. ``tag``
also gives the offending spans (code points, end exclusive).

Labels are learned from at most ``LEARN_ROWS`` documents (those with the
smallest id hashes), never from held-out ones; lang, source and doc_id are no
inputs. Equal texts are one learning document with the rounded mean of their
labels. Of each learning document the field is trained on at most ``WINDOWS``
windows around labelled tokens, evenly chosen, and one at random. Edge cases: null and empty texts have no tokens and score as such;
repeated documents are scored one by one; an empty table gives an empty result;
extra columns are ignored; without labels, or with one class only, all scores
are the (smoothed) share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, shared
from .quality_classifier import judged, learning_rows

LEARN_ROWS, THRESHOLD = 8192, 0.3
#: Candidate words and beginnings for token labels at most; windows of a learning document around labelled tokens at most; tokens to each side.
CANDIDATES, WINDOWS, AROUND = 1000, 4, 12
_BITS, _BEGINNINGS = 18, (4, 5, 6, 7)
_TWICE = np.uint64(0xC2B2AE3D27D4EB4F)
_FEATURES = 5 + len(_BEGINNINGS)
_MASK = np.uint64((1 << _BITS) - 1)
_GAP = np.ones(256, bool)
_GAP[128:] = False
_GAP[[*range(48, 58), *range(97, 123)]] = False


@dataclass
class Tokens:
    """The tokens of a block of texts."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray  # first token of each row, n+1 values
    chains: np.ndarray  # first token of each chain (a line with tokens), and the end
    features: np.ndarray  # (_FEATURES, tokens) table indexes
    beginnings: np.ndarray  # (lengths, tokens) hashes

    def units(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words and longer words' beginnings among tokens a to b: distinct hashes, which of them each is, counts, and its token."""
        size = self.ends[a:b] - self.starts[a:b]
        at = [np.arange(a, b), *(np.flatnonzero(size > n) + a for n in _BEGINNINGS)]
        found = np.concatenate([self.hashes[at[0]], *(h[i] for h, i in zip(self.beginnings, at[1:]))])
        return *np.unique(found, return_inverse=True, return_counts=True), np.concatenate(at)


def tokens(text: pa.Array) -> Tokens:
    data, off = kernels.raw(text)
    starts, ends, rows = kernels.word_bounds(data, off, _GAP)
    h = kernels.word_hashes(data, starts, ends)
    breaks = np.searchsorted(starts, np.flatnonzero(data == 10))
    chains = np.unique(np.concatenate([breaks, rows, [0, len(starts)]]))
    first = np.zeros(len(h), bool)
    first[chains[:-1]] = True
    last = np.append(first[1:], True)[: len(h)]
    before, after = np.roll(h, 1), np.roll(h, -1)
    before[first], after[last] = 1, 2
    head, tail = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
    for k in range(3):
        head = head * np.uint64(257) + data[np.minimum(starts + k, ends - 1)]
        tail = tail * np.uint64(257) + data[np.maximum(ends - 1 - k, starts)]
    beginnings = np.stack([kernels.word_hashes(data, starts, np.minimum(starts + n, ends)) for n in _BEGINNINGS])
    kinds = [kernels.mix(x + np.uint64(k << 56)) for k, x in enumerate((before, after, head, tail, *beginnings), 1)]
    return Tokens(h, starts, ends, rows, chains, np.stack([h & _MASK, *(x & _MASK for x in kinds)]).astype(np.int64), beginnings)


def log_odds(unary: np.ndarray, moves: np.ndarray, chains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of state 1 for all chains at once; a token's marginal logit is their sum.

    unary: weight of state 1 over state 0 per token; moves: 2 x 2 weights from state to state.
    """
    length = np.diff(chains)
    order = np.argsort(-length, kind="stable")
    at, length = chains[:-1][order], length[order]
    alive = np.searchsorted(-length, -np.arange(int(length[0]) + 1 if len(length) else 0), "left")  # chains longer than step k
    (a00, a01), (a10, a11) = np.exp(moves)
    forward, backward = unary.copy(), np.zeros(len(unary))
    for k in range(1, len(alive)):
        if not (n := int(alive[k])):
            break
        e = np.exp(np.clip(forward[at[:n] + k - 1], -40, 40))
        forward[at[:n] + k] += np.log((a01 + a11 * e) / (a00 + a10 * e))
    for k in range(len(alive) - 2, -1, -1):
        n = int(alive[k + 1])
        if n:
            here = at[:n] + k
            e = np.exp(np.clip(unary[here + 1] + backward[here + 1], -40, 40))
            backward[here] = np.log((a10 + a11 * e) / (a00 + a01 * e))
    return forward, backward


@dataclass
class Field:
    tables: np.ndarray  # (_FEATURES, 2 ** _BITS)
    bias: float
    moves: np.ndarray
    #: Calibration of a document's score: constant, logit of the largest marginal, logs of the expected and the full count.
    scale: np.ndarray

    def marginals(self, t: Tokens) -> np.ndarray:
        unary = self.bias + sum(table[f] for table, f in zip(self.tables, t.features))
        forward, backward = log_odds(unary.astype(np.float64), self.moves, t.chains)
        return np.clip(forward + backward, -30, 30)


def train(chains: list[tuple[np.ndarray, np.ndarray]], epochs: int = 40, rate: float = 0.5, shrink: float = 1e-5) -> Field:
    """Adagrad on the conditional log-likelihood. chains: (features (_FEATURES, n), labels (n)) each."""
    model = Field(np.zeros((_FEATURES, 1 << _BITS), np.float32), -4.0, np.zeros((2, 2)), np.array([0.0, 1.0, 0.0, 0.0]))
    if not chains:
        return model
    feats = np.concatenate([f for f, _ in chains], axis=1)
    y = np.concatenate([v for _, v in chains]).astype(float)
    ends = np.concatenate([[0], np.cumsum([len(v) for _, v in chains])])
    inner = np.ones(len(y), bool)
    inner[ends[:-1]] = False
    right = np.flatnonzero(inner)  # tokens with one before them in the chain
    pairs = 2 * y[right - 1].astype(int) + y[right].astype(int)
    seen = np.bincount(pairs, minlength=4).reshape(2, 2)
    used = [np.unique(f, return_inverse=True) for f in feats]
    weights = [np.zeros(len(u)) for u, _ in used]
    gathered, moves_sum, bias_sum = [np.full(len(u), 1e-8) for u, _ in used], np.full((2, 2), 1e-8), 1e-8
    for _ in range(epochs):
        unary = model.bias + sum(w[i] for w, (_, i) in zip(weights, used))
        forward, backward = log_odds(unary, model.moves, ends)
        p = 1 / (1 + np.exp(-np.clip(forward + backward, -30, 30)))
        error = (y - p) / len(chains)
        for w, g, (_, i) in zip(weights, gathered, used):
            step = np.bincount(i, error, len(w)) - shrink * w
            g += step**2
            w += rate * step / np.sqrt(g)
        # pair marginals: forward odds before, backward odds after
        f, b = np.clip(forward[right - 1], -40, 40), np.clip(unary[right] + backward[right], -40, 40)
        joint = np.exp(model.moves[None] + np.stack([np.zeros_like(f), f], 1)[:, :, None] + np.stack([np.zeros_like(b), b], 1)[:, None, :])
        expected = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        step = (seen - expected) / len(chains) - shrink * model.moves
        moves_sum += step**2
        model.moves = model.moves + 0.2 * rate * step / np.sqrt(moves_sum)
        step = error.sum()
        bias_sum += step**2
        model.bias += 0.2 * rate * step / np.sqrt(bias_sum)
    for k, (w, (u, _)) in enumerate(zip(weights, used)):
        model.tables[k, u] = w
    return model


def _texts(column: pa.Array) -> Iterator[tuple[int, Tokens]]:
    text = kernels.text_array(column)
    for i, j in kernels.blocks(text):
        yield i, tokens(pc.utf8_lower(text[i:j]))


def _summary(logit: np.ndarray, t: Tokens) -> np.ndarray:
    """Per row: logit of the largest marginal, logs of the expected number of toxic tokens and of all."""
    n = np.diff(t.rows)
    out = np.column_stack([np.full(len(n), -30.0), np.full(len(n), np.log(1e-6)), np.log1p(n)])
    full = np.flatnonzero(n)
    if len(full):
        out[full, 0] = np.maximum.reduceat(logit, t.rows[:-1][full])
        out[full, 1] = np.log(1e-6 + np.add.reduceat(1 / (1 + np.exp(-logit)), t.rows[:-1][full]))
    return out


def _calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a weak prior, by Newton steps."""
    z, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (y - p) - 0.05 * w
        curve = (z.T * (p * (1 - p))) @ z + 0.05 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return w


def _lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> set[int]:
    """Hashes of the words and beginnings (for "at least twice" with ``_TWICE``) that explain the toxic documents."""

    def found(only: np.ndarray | None):
        @kernels.tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, t in _texts(batch.column(1)):
                    sets = []
                    for a, b in zip(t.rows[:-1], t.rows[1:]):
                        unit, _, count, _ = t.units(a, b)
                        unit = np.concatenate([unit, unit[count > 1] ^ _TWICE])
                        sets.append(unit if only is None else unit[np.isin(unit, only)])
                    rows = np.repeat(np.arange(len(sets)) + i, [len(s) for s in sets])
                    units = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(units), batch.column(0).take(pa.array(rows)), batch.column(2).take(pa.array(rows))], ["unit", "doc_id", "label"])

        return sample.mapInArrow(run, "unit long, doc_id long, label int")

    counts = found(None).groupBy("unit").agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
    odds = F.log((F.col("n1") + 0.5) / (n_toxic + 1)) - F.log((F.col("n0") + 0.5) / (n_clean + 1))
    strong = counts.where((F.col("n1") >= 3) & (odds > 2.5)).orderBy(F.desc(odds * F.sqrt("n1")), "unit").limit(CANDIDATES).select("unit")
    only = np.sort(np.array([r[0] for r in strong.collect()], np.int64).view(np.uint64))
    held = found(only).where("label = 1").select("unit", "doc_id").orderBy("unit", "doc_id").toArrow()  # CANDIDATES times the sample's toxic documents at most
    units, ids = (held.column(k).to_numpy() for k in range(2))
    ends = np.flatnonzero(np.diff(units, append=0) != 0) + 1 if len(units) else np.zeros(0, int)
    docs = {int(units[b - 1]): set(ids[a:b].tolist()) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)}
    # those of many toxic documents, and those that explain documents the others leave unexplained
    chosen = {u for u, d in docs.items() if len(d) >= max(3, n_toxic / 12)}
    known = set().union(*(docs[u] for u in chosen))
    docs = {u: d - known for u, d in docs.items() if u not in chosen}
    while docs:
        unit = max(docs, key=lambda u: (len(docs[u]), u))
        if len(gain := docs.pop(unit)) < max(3, n_toxic // 100):
            break
        chosen.add(unit)
        docs = {u: d - gain for u, d in docs.items()}
    return chosen


def fit(docs: DataFrame, labels: DataFrame, most: int = LEARN_ROWS) -> Field:
    sample = learning_rows(docs, labels, "toxic", most).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.round(F.avg("label")).cast("int").alias("label"))
    sample = shared.saved(sample.select("doc_id", "text", "label"), "toxic-sample")
    count = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    n1, n0 = count.get(1, 0), count.get(0, 0)
    if not n1 or not n0:
        model = train([])
        share = (n1 + 1) / (n1 + n0 + 2)
        model.scale = np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0])
        return model
    toxic = np.array(sorted(_lexicon(sample, n1, n0)), np.int64).view(np.uint64)

    @kernels.tidied
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, feats, ys = [], [], []
            for i, t in _texts(batch.column(1)):
                label = np.zeros(len(t.hashes), bool)
                for r, (a, b) in enumerate(zip(t.rows[:-1], t.rows[1:])):
                    if a == b:
                        continue
                    is_toxic = batch.column(2)[i + r].as_py() == 1
                    unit, which, count, token = t.units(a, b)
                    hit = np.isin(unit, toxic) | ((count > 1) & np.isin(unit ^ _TWICE, toxic))
                    label[token[hit[which]]] = True
                    marked = np.flatnonzero(label[a:b]) + a
                    centres = marked[:: max(1, len(marked) // WINDOWS)][:WINDOWS].tolist() + [a + int(t.hashes[a] % np.uint64(b - a))]
                    for c in centres:
                        line = int(np.searchsorted(t.chains, c, "right")) - 1
                        x, z = max(c - AROUND, int(t.chains[line])), min(c + AROUND + 1, int(t.chains[line + 1]))
                        rows.append(i + r)
                        feats.append(t.features[:, x:z].reshape(-1))
                        ys.append((label[x:z] & is_toxic).astype(np.int64))
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(feats, pa.list_(pa.int64())), pa.array(ys, pa.list_(pa.int64()))], ["doc_id", "f", "y"])

    found = sample.mapInArrow(windows, "doc_id long, f array<long>, y array<long>").orderBy("doc_id", "f", "y").toArrow()  # WINDOWS + 1 a document at most
    arrays = ([x.values.to_numpy() for x in found.column(name)] for name in ("f", "y"))
    model = train([(f.reshape(_FEATURES, -1), y) for f, y in zip(*arrays)])

    @kernels.tidied
    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([np.zeros((0, 3)), *(_summary(model.marginals(t), t) for _, t in _texts(batch.column(1)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2]), batch.column(2)], ["doc_id", "top", "sum", "n", "label"])

    got = np.array(sorted(sample.mapInArrow(summaries, "doc_id long, top double, sum double, n double, label int").collect()), float).reshape(-1, 5)
    model.scale = _calibrated(got[:, 1:4], got[:, 4])
    return model


def tag(docs: DataFrame, model: Field, spans: bool = True) -> DataFrame:
    """(doc_id, score, spans): every whole text's score and, if asked for, its toxic spans."""

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, found = [np.zeros(0)], []
            text = kernels.text_array(batch.column(1))
            for i, j in kernels.blocks(text):
                low = pc.utf8_lower(text[i:j])
                t = tokens(low)
                logit = model.marginals(t)
                z = model.scale[0] + _summary(logit, t) @ model.scale[1:]
                scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                if spans:
                    found += _spans(low, t, logit)
            columns = [batch.column(0).cast(pa.int64()), pa.array(np.concatenate(scores))]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(columns + [pa.array(found, kind)] * spans, ["doc_id", "score", "spans"][: 2 + spans])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double" + ", spans array<struct<start:long,end:long>>" * spans)


def _spans(text: pa.Array, t: Tokens, logit: np.ndarray) -> list[list[dict]]:
    """Runs of toxic tokens of a chain, per row, in code points."""
    data, off = kernels.raw(text)
    out: list[list[dict]] = [[] for _ in range(len(off) - 1)]
    toxic = np.flatnonzero(logit >= 0)
    if not len(toxic):
        return out
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chain = np.searchsorted(t.chains, toxic, "right")
    row = np.searchsorted(t.rows, toxic, "right") - 1
    opens = np.concatenate([[True], (np.diff(toxic) > 1) | (np.diff(chain) > 0)])
    first, last = np.flatnonzero(opens), np.flatnonzero(np.append(opens[1:], True))
    starts, ends = (points[x] - points[off[row[first]]] for x in (t.starts[toxic[first]], t.ends[toxic[last]]))
    for r, a, b in zip(row[first].tolist(), starts.tolist(), ends.tolist()):
        out[r].append({"start": a, "end": b})
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and the offending spans."""
    docs = shared.table(spark, sf_dir, "documents")
    tagged = tag(docs, fit(docs, shared.table(spark, sf_dir, "labels")))
    return judged(tagged, THRESHOLD, "spans")
