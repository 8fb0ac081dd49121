"""Packing by cutting-stock column generation.

Documents are tokenised in the tasks and cut at multiples of the sequence
length; what remains of each is a piece. Lengths, up to 64 tokens exact and then
rounded up a little (``CLASSES``), form a histogram of at most 320 classes: that
alone reaches the driver. There, a linear program over patterns (how many pieces
of each class share a sequence) is solved by column generation: revised simplex
for the master problem, an unbounded-knapsack dynamic program to price new
patterns. Short pieces enter it in groups that fill whole units of ``UNIT``
tokens. Rounded-down pattern counts, and a first-fit packing of the few pieces
left over, give a table of slots. Pieces are ranked within their class (in buckets
of bounded size, whose counts give each bucket's first rank) and the n-th piece
takes the n-th slot.

Edge cases: a null or empty text is just the end id; repeated rows are packed
one by one; an empty table gives an empty result; extra columns of any name are
ignored. The encoder is tiktoken, built from the vocabulary of the given
``tokenizers`` file: the ids are the same, and it is four times as fast. Texts
with a run of ``BLANKS`` blanks, which overflow its pattern matcher, are encoded
by ``tokenizers`` itself. Special tokens in a text become their ids, as
``tokenizers`` does by default.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels, shared

LENGTH, UNIT, END_ID = 2048, 8, 1
#: (longest piece, lengths are rounded up to, pieces in a group): a group fills whole units, whatever its class.
CLASSES = ((64, 1, 8), (128, 4, 2), (None, 8, 1))
#: Pieces of a class that are ranked together, about, and buckets whose counts are summed together: a class may hold much of all rows.
RANKED, SUMMED = 200, 1_000
#: A run of so many blanks is left to ``tokenizers``.
BLANKS = 100_000
_BLANK_RUN = re.compile(r"(?<!\s)\s{%d}" % BLANKS)  # tried where a run begins, so in linear time


class Encoder:
    """A byte-level BPE with the vocabulary of a ``tokenizers`` file; the ids are those of ``tokenizers`` for any text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"]: t["id"] for t in model["added_tokens"] if t["special"]}
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @functools.cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str, special: bool = True) -> np.ndarray:
        """The ids of ``text``; special tokens in it become their ids, or, if not ``special``, are text like any other."""
        if len(text) >= BLANKS and _BLANK_RUN.search(text):
            self.whole.encode_special_tokens = not special
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all" if special else set(), disallowed_special=())

    def text(self, ids) -> str:
        return self.fast.decode_bytes(ids).decode()


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Each document's pieces: doc_id, start, length, ids_crc32, doc_tokens (and the ids)."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    types = [pa.int64()] * 5 + [pa.list_(pa.int32())] * keep_ids

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in batches:
            doc_ids, text = batch.column(0).cast(pa.int64()), kernels.text_array(batch.column(1))
            for i, j in kernels.blocks(text):
                out: list[tuple] = []
                for doc_id, t in zip(doc_ids[i:j].to_pylist(), text[i:j].to_pylist()):
                    ids = np.append(code.ids(t), np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(ids), length):
                        part = ids[at : at + length]
                        out.append((doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids), part.astype(np.int32))[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids)


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of the highest total price, by dynamic programming over capacities."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = np.searchsorted(sizes, c, "right")
        if fits:
            v = value[c - sizes[:fits]] + prices[:fits]
            k = int(v.argmax())
            value[c], last[c] = (v[k], k) if v[k] > value[c - 1] + 1e-12 else (value[c - 1], -1)
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= sizes[last[c]]
    return value[capacity], pattern


def first_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """A first basis: fill a sequence around the longest class left, as often as the scarcest of its classes allows.

    That class is then used up and appears no more, so the patterns are triangular.
    """
    basis, left, open_ = np.zeros((len(sizes), len(sizes))), demand.copy(), np.ones(len(sizes), bool)
    while open_.any():
        at = np.flatnonzero(open_)
        size = sizes[at]
        _, fill = best_pattern(size + 1e-6 * size**2, size, capacity - int(size[-1]))
        fill[-1] += 1
        used = np.flatnonzero(fill)
        out = at[used[(left[at[used]] / fill[used]).argmin()]]
        left[at] -= fill * (left[out] / fill[at == out][0])
        basis[at, out] = fill
        open_[out] = False
    return basis


def pivot(inverse: np.ndarray, column: np.ndarray, out: int) -> None:
    """The inverse after the basis column ``out`` is replaced by one that is ``column`` in terms of the old basis."""
    inverse[out] /= column[out]
    others = np.arange(len(inverse)) != out
    inverse[others] -= np.outer(column[others], inverse[out])


def inverted(basis: np.ndarray) -> np.ndarray:
    """The inverse, one pivot per column (rows taken by the largest element), without a threaded LAPACK call."""
    inverse, free, row_of = np.eye(len(basis)), np.ones(len(basis), bool), np.zeros(len(basis), int)
    for k in range(len(basis)):
        column = inverse @ basis[:, k]
        out = int(np.where(free, np.abs(column), -1).argmax())
        pivot(inverse, column, out)
        free[out], row_of[k] = False, out
    return inverse[row_of]


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4, most: int = 1500) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each (fractions), within ``gap`` of the fewest sequences.

    No plan is below the total size, nor (Farley) below the present one divided by the best pattern's price.
    Patterns are priced first with duals drawn towards each class's share of a sequence, near which they end:
    this damps their swings; a pattern that doesn't pay at the true duals is priced again with those.
    """
    basis = first_patterns(sizes, demand, capacity)
    inverse = inverted(basis)
    cost, share, pulls = np.ones(len(sizes)), sizes / capacity, (0.95, 0.8, 0.5, 0.0)
    fewest = share @ demand
    for step in range(most):
        if step % 100 == 99:
            inverse = inverted(basis)
        prices = cost @ inverse
        worst = int(prices.argmin())
        if prices[worst] < -1e-9:  # rather supply too many slots of this class
            enter, price = -np.eye(len(sizes))[worst], 0.0
        else:
            price = 1.0
            if prices @ demand <= (1 + gap) * fewest:
                break
            for pull in pulls:
                value, enter = best_pattern(pull * share + (1 - pull) * prices, sizes, capacity)
                if prices @ enter > 1 + gap:
                    break
            else:
                break
        x, column = np.maximum(inverse @ demand, 0), inverse @ enter
        ok = column > 1e-9
        if not ok.any():
            break
        out = int(np.where(ok, x / np.where(ok, column, 1), np.inf).argmin())
        basis[:, out], cost[out] = enter, price
        pivot(inverse, column, out)
    x = np.maximum(inverted(basis) @ demand, 0)
    return [(basis[:, k], x[k]) for k in range(len(sizes)) if cost[k] > 0]


def class_of(length: Column) -> Column:
    """The longest length of a piece's class."""
    out = F.ceil(length / CLASSES[-1][1]) * CLASSES[-1][1]
    for longest, step, _ in reversed(CLASSES[:-1]):
        out = F.when(length <= longest, F.ceil(length / step) * step).otherwise(out)
    return out.cast("int")


def slots(histogram: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, first sequence, slots of the class per sequence) for a histogram of classes."""
    if not histogram:
        return []
    group_of = {c: max(1, min(next(g for longest, _, g in CLASSES if longest is None or c <= longest), length // (4 * c))) for c in histogram}
    classes = sorted(histogram, key=lambda c: (c * group_of[c], c))
    group = np.array([group_of[c] for c in classes])
    sizes, pieces_of = -(-np.array(classes) * group // UNIT), np.array([histogram[c] for c in classes])
    plan: Counter = Counter()
    some = np.flatnonzero(pieces_of >= group)  # classes with a whole group
    if len(some):
        for pattern, times in column_generation(sizes[some], (pieces_of // group)[some].astype(float), length // UNIT):
            if n := int(times + 1e-6):
                full = np.zeros(len(classes), np.int64)
                full[some] = pattern.astype(np.int64) * group[some]
                plan[tuple(full.tolist())] += n
    left = pieces_of - sum((np.array(p) * n for p, n in plan.items()), np.zeros(len(classes), np.int64))
    bins: list[tuple[int, Counter]] = []
    for k in sorted(range(len(classes)), key=lambda k: -classes[k]):  # what rounding left over: first fit, longest first
        for _ in range(max(0, int(left[k]))):
            at = next((i for i, (room, _) in enumerate(bins) if room >= classes[k]), None)
            if at is None:
                bins.append((length, Counter()))
                at = len(bins) - 1
            bins[at] = (bins[at][0] - classes[k], bins[at][1] + Counter({k: 1}))
    for _, held in bins:
        plan[tuple(held[k] for k in range(len(classes)))] += 1
    rank, sequence, out = [0] * len(classes), 0, []
    for pattern, n in sorted(plan.items()):
        for k, a in enumerate(pattern):
            if a:
                out.append((classes[k], rank[k], rank[k] + a * n, sequence, a))
                rank[k] += a * n
        sequence += n
    return out


def assign(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``parts`` (a written table with a number ``_row`` of each row, as it is read three times) with sequence_id and offset."""
    if length % UNIT:
        raise ValueError(f"the sequence length must be a multiple of {UNIT}")
    spark = parts.sparkSession
    sized = parts.withColumn("_class", class_of(F.col("length")))
    histogram = {r[0]: r[1] for r in sized.groupBy("_class").count().collect()}  # the classes of CLASSES at most
    table = spark.createDataFrame(slots(histogram, length), "_class int, _from long, _to long, _first long, _per long")
    split = spark.createDataFrame([(c, -(-n // RANKED)) for c, n in histogram.items()], "_class int, _buckets int")
    put = sized.join(F.broadcast(split), "_class").withColumn("_bucket", F.expr("pmod(xxhash64(_row), _buckets)")).drop("_buckets")
    # the first rank of each bucket: those of earlier groups of buckets, and of earlier buckets of its group
    counts = put.groupBy("_class", "_bucket").count().withColumn("_group", F.floor(F.col("_bucket") / SUMMED))
    groups = counts.groupBy("_class", "_group").agg(F.sum("count").alias("_all"))
    groups = groups.select("_class", "_group", (F.sum("_all").over(Window.partitionBy("_class").orderBy("_group")) - F.col("_all")).alias("_earlier"))
    inside = F.sum("count").over(Window.partitionBy("_class", "_group").orderBy("_bucket")) - F.col("count")
    counts = counts.withColumn("_inside", inside).join(groups, ["_class", "_group"]).select("_class", "_bucket", (F.col("_earlier") + F.col("_inside")).alias("_before"))
    ranked = put.withColumn("_n", F.row_number().over(Window.partitionBy("_class", "_bucket").orderBy("doc_id", "start", "_row")))
    ranked = ranked.join(counts, ["_class", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_n") - 1).drop("_before", "_n", "_bucket")
    placed = ranked.join(F.broadcast(table.withColumnRenamed("_class", "_slot")), F.expr("_class = _slot AND _rank >= _from AND _rank < _to"))
    placed = placed.withColumn("sequence_id", F.expr("_first + (_rank - _from) div _per"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_rank")
    placed = placed.withColumn("offset", F.sum("length").over(before) - F.col("length"))
    return placed.select(*[c for c in parts.columns if c != "_row"], "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most ``length`` tokens."""
    numbered = pieces(docs, tokenizer, length, end_id, keep_ids).withColumn("_row", F.monotonically_increasing_id())
    return assign(shared.saved(numbered, "pieces"), length)


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, used): the sequences of a packing that kept its ids, padded to ``length`` unless they hold a power of two."""
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("x"), F.sum("length").alias("used"))
    ids, power = F.flatten(F.col("x.ids")), F.col("used").bitwiseAND(F.col("used") - 1) == 0
    padding = F.when(power, F.lit(0)).otherwise(length - F.col("used")).cast("int")
    return held.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id), padding)).alias("ids"), "used")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(shared.table(spark, sf_dir, "documents"), tokenizer_path())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: what is left, packed."""
    return pack(docs, tokenizer_path())
