"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact check.

Each benchmark item of n words has 64-bit SimHashes of item-sized windows: of its
first and its last w words, where w is n, or above 16 words the next smaller of
sizes that grow by about an eighth. Every run of w words of every document is
fingerprinted the same way, by sliding sums over whole texts. Words weigh 1 to 3
by length. Fingerprints within ``RADIUS`` bits of an item's are found through four
16-bit blocks: one block of the two must differ in at most RADIUS // 4 bits, and
all keys that near are in the index (pigeonhole), so none within the radius is
missed. A candidate counts if the n words at the item's place are similar enough
to it: weighted Jaccard over the multisets of 5-word shingles, a shingle weighing
the sum of its words' weights, 100 * intersection >= 75 * union, in integers.

Similar windows may be further off than any radius that can be searched. So each
item has fingerprints of parts as well: of its heaviest runs of five words, up to more than
100 - PERCENT percent of its weight. A window in which every part is changed shares
too little to be similar, so in each similar window one part stands unchanged, at distance
0; parts within ``PART_RADIUS`` bits are found through the same kind of blocks, and
every window around a found part is compared by running counts. Items of under five
words need no parts: they are one shingle, and its fingerprint is found at distance
0. Together no similar window is missed, and none is found but through a fingerprint.

The index of all items, or of the next ``PASS_ITEMS`` of them or ``PASS_BYTES`` of
their text, is built once, on the driver, by vector operations, and broadcast;
the documents are scanned once for it and never shuffled.

Edge cases: texts are lower-cased; null and empty texts or items match nothing;
a text or item of under five words is one shingle; a window that reaches over an
end of the text is cut there, but holds at least half the item's words (all of up
to 8); repeated documents are judged one by one; repeated items count once per
item_id; empty tables give empty results; extra columns of any name pass through
``clean`` and are ignored by ``leaks``. ``hamming`` is the distance of the nearer of
the item's two fingerprints at the window: it exceeds RADIUS where a part alone
led there, and is null where neither lies inside the text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import kernels, shared

WORDS, PERCENT, RADIUS, BLOCKS, PART_RADIUS = 5, 75, 7, 4, 3
#: Benchmark items, and bytes of their texts, in one index at most (or one item).
PASS_ITEMS, PASS_BYTES = 1 << 16, 32 << 20
_FOUND = "doc_id long, item_id long, start_word long, n_words long, similarity double, hamming int"
_NONE = 65  # a distance that no two fingerprints have


def size_class(n: int) -> int:
    """The window size for items of n words: all of up to 16, above that the largest step below."""
    w = 16
    if n <= w:
        return n
    while (more := w + w // 8) <= n:
        w = more
    return w


def least_words(n: int) -> int:
    """How many words a window for an item of n words must hold where the text's ends cut it."""
    return n if n <= 8 else (n + 1) // 2


def _weights(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.clip((ends - starts) // 3, 1, 3).astype(np.uint8)


#: The bits of a byte, one in each byte of 64.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).reshape(-1)


class Sums:
    """Running sums per fingerprint bit over a block's words; a window is a difference of two.

    While no window weighs 256, eight bits' sums share a 64-bit integer: carries between
    them cancel in the difference. Larger windows get a lane of 32 bits each.
    """

    def __init__(self, h: np.ndarray, weights: np.ndarray, largest: int):
        self.packed = 3 * largest < 256
        octets = h.view(np.uint8).reshape(-1, 8)
        if self.packed:
            rows = np.zeros((8, len(h) + 1), np.uint64)
            for k in range(8):
                np.cumsum(_SPREAD[octets[:, k]] * weights, out=rows[k, 1:])
            self.sum = np.ascontiguousarray(rows.T)
        else:
            self.sum = np.zeros((len(h) + 1, 64), np.uint32)
            np.cumsum(np.unpackbits(octets, axis=1) * weights[:, None], axis=0, out=self.sum[1:])
        self.weight = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])

    def windows(self, w: int) -> np.ndarray:
        """The fingerprint of each run of w words."""
        n = len(self.sum) - w
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.empty((n, 8), np.uint8)
        for i in range(0, n, 8192):  # stays in the processor's cache
            j = min(n, i + 8192)
            count = self.sum[i + w : j + w] - self.sum[i:j]
            count = count.view(np.uint8) if self.packed else count
            half = ((self.weight[i + w : j + w] - self.weight[i:j]) >> 1).astype(count.dtype)
            out[i:j] = np.packbits(count > half[:, None], axis=1)
        return out.view(np.uint64).reshape(-1)


class Index:
    """The items of one pass as arrays: whole fingerprints by size class and 16-bit block, parts by block, and shingles."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, percent: int = PERCENT):
        self.radius = radius
        text = kernels.text_array(pa.array([t for _, t in items], pa.string()))
        parts = [self._block([i for i, _ in items[a:b]], text[a:b], percent) for a, b in kernels.blocks(text)] or [self._block([], text, percent)]
        join = lambda k: np.concatenate([p[k] for p in parts])
        #: Per item: its id, words, and size class.
        self.item_id, self.n, self.width = (join(k) for k in ("item_id", "n", "width"))
        first = np.cumsum([0] + [len(p["n"]) for p in parts])[:-1]
        shifted = lambda k: np.concatenate([p[k] + f for p, f in zip(parts, first)])
        #: Shingles of all items, by item and hash, with their weights in the item.
        self.bag_rows = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p["bag_rows"]) for p in parts]))])
        self.bag_key, self.bag_weight = join("bag_key"), join("bag_weight")
        #: Per fingerprint: itself, its item, and where in the item it begins. An item's first is twice its number.
        self.marks, self.item_of, self.shift = (np.empty(2 * len(self.n), np.uint64), np.repeat(np.arange(len(self.n)), 2), np.zeros(2 * len(self.n), np.int64))
        self.marks[0::2], self.marks[1::2], self.shift[1::2] = join("head"), join("tail"), self.n - self.width
        self.classes = {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero((self.width[self.item_of] == w) & ((self.shift > 0) | (np.arange(len(self.marks)) % 2 == 0)))
            self.classes[w] = self._blocks(self.marks, own, radius)
        self.parts, self.part_item = join("part"), shifted("part_item")
        self.part_blocks = self._blocks(self.parts, np.arange(len(self.parts)), PART_RADIUS)
        self._bags: dict[int, Counter] = {}

    @staticmethod
    def _blocks(marks: np.ndarray, own: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per 16-bit block: whether a key is used, where its fingerprints begin, and those (of ``own``) that are near enough to the key in the block."""
        flips = np.array([sum(1 << b for b in bits) for r in range(radius // BLOCKS + 1) for bits in combinations(range(16), r)], np.int64)
        blocks = []
        for b in range(BLOCKS):
            key = ((marks[own] >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            near = (key[:, None] ^ flips[None]).reshape(-1)
            order = np.argsort(near, kind="stable")
            at = np.searchsorted(near[order], np.arange(65537)).astype(np.int32)
            blocks.append((at[1:] > at[:-1], at, np.repeat(own, len(flips))[order].astype(np.int32)))
        return blocks

    @staticmethod
    def _block(ids: list[int], text: pa.Array, percent: int) -> dict[str, np.ndarray]:
        """What the index holds of a block of items, those without words left out."""
        data, off = kernels.raw(pc.utf8_lower(text))
        starts, ends, rows = kernels.word_bounds(data, off)
        full = np.flatnonzero(np.diff(rows))
        h, weights, n = kernels.word_hashes(data, starts, ends), _weights(starts, ends), np.diff(rows)[full]
        rows = np.concatenate([[0], np.cumsum(n)])
        s, s_rows = kernels.shingles(h, rows, WORDS)
        total = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
        item = np.repeat(np.arange(len(n)), np.diff(s_rows))
        at = np.arange(len(s)) - s_rows[:-1][item] + rows[:-1][item]
        weight = total[at + np.minimum(WORDS, n)[item]] - total[at]
        order = np.lexsort((s, item))
        s, item, weight, at = s[order], item[order], weight[order], at[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(item) > 0) | (s[1:] != s[:-1])])) if len(s) else np.zeros(0, int)
        bag_key, bag_item, bag_weight = s[new], item[new], np.add.reduceat(weight, new) if len(new) else weight
        # the heaviest shingles, so many that windows without all of them are less similar than asked
        order = np.lexsort((bag_key, -bag_weight, bag_item))
        heavy, whole = bag_weight[order], np.bincount(bag_item, bag_weight, len(n)).astype(np.int64)
        bag_rows = np.searchsorted(bag_item, np.arange(len(n) + 1))
        run = np.cumsum(heavy) - heavy
        held = run - run[bag_rows[:-1][bag_item[order]]]
        chosen = order[(100 * held <= (100 - percent) * whole[bag_item[order]]) & (n[bag_item[order]] >= WORDS)]
        width = np.array([size_class(k) for k in n.tolist()], np.int64)
        head, tail, part = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), np.zeros(0, np.uint64)
        if len(n):
            sums = Sums(h, weights, int(width.max()))
            part = sums.windows(WORDS)[at[new][chosen]] if len(chosen) else part
            for w in np.unique(width).tolist():
                at, marks = np.flatnonzero(width == w), sums.windows(w)
                head[at], tail[at] = marks[rows[:-1][at]], marks[rows[1:][at] - w]
        return {"item_id": np.array(ids, np.int64)[full], "n": n, "width": width, "bag_rows": bag_rows, "bag_key": bag_key, "bag_weight": bag_weight, "head": head, "tail": tail, "part": part, "part_item": bag_item[chosen]}

    def bag(self, x: int) -> Counter:
        """Item x's shingles with their weights."""
        if x not in self._bags:
            if len(self._bags) >= 10_000:
                self._bags.clear()
            a, b = self.bag_rows[x : x + 2]
            self._bags[x] = Counter(dict(zip(self.bag_key[a:b].tolist(), self.bag_weight[a:b].tolist())))
        return self._bags[x]

    def candidates(self, w: int, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (window, fingerprint, distance) of class w within the radius."""
        return _near(self.classes[w], self.marks, self.radius, found)

    def parted(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (place, item) where a run of five words is within ``PART_RADIUS`` of a part of the item."""
        at, part, _ = _near(self.part_blocks, self.parts, PART_RADIUS, found)
        return at, self.part_item[part]


def _near(blocks: list, marks: np.ndarray, radius: int, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (place in ``found``, place in ``marks``, distance) within the radius, through the blocks."""
    keys = np.ascontiguousarray(found.view(np.uint16).reshape(-1, BLOCKS).T)
    at_all, item_all, far_all = [], [], []
    for b, (used, at, items) in enumerate(blocks):
        hit = np.flatnonzero(used[keys[b]])
        key = keys[b][hit].astype(np.int64)
        n = (at[key + 1] - at[key]).astype(np.int64)
        here = np.repeat(hit, n)
        item = items[np.repeat(at[key] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].astype(np.int64)
        far = np.bitwise_count(found[here] ^ marks[item])
        ok = far <= radius
        at_all.append(here[ok])
        item_all.append(item[ok])
        far_all.append(far[ok])
    at, item, far = map(np.concatenate, (at_all, item_all, far_all))
    _, one = np.unique(at * max(1, len(marks)) + item, return_index=True)
    return at[one], item[one], far[one]


def _best_start(lo: int, hi: int, n: int, want: Counter, s: list[int], weight: list[int], percent: int) -> tuple[int, int, int] | None:
    """(intersection, union, start) of the most similar window of n words, if similar enough; the first of equals.

    Windows begin at lo to hi and are cut to the text; s, weight: its shingles and their weights.
    """
    have, both, total, wanted, found = dict.fromkeys(want, 0), 0, 0, sum(want.values()), None
    left = right = max(0, lo)
    for a in range(lo, hi + 1):
        end = min(a + n - WORDS + 1, len(s))
        while right < end:
            k, v = s[right], weight[right]
            total += v
            if k in have:
                both += v if have[k] < want[k] else 0
                have[k] += v
            right += 1
        while left < a:
            k, v = s[left], weight[left]
            total -= v
            if k in have:
                have[k] -= v
                both -= v if have[k] < want[k] else 0
            left += 1
        either = total + wanted - both
        if 100 * both >= percent * either and (found is None or both * found[1] > found[0] * either):
            found = both, either, a
    return found


def _around(index: Index, parts: np.ndarray, row_of: np.ndarray, rows: np.ndarray) -> dict[int, list[list[int]]]:
    """By size class: (row, item, first start, last start) of all runs of windows that hold a part; starts are counted in the row."""
    at, item = index.parted(parts)
    if not len(at):
        return {}
    row = row_of[at]
    n = index.n[item]
    least = np.where(n <= 8, n, (n + 1) // 2)
    place, size = at - rows[row], (rows[1:] - rows[:-1])[row]
    lo, hi = np.maximum(place + WORDS - n, least - n), np.minimum(place, size - least)
    ok = (lo <= hi) & (place + WORDS <= size)
    out: dict[int, list] = {}
    last = None
    for r, x, a, z in sorted(set(zip(*(v[ok].tolist() for v in (row, item, lo, hi))))):
        if last and last[:2] == [r, x] and a <= last[3] + 1:
            last[3] = max(last[3], z)
        else:
            last = [r, x, a, z]
            out.setdefault(int(index.width[x]), []).append(last)
    return out


def weighted_shingles(h: np.ndarray, weights: np.ndarray) -> Counter:
    """Each 5-word shingle's count times the weight of its words."""
    s, _ = kernels.shingles(h, np.array([0, len(h)]), WORDS)
    size = min(WORDS, len(h))
    total = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
    out: Counter = Counter()
    for k, v in zip(s.tolist(), (total[size:] - total[:-size]).tolist() if size else []):
        out[k] += v
    return out


def overlap(a: Counter, b: Counter) -> tuple[int, int]:
    """Weighted intersection and union. (A shingle has one weight, so counts times weights compare like counts.)"""
    both = sum(min(v, b[k]) for k, v in a.items() if k in b)
    return both, sum(a.values()) + sum(b.values()) - both


def _search(index: Index, text: pa.Array, percent: int) -> list[tuple[int, int, int, int, float, int]]:
    """(row, item, start word, words, similarity, distance): the best window of each row and item_id that is similar enough."""
    best: dict[tuple[int, int], tuple] = {}
    for i, j in kernels.blocks(text):
        data, off = kernels.raw(pc.utf8_lower(text[i:j]))
        starts, ends, rows = kernels.word_bounds(data, off)
        if not len(starts) or not index.classes:
            continue
        h, weights = kernels.word_hashes(data, starts, ends), _weights(starts, ends)
        sums = Sums(h, weights, max(index.classes))
        row_of = np.repeat(np.arange(j - i), np.diff(rows))
        s, s_rows = kernels.shingles(h, rows, WORDS)
        around = _around(index, sums.windows(WORDS), row_of, rows)
        for w in index.classes:
            marks = sums.windows(w)
            for r, x, lo, hi in around.get(w, ()):
                item_id, n, want = int(index.item_id[x]), int(index.n[x]), index.bag(x)
                size, b = int(rows[r + 1] - rows[r]), max(0, lo)
                e = min(hi + n, size) - WORDS + 1
                weight = sums.weight[rows[r] + b + WORDS : rows[r] + e + WORDS] - sums.weight[rows[r] + b : rows[r] + e]
                top = _best_start(lo - b, hi - b, n, want, s[s_rows[r] + b : s_rows[r] + e].tolist(), weight.tolist(), percent)
                if top:
                    both, either, a = top[0], top[1], top[2] + b
                    a = 0 if a < 0 and a + n > size else a  # cut at both ends: the whole text either way
                    there = [(a + int(index.shift[k]), k) for k in (2 * x, 2 * x + 1)]
                    d = min((int(np.bitwise_count(marks[rows[r] + at] ^ index.marks[k])) for at, k in there if 0 <= at <= size - w), default=_NONE)
                    found = (both / either, -max(a, 0), n, -d)
                    if found > best.get((i + r, item_id), ()):
                        best[i + r, item_id] = found
            at, item, far = index.candidates(w, marks)
            inside = at + w <= rows[row_of[at] + 1]
            row, x = row_of[at[inside]], index.item_of[item[inside]]
            for r, x, a, d in sorted(set(zip(row.tolist(), x.tolist(), (at[inside] - index.shift[item[inside]]).tolist(), far[inside].tolist()))):
                item_id, n, want = int(index.item_id[x]), int(index.n[x]), index.bag(x)
                a, end = max(a, int(rows[r])), min(a + n, int(rows[r + 1]))
                both, either = overlap(weighted_shingles(h[a:end], weights[a:end]), want)
                if 100 * both >= percent * either:
                    found = (both / either, -(a - int(rows[r])), n, -d)
                    if found > best.get((i + r, item_id), ()):
                        best[i + r, item_id] = found
    return [(row, item_id, -m, n, s, None if d == -_NONE else -d) for (row, item_id), (s, m, n, d) in best.items()]


def _indexes(benchmark: DataFrame, radius: int, percent: int) -> Iterator:
    """Broadcast indexes of the benchmark's items, a pass each."""
    part, size, context = [], 0, benchmark.sparkSession.sparkContext
    for item_id, text in benchmark.selectExpr("CAST(item_id AS long)", "text").where("text IS NOT NULL AND item_id IS NOT NULL").toLocalIterator():
        if part and (len(part) >= PASS_ITEMS or size + len(text) > PASS_BYTES):
            yield context.broadcast(Index(part, radius, percent))
            part, size = [], 0
        part.append((item_id, text))
        size += len(text)
    if part:
        yield context.broadcast(Index(part, radius, percent))


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """One row per document and item found in it, with the place of the best window."""

    def search(index):
        @kernels.tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _search(index.value, kernels.text_array(batch.column(1)), percent)
                ids = batch.column(0).cast(pa.int64()).take(pa.array([f[0] for f in found], pa.int64()))
                rest = [pa.array([f[k] for f in found], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.float64()), (5, pa.int32()))]
                yield pa.RecordBatch.from_arrays([ids, *rest], ["doc_id", "item_id", "start_word", "n_words", "similarity", "hamming"])

        return docs.select("doc_id", "text").mapInArrow(run, _FOUND)

    parts = [search(index) for index in _indexes(benchmark, radius, percent)]
    out = parts[0] if parts else docs.sparkSession.createDataFrame([], _FOUND)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """``docs`` without the documents in which an item is found."""
    where = docs.columns.index("text")

    def without(index):
        @kernels.tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in _search(index.value, kernels.text_array(batch.column(where)), percent)]] = False
                yield batch.filter(pa.array(keep))

        return run

    for index in _indexes(benchmark, radius, percent):
        docs = docs.mapInArrow(without(index), docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark")).drop("hamming")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    return clean(docs, shared.table(spark, sf_dir, "benchmark"))


#: All windows of all items by brute force, but for those that share no shingle with theirs. Documents are taken to have distinct ids.
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT item_id, row_number() OVER () AS item, w, len(w) AS n, CASE WHEN len(w) <= 8 THEN len(w) ELSE (len(w) + 1) // 2 END AS least
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0
), ix AS (
  SELECT item, unnest(range(1, greatest(n - {WORDS} + 2, 2))) AS p, w FROM i
), ib AS (
  SELECT item, s, count(*) AS c, any_value(weight) AS weight FROM (
    SELECT item, w[p:p + {WORDS - 1}] AS s, list_sum([greatest(1, least(3, strlen(x) // 3)) FOR x IN w[p:p + {WORDS - 1}]]) AS weight FROM ix
  ) GROUP BY ALL
), it AS (SELECT item, sum(c * weight) AS total FROM ib GROUP BY item
), sizes AS (SELECT DISTINCT least({WORDS}, n) AS k FROM i
), ds AS (  -- runs of five words (shorter ones for shorter items) by place, from 0
  SELECT doc_id, len(w) AS size, k, p - 1 AS p, w[p:p + k - 1] AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k)
), a AS (  -- where windows that share a shingle begin
  SELECT DISTINCT doc_id, item, size, n, unnest(range(greatest(p + least(n, {WORDS}) - n, least - n), least(p, size - least) + 1)) AS a
  FROM ds JOIN ib USING (s) JOIN i USING (item) WHERE k = least(n, {WORDS})
), x AS (
  SELECT a.doc_id, a.item, a.n, a.a, ds.s, count(*) AS c,
    any_value(list_sum([greatest(1, least(3, strlen(x) // 3)) FOR x IN ds.s])) AS weight
  FROM a JOIN ds ON a.doc_id = ds.doc_id AND ds.k = least(a.n, {WORDS}) AND ds.p >= greatest(a.a, 0) AND ds.p + ds.k <= least(a.a + a.n, a.size)
  GROUP BY ALL
), y AS (
  SELECT doc_id, x.item, n, greatest(a, 0) AS start, sum(CASE WHEN ib.c IS NULL THEN 0 ELSE least(x.c, ib.c) * x.weight END) AS both_, sum(x.c * x.weight) AS total
  FROM x LEFT JOIN ib ON ib.item = x.item AND ib.s = x.s GROUP BY doc_id, x.item, n, a
), z AS (
  SELECT doc_id, item_id, start, y.n, both_, y.total + it.total - both_ AS either FROM y JOIN it USING (item) JOIN i USING (item)
)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start_word, CAST(n AS BIGINT) AS n_words, CAST(both_ AS DOUBLE) / CAST(either AS DOUBLE) AS similarity
FROM z WHERE 100 * both_ >= {PERCENT} * either
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY CAST(both_ AS DOUBLE) / CAST(either AS DOUBLE) DESC, start, n DESC) = 1"""
