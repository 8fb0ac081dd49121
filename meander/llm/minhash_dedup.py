"""Near-duplicate documents: SuperMinHash, banding, verification, union-find.

1. Each document's set of 5-word shingles gives a signature of 128 correlated
   permutation ranks (every element visits the components in an order of its
   own, and stops early once no component can improve). Documents with equal
   sets are one node from here on.
2. 32 bands of 4 components are bucket keys. In each bucket all members are
   compared with its leader, the member with the most bucket-mates overall:
   a star, not all pairs. Links count only after a check on the full sets.
3. Union-find groups the links. Documents in a bucket that still holds several
   components are compared across them, by prefix filtering: a set's shingles are
   ordered from the rarest; two sets that share nothing before rank r of either
   share at most size - r, which bounds the size of a partner. Of the pairs that
   share a shingle, are of different components and meet both bounds, most still
   differ too much: each set carries ``SKETCH`` parity bits (of how many of its
   shingles fall to each), and two sets differ in at least as many shingles as
   their parities do in bits. This too is exact, so the bounds lose none, and
   texts of one template don't all meet. What is left is checked on the full sets
   (hashed, written once), and the grouping is repeated.

A pair of similarity 0.75 shares no band with a chance under 6e-6; for it to
be lost, it must also not be joined through others.

Edge cases: null or empty texts (or only gaps) have an empty set and are linked
with nothing; rows without an id are linked with nothing and kept; rows that
repeat an id are one document, linked by any of its texts; an empty table gives
an empty result; extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels, shared
from .components import components

BANDS, ROWS, WORDS, PERCENT = 32, 4, 5, 75
_SIZE = BANDS * ROWS  # 128, a power of two
#: Bits of a set's parity sketch.
SKETCH = 512
_U = np.uint64
_SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash: (len(sets), 128) values whose high byte is the rank at which the component was reached.

    In round j, element e offers j + random to component (b + a j) mod 128, with odd a and b drawn from e:
    each element visits every component once. A set whose components all hold ranks up to j is finished.
    """
    sig = np.full(len(sets) * _SIZE, np.iinfo(np.uint64).max, np.uint64)
    live = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(live):
        return sig.reshape(-1, _SIZE)
    e = np.concatenate([sets[i] for i in live])
    at = np.repeat(live, [len(sets[i]) for i in live])
    seed = kernels.mix(e ^ _U(0xA0761D6478BD642F))
    step, start = ((seed & _U(63)) << _U(1)) | _U(1), (seed >> _U(6)) & _U(127)
    for j in range(_SIZE):
        place = ((start + step * _U(j)) & _U(127)).astype(np.int64)
        value = (kernels.mix(e + _U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> _U(8)) | _U(j << 56)
        np.minimum.at(sig, at * _SIZE + place, value)
        done = sig.reshape(-1, _SIZE).max(axis=1) < _U((j + 1) << 56)
        left = ~done[at]
        if not left.any():
            break
        e, at, step, start = e[left], at[left], step[left], start[left]
    return sig.reshape(-1, _SIZE)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(len(sig), BANDS, ROWS)
    key = (rows * kernels._LANE[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0xE7037ED1A0B428DB)
    return kernels.mix(key).view(np.int64)


@kernels.tidied
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, text = batch.column(0), kernels.text_array(batch.column(1))
        for i, j in kernels.blocks(text):
            sets = list(kernels.shingle_sets(text[i:j], WORDS))
            n = np.array([len(s) for s in sets], np.int64)
            own = kernels.mix(pc.fill_null(ids[i:j], 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            h1 = np.array([kernels.mix(s).sum(dtype=np.uint64) if len(s) else o for s, o in zip(sets, own)], np.uint64)
            h2 = np.array([kernels.mix(s ^ _U(0x8EBC6AF09C88C6E3)).sum(dtype=np.uint64) if len(s) else o for s, o in zip(sets, own)], np.uint64)
            full = np.flatnonzero(n)
            keys = band_keys(signatures([sets[k] for k in full])).reshape(-1)
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys, pa.int64()))
            columns = [ids[i:j].cast(pa.int64()), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), bands]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "h1", "h2", "bands"])


@kernels.tidied
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashed set of each text, and its parities."""
    for batch in batches:
        text = kernels.text_array(batch.column(1))
        for i, j in kernels.blocks(text):
            sets = list(kernels.shingle_sets(text[i:j], WORDS))
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets)
            bit = (np.repeat(np.arange(len(sets)), np.diff(at)) * SKETCH + (flat & _U(SKETCH - 1)).astype(np.int64)).astype(np.int64)
            odd = (np.bincount(bit, minlength=len(sets) * SKETCH) & 1).astype(np.uint8).reshape(len(sets), SKETCH)
            sketch = np.packbits(odd, axis=1).view(np.int64)
            own = pa.array([int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64())
            columns = [batch.column(0)[i:j], own, pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64))), *(pa.array(x) for x in sketch.T)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "own", "shingles", *_PARITY])


_PARITY = [f"p{k}" for k in range(SKETCH // 64)]


def _several(rows: DataFrame) -> DataFrame:
    """The rows whose shingle still joins two components, among rows whose bounds some other row may meet."""
    # written, so that both sides of the join are plain exchanges and a frequent shingle's rows can be split
    rows = shared.saved(rows, "prefixes")
    bounds = rows.groupBy("shingle").agg(F.min("size").alias("least"), F.max("most").alias("widest"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    bounds = shared.saved(bounds.where("lo <> hi"), "bounds")
    rows = rows.join(bounds, "shingle").where("least <= most AND size <= widest").select(*rows.columns)
    several = rows.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return rows.join(shared.saved(several.select("shingle"), "several"), "shingle", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``sets`` holds (node, shingles)."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a")
    full = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
    both = F.size(F.array_intersect("s", "t"))  # distinct shingles on both sides
    near = full.select("a", "b", (F.size("s") + F.size("t")).alias("all"), both.alias("both"))
    return near.where(f"both > 0 AND 100 * CAST(both AS long) >= {percent} * (CAST(all AS long) - both)").select("a", "b")


def cross_pairs(live: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The distinct pairs (a, b) of different components that share a shingle of ``live`` and that the bounds leave."""
    x, y = (live.select(*[F.col(c).alias(f"{side}_{c}") for c in live.columns]) for side in "xy")
    bits = sets.select("node", "own", *_PARITY)
    x, y = (one.join(bits.select(*[F.col(c).alias(f"{side}_{c}") for c in bits.columns]), [f"{side}_node", f"{side}_own"]) for one, side in ((x, "x"), (y, "y")))
    apart = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"x_{p}").bitwiseXOR(F.col(f"y_{p}"))) for p in _PARITY))
    # sizes a and b share at most (a + b - apart) / 2, and must share percent / (100 + percent) of a + b
    near = (100 + percent) * (F.col("x_size") + F.col("y_size") - apart) >= 2 * percent * (F.col("x_size") + F.col("y_size"))
    fits = F.expr("x_shingle = y_shingle AND x_component <> y_component AND x_node < y_node AND y_size <= x_most AND x_size <= y_most")
    return x.join(y, fits & near).select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = shared.saved(source.mapInArrow(_sign, _SIGNED), "signed")
    real = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = shared.saved(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")), "classes")
    ids = real.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi"))
    again = shared.saved(ids.where("n > 1"), "repeated")
    # of a node's rows (those of an id that is repeated), each set once
    reps = real.select(F.col("doc_id").alias("node"), "h1", "h2", "bands").join(classes.select("node"), "node", "left_semi")
    keys = reps.select("node", F.explode("bands").alias("key"))
    shared_keys = shared.saved(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    members = shared.saved(keys.join(shared_keys, "key").distinct(), "members")
    nodes = shared.saved(members.groupBy("node").agg(F.sum("n").alias("score")), "nodes")

    texts = source.withColumnRenamed("doc_id", "node").join(nodes.select("node"), "node", "left_semi")
    many = again.select(F.col("doc_id").alias("node"))
    once = texts.join(many, "node", "left_semi").groupBy("node", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("node", "text")
    kind = "node long, own long, shingles array<long>" + "".join(f", {p} long" for p in _PARITY)
    sets = texts.join(many, "node", "left_anti").mapInArrow(_sets, kind).unionByName(once.mapInArrow(_sets, kind).dropDuplicates(["node", "own"]))
    sets = shared.saved(sets, "sets")

    leaders = members.join(nodes, "node").groupBy("key").agg(F.max(F.struct("score", (-F.col("node")).alias("m"))).alias("x")).select("key", (-F.col("x.m")).alias("leader"))
    star = members.join(shared.saved(leaders, "leaders"), "key").where("node <> leader")
    star = shared.saved(star.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    links = shared.saved(verified(star, sets, percent).distinct(), "verified")
    # equal ids are one document: an id with several texts joins their classes
    same_id = real.join(again.where("lo <> hi").select("doc_id"), "doc_id", "left_semi").select("doc_id", "h1", "h2").distinct().join(classes, ["h1", "h2"])
    grouped = components(links.unionByName(same_id.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))))

    placed = shared.saved(members.join(grouped, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_ = placed.join(shared.saved(mixed, "mixed"), "key", "left_semi")
    within = shared.saved(open_.select("node", "component").distinct(), "open")
    rows = sets.join(within, "node").select("node", "own", "component", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    rows = shared.saved(rows, "shingles")
    common = shared.saved(rows.groupBy("shingle").agg(F.count("*").alias("n")), "common")
    rank = F.row_number().over(Window.partitionBy("node", "own").orderBy("n", "shingle")) - 1
    ranked = rows.join(common, "shingle").withColumn("rank", rank)
    # what a set has from this shingle on limits the size of a partner that shares nothing rarer
    ranked = ranked.withColumn("most", (100 * F.col("size") - (100 + percent) * F.col("rank")) / percent)
    ranked = ranked.where(f"n > 1 AND 100 * most >= {percent} * size")
    live = shared.saved(_several(ranked.select("shingle", "node", "own", "component", "size", "most")), "live")
    pairs = cross_pairs(live, sets.join(within.select("node"), "node", "left_semi"), percent)
    tested = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = verified(shared.saved(pairs.join(tested, ["a", "b"], "left_anti"), "pairs"), sets, percent)
    final = components(grouped.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    home = classes.join(final, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component"))
    home = shared.saved(home, "homes")
    out = signed.join(home, ["h1", "h2"], "left")
    return out.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays."""
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


#: All pairs that share a shingle, by brute force, and all that is reached through links. Documents are taken to have distinct ids.
ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + {WORDS - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS} + 2, 2))) AS p FROM d WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), near AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)
), links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near
), reached AS (SELECT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
), groups AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN groups USING (doc_id)"""
