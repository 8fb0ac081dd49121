"""A prefix trie of conversations, totalled by leaf-peeling message passing.

Turns get their place in a conversation by a range sort whose borders follow the
data and may divide a conversation. A conversation's first d turns are named by
two 64-bit exclusive-or sums of hashes of (depth, role, text), which are running
sums in ranges of ``RANGE`` places, so that a long conversation is many tasks'.
Equal names are one node: only 128 equal bits of different turns could mislead.

Each node belongs to its longest conversation (the smallest among equals). The
nodes of one owner are a path down to a leaf; paths hang on nodes of paths that
are longer, so of n nodes no chain of paths has more than sqrt(2n). The message
passing is between paths: each holds a counter of child paths that have not yet
reported; in a round all paths whose counter is at zero send the totals of their
subtrees to the node that they hang on, which counts down, until the root's path
is through. A path's own nodes then take what hangs on them by running sums from
its leaf up. Peeling single nodes instead would take a round for every turn of
the longest conversation.

Edge cases: rows without conv_id are left out; a null role or text is empty; a
null turn comes first; turns of equal number are ordered by role and then by the
MD5 of the text; repeated rows are turns of their own; a conversation of which
nothing is left (all its turns replaced by those of a conversation that doesn't
exist) is a member of the root; an empty table gives an empty result; extra
columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels, shared

#: Places summed together.
RANGE = 1024
#: Ids of members joined into one string.
JOINED = 4096
#: Conversations of a group share the first turns of its first one; how many is a hash modulo this.
GROUP, HEADS = 100, 6


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's place among the rows of its conv_id in this task, whose rows are sorted."""
    last, count = None, 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(ids):
            continue
        first = np.append(0, np.flatnonzero(np.diff(ids)) + 1)
        place = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
        if ids[0] == last:
            place[: first[1] if len(first) > 1 else len(ids)] += count
        last, count = ids[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "_n"])


def placed(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, a, b, chars): every turn's place from 0, the halves of its text's MD5 and its code points."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    half = lambda k: F.conv(F.substring("_md5", k, 16), 16, -10).cast("long")
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.md5(text.cast("binary")).alias("_md5"), F.length(text).cast("long").alias("chars"))
    turns = turns.withColumn("_row", F.monotonically_increasing_id())
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "_md5", "_row"]
    turns = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", half(1).alias("a"), half(17).alias("b"), "chars", F.spark_partition_id().alias("_part"))
    turns = shared.saved(turns.mapInArrow(_numbered, "conv_id long, role string, a long, b long, chars long, _part int, _n long"), "turns")
    parts = turns.groupBy("conv_id", "_part").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("conv_id").orderBy("_part")  # a row a task of the range sort at most
    parts = parts.withColumn("_before", F.sum("_rows").over(earlier) - F.col("_rows")).where("_before > 0").drop("_rows")
    parts = F.broadcast(parts)  # a task's range continues one conversation at most
    return turns.join(parts, ["conv_id", "_part"], "left").select("conv_id", (F.col("_n") + F.coalesce("_before", F.lit(0))).alias("pos"), "role", "a", "b", "chars")


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """(conv_id, total, depth, role, a, b, chars): the turns of each rebuilt conversation, from depth 1, and its depth in all; at depth 0 a row without turn.

    The first h = crc32(conv_id) % ``heads`` turns are those of the first conversation of its group; its own follow from the h-th on.
    """
    head = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < heads - 1)).groupBy(F.col("conv_id").alias("_first"))
    head = head.agg(F.sort_array(F.collect_list(F.struct("pos", "role", "a", "b", "chars"))).alias("_head"))  # heads - 1 turns at most
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("_own")).withColumn("_h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads)
    convs = convs.withColumn("_first", F.col("conv_id") - F.col("conv_id") % group).join(head, "_first", "left")
    convs = convs.withColumn("_head", F.slice(F.coalesce("_head", F.array().cast(head.schema["_head"].dataType)), 1, F.col("_h").cast("int")))
    convs = convs.withColumn("_k", F.size("_head").cast("long")).withColumn("total", F.col("_k") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0)))
    convs = shared.saved(convs.select("conv_id", "total", "_h", "_k", "_head"), "convs")
    own = turns.join(convs.select("conv_id", "total", "_h", "_k"), "conv_id").where("pos >= _h").withColumn("depth", F.expr("_k + pos - _h + 1"))
    names = ["conv_id", "total", "depth", "role", "a", "b", "chars"]
    lent = convs.select("conv_id", "total", F.explode("_head").alias("_t")).select("conv_id", "total", (F.col("_t.pos") + 1).alias("depth"), "_t.role", "_t.a", "_t.b", "_t.chars")
    roots = convs.select("conv_id", "total", *(F.lit(0).cast("long").alias(c) for c in ("depth",)), F.lit("").alias("role"), *(F.lit(0).cast("long").alias(c) for c in ("a", "b", "chars")))
    return own.select(names).unionByName(lent).unionByName(roots)


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, total, depth, chars, x, y, px, py): the names of each prefix of ``rebuilt`` rows, and of the prefix a turn shorter."""
    bits = lambda k: F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), "depth", "role", "a", "b")).otherwise(F.lit(0))
    rows = rows.select("conv_id", "total", "depth", "chars", bits(1).alias("_x"), bits(2).alias("_y"), F.expr(f"depth div {RANGE}").alias("_range"))
    own = Window.partitionBy("conv_id", "_range").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    named = rows.withColumns({"x": F.bit_xor("_x").over(own), "y": F.bit_xor("_y").over(own)})
    long = rows.where(F.col("total") >= RANGE).groupBy("conv_id", "_range").agg(F.bit_xor("_x").alias("_rx"), F.bit_xor("_y").alias("_ry"))
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    long = long.select("conv_id", "_range", F.bit_xor("_rx").over(earlier).alias("_rx"), F.bit_xor("_ry").over(earlier).alias("_ry")).where("_range > 0")
    named = named.join(long, ["conv_id", "_range"], "left")
    x, y = (F.col(c).bitwiseXOR(F.coalesce(f"_r{c}", F.lit(0))) for c in ("x", "y"))
    return named.select("conv_id", "total", "depth", "chars", x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("_x")).alias("px"), y.bitwiseXOR(F.col("_y")).alias("py"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (x, y, depth, conv_id) to (x, y, depth, first id, ids joined by commas), of at most ``JOINED`` ids each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
        ids = batch.column(3).to_pylist()
        new = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))
        runs = np.flatnonzero(new).tolist()
        at = [k for a, b in zip(runs, [*runs[1:], len(ids)]) for k in range(a, b, JOINED)]
        said = [",".join(map(str, ids[a:b])) for a, b in zip(at, [*at[1:], len(ids)])]
        yield pa.RecordBatch.from_arrays([*(pa.array(keys[k][at]) for k in range(3)), pa.array([ids[a] for a in at], pa.int64()), pa.array(said, pa.string())], ["x", "y", "depth", "_id", "said"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest = None, hashlib.sha256()
    row = lambda rows: pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[3] for r in rows], pa.string())], ["x", "y", "depth", "ends_sha256"])
    for batch in batches:
        done = []
        for *key, _, said in zip(*(c.to_pylist() for c in batch.columns)):
            if key != now:
                if now:
                    done.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(said.encode())
            else:
                digest.update(b"," + said.encode())
        yield row(done)
    if now:
        yield row([(*now, digest.hexdigest())])


def ends(named: DataFrame) -> DataFrame:
    """(x, y, depth, ends_sha256) of the nodes at which conversations end. Long lists of ids are joined in many tasks; one task digests the strings."""
    key = ["x", "y", "depth"]
    last = named.where("depth = total").select(*key, "conv_id")
    last = last.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    said = last.mapInArrow(_joined, "x long, y long, depth long, _id long, said string")
    return said.repartition(*key).sortWithinPartitions(*key, "_id").mapInArrow(_digested, "x long, y long, depth long, ends_sha256 string")


def linked(named: DataFrame) -> DataFrame:
    """The nodes: their names, smallest member, owner, members, code points of their last turn, children, and their parent's smallest member and owner."""
    longest = F.max(F.struct("total", F.bitwise_not("conv_id").alias("_c")))  # the smallest id of the longest
    nodes = named.groupBy("x", "y", "depth").agg(F.min("conv_id").alias("conv_id"), longest.alias("_o"), F.count("*").alias("n_convs"), *(F.max(c).alias(c) for c in ("chars", "px", "py")))
    nodes = shared.saved(nodes.select("x", "y", "depth", "conv_id", F.bitwise_not("_o._c").alias("owner"), "n_convs", "chars", "px", "py"), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("px").alias("x"), F.col("py").alias("y"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("depth").alias("_above"), F.col("conv_id").alias("parent_conv_id"), F.col("owner").alias("parent_owner"))
    out = nodes.withColumn("_above", F.col("depth") - 1).join(above, ["px", "py", "_above"], "left")
    out = out.join(children, ["x", "y", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return shared.saved(out.select("x", "y", "depth", "conv_id", "owner", "n_convs", "chars", "n_children", "parent_conv_id", "parent_owner"), "linked")


def peeled(nodes: DataFrame) -> DataFrame:
    """(path, parent, at, saved, leaves): each path's totals over its subtree, and the node it hangs on (path and depth)."""
    saved = F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    paths = nodes.groupBy(F.col("owner").alias("path")).agg(F.min_by("parent_owner", "depth").alias("parent"), (F.min("depth") - 1).alias("at"), saved, F.lit(1).cast("long").alias("leaves"))
    waits = paths.where("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("remaining"))
    open_ = shared.saved(paths.join(waits, "path", "left").withColumn("remaining", F.coalesce("remaining", F.lit(0))), "paths")
    rounds = [open_]
    while True:  # each round completes at least the lowest paths
        told = open_.where("remaining = 0 AND parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("_n"), F.sum("saved").alias("_saved"), F.sum("leaves").alias("_leaves"))
        held = open_.where("remaining > 0").join(told, "path", "left").na.fill(0, ["_n", "_saved", "_leaves"])
        held = held.select("path", "parent", "at", (F.col("saved") + F.col("_saved")).alias("saved"), (F.col("leaves") + F.col("_leaves")).alias("leaves"), (F.col("remaining") - F.col("_n")).alias("remaining"))
        open_ = shared.saved(held, "paths")
        if open_.isEmpty():
            break
        rounds.append(open_)
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out.where("remaining = 0").drop("remaining")


def totals(nodes: DataFrame) -> DataFrame:
    """``nodes`` with n_leaves and saved_tokens of their subtrees."""
    hung = peeled(nodes).where("parent IS NOT NULL").groupBy(F.col("parent").alias("owner"), F.col("at").alias("depth")).agg(F.sum("saved").alias("_s"), F.sum("leaves").alias("_l"))
    own = nodes.join(hung, ["owner", "depth"], "left").na.fill(0, ["_s", "_l"])
    own = own.withColumn("_s", F.col("_s") + (F.col("n_convs") - 1) * F.col("chars")).withColumn("_range", F.expr(f"depth div {RANGE}"))
    below = Window.partitionBy("owner", "_range").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    lower = Window.partitionBy("owner").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, 0)
    ranges = own.where(F.col("depth") >= RANGE).groupBy("owner", "_range").agg(F.sum("_s").alias("_s"), F.sum("_l").alias("_l"))
    ranges = ranges.select("owner", (F.col("_range") - 1).alias("_range"), F.sum("_s").over(lower).alias("_rs"), F.sum("_l").over(lower).alias("_rl"))
    out = own.withColumns({"_s": F.sum("_s").over(below), "_l": F.sum("_l").over(below)}).join(ranges, ["owner", "_range"], "left").na.fill(0, ["_rs", "_rl"])
    return out.withColumns({"saved_tokens": F.col("_s") + F.col("_rs"), "n_leaves": F.col("_l") + F.col("_rl") + 1})  # the leaf at the path's end


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of ``rebuilt`` rows (or any with its columns)."""
    named = shared.saved(prefixes(rows), "prefixes")
    out = totals(linked(named)).join(ends(named), ["x", "y", "depth"], "left")
    none = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(placed(shared.table(spark, sf_dir, "conversations"))))


#: DuckDB: prefixes by strings of digests; subtrees by joining each node with the prefixes of one of its members.
ORACLE_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
  UNION ALL
  SELECT conv_id, s, i + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END
  FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(s, i // 8 + 1, 1))) ELSE c END AS v FROM crc WHERE i < 8 * length(s))
), h AS (
  SELECT conv_id, xor(c, 4294967295) % {HEADS} AS h, conv_id - conv_id % {GROUP} AS g FROM crc WHERE i = 8 * length(s)
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT h.*, (SELECT count(*) FROM t WHERE t.conv_id = h.g) AS n_g FROM h
), r AS (
  SELECT n.conv_id, t.pos + 1 AS depth, role, text FROM n JOIN t ON t.conv_id = n.g AND t.pos < n.h
  UNION ALL
  SELECT n.conv_id, least(n.h, n.n_g) + t.pos - n.h + 1, role, text FROM n JOIN t USING (conv_id) WHERE t.pos >= n.h
), k AS (
  SELECT conv_id, depth, length(text) AS chars, string_agg(md5(md5(role) || md5(text)), '') OVER w AS name, max(depth) OVER (PARTITION BY conv_id) AS total
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
), p AS (
  SELECT conv_id, depth, chars, md5(name) AS name, CASE WHEN depth = 1 THEN '' ELSE md5(left(name, length(name) - 32)) END AS above, total FROM k
  UNION ALL
  SELECT n.conv_id, 0, 0, '', NULL, coalesce(x.total, 0) FROM n LEFT JOIN (SELECT conv_id, max(depth) AS total FROM k GROUP BY 1) x USING (conv_id)
), d AS (
  SELECT depth, name, any_value(above) AS above, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = total), '')) AS ends_sha256
  FROM p GROUP BY 1, 2
), c AS (
  SELECT depth - 1 AS depth, above AS name, count(*) AS n_children FROM d WHERE depth > 0 GROUP BY 1, 2
), e AS (
  SELECT d.*, coalesce(n_children, 0) AS n_children FROM d LEFT JOIN c USING (depth, name)
), s AS (
  SELECT p.depth, p.name, count(*) FILTER (e.n_children = 0) AS n_leaves, CAST(sum((e.n_convs - 1) * e.chars) AS BIGINT) AS saved_tokens
  FROM e JOIN p ON p.conv_id = e.conv_id AND p.depth <= e.depth GROUP BY 1, 2
)
SELECT e.conv_id, CAST(e.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, e.n_convs, e.n_children, n_leaves, saved_tokens, e.ends_sha256
FROM e JOIN s USING (depth, name) LEFT JOIN e u ON u.depth = e.depth - 1 AND u.name = e.above"""
