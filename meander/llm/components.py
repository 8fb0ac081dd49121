"""Connected components of a link table by distributed union-find.

Links are first contracted by a local union-find inside each partition, then by
alternating star steps (every neighbour hangs on the smallest one) until the
forest no longer changes. Nothing is collected but two counts per round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


#: Nodes that a task's local union-find holds at once, about.
HELD = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local union-find: each node of the partition with the smallest node it is joined to there.

    When it holds ``HELD`` nodes, what it found is passed on and it begins anew; later steps join the parts.
    """
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def found() -> Iterator[pa.RecordBatch]:
        nodes = list(parent)
        for i in range(0, len(nodes), 100_000):
            part = [(x, r) for x in nodes[i : i + 100_000] if (r := find(x)) != x]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= HELD:
            yield from found()
            parent.clear()
    yield from found()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, component): every linked node but the smallest of its component, with that smallest one.

    Self-links and links with a null end are ignored; an empty table gives an empty one.
    """
    both = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    stars = shared.saved(both.mapInArrow(_contract, "a long, b long").distinct(), "links")
    state = None
    while True:  # each round that changes the forest hangs nodes on smaller ones, so it comes to an end
        near = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        stars = shared.saved(small.select("x.*").where("a <> b").distinct(), "links")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
