"""Exact quantiles by distributed selection: no group's values are ever in one buffer or sorted.

Every wanted quantile lies between two ranks of its group. A rank is looked for in
an interval of values, at first the group's whole range: the interval is cut into
``BINS`` equal bins, whose counts and least and greatest values are partial
aggregates, and the bin that holds the rank becomes the next interval. A rank is
found when it is the first or last of its interval or all values there are equal,
which the first and last bin guarantee to come nearer in every pass. What is
shuffled is the bins' counts; a hot group costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

BINS = 4096
#: Groups up to which their intervals are sent to every task.
MOST_BROADCAST = 10_000


def quantiles(df: DataFrame, points: list[str], value: str, levels: list[float], bins: int = BINS) -> DataFrame:
    """(points, level, value): exact, linear between samples, as ``results.quantiles``; ``points`` may be empty. Null and NaN are left out; infinite values are an error.

    Groups without values are left out. A few passes over ``df``, which should be a table.
    """
    if any(not 0 <= q <= 1 for q in levels) or bins < 2:
        raise ValueError("levels are from 0 to 1, bins at least 2")
    keys = [f"_k{i}" for i in range(len(points))] or ["_k0"]
    x = F.col(value).cast("double")
    finite = F.when(F.abs(x) == float("inf"), F.raise_error(F.lit("infinite values have no quantiles")).cast("double")).otherwise(x)
    rows = df.select(*([F.col(p).alias(k) for p, k in zip(points, keys)] or [F.lit(0).alias("_k0")]), finite.alias("_x")).dropna(subset=["_x"])
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
    position = (F.col("level") * (F.col("_n") - 1)).alias("_position")
    wanted = groups.withColumn("level", F.explode(F.array(*(F.lit(float(q)) for q in dict.fromkeys(levels))))).select("*", position)
    ranks = F.array_distinct(F.array(F.floor("_position"), F.ceil("_position")))
    found = scratch.saved(wanted.withColumn("_rank", F.explode(ranks)).withColumn("_r", F.col("_rank")), "ranks")
    done = (F.col("_r") == 0) | (F.col("_r") == F.col("_n") - 1) | (F.col("_a") == F.col("_b"))
    parts = [found.where(done)]
    while not (open_ := found.where(~done)).isEmpty():
        found = scratch.saved(_narrowed(rows, open_, keys, bins), "ranks")
        parts.append(found.where(done))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    at = F.when(F.col("_r") == 0, F.col("_a")).otherwise(F.col("_b"))
    ends = every.groupBy(*keys, "level", "_position").agg(F.min_by(at, "_rank").alias("_low"), F.max_by(at, "_rank").alias("_high"))
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_position") - F.floor("_position"))
    return ends.select(*(F.col(k).alias(p) for k, p in zip(keys, points)), "level", between.alias("value"))


def _narrowed(rows: DataFrame, open_: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """The open ranks, each in the bin of its interval that holds it."""
    spans = open_.groupBy(*keys).agg(F.array_distinct(F.collect_list(F.struct("_a", "_b"))).alias("_spans"))  # two a level at most
    if open_.select(*keys).distinct().limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        spans = F.broadcast(spans)
    same = lambda a, b: F.expr(" AND ".join(f"{a}.{k} <=> {b}.{k}" for k in keys))
    held = rows.alias("r").join(spans.alias("s"), same("r", "s")).select("r.*", "_spans")
    # intervals of a group don't overlap, but two may share an end if values repeat: a value counts in each
    held = held.withColumn("_s", F.explode(F.filter("_spans", lambda s: (F.col("_x") >= s["_a"]) & (F.col("_x") <= s["_b"]))))
    a, b = F.col("_s._a"), F.col("_s._b")
    bin_ = F.least(F.floor((F.col("_x") / 2 - a / 2) / (b / 2 - a / 2) * bins), F.lit(bins - 1))  # monotone; halves don't overflow
    counts = held.groupBy(*keys, a.alias("_from"), b.alias("_to"), bin_.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    order = Window.partitionBy(*keys, "_from", "_to").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as bins
    counts = counts.withColumn("_upto", F.sum("_c").over(order))
    held_by = same("o", "c") & F.expr("o._a = c._from AND o._b = c._to AND o._r < c._upto AND o._r >= c._upto - c._c")
    return open_.alias("o").join(counts.alias("c"), held_by).select(*(F.col(f"o.{k}").alias(k) for k in keys), F.col("_c").alias("_n"), F.col("_lo").alias("_a"), F.col("_hi").alias("_b"), "level", "_position", "_rank", (F.col("_r") - F.col("_upto") + F.col("_c")).alias("_r"))
