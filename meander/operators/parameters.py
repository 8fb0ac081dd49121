"""Parameter values over time from a log of changes: SET replaces, ADD adds on each active step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lookup import with_positions


def expanded(plans: DataFrame) -> DataFrame:
    """(target, step, kind, x): plans (target, start_step, kind, x, active_steps) by step; a SET acts once."""
    last = F.col("start_step") + F.when(F.col("kind") == "ADD", F.col("active_steps") - 1).otherwise(0)
    return plans.select("target", F.explode(F.sequence(F.col("start_step"), last)).alias("step"), "kind", "x")


def timeline(changes: DataFrame, initial: float = 0.0) -> DataFrame:
    """(target, step, value) after each step with changes (target, step, kind, x): SETs before ADDs of the same step."""
    order = Window.partitionBy("target").orderBy("step")
    per_step = changes.groupBy("target", "step").agg(F.max(F.when(F.col("kind") == "SET", F.col("x"))).alias("_set"), F.sum(F.when(F.col("kind") == "ADD", F.col("x")).otherwise(0.0)).alias("_add"))
    runs = per_step.withColumn("_run", F.count("_set").over(order))
    run = Window.partitionBy("target", "_run").orderBy("step")
    base = F.coalesce(F.first("_set").over(run), F.lit(initial))
    return runs.select("target", "step", (base + F.sum("_add").over(run)).alias("value"))


def conflicting_sets(plans: DataFrame) -> DataFrame:
    """(target, start_step) with more than one SET."""
    return plans.where("kind = 'SET'").groupBy("target", "start_step").count().where("count > 1").select("target", "start_step")


def copied_input(df: DataFrame, value: str, when_none: str, point: str, step: str) -> DataFrame:
    """Absent inputs: ``zero``, ``keep`` (the point's last value, else 0), or ``required`` (an error)."""
    if when_none == "zero":
        return df.withColumn(value, F.coalesce(value, F.lit(0.0)))
    if when_none == "keep":
        before = Window.partitionBy(point).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(before), F.lit(0.0)))
    if when_none == "required":
        return df.withColumn(value, F.coalesce(value, F.raise_error(F.lit(f"{value} is required")).cast("double")))
    raise ValueError("when_none is zero, keep or required")


def summary(plans: DataFrame) -> DataFrame:
    """(place, start_step, name, kind, x, active_steps, target): the plans in the order in which they act, SETs before ADDs."""
    keyed = plans.withColumn("_key", F.struct("start_step", "name", F.when(F.col("kind") == "SET", 0).otherwise(1), "target", "x"))
    return with_positions(keyed, "_key", "place").drop("_key").select("place", "start_step", "name", "kind", "x", "active_steps", "target")
