"""From a source's cadence to a schedule's steps: hold, conservative, linear; and dataset-side time operators.

Both grids are regular, so every overlap is arithmetic: steps are exploded to
the source intervals they touch and joined by equality, never by comparison.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.temporal import EPOCH, Schedule, micros


def _us(x) -> int:
    return (x - EPOCH if isinstance(x, datetime) else x) // timedelta(microseconds=1)


def _steps(schedule: Schedule, spark) -> DataFrame:
    return schedule.frame(spark).withColumns({"_s": micros(F.col("start")), "_e": micros(F.col("end"))})


def conservative(df: DataFrame, points: list[str], time: str, value: str, start: datetime, interval: timedelta, schedule: Schedule, accumulated: bool = False) -> DataFrame:
    """(points, step, value): means weighted by overlap; of accumulated values, the mean rate per second.

    A source sample stands for [time, time + interval); samples must be at ``start`` plus whole intervals.
    Steps that the source doesn't wholly cover get null (for rates of means).
    """
    us, first = _us(interval), _us(start)
    steps = _steps(schedule, df.sparkSession)
    lo, hi = F.expr(f"(_s - {first}L) div {us}L"), F.expr(f"(_e - 1L - {first}L) div {us}L")
    touched = steps.select("step", "_s", "_e", F.explode(F.sequence(lo, hi)).alias("_i"))
    part = F.least(F.col("_e"), F.lit(first + us) + F.col("_i") * us) - F.greatest(F.col("_s"), F.lit(first) + F.col("_i") * us)
    touched = touched.withColumn("_part", part)
    source = df.withColumn("_i", F.expr(f"({_name(time)} - {first}L) div {us}L")).select(*points, "_i", value)
    joined = source.join(touched, "_i")
    if accumulated:
        return joined.groupBy(*points, "step").agg((F.sum(F.col(value) * F.col("_part") / us) / F.first(F.col("_e") - F.col("_s")) * 1_000_000).alias("value"))
    covered = F.sum("_part") == F.first(F.col("_e") - F.col("_s"))
    mean = F.sum(F.col(value) * F.col("_part")) / F.sum("_part")
    return joined.groupBy(*points, "step").agg(F.when(covered, mean).alias("value"))


def _name(time: str) -> str:
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', `{time}`)"


def hold(df: DataFrame, points: list[str], time: str, value: str, start: datetime, interval: timedelta, schedule: Schedule) -> DataFrame:
    """(points, step, value): the value of the one source interval that holds the step; a step across a border is an error."""
    us, first = _us(interval), _us(start)
    steps = _steps(schedule, df.sparkSession)
    lo, hi = F.expr(f"(_s - {first}L) div {us}L"), F.expr(f"(_e - 1L - {first}L) div {us}L")
    checked = F.when(lo == hi, lo).otherwise(F.raise_error(F.concat(F.lit("a step crosses a source border: step "), F.col("step").cast("string"))).cast("long"))
    steps = steps.select("step", checked.alias("_i"))
    source = df.withColumn("_i", F.expr(f"({_name(time)} - {first}L) div {us}L"))
    return source.join(steps, "_i").select(*points, "step", F.col(value).alias("value"))


def linear(df: DataFrame, points: list[str], time: str, value: str, start: datetime, interval: timedelta, schedule: Schedule) -> DataFrame:
    """(points, step, value): between the two samples around each step's middle; none past the last sample."""
    us, first = _us(interval), _us(start)
    steps = _steps(schedule, df.sparkSession)
    middle = (F.col("_s") + F.col("_e")) / 2 - first
    left = F.floor(middle / us)
    steps = steps.select("step", left.alias("_l"), (middle / us - left).alias("_f"))
    steps = steps.select("step", F.explode(F.when(F.col("_f") == 0, F.array(F.struct(F.col("_l").alias("_i"), F.lit(1.0).alias("_w")))).otherwise(F.array(F.struct(F.col("_l").alias("_i"), (1 - F.col("_f")).alias("_w")), F.struct((F.col("_l") + 1).alias("_i"), F.col("_f").alias("_w"))))).alias("x")).select("step", "x.*")
    source = df.withColumn("_i", F.expr(f"({_name(time)} - {first}L) div {us}L"))
    joined = source.join(steps, "_i").groupBy(*points, "step").agg(F.sum(F.col(value) * F.col("_w")).alias("value"), F.sum("_w").alias("_w"))
    return joined.where("abs(_w - 1) < 1e-9").drop("_w")


def time_aggregated(df: DataFrame, points: list[str], time: str, value: str, start: datetime, width: timedelta, methods: dict[str, str], factor: float = 1.0) -> DataFrame:
    """(points, block, a column per name): plain aggregates over blocks of ``width``, divided by ``factor`` afterwards."""
    allowed = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}
    if unknown := set(methods.values()) - allowed.keys():
        raise ValueError(f"unknown methods {sorted(unknown)}")
    block = F.expr(f"({_name(time)} - {_us(start)}L) div {_us(width)}L")
    return df.groupBy(*points, block.alias("block")).agg(*[(allowed[m](value) / factor).alias(n) for n, m in methods.items()])


def increments(df: DataFrame, points: list[str], time: str, value: str, interval: timedelta, clip: bool = True) -> DataFrame:
    """``df`` with ``increment``: differences of a total that starts anew each day, stamped at the interval's end."""
    began = F.date_trunc("day", F.timestamp_add("MICROSECOND", F.lit(-_us(interval)), F.col(time))).cast("timestamp_ntz")
    order = Window.partitionBy(*points, "_day").orderBy(time)
    step = F.col(value) - F.coalesce(F.lag(value).over(order), F.lit(0.0))
    return df.withColumn("_day", began).withColumn("increment", F.greatest(step, F.lit(0.0)) if clip else step).drop("_day")


def shifted(df: DataFrame, point: str, step: str, value: str, shifts: DataFrame, n_steps: int, fill: float | None = 0.0) -> DataFrame:
    """(point, step, value): what each point has ``shift`` steps later; ``fill`` outside. Points without a shift have 0."""
    moved = df.join(shifts.select(point, "shift"), point, "left").withColumn("_to", F.col(step) - F.coalesce("shift", F.lit(0)))
    moved = moved.where((F.col("_to") >= 0) & (F.col("_to") < n_steps)).select(point, F.col("_to").alias(step), value)
    grid = df.select(point).distinct().withColumn(step, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_steps - 1).cast("long"))))
    out = grid.join(moved, [point, step], "left")
    return out if fill is None else out.withColumn(value, F.coalesce(value, F.lit(fill)))


def sliding(df: DataFrame, step: str, n_steps: int, window: int, stride: int | None = None) -> DataFrame:
    """``df`` with ``window_start`` and ``offset``: each row once in every whole window that holds it."""
    stride = stride or window
    if not 0 < window <= n_steps or stride < 1:
        raise ValueError("the window must fit the steps")
    first = F.greatest(F.lit(0), F.ceil((F.col(step) - window + 1) / stride)) * stride
    last = F.least(F.floor(F.col(step) / stride) * stride, F.lit((n_steps - window) // stride * stride))
    starts = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"), F.lit(stride).cast("long"))).otherwise(F.array().cast("array<long>"))
    return df.withColumn("window_start", F.explode(starts)).withColumn("offset", F.col(step) - F.col("window_start"))


def chunked(df: DataFrame, points: list[str], step: str, value: str, length: int, n_steps: int) -> DataFrame:
    """(points, chunk, position, value, valid): steps in chunks; the last one is filled up with zeros."""
    whole = -(-n_steps // length) * length
    grid = df.select(*points).distinct().withColumn(step, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(whole - 1).cast("long"))))
    out = grid.join(df.select(*points, step, value), [*points, step], "left")
    return out.select(*points, F.expr(f"`{step}` div {length}").alias("chunk"), (F.col(step) % length).alias("position"), F.coalesce(value, F.lit(0.0)).alias("value"), (F.col(step) < n_steps).alias("valid"))


def values_or_zero(x: Column, clip_negative: bool = False) -> Column:
    """NaN and null become 0, then negatives if asked for."""
    out = F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))
    return F.greatest(out, F.lit(0.0)) if clip_negative else out


def has_value(x: Column) -> Column:
    """Neither null nor NaN."""
    return x.isNotNull() & ~F.isnan(x.cast("double"))


def longest_runs(df: DataFrame, key: str, step: str) -> DataFrame:
    """(key, start, length): each key's longest run of consecutive steps among its rows; the earliest of equals."""
    rows = df.select(key, step).distinct()
    island = rows.withColumn("_i", F.col(step) - F.row_number().over(Window.partitionBy(key).orderBy(step)))
    runs = island.groupBy(key, "_i").agg(F.min(step).alias("start"), F.count("*").alias("length"))
    return runs.groupBy(key).agg(F.max(F.struct("length", (-F.col("start")).alias("s"))).alias("x")).select(key, (-F.col("x.s")).alias("start"), F.col("x.length").alias("length"))


def common_spans(runs: DataFrame, group: str) -> DataFrame:
    """(group, shift, length): the steps that all members of a group have; members without any are ignored."""
    spans = runs.where("length > 0").groupBy(group).agg(F.max("start").alias("shift"), F.min(F.col("start") + F.col("length")).alias("_end"))
    return spans.select(group, "shift", F.greatest(F.lit(0), F.col("_end") - F.col("shift")).cast("long").alias("length"))


def nan_sum(x: Column) -> Column:
    """A sum that skips NaN; null when there is nothing else."""
    return F.sum(F.when(~F.isnan(x), x))
