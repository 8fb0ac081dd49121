"""Gauge overlays on a source's steps: inflow and loss series, aligned, shifted by basin, read by window.

A basin's gauges share a shift (the latest start of their longest valid runs) and a
length (up to the earliest end), so that all windows of a basin begin where all its
gauges have values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import IntegrityError, missing, require_unique
from .resample import common_spans, longest_runs, nan_sum


def aligned_steps(gauges: DataFrame, offset: int, n_steps: int, pad: float | None) -> DataFrame:
    """(gauge, step, value): steps counted from ``offset`` on, cut and padded to 0 to n_steps - 1.

    Beyond the steps that the table has at all, values are ``pad``; a step that it has, but not for a gauge, is missing (null).
    """
    low, high = gauges.agg(F.min("step"), F.max("step")).first()
    moved = gauges.select("gauge", (F.col("step") - offset).cast("long").alias("step"), "value")
    grid = gauges.select("gauge").distinct().withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_steps - 1).cast("long"))))
    observed = (F.col("step") + offset).between(F.lit(low), F.lit(high))
    return grid.join(moved, ["gauge", "step"], "left").select("gauge", "step", F.when(observed, F.col("value")).otherwise(F.lit(pad)).alias("value"))


def by_point(gauges: DataFrame, points: DataFrame) -> DataFrame:
    """(gauge, step, value): gauges (point, step, value) summed by wanted point (gauge, ...), NaN where all are; points without a gauge are an error."""
    require_unique(points, "gauge")
    if found := missing(points, "gauge", gauges, "point").orderBy("key").limit(5).collect():
        raise IntegrityError(f"points without a gauge: {[r[0] for r in found]}")
    wanted = gauges.join(points.select(F.col("gauge").alias("point")), "point")
    return wanted.groupBy(F.col("point").alias("gauge"), "step").agg(F.coalesce(nan_sum(F.col("value")), F.lit(float("nan"))).alias("value"))


def spans(aligned: DataFrame, points: DataFrame) -> DataFrame:
    """(basin, shift, length) over the gauges (gauge, basin) of each basin; those without values are ignored."""
    valid = aligned.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return common_spans(longest_runs(valid, "gauge", "step").join(points.select("gauge", "basin"), "gauge"), "basin")


def inflow(gauges: DataFrame, points: DataFrame, offset: int, n_steps: int) -> tuple[DataFrame, DataFrame]:
    """((gauge, step, value, shift, length), (basin, shift, length)): values inside the basin's span, 0 elsewhere and where missing.

    ``gauges`` (point, step, value) on their own steps, ``points`` (gauge, basin).
    """
    aligned = aligned_steps(by_point(gauges, points), offset, n_steps, 0.0)
    basins = spans(aligned, points)
    held = aligned.join(points.select("gauge", "basin"), "gauge").join(basins, "basin", "left")
    shift, length = (F.coalesce(c, F.lit(0)).cast("long") for c in ("shift", "length"))
    inside = (F.col("step") >= shift) & (F.col("step") < shift + length)
    value = F.when(inside, F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    return held.select("gauge", "step", value.alias("value"), shift.alias("shift"), length.alias("length")), basins


def loss(gauges: DataFrame, points: DataFrame, basins: DataFrame, offset: int, n_steps: int) -> DataFrame:
    """(gauge, step, value, shift): as observed, null where missing or outside; shifted as the inflow of the basin, or by 0."""
    if found := missing(points, "gauge", gauges, "point").orderBy("key").limit(5).collect():
        raise IntegrityError(f"points without a gauge: {[r[0] for r in found]}")
    own = gauges.join(points.select(F.col("gauge").alias("point")), "point").select(F.col("point").alias("gauge"), "step", "value")
    held = aligned_steps(own, offset, n_steps, None).join(points.select("gauge", "basin"), "gauge").join(basins.select("basin", "shift"), "basin", "left")
    return held.select("gauge", "step", F.when(~F.isnan("value"), F.col("value")).alias("value"), F.coalesce("shift", F.lit(0)).cast("long").alias("shift"))


def read_windows(overlay: DataFrame, last_start: int, length: int, fill: float | None, stride: int | None = None) -> DataFrame:
    """(window_start, gauge, offset, value): what each gauge has ``shift`` steps after each step of the windows; ``fill`` outside.

    Windows of ``length`` steps begin at 0, ``stride`` (or ``length``) and so on, up to ``last_start``.
    """
    steps = lambda last, by=1: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"), F.lit(by).cast("long")))
    grid = overlay.select("gauge").distinct().withColumn("window_start", steps(last_start, stride or length)).withColumn("offset", steps(length - 1))
    moved = overlay.select("gauge", (F.col("step") - F.col("shift")).alias("_at"), "value", F.lit(True).alias("_in"))
    out = grid.withColumn("_at", F.col("window_start") + F.col("offset")).join(moved, ["gauge", "_at"], "left")
    return out.select("window_start", "gauge", "offset", F.when(F.col("_in"), F.col("value")).otherwise(F.lit(fill)).alias("value"))


def with_overlays(source: DataFrame, overlays: dict[str, tuple[DataFrame, float | None]], last_start: int, length: int, stride: int | None = None) -> DataFrame:
    """(window_start, gauge, offset, value, a column per overlay): a source (gauge, step, value) and its overlays, each by its own shift and fill."""
    shifted = source if "shift" in source.columns else source.withColumn("shift", F.lit(0).cast("long"))
    out = read_windows(shifted, last_start, length, 0.0, stride)
    for name, (overlay, fill) in overlays.items():
        out = out.join(read_windows(overlay, last_start, length, fill, stride).withColumnRenamed("value", name), ["window_start", "gauge", "offset"], "left")
    return out
