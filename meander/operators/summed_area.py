"""Sums over rectangles by summed-area tables: sixteen look-ups a rectangle, however many cells it covers.

The table of a frame holds, at each corner of the grid, the sum of value times
area of all cells below and to the left. Between corners it is bilinear in the
shares of the cell's area, since values are constant within a cell; so a
rectangle's sum is a fixed combination of corners: four interpolated look-ups of
four corners each. The combinations are a mapping from corners to targets,
which ``apply_mapping`` applies to any number of frames.

Missing cells count as 0, as in ``apply_mapping``. Sums are exact to the rounding
of the whole frame's sum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mapping import Grid, apply_mapping


def corners(frames: DataFrame, grid: Grid, time: str, source: str, value: str) -> DataFrame:
    """(time, source, value) of every corner: its number is iy * (nx + 1) + ix. A row a corner and frame, two exchanges."""
    nx, ny = grid.x.n, grid.y.n
    x = F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    (left, right), (low, high) = grid.x.edges(F.col(source) % nx), grid.y.edges(F.expr(f"`{source}` div {nx}"))
    cells = frames.where(F.col(source).between(0, nx * ny - 1)).groupBy(F.col(time).alias("_t"), (F.col(source) % nx + 1).alias("_ix"), (F.expr(f"`{source}` div {nx}") + 1).alias("_iy")).agg(F.sum(x * grid.area(left, right, low, high)).alias("_v"))
    every = frames.select(F.col(time).alias("_t")).distinct()
    every = every.withColumn("_iy", F.explode(F.sequence(F.lit(0), F.lit(ny)).cast("array<long>"))).withColumn("_ix", F.explode(F.sequence(F.lit(0), F.lit(nx)).cast("array<long>")))
    held = every.join(cells, ["_t", "_ix", "_iy"], "left").withColumn("_v", F.coalesce("_v", F.lit(0.0)))
    along = Window.partitionBy("_t", "_iy").orderBy("_ix").rowsBetween(Window.unboundedPreceding, 0)  # a row of the grid
    up = Window.partitionBy("_t", "_ix").orderBy("_iy").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("_v", F.sum("_v").over(along)).withColumn("_v", F.sum("_v").over(up))
    return held.select(F.col("_t").alias(time), (F.col("_iy") * (nx + 1) + F.col("_ix")).alias("source"), F.col("_v").alias("value"))


def corner_mapping(targets: DataFrame, grid: Grid, mode: str = "mean", least_coverage: float = 1 - 1e-6) -> DataFrame:
    """(target_id, source, weight) from corners to rectangles (target_id, xmin, xmax, ymin, ymax), 16 rows each at most.

    The weighted sum of a frame's corners is the integral over the rectangle, divided by its area on the grid for ``mean``.
    A target of which less than ``least_coverage`` lies on the grid is an error.
    """
    x, y = grid.x, grid.y
    on = lambda c, axis: F.least(F.greatest(F.col(c), F.lit(float(axis.low))), F.lit(float(axis.high)))
    held = targets.select("target_id", on("xmin", x).alias("_x0"), on("xmax", x).alias("_x1"), on("ymin", y).alias("_y0"), on("ymax", y).alias("_y1"), ((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).alias("_whole"))
    bad = F.raise_error(F.concat(F.lit("a target is not wholly on the grid: "), F.col("target_id").cast("string"))).cast("double")
    plane = (F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0")) / F.col("_whole")
    area = grid.area(F.col("_x0"), F.col("_x1"), F.col("_y0"), F.col("_y1")) if mode == "mean" else F.lit(1.0)
    held = held.withColumn("_area", F.when(plane >= least_coverage, area).otherwise(bad))

    def place(c: str, axis, sine: bool) -> tuple[Column, Column]:
        """The cell that a coordinate lies in, and the share of the cell's extent below it."""
        i = F.least(F.greatest(F.floor((F.col(c) - axis.low) / axis.width), F.lit(0)), F.lit(axis.n - 1)).cast("long")
        low, high = axis.edges(i)
        f = (lambda v: F.sin(F.radians(v))) if sine else (lambda v: v)
        return i, (f(F.col(c)) - f(low)) / (f(high) - f(low))

    parts = []
    for cx, sx in (("_x0", -1), ("_x1", 1)):
        for cy, sy in (("_y0", -1), ("_y1", 1)):
            (ix, fx), (iy, fy) = place(cx, x, False), place(cy, y, grid.geographic)
            for dx in (0, 1):
                for dy in (0, 1):
                    weight = sx * sy * (fx if dx else 1 - fx) * (fy if dy else 1 - fy)
                    parts.append(F.struct(((iy + dy) * (x.n + 1) + ix + dx).alias("source"), weight.alias("weight")))
    out = held.withColumn("_p", F.explode(F.array(*parts))).groupBy("target_id", F.col("_p.source").alias("source"), "_area").agg(F.sum("_p.weight").alias("_w"))
    return out.where("_w <> 0").select("target_id", "source", (F.col("_w") / F.col("_area")).alias("weight"))


def rectangle_sums(frames: DataFrame, targets: DataFrame, grid: Grid, time: str, source: str, value: str, mode: str = "mean") -> DataFrame:
    """(time, target_id, value): what ``apply_mapping`` gives with the mapping of ``rectangle_overlap``, without a row for each cell and target."""
    if mode not in ("mean", "sum"):
        raise ValueError("mode is mean or sum")
    if grid.geographic and max(abs(grid.y.low), abs(grid.y.high)) > 90 + 1e-9 or not math.isfinite(grid.x.width):
        raise ValueError("latitudes are from -90 to 90")
    return apply_mapping(corners(frames, grid, time, source, value), corner_mapping(targets, grid, mode), time, "source", "value")
