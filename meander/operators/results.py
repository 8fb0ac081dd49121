"""Reading results: vectors, grids and series of (time, point_id, value) tables kept by rank and year."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from .lookup import IntegrityError, require_unique


class Results:
    """Named results, each a sequence of tables with a time index; what is put is written at once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def put(self, name: str, df: DataFrame) -> int:
        """Adds a result; returns its time index."""
        self.held.setdefault(name, []).append(scratch.saved(df, "result"))
        return len(self.held[name]) - 1

    def names(self) -> list[str]:
        return sorted(self.held)

    def one_by_one(self, name: str) -> list[DataFrame]:
        if name not in self.held:
            raise IntegrityError(f"no result {name}; there are {self.names()}")
        return list(self.held[name])

    def get(self, name: str) -> DataFrame:
        """All tables of a result as one, with ``time_index``."""
        parts = [df.withColumn("time_index", F.lit(k).cast("long")) for k, df in enumerate(self.one_by_one(name))]
        if not parts:
            raise IntegrityError(f"{name} is empty")
        return reduce(DataFrame.unionByName, parts)

    def pop(self, name: str) -> DataFrame:
        """Removes and returns the newest table."""
        if not self.one_by_one(name):
            raise IntegrityError(f"no finished result of {name}")
        return self.held[name].pop()

    def reset(self) -> None:
        """Empties all results; their names stay."""
        self.held = {name: [] for name in self.held}


def in_time_range(df: DataFrame, time: str, start, end) -> DataFrame:
    """Times from start to end, both included; a range that the table doesn't cover or that is empty is an error."""
    low, high = df.agg(F.min(time), F.max(time)).first()
    if low is None or start > end or start < low or end > high:
        raise IntegrityError(f"the range {start} to {end} is not within {low} to {high}")
    return df.where(F.col(time).between(F.lit(start), F.lit(end)))


def vector(df: DataFrame, time: str, at) -> DataFrame:
    return df.where(F.col(time) == F.lit(at))


def unravelled(df: DataFrame, point: str, ny: int) -> DataFrame:
    """Adds x and y of ids counted as x * ny + y."""
    return df.withColumns({"x": F.expr(f"`{point}` div {ny}"), "y": F.col(point) % ny})


def grid(df: DataFrame, point: str, value: str, nx: int, ny: int, fill: float) -> DataFrame:
    """(x, y, value): the dense grid of one time, ``fill`` where no point is."""
    cells = df.sparkSession.range(nx * ny).withColumnRenamed("id", point)
    return unravelled(cells.join(df.select(point, value), point, "left"), point, ny).select("x", "y", F.coalesce(value, F.lit(fill)).alias("value"))


def converted(df: DataFrame, point: str, converter: Callable[[Column], tuple[Column, Column]]) -> DataFrame:
    """``df`` with x and y, which the caller's converter makes of the point: two integer expressions, or an error; null ones stop the query."""
    x, y = converter(F.col(point))
    out = df.withColumns({"x": x, "y": y})
    if wrong := [c for c in ("x", "y") if out.schema[c].dataType.typeName() not in ("byte", "short", "integer", "long")]:
        raise TypeError(f"a converter gives integers, not {[(c, out.schema[c].dataType.simpleString()) for c in wrong]}")
    bad = F.raise_error(F.concat(F.lit("the converter has no place for "), F.coalesce(F.col(point).cast("string"), F.lit("null"))))
    return out.withColumns({c: F.coalesce(F.col(c), bad.cast(out.schema[c].dataType)) for c in ("x", "y")})


def series(df: DataFrame, point: str, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted points (position, point), with their position; repeated or unknown points are errors."""
    require_unique(wanted, point)
    if found := wanted.join(df.select(point).distinct(), point, "left_anti").limit(5).collect():
        raise IntegrityError(f"unknown points {[r[point] for r in found]}")
    return df.join(wanted.select("position", point), point)


def quantiles(df: DataFrame, points: list[str], value: str, levels: list[float]) -> DataFrame:
    """(points, level, value): exact, linear between samples."""
    found = df.groupBy(*points).agg(F.percentile(value, F.array(*map(F.lit, levels))).alias("_q"))
    table = F.arrays_zip(F.array(*map(F.lit, levels)).alias("level"), F.col("_q").alias("value"))
    return found.select(*points, F.inline(table).alias("level", "value"))


def bounding_box(df: DataFrame, x: str, y: str, value: str, pad: int, nx: int, ny: int) -> DataFrame:
    """(x0, x1, y0, y1) of the cells with a value, padded and kept on the grid."""
    real = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return real.agg(F.greatest(F.min(x) - pad, F.lit(0)).alias("x0"), F.least(F.max(x) + pad, F.lit(nx - 1)).alias("x1"), F.greatest(F.min(y) - pad, F.lit(0)).alias("y0"), F.least(F.max(y) + pad, F.lit(ny - 1)).alias("y1"))


def all_coordinates(ranks: list[DataFrame], point: str, ny: int) -> DataFrame:
    """(x, y) of the points of all ranks; a point that two ranks have is an error."""
    points = require_unique(reduce(DataFrame.unionByName, [df.select(point).distinct() for df in ranks]), point)
    return unravelled(points, point, ny).select("x", "y")
