"""Scans of (time, point, value) sources in one call: range, units, missing values, clipping, time aggregation."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lookup import IntegrityError, require_unique
from ..operators.resample import increments, time_aggregated, values_or_zero
from ..plans.temporal import micros

#: Names of axes, in order of preference.
X_NAMES, Y_NAMES, TIME_NAMES = ("lon", "longitude", "long", "x"), ("lat", "latitude", "y"), ("time", "valid_time")


def found_name(columns: list[str], names: tuple[str, ...]) -> str:
    """The first of ``names`` among the columns, else the first column that is one of them but for its case."""
    for name in names:
        if name in columns:
            return name
    for column in columns:
        if column.lower() in names:
            return column
    raise IntegrityError(f"none of {names} is a column")


def in_range(time: Column, start: datetime, end: datetime, step: timedelta, width: timedelta | None = None) -> Column:
    """From start to end, both included; for blocks of ``width``, up to the end of the last block. Times must be steps."""
    until = end + (width or timedelta(0))
    inside = (time >= F.lit(start).cast("timestamp_ntz")) & ((time < F.lit(until).cast("timestamp_ntz")) if width else (time <= F.lit(until).cast("timestamp_ntz")))
    since = micros(time) - micros(F.lit(start).cast("timestamp_ntz"))
    return inside & F.when(inside & (since % (step // timedelta(microseconds=1)) != 0), F.raise_error(F.lit("a time is not on the step grid")).cast("boolean")).otherwise(F.lit(True))


def scan(source: DataFrame, points: list[str], time: str, value: str, start: datetime, end: datetime, step: timedelta, factor: float = 1.0, clip: bool = False, how: str | None = None, width: timedelta | None = None, accumulated: bool = False) -> DataFrame:
    """(points, time, value) of the steps from start to end, both included.

    NaN and null count as 0; values are divided by ``factor``; ``clip`` makes negatives 0. ``how`` (mean, max, min, sum) over
    blocks of ``width`` gives a row a block, at its start, and covers the whole last block. ``accumulated``: values are totals
    of the day so far, stamped at the end of their step; their increments are scanned, at the beginning of their step.
    """
    rows = source.select(*points, F.col(time).cast("timestamp_ntz").alias("time"), F.col(value).cast("double").alias("value"))
    if accumulated:
        rows = increments(rows, points, "time", "value", step, clip=clip).select(*points, F.timestamp_add("MICROSECOND", F.lit(-(step // timedelta(microseconds=1))), F.col("time")).cast("timestamp_ntz").alias("time"), F.col("increment").alias("value"))
    rows = rows.where(in_range(F.col("time"), start, end, step, width if how else None)).withColumn("value", values_or_zero(F.col("value"), clip))
    if how is None:
        return rows.withColumn("value", F.col("value") / factor)
    out = time_aggregated(rows, points, "time", "value", start, width, {"value": how}, factor)
    at = F.timestamp_add("MICROSECOND", F.col("block") * (width // timedelta(microseconds=1)), F.lit(start).cast("timestamp_ntz"))
    return out.select(*points, at.cast("timestamp_ntz").alias("time"), "value")


def require_shape(df: DataFrame, time: str, point: str, value: str) -> DataFrame:
    """A (time, point, value) table: no further columns, each pair once, every point at every time."""
    if extra := set(df.columns) - {time, point, value}:
        raise IntegrityError(f"columns besides {time}, {point} and {value}: {sorted(extra)}")
    require_unique(df, time, point)
    rows, times, points = df.agg(F.count("*"), F.count_distinct(time), F.count_distinct(point)).first()
    if rows != times * points:
        raise IntegrityError(f"{rows} rows are not {times} times x {points} points")
    return df


def map_shape(metadata: DataFrame) -> DataFrame:
    """(nx, ny) of (kind, name, position, value) rows; kind is attribute, variable or dimension.

    In order: attributes nx and ny, variables nx and ny, the variable map_shape, the attribute map_shape, then dimensions nx and
    ny, x and y, lon and lat. A pair counts only if both are there; none at all is an error.
    """
    one = lambda kind, name, position=0: F.max(F.when((F.col("kind") == kind) & (F.col("name") == name) & (F.col("position") == position), F.col("value")))
    pairs = [(one("attribute", "nx"), one("attribute", "ny")), (one("variable", "nx"), one("variable", "ny"))]
    pairs += [(one(kind, "map_shape"), one(kind, "map_shape", 1)) for kind in ("variable", "attribute")]
    pairs += [(one("dimension", a), one("dimension", b)) for a, b in (("nx", "ny"), ("x", "y"), ("lon", "lat"))]
    shape = F.coalesce(*[F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("nx"), b.alias("ny"))) for a, b in pairs])
    found = metadata.agg(shape.alias("s"))
    bad = F.raise_error(F.lit("no shape in attributes, variables or dimensions"))
    return found.select(*[F.when(F.col("s").isNull(), bad.cast("long")).otherwise(F.col(f"s.{c}")).cast("long").alias(c) for c in ("nx", "ny")])


def not_increasing(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value is not above the one before (in ``order``, within ``by``), with ``before``."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("before", before).where(F.col(value) <= F.col("before"))


def not_following(df: DataFrame, by: list[str], step: str) -> DataFrame:
    """Rows whose step is not the one after the step before: late, skipped or repeated."""
    before = F.lag(step).over(Window.partitionBy(*by).orderBy(step))
    return df.withColumn("before", before).where(F.col(step) != F.col("before") + 1)


def wide(sources: dict[str, DataFrame], on: list[str], value: str = "value") -> DataFrame:
    """(on, a column per source): variables of the same times and points side by side; each pair may occur once in each."""
    out = None
    for name, df in sources.items():
        one = require_unique(df, *on).select(*on, F.col(value).alias(name))
        out = one if out is None else out.join(one, on)
    return out


def axes(df: DataFrame, *columns: str) -> DataFrame:
    """The distinct coordinates."""
    return df.select(*columns).distinct()


def level(df: DataFrame, array: str, at: int, name: str = "value") -> DataFrame:
    """``df`` with one level of an array column; a level that a row lacks is an error."""
    short = F.raise_error(F.concat(F.lit(f"no level {at} in "), F.size(array).cast("string"))).cast("double")
    return df.withColumn(name, F.when(F.size(array) > at, F.get(array, F.lit(at)).cast("double")).otherwise(short)).drop(array)


def levels(df: DataFrame, array: str, value: str = "value") -> DataFrame:
    """A row a level: ``df`` with ``level`` and ``value``."""
    kept = [c for c in df.columns if c != array]
    return df.select(*kept, F.posexplode(array).alias("level", value)).withColumns({"level": F.col("level").cast("long"), value: F.col(value).cast("double")})
