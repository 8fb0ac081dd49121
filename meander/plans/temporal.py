"""Time windows and schedules, compiled to grouping-key columns.

Times are TIMESTAMP_NTZ. A window rule adds the start of the window that holds
each time; nothing is looked up per row except for explicit windows, which are
joined as a small table.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import scratch

EPOCH = datetime(1970, 1, 1)
_WINDOW = "struct<name: string, start: timestamp_ntz, end: timestamp_ntz>"
#: Explicit windows up to which they are sent to every task.
MOST_BROADCAST = 10_000


def micros(t: Column) -> Column:
    """Whole microseconds since 1970, exact."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), t.cast("timestamp_ntz"))


def at_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us.cast("long"), F.lit(EPOCH).cast("timestamp_ntz")).cast("timestamp_ntz")


@dataclass(frozen=True)
class EveryStep:
    """Each time is a window of its own."""

    def start(self, t: Column) -> Column:
        return t.cast("timestamp_ntz")


@dataclass(frozen=True)
class CalendarWindow:
    """Days, months or years; a year may begin at any month and day that every year has."""

    unit: str
    start_month: int = 1
    start_day: int = 1

    def __post_init__(self):
        if self.unit not in ("day", "month", "year"):
            raise ValueError(f"unknown calendar unit {self.unit}")
        if (self.start_month, self.start_day) != (1, 1) and self.unit != "year":
            raise ValueError("only years may begin elsewhere")
        datetime(2001, self.start_month, self.start_day)  # must exist in every year

    def start(self, t: Column) -> Column:
        if self.unit != "year" or (self.start_month, self.start_day) == (1, 1):
            return F.date_trunc(self.unit, t).cast("timestamp_ntz")
        late = F.struct(F.month(t), F.day(t)) >= F.struct(F.lit(self.start_month), F.lit(self.start_day))
        year = F.year(t) - F.when(late, 0).otherwise(1)
        return F.make_date(year, F.lit(self.start_month), F.lit(self.start_day)).cast("timestamp_ntz")

    def end(self, start: Column) -> Column:
        return F.timestamp_add(self.unit.upper(), F.lit(1), start).cast("timestamp_ntz")


@dataclass(frozen=True)
class IntervalWindow:
    """Equal intervals aligned to 1970 (or to ``origin``)."""

    width: timedelta
    origin: datetime = EPOCH

    def __post_init__(self):
        if self.width < timedelta(microseconds=1):
            raise ValueError("a window needs a positive width")

    @property
    def us(self) -> int:
        return self.width // timedelta(microseconds=1)

    def start(self, t: Column) -> Column:
        since = micros(t) - (self.origin - EPOCH) // timedelta(microseconds=1)
        return at_micros(micros(t) - F.pmod(since, F.lit(self.us)))

    def end(self, start: Column) -> Column:
        return at_micros(micros(start) + self.us)


@dataclass(frozen=True)
class ExplicitWindows:
    """Named half-open windows that don't overlap; times in the gaps are dropped."""

    windows: tuple[tuple[str, datetime, datetime], ...]

    def __post_init__(self):
        if len({n for n, _, _ in self.windows}) < len(self.windows):
            raise ValueError("window names repeat")
        for (_, a, b), (_, c, _) in zip(self.windows, (*self.windows[1:], ("", datetime.max, None))):
            if not a < b <= c:
                raise ValueError("windows must be ordered, not empty and not overlapping")

    def attach(self, df: DataFrame, time: str, name: str = "window", start: str = "window_start") -> DataFrame:
        table = df.sparkSession.createDataFrame(list(self.windows), "_n string, _s timestamp_ntz, _e timestamp_ntz")
        if len(self.windows) > MOST_BROADCAST:
            return attach_windows(df, time, table.toDF("name", "start", "end"), name, start)
        table = F.broadcast(table)
        joined = df.join(table, (F.col(time) >= F.col("_s")) & (F.col(time) < F.col("_e")))  # a parameter's rows
        return joined.withColumn(name, F.col("_n")).withColumn(start, F.col("_s")).drop("_n", "_s", "_e")


def attach_windows(df: DataFrame, time: str, windows: DataFrame, name: str = "window", start: str = "window_start") -> DataFrame:
    """``df`` with the window (name, start, end) that holds each time, of a table of any size; rows in no window are dropped.

    Windows must not overlap (``overlapping`` finds those that do): so a time can only be in the one that began last. Rows and
    window starts are sorted together by ranges that follow the data, the last start is carried along within each range and
    from range to range, and the ends are checked. Nothing is compared pair by pair, whatever the lengths and densities.
    """
    own = df.select(F.struct("*").alias("_row"), F.col(time).cast("timestamp_ntz").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(_WINDOW).alias("_w"))
    starts = windows.select(F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), F.col("start").alias("_t"), F.lit(0).alias("_kind"), F.struct(F.col("name").cast("string").alias("name"), F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end")).alias("_w"))
    both = own.where(F.col("_t").isNotNull()).unionByName(starts.where("start < end"))
    order = ["_t", "_kind", "_tie"]  # a window holds its start
    both = both.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order)
    both = scratch.saved(both.withColumn("_part", F.spark_partition_id()), "windows")
    along = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.groupBy("_part").agg(F.max_by("_w", F.when(F.col("_w").isNotNull(), F.struct(*order))).alias("_w"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    carried = carried.select("_part", F.last("_w", ignorenulls=True).over(before).alias("_c"))
    held = both.withColumn("_l", F.last("_w", ignorenulls=True).over(along)).where("_kind = 1").join(F.broadcast(carried), "_part")
    held = held.withColumn("_l", F.coalesce("_l", "_c")).where("_t < _l.end")
    return held.select("_row.*", F.col("_l.name").alias(name), F.col("_l.start").alias(start))


def overlapping(windows: DataFrame) -> DataFrame:
    """The windows (name, start, end) that begin before an earlier one has ended, and those that are empty."""
    ends = windows.select(F.col("name"), F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"))
    sorted_ = ends.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("start", "_tie").withColumn("_part", F.spark_partition_id())
    sorted_ = scratch.saved(sorted_, "windows")
    before = Window.partitionBy("_part").orderBy("start", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    parts = sorted_.groupBy("_part").agg(F.max("end").alias("_e"))
    parts = parts.select("_part", F.max("_e").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_e"))  # a row a task
    late = F.greatest(F.max("end").over(before), F.col("_e")) > F.col("start")
    held = sorted_.join(F.broadcast(parts), "_part").withColumn("_late", F.coalesce(late, F.lit(False)) | (F.col("start") >= F.col("end")))
    return held.where("_late").select("name", "start", "end")


def check_nested(inner, outer) -> None:
    """An inner window must lie inside one outer window."""
    order = {"day": 0, "month": 1, "year": 2}
    if isinstance(inner, CalendarWindow) and isinstance(outer, CalendarWindow):
        if order[inner.unit] > order[outer.unit] or (inner.unit == outer.unit and inner != outer) or (inner.unit == "month" and outer.start_day != 1):
            raise ValueError(f"{inner} does not nest in {outer}")
    elif isinstance(inner, IntervalWindow) and isinstance(outer, IntervalWindow):
        if outer.us % inner.us or (outer.origin - inner.origin) % inner.width:
            raise ValueError(f"{inner} does not nest in {outer}")
    elif isinstance(inner, IntervalWindow) and isinstance(outer, CalendarWindow):
        if timedelta(days=1) % inner.width or (inner.origin - EPOCH) % inner.width:
            raise ValueError(f"{inner} does not nest in {outer}")
    elif isinstance(inner, CalendarWindow) and isinstance(outer, IntervalWindow):
        if inner.unit != "day" or outer.width % timedelta(days=1) or (outer.origin - EPOCH) % timedelta(days=1):
            raise ValueError(f"{inner} does not nest in {outer}")


@dataclass(frozen=True)
class Schedule:
    """Steps of equal length from ``start``; the last one is cut at ``end``."""

    start: datetime
    end: datetime
    step: timedelta

    def __post_init__(self):
        if not self.start < self.end or self.step <= timedelta(0):
            raise ValueError("a schedule needs a positive extent and step")

    def __len__(self) -> int:
        return -((self.start - self.end) // self.step)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(step, start, end)."""
        us = self.step // timedelta(microseconds=1)
        first = (self.start - EPOCH) // timedelta(microseconds=1)
        steps = spark.range(len(self)).withColumnRenamed("id", "step")
        return steps.select("step", at_micros(F.lit(first) + F.col("step") * us).alias("start"), F.least(at_micros(F.lit(first) + (F.col("step") + 1) * us), F.lit(self.end).cast("timestamp_ntz")).alias("end"))

    def index_at(self, t: datetime) -> int:
        """The step that begins at ``t`` exactly."""
        n, rest = divmod(t - self.start, self.step)
        if rest or not 0 <= n < len(self):
            raise ValueError(f"{t} begins no step")
        return n

    def step_at(self, t: Column) -> Column:
        """The step that holds a time, null outside."""
        since = micros(t) - (self.start - EPOCH) // timedelta(microseconds=1)
        us = self.step // timedelta(microseconds=1)
        inside = (t >= F.lit(self.start).cast("timestamp_ntz")) & (t < F.lit(self.end).cast("timestamp_ntz"))
        return F.when(inside, ((since - F.pmod(since, F.lit(us))) / us).cast("long"))


def with_spin_up(steps: DataFrame, until_step: int, cycles: int) -> DataFrame:
    """Steps 0 to ``until_step`` (inclusive) ``cycles`` times before the main period: adds phase, cycle, slot."""
    again = steps.where(F.col("step") <= until_step).withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))) if cycles else F.lit(0)).withColumn("phase", F.lit("spin_up"))
    if not cycles:
        again = again.limit(0)
    main = steps.withColumn("cycle", F.lit(cycles)).withColumn("phase", F.lit("main"))
    slot = F.when(F.col("phase") == "spin_up", F.col("cycle") * (until_step + 1) + F.col("step")).otherwise(F.lit(cycles * (until_step + 1)) + F.col("step"))
    return again.unionByName(main).withColumn("slot", slot.cast("long"))


def timeline_problems(df: DataFrame, time: str, schedule: Schedule) -> DataFrame:
    """(time, problem): repeated and missing steps of a source against its schedule."""
    seen = df.groupBy(F.col(time).alias("time")).count()
    repeated = seen.where("count > 1").select("time", F.lit("duplicate").alias("problem"))
    missing = schedule.frame(df.sparkSession).select(F.col("start").alias("time")).join(seen.select("time"), "time", "left_anti").withColumn("problem", F.lit("missing"))
    return repeated.unionByName(missing)


def source_interval(df: DataFrame, time: str) -> DataFrame:
    """(interval_us, regular): the smallest step between distinct times, and whether all are multiples of it.

    Times are dealt by ranges of days before they are compared, so the window is not one task's.
    """
    times = df.select(F.col(time).alias("t")).distinct().withColumn("us", micros(F.col("t")))
    part = times.withColumn("block", F.date_trunc("month", "t"))
    inner = part.withColumn("gap", F.lead("us").over(Window.partitionBy("block").orderBy("us")) - F.col("us"))
    edges = part.groupBy("block").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))  # a row a month
    across = edges.select((F.lead("lo").over(Window.orderBy("block")) - F.col("hi")).alias("gap"))
    gaps = inner.select("gap").unionByName(across).where("gap > 0")
    least = gaps.agg(F.min("gap")).first()[0]
    return gaps.groupBy(F.lit(least).cast("long").alias("interval_us")).agg(F.min(F.col("gap") % least == 0).alias("regular"))


def crossing(steps: DataFrame, rule) -> DataFrame:
    """The steps (start, end) that straddle a window's border."""
    last = F.timestamp_add("MICROSECOND", F.lit(-1), F.col("end")).cast("timestamp_ntz")
    return steps.where(rule.start(F.col("start")) != rule.start(last))


def schedule_problems(steps: DataFrame) -> DataFrame:
    """(step, problem) of an explicit schedule (step, start, end): ``index`` not following, ``empty``, or ``overlap`` with the step before; gaps are allowed."""
    part = F.floor(F.col("step") / 1_000_000)  # so that no window is the whole schedule's
    edge = steps.where(F.col("step") % 1_000_000 == 999_999).select((part + 1).alias("_part"), F.col("step").alias("_s"), F.col("end").alias("_e"))
    order = Window.partitionBy("_part").orderBy("step", "start")
    held = steps.withColumn("_part", part).join(edge, "_part", "left")
    before_step, before_end = F.coalesce(F.lag("step").over(order), F.col("_s")), F.coalesce(F.lag("end").over(order), F.col("_e"))
    held = held.withColumns({"_bs": before_step, "_be": before_end})
    follows = F.when(F.col("_bs").isNull(), F.col("step") == 0).otherwise(F.col("step") == F.col("_bs") + 1)
    problem = F.when(~follows, "index").when(F.col("start") >= F.col("end"), "empty").when(F.col("start") < F.col("_be"), "overlap")
    return held.select("step", problem.alias("problem")).where("problem IS NOT NULL")


@dataclass(frozen=True)
class Contract:
    """What a source says of its times."""

    start: datetime
    interval: timedelta
    count: int
    calendar: str = "standard"
    position: str = "start"

    @classmethod
    def of(cls, df: DataFrame, time: str, **options) -> Contract:
        """The contract that a source's distinct times keep; a gap is an error."""
        low, high, n = df.agg(F.min(time), F.max(time), F.count_distinct(time)).first()
        interval = (high - low) / (n - 1) if n > 1 else timedelta(0)
        uneven = df.select(micros(F.col(time)).alias("us")).where((F.col("us") - F.lit((low - EPOCH) // timedelta(microseconds=1))) % max(1, interval // timedelta(microseconds=1)) != 0)
        if n > 1 and uneven.limit(1).count():
            raise ValueError(f"{time} has gaps or uneven steps")
        return cls(low, interval, n, **options)


def agreed(contracts: dict[str, Contract]) -> Contract:
    """The contract that all sources share; the first difference is an error."""
    if not contracts:
        raise ValueError("no contracts")
    (name, first), *others = contracts.items()
    for other, contract in others:
        for attribute in ("calendar", "start", "interval", "count", "position"):
            if getattr(contract, attribute) != getattr(first, attribute):
                raise ValueError(f"{name} and {other} differ in {attribute}")
    return first


def step_counts(start: datetime, end: datetime, interval: timedelta, spin_up: tuple[datetime, datetime, int] | None = None) -> tuple[int, int, int]:
    """(main, spin-up, all) steps; both ends of a period are steps. spin_up: first and last step of a cycle, and cycles."""

    def inclusive(a: datetime, b: datetime) -> int:
        n, rest = divmod(b - a, interval)
        if rest or n < 0:
            raise ValueError(f"{a} to {b} is not whole steps of {interval}")
        return n + 1

    main = inclusive(start, end)
    again = inclusive(*spin_up[:2]) * spin_up[2] if spin_up and spin_up[2] > 0 else 0
    return main, again, again + main


def after_spin_up(df: DataFrame, step: str, first: int) -> DataFrame:
    """Output from step ``first`` on, counted anew from 0; earlier steps ran, but have no output."""
    return df.where(F.col(step) >= first).withColumn(step, F.col(step) - first)
