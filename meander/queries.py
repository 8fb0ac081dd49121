"""One query per operator over the driver's tables, each with the DuckDB SQL of the same result.

Doubles are rounded on both sides, since sums are taken in other orders; where results can end in an exact half
of the last digit, a ten-millionth is added first.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import calendars, digests, expressions, names
from .operators import lookup, mapping, overlay, parameters, resample, results, statistics
from .plans.temporal import CalendarWindow, Contract, ExplicitWindows, IntervalWindow, Schedule, after_spin_up, agreed, crossing, micros, schedule_problems, source_interval, step_counts, timeline_problems, with_spin_up
from .sources import scan, scratch, tables
from .streaming import substeps

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DAY, MONTH, YEAR, WATER_YEAR = CalendarWindow("day"), CalendarWindow("month"), CalendarWindow("year"), CalendarWindow("year", 10, 1)
START, END = datetime(2024, 1, 1), datetime(2024, 1, 31)
HOURS = lambda n: timedelta(hours=n)


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _round(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


def _events(spark, sf) -> DataFrame:
    return _t(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


# --- two-level aggregation ---------------------------------------------------------------------------------------------

_KINDS = ("mean", "sum", "max", "min", "first", "last")
_INNER_SQL = {"mean": "avg(value)", "sum": "sum(value)", "max": "max(value)", "min": "min(value)", "first": "min_by(value, ts)", "last": "max_by(value, ts)"}
_OUTER_SQL = {"mean": "avg({0})", "sum": "sum({0})", "max": "max({0})", "min": "min({0})", "first": "min_by({0}, i)", "last": "max_by({0}, i)"}
_5DAYS_SQL = "time_bucket(INTERVAL 5 DAY, ts, TIMESTAMP '1970-01-01')"


def _inner_sql(inner: str = "date_trunc('day', ts)", outer: str = _5DAYS_SQL, kinds=_KINDS) -> str:
    return f"SELECT user_id, CAST({outer} AS TIMESTAMP) AS outer_start, CAST({inner} AS TIMESTAMP) AS i, {', '.join(f'{_INNER_SQL[k]} AS {k}_' for k in kinds)} FROM events GROUP BY ALL"


_FIVE = IntervalWindow(timedelta(days=5))


@query("e1_single_level", f"SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS inner_start, {', '.join(f'round({_INNER_SQL[k]}, 6) AS {k}' for k in _KINDS)}, list_extract(list(value ORDER BY ts, value), count(*) // 2 + 1) AS mid FROM events GROUP BY ALL")
def _(spark, sf):
    return _round(statistics.inner_windows(_events(spark, sf), ["user_id"], "ts", "value", DAY, statistics.AGGREGATES))


_WEIGHTED_SQL = "SELECT *, coalesce(date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6, 0.0) AS w FROM events"


@query("e1_duration_weighted", f"SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS inner_start, round(CASE WHEN sum(w) <> 0 THEN sum(value * w) / sum(w) END, 6) AS mean, round(sum(value * w), 3) AS sum FROM ({_WEIGHTED_SQL}) GROUP BY ALL")
def _(spark, sf):
    gap = F.coalesce((micros(F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts"))) - micros(F.col("ts"))) / 1e6, F.lit(0.0))
    out = statistics.inner_windows(_events(spark, sf).withColumn("w", gap), ["user_id"], "ts", "value", DAY, ["mean", "sum"], "w")
    return out.withColumns({"mean": F.round("mean", 6), "sum": F.round("sum", 3)})


@query("e2_all_compounds", f"WITH a AS ({_inner_sql()}) SELECT user_id, outer_start, max(i) AS time, count(*) AS n_inner, " + ", ".join(f"round({_OUTER_SQL[o].format(i + '_')}, 6) AS {o}_{i}" for o in _KINDS for i in _KINDS) + " FROM a GROUP BY ALL")
def _(spark, sf):
    return _round(statistics.two_level(_events(spark, sf), ["user_id"], "ts", "value", DAY, _FIVE, [f"{o}_{i}" for o in _KINDS for i in _KINDS]))


@query("e2_max_mean_day_month", f"WITH a AS ({_inner_sql(outer=chr(100) + 'ate_trunc(' + chr(39) + 'month' + chr(39) + ', ts)', kinds=('mean',))}) SELECT user_id, outer_start, max(i) AS time, count(*) AS n_inner, round(max(mean_), 6) AS max_mean FROM a GROUP BY ALL")
def _(spark, sf):
    return _round(statistics.two_level(_events(spark, sf), ["user_id"], "ts", "value", DAY, MONTH, ["max_mean"]))


_RANKED_SQL = f"WITH a AS ({_inner_sql(kinds=('mean', 'last'))}), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, outer_start ORDER BY i) - 1 AS n FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY user_id, outer_start ORDER BY {{0}}, n) - 1 AS k FROM b) SELECT user_id, outer_start, k, {{1}} AS value FROM c WHERE k < 3"


def _best(name: str):
    def run(spark, sf):
        out = statistics.two_level(_events(spark, sf), ["user_id"], "ts", "value", DAY, _FIVE, [name])
        return _round(statistics.ranked(out, ["user_id", "outer_start"], name).withColumn("k", F.col("k").cast("long")))

    return run


for _name, _order, _value in (("max3_mean", "mean_ DESC", "round(mean_, 6)"), ("min3_last", "last_", "round(last_, 6)"), ("argmax3_mean", "mean_ DESC", "n"), ("argmin3_last", "last_", "n")):
    query(f"e{5 if 'arg' in _name else 3}_{_name}", _RANKED_SQL.format(_order, _value))(_best(_name))


@query("e4_arg", f"WITH a AS ({_inner_sql(kinds=('mean', 'max'))}), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, outer_start ORDER BY i) - 1 AS n FROM a) SELECT user_id, outer_start, max(i) AS time, count(*) AS n_inner, CAST(min_by(n, (-mean_, n)) AS BIGINT) AS argmax_mean, CAST(min_by(n, (max_, n)) AS BIGINT) AS argmin_max FROM b GROUP BY ALL")
def _(spark, sf):
    return statistics.two_level(_events(spark, sf), ["user_id"], "ts", "value", DAY, _FIVE, ["argmax_mean", "argmin_max"])


@query("d26_arg_time", f"WITH a AS ({_inner_sql(kinds=('mean',))}) SELECT user_id, outer_start, min_by(i, (-mean_, i)) AS at FROM a GROUP BY ALL")
def _(spark, sf):
    out = statistics.two_level(_events(spark, sf), ["user_id"], "ts", "value", DAY, _FIVE, ["argmax_mean"])
    order = statistics.ordinals(_events(spark, sf), ["user_id"], "ts", DAY, _FIVE)
    return statistics.arg_times(out, order, ["user_id"], "argmax_mean").select("user_id", "outer_start", F.col("time").alias("at"))


@query("e8_scatter_sum", "SELECT n_nationkey, round(coalesce(sum(c_acctbal), 0), 6) AS scatter_sum, round(coalesce(avg(c_acctbal), 0), 6) AS scatter_mean FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def _(spark, sf):
    return _round(statistics.scatter(_t(spark, sf, "customer"), "c_nationkey", F.col("c_acctbal"), _t(spark, sf, "nation"), "n_nationkey"))


@query("e9_scatter_mean_expression", "SELECT s_suppkey, round(coalesce(sum(l_quantity * (1 - l_discount)), 0), 6) AS scatter_sum, round(coalesce(avg(l_quantity * (1 - l_discount)), 0), 6) AS scatter_mean FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL")
def _(spark, sf):
    items = expressions.with_virtual(_t(spark, sf, "lineitem"), {"net": "l_quantity * (1 - l_discount)"})
    return _round(statistics.scatter(items, "l_suppkey", F.col("net"), _t(spark, sf, "supplier"), "s_suppkey"))


@query("e10_time_aggregation", "SELECT user_id, date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS block, round(avg(value) / 10, 6) AS mean, round(max(value) / 10, 6) AS top, round(min(value) / 10, 6) AS low, round(sum(value) / 10, 6) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    methods = {"mean": "mean", "top": "max", "low": "min", "total": "sum"}
    return _round(resample.time_aggregated(_events(spark, sf), ["user_id"], "ts", "value", START, HOURS(24), methods, 10.0))


_DAILY_SQL = "SELECT user_id, date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS step, sum(value) AS v FROM events GROUP BY ALL"


def _daily(spark, sf) -> DataFrame:
    step = F.datediff("ts", F.lit(START.date())).cast("long").alias("step")
    return _events(spark, sf).groupBy("user_id", step).agg(F.sum("value").alias("v"))


@query("e14_quantiles", f"SELECT user_id, level, round(CASE level WHEN 0.0 THEN quantile_cont(v, 0.0) WHEN 0.1 THEN quantile_cont(v, 0.1) WHEN 0.5 THEN quantile_cont(v, 0.5) ELSE quantile_cont(v, 0.9) END, 6) AS value FROM ({_DAILY_SQL}), (SELECT unnest([0.0, 0.1, 0.5, 0.9])::DOUBLE AS level) GROUP BY user_id, level")
def _(spark, sf):
    return _round(results.quantiles(_daily(spark, sf), ["user_id"], "v", [0.0, 0.1, 0.5, 0.9]))


@query("e15_nan_sum", "SELECT event_type, user_id, round(sum(CASE WHEN value > 250 THEN value END), 6) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    x = F.when(F.col("value") > 250, F.col("value")).otherwise(F.lit(float("nan")))
    return _round(_events(spark, sf).groupBy("event_type", "user_id").agg(resample.nan_sum(x).alias("total")))


_RUNS_SQL = f"WITH d AS (SELECT DISTINCT user_id, step FROM ({_DAILY_SQL})), i AS (SELECT *, step - row_number() OVER (PARTITION BY user_id ORDER BY step) AS g FROM d), r AS (SELECT user_id, g, min(step) AS start, count(*) AS length FROM i GROUP BY ALL)"


@query("e16_longest_run", _RUNS_SQL + " SELECT user_id, arg_max(start, (length, -start)) AS start, max(length) AS length FROM r GROUP BY ALL")
def _(spark, sf):
    return resample.longest_runs(_daily(spark, sf), "user_id", "step")


@query("e17_common_spans", _RUNS_SQL + ", u AS (SELECT user_id % 10 AS basin, arg_max(start, (length, -start)) AS start, max(length) AS length FROM r GROUP BY user_id) SELECT basin, max(start) AS shift, CAST(greatest(0, min(start + length) - max(start)) AS BIGINT) AS length FROM u GROUP BY basin")
def _(spark, sf):
    runs = resample.longest_runs(_daily(spark, sf), "user_id", "step").withColumn("basin", F.col("user_id") % 10)
    return resample.common_spans(runs, "basin")


@query("e18_balanced_ranks")
def _(spark, sf):
    return lookup.ranked_groups(_t(spark, sf, "customer"), "c_nationkey", 4)


@query("e19_element_reduce", "SELECT o_custkey, round(max(o_totalprice), 6) AS value FROM orders GROUP BY ALL")
def _(spark, sf):
    return _round(lookup.element_reduced(_t(spark, sf, "orders"), "o_custkey", "o_totalprice", "max"))


@query("e21_duplicates", "SELECT user_id, event_type, count(*) AS count FROM events GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return lookup.duplicates(_t(spark, sf, "events"), "user_id", "event_type")


@query("e23_inner_count", f"WITH a AS ({_inner_sql(kinds=('sum',))}) SELECT user_id, outer_start, count(*) AS n_inner FROM a GROUP BY ALL")
def _(spark, sf):
    return statistics.two_level(_events(spark, sf), ["user_id"], "ts", "value", DAY, _FIVE, ["sum_sum"]).select("user_id", "outer_start", "n_inner")


# --- windows and schedules ---------------------------------------------------------------------------------------------


@query("f1_every_step", "SELECT user_id, ts AS inner_start, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def _(spark, sf):
    from .plans.temporal import EveryStep

    return _round(statistics.inner_windows(_events(spark, sf), ["user_id"], "ts", "value", EveryStep(), ["mean"]))


@query("f2_month", "SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS inner_start, round(sum(o_totalprice), 6) AS sum FROM orders GROUP BY ALL")
def _(spark, sf):
    return _round(statistics.inner_windows(_t(spark, sf, "orders"), ["o_custkey"], "o_orderdate", "o_totalprice", MONTH, ["sum"]))


_WATER_SQL = "make_timestamp(CASE WHEN month(o_orderdate) >= 10 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END, 10, 1, 0, 0, 0.0)"


@query("f3_water_year", f"WITH a AS (SELECT o_custkey, {_WATER_SQL} AS outer_start, date_trunc('month', o_orderdate)::TIMESTAMP AS i, sum(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT o_custkey, outer_start, max(i) AS time, count(*) AS n_inner, round(max(v), 6) AS max_sum FROM a GROUP BY ALL")
def _(spark, sf):
    return _round(statistics.two_level(_t(spark, sf, "orders"), ["o_custkey"], "o_orderdate", "o_totalprice", MONTH, WATER_YEAR, ["max_sum"]))


@query("f4_explicit_windows", "SELECT user_id, CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 'early' ELSE 'late' END AS name, round(sum(value), 6) AS total FROM events WHERE (ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-08') OR (ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-20') GROUP BY ALL")
def _(spark, sf):
    rule = ExplicitWindows((("early", datetime(2024, 1, 3), datetime(2024, 1, 8)), ("late", datetime(2024, 1, 15), datetime(2024, 1, 20))))
    return _round(rule.attach(_events(spark, sf), "ts", "name").groupBy("user_id", "name").agg(F.sum("value").alias("total")))


@query("f5_interval_windows", "SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS inner_start, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def _(spark, sf):
    return _round(statistics.inner_windows(_events(spark, sf), ["user_id"], "ts", "value", IntervalWindow(HOURS(6)), ["mean"]))


@query("f6_partial_period_drop", f"WITH a AS ({_inner_sql(kinds=('mean',))}) SELECT user_id, outer_start, max(i) AS time, count(*) AS n_inner, round(max(mean_), 6) AS max_mean FROM a WHERE outer_start + INTERVAL 5 DAY <= TIMESTAMP '2024-01-28' GROUP BY ALL")
def _(spark, sf):
    return _round(statistics.two_level(_events(spark, sf), ["user_id"], "ts", "value", DAY, _FIVE, ["max_mean"], drop_after=datetime(2024, 1, 28)))


_SCHEDULE_SQL = "SELECT i AS step, TIMESTAMP '2024-01-01' + INTERVAL (i * 7) HOUR AS start, least(TIMESTAMP '2024-01-01' + INTERVAL ((i + 1) * 7) HOUR, TIMESTAMP '2024-01-31') AS \"end\" FROM (SELECT unnest(generate_series(0, 102)) AS i)"
_SEVEN = Schedule(START, END, HOURS(7))


@query("f15_step_at", "SELECT event_id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) // 25200000000 AS step FROM events")
def _(spark, sf):
    return _events(spark, sf).select("event_id", _SEVEN.step_at(F.col("ts")).alias("step"))


@query("f8_ordinals", "SELECT DISTINCT user_id, outer_start, i AS inner_start, dense_rank() OVER (PARTITION BY user_id, outer_start ORDER BY i) - 1 AS ordinal FROM (SELECT user_id, date_trunc('month', ts)::TIMESTAMP AS outer_start, date_trunc('day', ts)::TIMESTAMP AS i FROM events)")
def _(spark, sf):
    return statistics.ordinals(_events(spark, sf), ["user_id"], "ts", DAY, MONTH)


@query("f9_increments", "WITH h AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR AS t, sum(value) AS v FROM events GROUP BY ALL), c AS (SELECT *, sum(v) OVER (PARTITION BY user_id, date_trunc('day', t - INTERVAL 1 HOUR) ORDER BY t) AS total FROM h) SELECT user_id, t, round(v, 6) AS increment FROM c")
def _(spark, sf):
    hours = _events(spark, sf).groupBy("user_id", F.timestamp_add("HOUR", F.lit(1), F.date_trunc("hour", "ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("t")).agg(F.sum("value").alias("v"))
    day = F.date_trunc("day", F.timestamp_add("HOUR", F.lit(-1), F.col("t")))
    totals = hours.withColumn("total", F.sum("v").over(Window.partitionBy("user_id", day).orderBy("t")))
    return _round(resample.increments(totals, ["user_id"], "t", "total", HOURS(1)).select("user_id", "t", "increment"))


@query("f10_shifts", f"WITH d AS ({_DAILY_SQL}), g AS (SELECT DISTINCT user_id, t FROM d, (SELECT unnest(generate_series(0, 29)) AS t)) SELECT g.user_id, g.t AS step, round(coalesce(d.v, 0), 6) AS v FROM g LEFT JOIN d ON d.user_id = g.user_id AND d.step = g.t + g.user_id % 5")
def _(spark, sf):
    daily = _daily(spark, sf)
    shifts = daily.select("user_id", (F.col("user_id") % 5).alias("shift")).distinct()
    return _round(resample.shifted(daily, "user_id", "step", "v", shifts, 30))


@query("f11_sliding_windows", f"SELECT user_id, s AS window_start, round(sum(v), 6) AS total, count(*) AS n FROM ({_DAILY_SQL}), (SELECT unnest(generate_series(0, 23, 3)) AS s) WHERE step >= s AND step < s + 7 GROUP BY ALL")
def _(spark, sf):
    out = resample.sliding(_daily(spark, sf), "step", 30, 7, 3).groupBy("user_id", "window_start").agg(F.sum("v").alias("total"), F.count("*").alias("n"))
    return _round(out)


@query("f17_source_interval", "WITH t AS (SELECT DISTINCT date_trunc('hour', ts) AS t FROM events), g AS (SELECT date_diff('microsecond', t, lead(t) OVER (ORDER BY t)) AS gap FROM t) SELECT min(gap) AS interval_us, bool_and(gap % (SELECT min(gap) FROM g) = 0) AS regular FROM g WHERE gap IS NOT NULL")
def _(spark, sf):
    hours = _events(spark, sf).select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t"))
    return source_interval(hours, "t")


@query("f18_output_time", "SELECT user_id, date_trunc('month', ts)::TIMESTAMP AS outer_start, max(date_trunc('day', ts))::TIMESTAMP AS time FROM events GROUP BY ALL")
def _(spark, sf):
    return statistics.two_level(_events(spark, sf), ["user_id"], "ts", "value", DAY, MONTH, ["last_last"]).select("user_id", "outer_start", "time")


# --- resampling --------------------------------------------------------------------------------------------------------

_SIX_SQL = "SELECT event_type, (date_diff('microsecond', TIMESTAMP '2024-01-01', ts) // 21600000000) AS i, avg(value) AS v FROM events GROUP BY ALL"
_FOUR_STEPS_SQL = "SELECT unnest(generate_series(0, 179)) AS step"


def _six_hours(spark, sf) -> DataFrame:
    rule = IntervalWindow(HOURS(6))
    return _events(spark, sf).groupBy("event_type", rule.start(F.col("ts")).alias("at")).agg(F.avg("value").alias("v"))


def _forcing(kind: str, hours: int = 4, **options):
    def run(spark, sf):
        f = getattr(resample, kind)
        out = f(_six_hours(spark, sf), ["event_type"], "at", "v", START, HOURS(6), Schedule(START, END, HOURS(hours)), **options)
        return out.withColumn("value", F.round(F.col("value") + 1e-7, 6))

    return run


_PART = "(least((step + 1) * 4, (i + 1) * 6) - greatest(step * 4, i * 6))"
query("d8_conservative", f"SELECT event_type, step, CASE WHEN sum({_PART}) = 4 THEN round(sum(v * {_PART}) / sum({_PART}) + 1e-7, 6) END AS value FROM ({_SIX_SQL}), ({_FOUR_STEPS_SQL}) WHERE step * 4 < (i + 1) * 6 AND i * 6 < (step + 1) * 4 GROUP BY ALL")(_forcing("conservative"))
query("d8_conservative_accumulated", f"SELECT event_type, step, round(sum(v * {_PART} / 6.0) / 14400 + 1e-7, 6) AS value FROM ({_SIX_SQL}), ({_FOUR_STEPS_SQL}) WHERE step * 4 < (i + 1) * 6 AND i * 6 < (step + 1) * 4 GROUP BY ALL")(_forcing("conservative", accumulated=True))
query("d9_hold", f"SELECT event_type, step, round(v + 1e-7, 6) AS value FROM ({_SIX_SQL}), (SELECT unnest(generate_series(0, 239)) AS step) WHERE step // 2 = i")(_forcing("hold", 3))
query("d10_linear", f"WITH s AS ({_SIX_SQL}), t AS (SELECT step, (step * 4 + 2) / 6.0 AS m FROM ({_FOUR_STEPS_SQL})) SELECT a.event_type, step, round(CASE WHEN m = floor(m) THEN a.v ELSE a.v * (1 - m + floor(m)) + b.v * (m - floor(m)) END + 1e-7, 6) AS value FROM t JOIN s a ON a.i = floor(m) LEFT JOIN s b ON b.event_type = a.event_type AND b.i = floor(m) + 1 WHERE m = floor(m) OR b.v IS NOT NULL")(_forcing("linear"))

# --- spatial mappings --------------------------------------------------------------------------------------------------

#: A grid of 50 x 40 cells; part p_partkey is cell p_partkey.
_GRID = mapping.Grid(mapping.Axis(0.0, 1.0, 50), mapping.Axis(0.0, 1.0, 40))
_GLOBE = mapping.Grid(mapping.Axis(-180.0, 7.2, 50, 360.0), mapping.Axis(-90.0, 4.5, 40), geographic=True)
_MAP_SQL = "SELECT l_suppkey AS target_id, l_partkey AS source, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL"


def _weights(spark, sf) -> DataFrame:
    return _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("target_id"), F.col("l_partkey").alias("source")).agg(F.sum("l_quantity").alias("weight"))


def _frames(spark, sf) -> DataFrame:
    """(t, source, x): three frames over the parts."""
    return _t(spark, sf, "part").select(F.explode(F.expr("array(0L, 1L, 2L)")).alias("t"), F.col("p_partkey").alias("source"), F.col("p_retailprice").alias("p")).select("t", "source", (F.col("p") * (F.col("t") + 1)).alias("x"))


_FRAMES_SQL = "SELECT CAST(t AS BIGINT) AS t, p_partkey AS source, p_retailprice * (t + 1) AS x FROM part, (SELECT unnest([0, 1, 2]) AS t)"


@query("d7_apply_mapping", f"SELECT t, s_suppkey AS target_id, round(coalesce(sum(weight * x), 0), 4) AS value FROM (SELECT unnest([0, 1, 2])::BIGINT AS t) CROSS JOIN supplier LEFT JOIN ({_MAP_SQL}) m ON m.target_id = s_suppkey LEFT JOIN ({_FRAMES_SQL}) f USING (t, source) GROUP BY ALL")
def _(spark, sf):
    targets = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("target_id"))
    out = mapping.apply_mapping(_frames(spark, sf), _weights(spark, sf), "t", "source", "x", targets)
    return out.withColumn("value", F.round("value", 3))


@query("e11_normalized", f"SELECT target_id, source, round(weight / sum(weight) OVER (PARTITION BY target_id), 6) AS weight FROM ({_MAP_SQL})")
def _(spark, sf):
    return _round(mapping.normalized(_weights(spark, sf)))


@query("e20_coverage", f"SELECT target_id, round(sum(weight), 6) AS coverage FROM ({_MAP_SQL}) GROUP BY ALL")
def _(spark, sf):
    return _round(mapping.coverage(_weights(spark, sf)))


@query("e13_climatology", f"SELECT target_id, round(sum(weight * x) / 3, 3) AS value FROM ({_MAP_SQL}) JOIN ({_FRAMES_SQL}) USING (source) GROUP BY ALL")
def _(spark, sf):
    return statistics.climatology(_frames(spark, sf), _weights(spark, sf), "t", "source", "x").withColumn("value", F.round("value", 3))


def _corner() -> tuple[Column, Column]:
    return F.pmod(F.col("s_suppkey") * 7, F.lit(45)) + F.col("s_suppkey") % 10 / 10, F.pmod(F.col("s_suppkey") * 3, F.lit(35)) + F.col("s_suppkey") % 7 / 8


_RECT_SQL = "SELECT s_suppkey AS target_id, (s_suppkey * 7) % 45 + (s_suppkey % 10) / 10.0::DOUBLE AS x0, (s_suppkey * 3) % 35 + (s_suppkey % 7) / 8.0::DOUBLE AS y0 FROM supplier"


@query("d11_rectangle_overlap", f"WITH c AS (SELECT i, j FROM (SELECT unnest(generate_series(0, 49)) AS i), (SELECT unnest(generate_series(0, 39)) AS j)), o AS (SELECT target_id, j * 50 + i AS source, (least(x0 + 3.3, i + 1) - greatest(x0, i)) * (least(y0 + 2.6, j + 1) - greatest(y0, j)) AS weight FROM ({_RECT_SQL}) JOIN c ON i < x0 + 3.3 AND i + 1 > x0 AND j < y0 + 2.6 AND j + 1 > y0) SELECT target_id, source, round(weight / sum(weight) OVER (PARTITION BY target_id), 6) AS weight FROM o WHERE weight > 1e-9")
def _(spark, sf):
    x, y = _corner()
    targets = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("target_id"), x.alias("xmin"), (x + 3.3).alias("xmax"), y.alias("ymin"), (y + 2.6).alias("ymax"))
    return _round(mapping.rectangle_overlap(targets, _GRID).where("weight > 1e-9").drop("coverage"))


_LON_SQL, _LAT_SQL = "((c_custkey * 37) % 7200) / 10.0 - 360", "((c_custkey * 13) % 1800) / 10.0 - 90"


@query("d13_nearest_cell", f"WITH p AS (SELECT c_custkey, {_LON_SQL} AS lon, {_LAT_SQL} AS lat FROM customer), i AS (SELECT c_custkey, floor((lon - 360 * floor((lon + 180) / 360) + 180) / 7.2) AS ix, floor((lat + 90) / 4.5) AS iy FROM p) SELECT c_custkey, CAST(least(iy, 39) * 50 + ((ix % 50) + 50) % 50 AS BIGINT) AS source FROM i")
def _(spark, sf):
    lon, lat = F.col("c_custkey") * 37 % 7200 / 10 - 360, F.col("c_custkey") * 13 % 1800 / 10 - 90
    points = _t(spark, sf, "customer").select("c_custkey", lon.alias("lon"), lat.alias("lat"))
    return _GLOBE.cells(points, "lon", "lat").select("c_custkey", "source")


@query("d14_pixel_aggregation", "SELECT s_suppkey AS target_id, CAST((l_partkey % 40) * 50 + l_orderkey % 50 AS BIGINT) AS source, round(sum(l_quantity), 6) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0 GROUP BY ALL")
def _(spark, sf):
    pixels = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("pixel_target"), (F.col("l_orderkey") % 50 + 0.5).alias("x"), (F.col("l_partkey") % 40 + 0.5).alias("y"), F.col("l_quantity").alias("area"))
    targets = _t(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("target_id"))
    return _round(mapping.pixel_mapping(pixels, targets, _GRID))


@query("c12_source_mask", f"WITH m AS ({_MAP_SQL}), v AS (SELECT m.*, p_size > 10 AS ok FROM m JOIN part ON p_partkey = source), s AS (SELECT *, sum(weight) OVER (PARTITION BY target_id) AS a, sum(CASE WHEN ok THEN weight END) OVER (PARTITION BY target_id) AS g FROM v) SELECT target_id, source, round(weight * a / g, 6) AS weight FROM s WHERE ok")
def _(spark, sf):
    valid = _t(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("source"))
    return _round(mapping.with_source_mask(_weights(spark, sf), valid, _GRID, "drop"))


@query("d12_nearest_valid_cell", "WITH t AS (SELECT n_nationkey, n_nationkey * 2 AS cx, n_nationkey AS cy FROM nation), v AS (SELECT s AS source, s % 50 AS x, s // 50 AS y FROM (SELECT unnest(generate_series(0, 1999)) AS s) WHERE (s % 50 + 2 * (s // 50)) % 7 = 3), r AS (SELECT n_nationkey, source, row_number() OVER (PARTITION BY n_nationkey ORDER BY greatest(abs(x - cx), abs(y - cy)), (x - cx) ** 2 + (y - cy) ** 2, CASE WHEN abs(y - cy) >= abs(x - cx) THEN CASE WHEN y <= cy THEN 0 ELSE 1 END ELSE CASE WHEN x < cx THEN 2 ELSE 3 END END, CASE WHEN abs(y - cy) >= abs(x - cx) THEN x ELSE y END) AS k FROM t, v) SELECT CAST(n_nationkey AS BIGINT) AS target_id, source FROM r WHERE k = 1")
def _(spark, sf):
    points = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("target_id"), (F.col("n_nationkey") * 2).alias("cx"), F.col("n_nationkey").alias("cy"))
    return mapping.nearest_cells(points, spark.range(2000).where("(id % 50 + 2 * (id div 50)) % 7 = 3").withColumnRenamed("id", "source"), _GRID)


@query("e12_weighted_center", f"SELECT target_id, CAST(round_even(sum(weight * (source % 50)) / sum(weight), 0) AS BIGINT) AS cx, CAST(round_even(sum(weight * (source // 50)) / sum(weight), 0) AS BIGINT) AS cy FROM ({_MAP_SQL}) GROUP BY ALL")
def _(spark, sf):
    return mapping.centers(_weights(spark, sf), _GRID).select("target_id", F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"))


@query("c4_local_mapping", f"SELECT CAST(position AS BIGINT) AS position, target_id, source, weight FROM ({_MAP_SQL}) JOIN (SELECT s_suppkey AS target_id, row_number() OVER (ORDER BY s_suppkey DESC) - 1 AS position FROM supplier WHERE s_acctbal > 8000) USING (target_id) WHERE weight <> 0")
def _(spark, sf):
    wanted = lookup.with_positions(_t(spark, sf, "supplier").where("s_acctbal > 8000").select((-F.col("s_suppkey")).alias("n")), "n").select("position", (-F.col("n")).alias("target_id"))
    return mapping.local(_weights(spark, sf), wanted).select("position", "target_id", "source", "weight")


# --- scans, projections, filters ---------------------------------------------------------------------------------------


@query("a5_multivariable", "SELECT user_id, day, round(click, 6) AS click, round(purchase, 6) AS purchase FROM (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, sum(value) FILTER (event_type = 'click') AS click, sum(value) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY ALL) WHERE click IS NOT NULL AND purchase IS NOT NULL")
def _(spark, sf):
    one = lambda kind: _events(spark, sf).where(F.col("event_type") == kind).groupBy("user_id", DAY.start(F.col("ts")).alias("day")).agg(F.sum("value").alias("value"))
    return _round(scan.wide({"click": one("click"), "purchase": one("purchase")}, ["user_id", "day"]))


@query("a6_catalog_align", "SELECT s_suppkey, s_name, s_nationkey, round(sum(l_quantity), 6) AS quantity FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL")
def _(spark, sf):
    quantity = _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_quantity").alias("quantity"))
    return _round(lookup.aligned(lookup.projected(_t(spark, sf, "supplier"), skip=["s_acctbal"]), [quantity], "s_suppkey"))


_FILES_SQL = "SELECT 'flow_max3_' || k || '_rank' || r || CASE WHEN r % 2 = 0 THEN '_' || (2000 + r) ELSE '' END || '.parquet' AS name, k, r FROM (SELECT unnest([0, 2, 10]) AS k), (SELECT unnest([0, 1, 2]) AS r)"


@query("a16_missing_steps", "SELECT CAST(h AS TIMESTAMP) AS time, 'missing' AS problem FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:50:00', INTERVAL 10 MINUTE)) AS h) WHERE h NOT IN (SELECT time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') FROM events)")
def _(spark, sf):
    ten = timedelta(minutes=10)
    times = _events(spark, sf).select(IntervalWindow(ten).start(F.col("ts")).alias("t")).distinct()
    return timeline_problems(times, "t", Schedule(START, END, ten))


@query("a17_time_keys", "SELECT strftime(o_orderdate, '%Y%m%d') AS by_day, strftime(o_orderdate, '%Y_%m') AS by_month, strftime(o_orderdate, '%Y') AS by_year, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, sf):
    keys = {f"by_{k}": tables.time_key(F.col("o_orderdate"), k) for k in ("day", "month", "year")}
    return _t(spark, sf, "orders").select(*[c.alias(n) for n, c in keys.items()]).groupBy(*keys).agg(F.count("*").alias("n"))


@query("a20_chunk_padding", f"WITH d AS ({_DAILY_SQL}), g AS (SELECT DISTINCT user_id, t FROM d, (SELECT unnest(generate_series(0, 34)) AS t)) SELECT g.user_id, t // 7 AS chunk, t % 7 AS position, round(coalesce(v, 0), 6) AS value, t < 30 AS valid FROM g LEFT JOIN d ON d.user_id = g.user_id AND d.step = t")
def _(spark, sf):
    return _round(resample.chunked(_daily(spark, sf), ["user_id"], "step", "v", 7, 30))


@query("a22_axis", "SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS t, event_type FROM events")
def _(spark, sf):
    return scan.axes(_events(spark, sf).withColumn("t", DAY.start(F.col("ts"))), "t", "event_type")


@query("c1_projection", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, sf):
    return lookup.projected(_t(spark, sf, "orders"), visible=["o_orderkey", "o_custkey", "o_totalprice"])


@query("c2_subset", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(spark, sf):
    wanted = _t(spark, sf, "customer").join(_t(spark, sf, "nation").where("n_regionkey = 1"), F.expr("c_nationkey = n_nationkey")).select("c_custkey")
    return lookup.subset(_t(spark, sf, "customer"), "c_custkey", wanted).select("c_custkey", "c_name")


@query("c5_selection_order", "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS position, s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def _(spark, sf):
    return lookup.with_positions(_t(spark, sf, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_name"), "s_suppkey").select("position", "s_suppkey", "s_name")


@query("c6_time_range", "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'")
def _(spark, sf):
    return results.in_time_range(_events(spark, sf), "ts", datetime(2024, 1, 5), datetime(2024, 1, 6)).select("event_id", "ts")


@query("c8_level_slice", "SELECT vec_id, round(embedding[4]::DOUBLE, 6) AS value FROM embeddings")
def _(spark, sf):
    return _round(scan.level(_t(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 3))


@query("c9_missing_to_zero", "SELECT event_id, CASE WHEN value > 300 THEN 0.0 WHEN value < 100 THEN 0.0 ELSE round(value - 100, 6) END AS value FROM events")
def _(spark, sf):
    x = F.when(F.col("value") > 300, F.lit(float("nan"))).otherwise(F.col("value") - 100)
    return _round(_events(spark, sf).select("event_id", resample.values_or_zero(x, clip_negative=True).alias("value")))


@query("c20_bounding_box", "SELECT greatest(min(p_partkey % 50) - 2, 0) AS x0, least(max(p_partkey % 50) + 2, 49) AS x1, greatest(min(p_partkey // 50) - 2, 0) AS y0, least(max(p_partkey // 50) + 2, 39) AS y1 FROM part WHERE p_retailprice < 920")
def _(spark, sf):
    value = F.when(F.col("p_retailprice") < 920, F.col("p_retailprice")).otherwise(F.lit(float("nan")))
    cells = _t(spark, sf, "part").select((F.col("p_partkey") % 50).alias("x"), F.expr("p_partkey div 50").alias("y"), value.alias("v"))
    return results.bounding_box(cells, "x", "y", "v", 2, 50, 40)


# --- joins and references ----------------------------------------------------------------------------------------------


@query("d1_positions", "SELECT o_orderkey, coalesce(position, -1) AS position FROM orders LEFT JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def _(spark, sf):
    some = lookup.with_positions(_t(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey"), "c_custkey")
    return lookup.positions_of(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", some, "c_custkey").select("o_orderkey", "position")


@query("d2_references", "SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, sf):
    return lookup.referenced(_t(spark, sf, "orders"), "o_custkey", _t(spark, sf, "customer"), "c_custkey", "c_nationkey").select("o_orderkey", "c_nationkey")


@query("d3_inverse_reference", "WITH r AS (SELECT s_nationkey, max(s_suppkey) AS p FROM supplier WHERE s_acctbal > 5000 GROUP BY ALL) SELECT n_nationkey, coalesce(p, -1) AS position FROM nation LEFT JOIN r ON s_nationkey = n_nationkey")
def _(spark, sf):
    rows = _t(spark, sf, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.max("s_suppkey").alias("p"))
    return lookup.inverse_reference(_t(spark, sf, "nation"), "n_nationkey", lookup.require_unique(rows, "s_nationkey"), "s_nationkey", "p")


@query("d5_lineage", "SELECT s_suppkey, n_regionkey AS \"group\" FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, sf):
    return lookup.lineage(_t(spark, sf, "supplier"), [("s_nationkey", _t(spark, sf, "nation"), "n_nationkey", "n_regionkey")]).select("s_suppkey", "group")


@query("d6_group_ranks", "SELECT c_custkey, n_regionkey % 3 AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf):
    groups = lookup.lineage(_t(spark, sf, "customer"), [("c_nationkey", _t(spark, sf, "nation"), "n_nationkey", "n_regionkey")])
    ranks = _t(spark, sf, "region").select(F.col("r_regionkey").alias("group"), (F.col("r_regionkey") % 3).alias("rank"))
    return groups.join(ranks, "group").select("c_custkey", "rank")


@query("d17_arithmetic", "SELECT user_id, day, round(2 * a + b / 4, 6) AS v FROM (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS a, sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS b FROM events GROUP BY ALL)")
def _(spark, sf):
    def one(kind):
        held = _events(spark, sf).groupBy("user_id", DAY.start(F.col("ts")).alias("day")).agg(F.sum(F.when(F.col("event_type") == kind, F.col("value")).otherwise(0.0)).alias("value"))
        return held

    return _round(lookup.combined(one("click"), one("view"), ["user_id", "day"], "2 * a + b / 4", "v"))


@query("d21_series", "SELECT position, user_id, ts, value FROM events JOIN (SELECT unnest([7, 3, 12]) AS user_id, unnest([0, 1, 2]) AS position) USING (user_id)")
def _(spark, sf):
    wanted = spark.createDataFrame([(0, 7), (1, 3), (2, 12)], "position int, user_id long")
    return results.series(_events(spark, sf), "user_id", wanted).select("position", "user_id", "ts", "value")


@query("d23_trials", "SELECT CAST(trial AS BIGINT) AS trial, n_nationkey FROM nation, (SELECT unnest([0, 1, 2]) AS trial)")
def _(spark, sf):
    return lookup.trials(_t(spark, sf, "nation").select("n_nationkey"), 3)


@query("d24_missing_keys", "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(spark, sf):
    return lookup.missing(_t(spark, sf, "orders"), "o_custkey", _t(spark, sf, "customer").where("c_acctbal > 0"), "c_custkey")


@query("h2_merge_ranks", "SELECT o_orderkey, o_totalprice, CAST(o_orderkey % 4 AS INTEGER) AS rank FROM orders")
def _(spark, sf):
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return lookup.merged({r: orders.where(F.col("o_orderkey") % 4 == r) for r in range(4)}, "o_orderkey")


@query("h3_set_differences", "SELECT key, side FROM (SELECT l_partkey AS key, 'extra' AS side FROM lineitem EXCEPT SELECT p_partkey, 'extra' FROM part WHERE p_size < 25) UNION ALL (SELECT p_partkey, 'unused' FROM part WHERE p_size < 25 EXCEPT SELECT l_partkey, 'unused' FROM lineitem)")
def _(spark, sf):
    items, parts = _t(spark, sf, "lineitem"), _t(spark, sf, "part").where("p_size < 25")
    extra = lookup.missing(items, "l_partkey", parts, "p_partkey").withColumn("side", F.lit("extra"))
    return extra.unionByName(lookup.missing(parts, "p_partkey", items, "l_partkey").withColumn("side", F.lit("unused")))


# --- expressions, results, names ---------------------------------------------------------------------------------------

_EXPRESSIONS = {
    "disc": "l_extendedprice * (1 - l_discount)",
    "charge": "disc * (1 + l_tax)",
    "kind": "where(l_quantity > 25 and not l_discount > 0.05, 1, 2) + (3 if 10 <= l_quantity < 20 else 0)",
    "curve": "sqrt(abs(l_tax - 0.04)) + sin(pi * l_quantity / 50) + max(l_tax, l_discount) ** 2 + (0 - l_quantity) % 7",
}


@query("i1_expressions", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + 1e-7, 4) AS disc, round(l_extendedprice * (1 - l_discount) * (1 + l_tax) + 1e-7, 4) AS charge, CASE WHEN l_quantity > 25 AND NOT l_discount > 0.05 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END + CASE WHEN l_quantity >= 10 AND l_quantity < 20 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS kind, round(sqrt(abs(l_tax - 0.04)) + sin(pi() * l_quantity / 50) + greatest(l_tax, l_discount) ** 2 + (-l_quantity - 7 * floor(-l_quantity / 7)) + 1e-7, 4) AS curve FROM lineitem")
def _(spark, sf):
    out = expressions.with_virtual(_t(spark, sf, "lineitem"), _EXPRESSIONS)
    return out.select("l_orderkey", "l_linenumber", *[(F.round(F.col(c) + 1e-7, 4) if c != "kind" else F.col(c)).alias(c) for c in _EXPRESSIONS])


@query("i2_vector", "SELECT l_suppkey, round(sum(l_quantity), 6) AS value FROM lineitem WHERE year(l_shipdate) = 1995 GROUP BY ALL")
def _(spark, sf):
    yearly = _t(spark, sf, "lineitem").groupBy("l_suppkey", YEAR.start(F.col("l_shipdate")).alias("t")).agg(F.sum("l_quantity").alias("value"))
    return _round(results.vector(yearly, "t", datetime(1995, 1, 1)).select("l_suppkey", "value"))


@query("i3_grid", "SELECT g // 40 AS x, g % 40 AS y, coalesce(round(p_retailprice, 6), -1.0::DOUBLE) AS value FROM (SELECT unnest(generate_series(0, ((SELECT max(p_partkey) FROM part) // 40 + 1) * 40 - 1)) AS g) LEFT JOIN part ON p_partkey = g AND p_size < 10")
def _(spark, sf):
    parts = _t(spark, sf, "part").select(F.col("p_partkey").alias("point"), F.when(F.col("p_size") < 10, F.col("p_retailprice")).alias("v"))
    nx = -(-(parts.agg(F.max("point")).first()[0] + 1) // 40)
    return _round(results.grid(parts.where("v IS NOT NULL"), "point", "v", nx, 40, -1.0))


@query("i7_noleap_days", "WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)) SELECT d::TIMESTAMP AS d, year(d) * 365 + (date_diff('day', make_date(2001, 1, 1), make_date(2001, month(d), day(d)))) AS n, year(d) * 360 + (month(d) - 1) * 30 + least(day(d), 30) - 1 AS n360 FROM d")
def _(spark, sf):
    days = _t(spark, sf, "orders").select(DAY.start(F.col("o_orderdate")).alias("d")).distinct().where("NOT (month(d) = 2 AND day(d) = 29)")
    y, m, d = F.year("d"), F.month("d"), F.day("d")
    return days.select("d", calendars.day_number(y, m, d, "noleap").alias("n"), calendars.day_number(y, m, F.least(d, F.lit(30)), "360_day").alias("n360"))


@query("i7_calendar_round_trip", "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS \"day\" FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)")
def _(spark, sf):
    days = _t(spark, sf, "orders").where("NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)")
    n = calendars.day_number(F.year("o_orderdate"), F.month("o_orderdate"), F.day("o_orderdate"), "noleap")
    return days.select(n.alias("n")).distinct().select(calendars.from_day_number(F.col("n"), "noleap").alias("x")).select("x.*")


@query("i8_symbols", "WITH t AS (SELECT DISTINCT p_brand || ' + 2*base.' || p_type || '^2 / 0.5' AS text FROM part) SELECT text, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(text, '^', '_pow_'), '+', '_plus_'), '-', '_minus_'), '*', '_mul_'), '/', '_div_'), '.', '_dot_'), '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS symbol FROM t")
def _(spark, sf):
    text = F.concat(F.col("p_brand"), F.lit(" + 2*base."), F.col("p_type"), F.lit("^2 / 0.5"))
    return _t(spark, sf, "part").select(text.alias("text")).distinct().withColumn("symbol", names.symbol(F.col("text")))


@query("i10_fingerprints", "SELECT user_id, sha256(string_agg(event_id || ':' || event_type, ',' ORDER BY event_id)) AS digest FROM events GROUP BY ALL")
def _(spark, sf):
    held = _events(spark, sf).select("user_id", "event_id", F.concat(F.col("event_id").cast("string"), F.lit(":"), "event_type").alias("text"))
    return digests.sha256_by(held, "user_id", ["event_id"], "text", ",")


@query("i13_update", "SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer")
def _(spark, sf):
    rows = _t(spark, sf, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return lookup.updated(_t(spark, sf, "customer"), "c_acctbal", 0.0, rows, "c_nationkey").select("c_custkey", "c_acctbal")


# --- stateful operators in batch form ----------------------------------------------------------------------------------


@query("j7_adaptive_substeps", "WITH RECURSIVE s AS (SELECT o_orderkey, 0 AS sub_step, 0.0::DOUBLE AS t, least(1000.0 + o_orderkey % 7 * 100, 1500.0, 3600.0)::DOUBLE AS dt FROM orders UNION ALL SELECT o_orderkey, sub_step + 1, t + dt, least(1000.0 + o_orderkey % 7 * 100, 1500.0, 3600.0 - t - dt)::DOUBLE FROM s WHERE 3600.0 - t - dt > 1e-9) SELECT o_orderkey, sub_step, dt FROM s")
def _(spark, sf):
    steps = _t(spark, sf, "orders").select("o_orderkey", F.lit(3600.0).alias("seconds"))
    return substeps.adaptive(steps, "seconds", lambda rows, elapsed: 1000.0 + rows["o_orderkey"].to_numpy() % 7 * 100, 1500.0).select("o_orderkey", "sub_step", "dt")


_CHANGES_SQL = "SELECT user_id AS target, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS step, CASE WHEN event_type = 'purchase' THEN 'SET' ELSE 'ADD' END AS kind, max(value) AS x FROM events GROUP BY ALL"


@query("j9_parameter_timeline", f"WITH c AS ({_CHANGES_SQL}), p AS (SELECT target, step, max(x) FILTER (kind = 'SET') AS s, coalesce(sum(x) FILTER (kind = 'ADD'), 0) AS a FROM c GROUP BY ALL), r AS (SELECT *, count(s) OVER (PARTITION BY target ORDER BY step) AS run FROM p) SELECT target, step, round(coalesce(first_value(s) OVER w, 0) + sum(a) OVER w, 4) AS value FROM r WINDOW w AS (PARTITION BY target, run ORDER BY step)")
def _(spark, sf):
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01', date_trunc('hour', ts))")
    kind = F.when(F.col("event_type") == "purchase", "SET").otherwise("ADD")
    changes = _events(spark, sf).groupBy(F.col("user_id").alias("target"), hour.alias("step"), kind.alias("kind")).agg(F.max("value").alias("x"))
    return parameters.timeline(changes).withColumn("value", F.round("value", 4))


@query("j9_expanded_plans", "SELECT c_custkey AS target, c_nationkey + i AS step, CASE WHEN c_custkey % 3 = 0 THEN 'SET' ELSE 'ADD' END AS kind, c_acctbal AS x FROM customer, (SELECT unnest([0, 1, 2]) AS i) WHERE i = 0 OR c_custkey % 3 <> 0")
def _(spark, sf):
    kind = F.when(F.col("c_custkey") % 3 == 0, "SET").otherwise("ADD")
    plans = _t(spark, sf, "customer").select(F.col("c_custkey").alias("target"), F.col("c_nationkey").alias("start_step"), kind.alias("kind"), F.col("c_acctbal").alias("x"), F.lit(3).alias("active_steps"))
    return parameters.expanded(plans)


@query("m8_coalesced_mapping", "SELECT l_partkey AS source, l_suppkey AS target_id, round(sum(l_quantity), 6) AS weight FROM lineitem GROUP BY ALL")
def _(spark, sf):
    return _round(mapping.coalesced(_t(spark, sf, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target_id"), F.col("l_quantity").alias("weight"))))


@query("m11_copied_input", "SELECT user_id, event_id, round(coalesce(last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0), 6) AS value FROM events")
def _(spark, sf):
    x = F.when(F.col("event_type") == "click", F.col("value"))
    return _round(parameters.copied_input(_events(spark, sf).select("user_id", "event_id", x.alias("value")), "value", "keep", "user_id", "event_id"))


@query("b3_year_split", "SELECT CAST(year(o_orderdate) AS VARCHAR) AS time_key, count(*) AS n, round(sum(o_totalprice), 3) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1993-01-01' AND o_orderdate < TIMESTAMP '1995-07-01' GROUP BY ALL")
def _(spark, sf):
    path = scratch.new_path(spark, "years")
    tables.write_by_time(_t(spark, sf, "orders"), path, "o_orderdate", "year")
    found = tables.read_by_time(spark, path, None, "o_orderdate", "year", datetime(1993, 1, 1), datetime(1995, 7, 1))
    return found.groupBy(F.col("time_key").cast("string").alias("time_key")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 3).alias("total"))


@query("b5_static_columns", f"SELECT user_id, step, round(v, 6) AS v, c_mktsegment FROM ({_DAILY_SQL}) JOIN customer ON c_custkey = user_id")
def _(spark, sf):
    static = _t(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    known = _daily(spark, sf).join(static, "user_id", "left_semi")
    return _round(lookup.with_static(known, "user_id", static, "c_mktsegment"))


@query("b8_normalized_export", f"SELECT t, target_id, round(sum(w * x), 4) AS value FROM (SELECT target_id, source, weight / sum(weight) OVER (PARTITION BY target_id) AS w FROM ({_MAP_SQL})) JOIN ({_FRAMES_SQL}) USING (source) GROUP BY ALL")
def _(spark, sf):
    out = mapping.apply_mapping(_frames(spark, sf), mapping.normalized(_weights(spark, sf)), "t", "source", "x")
    return out.withColumn("value", F.round("value", 4))


@query("j2_stream_two_level", f"WITH a AS ({_inner_sql(kinds=('mean', 'max'))}), w AS (SELECT max(ts) AS m FROM events) SELECT user_id, outer_start, count(*) AS n_inner, round(max(mean_), 6) AS max_mean, round(min(max_), 6) AS min_max FROM a WHERE outer_start + INTERVAL 5 DAY <= (SELECT m FROM w) GROUP BY ALL")
def _(spark, sf):
    from .streaming import windows

    folder = scratch.new_path(spark, "stream")
    _events(spark, sf).repartitionByRange(4, "ts").write.parquet(f"{folder}/in")
    source = windows.file_stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, 64)
    out = windows.two_level_stream(source, ["user_id"], "ts", "value", "1 day", "5 days", ["max_mean", "min_max"])
    windows.run_to_table(out, f"{folder}/out", f"{folder}/checkpoint")
    return _round(spark.read.parquet(f"{folder}/out"))


# --- further scans, sinks and checks -----------------------------------------------------------------------------------


@query("a10_mapping_round_trip", f"SELECT target_id, source, round(weight, 6) AS weight FROM ({_MAP_SQL})")
def _(spark, sf):
    from .sources import mapping_table

    path = scratch.new_path(spark, "mapping")
    mapping_table.save_mapping(_weights(spark, sf), path)
    return _round(mapping_table.load_mapping(spark, path))


@query("a12_rank_files", "SELECT CAST(o_custkey % 4 AS INTEGER) AS rank, o_custkey, round(sum(o_totalprice), 4) AS total FROM orders WHERE year(o_orderdate) = 1996 GROUP BY ALL")
def _(spark, sf):
    path = scratch.new_path(spark, "ranks")
    tables.write_by_time(_t(spark, sf, "orders").withColumn("rank", (F.col("o_custkey") % 4).cast("int")), path, "o_orderdate", "year", "rank")
    found = tables.read_by_time(spark, path, None, "o_orderdate", "year", datetime(1996, 1, 1), datetime(1997, 1, 1))
    return found.groupBy("rank", "o_custkey").agg(F.round(F.sum("o_totalprice"), 4).alias("total"))


@query("b4_best_k_split", _RANKED_SQL.format("mean_ DESC", "round(mean_, 6)").replace("WHERE k < 3", "WHERE k = 1"))
def _(spark, sf):
    out = statistics.two_level(_events(spark, sf), ["user_id"], "ts", "value", DAY, _FIVE, ["max3_mean"])
    path = scratch.new_path(spark, "best")
    statistics.ranked(out, ["user_id", "outer_start"], "max3_mean").write.partitionBy("k").parquet(path)
    return _round(spark.read.parquet(path).where("k = 1").select("user_id", "outer_start", F.col("k").cast("long").alias("k"), "value"))


@query("b11_dense_frames", "SELECT CAST(t AS BIGINT) AS t, ((SELECT max(p_partkey) FROM part) + 1) * 4 AS bytes, n FROM (SELECT unnest([0, 1, 2]) AS t), (SELECT count(*) AS n FROM part)")
def _(spark, sf):
    from .sources import mapping_table

    frames = _frames(spark, sf)
    size = frames.agg(F.max("source")).first()[0] + 1
    held = frames.groupBy("t").agg(F.count("*").alias("n"))
    dense = mapping_table.dense_frames(frames, "t", "source", "x", size, -9999.0)
    return dense.select("t", F.octet_length("frame").cast("long").alias("bytes")).join(held, "t")


@query("c3_dropped", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, sf):
    return lookup.projected(_t(spark, sf, "customer"), skip=["c_nationkey", "c_acctbal"])


@query("c15_outside_dropped", "SELECT p_partkey, CAST(floor(p_size) + 50 * floor(p_retailprice - 900) AS BIGINT) AS source FROM part WHERE p_size <= 50 AND p_retailprice BETWEEN 900 AND 940 AND p_size < 50 AND p_retailprice < 940")
def _(spark, sf):
    points = _t(spark, sf, "part").where("p_size <> 50 AND p_retailprice <> 940").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") - 900).alias("y"))
    return _GRID.cells(points, "x", "y").select("p_partkey", "source")


@query("c17_gather", "WITH p AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS position, c_custkey, c_acctbal FROM customer) SELECT a.c_custkey, b.c_acctbal AS gathered FROM p a JOIN p b ON b.position = (a.position * 7 + 3) % (SELECT count(*) FROM customer)")
def _(spark, sf):
    placed = lookup.with_positions(_t(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    size = _t(spark, sf, "customer").count()
    index = placed.select("c_custkey", ((F.col("position") * 7 + 3) % size).alias("position"))
    return index.join(placed.select("position", F.col("c_acctbal").alias("gathered")), "position").select("c_custkey", "gathered")


@query("d18_same_points", "SELECT o_custkey, round(sum(o_totalprice), 4) AS total, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, sf):
    orders = _t(spark, sf, "orders")
    total = orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 4).alias("total"))
    return lookup.aligned(total, [orders.groupBy("o_custkey").agg(F.count("*").alias("n"))], "o_custkey")


@query("d20_local_order", "SELECT row_number() OVER (ORDER BY s_suppkey DESC) - 1 AS position, s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 4 ELSE 0 END AS shift FROM supplier")
def _(spark, sf):
    order = lookup.with_positions(_t(spark, sf, "supplier").select((-F.col("s_suppkey")).alias("n")), "n").select("position", (-F.col("n")).alias("s_suppkey"))
    shifts = _t(spark, sf, "supplier").where("s_suppkey % 3 = 0").select("s_suppkey", (F.col("s_suppkey") % 4).alias("shift"))
    return order.join(shifts, "s_suppkey", "left").select("position", "s_suppkey", F.coalesce("shift", F.lit(0).cast("long")).alias("shift"))


@query("d22_targets", "SELECT c_custkey, CASE WHEN c_custkey IN (3, 5, 8) THEN 1.5::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer")
def _(spark, sf):
    customer, targets = _t(spark, sf, "customer"), spark.createDataFrame([(3,), (5,), (8,)], "c_custkey long")
    lookup.require_references(lookup.require_unique(targets, "c_custkey"), "c_custkey", customer, "c_custkey")
    return lookup.updated(customer, "c_acctbal", 1.5, targets, "c_custkey").select("c_custkey", "c_acctbal")


@query("d25_resharded_state", "SELECT c_custkey, CAST(c_custkey % 3 AS INTEGER) AS rank, round(c_acctbal, 6) AS value FROM customer")
def _(spark, sf):
    from .sources import state

    path = scratch.new_path(spark, "state")
    state.save_state(_t(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 5).cast("int").alias("rank"), F.col("c_acctbal").alias("value")), path)
    now = _t(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 3).cast("int").alias("rank"))
    return _round(state.load_state(spark, path, now, "c_custkey"))


@query("g5_not_increasing", "SELECT user_id, count(*) AS n FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) WHERE value <= b GROUP BY ALL")
def _(spark, sf):
    return scan.not_increasing(_events(spark, sf), ["user_id"], ["ts"], "value").groupBy("user_id").agg(F.count("*").alias("n"))


@query("g6_integer_runs", "WITH k AS (SELECT DISTINCT l_suppkey, l_partkey // 10 AS p FROM lineitem), r AS (SELECT *, p - row_number() OVER (PARTITION BY l_suppkey ORDER BY p) AS g FROM k) SELECT l_suppkey, min(p) AS low, max(p) AS high FROM r GROUP BY l_suppkey, g")
def _(spark, sf):
    return lookup.integer_runs(_t(spark, sf, "lineitem").select("l_suppkey", F.expr("l_partkey div 10").alias("p")), ["l_suppkey"], "p")


@query("h1_concatenated_shards", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, sf):
    orders = _t(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"))
    return lookup.merged({k: orders.where(F.col("o_orderkey") % 3 == k) for k in range(3)}, "o_orderkey").groupBy("y").agg(F.count("*").alias("n"))


@query("i4_lerp", "SELECT l_orderkey, l_linenumber, round(l_discount + 0.25 * (l_tax - l_discount) + 1e-9, 6) AS v FROM lineitem")
def _(spark, sf):
    out = expressions.with_virtual(_t(spark, sf, "lineitem"), {"v": "l_discount + 0.25 * (l_tax - l_discount)"})
    return out.select("l_orderkey", "l_linenumber", F.round(F.col("v") + 1e-9, 6).alias("v"))


@query("i6_unravelled", "SELECT p_partkey, p_partkey // 40 AS x, p_partkey % 40 AS y FROM part")
def _(spark, sf):
    return results.unravelled(_t(spark, sf, "part").select("p_partkey"), "p_partkey", 40)


@query("k1_registered_function", "SELECT l_orderkey, l_linenumber, round(l_quantity * (1 - l_discount) * 3 + 1e-9, 6) AS v FROM lineitem")
def _(spark, sf):
    from .functions.registry import Registry, Signature

    r = Registry()
    r.register(Signature("net", {"l_quantity": "double", "l_discount": "double"}, "double", ("factor",)), lambda l_quantity, l_discount, factor: l_quantity * (1 - l_discount) * factor)
    out = r.apply(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), "net", "v", factor=3.0)
    return out.select("l_orderkey", "l_linenumber", F.round(F.col("v") + 1e-9, 6).alias("v"))


@query("k6_adhoc_request", f"WITH a AS (SELECT user_id, CAST({_5DAYS_SQL} AS TIMESTAMP) AS outer_start, date_trunc('day', ts) AS i, avg(value / 2 + 1) AS m FROM events GROUP BY ALL) SELECT user_id, outer_start, round(max(m) + 1e-7, 6) AS half_max_mean, round(min(m) + 1e-7, 6) AS half_min_mean FROM a GROUP BY ALL")
def _(spark, sf):
    from .plans.schema import request

    wanted = request({"max_mean": [{"half": "value / 2 + 1"}], "min_mean": [("half", "value / 2 + 1")]})
    df = expressions.with_virtual(_events(spark, sf), {alias: text for _, alias, text in wanted})
    out = statistics.two_level(df, ["user_id"], "ts", "half", DAY, _FIVE, [op for op, _, _ in wanted])
    return out.select("user_id", "outer_start", *[F.round(F.col(op) + 1e-7, 6).alias(f"half_{op}") for op, _, _ in wanted])


@query("l2_conformed", "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, 0.5::DOUBLE AS rough FROM customer")
def _(spark, sf):
    from .plans.schema import Field, check_model, conformed

    fields = [Field("c_custkey", "int", "coordinate"), Field("c_nationkey", "int", "reference", "nation.n_nationkey"), Field("c_acctbal", "float"), Field("rough", "float", default=0.5), Field("extra", "float", depends_on=("other",))]
    customer = conformed(_t(spark, sf, "customer"), fields)
    check_model({"customer": customer, "nation": _t(spark, sf, "nation")}, {"customer": [f for f in fields if f.name != "extra"], "nation": [Field("n_nationkey", "idx", "coordinate")]})
    return customer


@query("l5_shard", "SELECT s_suppkey, n_regionkey AS \"group\" FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey % 2 = 1")
def _(spark, sf):
    groups = lookup.lineage(_t(spark, sf, "supplier"), [("s_nationkey", _t(spark, sf, "nation"), "n_nationkey", "n_regionkey")])
    ranks = _t(spark, sf, "region").select(F.col("r_regionkey").alias("group"), (F.col("r_regionkey") % 2).alias("rank"))
    return lookup.own_shard(groups, "group", ranks, 1).select("s_suppkey", "group")


@query("m7_mask_targets", "SELECT p_partkey AS target_id, (p_partkey % 50)::DOUBLE AS xmin, (p_partkey % 50 + 1)::DOUBLE AS xmax, (p_partkey // 50)::DOUBLE AS ymin, (p_partkey // 50 + 1)::DOUBLE AS ymax FROM part WHERE p_size > 40 AND p_partkey < 2000")
def _(spark, sf):
    mask = _t(spark, sf, "part").where("p_partkey < 2000").select("p_partkey", "p_size", (F.col("p_partkey") % 50).alias("ix"), F.expr("p_partkey div 50").alias("iy"))
    return mapping.mask_targets(mask, _GRID, F.col("p_size") > 40, target_id="p_partkey").drop("source", "x", "y")


@query("m10_plan_summary", "SELECT row_number() OVER (ORDER BY c_nationkey, c_mktsegment, c_custkey % 3 <> 0, c_custkey) - 1 AS place, CAST(c_nationkey AS BIGINT) AS start_step, c_mktsegment AS name, CASE WHEN c_custkey % 3 = 0 THEN 'SET' ELSE 'ADD' END AS kind, c_acctbal AS x, 3 AS active_steps, c_custkey AS target FROM customer")
def _(spark, sf):
    kind = F.when(F.col("c_custkey") % 3 == 0, "SET").otherwise("ADD")
    plans = _t(spark, sf, "customer").select(F.col("c_custkey").alias("target"), F.col("c_nationkey").cast("long").alias("start_step"), F.col("c_mktsegment").alias("name"), kind.alias("kind"), F.col("c_acctbal").alias("x"), F.lit(3).alias("active_steps"))
    return parameters.summary(plans)


@query("m13_missing_files", "SELECT strftime(h, '%Y%m%d') AS time_key FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-01-10', INTERVAL 1 DAY)) AS h) WHERE NOT EXISTS (SELECT 1 FROM events WHERE date_trunc('day', ts) = h)")
def _(spark, sf):
    needed = Schedule(datetime(2023, 12, 30), datetime(2024, 1, 11), HOURS(24)).frame(spark)
    return tables.missing_keys(needed, _events(spark, sf), "day", "ts")


# --- compositions ------------------------------------------------------------------------------------------------------


@query("a15_times_by_rank", "SELECT CAST(o_custkey % 4 AS BIGINT) AS rank, count(DISTINCT year(o_orderdate)) AS years FROM orders GROUP BY ALL")
def _(spark, sf):
    kept = _t(spark, sf, "orders").select((F.col("o_custkey") % 4).alias("rank"), YEAR.start(F.col("o_orderdate")).alias("t"), "o_custkey").distinct()
    tables.check_ranks(kept, 4, "t", "o_custkey")
    return kept.groupBy("rank").agg(F.count_distinct("t").alias("years"))


@query("c11_factor_after_aggregation", "SELECT event_type, date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS block, round(max(value) / 1000 + 1e-9, 6) AS top FROM events GROUP BY ALL")
def _(spark, sf):
    out = resample.time_aggregated(_events(spark, sf), ["event_type"], "ts", "value", START, HOURS(24), {"top": "max"}, 1000.0)
    return out.withColumn("top", F.round(F.col("top") + 1e-9, 6))


@query("c16_first_frame_mask", f"WITH m AS ({_MAP_SQL}), v AS (SELECT m.*, p_size <= 40 AS ok FROM m JOIN part ON p_partkey = source), s AS (SELECT *, sum(weight) OVER (PARTITION BY target_id) AS a, sum(CASE WHEN ok THEN weight END) OVER (PARTITION BY target_id) AS g FROM v), w AS (SELECT target_id, source, weight * a / g AS weight FROM s WHERE ok) SELECT t, target_id, round(sum(weight * x), 3) AS value FROM w JOIN ({_FRAMES_SQL}) USING (source) GROUP BY ALL")
def _(spark, sf):
    size = _t(spark, sf, "part").select(F.col("p_partkey").alias("source"), "p_size")
    frames = _frames(spark, sf).join(size, "source").withColumn("x", F.when(F.col("p_size") > 40, F.lit(float("nan"))).otherwise(F.col("x")))
    valid = mapping.first_frame_valid(frames, "t", "source", "x")
    out = mapping.apply_mapping(frames, mapping.with_source_mask(_weights(spark, sf), valid, _GRID, "drop"), "t", "source", "x")
    return out.withColumn("value", F.round("value", 3))


@query("d15_point_mapping", "SELECT c_custkey AS target_id, CAST((c_custkey * 3 % 40) * 50 + c_custkey * 7 % 50 AS BIGINT) AS source, 1.0::DOUBLE AS weight FROM customer")
def _(spark, sf):
    points = _t(spark, sf, "customer").select(F.col("c_custkey").alias("target_id"), (F.col("c_custkey") * 7 % 50 + 0.25).alias("x"), (F.col("c_custkey") * 3 % 40 + 0.75).alias("y"))
    return mapping.point_mapping(points, _GRID, "nearest")


@query("d16_range_lookup", "SELECT event_id, name FROM events JOIN (SELECT unnest(['a', 'b', 'c']) AS name, unnest([TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-11 12:00:00']) AS s, unnest([TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-11 12:00:00', TIMESTAMP '2024-01-29']) AS e) ON ts >= s AND ts < e")
def _(spark, sf):
    rule = ExplicitWindows((("a", datetime(2024, 1, 2), datetime(2024, 1, 5)), ("b", datetime(2024, 1, 10), datetime(2024, 1, 11, 12)), ("c", datetime(2024, 1, 11, 12), datetime(2024, 1, 29))))
    return rule.attach(_events(spark, sf), "ts", "name").select("event_id", "name")


@query("e7_levels", "SELECT label, level, round(avg(x) + 1e-9, 5) AS mean, round(max(x) + 1e-9, 5) AS max FROM (SELECT label, unnest(generate_series(0, len(embedding) - 1)) AS level, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL")
def _(spark, sf):
    held = scan.levels(_t(spark, sf, "embeddings").select("label", "embedding"), "embedding", "x")
    return held.groupBy("label", "level").agg(F.round(F.avg("x") + 1e-9, 5).alias("mean"), F.round(F.max("x") + 1e-9, 5).alias("max"))


@query("g1_best_samples", "SELECT user_id, k, value FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts) - 1 AS k FROM events) WHERE k < 5")
def _(spark, sf):
    return lookup.best_rows(_events(spark, sf), ["user_id"], "value", 5, ["ts"]).select("user_id", "k", "value")


@query("h4_range_intersection", "SELECT event_type, CASE WHEN max(a) <= min(b) THEN max(a) END AS low, CASE WHEN max(a) <= min(b) THEN min(b) END AS high FROM (SELECT user_id, event_type, min(ts) AS a, max(ts) AS b FROM events GROUP BY ALL) GROUP BY ALL")
def _(spark, sf):
    seen = _events(spark, sf).groupBy("user_id", "event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return lookup.range_intersection(seen, ["event_type"], "a", "b")


@query("j15_output_after_spin_up", f"SELECT user_id, step - 10 AS step, round(sum(v) OVER (PARTITION BY user_id ORDER BY step), 5) AS total FROM ({_DAILY_SQL}) QUALIFY step >= 10")
def _(spark, sf):
    running = F.sum("v").over(Window.partitionBy("user_id").orderBy("step"))
    return after_spin_up(_daily(spark, sf).withColumn("total", F.round(running, 5)), "step", 10).select("user_id", "step", "total")


@query("m5_mapped_variables", f"SELECT target_id, round(sum(weight * p_retailprice), 4) AS price, round(sum(weight * p_size), 4) AS size FROM ({_MAP_SQL}) JOIN part ON p_partkey = source GROUP BY ALL")
def _(spark, sf):
    part = _t(spark, sf, "part").select(F.lit(0).alias("t"), F.col("p_partkey").alias("source"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    out = mapping.mapped_variables(part, _weights(spark, sf), "t", "source", ["price", "size"])
    return out.select("target_id", F.round("price", 4).alias("price"), F.round("size", 4).alias("size"))


@query("m9_set_value", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0::DOUBLE ELSE s_acctbal END AS s_acctbal FROM supplier")
def _(spark, sf):
    supplier = _t(spark, sf, "supplier")
    return lookup.updated(supplier, "s_acctbal", 0.0, supplier.where("s_acctbal < 0"), "s_suppkey").select("s_suppkey", "s_acctbal")


@query("m12_all_coordinates", "SELECT DISTINCT p_partkey // 40 AS x, p_partkey % 40 AS y FROM part")
def _(spark, sf):
    parts = _t(spark, sf, "part").select("p_partkey")
    return results.all_coordinates([parts.where(F.col("p_partkey") % 3 == k) for k in range(3)], "p_partkey", 40)


@query("a3_raw_frames", f"SELECT CAST(t AS VARCHAR) AS file, source // 50 AS y, source % 50 AS x, round(CAST(x AS FLOAT)::DOUBLE / 10 + 1e-7, 4) AS value FROM ({_FRAMES_SQL})")
def _(spark, sf):
    """Grids as raw bytes, and back."""
    from .sources import binary, mapping_table

    frames = _frames(spark, sf).withColumn("source", F.col("source").cast("int"))
    ny = -(-(frames.agg(F.max("source")).first()[0] + 1) // 50)
    held = mapping_table.dense_frames(frames, "t", "source", "x", ny * 50, -9999.0)
    cells = binary.decoded(held.select(F.col("t").cast("string").alias("path"), F.col("frame").alias("content")), ny, 50, factor=10.0)
    return cells.where("value > -999").select("file", "y", "x", F.round(F.col("value") + 1e-7, 4).alias("value"))


@query("a8_active_points", "SELECT (p_partkey % 50) * 40 + p_partkey // 50 AS point_id FROM part WHERE p_size <> 7")
def _(spark, sf):
    from .sources import binary

    value = F.when(F.col("p_size") == 7, -9999).otherwise(F.col("p_size"))
    cells = _t(spark, sf, "part").select((F.col("p_partkey") % 50).alias("x"), F.expr("p_partkey div 50").alias("y"), value.alias("value"))
    return binary.active_points(cells, 40)


@query("c10_clipped", "SELECT c_custkey, greatest(c_acctbal, 0.0) AS v FROM customer")
def _(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", resample.values_or_zero(F.col("c_acctbal"), clip_negative=True).alias("v"))


@query("d19_gauges_by_point", f"SELECT n_nationkey, step, round(sum(v), 5) AS v FROM ({_DAILY_SQL}) JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def _(spark, sf):
    at = _t(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("point"))
    gauges = _daily(spark, sf).join(at, "user_id").select("point", "step", F.col("v").alias("value"))
    found = overlay.by_point(gauges, gauges.select(F.col("point").alias("gauge")).distinct())
    return found.select(F.col("gauge").alias("n_nationkey"), "step", F.round("value", 5).alias("v"))


@query("j4_strict_order", f"SELECT user_id, step FROM (SELECT user_id, step, lag(step) OVER (PARTITION BY user_id ORDER BY step) AS b FROM ({_DAILY_SQL})) WHERE step <> b + 1")
def _(spark, sf):
    return scan.not_following(_daily(spark, sf), ["user_id"], "step").select("user_id", "step")


# --- overlays ----------------------------------------------------------------------------------------------------------

#: Gauges are users, basins are users modulo 10; 24 steps from the fourth day on, windows of 5 steps every 3.
_OFFSET, _STEPS, _LENGTH, _STRIDE, _LAST = 3, 24, 5, 3, 18
_GAUGES_SQL = f"d AS ({_DAILY_SQL}), ax AS (SELECT min(step) AS lo, max(step) AS hi FROM d), u AS (SELECT DISTINCT user_id FROM d)"
_SLOTS_SQL = f"(SELECT unnest(generate_series(0, {_LAST}, {_STRIDE})) AS window_start) CROSS JOIN (SELECT unnest(generate_series(0, {_LENGTH - 1})) AS o)"


def _aligned_sql(pad: str) -> str:
    """(user_id, t, v): every eleventh value is missing."""
    return f"SELECT u.user_id, t, CASE WHEN t + {_OFFSET} NOT BETWEEN lo AND hi THEN {pad} WHEN (d.user_id + d.step) % 11 = 0 THEN NULL ELSE d.v END AS v FROM u CROSS JOIN (SELECT unnest(generate_series(0, {_STEPS - 1})) AS t) CROSS JOIN ax LEFT JOIN d ON d.user_id = u.user_id AND d.step = t + {_OFFSET}"


_INFLOW_SQL = f"WITH {_GAUGES_SQL}, g AS ({_aligned_sql('0')}), i AS (SELECT user_id, t, t - row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM g WHERE v IS NOT NULL), r AS (SELECT user_id, min(t) AS s, count(*) AS n FROM i GROUP BY user_id, k), b AS (SELECT user_id, arg_max(s, (n, -s)) AS s, max(n) AS n FROM r GROUP BY user_id), basins AS (SELECT user_id % 10 AS basin, max(s) AS shift, greatest(0, min(s + n) - max(s)) AS length FROM b GROUP BY 1), f AS (SELECT user_id, t, CASE WHEN t >= shift AND t < shift + length THEN coalesce(v, 0) ELSE 0 END AS v, coalesce(shift, 0) AS shift, coalesce(length, 0) AS length FROM g LEFT JOIN basins ON basin = user_id % 10)"
_LOSS_SQL = f"l AS (SELECT h.user_id, t, v, coalesce(shift, 0) AS shift FROM ({_aligned_sql('NULL')}) h LEFT JOIN basins ON basin = user_id % 10)"


def _gauges(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(point, step, value) with NaN where missing, and (gauge, basin)."""
    daily = _daily(spark, sf)
    value = F.when((F.col("user_id") + F.col("step")) % 11 == 0, F.lit(float("nan"))).otherwise(F.col("v"))
    points = daily.select(F.col("user_id").alias("gauge"), (F.col("user_id") % 10).alias("basin")).distinct()
    return daily.select(F.col("user_id").alias("point"), "step", value.alias("value")), points


@query("m1_gauge_overlay", _INFLOW_SQL + " SELECT user_id AS gauge, t AS step, round(v, 6) AS value, CAST(shift AS BIGINT) AS shift, CAST(length AS BIGINT) AS length FROM f")
def _(spark, sf):
    return _round(overlay.inflow(*_gauges(spark, sf), _OFFSET, _STEPS)[0])


@query("m1_shifted_reads", _INFLOW_SQL + f" SELECT window_start, u.user_id AS gauge, o AS \"offset\", round(coalesce(f.v, 0), 6) AS value FROM u CROSS JOIN {_SLOTS_SQL} LEFT JOIN f ON f.user_id = u.user_id AND f.t = window_start + o + f.shift")
def _(spark, sf):
    flows, _ = overlay.inflow(*_gauges(spark, sf), _OFFSET, _STEPS)
    return _round(overlay.read_windows(flows, _LAST, _LENGTH, 0.0, _STRIDE))


@query("m2_loss_overlay", _INFLOW_SQL + ", " + _LOSS_SQL + " SELECT user_id AS gauge, t AS step, round(v, 6) AS value, CAST(shift AS BIGINT) AS shift FROM l")
def _(spark, sf):
    gauges, points = _gauges(spark, sf)
    return _round(overlay.loss(gauges, points, overlay.inflow(gauges, points, _OFFSET, _STEPS)[1], _OFFSET, _STEPS))


@query("m3_overlay_alignment", f"WITH {_GAUGES_SQL} SELECT u.user_id AS gauge, t AS step, CASE WHEN t - 4 NOT BETWEEN lo AND hi THEN -1.0 ELSE round(d.v, 6) END AS value FROM u CROSS JOIN (SELECT unnest(generate_series(0, 19)) AS t) CROSS JOIN ax LEFT JOIN d ON d.user_id = u.user_id AND d.step = t - 4")
def _(spark, sf):
    gauges = _daily(spark, sf).select(F.col("user_id").alias("gauge"), "step", F.col("v").alias("value"))
    return _round(overlay.aligned_steps(gauges, -4, 20, -1.0))


@query("m4_windowed_overlays", _INFLOW_SQL + ", " + _LOSS_SQL + f" SELECT window_start, u.user_id AS gauge, o AS \"offset\", round(coalesce(d.v, 0), 6) AS value, round(coalesce(f.v, 0), 6) AS inflow, round(l.v, 6) AS loss FROM u CROSS JOIN {_SLOTS_SQL} LEFT JOIN d ON d.user_id = u.user_id AND d.step = window_start + o LEFT JOIN f ON f.user_id = u.user_id AND f.t = window_start + o + f.shift LEFT JOIN l ON l.user_id = u.user_id AND l.t = window_start + o + l.shift")
def _(spark, sf):
    gauges, points = _gauges(spark, sf)
    flows, basins = overlay.inflow(gauges, points, _OFFSET, _STEPS)
    losses = overlay.loss(gauges, points, basins, _OFFSET, _STEPS)
    source = _daily(spark, sf).select(F.col("user_id").alias("gauge"), "step", F.col("v").alias("value"))
    return _round(overlay.with_overlays(source, {"inflow": (flows, 0.0), "loss": (losses, None)}, _LAST, _LENGTH, _STRIDE))


# --- scans in one call, grids ------------------------------------------------------------------------------------------


@query("a1_scan", "WITH h AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS t, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE sum(value) - 200 END AS v FROM events GROUP BY ALL) SELECT user_id, date_trunc('day', t)::TIMESTAMP AS time, round(max(greatest(coalesce(v, 0), 0)) / 1000, 6) AS value FROM h WHERE t >= TIMESTAMP '2024-01-05' AND t < TIMESTAMP '2024-01-20' GROUP BY ALL")
def _(spark, sf):
    rows = _events(spark, sf).groupBy("user_id", IntervalWindow(HOURS(6)).start(F.col("ts")).alias("t")).agg(F.when(F.count("*") % 3 == 0, F.lit(float("nan"))).otherwise(F.sum("value") - 200).alias("v"))
    return _round(scan.scan(rows, ["user_id"], "t", "v", datetime(2024, 1, 5), datetime(2024, 1, 19), HOURS(6), factor=1000.0, clip=True, how="max", width=HOURS(24)))


@query("a2_accumulated_scan", "WITH h AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS t, sum(value) AS v FROM events GROUP BY ALL) SELECT user_id, t AS time, round(v / 3.6, 6) AS value FROM h WHERE t BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-19 23:00:00'")
def _(spark, sf):
    hours = _events(spark, sf).groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(F.sum("value").alias("v"))
    total = F.sum("v").over(Window.partitionBy("user_id", F.date_trunc("day", "h")).orderBy("h"))
    totals = hours.select("user_id", F.timestamp_add("HOUR", F.lit(1), F.col("h")).cast("timestamp_ntz").alias("t"), total.alias("total"))
    return _round(scan.scan(totals, ["user_id"], "t", "total", datetime(2024, 1, 5), datetime(2024, 1, 19, 23), HOURS(1), factor=3.6, accumulated=True))


@query("a4_point_series", "SELECT o_custkey % 7 AS point, CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS t, round(sum(o_totalprice), 3) AS v FROM orders GROUP BY ALL")
def _(spark, sf):
    held = _t(spark, sf, "orders").groupBy((F.col("o_custkey") % 7).alias("point"), YEAR.start(F.col("o_orderdate")).alias("t")).agg(F.round(F.sum("o_totalprice"), 3).alias("v"))
    return scan.require_shape(held, "t", "point", "v")


_PIXEL_SQL = "SELECT l_linenumber AS tile, l_partkey % 60 AS ix, l_suppkey % 60 AS iy, l_orderkey % 24 - 2 AS cx, l_quantity::BIGINT % 20 AS cy, l_extendedprice AS area FROM lineitem"


@query("a9_tile_pixels", f"WITH t AS (SELECT k AS tile, (k * 10 - 40)::DOUBLE AS w, (k * 5)::DOUBLE AS n FROM (SELECT unnest(generate_series(1, 7)) AS k)), p AS ({_PIXEL_SQL}), c AS (SELECT * FROM t JOIN p USING (tile) WHERE ix >= greatest(round((-12.0 - w) / 0.5), 0) AND ix < least(round((18.0 - w) / 0.5), 60) AND iy >= greatest(round((n - 21.0) / 0.5), 0) AND iy < least(round((n + 7.0) / 0.5), 60) AND cx > 0) SELECT CAST((cx - 3) * 12 + cy - 2 AS BIGINT) AS pixel_target, round((w + (ix + 0.5) * 0.5)::DOUBLE, 6) AS x, round((n - (iy + 0.5) * 0.5)::DOUBLE, 6) AS y, count(*) AS pixels, round(sum(area), 3) AS area FROM c WHERE cx - 3 BETWEEN 0 AND 14 AND cy - 2 BETWEEN 0 AND 11 GROUP BY ALL")
def _(spark, sf):
    tiles = spark.createDataFrame([(k, k * 10.0 - 40, k * 5.0, 0.5, 60, 60) for k in range(1, 8)], "tile int, tile_west double, tile_north double, size double, nix int, niy int")
    pixels = _t(spark, sf, "lineitem").select(F.col("l_linenumber").alias("tile"), (F.col("l_partkey") % 60).alias("ix"), (F.col("l_suppkey") % 60).alias("iy"), (F.col("l_orderkey") % 24 - 2).alias("cx"), (F.col("l_quantity").cast("long") % 20).alias("cy"), F.col("l_extendedprice").alias("area"))
    found = mapping.tile_pixels(pixels, tiles, -12.0, 18.0, -7.0, 21.0, 15, 12, (2, 1))
    return found.groupBy("pixel_target", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")).agg(F.count("*").alias("pixels"), F.round(F.sum("area"), 3).alias("area"))


@query("a11_discovered_grid", "WITH c AS (SELECT p_partkey % 25 AS ix, p_partkey // 25 % 8 AS iy, 10 + 0.4::DOUBLE * (p_partkey % 25) AS x, -4 + 0.5::DOUBLE * (p_partkey // 25 % 8) AS y FROM part) SELECT CAST(count(DISTINCT ix) AS BIGINT) AS nx, CAST(count(DISTINCT iy) AS BIGINT) AS ny, round(min(x) - 0.2, 6) AS west, round(max(x) + 0.2, 6) AS east, round(min(y) - 0.25, 6) AS south, round(max(y) + 0.25, 6) AS north FROM c")
def _(spark, sf):
    cells = _t(spark, sf, "part").select((F.col("p_partkey") % 25).alias("ix"), F.expr("p_partkey div 25 % 8").alias("iy"))
    held = cells.select("ix", "iy", (F.col("ix") * 0.4 + 10).alias("Longitude"), (F.col("iy") * 0.5 - 4).alias("LAT"))
    g = mapping.Grid.from_coordinates(held)
    return _round(spark.createDataFrame([(g.x.n, g.y.n, g.x.low, g.x.high, g.y.low, g.y.high)], "nx long, ny long, west double, east double, south double, north double"))


@query("a14_map_shape", "SELECT count(DISTINCT n_regionkey) AS nx, max(n_nationkey)::BIGINT AS ny FROM nation")
def _(spark, sf):
    regions, last = _t(spark, sf, "nation").agg(F.count_distinct("n_regionkey"), F.max("n_nationkey")).first()
    rows = [("dimension", "x", 0, 3), ("dimension", "y", 0, 4), ("variable", "nx", 0, 8), ("attribute", "map_shape", 0, 5), ("attribute", "map_shape", 1, 6), ("variable", "map_shape", 0, regions), ("variable", "map_shape", 1, last)]
    return scan.map_shape(spark.createDataFrame(rows, "kind string, name string, position int, value long"))


@query("d15_point_overlap", "WITH p AS (SELECT c_custkey AS target_id, c_custkey * 7 % 45 + 2.25 - 0.75 AS x0, c_custkey * 3 % 35 + 2.75 - 0.75 AS y0 FROM customer), c AS (SELECT i, j FROM (SELECT unnest(generate_series(0, 49)) AS i), (SELECT unnest(generate_series(0, 39)) AS j)), o AS (SELECT target_id, CAST(j * 50 + i AS BIGINT) AS source, (least(x0 + 1.5, i + 1) - greatest(x0, i)) * (least(y0 + 1.5, j + 1) - greatest(y0, j)) AS weight FROM p JOIN c ON i < x0 + 1.5 AND i + 1 > x0 AND j < y0 + 1.5 AND j + 1 > y0) SELECT target_id, source, round((weight / sum(weight) OVER (PARTITION BY target_id))::DOUBLE, 6) AS weight FROM o WHERE weight > 0")
def _(spark, sf):
    points = _t(spark, sf, "customer").select(F.col("c_custkey").alias("target_id"), (F.col("c_custkey") * 7 % 45 + 2.25).alias("x"), (F.col("c_custkey") * 3 % 35 + 2.75).alias("y"))
    return _round(mapping.point_mapping(points, _GRID, "overlap", 1.5))


_REPAIR_SQL = "m AS (SELECT l_suppkey AS target_id, CAST((l_suppkey * 7 % 45 + l_linenumber % 3) + 50 * (l_suppkey * 3 % 35) AS BIGINT) AS source, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL), v AS (SELECT s AS source, s % 50 AS x, s // 50 AS y FROM (SELECT unnest(generate_series(0, 1999)) AS s) WHERE s % 3 = 1 AND s // 50 % 4 = 0), k AS (SELECT m.target_id, m.source, weight, v.source IS NOT NULL AS ok, sum(weight) OVER t AS a, sum(CASE WHEN v.source IS NOT NULL THEN weight END) OVER t AS g FROM m LEFT JOIN v USING (source) WINDOW t AS (PARTITION BY target_id)), e AS (SELECT target_id, max(a) AS a, round_even(sum(weight * (source % 50)) / sum(weight), 0) AS cx, round_even(sum(weight * (source // 50)) / sum(weight), 0) AS cy FROM k WHERE g IS NULL GROUP BY target_id), n AS (SELECT target_id, v.source, a FROM e, v QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY greatest(abs(x - cx), abs(y - cy)), (x - cx) ** 2 + (y - cy) ** 2, CASE WHEN abs(y - cy) >= abs(x - cx) THEN CASE WHEN y <= cy THEN 0 ELSE 1 END ELSE CASE WHEN x < cx THEN 2 ELSE 3 END END, CASE WHEN abs(y - cy) >= abs(x - cx) THEN x ELSE y END) = 1)"


@query("c12_repaired_mask", f"WITH {_REPAIR_SQL} SELECT target_id, source, round(weight * a / g, 6) AS weight FROM k WHERE ok UNION ALL SELECT target_id, source, round(a, 6) FROM n")
def _(spark, sf):
    at = F.col("l_suppkey") * 7 % 45 + F.col("l_linenumber") % 3 + 50 * (F.col("l_suppkey") * 3 % 35)
    weights = _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("target_id"), at.cast("long").alias("source")).agg(F.sum("l_quantity").alias("weight"))
    valid = spark.range(2000).where("id % 3 = 1 AND id div 50 % 4 = 0").withColumnRenamed("id", "source")
    return _round(mapping.with_source_mask(weights, valid, _GRID, "nearest"))


@query("m6_generated_local_mapping", "WITH m AS (SELECT l_suppkey AS target_id, CAST((l_partkey % 40) * 50 + l_orderkey % 50 AS BIGINT) AS source, sum(l_quantity) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0 GROUP BY ALL), k AS (SELECT *, source % 5 <> 0 AS ok, sum(weight) OVER (PARTITION BY target_id) AS a, sum(CASE WHEN source % 5 <> 0 THEN weight END) OVER (PARTITION BY target_id) AS g FROM m) SELECT CAST(dense_rank() OVER (ORDER BY target_id) - 1 AS BIGINT) AS position, target_id, source, round(weight * a / g, 6) AS weight FROM k WHERE ok AND target_id % 4 = 0")
def _(spark, sf):
    from .sources import mapping_table

    pixels = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("pixel_target"), (F.col("l_orderkey") % 50 + 0.5).alias("x"), (F.col("l_partkey") % 40 + 0.5).alias("y"), F.col("l_quantity").alias("area"))
    targets = _t(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("target_id"))
    frame = spark.range(2000).select(F.lit(0).alias("t"), F.col("id").alias("source"), F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(1.0).alias("x"))
    path = scratch.new_path(spark, "generated")
    mapping_table.save_mapping(mapping.generated(pixels, targets, _GRID, "drop", mapping.first_frame_valid(frame, "t", "source", "x")), path)
    held = mapping_table.load_mapping(spark, path, 2000)
    axes = spark.range(50).select((F.col("id") + 0.5).alias("x"), (F.col("id") % 40 + 0.5).alias("y"))
    wanted = lookup.with_positions(held.where("target_id % 4 = 0").select("target_id").distinct(), "target_id")
    return _round(mapping.local_for(held, _GRID, mapping.Grid.from_coordinates(axes, geographic=False), wanted).select("position", "target_id", "source", "weight"))


# --- schedules, contracts, flags ---------------------------------------------------------------------------------------


@query("f14_explicit_schedule", "WITH s AS (SELECT n_nationkey AS step, n_nationkey * 6 AS a, n_nationkey * 6 + CASE WHEN n_nationkey % 7 = 3 THEN 0 WHEN n_nationkey % 5 = 2 THEN 8 ELSE 5 END AS e FROM nation WHERE n_nationkey <> 13) SELECT CAST(step AS BIGINT) AS step, CASE WHEN step <> coalesce(lag(step) OVER (ORDER BY step) + 1, 0) THEN 'index' WHEN a >= e THEN 'empty' WHEN a < lag(e) OVER (ORDER BY step) THEN 'overlap' END AS problem FROM s QUALIFY problem IS NOT NULL")
def _(spark, sf):
    at = lambda h: F.timestamp_add("HOUR", h, F.lit(START).cast("timestamp_ntz")).cast("timestamp_ntz")
    n = F.col("n_nationkey").cast("int")
    long = F.when(n % 7 == 3, 0).when(n % 5 == 2, 8).otherwise(5)
    return schedule_problems(_t(spark, sf, "nation").where("n_nationkey <> 13").select(n.cast("long").alias("step"), at(n * 6).alias("start"), at(n * 6 + long).alias("end")))


@query("f16_agreed_contract", "SELECT TIMESTAMP '2024-01-01' + INTERVAL (min(r_regionkey)) DAY AS start, 86400.0::DOUBLE AS seconds, count(*) AS count FROM region")
def _(spark, sf):
    days = lambda df, c: df.select(F.timestamp_add("DAY", c.cast("int"), F.lit(START).cast("timestamp_ntz")).cast("timestamp_ntz").alias("t"))
    sources = {"region": days(_t(spark, sf, "region"), F.col("r_regionkey")), "nation": days(_t(spark, sf, "nation"), F.col("n_regionkey"))}
    found = agreed({name: Contract.of(df, "t") for name, df in sources.items()})
    return spark.createDataFrame([(found.start, found.interval.total_seconds(), found.count)], "start timestamp_ntz, seconds double, count long")


@query("m14_step_counts", "SELECT date_diff('day', min(d), max(d)) + 1 AS main, CAST(3 * 5 AS BIGINT) AS spin_up, date_diff('day', min(d), max(d)) + 1 + 3 * 5 AS total FROM (SELECT date_trunc('day', ts) AS d FROM events)")
def _(spark, sf):
    low, high = _events(spark, sf).select(DAY.start(F.col("ts")).alias("d")).agg(F.min("d"), F.max("d")).first()
    return spark.createDataFrame([step_counts(low, high, HOURS(24), (low, low + HOURS(96), 3))], "main long, spin_up long, total long")


@query("c13_output_start", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-11'")
def _(spark, sf):
    steps = _events(spark, sf).withColumn("step", F.datediff("ts", F.lit(START.date())))
    return after_spin_up(steps, "step", 10).select("event_id", "ts")


@query("m15_open_windows", f"WITH a AS ({_inner_sql(kinds=('mean', 'sum'))}) SELECT user_id, outer_start, max(i) AS time, count(*) AS n_inner, round(max(mean_), 6) AS max_mean, round(sum(sum_), 6) AS sum_sum FROM a WHERE outer_start + INTERVAL 5 DAY > TIMESTAMP '2024-01-17 06:00:00' GROUP BY ALL")
def _(spark, sf):
    return _round(statistics.open_windows(_events(spark, sf), ["user_id"], "ts", "value", DAY, _FIVE, ["max_mean", "sum_sum"], datetime(2024, 1, 17, 6)))


@query("j3_manual_flags", f"WITH d AS ({_DAILY_SQL}), f AS (SELECT *, step % 3 = 0 AS a, step % 9 = 0 AS b FROM d), w AS (SELECT *, sum(a::INT) OVER p - first_value(a::INT) OVER p AS \"inner\", sum(b::INT) OVER p - first_value(b::INT) OVER p AS \"outer\" FROM f WINDOW p AS (PARTITION BY user_id ORDER BY step ROWS UNBOUNDED PRECEDING)) SELECT user_id, CAST(\"outer\" AS BIGINT) AS \"outer\", round(max(m), 6) AS max_mean FROM (SELECT user_id, \"outer\", \"inner\", avg(v) AS m FROM w GROUP BY ALL) GROUP BY ALL")
def _(spark, sf):
    s = F.col("step")
    flags = _daily(spark, sf).withColumns({"first": s % 3 == 0, "last": s % 3 == 2, "outer_first": s % 9 == 0, "outer_last": s % 9 == 8})
    held = statistics.manual_windows(flags.withColumn("last", F.col("last") | F.col("outer_first")), ["user_id"], "step")
    low = held.groupBy("user_id", "outer", "inner").agg(F.avg("v").alias("m"))
    return _round(low.groupBy("user_id", "outer").agg(F.max("m").alias("max_mean")))


# --- results, state, streams -------------------------------------------------------------------------------------------


@query("b6_results", f"SELECT 'kept' AS name, CAST(k AS BIGINT) AS time_index, user_id, round(sum(v * (k + 1)), 5) AS total FROM ({_DAILY_SQL}), (SELECT unnest([0, 1]) AS k) GROUP BY k, user_id UNION ALL SELECT 'popped', NULL, user_id, round(sum(v) * 3, 5) FROM ({_DAILY_SQL}) GROUP BY user_id")
def _(spark, sf):
    held = results.Results(spark)
    total = _daily(spark, sf).groupBy("user_id").agg(F.sum("v").alias("v"))
    for k in range(3):
        held.put("total", total.select("user_id", F.round(F.col("v") * (k + 1), 5).alias("total")))
    popped = held.pop("total").select(F.lit("popped").alias("name"), F.lit(None).cast("long").alias("time_index"), "user_id", "total")
    return held.get("total").select(F.lit("kept").alias("name"), "time_index", "user_id", "total").unionByName(popped)


@query("j5_bundled_sources", "SELECT 'events' AS source, user_id AS key, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'orders', o_custkey, count(*) FROM orders GROUP BY ALL")
def _(spark, sf):
    from .streaming import steps, windows

    folder = scratch.new_path(spark, "bundle")
    _events(spark, sf).select(F.col("user_id").alias("key")).write.parquet(f"{folder}/events")
    _t(spark, sf, "orders").select(F.col("o_custkey").alias("key")).write.parquet(f"{folder}/orders")
    streams = {name: windows.file_stream(spark, f"{folder}/{name}", "key long") for name in ("events", "orders")}
    windows.run_to_table(steps.bundled(streams), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").groupBy("source", "key").agg(F.count("*").alias("n"))


@query("j8_prepared_tables", f"SELECT a.user_id, round(a.v / b.m, 6) AS share FROM (SELECT user_id, sum(v) AS v FROM ({_DAILY_SQL}) GROUP BY ALL) a, (SELECT avg(v) AS m FROM (SELECT user_id, sum(v) AS v FROM ({_DAILY_SQL}) GROUP BY ALL)) b")
def _(spark, sf):
    from .streaming.steps import Prepared

    prepared = Prepared()
    total = lambda: prepared.get("total", lambda: _daily(spark, sf).groupBy("user_id").agg(F.sum("v").alias("v")))
    mean = total().agg(F.avg("v")).first()[0]
    return _round(total().select("user_id", (F.col("v") / mean).alias("share")))


@query("j10_checked_state", "SELECT c_custkey, c_mktsegment, round(c_acctbal, 6) AS c_acctbal FROM customer")
def _(spark, sf):
    from .sources import state

    path = scratch.new_path(spark, "state")
    state.save_state(_t(spark, sf, "customer").select("c_custkey", "c_acctbal"), path, step="29")
    now = _t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return _round(state.load_state(spark, path, now, "c_custkey"))


@query("k5_named_values", "SELECT l_orderkey, l_linenumber, round((l_quantity - m) / (t - m) + 1e-9, 5) AS v FROM lineitem, (SELECT avg(l_quantity) AS m, max(l_quantity * 2) AS t FROM lineitem)")
def _(spark, sf):
    items = _t(spark, sf, "lineitem")
    known = expressions.constants(items, {"middle": "mean(l_quantity)", "top": "max(l_quantity * 2)"})
    out = expressions.with_virtual(items, {**known, "v": "(l_quantity - middle) / (top - middle)"})
    return out.select("l_orderkey", "l_linenumber", F.round(F.col("v") + 1e-9, 5).alias("v"))


# --- sinks, names, checks ----------------------------------------------------------------------------------------------


@query("a7_fortran_frames", f"SELECT CAST(t AS VARCHAR) AS file, source % n AS y, source // n AS x, round(CAST(x AS FLOAT)::DOUBLE + 1e-7, 3) AS value FROM ({_FRAMES_SQL}), (SELECT max(p_partkey) // 50 + 1 AS n FROM part)")
def _(spark, sf):
    from .sources import binary, mapping_table

    frames = _frames(spark, sf).withColumn("source", F.col("source").cast("int"))
    ny = frames.agg(F.max("source")).first()[0] // 50 + 1
    held = mapping_table.dense_frames(frames, "t", "source", "x", ny * 50, -9999.0)
    cells = binary.decoded(held.select(F.col("t").cast("string").alias("path"), F.col("frame").alias("content")), ny, 50, fortran=True)
    return cells.where("value > -999").select("file", "y", "x", F.round(F.col("value") + 1e-7, 3).alias("value"))


@query("b1_stream_append", "SELECT user_id, count(*) AS n, round(sum(value), 5) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    """Two runs of one query: the second appends what came since, nothing is repeated."""
    from .streaming import windows

    folder, events = scratch.new_path(spark, "append"), _events(spark, sf)
    for k in range(2):
        events.where(F.col("event_id") % 2 == k).write.mode("append").parquet(f"{folder}/in")
        windows.run_to_table(windows.file_stream(spark, f"{folder}/in", events.schema), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 5).alias("total"))


@query("b7_climatology_export", f"SELECT target_id, round(sum(weight * x) / 3, 3) AS value FROM ({_MAP_SQL}) JOIN ({_FRAMES_SQL}) USING (source) GROUP BY ALL")
def _(spark, sf):
    out = statistics.climatology(_frames(spark, sf), _weights(spark, sf), "t", "source", "x")
    return scratch.saved(out, "climatology").withColumn("value", F.round("value", 3))


@query("b9_quantile_export", f"SELECT user_id, 0.5::DOUBLE AS level, round(quantile_cont(v, 0.5), 6) AS value FROM ({_DAILY_SQL}) GROUP BY user_id")
def _(spark, sf):
    path = scratch.new_path(spark, "quantiles")
    results.quantiles(_daily(spark, sf), ["user_id"], "v", [0.1, 0.5, 0.9]).write.partitionBy("level").parquet(path)
    return _round(spark.read.parquet(path).where("level = 0.5").select("user_id", "level", "value"))


@query("b10_mapped_export", f"SELECT CAST(t AS INTEGER) AS t, target_id, round(sum(weight * x), 3) AS value FROM ({_MAP_SQL}) JOIN ({_FRAMES_SQL}) USING (source) WHERE t = 1 GROUP BY ALL")
def _(spark, sf):
    path = scratch.new_path(spark, "mapped")
    mapping.apply_mapping(_frames(spark, sf), _weights(spark, sf), "t", "source", "x").write.partitionBy("t").parquet(path)
    return spark.read.parquet(path).where("t = 1").select("t", "target_id", F.round("value", 3).alias("value"))


@query("b12_merged_catalog", "SELECT s_suppkey, s_name, CAST(s_suppkey % 3 AS INTEGER) AS rank FROM supplier")
def _(spark, sf):
    path, supplier = scratch.new_path(spark, "catalog"), _t(spark, sf, "supplier").select("s_suppkey", "s_name")
    lookup.merged({r: supplier.where(F.col("s_suppkey") % 3 == r) for r in range(3)}, "s_suppkey").write.partitionBy("rank").parquet(path)
    return spark.read.parquet(path)


@query("b13_mapping_of_few_targets", f"SELECT target_id, source, round(weight, 6) AS weight FROM ({_MAP_SQL}) WHERE target_id IN (3, 5)")
def _(spark, sf):
    from .sources import mapping_table

    path = scratch.new_path(spark, "mapping")
    mapping_table.save_mapping(_weights(spark, sf), path)
    n = _t(spark, sf, "part").agg(F.max("p_partkey")).first()[0] + 1
    return _round(mapping_table.load_mapping(spark, path, n).where("target_id IN (3, 5)"))


@query("b16_compressed_years", "SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY ALL")
def _(spark, sf):
    path = scratch.new_path(spark, "years")
    tables.write_by_time(_t(spark, sf, "orders"), path, "o_orderdate", "year", compression="gzip")
    return tables.read_by_time(spark, path, None, "o_orderdate", "year", datetime(1996, 1, 1), datetime(1997, 1, 1)).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("c7_inclusive_range", "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS time, round(sum(value), 6) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-04' AND ts < TIMESTAMP '2024-01-09' GROUP BY ALL")
def _(spark, sf):
    daily = _events(spark, sf).groupBy("user_id", DAY.start(F.col("ts")).alias("t")).agg(F.sum("value").alias("v"))
    return _round(scan.scan(daily, ["user_id"], "t", "v", datetime(2024, 1, 4), datetime(2024, 1, 8), HOURS(24)))


@query("c14_valid_steps", f"SELECT user_id, CAST(30 AS BIGINT) AS valid, CAST(5 AS BIGINT) AS padded FROM ({_DAILY_SQL}) GROUP BY user_id")
def _(spark, sf):
    out = resample.chunked(_daily(spark, sf), ["user_id"], "step", "v", 7, 30)
    return out.groupBy("user_id").agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("padded"))


@query("c18_checked_casts", "SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_totalprice FROM orders")
def _(spark, sf):
    from .plans.schema import Field, conformed

    return conformed(_t(spark, sf, "orders"), [Field("o_orderkey", "int"), Field("o_custkey", "idx"), Field("o_totalprice", "hpfloat")])


@query("c19_valid_values", "SELECT event_type, count(*) FILTER (value <= 300 AND event_id % 5 <> 0) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    x = F.when(F.col("event_id") % 5 != 0, F.when(F.col("value") > 300, F.lit(float("nan"))).otherwise(F.col("value")))
    return _events(spark, sf).withColumn("x", x).groupBy("event_type").agg(F.count_if(resample.has_value(F.col("x"))).alias("n"))


@query("d4_aligned_tables", "SELECT c_custkey, c_mktsegment, round(2 * c_acctbal, 6) AS a, c_nationkey + 1 AS b FROM customer")
def _(spark, sf):
    customer = _t(spark, sf, "customer")
    parts = [customer.select("c_custkey", (F.col("c_acctbal") * 2).alias("a")), customer.select("c_custkey", (F.col("c_nationkey") + 1).alias("b"))]
    return _round(lookup.aligned(customer.select("c_custkey", "c_mktsegment"), parts, "c_custkey"))


SQL["e18_balanced_ranks"] = """
WITH RECURSIVE g AS (SELECT c_nationkey, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS i FROM customer GROUP BY 1
), s AS (
  SELECT 0::BIGINT AS i, [0, 0, 0, 0]::BIGINT[] AS loads, 0 AS c_nationkey, 0::BIGINT AS size, -1 AS rank
  UNION ALL
  SELECT g.i, [CASE WHEN k = list_position(loads, list_min(loads)) THEN loads[k] + g.size ELSE loads[k] END FOR k IN range(1, 5)], g.c_nationkey, g.size, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER)
  FROM s JOIN g ON g.i = s.i + 1
) SELECT c_nationkey, size, rank FROM s WHERE i > 0"""


@query("g4_positions_of_names", "SELECT s_name, row_number() OVER (ORDER BY s_name) - 1 AS position FROM supplier")
def _(spark, sf):
    return lookup.with_positions(_t(spark, sf, "supplier").select("s_name"), "s_name")


@query("g2_positions_or_miss", "SELECT l_orderkey, l_linenumber, coalesce(p, -7) AS position FROM lineitem LEFT JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS p FROM part WHERE p_size < 20) ON p_partkey = l_partkey")
def _(spark, sf):
    some = lookup.with_positions(_t(spark, sf, "part").where("p_size < 20").select("p_partkey"), "p_partkey")
    return lookup.positions_of(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", some, "p_partkey", -7).drop("l_partkey")


@query("h5_coordinate_union", "SELECT l_suppkey AS key FROM lineitem UNION SELECT s_suppkey FROM supplier UNION SELECT c_custkey FROM customer")
def _(spark, sf):
    keys = [("lineitem", "l_suppkey"), ("supplier", "s_suppkey"), ("customer", "c_custkey")]
    parts = [_t(spark, sf, t).select(F.col(c).alias("key")) for t, c in keys]
    return scan.axes(parts[0].unionByName(parts[1]).unionByName(parts[2]), "key")


@query("i9_result_names", "SELECT n AS name, regexp_extract(n, '^(.+)_rank(\\d+)(?:_(\\d{4}))?\\.\\w+$', 1) AS variable, CAST(regexp_extract(n, '_rank(\\d+)', 1) AS INTEGER) AS rank, CAST(nullif(regexp_extract(n, '_(\\d{4})\\.', 1), '') AS INTEGER) AS year FROM (SELECT 'q_' || n_name || '_rank' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '_' || (1990 + n_nationkey) ELSE '' END || '.parquet' AS n FROM nation)")
def _(spark, sf):
    n = F.col("n_nationkey")
    year = F.when(n % 2 == 0, F.concat(F.lit("_"), (n + 1990).cast("string"))).otherwise("")
    held = _t(spark, sf, "nation").select(F.concat(F.lit("q_"), "n_name", F.lit("_rank"), n.cast("string"), year, F.lit(".parquet")).alias("name"))
    return held.select("name", names.result_file(F.col("name")).alias("f")).select("name", "f.*")


@query("k2_pandas_form", "SELECT l_orderkey, l_linenumber, round(l_quantity * 2 + l_tax + 1e-9, 6) AS a, round(l_quantity * 2 + l_tax + 1e-9, 6) AS b FROM lineitem")
def _(spark, sf):
    from .functions.registry import Registry, Signature

    r, f = Registry(), lambda l_quantity, l_tax, by: l_quantity * by + l_tax
    r.register(Signature("mix", {"l_quantity": "double", "l_tax": "double"}, "double", ("by",)), f, f)
    items = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    out = r.apply(r.apply(items, "mix", "a", "expression", by=2.0), "mix", "b", "pandas", by=2.0)
    return out.select("l_orderkey", "l_linenumber", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in "ab"])


@query("l1_checked_model", "SELECT o_orderkey, o_custkey, CAST(c_nationkey AS INTEGER) AS c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey")
def _(spark, sf):
    from .plans.schema import Field, check_model

    tables_ = {t: _t(spark, sf, t) for t in ("orders", "customer", "nation")}
    fields = {"orders": [Field("o_orderkey", "int", "coordinate"), Field("o_custkey", "int", "reference", "customer.c_custkey")], "customer": [Field("c_custkey", "int", "coordinate"), Field("c_nationkey", "idx", "reference", "nation.n_nationkey")], "nation": [Field("n_nationkey", "idx", "coordinate")]}
    check_model(tables_, fields)
    return lookup.referenced(tables_["orders"].select("o_orderkey", "o_custkey"), "o_custkey", tables_["customer"], "c_custkey", "c_nationkey").select("o_orderkey", "o_custkey", "c_nationkey")


@query("l4_partition_checks", "SELECT 'leaves' AS problem, c_nationkey AS key FROM customer WHERE c_custkey % 2 <> c_nationkey % 2 GROUP BY ALL UNION ALL SELECT 'differs', n_nationkey FROM nation WHERE n_nationkey % 5 = 0")
def _(spark, sf):
    from .plans.schema import cross_rank_references, differing_replicas

    rank = lambda c: (F.col(c) % 2).cast("int")
    customer, nation = _t(spark, sf, "customer").withColumn("rank", rank("c_custkey")), _t(spark, sf, "nation")
    leaves = cross_rank_references(customer, "c_nationkey", nation.withColumn("rank", rank("n_nationkey")), "n_nationkey").select(F.lit("leaves").alias("problem"), F.col("c_nationkey").alias("key")).distinct()
    copies = lookup.trials(nation.select("n_nationkey", "n_name"), 3).withColumnRenamed("trial", "rank")
    copies = copies.withColumn("n_name", F.when((F.col("rank") == 1) & (F.col("n_nationkey") % 5 == 0), F.lit("?")).otherwise(F.col("n_name")))
    return leaves.unionByName(differing_replicas(copies, "n_nationkey", "n_name").select(F.lit("differs").alias("problem"), F.col("n_nationkey").alias("key")))


@query("l6_defaults", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN -1.5 ELSE c_acctbal END AS c_acctbal, 7 AS extra FROM customer")
def _(spark, sf):
    from .plans.schema import Field, conformed

    some = _t(spark, sf, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")))
    return conformed(some, [Field("c_custkey", "int"), Field("c_acctbal", "float", default=-1.5), Field("extra", "idx", default=7)])


from . import queries_planned, queries_stored  # noqa: E402, F401  register their queries
