"""Queries of schedules, names, requests and expressions, each applied to rows of the given tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import expressions
from .operators import mapping, results, statistics
from .plans import schema
from .plans.temporal import Schedule, crossing, micros, with_spin_up
from .queries import _FIVE, _GLOBE, _KINDS, _OUTER_SQL, DAY, HOURS, _events, _inner_sql, _round, _t, query
from .sources import scratch, tables
from .streaming import substeps

# --- schedules that last as long as the events -----------------------------------------------------------------------------


def _schedule(spark, sf, hours: int) -> Schedule:
    """Steps from the first event's day to the last event's second."""
    low, high = _events(spark, sf).agg(F.min(F.date_trunc("day", "ts")).cast("timestamp_ntz"), F.max(F.date_trunc("second", "ts")).cast("timestamp_ntz")).first()
    return Schedule(low, high, HOURS(hours))


def _steps_sql(hours: int) -> str:
    return f"b AS (SELECT date_trunc('day', min(ts)) AS low, date_trunc('second', max(ts)) AS high FROM events), s AS (SELECT i AS step, CAST(low + INTERVAL (i * {hours}) HOUR AS TIMESTAMP) AS start, CAST(least(low + INTERVAL ((i + 1) * {hours}) HOUR, high) AS TIMESTAMP) AS \"end\" FROM b, range((SELECT CAST(ceil(epoch(high - low) / {hours * 3600}) AS BIGINT) FROM b)) r(i))"


@query("f13_schedule", f"WITH {_steps_sql(7)} SELECT step, start, \"end\", count(event_id) AS n FROM s LEFT JOIN events ON ts >= start AND ts < \"end\" GROUP BY ALL")
def _(spark, sf):
    """The events of each step."""
    schedule = _schedule(spark, sf, 7)
    held = _events(spark, sf).groupBy(schedule.step_at(F.col("ts")).alias("step")).agg(F.count("*").alias("n"))
    return schedule.frame(spark).join(held, "step", "left").na.fill(0, ["n"])


#: From each event of a user to the next one.
_NEXT_SQL = "SELECT event_id, user_id, ts AS start, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS \"end\" FROM events"


def _between(spark, sf) -> DataFrame:
    following = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _events(spark, sf).select("event_id", "user_id", F.col("ts").alias("start"), following.alias("end")).where("end IS NOT NULL")


@query("f7_window_crossing", f"SELECT event_id FROM ({_NEXT_SQL}) WHERE date_trunc('day', start) <> date_trunc('day', \"end\" - INTERVAL 1 MICROSECOND)")
def _(spark, sf):
    return crossing(_between(spark, sf), DAY).select("event_id")


@query("j6_fixed_substeps", f"SELECT event_id, CAST(sub_step AS INTEGER) AS sub_step, round((epoch_us(\"end\") - epoch_us(start)) / 1e6 / 4.0 + 1e-8, 6) AS dt, (sub_step + 0.5)::DOUBLE / 4 AS midpoint FROM ({_NEXT_SQL}), (SELECT unnest([0, 1, 2, 3]) AS sub_step) WHERE \"end\" IS NOT NULL")
def _(spark, sf):
    steps = _between(spark, sf).withColumn("seconds", (micros(F.col("end")) - micros(F.col("start"))) / 1_000_000)
    return _round(substeps.fixed(steps, 4, "seconds").select("event_id", "sub_step", (F.col("dt") + 1e-8).alias("dt"), "midpoint"))


_SLOTS_SQL = f"{_steps_sql(24)}, p AS (SELECT step, 'spin_up' AS phase, CAST(c AS BIGINT) AS cycle, c * 5 + step AS slot FROM s, (SELECT unnest([0, 1]) AS c) WHERE step < 5 UNION ALL SELECT step, 'main', 2, 10 + step FROM s)"


def _slots(spark, sf) -> DataFrame:
    """Days of the events, the first five twice before."""
    return with_spin_up(_schedule(spark, sf, 24).frame(spark), 4, 2)


@query("f12_spin_up", f"WITH {_SLOTS_SQL} SELECT slot, phase, cycle, count(event_id) AS n, round(coalesce(sum(value), 0), 6) AS total FROM p JOIN s USING (step) LEFT JOIN events ON ts >= start AND ts < \"end\" GROUP BY ALL")
def _(spark, sf):
    """What each slot of the run reads."""
    held = _events(spark, sf).groupBy(_schedule(spark, sf, 24).step_at(F.col("ts")).alias("step")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = _slots(spark, sf).join(held, "step", "left").na.fill(0)
    return _round(out.select("slot", "phase", F.col("cycle").cast("long").alias("cycle"), "n", "total"))


@query("a21_time_slots", f"WITH {_SLOTS_SQL}, u AS (SELECT DISTINCT user_id FROM events), e AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS day FROM events WHERE ts < (SELECT high FROM b)) SELECT u.user_id, slot, day IS NOT NULL AS is_valid, phase = 'spin_up' AS is_spin_up FROM u CROSS JOIN (p JOIN s USING (step)) LEFT JOIN e ON e.user_id = u.user_id AND day = start")
def _(spark, sf):
    """For each user and slot of the run, whether the user has events then."""
    schedule = _schedule(spark, sf, 24)
    seen = _events(spark, sf).select("user_id", schedule.step_at(F.col("ts")).alias("step")).where("step IS NOT NULL").distinct().withColumn("is_valid", F.lit(True))
    every = _events(spark, sf).select("user_id").distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(schedule) - 1)).cast("array<long>")))
    held = every.join(seen, ["user_id", "step"], "left").join(F.broadcast(_slots(spark, sf)), "step")  # a row a slot
    return held.select("user_id", "slot", F.coalesce("is_valid", F.lit(False)).alias("is_valid"), (F.col("phase") == "spin_up").alias("is_spin_up"))


# --- names, requests, expressions ------------------------------------------------------------------------------------------------


@query("i5_cell_area", "SELECT p_partkey, p_partkey % 2000 AS source, round(6371007.2 ** 2 * radians(7.2) * (sin(radians(-90 + ((p_partkey % 2000) // 50 + 1) * 4.5)) - sin(radians(-90 + ((p_partkey % 2000) // 50) * 4.5))) / 1e6, 3) AS area FROM part")
def _(spark, sf):
    """The area of the cell of each part."""
    cells = _t(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 2000).alias("source"))
    (a, b), (c, d) = _GLOBE.x.edges(F.col("source") % 50), _GLOBE.y.edges(F.expr("source div 50"))
    return cells.select("p_partkey", "source", F.round(_GLOBE.area(a, b, c, d) / 1e6, 3).alias("area"))


@query("a13_list_results", "SELECT 'flow_max3_' || s_suppkey % 12 AS variable, 'flow_max3' AS base, CAST(s_suppkey % 12 AS INTEGER) AS k, CAST(s_suppkey AS INTEGER) AS rank, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 2000 + s_suppkey % 50 END AS INTEGER) AS year FROM supplier WHERE s_suppkey % 7 <> 3")
def _(spark, sf):
    """Result files of all suppliers, among others of another form."""
    k = F.col("s_suppkey")
    year = F.when(k % 2 == 0, F.concat(F.lit("_"), (k % 50 + 2000).cast("string"))).otherwise("")
    name = F.when(k % 7 == 3, F.concat(F.lit("notes"), k.cast("string"), F.lit(".txt"))).otherwise(F.concat(F.lit("flow_max3_"), (k % 12).cast("string"), F.lit("_rank"), k.cast("string"), year, F.lit(".parquet")))
    return tables.listed(_t(spark, sf, "supplier").select(name.alias("name")))


def _asked(n: int) -> tuple[str, str]:
    return _KINDS[n % 6], _KINDS[(n * 5 + n // 6) % 6]


@query("e6_operation_names", f"WITH a AS ({_inner_sql()}) " + " UNION ALL ".join(f"SELECT {n} AS n_nationkey, '{o}_{i}' AS name, user_id, outer_start, round({_OUTER_SQL[o].format(i + '_')}, 6) AS value FROM a GROUP BY user_id, outer_start" for n in range(25) for o, i in [_asked(n)]))
def _(spark, sf):
    """Each nation asks for an operation by name: names are parsed, all are computed in one pass, and each gets its own."""
    names = F.array(*map(F.lit, _KINDS))
    n = F.col("n_nationkey").cast("int")
    asked = _t(spark, sf, "nation").select("n_nationkey", F.concat_ws("_", F.get(names, n % 6), F.get(names, (n * 5 + F.expr("n_nationkey div 6")).cast("int") % 6)).alias("name"))
    wanted = sorted({r["name"] for r in asked.collect()})  # a nation's, 36 at most
    out = statistics.two_level(_events(spark, sf), ["user_id"], "ts", "value", DAY, _FIVE, wanted)
    long = out.select("user_id", "outer_start", F.explode(F.array(*(F.struct(F.lit(w).alias("name"), F.col(w).alias("value")) for w in wanted))).alias("x")).select("user_id", "outer_start", "x.*")
    return _round(long.join(F.broadcast(asked), "name").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "name", "user_id", "outer_start", "value"))


@query("g7_dependency_order", "SELECT l_orderkey, l_linenumber, round(l_quantity + 1, 6) AS a, round(l_quantity + 1 + l_tax, 6) AS c, round((l_quantity + 1 + l_tax) * 2, 6) AS b, round((l_quantity + 1 + l_tax) * 3, 6) AS d FROM lineitem")
def _(spark, sf):
    """Columns are added in the order that their references ask for, whatever the order in which they are written."""
    written = {"d": "b + c", "b": "c * 2", "a": "l_quantity + 1", "c": "a + l_tax"}
    items = _t(spark, sf, "lineitem")
    for name in expressions.dependency_order(written):
        items = expressions.with_virtual(items, {name: written[name]})
    return _round(items.select("l_orderkey", "l_linenumber", "a", "c", "b", "d"))


@query("l3_namespace", "SELECT c_custkey, c.c_name, n.n_name, r.r_name, n.n_regionkey FROM customer c JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey")
def _(spark, sf):
    """Bare names are resolved to the one table that has them."""
    modules = {m: _t(spark, sf, t) for m, t in (("c", "customer"), ("n", "nation"), ("r", "region"))}
    known = schema.namespace({m: df.columns for m, df in modules.items()})
    f = lambda name: F.col(known[name])
    joined = modules["c"].alias("c").join(modules["n"].alias("n"), f("c_nationkey") == f("n_nationkey")).join(modules["r"].alias("r"), f("n_regionkey") == f("r_regionkey"))
    return joined.select(*(f(name).alias(name) for name in ("c_custkey", "c_name", "n_name", "r_name", "n_regionkey")))


_REQUEST = {"max": ["l_quantity", {"net": "l_extendedprice * (1 - l_discount)"}], "sum": [("net", "l_extendedprice * (1 - l_discount)")]}


@query("l8_request", "SELECT l_suppkey, max(l_quantity) AS max_l_quantity, round(max(l_extendedprice * (1 - l_discount)), 6) AS max_net, round(sum(l_extendedprice * (1 - l_discount)) + 1e-7, 4) AS sum_net FROM lineitem GROUP BY 1")
def _(spark, sf):
    """A request's operations and aliases, carried out over lineitem by supplier."""
    found = schema.request(_REQUEST)
    items = expressions.with_virtual(_t(spark, sf, "lineitem"), {alias: e for _, alias, e in found if alias != e})
    how = {"max": F.max, "sum": lambda c: F.round(F.sum(c) + 1e-7, 4)}
    out = items.groupBy("l_suppkey").agg(*(how[op](alias).alias(f"{op}_{alias}") for op, alias, _ in found))
    return out.withColumn("max_net", F.round("max_net", 6))


# --- what callers supply, and times of ordinals ------------------------------------------------------------------------------------


@query("d26_best_times", f"WITH a AS ({_inner_sql(kinds=('mean',))}), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, outer_start ORDER BY i) - 1 AS n FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY user_id, outer_start ORDER BY mean_, n) - 1 AS k FROM b) SELECT user_id, outer_start, CAST(k AS INTEGER) AS k, n AS ordinal, i AS time FROM c WHERE k < 3")
def _(spark, sf):
    out = statistics.two_level(_events(spark, sf), ["user_id"], "ts", "value", DAY, _FIVE, ["argmin3_mean"])
    return statistics.arg_times(out, statistics.ordinals(_events(spark, sf), ["user_id"], "ts", DAY, _FIVE), ["user_id"], "argmin3_mean")


@query("k7_user_callables", "WITH b AS (SELECT date_trunc('day', min(ts)) + INTERVAL 8 DAY AS low FROM events) SELECT user_id // 40 AS x, user_id % 40 AS y, count(*) AS n, round(sum(value), 6) AS total FROM events, b WHERE ts >= low AND ts < low + INTERVAL 10 DAY GROUP BY ALL")
def _(spark, sf):
    """Files by a key that the caller makes of the time (the week of the year), and places that the caller makes of the point."""
    path = scratch.new_path(spark, "weeks")
    week = lambda t: F.concat_ws("w", F.year(t).cast("string"), F.lpad(F.floor((F.dayofyear(t) - 1) / 7).cast("string"), 2, "0"))
    tables.write_by_time(_events(spark, sf), path, "ts", week)
    low = _events(spark, sf).select(F.timestamp_add("DAY", F.lit(8), F.date_trunc("day", F.min("ts"))).cast("timestamp_ntz")).first()[0]
    found = tables.read_by_time(spark, path, None, "ts", week, low, low + HOURS(240))
    placed = results.converted(found, "user_id", lambda p: (F.floor(p / 40).cast("long"), p % 40))
    return _round(placed.groupBy("x", "y").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@query("m7_point_targets", "SELECT s_suppkey AS target_id, (s_suppkey % 50)::DOUBLE AS x, s_suppkey / 50.0::DOUBLE AS y, s_suppkey % 50 - 0.5::DOUBLE AS xmin, s_suppkey % 50 + 0.5::DOUBLE AS xmax, s_suppkey / 50.0::DOUBLE - 1 AS ymin, s_suppkey / 50.0::DOUBLE + 1 AS ymax FROM supplier")
def _(spark, sf):
    k = F.col("s_suppkey")
    points = _t(spark, sf, "supplier").select("s_suppkey", (k % 50).cast("double").alias("lon"), (k / 50).alias("lat"))
    return mapping.point_targets(points, "lon", "lat", "s_suppkey", (1.0, 2.0))
