"""Queries of files with catalogs, keyed stream state, step logs, many windows and exact selection; registered with the others."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import mapping, selection, summed_area
from .plans.temporal import IntervalWindow, Schedule, at_micros, attach_windows, micros
from .queries import _FIVE as FIVE
from .queries import _FRAMES_SQL, _GRID, _MAP_SQL, _RECT_SQL, DAY, _corner, _events, _frames, _round, _t, _weights, query
from .sources import bucketed, files, netcdf_source, scratch
from .sources.changelog import ChangeLog
from .streaming import keyed, windows
from .streaming.bundle import Bundle, Source
from .streaming.steps import ChangeRunner

_DAYS = "SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS time, sum(value) AS value FROM events GROUP BY ALL"


def _daily_frames(spark, sf) -> str:
    """The path of NetCDF files of daily sums by user, in four ranks."""
    path = scratch.new_path(spark, "frames")
    daily = _events(spark, sf).groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("time")).agg(F.sum("value").alias("value"))
    netcdf_source.write_ranks(daily, path, "value", "time", "user_id", "value", 4)
    return path


@query("a1_netcdf_range", f"WITH d AS ({_DAYS}), b AS (SELECT min(time) AS low, max(user_id) // 2 AS top FROM d) SELECT 'value_rank' || user_id % 4 || '.nc' AS file, user_id, time, round(value, 6) AS value FROM d, b WHERE time >= low + INTERVAL 9 DAY AND time < low + INTERVAL 19 DAY AND user_id <= top")
def _(spark, sf):
    first, most = _events(spark, sf).agg(F.min(F.date_trunc("day", "ts")).cast("timestamp_ntz"), F.floor(F.max("user_id") / 2)).first()
    found = netcdf_source.read(spark, _daily_frames(spark, sf), "value", start=first + timedelta(days=9), end=first + timedelta(days=19), points=(0, most))
    return _round(found.where("NOT isnan(value)").select("file", F.col("point").cast("long").alias("user_id"), "time", "value"))


_MONTHS = "SELECT CAST(o_custkey % 4 AS INTEGER) AS rank, CAST(year(o_orderdate) AS VARCHAR) AS split, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, o_custkey AS p, sum(o_totalprice) AS v FROM orders GROUP BY ALL"


def _monthly_frames(spark, sf) -> str:
    path = scratch.new_path(spark, "frames")
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("m")
    monthly = _t(spark, sf, "orders").groupBy(month, "o_custkey").agg(F.sum("o_totalprice").alias("v"))
    netcdf_source.write_ranks(monthly, path, "total", "m", "o_custkey", "v", 4, split=F.year("m"))
    return path


@query("a12_checked_catalog", f"WITH d AS ({_MONTHS}), p AS (SELECT rank, CAST(count(DISTINCT p) AS INTEGER) AS points, min(p) AS least_point, max(p) AS greatest_point FROM d GROUP BY 1), t AS (SELECT split, CAST(count(DISTINCT m) AS INTEGER) AS steps, min(m) AS first, max(m) AS last FROM d GROUP BY 1) SELECT 'total_rank' || rank || '_' || split || '.nc' AS file, * FROM p, t")
def _(spark, sf):
    return netcdf_source.listing(spark, _monthly_frames(spark, sf))


@query("h4_files_of_a_range", f"WITH d AS ({_MONTHS}), p AS (SELECT rank, count(DISTINCT p) AS points FROM d GROUP BY 1), b AS (SELECT date_trunc('year', min(m)) + INTERVAL 14 MONTH AS low FROM d), t AS (SELECT split, count(DISTINCT m) AS steps FROM d, b WHERE m >= low AND m < low + INTERVAL 13 MONTH GROUP BY 1) SELECT 'total_rank' || rank || '_' || split || '.nc' AS file, points * steps AS cells FROM p, t")
def _(spark, sf):
    """The files that a range of times opens, and how many values of each are read."""
    low = _t(spark, sf, "orders").select(F.timestamp_add("MONTH", F.lit(14), F.date_trunc("year", F.min("o_orderdate"))).cast("timestamp_ntz").alias("a")).withColumn("b", F.timestamp_add("MONTH", F.lit(13), "a").cast("timestamp_ntz")).first()
    return netcdf_source.read(spark, _monthly_frames(spark, sf), "total", start=low["a"], end=low["b"]).groupBy("file").agg(F.count("*").alias("cells"))


# --- keyed stream state --------------------------------------------------------------------------------------------------


def _fed(spark, sf, folder: str, parts: int, run) -> list:
    """Events written in ``parts`` stretches of time, the stream run after each (one batch); what ``run(source)`` returns each time."""
    events, out = _events(spark, sf), []
    low, high = events.agg(F.min(F.date_trunc("day", "ts")), F.max("ts")).first()
    cut = [low + (high - low) * k / parts for k in range(parts)] + [None]
    for a, b in zip(cut, cut[1:]):
        later = events.where(F.col("ts") >= F.lit(a).cast("timestamp_ntz"))
        (later.where(F.col("ts") < F.lit(b).cast("timestamp_ntz")) if b else later).write.mode("append").parquet(f"{folder}/in")
        out.append(run(windows.file_stream(spark, f"{folder}/in", events.schema, 1_000_000)))
    return out


_BEST = "WITH a AS (SELECT user_id, CAST(time_bucket(INTERVAL 5 DAY, ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS outer_start, CAST(date_trunc('day', ts) AS TIMESTAMP) AS i, avg(value) AS m, max_by(value, ts) AS l FROM events GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, outer_start ORDER BY i) - 1 AS n FROM a)"


@query("j2_stream_best", f"{_BEST} SELECT user_id, outer_start, max(i) AS time, count(*) AS n_inner, CAST(min_by(n, (-m, n)) AS BIGINT) AS argmax_mean, round(min(m), 6) AS min_mean, round((list(l ORDER BY l DESC, n))[1], 6) AS best_last, round((list(l ORDER BY l DESC, n))[2], 6) AS second_last, (list(n ORDER BY m, n))[2] AS second_argmin FROM b WHERE outer_start + INTERVAL 5 DAY <= (SELECT max(ts) FROM events) GROUP BY ALL")
def _(spark, sf):
    folder = scratch.new_path(spark, "keyed")
    keyed.prepare(spark)

    def run(source):
        out = keyed.two_level_keyed(source, ["user_id"], "ts", "value", DAY, FIVE, ["argmax_mean", "min_mean", "max3_last", "argmin2_mean"])
        windows.run_to_table(out, f"{folder}/out", f"{folder}/checkpoint")

    _fed(spark, sf, folder, 3, run)
    named = spark.read.parquet(f"{folder}/out").select("user_id", "outer_start", "time", "n_inner", "argmax_mean", "min_mean", F.get("max3_last", 0).alias("best_last"), F.get("max3_last", 1).alias("second_last"), F.get("argmin2_mean", 1).alias("second_argmin"))
    return _round(named)


@query("m15_running_windows", "WITH c AS (SELECT min(date_trunc('day', ts)) AS low, max(ts) AS high FROM events), p AS (SELECT 0 AS part, low + (high - low) / 2 AS upto FROM c UNION ALL SELECT 1, NULL FROM c), e AS (SELECT part, events.* FROM events, p WHERE upto IS NULL OR ts < upto), a AS (SELECT part, user_id, CAST(time_bucket(INTERVAL 5 DAY, ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS outer_start, CAST(date_trunc('day', ts) AS TIMESTAMP) AS i, avg(value) AS m, sum(value) AS s FROM e GROUP BY ALL), w AS (SELECT part, max(ts) AS now FROM e GROUP BY 1) SELECT part, user_id, outer_start, max(i) AS time, count(*) AS n_inner, round(max(m), 6) AS max_mean, round(sum(s), 6) AS sum_sum FROM a JOIN w USING (part) WHERE outer_start + INTERVAL 5 DAY > now GROUP BY ALL")
def _(spark, sf):
    """The windows that are open after half of the events, and after all, read from the stream's state."""
    folder = scratch.new_path(spark, "keyed")
    keyed.prepare(spark)

    def run(source):
        out = keyed.two_level_keyed(source, ["user_id"], "ts", "value", DAY, FIVE, ["max_mean", "sum_sum"])
        windows.run_to_table(out, f"{folder}/out", f"{folder}/checkpoint")
        return scratch.saved(keyed.open_windows(spark, f"{folder}/checkpoint", ["user_id"], ["max_mean", "sum_sum"]), "open")

    first, then = _fed(spark, sf, folder, 2, run)
    return _round(first.withColumn("part", F.lit(0)).unionByName(then.withColumn("part", F.lit(1))))


@query("j3_flagged_stream", f"WITH d AS ({_DAYS}), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time) - 1 AS n FROM d), i AS (SELECT user_id, n // 9 AS \"outer\", n // 3 AS k, min(time) AS t, avg(value) AS m, sum(value) AS s, count(*) AS c FROM f GROUP BY ALL) SELECT user_id, CAST(\"outer\" AS BIGINT) AS \"outer\", max(t) AS time, count(*) AS n_inner, round(max(m), 6) AS max_mean, CAST(min_by(k % 3, (s, k)) AS BIGINT) AS argmin_sum FROM i GROUP BY user_id, \"outer\" HAVING sum(c) = 9")
def _(spark, sf):
    """Every three of a user's days are an inner window, every three of those an outer one, as flags say that the caller sets."""
    folder = scratch.new_path(spark, "keyed")
    keyed.prepare(spark)
    daily = _events(spark, sf).groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("time")).agg(F.sum("value").alias("value"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("time")) - 1
    flags = daily.withColumn("n", n).withColumns({"first": F.expr("n % 3 = 0"), "last": F.expr("n % 3 = 2"), "outer_first": F.expr("n % 9 = 2"), "outer_last": F.expr("n % 9 = 8")})
    for part in ("n < 13", "n >= 13"):  # a window is open in between
        flags.where(part).write.mode("append").parquet(f"{folder}/in")
        source = windows.file_stream(spark, f"{folder}/in", flags.schema, 1000)
        windows.run_to_table(keyed.flagged(source, ["user_id"], "time", "value", ["max_mean", "argmin_sum"]), f"{folder}/out", f"{folder}/checkpoint")
    return _round(spark.read.parquet(f"{folder}/out"))


# --- steps whose state is kept as changes ----------------------------------------------------------------------------------


def _totals(state, batch):
    """The users of a batch, with what it adds."""
    added = batch.groupBy("user_id").agg(F.sum("value").alias("added"), F.max("step").alias("seen"))
    return state.drop("seen").join(added, "user_id").select("user_id", (F.col("total") + F.col("added")).alias("total"), "seen")


def _stepped(spark, sf) -> tuple:
    """Events by day, counted from the first, and a log of totals by user in four ranks."""
    events = _events(spark, sf)
    first = events.agg(F.to_date(F.min("ts"))).first()[0]
    steps = events.withColumn("step", F.datediff("ts", F.lit(first)).cast("long"))
    folder = scratch.new_path(spark, "steps")
    log = ChangeLog(spark, f"{folder}/log", ["user_id"], 4, F.col("user_id") % 4, compact_every=2)
    initial = events.select("user_id").distinct().select("user_id", F.lit(0.0).alias("total"), F.lit(None).cast("long").alias("seen"))
    return steps, steps.agg(F.max("step")).first()[0], folder, log, initial


_DAYED = "WITH e AS (SELECT *, date_diff('day', (SELECT min(ts) FROM events), ts) AS step FROM (SELECT * REPLACE (CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts) FROM events))"


@query("j1_managed_steps", f"{_DAYED} SELECT user_id, round(sum(value) + 1e-7, 5) AS total, max(step) AS seen FROM e GROUP BY ALL")
def _(spark, sf):
    steps, last, folder, log, initial = _stepped(spark, sf)
    for k in range(last // 10 + 1):  # ten whole steps to a batch, in order, each in two files
        steps.where(F.expr(f"step div 10 = {k}")).repartition(2).write.mode("append").parquet(f"{folder}/in")
    ChangeRunner(log, initial, _totals).run(windows.file_stream(spark, f"{folder}/in", steps.schema, 2))
    log.verify()
    return log.state().select("user_id", F.round(F.col("total") + 1e-7, 5).alias("total"), "seen")


@query("j11_resumed_steps", f"{_DAYED} SELECT user_id, round(sum(value) + 1e-7, 5) AS total, max(step) AS seen FROM e GROUP BY ALL")
def _(spark, sf):
    """The runner stops after each batch of days, once half-way, and goes on from its state and cursor."""
    steps, last, folder, log, initial = _stepped(spark, sf)
    for k in range(last // 10 + 1):
        steps.where(F.expr(f"step div 10 = {k}")).repartition(2).write.mode("append").parquet(f"{folder}/in")
        if k == 1:  # as a driver leaves it that was lost between the phases of this step
            files.publish(spark, f"{log.folder}/running.json", {"step": k, "attempt": "lost"})
            log.prepare(k, "lost", log.state().withColumn("total", F.lit(0.0)))
        ChangeRunner(log, initial, _totals).run(windows.file_stream(spark, f"{folder}/in", steps.schema, 2))
    log.verify()
    return log.state().select("user_id", F.round(F.col("total") + 1e-7, 5).alias("total"), "seen")


@query("j10_state_by_rank", f"{_DAYED} SELECT CAST(user_id % 4 AS INTEGER) AS rank, count(*) AS rows, round(sum(total) + 1e-7, 4) AS total FROM (SELECT user_id, sum(value) AS total FROM e WHERE step <= (SELECT max(step) FROM e) // 2 GROUP BY 1 UNION ALL SELECT DISTINCT user_id, 0.0 FROM e WHERE user_id NOT IN (SELECT user_id FROM e WHERE step <= (SELECT max(step) FROM e) // 2)) GROUP BY 1")
def _(spark, sf):
    """Two steps are published, the second is taken back before its commit; what each rank then has."""
    steps, last, _, log, initial = _stepped(spark, sf)
    log.begin(initial)
    log.run(0, lambda state: _totals(state, steps.where(F.col("step") <= last // 2)))
    log.prepare(1, "never", _totals(log.state(), steps.where(F.col("step") > last // 2)))
    log.verify()
    return log.state().groupBy((F.col("user_id") % 4).cast("int").alias("rank")).agg(F.count("*").alias("rows"), F.round(F.sum("total") + 1e-7, 4).alias("total"))


# --- many windows, exact selection -------------------------------------------------------------------------------------------

_SPANS = "WITH b AS (SELECT epoch_us(min(ts)) AS low, (epoch_us(max(ts)) - epoch_us(min(ts))) // (SELECT max(o_orderkey) + 1 FROM orders) AS width FROM events)"


@query("d16_many_windows", f"{_SPANS}, w AS (SELECT o_orderkey, low + o_orderkey * width AS s, low + o_orderkey * width + width * (3 + o_orderkey % 5) // 8 AS e FROM orders, b) SELECT event_id, CAST(o_orderkey AS VARCHAR) AS \"window\", make_timestamp(s) AS window_start FROM (SELECT event_id, epoch_us(ts) AS us, (epoch_us(ts) - low) // width AS k FROM events, b) JOIN w ON o_orderkey = k AND us < e")
def _(spark, sf):
    """A window for every order, together as long as the events last, with gaps."""
    events, orders = _events(spark, sf), _t(spark, sf, "orders").select("o_orderkey")
    low, high = events.agg(F.min(micros(F.col("ts"))), F.max(micros(F.col("ts")))).first()
    width = (high - low) // (orders.agg(F.max("o_orderkey")).first()[0] + 1)
    start = F.lit(low) + F.col("o_orderkey") * width
    table = orders.select(F.col("o_orderkey").cast("string").alias("name"), at_micros(start).alias("start"), at_micros(start + F.expr(f"{width} * (3 + o_orderkey % 5) div 8")).alias("end"))
    return attach_windows(events.select("event_id", "ts"), "ts", table).drop("ts")


_LEVELS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
_QUANTILES = " ".join(f"WHEN {q} THEN quantile_cont(x, {q})" for q in _LEVELS)


@query("e14_one_group", f"SELECT level, round(CASE level {_QUANTILES} END, 6) AS value FROM (SELECT l_extendedprice AS x FROM lineitem), (SELECT unnest({list(_LEVELS)})::DOUBLE AS level) GROUP BY level")
def _(spark, sf):
    """All of lineitem is one group: selection by histograms, no buffer of values."""
    return _round(selection.quantiles(_t(spark, sf, "lineitem"), [], "l_extendedprice", list(_LEVELS)))


@query("e14_selected", f"SELECT l_suppkey, level, round(CASE level {_QUANTILES} END, 6) AS value FROM (SELECT l_suppkey, l_extendedprice * (1 - l_discount) AS x FROM lineitem), (SELECT unnest({list(_LEVELS)})::DOUBLE AS level) GROUP BY l_suppkey, level")
def _(spark, sf):
    items = _t(spark, sf, "lineitem").select("l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    return _round(selection.quantiles(items, ["l_suppkey"], "x", list(_LEVELS)))


# --- rectangles over many cells, steps that are run again ------------------------------------------------------------------------


@query("d11_summed_area", f"WITH f AS ({_FRAMES_SQL}), o AS (SELECT target_id, t, (least(x0 + 3.3, source % 50 + 1) - greatest(x0, source % 50)) * (least(y0 + 2.6, source // 50 + 1) - greatest(y0, source // 50)) AS weight, x FROM ({_RECT_SQL}) JOIN f ON source % 50 < x0 + 3.3 AND source % 50 + 1 > x0 AND source // 50 < y0 + 2.6 AND source // 50 + 1 > y0 WHERE source < 2000), v AS (SELECT t, target_id, sum(weight * x) / (3.3 * 2.6) AS value FROM o GROUP BY ALL) SELECT CAST(q.t AS BIGINT) AS t, s_suppkey AS target_id, round(coalesce(value, 0) + 1e-6, 4) AS value FROM supplier CROSS JOIN (SELECT unnest([0, 1, 2]) AS t) q LEFT JOIN v ON v.target_id = s_suppkey AND v.t = q.t")
def _(spark, sf):
    x, y = _corner()
    targets = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("target_id"), x.alias("xmin"), (x + 3.3).alias("xmax"), y.alias("ymin"), (y + 2.6).alias("ymax"))
    out = summed_area.rectangle_sums(_frames(spark, sf), targets, _GRID, "t", "source", "x")
    return out.withColumn("value", F.round(F.col("value") + 1e-6, 4))


@query("j5_retried_bundle", "WITH b AS (SELECT date_trunc('day', min(ts)) AS low FROM events), e AS (SELECT date_diff('day', low, date_trunc('day', ts)) // 5 AS step, event_type, value FROM events, b), r AS (SELECT step // 2 AS k, avg(value) AS rate FROM e GROUP BY 1) SELECT CAST(step AS INTEGER) AS step, event_type, count(*) AS n, round(sum(value) / any_value(rate), 5) AS total FROM e JOIN r ON k = step // 2 GROUP BY ALL")
def _(spark, sf):
    """Events by the day and a rate of every ten days, in steps of five. Every other step fails once, and rows come late before it is run again."""
    folder = scratch.new_path(spark, "bundle")
    events = _events(spark, sf)
    low, high = events.agg(F.min(F.date_trunc("day", "ts")).cast("timestamp_ntz"), F.max("ts")).first()
    events.write.parquet(f"{folder}/events")
    ten = IntervalWindow(timedelta(days=10), low).start(F.col("ts"))
    events.groupBy(ten.alias("at")).agg(F.avg("value").alias("rate")).write.parquet(f"{folder}/rates")
    days = lambda n: timedelta(days=n)
    sources = {"events": Source(f"{folder}/events", events.schema, "ts", days(1), low), "rates": Source(f"{folder}/rates", spark.read.parquet(f"{folder}/rates").schema, "at", days(10), low)}
    bundle = Bundle(spark, f"{folder}/bundle", Schedule(low, high + timedelta(microseconds=1), days(5)), sources)

    def body(step, rows):
        if step % 2 and not files.exists(spark, f"{folder}/late-{step}.json"):
            rows["events"].limit(50).withColumn("value", F.lit(1e6)).write.mode("append").parquet(f"{folder}/events")
            files.publish(spark, f"{folder}/late-{step}.json", {})
            raise InterruptedError
        total = rows["events"].withColumn("at", IntervalWindow(days(10), low).start(F.col("ts"))).join(rows["rates"], "at")
        total = total.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value") / F.max("rate"), 5).alias("total"))
        total.withColumn("step", F.lit(step)).write.mode("overwrite").parquet(f"{folder}/out/part={step}")

    while bundle.next_step() < len(bundle.schedule):
        try:
            bundle.run(body)
        except InterruptedError:
            continue
    return spark.read.parquet(f"{folder}/out").select("step", "event_type", "n", "total")


# --- layouts -----------------------------------------------------------------------------------------------------------------------


@query("d7_laid_out_mapping", f"SELECT t, target_id, round(sum(weight * x), 4) AS value FROM ({_MAP_SQL}) m JOIN ({_FRAMES_SQL}) f USING (source) GROUP BY ALL")
def _(spark, sf):
    """Frames and mapping are laid out by cell once; each frame's mapping joins them bucket by bucket."""
    frames = bucketed.laid_out(_frames(spark, sf), ["source"], 8, "frames")
    weights = bucketed.laid_out(_weights(spark, sf), ["source"], 8, "mapping")
    return mapping.apply_mapping(frames, weights, "t", "source", "x").withColumn("value", F.round("value", 4))


@query("d25_laid_out_state", "SELECT o_custkey AS c_custkey, count(*) AS n, round(any_value(c_acctbal) + sum(o_totalprice) + 1e-7, 4) AS balance FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def _(spark, sf):
    """State laid out by key is joined with rows of two steps that are laid out alike: the new state needs no exchange."""
    state = bucketed.laid_out(_t(spark, sf, "customer").select("c_custkey", F.lit(0).cast("long").alias("n"), F.col("c_acctbal").alias("balance")), ["c_custkey"], 8, "state")
    orders = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    for part in (0, 1):
        rows = bucketed.laid_out(orders.where(F.col("o_orderkey") % 2 == part), ["c_custkey"], 8, "rows")
        added = rows.groupBy("c_custkey").agg(F.count("*").alias("a"), F.sum("o_totalprice").alias("s"))
        state = state.join(added, "c_custkey", "left").select("c_custkey", (F.col("n") + F.coalesce("a", F.lit(0))).alias("n"), (F.col("balance") + F.coalesce("s", F.lit(0.0))).alias("balance"))
        state = bucketed.laid_out(state, ["c_custkey"], 8, "state")
    return state.where("n > 0").select("c_custkey", "n", F.round(F.col("balance") + 1e-7, 4).alias("balance"))
