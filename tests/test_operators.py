"""Hand-computed frames, contracts and properties."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from meander.functions import calendars, expressions, registry
from meander.operators import lookup, mapping, parameters, resample, results, statistics
from meander.plans.temporal import CalendarWindow, EveryStep, ExplicitWindows, IntervalWindow, Schedule, check_nested, source_interval, timeline_problems
from meander.sources import binary, tables
from meander.streaming import substeps, windows
from pyspark.sql import functions as F

DAY, MONTH = CalendarWindow("day"), CalendarWindow("month")
T = lambda d, h=0: datetime(2024, 1, d, h)


def samples(spark, rows):
    return spark.createDataFrame(rows, "point long, t timestamp_ntz, x double, w double")


@pytest.mark.parametrize("name,parts", [("mean", ("mean", None, False, 1)), ("max_mean", ("mean", "max", False, 1)), ("argmax3_last", ("last", "max", True, 3)), ("min2_sum", ("sum", "min", False, 2)), ("mid", ("mid", None, False, 1))])
def test_operation_names(name, parts):
    op = statistics.operation(name)
    assert (op.inner, op.outer, op.arg, op.k) == parts


@pytest.mark.parametrize("name", ["", "median", "max_mean_min", "argmax", "max3", "mean3_max", "argmean_max", "mid_mean", "max_mid", "max_argmax", "max0_mean", "_max"])
def test_wrong_operation_names(name):
    with pytest.raises(ValueError):
        statistics.operation(name)


def test_ties_weights_and_ordinals(spark):
    rows = [(1, T(1), 4.0, 1.0), (1, T(1, 6), 1.0, 3.0), (1, T(2), 4.0, 1.0), (1, T(3), 2.0, 2.0), (1, T(3, 1), 6.0, 2.0)]
    out = statistics.two_level(samples(spark, rows), ["point"], "t", "x", DAY, MONTH, ["max_mean", "argmax_mean", "argmax_max", "max2_mean", "argmin2_mean", "sum_sum", "last_first"], "w").first()
    # daily means 1.75, 4, 4; the tie goes to the earlier day
    assert (out.max_mean, out.argmax_mean, out.argmax_max, out.max2_mean, out.argmin2_mean) == (4.0, 1, 2, [4.0, 4.0], [0, 1])
    assert (out.sum_sum, out.last_first, out.time, out.n_inner) == (7.0 + 4.0 + 16.0, 2.0, T(3), 3)


def test_fewer_windows_than_k_and_middle(spark):
    rows = [(1, T(1, h), float(h), 1.0) for h in range(4)]
    out = statistics.two_level(samples(spark, rows), ["point"], "t", "x", DAY, MONTH, ["max3_mean"]).first()
    assert out.max3_mean == [1.5]
    assert statistics.inner_windows(samples(spark, rows), ["point"], "t", "x", DAY, ["mid"]).first().mid == 2.0


def test_nan_is_the_largest(spark):
    out = statistics.inner_windows(samples(spark, [(1, T(1), float("nan"), 1.0), (1, T(1, 1), 2.0, 1.0)]), ["point"], "t", "x", DAY, ["max", "min"]).first()
    assert np.isnan(out["max"]) and out["min"] == 2.0


@pytest.mark.parametrize("inner,outer", [(MONTH, DAY), (IntervalWindow(timedelta(hours=5)), DAY), (IntervalWindow(timedelta(days=1)), IntervalWindow(timedelta(hours=36))), (MONTH, IntervalWindow(timedelta(days=30))), (MONTH, CalendarWindow("year", 10, 15))])
def test_windows_that_do_not_nest(inner, outer):
    with pytest.raises(ValueError):
        check_nested(inner, outer)


def test_wrong_windows_and_schedules():
    for make in (lambda: CalendarWindow("week"), lambda: CalendarWindow("month", 2), lambda: CalendarWindow("year", 2, 29), lambda: Schedule(T(2), T(1), timedelta(1)), lambda: ExplicitWindows((("a", T(1), T(3)), ("b", T(2), T(4)))), lambda: ExplicitWindows((("a", T(1), T(1)),)), lambda: IntervalWindow(timedelta(0))):
        with pytest.raises(ValueError):
            make()


def test_water_year(spark):
    rule = CalendarWindow("year", 10, 1)
    df = spark.createDataFrame([(datetime(2023, 9, 30, 23),), (datetime(2023, 10, 1),), (datetime(2024, 2, 29),)], "t timestamp_ntz").select(rule.start(F.col("t")).alias("s"))
    assert [r.s.year for r in df.collect()] == [2022, 2023, 2023]


def test_last_step_is_cut(spark):
    s = Schedule(T(1), T(2), timedelta(hours=7))
    assert len(s) == 4 and s.frame(spark).orderBy("step").collect()[-1][1:] == (T(1, 21), T(2))
    assert s.index_at(T(1, 7)) == 1
    with pytest.raises(ValueError):
        s.index_at(T(1, 8))


def test_timeline_problems(spark):
    df = spark.createDataFrame([(T(1),), (T(1),), (T(3),)], "t timestamp_ntz")
    found = {(r.time, r.problem) for r in timeline_problems(df, "t", Schedule(T(1), T(4), timedelta(days=1))).collect()}
    assert found == {(T(1), "duplicate"), (T(2), "missing")}
    assert source_interval(df, "t").first()[:] == (2 * 86_400_000_000, True)


def test_conservation(spark):
    """What accumulates over steps equals what the source accumulated."""
    rows = [(1, datetime(2024, 1, 1) + timedelta(hours=6 * i), float(i * i), 1.0) for i in range(8)]
    schedule = Schedule(T(1), T(3), timedelta(hours=4))
    out = resample.conservative(samples(spark, rows), ["point"], "t", "x", T(1), timedelta(hours=6), schedule, accumulated=True)
    assert out.agg(F.sum("value")).first()[0] * 4 * 3600 == pytest.approx(sum(i * i for i in range(8)))


def test_hold_across_a_border_is_an_error(spark):
    rows = [(1, datetime(2024, 1, 1) + timedelta(hours=6 * i), 1.0, 1.0) for i in range(4)]
    with pytest.raises(Exception, match="border"):
        resample.hold(samples(spark, rows), ["point"], "t", "x", T(1), timedelta(hours=6), Schedule(T(1), T(2), timedelta(hours=4))).collect()


def test_linear_stops_at_the_last_sample(spark):
    rows = [(1, datetime(2024, 1, 1) + timedelta(hours=6 * i), float(i), 1.0) for i in range(3)]
    out = {r.step: r.value for r in resample.linear(samples(spark, rows), ["point"], "t", "x", T(1), timedelta(hours=6), Schedule(T(1), T(2), timedelta(hours=6))).collect()}
    assert out == {0: 0.5, 1: 1.5}


def test_runs_and_spans(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (1, 5), (1, 6), (2, 3)], "k long, step long")
    runs = resample.longest_runs(df, "k", "step")
    assert {tuple(r) for r in runs.collect()} == {(1, 0, 2), (2, 3, 1)}
    assert resample.common_spans(runs.withColumn("g", F.lit(1)), "g").first()[:] == (1, 3, 0)


def test_shift_and_fill(spark):
    df = spark.createDataFrame([(1, s, float(s)) for s in range(4)] + [(2, s, float(s)) for s in range(4)], "k long, step long, v double")
    shifts = spark.createDataFrame([(1, 2)], "k long, shift long")
    out = {(r.k, r.step): r.v for r in resample.shifted(df, "k", "step", "v", shifts, 4, None).collect()}
    assert out == {(1, 0): 2.0, (1, 1): 3.0, (1, 2): None, (1, 3): None, **{(2, s): float(s) for s in range(4)}}


def test_expressions(spark):
    df = spark.createDataFrame([(2.0, -7.0)], "a double, `m.b` double")
    out = expressions.with_virtual(df, {"c": "d ^ 2", "d": "a + 1", "e": "m.b % 3", "f": "1 if 0 < a <= 2 else 0", "g": "a / 0", "h": "not a > 1 or a == 2"}).first()
    assert (out.c, out.d, out.e, out.f, out.g, out.h) == (9.0, 3.0, 2.0, 1.0, None, True)
    assert expressions.names("where(m.b > pi, x, -y)") == {"m.b", "x", "y"}


@pytest.mark.parametrize("virtual", [{"c": "c + 1"}, {"c": "d", "d": "c"}, {"c": "zzz"}, {"c": "a +"}, {"c": "open('x')"}, {"c": "a[0]"}, {"c": "'text'"}, {"c": "max(a)"}])
def test_wrong_expressions(spark, virtual):
    with pytest.raises(expressions.ExpressionError):
        expressions.with_virtual(spark.createDataFrame([(1.0,)], "a double"), virtual)


def test_noleap_round_trip(spark):
    df = spark.range(0, 800).select(calendars.from_day_number(F.col("id") + 730_000, "noleap").alias("x"), "id")
    assert df.where(calendars.day_number(F.col("x.year"), F.col("x.month"), F.col("x.day"), "noleap") != F.col("id") + 730_000).count() == 0


def test_rectangles(spark):
    grid = mapping.Grid(mapping.Axis(0.0, 1.0, 4), mapping.Axis(0.0, 1.0, 4))
    targets = spark.createDataFrame([(1, 0.5, 1.5, 0.0, 1.0), (2, 2.0, 3.0, 2.0, 3.0)], "target_id long, xmin double, xmax double, ymin double, ymax double")
    assert {(r.target_id, r.source): r.weight for r in mapping.rectangle_overlap(targets, grid).collect()} == {(1, 0): 0.5, (1, 1): 0.5, (2, 10): 1.0}
    once = mapping.normalized(mapping.rectangle_overlap(targets, grid, "sum"))
    assert sorted(mapping.normalized(once).collect()) == sorted(once.collect())
    outside = spark.createDataFrame([(1, 3.5, 4.5, 0.0, 1.0)], targets.schema)
    with pytest.raises(Exception, match="wholly"):
        mapping.rectangle_overlap(outside, grid).collect()


def test_mask_repair(spark):
    grid = mapping.Grid(mapping.Axis(0.0, 1.0, 4), mapping.Axis(0.0, 1.0, 4))
    weights = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (2, 5, 2.0)], "target_id long, source long, weight double")
    valid = spark.createDataFrame([(1,), (11,), (4,)], "source long")
    out = {(r.target_id, r.source): r.weight for r in mapping.with_source_mask(weights, valid, grid).collect()}
    assert out == {(1, 1): 4.0, (2, 1): 2.0}  # cells 1 and 4 are both one step from 5: the smaller number
    with pytest.raises(Exception, match="no valid source"):
        mapping.with_source_mask(weights, valid, grid, "error").collect()


def test_periodic_axis(spark):
    globe = mapping.Axis(-180.0, 90.0, 4, 360.0)
    xs = [-180.0, 179.9, 180.0, 270.0, -190.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(globe.index(F.col("x")).alias("i"))
    assert [r.i for r in df.collect()] == [0, 3, 0, 1, 3]


def test_references(spark):
    a = spark.createDataFrame([(1,), (1,), (9,)], "k long")
    b = spark.createDataFrame([(1, 5), (2, 6)], "k long, v long")
    with pytest.raises(lookup.IntegrityError, match="9"):
        lookup.require_references(a, "k", b, "k")
    with pytest.raises(lookup.IntegrityError):
        lookup.require_unique(a, "k")
    with pytest.raises(lookup.IntegrityError):
        lookup.aligned(b, [spark.createDataFrame([(1, 7)], "k long, w long")], "k")
    with pytest.raises(lookup.IntegrityError):
        lookup.projected(b, ["k"], ["k"])
    assert [r.position for r in lookup.with_positions(b, "k").orderBy("k").collect()] == [0, 1]


def test_balance():
    assert lookup.balanced_ranks([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2) == [("a", 5, 0), ("b", 4, 1), ("c", 3, 1), ("d", 3, 0)]


def test_parameters(spark):
    log = spark.createDataFrame([(1, 0, "ADD", 1.0), (1, 2, "ADD", 5.0), (1, 2, "SET", 10.0), (1, 3, "ADD", 1.0)], "target long, step long, kind string, x double")
    assert [r.value for r in parameters.timeline(log, 100.0).orderBy("step").collect()] == [101.0, 15.0, 16.0]
    with pytest.raises(Exception, match="required"):
        parameters.copied_input(spark.createDataFrame([(1, 1, None)], "p long, s long, v double"), "v", "required", "p", "s").collect()


def test_results(spark):
    df = spark.createDataFrame([(T(1), 1, 2.0), (T(2), 1, 3.0)], "t timestamp_ntz, p long, v double")
    with pytest.raises(lookup.IntegrityError):
        results.in_time_range(df, "t", T(1), T(5))
    with pytest.raises(lookup.IntegrityError):
        results.series(df, "p", spark.createDataFrame([(0, 7)], "position int, p long"))


def test_ranks(spark):
    df = spark.createDataFrame([(T(1), 1, 0), (T(2), 1, 0), (T(1), 2, 1), (T(2), 2, 1)], "t timestamp_ntz, p long, rank int")
    assert tables.check_ranks(df, 2, "t", "p") is df
    for bad, n in ((df.where("NOT (p = 2 AND t > '2024-01-01 12:00:00')"), 2), (df, 3), (df.unionByName(df.withColumn("rank", 1 - F.col("rank"))), 2)):
        with pytest.raises(lookup.IntegrityError):
            tables.check_ranks(bad, n, "t", "p")


def test_binary_frames(spark, tmp_path):
    np.arange(12, dtype="<f4").tofile(tmp_path / "a.bin")
    out = binary.frames(spark, str(tmp_path), 2, 3, factor=2.0)
    assert {(r.frame, r.y, r.x): r.value for r in out.collect()}[1, 1, 2] == 5.5
    (tmp_path / "b.bin").write_bytes(b"12345")
    with pytest.raises(Exception, match="whole frames"):
        binary.frames(spark, str(tmp_path), 2, 3).collect()


def test_adaptive_substeps(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 3.0)], "k long, seconds double")
    out = substeps.adaptive(df, "seconds", lambda rows, t: np.full(len(rows), 4.0), 100.0)
    assert sorted((r.k, r.sub_step, r.dt) for r in out.collect()) == [(1, 0, 4.0), (1, 1, 4.0), (1, 2, 2.0), (2, 0, 3.0)]
    with pytest.raises(Exception, match="positive"):
        substeps.adaptive(df, "seconds", lambda rows, t: np.zeros(len(rows)), 100.0).collect()


def test_registry(spark):
    r, df = registry.Registry(), spark.createDataFrame([(2.0,)], "depth double")
    r.register(registry.Signature("scaled", {"depth": "double"}, "double", ("by",)), lambda depth, by: depth * by, lambda depth, by: depth * by)
    assert r.apply(df, "scaled", "y", by=3.0).first().y == r.apply(df, "scaled", "y", form="pandas", by=3.0).first().y == 6.0
    for bad in (lambda: r.apply(df, "scaled", "y"), lambda: r.apply(df.select(F.col("depth").cast("int")), "scaled", "y", by=1.0), lambda: r.apply(df, "none", "y")):
        with pytest.raises(ValueError):
            bad()


def test_ordered_steps(spark):
    steps = lambda *s: spark.createDataFrame([(x,) for x in s], "step long")
    assert windows.ordered_steps_only(steps(3, 4), 2) == 4
    for bad in (steps(5), steps(2, 3), steps(3, 5)):
        with pytest.raises(ValueError):
            windows.ordered_steps_only(bad, 2)


def test_every_step(spark):
    assert EveryStep().start(F.lit(T(1))) is not None


def test_schemas(spark):
    from meander.plans import schema

    df = spark.createDataFrame([(1, None, 2.5)], "k int, x double, y double")
    fields = [schema.Field("k", "int", "coordinate"), schema.Field("x", "float", default=7.0), schema.Field("z", "bool", default=True)]
    assert schema.conformed(df, fields).first()[:] == (1, 7.0, True)
    for bad in ([schema.Field("y", "int")], [schema.Field("missing", "float")]):
        with pytest.raises(lookup.IntegrityError):
            schema.conformed(df, bad)
    with pytest.raises(Exception, match="CAST_OVERFLOW|overflow"):
        schema.conformed(spark.createDataFrame([(2**40,)], "k long"), [schema.Field("k", "idx")]).collect()
    for make in (lambda: schema.Field("a", "text"), lambda: schema.Field("a", "int", "reference")):
        with pytest.raises(ValueError):
            make()
    assert schema.namespace({"river": ["depth", "id"], "lake": ["id"]}, ["total"]) == {"river.depth": "river.depth", "river.id": "river.id", "lake.id": "lake.id", "depth": "river.depth", "total": "total"}
    with pytest.raises(ValueError):
        schema.request({"mean": ["a", "a"]})
    with pytest.raises(ValueError):
        schema.request({"mean": [("q", "a")], "max": [("q", "b")]})


def test_managed_steps_resume_and_refuse_gaps(spark, tmp_path):
    from meander.streaming.steps import StepRunner

    def put(*steps):
        spark.createDataFrame([(s, float(s)) for s in steps], "step long, x double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    put(0, 1)
    initial = spark.createDataFrame([(0.0,)], "total double")
    advance = lambda state, batch: state.join(F.broadcast(batch.agg(F.sum("x").alias("x")))).select((F.col("total") + F.col("x")).alias("total"))
    runner = StepRunner(spark, f"{tmp_path}/run", initial, advance)
    run = lambda: runner.run(windows.file_stream(spark, f"{tmp_path}/in", "step long, x double"))
    run()
    put(2)
    last = run().lastProgress["batchId"]
    assert runner.state(last).first()[:] == (3.0, 2)
    put(4)
    with pytest.raises(Exception, match="do not follow"):
        run()


def test_dense_frames(spark):
    from meander.sources import mapping_table

    df = spark.createDataFrame([(1, 0, 5.0), (1, 3, float("nan")), (2, 2, 6.0)], "t long, i long, v double")
    got = {r.t: np.frombuffer(r.frame, "<f4").tolist() for r in mapping_table.dense_frames(df, "t", "i", "v", 4, -1.0).collect()}
    assert got == {1: [5.0, -1.0, -1.0, -1.0], 2: [-1.0, -1.0, 6.0, -1.0]}
    with pytest.raises(Exception, match="not in a grid"):
        mapping_table.dense_frames(df, "t", "i", "v", 3, -1.0).collect()


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1) + timedelta(hours=7 * i), float(i % 11), 1.0) for i in range(60)]
    samples(spark, rows).repartitionByRange(4, "t").sortWithinPartitions("t").write.parquet(f"{tmp_path}/in")
    source = windows.file_stream(spark, f"{tmp_path}/in", "point long, t timestamp_ntz, x double, w double", 10)
    out = windows.two_level_stream(source, ["point"], "t", "x", "1 day", "5 days", ["max_mean", "last_first", "sum_min"])
    windows.run_to_table(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    five = IntervalWindow(timedelta(days=5))
    batch = statistics.two_level(samples(spark, rows), ["point"], "t", "x", DAY, five, ["max_mean", "last_first", "sum_min"], drop_after=rows[-1][1])
    got = sorted(spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted(batch.select("point", "outer_start", "n_inner", "max_mean", "last_first", "sum_min").collect())
    assert got == want and len(got) == 4
    with pytest.raises(ValueError):
        windows.two_level_stream(source, ["point"], "t", "x", "1 day", "5 days", ["argmax_mean"])


def classic_file(records, lats, lons, values):
    """The bytes of a small NetCDF classic file with a record dimension, written out by hand."""
    import struct

    i = lambda *x: struct.pack(f">{len(x)}i", *x)
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: i(len(s)) + pad(s.encode())
    text = lambda k, v: name(k) + i(2, len(v)) + pad(v.encode())
    ny, nx = len(lats), len(lons)
    variables = [("time", [0], i(12, 1) + text("units", "hours since 2024-01-01"), 6, 8), ("lat", [1], i(0, 0), 6, 8 * ny), ("lon", [2], i(0, 0), 5, 4 * nx), ("q", [0, 1, 2], i(12, 2) + name("_FillValue") + i(3, 1) + pad(struct.pack(">h", -1)) + name("scale_factor") + i(6, 1) + struct.pack(">d", 0.5), 3, -(-2 * ny * nx // 4) * 4)]

    def head(begins):
        out = b"CDF\x01" + i(len(records)) + i(10, 3) + name("time") + i(0) + name("lat") + i(ny) + name("lon") + i(nx) + i(0, 0) + i(11, 4)
        for (n, dims, attributes, kind, size), begin in zip(variables, begins):
            out += name(n) + i(len(dims), *dims) + attributes + i(kind, size, begin)
        return out

    base = len(head([0] * 4))
    fixed = struct.pack(f">{ny}d", *lats) + struct.pack(f">{nx}f", *lons)
    first = base + len(fixed)
    body = b"".join(struct.pack(">d", t) + pad(struct.pack(f">{ny * nx}h", *v)) for t, v in zip(records, values))
    return head([first, base, base + 8 * ny, first + 8]) + fixed + body


def test_netcdf_classic(spark, tmp_path):
    from meander.sources import netcdf

    (tmp_path / "a.nc").write_bytes(classic_file([0.0, 6.0], [10.0, 20.0, 30.0], [1.0], [[2, 4, -1], [6, 8, 10]]))
    out = netcdf.variable(spark, str(tmp_path), "q", ("time", "lat", "lon")).collect()
    got = {(r.time, r.lat, r.lon): r.value for r in out}
    assert len(got) == 6 and got[T(1), 20.0, 1.0] == 2.0 and got[T(1, 6), 30.0, 1.0] == 5.0 and np.isnan(got[T(1), 30.0, 1.0])
    (tmp_path / "b.nc").write_bytes(b"HDF file")
    with pytest.raises(Exception, match="NetCDF classic"):
        netcdf.variable(spark, str(tmp_path), "q", ("time", "lat", "lon")).collect()


def test_positions_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(lookup, "RANKED", 10)
    keys = sorted({(k * 7919) % 1000 - 500 for k in range(130)})
    df = spark.createDataFrame([(k,) for k in reversed(keys)], "k long")
    assert [r.position for r in lookup.with_positions(df, "k").orderBy("k").collect()] == list(range(len(keys)))
    assert lookup.with_positions(df.limit(0), "k").collect() == []
