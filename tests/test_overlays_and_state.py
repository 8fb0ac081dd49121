"""Overlays, scans, grids, state and results on hand-made frames: what must be refused, and cases that the queries lack."""

import hashlib
from datetime import datetime, timedelta

import pytest
from meander.functions import digests, expressions
from meander.operators import lookup, mapping, overlay, results, statistics
from meander.operators.lookup import IntegrityError
from meander.plans.temporal import CalendarWindow, Contract, Schedule, agreed, schedule_problems, step_counts
from meander.sources import files, mapping_table, scan, scratch, state
from meander.streaming.steps import Prepared
from pyspark.sql import functions as F

HOUR, DAY = timedelta(hours=1), timedelta(days=1)
T = lambda d, h=0: datetime(2024, 1, d, h)


def test_inflow_spans_and_shifted_reads(spark):
    nan = float("nan")
    series = {1: [nan, 1, 2, 3, 4, 5, nan, 7], 2: [0, 0, nan, 13, 14, 15, 16, nan], 3: [nan] * 8}
    rows = [(g, s, float(v)) for g, values in series.items() for s, v in enumerate(values)]
    gauges = spark.createDataFrame(rows, "point long, step long, value double")
    points = spark.createDataFrame([(1, 9), (2, 9), (3, 8)], "gauge long, basin long")
    flows, basins = overlay.inflow(gauges, points, 1, 8)
    # from step 1 on: gauge 1 has 0 to 4 of source steps 1 to 5, gauge 2 has 2 to 5; the last step is past the data and counts as 0
    assert sorted(tuple(r) for r in basins.collect()) == [(8, 7, 1), (9, 2, 3)]
    got = {(r.gauge, r.step): r.value for r in flows.collect()}
    assert [got[1, s] for s in range(8)] == [0, 0, 3, 4, 5, 0, 0, 0] and [got[2, s] for s in range(8)] == [0, 0, 13, 14, 15, 0, 0, 0]
    assert all(got[3, s] == 0 for s in range(8))
    read = {(r.window_start, r.gauge, r.offset): r.value for r in overlay.read_windows(flows, 4, 4, 0.0).collect()}
    assert [read[0, 1, k] for k in range(4)] == [3, 4, 5, 0] and [read[4, 2, k] for k in range(4)] == [0, 0, 0, 0]
    lost = {(r.gauge, r.step): r.value for r in overlay.loss(gauges, points, basins, 1, 8).collect()}
    assert [lost[1, s] for s in range(8)] == [1, 2, 3, 4, 5, None, 7, None]
    with pytest.raises(IntegrityError, match="without a gauge"):
        overlay.inflow(gauges, points.unionByName(spark.createDataFrame([(5, 9)], points.schema)), 0, 8)


def test_scan_rejects_times_off_the_grid_and_partial_shapes(spark):
    rows = spark.createDataFrame([(1, T(1), -3.0), (1, T(1, 1), None), (1, T(1, 2), 8.0), (1, T(2), 1.0)], "p long, t timestamp_ntz, v double")
    got = scan.scan(rows, ["p"], "t", "v", T(1), T(1, 2), HOUR, factor=2.0, clip=True).orderBy("time").collect()
    assert [(r.time, r.value) for r in got] == [(T(1), 0.0), (T(1, 1), 0.0), (T(1, 2), 4.0)]
    daily = scan.scan(rows, ["p"], "t", "v", T(1), T(1), HOUR, how="sum", width=DAY).collect()
    assert [(r.time, r.value) for r in daily] == [(T(1), 5.0)]
    with pytest.raises(Exception, match="step grid"):
        scan.scan(rows, ["p"], "t", "v", T(1), T(2), timedelta(hours=2)).collect()
    with pytest.raises(IntegrityError, match="rows are not"):
        scan.require_shape(rows.select("p", "t", "v").unionByName(spark.createDataFrame([(2, T(1), 0.0)], rows.schema)), "t", "p", "v")
    with pytest.raises(IntegrityError, match="besides"):
        scan.require_shape(rows.withColumn("x", F.lit(1)), "t", "p", "v")


def test_axes_are_found_or_refused(spark):
    even = spark.createDataFrame([(x + 0.5, y * 2.0) for x in range(4) for y in range(3)], "LON double, lat double")
    g = mapping.Grid.from_coordinates(even)
    assert (g.x.low, g.x.width, g.x.n, g.x.period, g.y.low, g.y.n, g.geographic) == (0.0, 1.0, 4, 360.0, -1.0, 3, True)
    with pytest.raises(IntegrityError, match="evenly"):
        mapping.Grid.from_coordinates(spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (3.0, 2.0)], "x double, y double"))
    turned = spark.createDataFrame([(i, j, i + 0.3 * j, float(j)) for i in range(3) for j in range(3)], "ix int, iy int, x double, y double")
    with pytest.raises(IntegrityError, match="not an axis"):
        mapping.Grid.from_coordinates(turned)
    with pytest.raises(IntegrityError, match="none of"):
        mapping.Grid.from_coordinates(even.withColumnRenamed("lat", "height"))
    other = mapping.Grid(mapping.Axis(0.5, 1.0, 4), g.y)
    held = spark.createDataFrame([(1, 0, 1.0)], "target_id long, source long, weight double")
    with pytest.raises(IntegrityError, match="anew"):
        mapping.local_for(held, g, other, spark.createDataFrame([(0, 1)], "position long, target_id long"))


def nearest_brute(cx, cy, valid, nx, ny, periodic):
    best = None
    for r in range(max(nx, ny) + 1):
        ring = [(dx, -r) for dx in range(-r, r + 1)] + [(dx, r) for dx in range(-r, r + 1)] * (r > 0)
        ring += [(-r, dy) for dy in range(-r + 1, r)] + [(r, dy) for dy in range(-r + 1, r)] * (r > 0)
        for dx, dy in ring:
            x, y = ((cx + dx) % nx if periodic else cx + dx), cy + dy
            if 0 <= x < nx and 0 <= y < ny and y * nx + x in valid:
                far = min(abs(dx), nx - abs(dx)) if periodic else abs(dx)
                d = far * far + dy * dy
                if best is None or d < best[0]:
                    best = d, y * nx + x
        if best:
            return best[1]


@pytest.mark.parametrize("period", [None, 9.0])
def test_nearest_cells_in_ring_order(spark, period):
    grid = mapping.Grid(mapping.Axis(0.0, 1.0, 9, period), mapping.Axis(0.0, 1.0, 7))
    for k in (3, 11, 31):
        valid = {s for s in range(63) if (s * 7 + k) % k == 0}
        points = [(p, p % 9, p // 9) for p in range(63)]
        got = mapping.nearest_cells(spark.createDataFrame(points, "target_id long, cx int, cy int"), spark.createDataFrame([(v,) for v in valid], "source long"), grid)
        assert {r.target_id: r.source for r in got.collect()} == {p: nearest_brute(x, y, valid, 9, 7, period is not None) for p, x, y in points}


def test_positions_follow_the_data(spark, monkeypatch):
    monkeypatch.setattr(lookup, "RANKED", 50)
    keys = [2**62, -(2**62), None] + [7] * 200 + list(range(100))
    got = lookup.with_positions(spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect()
    assert sorted(r.position for r in got if r.k is not None) == list(range(302)) and [r.position for r in got if r.k is None] == [None]
    order = [r.k for r in sorted((r for r in got if r.k is not None), key=lambda r: r.position)]
    assert order == sorted(k for k in keys if k is not None)


def test_middle_of_equal_times_and_missing_best(spark):
    rows = spark.createDataFrame([(1, T(1), 5.0), (1, T(1), 3.0), (1, T(1), 4.0), (2, T(1), None), (2, T(2), 2.0), (2, T(3), 2.0)], "p long, t timestamp_ntz, v double")
    day, month = CalendarWindow("day"), CalendarWindow("month")
    assert {r.p: r.mid for r in statistics.inner_windows(rows, ["p"], "t", "v", day, ["mid"]).where("inner_start = '2024-01-01'").collect()} == {1: 4.0, 2: None}
    best = {r.p: (r.max2_mean, r.argmax_mean) for r in statistics.two_level(rows, ["p"], "t", "v", day, month, ["max2_mean", "argmax_mean"]).collect()}
    assert best == {1: ([4.0], 0), 2: ([2.0, 2.0], 1)}


def test_flags_contracts_and_schedules(spark):
    flags = spark.createDataFrame([(1, 0, True, True, True, False), (1, 1, True, False, False, True)], "p long, t long, first boolean, last boolean, outer_first boolean, outer_last boolean")
    with pytest.raises(Exception, match="last step"):
        statistics.manual_windows(flags, ["p"], "t").collect()
    one = Contract(T(1), HOUR, 5)
    assert agreed({"a": one, "b": Contract(T(1), HOUR, 5)}) == one
    with pytest.raises(ValueError, match="differ in count"):
        agreed({"a": one, "b": Contract(T(1), HOUR, 6)})
    with pytest.raises(ValueError, match="gaps"):
        Contract.of(spark.createDataFrame([(T(1),), (T(2),), (T(4),)], "t timestamp_ntz"), "t")
    assert schedule_problems(Schedule(T(1), T(3), HOUR).frame(spark)).collect() == []
    assert step_counts(T(1), T(3), DAY) == (3, 0, 3)
    with pytest.raises(ValueError, match="whole steps"):
        step_counts(T(1), T(3, 5), DAY)


def test_state_is_checked(spark):
    table = spark.createDataFrame([(k, k * 0.5) for k in range(20)], "k long, v double")
    path = scratch.new_path(spark, "state")
    state.save_state(table.repartition(4), path, label="x")
    assert sorted(state.load_state(spark, path).collect()) == sorted(table.collect())
    folder = files.read_record(spark, f"{path}/manifest.json")["folder"]
    table.limit(1).write.mode("append").parquet(f"{path}/{folder}")
    with pytest.raises(IntegrityError, match="manifest"):
        state.load_state(spark, path)
    with pytest.raises(IntegrityError, match="already"):
        state.save_state(table, path)
    with pytest.raises(IntegrityError, match="no state"):
        state.load_state(spark, path + "-none")
    crashed = scratch.new_path(spark, "state")
    table.write.parquet(f"{crashed}/rows-of-a-writer-that-was-lost")
    state.save_state(table, crashed)
    assert state.load_state(spark, crashed).count() == 20
    with pytest.raises(IntegrityError, match="open"):
        state.save_state(table, scratch.new_path(spark, "state"), open_windows=2)


def test_scratch_tables_are_cleared(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scratch, "folder", lambda spark: str(tmp_path))
    assert scratch.saved(spark.range(3), "x").count() == 3 and list(tmp_path.rglob("*.parquet"))
    scratch.clear(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_results_and_prepared_tables(spark):
    held = results.Results(spark)
    for k in range(2):
        assert held.put("a", spark.range(k + 1)) == k
    assert sorted(tuple(r) for r in held.get("a").collect()) == [(0, 0), (0, 1), (1, 1)] and held.pop("a").count() == 2
    held.reset()
    with pytest.raises(IntegrityError, match="no finished"):
        held.pop("a")
    with pytest.raises(IntegrityError, match="no result"):
        held.get("b")
    built = []
    prepared = Prepared()
    for key in (1, 1, 2):
        prepared.get("t", lambda: built.append(1) or spark.range(3), key)
    assert len(built) == 2


def test_digests_stream(spark):
    rows = [(k % 3, k, f"t{k}") for k in range(3000)] + [(None, 1, "x"), (None, 2, None)]
    got = {r.g: r.digest for r in digests.sha256_by(spark.createDataFrame(rows, "g long, n long, s string").repartition(9), "g", ["n"], "s", "|").collect()}
    want = {g: hashlib.sha256("|".join(s or "" for k, _, s in rows if k == g).encode()).hexdigest() for g in (0, 1, 2, None)}
    assert got == want


def test_dense_frames_by_runs(spark):
    rows = [(t, i, float(t * 10 + i)) for t in range(5) for i in range(0, 40, 3)] + [(1, 1, None), (1, 2, float("nan"))]
    frames = mapping_table.dense_frames(spark.createDataFrame(rows, "t long, i int, v double"), "t", "i", "v", 40, -1.0, "<f8")
    import numpy as np

    for r in frames.collect():
        assert np.frombuffer(bytes(r.frame), "<f8").tolist() == [float(r.t * 10 + i) if i % 3 == 0 else -1.0 for i in range(40)]
    with pytest.raises(Exception, match="not in a grid"):
        mapping_table.dense_frames(spark.createDataFrame([(0, 40, 1.0)], "t long, i int, v double"), "t", "i", "v", 40, -1.0).collect()


def test_sources_must_agree(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, value double")
    with pytest.raises(Exception, match="only one source"):
        lookup.combined(a, a.limit(1), ["k"], "a + b").collect()
    assert sorted(tuple(r) for r in lookup.combined(a, a, ["k"], "a * b - 1").collect()) == [(1, 0.0), (2, 3.0)]
    with pytest.raises(IntegrityError, match="unknown keys"):
        lookup.subset(a, "k", spark.createDataFrame([(3,)], "k long"))
    with pytest.raises(IntegrityError, match="groups"):
        lookup.ranked_groups(a, "k", 2, most=1)
    with pytest.raises(expressions.ExpressionError):
        expressions.constants(a, {"x": "value + 1"})
    with pytest.raises(IntegrityError, match="size"):
        mapping.point_mapping(a, None, "overlap")
