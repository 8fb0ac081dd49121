"""Mask and point targets, coalesced mappings, callers' functions, times of ordinals: what the queries don't show."""

from datetime import datetime, timedelta

import pytest
from meander.operators import mapping, results, statistics
from meander.operators.lookup import IntegrityError
from meander.plans.temporal import CalendarWindow
from meander.sources import tables
from pyspark.sql import functions as F

GRID = mapping.Grid(mapping.Axis(10.0, 2.0, 4), mapping.Axis(0.0, 1.0, 3))
MASK = "ix int, iy int, inside boolean, number long"


def test_masks(spark):
    mask = spark.createDataFrame([(0, 0, True, 7), (3, 2, True, 8), (1, 1, False, 9), (2, 1, None, 10)], MASK)
    got = sorted(map(tuple, mapping.mask_targets(mask, GRID, F.col("inside")).collect()))
    assert got == [(0, 0, 11.0, 0.5, 10.0, 12.0, 0.0, 1.0), (11, 11, 17.0, 2.5, 16.0, 18.0, 2.0, 3.0)]
    assert sorted(r.target_id for r in mapping.mask_targets(mask, GRID, F.col("inside"), target_id="number").collect()) == [7, 8]
    # a target that is a cell of the grid is covered by that cell alone
    weights = mapping.rectangle_overlap(mapping.mask_targets(mask, GRID, F.col("inside")).drop("source"), GRID).collect()
    assert {(r.target_id, r.source, round(r.weight, 12)) for r in weights} == {(0, 0, 1.0), (11, 11, 1.0)}
    assert mapping.mask_targets(mask, GRID, F.lit(False)).collect() == []
    for bad, message in (([(4, 0, True, 1)], "off the grid: 4, 0"), ([(None, 0, True, 1)], "off the grid"), ([(0, 0, True, 1), (0, 0, True, 2)], "repeated")):
        with pytest.raises(Exception, match=message):
            mapping.mask_targets(spark.createDataFrame(bad, MASK), GRID, F.col("inside")).collect()


def test_points(spark):
    points = spark.createDataFrame([(1, 11.0, 0.5), (2, 12.0, 1.5)], "id long, lon double, lat double")
    assert mapping.point_targets(points, "lon", "lat", "id").columns == ["target_id", "x", "y"]
    got = sorted(map(tuple, mapping.point_targets(points, "lon", "lat", "id", 1.0).collect()))
    assert got == [(1, 11.0, 0.5, 10.5, 11.5, 0.0, 1.0), (2, 12.0, 1.5, 11.5, 12.5, 1.0, 2.0)]
    with pytest.raises(IntegrityError, match="repeated"):
        mapping.point_targets(points.unionByName(points), "lon", "lat", "id")


def test_coalesced(spark):
    rows = spark.createDataFrame([(1, 2, 0.5), (1, 2, 0.25), (1, 3, 1.0), (2, 2, 0.0)], "target_id long, source long, weight double")
    assert sorted(map(tuple, mapping.coalesced(rows).collect())) == [(1, 2, 0.75), (1, 3, 1.0), (2, 2, 0.0)]


def test_converters(spark):
    df = spark.range(3).withColumnRenamed("id", "p")
    assert sorted((r.p, r.x, r.y) for r in results.converted(df, "p", lambda p: (p * 2, F.lit(1))).collect()) == [(0, 0, 1), (1, 2, 1), (2, 4, 1)]
    with pytest.raises(TypeError, match="a converter gives integers"):
        results.converted(df, "p", lambda p: (p / 2, p))
    with pytest.raises(Exception, match="no place for 2"):
        results.converted(df, "p", lambda p: (F.when(p < 2, p), p)).collect()


def test_a_callers_time_key_prunes_folders(spark, tmp_path):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + timedelta(hours=7 * k), k) for k in range(40)], "t timestamp_ntz, k int")
    half = lambda t: F.concat(F.date_format(t, "yyyyMMdd"), F.when(F.hour(t) < 12, "a").otherwise("b"))
    tables.write_by_time(df, f"{tmp_path}/h", "t", half)
    a, b = start + timedelta(days=2), start + timedelta(days=4, hours=5)
    found = tables.read_by_time(spark, f"{tmp_path}/h", None, "t", half, a, b)
    assert sorted(r.k for r in found.collect()) == [k for k in range(40) if a <= start + timedelta(hours=7 * k) < b]
    assert len(found.inputFiles()) >= 1 and "PartitionFilters: [isnotnull(time_key" in found._jdf.queryExecution().executedPlan().toString()


def test_times_of_ordinals(spark):
    rows = [("a", datetime(2024, 1, d, 5), float(v)) for d, v in ((1, 3), (4, 9), (9, 1))] + [("a", datetime(2024, 2, 2), 5.0), ("b", datetime(2024, 1, 3), 2.0)]
    df = spark.createDataFrame(rows, "p string, t timestamp_ntz, v double")
    out = statistics.two_level(df, ["p"], "t", "v", CalendarWindow("day"), CalendarWindow("month"), ["argmax2_mean", "argmin_sum"])
    order = statistics.ordinals(df, ["p"], "t", CalendarWindow("day"), CalendarWindow("month"))
    best = {(r.p, r.outer_start.month, r.k): (r.ordinal, r.time) for r in statistics.arg_times(out, order, ["p"], "argmax2_mean").collect()}
    assert best == {("a", 1, 0): (1, datetime(2024, 1, 4)), ("a", 1, 1): (0, datetime(2024, 1, 1)), ("a", 2, 0): (0, datetime(2024, 2, 2)), ("b", 1, 0): (0, datetime(2024, 1, 3))}
    least = {(r.p, r.outer_start.month): r.time for r in statistics.arg_times(out, order, ["p"], "argmin_sum").collect()}
    assert least == {("a", 1): datetime(2024, 1, 9), ("a", 2): datetime(2024, 2, 2), ("b", 1): datetime(2024, 1, 3)}
