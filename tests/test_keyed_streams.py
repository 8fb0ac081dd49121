"""Keyed stream state against the batch operators and plain Python."""

import math
import random
from datetime import datetime, timedelta

import pytest
from meander.operators import statistics
from meander.plans.temporal import CalendarWindow, IntervalWindow
from meander.sources import scratch
from meander.streaming import keyed, windows

from .comparing import plain

OPS = [f"{o}_{i}" for o in ("mean", "sum", "max", "min", "first", "last") for i in ("mean", "sum", "max", "min", "first", "last")] + ["argmax_mean", "argmin_last", "max3_sum", "min2_max", "argmax2_first", "argmin3_mean"]


@pytest.mark.parametrize("seed", range(3))
def test_folds(seed):
    """Slots against lists of all inner windows, NaN and ties among them."""
    rng = random.Random(seed)
    ops = keyed._ops(OPS)
    folds = keyed.Folds(ops)
    for size in (1, 2, 3, 8):
        inner = [[rng.choice([0.0, 1.0, -2.5, 7.0, math.nan]) for _ in range(rng.randrange(1, 4))] for _ in range(size)]
        slots = None
        for n, xs in enumerate(inner):
            w = None
            for k, x in enumerate(xs):
                w = keyed.merged(w, (x, 1, x, x, k, x, k, x))
            slots = folds.folded(slots, n, w)
        top = lambda xs: max(xs, key=lambda x: (x != x, x if x == x else 0))  # noqa: E731  NaN is the largest
        low = lambda xs: min(xs, key=lambda x: (x != x, x if x == x else 0))
        one = {"mean": lambda xs: sum(xs) / len(xs), "sum": sum, "max": top, "min": low, "first": lambda xs: xs[0], "last": lambda xs: xs[-1]}
        want = []
        for o in ops:
            values = [one[o.inner](xs) for xs in inner]
            if o.arg or o.k > 1:
                order = sorted(range(size), key=lambda k: (keyed._order(values[k], o.outer == "max"), k))[: o.k]
                found = order if o.arg else [values[k] for k in order]
                want.append(found[0] if o.k == 1 else found)
            else:
                want.append(one[o.outer](values))
        assert repr(folds.results(slots, size)) == repr(want)


def events(seed):
    rng, start = random.Random(seed), datetime(2024, 1, 28)
    rows = [(start + timedelta(seconds=rng.randrange(14 * 86_400)), rng.choice(["a", "b"]), rng.choice([1.0, 2.0, 2.0, 5.5, math.nan])) for _ in range(150)]
    return sorted({(t, p): (t, p, v) for t, p, v in rows}.values())


def test_streams_equal_batch(spark):
    keyed.prepare(spark)
    folder, rows = scratch.new_path(spark, "keyed"), events(1)
    inner, outer = CalendarWindow("day"), CalendarWindow("month")
    names = ["mean_sum", "argmax_mean", "max3_last", "argmin2_max", "last_first"]
    schema = "t timestamp_ntz, p string, v double"
    for part in (rows[:40], rows[40:41], rows[41:]):
        spark.createDataFrame([*part, (part[0][0], "a", None), (part[0][0], None, 1.0)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = windows.file_stream(spark, f"{folder}/in", spark.createDataFrame([], schema).schema, 1)
        windows.run_to_table(keyed.two_level_keyed(stream, ["p"], "t", "v", inner, outer, names), f"{folder}/out", f"{folder}/checkpoint")
        seen = spark.createDataFrame([r for r in rows if r[0] <= part[-1][0] and r[2] == r[2]], schema)
        batch = {(r.p, r.outer_start): [plain(x) if not isinstance(x, list) else [plain(y) for y in x] for x in r] for r in statistics.two_level(seen, ["p"], "t", "v", inner, outer, names).collect()}
        shown = lambda df: {(r.p, r.outer_start): [plain(x) if not isinstance(x, list) else [plain(y) for y in x] for x in r] for r in df.collect()}
        assert shown(spark.read.parquet(f"{folder}/out")) == {k: v for k, v in batch.items() if outer_end(k[1]) <= part[-1][0]}
        assert shown(keyed.open_windows(spark, f"{folder}/checkpoint", ["p"], names)) == {k: v for k, v in batch.items() if outer_end(k[1]) > part[-1][0]}
    assert any(outer_end(k[1]) <= rows[-1][0] for k in batch) and any(outer_end(k[1]) > rows[-1][0] for k in batch)


def test_points_share_state(spark):
    """Points of several types in two buckets: state rows follow the buckets, not the points; results are those of the batch."""
    keyed.prepare(spark)
    folder, rng = scratch.new_path(spark, "keyed"), random.Random(5)
    schema = "t timestamp_ntz, a timestamp, b binary, c date, d timestamp_ntz, v double"
    start, points = datetime(2024, 3, 1, 12), ["a", "b", "c", "d"]
    key = lambda k: (start + timedelta(microseconds=k), bytes([k, 255]), (start + timedelta(days=k)).date(), start - timedelta(microseconds=k))
    rows = [(start + timedelta(seconds=rng.randrange(15 * 86_400)), *key(rng.randrange(40)), rng.choice([1.1, 2.2, 3.3])) for _ in range(1500)]
    names = ["sum_mean", "max2_last", "argmin2_sum"]
    inner, outer = CalendarWindow("day"), IntervalWindow(timedelta(days=5))
    rows = sorted({(r[0], r[2]): r for r in rows}.values())
    for part in (rows[:700], rows[700:]):
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(f"{folder}/in")
        stream = windows.file_stream(spark, f"{folder}/in", spark.createDataFrame([], schema).schema, 1000)
        ran = windows.run_to_table(keyed.two_level_keyed(stream, points, "t", "v", inner, outer, names, buckets=2), f"{folder}/out", f"{folder}/checkpoint")
        assert all(p["stateOperators"][0]["numRowsTotal"] <= 4 * 2 for p in ran.recentProgress)  # values, timers
    found = spark.read.parquet(f"{folder}/out").unionByName(keyed.open_windows(spark, f"{folder}/checkpoint", points, names))
    want = statistics.two_level(spark.createDataFrame(rows, schema), points, "t", "v", inner, outer, names)
    assert dict(found.dtypes) == {"a": "timestamp", "b": "binary", "c": "date", "d": "timestamp_ntz", "outer_start": "timestamp_ntz", "time": "timestamp_ntz", "n_inner": "bigint", "sum_mean": "double", "max2_last": "array<double>", "argmin2_sum": "array<bigint>"}
    shown = lambda df: sorted((str(r.asDict() | {"sum_mean": round(r.sum_mean, 9)}) for r in df.select(sorted(df.columns)).collect()))
    assert shown(found) == shown(want) and want.count() > 100


def outer_end(start):
    return datetime(start.year + start.month // 12, start.month % 12 + 1, 1)


def test_what_flags_refuse(spark):
    keyed.prepare(spark)
    folder = scratch.new_path(spark, "keyed")
    rows = [(datetime(2024, 1, 1), 1, 1.0, True, False, True, False)]
    schema = "time timestamp_ntz, p long, v double, first boolean, last boolean, outer_first boolean, outer_last boolean"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/in")
    stream = windows.file_stream(spark, f"{folder}/in", spark.createDataFrame([], schema).schema)
    with pytest.raises(Exception, match="outer flags need the inner window's last step"):
        windows.run_to_table(keyed.flagged(stream, ["p"], "time", "v", ["max_mean"]), f"{folder}/out", f"{folder}/checkpoint")


def test_what_streams_refuse(spark):
    stream = spark.readStream.format("rate").load()
    for names in (["mean"], ["max_mid"]):
        with pytest.raises(ValueError):
            keyed.two_level_keyed(stream, ["value"], "timestamp", "value", CalendarWindow("day"), CalendarWindow("month"), names)
    with pytest.raises(ValueError, match="nest"):
        keyed.two_level_keyed(stream, ["value"], "timestamp", "value", CalendarWindow("day"), IntervalWindow(timedelta(hours=30)), ["max_mean"])
