"""Many windows and exact selection against plain Python, and what their plans must not hold."""

import bisect
import collections
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from meander.operators import results, selection
from meander.plans import temporal
from meander.plans.temporal import ExplicitWindows, attach_windows, overlapping
from pyspark.sql import functions as F

ZERO = datetime(2024, 1, 1)
WINDOWS = "name string, start timestamp_ntz, end timestamp_ntz"


def at(n):
    return ZERO + timedelta(seconds=n)


def drawn(seed, n):
    """Windows of very different lengths and gaps, some touching; most times in one of them, many equal, some on the borders."""
    rng, t, windows = random.Random(seed), 0, []
    for k in range(n):
        t += rng.choice([0, 0, 1, 500])
        length = rng.choice([1, 1, 2, 1000, 3])
        windows.append((f"w{k}", at(t), at(t + length)))
        t += length
    times = [at(rng.randrange(-5, t + 50)) for _ in range(400)] + [w[1] for w in windows[:50]] + [w[2] for w in windows[:50]] + [at(t // 2)] * 300 + [None]
    return windows, [(k, x, "name") for k, x in enumerate(times)]


@pytest.mark.parametrize("seed,n", [(1, 1), (2, 40), (3, 700)])
def test_windows_against_bisection(spark, seed, n):
    windows, rows = drawn(seed, n)
    starts = [w[1] for w in windows]
    want = collections.Counter()
    for k, t, name in rows:
        i = bisect.bisect_right(starts, t) - 1 if t else -1
        if i >= 0 and t < windows[i][2]:
            want[k, t, name, windows[i][0], windows[i][1]] += 1
    df = spark.createDataFrame(rows, "k long, t timestamp_ntz, name string")
    table = spark.createDataFrame(random.Random(seed).sample(windows, n), WINDOWS).repartition(3)
    got = attach_windows(df, "t", table.unionByName(spark.createDataFrame([("empty", at(3), at(3)), (None, None, None)], WINDOWS)))
    assert got.columns == ["k", "t", "name", "window", "window_start"] and collections.Counter(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert attach_windows(df, "t", table.limit(0)).collect() == [] and attach_windows(df.limit(0), "t", table).collect() == []


def test_many_explicit_windows_are_not_compared_pairwise(spark, monkeypatch):
    windows, rows = drawn(4, 30)
    df = spark.createDataFrame(rows, "k long, t timestamp_ntz, name string").drop("name")
    rule = ExplicitWindows(tuple(windows))
    few = sorted(map(tuple, rule.attach(df, "t").collect()))
    monkeypatch.setattr(temporal, "MOST_BROADCAST", 10)
    many = rule.attach(df, "t")
    assert sorted(map(tuple, many.collect())) == few and "NestedLoop" not in many._jdf.queryExecution().executedPlan().toString()


def test_overlapping_windows_are_found(spark):
    rows = [("a", at(0), at(10)), ("b", at(10), at(11)), ("c", at(4), at(5)), ("d", at(11), at(11)), ("e", at(20), at(90)), ("f", at(30), at(31)), ("g", at(40), at(41)), ("h", at(90), at(91))]
    table = spark.createDataFrame(rows, WINDOWS)
    assert sorted(r.name for r in overlapping(table).collect()) == ["c", "d", "f", "g"]
    assert overlapping(table.limit(0)).collect() == []


LEVELS = [0.0, 0.013, 0.1, 0.25, 0.5, 0.5, 0.75, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_selection_against_sorting(spark, bins):
    rng = random.Random(bins)
    groups = {
        "one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 50, "ties": [float(rng.randrange(3)) for _ in range(101)], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 308) for _ in range(60)],
        "near": [1.0 + k * 2**-52 for k in range(20)], "normal": [rng.gauss(0, 1) for _ in range(999)], "ends": [-1.7e308, 1.7e308, 0.0], None: [4.0, 8.0, 15.0],
    }
    rows = [(g, x, 1) for g, xs in groups.items() for x in xs] + [("none", None, 1), ("nan", float("nan"), 1), ("two", None, 1), ("two", float("nan"), 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double, _k0 int")
    got = {(r.g, r.level): r.value for r in selection.quantiles(df, ["g"], "x", LEVELS, bins).collect()}
    assert set(got) == {(g, q) for g in groups for q in LEVELS}
    for g, xs in groups.items():
        xs = sorted(xs)
        for q in LEVELS:
            p = q * (len(xs) - 1)
            low, high = xs[int(np.floor(p))], xs[int(np.ceil(p))]
            assert got[g, q] == low + (high - low) * (p - np.floor(p)) or (np.isinf(high - low) and p % 1), (g, q)


def test_selection_without_groups_equals_the_other(spark):
    df = spark.range(5000).select((F.hash("id") % 1000 / 8).alias("x"), F.lit("a").alias("level"))
    got = {r.level: r.value for r in selection.quantiles(df, [], "x", [0.2, 0.5, 0.77]).collect()}
    want = {r.level: r.value for r in results.quantiles(df.withColumn("k", F.lit(1)), ["k"], "x", [0.2, 0.5, 0.77]).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    assert selection.quantiles(df.limit(0), [], "x", [0.5]).collect() == []


def test_what_selection_refuses(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),)], "x double")
    with pytest.raises(Exception, match="infinite"):
        selection.quantiles(df, [], "x", [0.5]).collect()
    with pytest.raises(ValueError, match="levels"):
        selection.quantiles(df, [], "x", [1.5])


def test_wide_selections_are_joined_by_exchange(spark, monkeypatch):
    monkeypatch.setattr(selection, "MOST_BROADCAST", 2)
    df = spark.range(3000).select((F.col("id") % 7).alias("g"), (F.hash("id") % 977).cast("double").alias("x"))
    want = {(r.g, r.level): r.value for r in results.quantiles(df, ["g"], "x", [0.3, 0.5]).collect()}
    assert {(r.g, r.level): r.value for r in selection.quantiles(df, ["g"], "x", [0.3, 0.5], 8).collect()} == pytest.approx(want, abs=1e-9)
