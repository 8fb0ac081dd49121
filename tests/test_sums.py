"""Sums whose order is free, and what ranks by them."""

import math
import random
from datetime import datetime
from itertools import permutations

import numpy as np
import pytest
from meander.functions import sums
from meander.operators import statistics
from meander.plans.temporal import CalendarWindow
from pyspark.sql import functions as F


@pytest.mark.parametrize("scale", [1e-8, 0.01, 1.0, 1e6])
def test_exact_sums(spark, scale):
    rng = random.Random(1)
    x = [rng.uniform(-1, 1) * scale for _ in range(2000)]
    high, middle, low = sums.split(np.array(x))
    assert all(h + m + r == y for h, m, r, y in zip(high, middle, low, x))
    for _ in range(2):
        rng.shuffle(x)
        assert spark.createDataFrame([(v,) for v in x], "v double").repartition(5).agg(sums.exact_sum(F.col("v"))).first()[0] == math.fsum(x)


def test_sums_of_odd_numbers(spark):
    for x, want in (([], None), ([None], None), ([None, 1.5], 1.5), ([1e300, 1e300, 2.0], 2e300), ([math.inf, 1.0], math.inf), ([math.inf, -math.inf], math.nan), ([math.nan, 1.0], math.nan), ([-math.inf, 1e20], -math.inf)):
        got = spark.createDataFrame([(v,) for v in x], "v double").agg(sums.exact_sum(F.col("v"))).first()[0]
        assert repr(got) == repr(want)


def test_ties_of_means_in_every_order(spark):
    """Two days of equal means; the order in which a day's values are added must not decide (it did: 60.32 + 110.86 + 17.23 + 45.71)."""
    rows = []
    for k, values in enumerate(permutations([60.32, 110.86, 17.23, 45.71])):
        rows += [(k, datetime(2024, 1, 1, 1), 59.71), (k, datetime(2024, 1, 1, 2), 57.35)] + [(k, datetime(2024, 1, 2, 1), v) for v in values]
    df = spark.createDataFrame(rows, "p long, t timestamp_ntz, v double").coalesce(1)
    out = statistics.two_level(df, ["p"], "t", "v", CalendarWindow("day"), CalendarWindow("month"), ["argmin2_mean", "argmax2_mean"])
    assert {(tuple(r.argmin2_mean), tuple(r.argmax2_mean)) for r in out.collect()} == {((0, 1), (0, 1))}
