"""Summed-area tables against overlaps, bundles that are run again, and layouts whose joins need no exchange."""

import random
from datetime import datetime, timedelta

import pytest
from meander.operators import mapping, summed_area
from meander.operators.lookup import IntegrityError
from meander.plans.temporal import Schedule
from meander.sources import bucketed, files
from meander.streaming.bundle import Bundle, Source
from pyspark.sql import functions as F

PLANE = mapping.Grid(mapping.Axis(-3.0, 0.5, 14), mapping.Axis(10.0, 2.0, 9))
GLOBE = mapping.Grid(mapping.Axis(-180.0, 20.0, 18, 360.0), mapping.Axis(-90.0, 15.0, 12), geographic=True)


@pytest.mark.parametrize("grid", [PLANE, GLOBE])
@pytest.mark.parametrize("mode", ["mean", "sum"])
def test_rectangles_equal_overlaps(spark, grid, mode):
    rng = random.Random(5)
    between = lambda axis: sorted(rng.choice([rng.uniform(axis.low, axis.high), axis.low + axis.width * rng.randrange(axis.n + 1)]) for _ in range(2))
    rows = []
    while len(rows) < 40:
        (a, b), (c, d) = between(grid.x), between(grid.y)
        if b - a > 1e-3 and d - c > 1e-3:
            rows.append((len(rows), a, b, c, d))
    rows += [(100, grid.x.low, grid.x.high, grid.y.low, grid.y.high), (101, grid.x.low, grid.x.low + grid.x.width / 3, grid.y.high - grid.y.width / 7, grid.y.high)]
    targets = spark.createDataFrame(rows, "target_id long, xmin double, xmax double, ymin double, ymax double")
    cells = [(t, k, rng.choice([rng.gauss(5, 3), rng.gauss(5, 3), None, float("nan")])) for t in range(3) for k in range(grid.x.n * grid.y.n) if rng.random() < 0.8]
    frames = spark.createDataFrame(cells, "t long, s long, v double")
    slow = mapping.apply_mapping(frames, mapping.rectangle_overlap(targets, grid, mode), "t", "s", "v", targets)
    want = {(r.t, r.target_id): r.value for r in slow.collect()}
    got = {(r.t, r.target_id): r.value for r in summed_area.rectangle_sums(frames, targets, grid, "t", "s", "v", mode).collect()}
    assert len(got) == 3 * len(rows)
    most = max(abs(v) for v in want.values())
    assert all(abs(got[k] - want[k]) <= 1e-9 * max(1, most) for k in want)
    assert summed_area.corner_mapping(targets, grid).groupBy("target_id").count().where("count > 16").count() == 0


def test_what_rectangles_refuse(spark):
    off = spark.createDataFrame([(7, -4.0, -2.0, 11.0, 12.0)], "target_id long, xmin double, xmax double, ymin double, ymax double")
    frames = spark.createDataFrame([(0, 0, 1.0)], "t long, s long, v double")
    with pytest.raises(Exception, match="not wholly on the grid: 7"):
        summed_area.rectangle_sums(frames, off, PLANE, "t", "s", "v").collect()
    with pytest.raises(ValueError):
        summed_area.rectangle_sums(frames, off, PLANE, "t", "s", "v", "median")
    assert summed_area.rectangle_sums(frames.limit(0), off.limit(0), PLANE, "t", "s", "v").collect() == []


DAY = timedelta(days=1)
T = lambda d, h=0: datetime(2024, 1, d, h)


@pytest.fixture
def bundle(spark, tmp_path):
    fine = spark.createDataFrame([(T(d, h), float(10 * d + h)) for d in range(1, 7) for h in (0, 6, 23)], "t timestamp_ntz, v double")
    rough = spark.createDataFrame([(T(1), 100.0), (T(4), 400.0)], "t timestamp_ntz, v double")
    fine.write.parquet(f"file://{tmp_path}/fine")
    rough.write.parquet(f"file://{tmp_path}/rough")
    make = lambda: Bundle(spark, f"file://{tmp_path}/b", Schedule(T(1), T(7), 2 * DAY), {"fine": Source(f"file://{tmp_path}/fine", fine.schema, "t", timedelta(hours=1)), "rough": Source(f"file://{tmp_path}/rough", rough.schema, "t", 3 * DAY, T(1))})
    return make, fine, tmp_path


def shown(rows):
    return {name: sorted(map(tuple, df.collect())) for name, df in rows.items()}


def test_cadences(spark, bundle):
    make, _, _ = bundle
    seen = []
    while make().next_step() < 3:
        make().run(lambda step, rows: seen.append(shown(rows)))
    assert [sorted({t.day for t, _ in s["fine"]}) for s in seen] == [[1, 2], [3, 4], [5, 6]]
    assert [[v for _, v in s["rough"]] for s in seen] == [[100.0], [100.0, 400.0], [400.0]]
    with pytest.raises(IntegrityError, match="not one of 3"):
        make().read(3)


def test_a_step_that_is_run_again_sees_the_same(spark, bundle):
    make, fine, folder = bundle
    seen = []

    def fails(step, rows):
        seen.append((step, shown(rows)))
        fine.where(F.col("t") < T(3)).write.mode("append").parquet(f"file://{folder}/fine")  # late rows
        raise ZeroDivisionError

    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            make().run(fails)
    assert make().next_step() == 0
    for f in (folder / "fine").iterdir():
        f.unlink()  # even if the files go
    assert make().run(lambda step, rows: seen.append((step, shown(rows)))) == 0 and make().next_step() == 1
    assert seen[0] == seen[1] == seen[2] and len(seen[0][1]["fine"]) == 6
    assert not files.exists(spark, f"file://{folder}/b/cache/0")


def test_lost_while_the_cache_was_written(spark, bundle, monkeypatch):
    make, fine, folder = bundle

    class Lost(BaseException):
        pass

    def lose(df):
        raise Lost

    with monkeypatch.context() as m:
        m.setattr(Bundle, "_digest", staticmethod(lose))
        with pytest.raises(Lost):
            make().read(0)
    fine.write.mode("append").parquet(f"file://{folder}/fine")  # files that the pinned list doesn't have
    assert len(shown(make().read(0))["fine"]) == 6
    # another step, pinned before files are changed
    make()._pinned(1)
    one = next(f for f in (folder / "fine").iterdir() if f.name.endswith(".parquet") and f.stat().st_size)
    one.unlink()
    with pytest.raises(IntegrityError, match="not as they were when the step was pinned"):
        make().read(1)


def test_changed_caches_are_refused(spark, bundle):
    make, fine, folder = bundle
    make().read(0)
    fine.limit(1).write.mode("append").parquet(f"file://{folder}/b/cache/0/fine")
    with pytest.raises(IntegrityError, match="cached rows of fine have changed"):
        make().read(0)


def test_layouts_need_no_exchange(spark):
    cells = spark.range(1000).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("t"), F.col("id").alias("source"), F.rand(1).alias("x"))
    weights = spark.range(3000).select((F.col("id") % 7).alias("target_id"), (F.col("id") % 1000).alias("source"), F.rand(2).alias("weight"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        count = lambda a, b: len(bucketed.exchanges(mapping.apply_mapping(a, b, "t", "source", "x")))
        a, b = bucketed.laid_out(cells, ["source"], 4), bucketed.laid_out(weights, ["source"], 4)
        assert count(cells, weights) == 3 and count(a, b) == 1  # only the grouping by time and target is left
        state = bucketed.laid_out(weights.groupBy("source").agg(F.sum("weight").alias("w")), ["source"], 4)
        assert bucketed.exchanges(state.join(a.groupBy("source").agg(F.sum("x").alias("s")), "source", "left")) == []
        got = {(r.t, r.target_id): r.value for r in mapping.apply_mapping(a, b, "t", "source", "x").collect()}
        # the same rows, dealt out anew
        want = {(r.t, r.target_id): r.value for r in mapping.apply_mapping(a.repartition(3), b.repartition(5), "t", "source", "x").collect()}
        assert got == pytest.approx(want) and len(got) == 14
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    with pytest.raises(ValueError):
        bucketed.laid_out(cells, [], 4)
