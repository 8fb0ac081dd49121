"""Rank files as NetCDF: written, planned, read by range, and refused when they are not what the catalog says."""

import json
import math
from datetime import datetime

import pytest
from meander.operators.lookup import IntegrityError
from meander.sources import netcdf, netcdf_source
from pyspark.sql import functions as F

DAYS = [datetime(2024, 1, d) for d in (1, 2, 4, 5)]


def frames(spark):
    rows = [(t, p, float(10 * k + p)) for k, t in enumerate(DAYS) for p in (0, 1, 2, 3, 5, 7, 10) if (k, p) != (1, 5)]
    return rows, spark.createDataFrame(rows, "t timestamp_ntz, p long, v double")


@pytest.fixture
def written(spark, tmp_path):
    rows, df = frames(spark)
    path = f"file://{tmp_path}/out"
    netcdf_source.write_ranks(df, path, "q", "t", "p", "v", 3, split=F.when(F.col("t") < DAYS[2], "a").otherwise("b"))
    return rows, path, tmp_path / "out"


def held(df):
    return sorted((r.time, int(r.point), r.q) for r in df.collect() if not math.isnan(r.q))


def test_round_trip_and_ranges(spark, written):
    rows, path, folder = written
    every = netcdf_source.read(spark, path, "q")
    assert held(every) == sorted(rows) and every.count() == 4 * 7  # a step without a value at a point has NaN there
    assert {r.file for r in every.select("file").distinct().collect()} == {f"q_rank{r}_{s}.nc" for r in range(3) for s in "ab"}
    some = netcdf_source.read(spark, path, "q", start=DAYS[1], end=DAYS[3], points=(2, 5))
    assert held(some) == sorted(r for r in rows if DAYS[1] <= r[0] < DAYS[3] and 2 <= r[1] <= 5)
    assert netcdf_source.read(spark, path, "q", start=datetime(2030, 1, 1)).collect() == []
    # the other reader, which holds whole files, sees the same
    assert sorted((r.time, int(r.point), r.value) for r in netcdf.variable(spark, str(folder), "q", ("time", "point"), "q_*.nc").collect() if not math.isnan(r.value)) == sorted(rows)


def test_partitions_follow_ranges(spark, written):
    _, path, _ = written
    count = lambda **o: netcdf_source.read(spark, path, "q", **o).rdd.getNumPartitions()
    assert count() == 6 and count(chunk=1) == 12  # six files of two steps
    assert count(chunk=1, start=DAYS[1], end=DAYS[3]) == 6 and count(start=DAYS[2]) == 3 and count(points=(6, 9)) == 2
    bounded = netcdf_source.read(spark, path, "q", pushdown="true", chunk=1).where((F.col("time") >= DAYS[3]) & (F.col("point") <= 0))
    assert bounded.rdd.getNumPartitions() == 1 and bounded.count() == 1


def test_a_table_filtered_in_two_ways_loses_nothing(spark, written):
    rows, path, _ = written
    every = netcdf_source.read(spark, path, "q")
    assert held(every.where(F.col("time") >= DAYS[3])) == sorted(r for r in rows if r[0] >= DAYS[3])
    assert held(every.where(F.col("time") < DAYS[1])) == sorted(r for r in rows if r[0] < DAYS[1])
    assert held(every) == sorted(rows)


def test_catalog(spark, written):
    _, path, _ = written
    got = {r.file: r for r in netcdf_source.listing(spark, path).collect()}
    one = got["q_rank1_b.nc"]
    assert (one.rank, one.split, one.steps, one.points, one.least_point, one.greatest_point, one["first"], one["last"]) == (1, "b", 2, 3, 1, 10, DAYS[2], DAYS[3])


def test_what_the_catalog_refuses(spark, written):
    _, path, folder = written
    listed = json.loads((folder / "_catalog.json").read_text())

    def refused(message, **changes):
        (folder / "_catalog.json").write_text(json.dumps(listed | changes))
        with pytest.raises(Exception, match=message):
            netcdf_source.read(spark, path, "q").collect()

    refused("version 9, not", version=9)
    refused("ranks \\[0, 2\\] of b", files=[f for f in listed["files"] if f["file"] != "q_rank1_b.nc"])
    refused("differ in their times", files=[f | ({"last_us": 0} if f["rank"] else {}) for f in listed["files"]])
    refused("not rank 2", files=[f | {"file": f["file"].replace("rank2", "rank1")} if f["rank"] == 2 else f for f in listed["files"]])
    (folder / "_catalog.json").write_text(json.dumps(listed))
    data = (folder / "q_rank0_a.nc").read_bytes()
    (folder / "q_rank0_a.nc").write_bytes(data[:-8])
    with pytest.raises(Exception, match="2 steps in the catalog, 2 committed, 2 in the header, 1 in the file"):
        netcdf_source.read(spark, path, "q").collect()
    (folder / "q_rank0_a.nc").write_bytes(data[:40])
    with pytest.raises(Exception, match="the header is cut off"):
        netcdf_source.read(spark, path, "q").collect()


def test_points_of_several_ranks_and_other_bad_rows(spark, tmp_path):
    _, df = frames(spark)
    with pytest.raises(ValueError, match="outside 2 ranks"):
        netcdf_source.write_ranks(df, f"{tmp_path}/x", "q", "t", "p", "v", 2, F.col("p"))
    with pytest.raises(ValueError, match="outside 3 ranks"):
        netcdf_source.write_ranks(df.withColumn("t", F.lit(None).cast("timestamp_ntz")), f"{tmp_path}/x", "q", "t", "p", "v", 3)
    with pytest.raises(Exception, match="two values of one time and point"):
        netcdf_source.write_ranks(df.unionByName(df), f"{tmp_path}/y", "q", "t", "p", "v", 3)
    assert not (tmp_path / "y" / "_catalog.json").exists() and not [f for f in (tmp_path / "y").iterdir() if f.name.endswith(".nc")]
    with pytest.raises(FileNotFoundError):
        netcdf_source.listing(spark, f"{tmp_path}/y")
    with pytest.raises(IntegrityError, match="points of several ranks"):
        netcdf_source.write_ranks(df, f"{tmp_path}/z", "q", "t", "p", "v", 2, F.when(F.col("t") < DAYS[1], 0).otherwise(1))
