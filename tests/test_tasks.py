"""Rows of a task do not grow with the table."""

from meander.operators import lookup, mapping
from meander.sources import mapping_table, scratch
from pyspark.sql import functions as F


def _most(df):
    """Rows of the fullest partition."""
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_integer_runs_are_dealt_by_size(spark):
    rows = spark.range(2_400_000).select((F.col("id") % 400).alias("k"), (F.expr("id div 800") * 2).alias("v"))  # each twice
    runs = lookup.integer_runs(rows, ["k"], "v")
    assert _most(runs) < 500_000
    assert runs.count() == 1_200_000 and runs.where("low <> high").count() == 0
    joined = lookup.integer_runs(rows.withColumn("v", F.expr("v div 2")), ["k"], "v")
    assert {(r.low, r.high) for r in joined.collect()} == {(0, 2999)} and joined.count() == 400


def test_mappings_are_dealt_by_size(spark):
    axis = spark.range(40).select((F.col("id") + 0.5).alias("x"), (F.col("id") + 0.5).alias("y"))
    grid = mapping.Grid.from_coordinates(axis, geographic=False)
    cell = F.col("id") % 1600
    pixels = spark.range(1_600_000).select(F.expr("id div 1600").alias("pixel_target"), (cell % 40 + 0.5).alias("x"), (F.floor(cell / 40) + 0.5).alias("y"), F.lit(1.0).alias("area"))
    targets = spark.range(1000).select(F.col("id").alias("target_id"))
    made = mapping.generated(pixels, targets, grid, "drop", spark.range(1600).select(F.col("id").alias("source")).where("source % 2 = 0"))
    assert _most(mapping.pixel_mapping(pixels, targets, grid)) < 800_000 and _most(made) < 400_000
    path = scratch.new_path(spark, "mapping")
    mapping_table.save_mapping(made, path)
    held = mapping_table.load_mapping(spark, path, 1600)
    assert len(held.inputFiles()) > 1 and held.agg(F.count("*"), F.sum("weight"), F.min("weight")).first()[:] == (800_000, 1_600_000.0, 2.0)
    wanted = lookup.with_positions(targets.where("target_id % 2 = 1"), "target_id")
    found = mapping.local_for(held, grid, grid, wanted)
    assert found.agg(F.count("*"), F.sum("position"), F.max("position")).first()[:] == (400_000, 800 * sum(range(500)), 499)
