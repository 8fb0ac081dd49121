"""Two-level windows over streams.

Two chained event-time aggregations in append mode: samples to inner windows,
inner windows to outer ones. Late samples are dropped by the watermark; an outer
window comes out when the watermark has passed it, so the last, open one does
not (it is partial).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.statistics import AGGREGATES, Operation, operation

#: What a stream can compute without keeping its samples.
_STREAMED = ("mean", "sum", "max", "min", "first", "last")


def _aggregate(kind: str, x: str, t: Column) -> Column:
    return {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[kind](x) if kind not in ("first", "last") else (F.min_by if kind == "first" else F.max_by)(x, t)


def two_level_stream(stream: DataFrame, points: list[str], time: str, value: str, inner: str, outer: str, operations: list[str], late: str = "0 seconds") -> DataFrame:
    """(points, outer_start, n_inner, a column per operation) of a stream, for windows like "1 day" and "5 days"."""
    ops: list[Operation] = [operation(o) for o in operations]
    if bad := [o.name for o in ops if o.outer is None or o.arg or o.k > 1 or o.inner not in _STREAMED]:
        raise ValueError(f"not for streams: {bad}")
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)  # watermarks need TIMESTAMP
    low = timed.groupBy(*points, F.window("_t", inner).alias("_w")).agg(*[_aggregate(k, value, F.col("_t")).alias(f"_{k}") for k in AGGREGATES if k in {o.inner for o in ops}])
    high = low.groupBy(*points, F.window(F.window_time("_w"), outer).alias("_o"))
    found = high.agg(F.count("*").alias("n_inner"), *[_aggregate(o.outer, f"_{o.inner}", F.col("_w.start")).alias(o.name) for o in ops])
    return found.select(*points, F.col("_o.start").cast("timestamp_ntz").alias("outer_start"), "n_inner", *[o.name for o in ops])


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files in the order they appear, so many to a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_table(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the stream's rows to a table of Parquet files, exactly once, as far as input is available."""
    query = out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ordered_steps_only(batch: DataFrame, last_step: int, step: str = "step") -> int:
    """For foreachBatch: the batch's last step, if its steps follow ``last_step`` without gap or repetition."""
    low, high, n = batch.agg(F.min(step), F.max(step), F.count_distinct(step)).first()
    if low is None:
        return last_step
    if low != last_step + 1 or high - low + 1 != n:
        raise ValueError(f"steps {low} to {high} ({n}) do not follow {last_step}")
    return high
