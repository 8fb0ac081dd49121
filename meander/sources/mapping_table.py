"""Mappings, dense grids and merged tables as files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import IntegrityError, tasks_for
from . import scratch


def save_mapping(mapping: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Written by target, so that a few targets' rows are found in few files."""
    rows = scratch.saved(mapping.select("target_id", "source", "weight"), "unsorted")
    rows.repartitionByRange(tasks_for(rows), F.col("target_id")).sortWithinPartitions("target_id", "source").write.mode(mode).parquet(path)


def load_mapping(spark: SparkSession, path: str, n_sources: int | None = None) -> DataFrame:
    out = spark.read.schema("target_id long, source long, weight double").parquet(path)
    if n_sources is not None and (found := out.where((F.col("source") < 0) | (F.col("source") >= n_sources)).limit(1).collect()):
        raise IntegrityError(f"source {found[0].source} is not on the grid")
    return out


def dense_frames(df: DataFrame, time: str, index: str, value: str, size: int, fill: float, dtype: str = "<f4") -> DataFrame:
    """(time, frame): each time's grid as raw bytes, ``fill`` where there is no value. A frame is of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, frame, kind = None, None, None

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([frame.tobytes()], pa.binary())], [time, "frame"])

        for batch in batches:
            kind = batch.schema.field(0).type
            times, at = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            values = batch.column(2).cast(pa.float64()).to_numpy(zero_copy_only=False)
            if len(at) and not (0 <= at.min() and at.max() < size):
                raise ValueError(f"{index} {at.min()} to {at.max()} are not in a grid of {size}")
            runs = pc.run_end_encode(times)  # rows are sorted by time
            begin = 0
            for end, t in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                if frame is None or t != now:
                    if frame is not None:
                        yield whole()
                    now, frame = t, np.full(size, fill, dtype)
                there = np.isfinite(values[begin:end])
                frame[at[begin:end][there]] = values[begin:end][there]
                begin = end
        if frame is not None:
            yield whole()

    rows = df.select(time, index, value).repartition(time).sortWithinPartitions(time, index)
    return rows.mapInArrow(run, f"{time} {dict(df.dtypes)[time]}, frame binary")
