"""Raw binary frames: files of ``ny * nx`` numbers per time, read through Spark's binaryFile source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decoded(files: DataFrame, ny: int, nx: int, dtype: str = "<f4", factor: float = 1.0, fortran: bool = False) -> DataFrame:
    """(file, frame, y, x, value) of (path, content): values divided by ``factor``. Content that isn't whole frames is an error."""
    item = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_buffer()
                if data.size % (ny * nx * item):
                    raise ValueError(f"{path}: {data.size} bytes are not whole frames of {ny} x {nx} x {item}")
                cubes = np.frombuffer(data, dtype).reshape(-1, ny * nx)
                for k, frame in enumerate(cubes):
                    y, x = np.divmod(np.arange(ny * nx), nx) if not fortran else np.divmod(np.arange(ny * nx), ny)[::-1]
                    columns = [pa.array([path.rpartition("/")[2]] * len(frame)), pa.array(np.full(len(frame), k)), pa.array(y), pa.array(x), pa.array(frame.astype(float) / factor)]
                    yield pa.RecordBatch.from_arrays(columns, ["file", "frame", "y", "x", "value"])

    return files.select("path", "content").mapInArrow(run, "file string, frame long, y long, x long, value double")


def frames(spark: SparkSession, path: str, ny: int, nx: int, dtype: str = "<f4", factor: float = 1.0, glob: str = "*.bin", fortran: bool = False) -> DataFrame:
    """The frames of all files of a folder."""
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path), ny, nx, dtype, factor, fortran)


def active_points(cells: DataFrame, ny: int, absent: int = -9999) -> DataFrame:
    """(point_id): ids x * ny + y of cells (x, y, value) that are not absent."""
    return cells.where(F.col("value") != absent).select((F.col("x") * ny + F.col("y")).alias("point_id"))
