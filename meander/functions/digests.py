"""Digests of ordered text, in bounded memory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def sha256_by(df: DataFrame, key: str, order: list[str], text: str, between: str = "") -> DataFrame:
    """(key, digest): SHA-256 of each key's texts in order, joined by ``between``.

    A key's rows are sorted by Spark and stream through the hash; none are gathered.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest is None or k != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = k, hashlib.sha256()
                else:
                    digest.update(between.encode())
                digest.update((t or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], batch.schema.field(0).type), pa.array([d for _, d in done], pa.string())], [key, "digest"])
            type_ = batch.schema.field(0).type
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], type_), pa.array([digest.hexdigest()], pa.string())], [key, "digest"])

    rows = df.select(key, text, *[c for c in order if c not in (key, text)]).repartition(key).sortWithinPartitions(key, *order)
    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, digest string")
