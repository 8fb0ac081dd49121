"""State tables with a manifest: what was saved is what is loaded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import IntegrityError, aligned
from . import files


def _summary(state: DataFrame) -> DataFrame:
    """(rows, digest): the digest is a sum of row hashes, so it doesn't depend on the order of rows."""
    return state.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*sorted(state.columns)).cast("decimal(20,0)")).alias("digest"))


def save_state(state: DataFrame, path: str, open_windows: int = 0, **labels: str) -> None:
    """Write ``state`` to a folder of its own and, last, the manifest that names it (rows, digest, labels). Only between windows: an open one is an error.

    What a crash leaves behind is never read; saving again simply works. A path that has a manifest is not written again.
    """
    if open_windows:
        raise IntegrityError(f"{open_windows} windows are open; state is saved when all are closed")
    spark, rows = state.sparkSession, f"rows-{uuid.uuid4().hex}"
    state.write.parquet(f"{path}/{rows}")
    found = _summary(spark.read.parquet(f"{path}/{rows}")).first()
    if not files.publish(spark, f"{path}/manifest.json", {"rows": found["rows"], "digest": str(found["digest"]), "folder": rows, "labels": labels}):
        raise IntegrityError(f"{path} holds a state already")


def load_state(spark: SparkSession, path: str, now: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """The state of ``path``, checked against its manifest; with ``now``, dealt to its rows by ``key`` (the same keys on both sides)."""
    want = files.read_record(spark, f"{path}/manifest.json")
    if want is None:
        raise IntegrityError(f"{path} holds no state")
    rows = spark.read.parquet(f"{path}/{want['folder']}")
    got = _summary(rows).first()
    if (want["rows"], want["digest"]) != (got["rows"], str(got["digest"])):
        raise IntegrityError(f"{path}: {got['rows']} rows with digest {got['digest']}, the manifest has {want['rows']} with {want['digest']}")
    return rows if now is None else aligned(now, [rows.drop(*(set(now.columns) & set(rows.columns) - {key}))], key)
