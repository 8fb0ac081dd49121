"""Session helpers: where intermediate tables go, and how a table is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_path, saved

__all__ = ["WORD_GAP", "held_out", "new_path", "saved", "table", "words"]

#: Words are runs of anything but these six ASCII characters.
WORD_GAP = r"[ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 2 modulo 4 are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def words(text: Column) -> Column:
    """array<string> of the words of ``text``; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")
