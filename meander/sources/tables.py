"""Parquet tables kept by time key, rank and year; listing and checking of result files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import result_file
from ..operators.lookup import IntegrityError

#: Formats of time keys.
TIME_KEYS = {"single": "''", "day": "yyyyMMdd", "month": "yyyy_MM", "year": "yyyy"}


def time_key(t: Column, kind: str | Callable[[Column], Column]) -> Column:
    """The key of a time: a named kind, or the caller's function, whose keys must sort as the times do."""
    if callable(kind):
        return kind(t).cast("string")
    return F.date_format(t, TIME_KEYS[kind]) if kind != "single" else F.lit("")


def write_by_time(df: DataFrame, path: str, time: str, kind: str | Callable[[Column], Column], *more: str, mode: str = "errorifexists", compression: str = "zstd") -> None:
    """One folder per time key (and per further column); rows of a key are gathered first, so files are few."""
    if compression not in ("none", "snappy", "gzip", "zstd", "lz4"):
        raise ValueError(f"unknown compression {compression}")
    keyed = df.withColumn("time_key", time_key(F.col(time), kind))
    # rebalanced, not repartitioned: a key with much of the data is split
    keyed.hint("rebalance", "time_key", *more).write.mode(mode).partitionBy("time_key", *more).option("compression", compression).parquet(path)


def read_by_time(spark: SparkSession, path: str, schema, time: str, kind: str | Callable[[Column], Column], start, end) -> DataFrame:
    """Rows with start <= time < end; only the folders of these keys are read."""
    df = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    low, high = (time_key(F.lit(t).cast("timestamp_ntz"), kind) for t in (start, end))
    pruned = df.where((F.col("time_key") >= low) & (F.col("time_key") <= high)) if kind != "single" else df
    return pruned.where((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)))


def listed(files: DataFrame, name: str = "name") -> DataFrame:
    """(variable, base, k, rank, year) of result-file names; k in numeric order for best-of-K variables."""
    found = files.withColumn("_f", result_file(F.col(name))).where("_f IS NOT NULL").select("_f.*")
    k = F.nullif(F.regexp_extract("variable", r"_(\d+)$", 1), F.lit("")).cast("int")
    return found.select("variable", F.regexp_replace("variable", r"_\d+$", "").alias("base"), k.alias("k"), "rank", "year")


def check_ranks(df: DataFrame, n_ranks: int, time: str, point: str) -> DataFrame:
    """``df`` (with column rank) if ranks 0 to n - 1 are all there with the same times, and each point is of one rank."""
    ranks = df.groupBy("rank").agg(F.count_distinct(time).alias("n"), F.min(time).alias("a"), F.max(time).alias("b"), F.sum_distinct(F.xxhash64(time).cast("decimal(38,0)")).alias("h"))
    found = ranks.collect()  # a row a rank
    if sorted(r["rank"] for r in found) != list(range(n_ranks)):
        raise IntegrityError(f"ranks {sorted(r['rank'] for r in found)}, not 0 to {n_ranks - 1}")
    if len({(r["n"], r["a"], r["b"], r["h"]) for r in found}) > 1:
        raise IntegrityError("ranks differ in their times")
    if shared := df.groupBy(point).agg(F.count_distinct("rank").alias("n")).where("n > 1").limit(5).collect():
        raise IntegrityError(f"points of several ranks: {[r[0] for r in shared]}")
    return df


def missing_keys(needed: DataFrame, there: DataFrame, kind: str, time: str, needed_time: str = "start") -> DataFrame:
    """(time_key): the keys of the needed times under which the table has nothing."""
    wanted = needed.select(time_key(F.col(needed_time), kind).alias("time_key")).distinct()
    return wanted.join(there.select(time_key(F.col(time), kind).alias("time_key")).distinct(), "time_key", "left_anti")
