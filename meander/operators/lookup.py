"""Keys and references: positions, foreign keys, alignment, selections, groups to ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import with_virtual
from ..sources import scratch


class IntegrityError(ValueError):
    pass


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, count) of keys found more than once."""
    return df.groupBy(*keys).count().where("count > 1")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    if found := duplicates(df, *keys).orderBy(*keys).limit(5).collect():
        raise IntegrityError(f"repeated keys {[tuple(r)[:-1] for r in found]}")
    return df


def missing(df: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Keys of ``df`` that ``target`` lacks."""
    return df.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct().join(target.select(F.col(target_key).alias("key")), "key", "left_anti")


def require_references(df: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    if found := missing(df, key, target, target_key).orderBy("key").limit(5).collect():
        raise IntegrityError(f"{key}: no such {target_key}: {[r[0] for r in found]}")
    return df


#: Rows that are ranked in one window, about.
RANKED = 1_000_000


def tasks_for(df: DataFrame, rows: int = 500_000) -> int:
    """Among how many tasks ``df`` is dealt so that each gets about so many rows."""
    return df.count() // rows + 1


def with_positions(df: DataFrame, key: str, position: str = "position") -> DataFrame:
    """``df`` with each key's place in key order, from 0 (null for null keys): ranks within ranges, plus the sizes of those before.

    The ranges follow the data and may divide repeated keys, so an outlying or repeated key fills none of its own; they are
    written, so that all later steps see the same.
    """
    parts = df.count() // RANKED + 1
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(parts, F.asc_nulls_last(key), F.col("_tie")).withColumn("_part", F.spark_partition_id())
    dealt = scratch.saved(dealt, "ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row per RANKED rows
    before = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(F.asc_nulls_last(key), "_tie")) - 1
    place = F.when(F.col(key).isNotNull(), (F.col("_r") + F.col("_before")).cast("long"))
    return dealt.withColumn("_r", rank).join(before, "_part").withColumn(position, place).drop("_part", "_r", "_before", "_tie")


def positions_of(df: DataFrame, key: str, target: DataFrame, target_key: str, miss: int = -1) -> DataFrame:
    """``df`` with ``position``: where its key is in ``target`` (target_key, position), or ``miss``."""
    table = target.select(F.col(target_key).alias(key), "position")
    return df.join(table, key, "left").withColumn("position", F.coalesce("position", F.lit(miss).cast("long")))


def inverse_reference(target: DataFrame, target_key: str, df: DataFrame, key: str, position: str, fill: int = -1) -> DataFrame:
    """(target_key, position): the one row that refers to each target, or ``fill``."""
    rows = df.select(F.col(key).alias(target_key), F.col(position).alias("position"))
    return target.select(target_key).join(rows, target_key, "left").withColumn("position", F.coalesce("position", F.lit(fill).cast("long")))


def lineage(df: DataFrame, hops: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """``df`` with the root group of each row; hops are (foreign key, table, its key, its next foreign key)."""
    seen: set[int] = set()
    out = df.withColumn("group", F.col(hops[0][0]))
    for key, table, target_key, up in hops:
        if id(table) in seen:
            raise IntegrityError(f"the lineage returns to the table of {target_key}")
        seen.add(id(table))
        step = table.select(F.col(target_key).alias("group"), F.col(up).alias("_up"))
        out = out.join(step, "group").drop("group").withColumnRenamed("_up", "group")
    return out


def balanced_ranks(sizes: list[tuple[object, int]], ranks: int) -> list[tuple[object, int, int]]:
    """(group, size, rank): largest group first (then the smaller key), each to the least loaded rank (then the lowest)."""
    load, out = [0] * ranks, []
    for group, size in sorted(sizes, key=lambda g: (-g[1], g[0])):
        rank = min(range(ranks), key=lambda r: (load[r], r))
        load[rank] += size
        out.append((group, size, rank))
    return out


def ranked_groups(df: DataFrame, group: str, ranks: int, most: int = 1_000_000) -> DataFrame:
    """(group, size, rank) for a column of at most ``most`` groups (their sizes, not the rows, are balanced on the driver); more are an error."""
    sizes = [(r[0], r[1]) for r in df.groupBy(group).count().limit(most + 1).collect()]
    if len(sizes) > most:
        raise IntegrityError(f"more than {most} groups in {group}")
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame(balanced_ranks(sizes, ranks), f"{group} {kind}, size long, rank int")


def aligned(first: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """Tables of the same keys side by side; other key sets and repeated keys are errors."""
    out = require_unique(first, key)
    for other in others:
        require_unique(other, key)
        gaps = out.select(key).join(other.select(key), key, "left_anti").unionByName(other.select(key).join(out.select(key), key, "left_anti"))
        if found := gaps.limit(5).collect():
            raise IntegrityError(f"keys that not all tables have: {[r[0] for r in found]}")
        if both := (set(out.columns) & set(other.columns)) - {key}:
            raise IntegrityError(f"columns that several tables have: {sorted(both)}")
        out = out.join(other, key)
    return out


def projected(df: DataFrame, visible: list[str] | None = None, skip: list[str] = ()) -> DataFrame:
    """Only ``visible`` columns, or all but ``skip``; unknown and contradictory names are errors."""
    if unknown := [c for c in [*(visible or []), *skip] if c not in df.columns]:
        raise IntegrityError(f"unknown columns {unknown}")
    if both := set(visible or []) & set(skip):
        raise IntegrityError(f"visible and skipped: {sorted(both)}")
    return df.select(*(visible if visible is not None else [c for c in df.columns if c not in skip]))


def merged(ranks: dict[int, DataFrame], key: str) -> DataFrame:
    """Rank tables as one, with ``rank``; schemas must agree and keys be unique over all."""
    schemas = {r: df.schema.simpleString() for r, df in ranks.items()}
    if len(set(schemas.values())) > 1:
        raise IntegrityError(f"rank schemas differ: {schemas}")
    parts = [df.withColumn("rank", F.lit(r)) for r, df in sorted(ranks.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return require_unique(out, key)


def updated(df: DataFrame, column: str, value: Column | float, rows: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """``df`` with the column set on all rows, or on those whose key is in ``rows``."""
    value = value if isinstance(value, Column) else F.lit(value)
    if rows is None:
        return df.withColumn(column, value)
    chosen = rows.select(key).distinct().withColumn("_set", F.lit(True))
    return df.join(chosen, key, "left").withColumn(column, F.when(F.col("_set"), value).otherwise(F.col(column))).drop("_set")


def element_reduced(df: DataFrame, element: str, value: str, how: str) -> DataFrame:
    """(element, value): min, max or sum of each element over ranks."""
    return df.groupBy(element).agg({"min": F.min, "max": F.max, "sum": F.sum}[how](value).alias("value"))


def referenced(df: DataFrame, key: str, target: DataFrame, target_key: str, *columns: str) -> DataFrame:
    """``df`` with columns of the row it refers to; a key without target, or with several, is an error."""
    require_references(df, key, require_unique(target, target_key), target_key)
    return df.join(target.select(F.col(target_key).alias(key), *columns), key)


def subset(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is wanted; unknown keys are an error."""
    if found := missing(wanted, key, df, key).limit(5).collect():
        raise IntegrityError(f"unknown keys {[r[0] for r in found]}")
    return df.join(wanted.select(key), key, "left_semi")


def combined(left: DataFrame, right: DataFrame, on: list[str], expression: str, name: str = "value", value: str = "value") -> DataFrame:
    """(on, name): an expression in a and b over two sources of the same times and points; rows that one lacks are an error."""
    a, b = (df.select(*on, F.col(value).alias(c)) for df, c in ((left, "a"), (right, "b")))
    both = require_unique(a, *on).join(require_unique(b, *on), on, "full")
    lack = F.raise_error(F.concat_ws(" ", F.lit("only one source has"), *[F.col(c).cast("string") for c in on])).cast("double")
    whole = {c: F.when(F.col("a").isNull() | F.col("b").isNull(), lack).otherwise(F.col(c)) for c in ("a", "b")}
    return with_virtual(both.withColumns(whole), {name: expression}).select(*on, name)


def trials(df: DataFrame, count: int) -> DataFrame:
    """Each row once per trial, numbered from 0."""
    if count < 1:
        raise ValueError("a trial axis needs a trial")
    return df.withColumn("trial", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))


def best_rows(df: DataFrame, by: list[str], value: str, k: int, ties: list[str], highest: bool = True) -> DataFrame:
    """The k best rows of each group, numbered ``k`` from 0; equal values in the order of ``ties``."""
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last(value) if highest else F.asc_nulls_last(value), *ties)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).withColumn("k", (F.col("_r") - 1).cast("long")).drop("_r")


def integer_runs(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, low, high): the contiguous runs of a group's distinct integers.

    Rows are dealt to as many tasks as their number asks for; equal ones meet first, so that a group is ordered without them.
    """
    parts = tasks_for(df)
    distinct = df.select(*by, value).repartition(parts, *by, value).distinct()
    island = distinct.repartition(parts, *by).withColumn("_g", F.col(value) - F.row_number().over(Window.partitionBy(*by).orderBy(value)))
    return island.groupBy(*by, "_g").agg(F.min(value).alias("low"), F.max(value).alias("high")).drop("_g")


def range_intersection(df: DataFrame, by: list[str], low: str, high: str) -> DataFrame:
    """(by, low, high): what all ranges of a group have in common; null where they have nothing."""
    found = df.groupBy(*by).agg(F.max(low).alias("_l"), F.min(high).alias("_h"))
    some = F.col("_l") <= F.col("_h")
    return found.select(*by, F.when(some, F.col("_l")).alias("low"), F.when(some, F.col("_h")).alias("high"))


def own_shard(df: DataFrame, group: str, ranks: DataFrame, rank: int) -> DataFrame:
    """A rank's rows: those whose group (group, rank) is its; groups without a rank are an error."""
    require_references(df, group, ranks, group)
    return df.join(ranks.where(F.col("rank") == rank).select(group), group, "left_semi")


def with_static(df: DataFrame, key: str, table: DataFrame, *columns: str) -> DataFrame:
    """``df`` with each point's constants."""
    return referenced(df, key, table, key, *columns)
