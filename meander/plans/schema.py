"""Declared schemas: typed fields of named modules, checked casts, defaults and name resolution."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lookup import IntegrityError, require_references, require_unique

#: Declared kinds and their column types.
KINDS = {"float": T.DoubleType(), "hpfloat": T.DoubleType(), "int": T.LongType(), "idx": T.IntegerType(), "bool": T.BooleanType()}
_FAMILY = {"double": "float", "float": "float", "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "boolean": "bool"}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    role: str = "value"  # value, coordinate, reference, selection
    refers_to: str | None = None  # of a reference: module.coordinate
    default: float | int | bool | None = None
    depends_on: tuple[str, ...] = ()  # modules that must be open, else the field doesn't exist

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"{self.name}: unknown kind {self.kind}")
        if (self.role == "reference") != (self.refers_to is not None):
            raise ValueError(f"{self.name}: references, and only they, name what they refer to")


def checked_cast(column: str, source: str, kind: str) -> Column:
    """A cast within a family (float, int, bool); an int that doesn't fit is an error."""
    wanted = KINDS[kind]
    if _FAMILY.get(source) != _FAMILY[wanted.simpleString()]:
        raise IntegrityError(f"{column}: {source} is not {kind}")
    return F.col(column).cast(wanted)  # ANSI casts raise on overflow


def conformed(df: DataFrame, fields: Iterable[Field], open_modules: Iterable[str] = ()) -> DataFrame:
    """``df`` with exactly the declared fields: cast, absent ones with a default added, nulls replaced by the default."""
    kinds, out = dict(df.dtypes), []
    for f in fields:
        if not set(f.depends_on) <= set(open_modules):
            continue
        if f.name not in kinds:
            if f.default is None:
                raise IntegrityError(f"{f.name} is missing and has no default")
            out.append(F.lit(f.default).cast(KINDS[f.kind]).alias(f.name))
            continue
        value = checked_cast(f.name, kinds[f.name], f.kind)
        out.append((value if f.default is None else F.coalesce(value, F.lit(f.default).cast(KINDS[f.kind]))).alias(f.name))
    return df.select(*out)


def check_model(tables: Mapping[str, DataFrame], fields: Mapping[str, Iterable[Field]]) -> None:
    """Coordinates are unique and references have their targets, over all modules."""
    for module, own in fields.items():
        for f in own:
            if f.role in ("coordinate", "selection"):
                require_unique(tables[module], f.name)
            elif f.role == "reference":
                target, _, key = f.refers_to.partition(".")
                require_references(tables[module], f.name, tables[target], key)


def namespace(modules: Mapping[str, Iterable[str]], virtual: Iterable[str] = ()) -> dict[str, str]:
    """Names to ``module.field``: dotted always, bare where one module has it; virtual names hide stored ones."""
    out = {f"{m}.{f}": f"{m}.{f}" for m, own in modules.items() for f in own}
    bare: dict[str, list[str]] = {}
    for m, own in modules.items():
        for f in own:
            bare.setdefault(f, []).append(f"{m}.{f}")
    out |= {f: full[0] for f, full in bare.items() if len(full) == 1}
    return out | {v: v for v in virtual}


def request(operations: Mapping[str, Iterable[str | tuple[str, str] | dict[str, str]]]) -> list[tuple[str, str, str]]:
    """(operation, alias, expression) of a request like {"max_mean": ["depth", {"q": "a * b"}]}; repetitions and conflicts are errors."""
    found: list[tuple[str, str, str]] = []
    aliases: dict[str, str] = {}
    for op, items in operations.items():
        for item in items:
            pairs = item.items() if isinstance(item, dict) else [item if isinstance(item, tuple) else (item, item)]
            for alias, expression in pairs:
                if aliases.setdefault(alias, expression) != expression:
                    raise ValueError(f"{alias} stands for {aliases[alias]!r} and {expression!r}")
                if (op, alias, expression) in found:
                    raise ValueError(f"{op} of {alias} is asked for twice")
                found.append((op, alias, expression))
    return found


def cross_rank_references(df: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """(key, rank, target_rank): references that leave their rank. Both tables have a column rank; a shard that has any is not closed."""
    there = target.select(F.col(target_key).alias(key), F.col("rank").alias("target_rank"))
    return df.select(key, "rank").distinct().join(there, key).where("rank <> target_rank")


def differing_replicas(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key): rows of a replicated table (with a column rank) that are not the same on all ranks, or not on all of them."""
    ranks = df.select("rank").distinct().count()
    found = df.groupBy(key).agg(F.count_distinct("rank").alias("_n"), F.count_distinct(F.xxhash64(*columns)).alias("_v"))
    return found.where((F.col("_n") != ranks) | (F.col("_v") != 1)).select(key)
