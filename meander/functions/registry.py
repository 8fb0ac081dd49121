"""Named functions with typed signatures, bound to columns by name.

A function may have several forms: a Column expression is taken before a pandas
UDF. Arguments are columns of the same name, or values given at the call.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Signature:
    name: str
    columns: dict[str, str]  # parameter: type
    returns: str
    settings: tuple[str, ...] = ()  # parameters that are values, not columns

    def __post_init__(self):
        if both := set(self.columns) & set(self.settings):
            raise ValueError(f"{self.name}: both column and setting: {sorted(both)}")


@dataclass
class Registry:
    forms: dict[str, dict[str, Callable]] = field(default_factory=dict)
    signatures: dict[str, Signature] = field(default_factory=dict)

    def register(self, signature: Signature, expression: Callable | None = None, pandas: Callable | None = None) -> None:
        if signature.name in self.signatures:
            raise ValueError(f"{signature.name} is registered")
        given = {k: f for k, f in (("expression", expression), ("pandas", pandas)) if f}
        if not given:
            raise ValueError(f"{signature.name} has no form")
        self.signatures[signature.name], self.forms[signature.name] = signature, given

    def apply(self, df: DataFrame, name: str, out: str, form: str | None = None, **settings) -> DataFrame:
        """``df`` with the function's result as column ``out``."""
        if name not in self.signatures:
            raise ValueError(f"unknown function {name}")
        s, forms = self.signatures[name], self.forms[name]
        if set(settings) != set(s.settings):
            raise ValueError(f"{name} takes the settings {list(s.settings)}")
        kinds = dict(df.dtypes)
        for column, kind in s.columns.items():
            if kinds.get(column) != kind:
                raise ValueError(f"{name}: {column} must be a column of type {kind}, not {kinds.get(column)}")
        form = form or next(iter(forms))
        if form == "expression":
            result: Column = forms[form](**{c: F.col(c) for c in s.columns}, **settings)
        else:
            function, names = forms[form], list(s.columns)
            result = F.pandas_udf(lambda *x: function(**dict(zip(names, x)), **settings), s.returns)(*names)
        return df.withColumn(out, result.cast(s.returns))
