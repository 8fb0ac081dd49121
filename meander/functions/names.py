"""Names: symbols from expressions, result-file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for operators in a symbol.
OPERATOR_WORDS = {"**": "_pow_", "^": "_pow_", "+": "_plus_", "-": "_minus_", "*": "_mul_", "/": "_div_", ".": "_dot_"}
RESULT_FILE = r"^(.+)_rank(\d+)(?:_(\d{4}))?\.\w+$"


def symbol(text: Column) -> Column:
    """An expression as an identifier."""
    for mark, word in OPERATOR_WORDS.items():
        text = F.replace(text, F.lit(mark), F.lit(word))
    return F.regexp_replace(F.regexp_replace(text, "[^0-9A-Za-z]+", "_"), "^_+|_+$", "")


def result_file(name: Column) -> Column:
    """struct(variable, rank, year) of ``variable_rank3_2001.parquet``; null if it isn't one."""
    part = lambda k: F.regexp_extract(name, RESULT_FILE, k)
    found = F.struct(part(1).alias("variable"), F.nullif(part(2), F.lit("")).cast("int").alias("rank"), F.nullif(part(3), F.lit("")).cast("int").alias("year"))
    return F.when(name.rlike(RESULT_FILE), found)
