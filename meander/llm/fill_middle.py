"""Fill-in-the-middle by ropes.

A text is a rope: a balanced tree whose leaves hold at most ``LEAF`` code points
and whose nodes cache how many line ends and code points lie below. A document's
two cuts are ranks of lines (units); the tree is split at them, which rebuilds
only the nodes on the way down, and the three subtrees are joined anew around
the sentinels. The inverse makes a rope of the output, splits it around the
sentinels by code points, and puts the subtrees back in order. Ranks and form
come from hashes of the seed and the document's id, so a task that runs again
gives the same rows.

Edge cases: an empty or null text is plain and has no lines; so is a text that
holds a sentinel, which is what makes the inverse unambiguous; a null doc_id
hashes as if it had no digits; repeated rows give repeated rows; texts may be of
any length and hold any number of lines; an empty table gives an empty result;
extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Union

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import kernels, shared

#: What goes before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of a leaf.
LEAF = 4096
SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50


@dataclass(slots=True)
class Leaf:
    text: str
    breaks: int
    chars: int


@dataclass(slots=True)
class Tree:
    left: Rope
    right: Rope
    breaks: int
    chars: int


Rope = Union[Leaf, Tree]


def leaf(text: str) -> Leaf:
    return Leaf(text, text.count("\n"), len(text))


def rope(text: str) -> Rope:
    """A balanced tree over ``text``."""
    level: list[Rope] = [leaf(text[i : i + LEAF]) for i in range(0, max(len(text), 1), LEAF)]
    while len(level) > 1:
        level = [join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def join(left: Rope, right: Rope) -> Rope:
    if not left.chars or not right.chars:
        return right if not left.chars else left
    return Tree(left, right, left.breaks + right.breaks, left.chars + right.chars)


def split_lines(at: Rope, lines: int) -> tuple[Rope, Rope]:
    """The first ``lines`` lines, and the rest; a last line without line end counts as one."""
    if lines <= 0:
        return leaf(""), at
    if lines > at.breaks:
        return at, leaf("")
    if isinstance(at, Leaf):
        rest = at.text.split("\n", lines)[-1]
        return leaf(at.text[: at.chars - len(rest)]), leaf(rest)
    if lines <= at.left.breaks:
        a, b = split_lines(at.left, lines)
        return a, join(b, at.right)
    a, b = split_lines(at.right, lines - at.left.breaks)
    return join(at.left, a), b


def split_chars(at: Rope, chars: int) -> tuple[Rope, Rope]:
    """The first ``chars`` code points, and the rest."""
    if chars <= 0 or chars >= at.chars:
        return (leaf(""), at) if chars <= 0 else (at, leaf(""))
    if isinstance(at, Leaf):
        return leaf(at.text[:chars]), leaf(at.text[chars:])
    if chars <= at.left.chars:
        a, b = split_chars(at.left, chars)
        return a, join(b, at.right)
    a, b = split_chars(at.right, chars - at.left.chars)
    return join(at.left, a), b


def leaves(at: Rope) -> Iterator[str]:
    todo = [at]
    while todo:
        node = todo.pop()
        if isinstance(node, Leaf):
            yield node.text
        else:
            todo += [node.right, node.left]


def text_of(at: Rope) -> str:
    return at.text if isinstance(at, Leaf) else "".join(leaves(at))


def rearranged(doc_id: int | None, text: str, seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, str]:
    """(lines, form, code points of prefix and of middle, output) of one document."""
    whole = rope(text)
    n = whole.breaks + (bool(text) and text[-1] != "\n")
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= fim:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = split_lines(whole, second)
    prefix, middle = split_lines(head, first)
    p, s = join(leaf(PREFIX), prefix), join(leaf(SUFFIX), suffix)
    form, outer = ("spm", join(s, p)) if h4 % 100 < spm else ("psm", join(p, s))
    return n, form, prefix.chars, middle.chars, text_of(join(outer, join(leaf(MIDDLE), middle)))


def restored(output: str, form: str) -> str:
    """The text of an output."""
    if form == "plain":
        return output
    marks = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    at, rest, taken, parts = [output.index(m) for m in marks], rope(output), 0, {}
    for mark, end in zip(marks, [*at[1:], len(output)]):
        segment, rest = split_chars(rest, end - taken)
        taken, parts[mark] = end, split_chars(segment, len(mark))[1]
    return text_of(join(join(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]))


def transform(docs: DataFrame, seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0).cast(pa.int64()), kernels.text_array(batch.column(1))
            for i, j in kernels.blocks(text):
                rows = [(d, *rearranged(d, t, seed, fim, spm)) for d, t in zip(ids[i:j].to_pylist(), text[i:j].to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def invert(outputs: DataFrame) -> DataFrame:
    """``outputs``, which have form and output, with the texts as ``restored``."""
    schema = StructType([*outputs.schema.fields, StructField("restored", StringType())])
    at = outputs.columns.index("output"), outputs.columns.index("form")

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            output, form = kernels.text_array(batch.column(at[0])), batch.column(at[1])
            for i, j in kernels.blocks(output):
                back = [restored(o, f) for o, f in zip(output[i:j].to_pylist(), form[i:j].to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(back, pa.string())], [*batch.schema.names, "restored"])

    return outputs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    hexed = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    done = invert(transform(shared.table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hexed("output").alias("output_sha256"), hexed("restored").alias("restored_sha256"))


def _sql() -> str:
    """DuckDB: the same from lists of lines."""
    head = lambda k: f"CASE WHEN {k} = 0 THEN '' WHEN {k} >= len(l) THEN t ELSE array_to_string(l[1:{k}], chr(10)) || chr(10) END"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents
), h AS (
  SELECT *, CAST(len(l) - (CASE WHEN l[-1] = '' THEN 1 ELSE 0 END) AS BIGINT) AS n,
    {", ".join(f"CAST('0x' || substr(k, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))}
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {FIM_PERCENT} THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, {head("a")} AS pre, {head("b")} AS upto FROM c
), s AS (
  SELECT *, substr(upto, length(pre) + 1) AS mid, substr(t, length(upto) + 1) AS suf FROM p
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM s"""


ORACLE_SQL = _sql()
