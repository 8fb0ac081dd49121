"""Chat formatting at token level.

Each turn's text is escaped, encoded on its own, and spliced between reserved
ids: ``<s>`` opens the conversation; a user turn is ``[INST] text [/INST]``, a
system turn ``<<SYS>> text <</SYS>>``, an assistant turn ``text </s>``, and a turn
of any other role ``<<ROLE>> role <</ROLE>> text </s>`` (markers only, no blanks).
Encoding segments separately means that no token spans a marker, and a marker
written in a text can never become a reserved id; so that the plain string is
unambiguous, too, such strings are escaped: a marker in a text gets a backslash
after its first character, and so do escaped markers, which makes it reversible.

Texts are escaped and encoded where they lie, and written. A turn's place in its
conversation's sequence is a running sum of lengths, and its loss mask a running
sum of segment lengths: turns are summed within ranges of ``RANGE`` turn numbers,
and ranges within their conversation, so that a long conversation is many tasks'.
Reading back decodes turn by turn, too; only its digests, which are sequential,
stream each conversation's texts through one task, in order and in bounded memory.

Edge cases: a null text or role is empty; turns of equal number are ordered by
role and text; rows that repeat are formatted as often; rows without conv_id
form one conversation without id; an empty table gives an empty result; extra
columns of any name are ignored. Texts may be of any length and hold any run of
blanks (see ``packing.Encoder``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels, packing, shared

#: The markers, in the order of their reserved ids.
MARKERS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>")
#: Reserved ids follow those of the tokenizer (50,257 of byte_bpe_50k.json).
FIRST_ID = 50257
#: Turn numbers summed together.
RANGE = 1024
_ID = {m: FIRST_ID + k for k, m in enumerate(MARKERS)}
_OPENS = sorted({m[0] for m in MARKERS})
_MARKED = re.compile("|".join(rf"({re.escape(m[0])})(\\*)({re.escape(m[1:])})" for m in MARKERS))
_ESCAPED = re.compile("|".join(rf"({re.escape(m[0])})\\(\\*)({re.escape(m[1:])})" for m in MARKERS))


def escape(text: str) -> str:
    if not any(c in text for c in _OPENS):  # most texts: no marker can begin
        return text
    return _MARKED.sub(lambda m: "".join((g := [x for x in m.groups() if x is not None])[:1]) + "\\" + "".join(g[1:]), text)


def unescape(text: str) -> str:
    return text if "\\" not in text else _ESCAPED.sub(lambda m: "".join(x for x in m.groups() if x is not None), text)


def segments(role: str, text: str, first: bool) -> list[tuple[bool, str, bool]]:
    """(is a marker, content, in the loss) of one turn, in order; contents are escaped."""
    out = [(True, "<s>", False)] if first else []
    if role == "user":
        return out + [(True, "[INST]", False), (False, text, False), (True, "[/INST]", False)]
    if role == "system":
        return out + [(True, "<<SYS>>", False), (False, text, False), (True, "<</SYS>>", False)]
    if role == "assistant":
        return out + [(False, text, True), (True, "</s>", False)]
    return out + [(True, "<<ROLE>>", False), (False, role, False), (True, "<</ROLE>>", False), (False, text, False), (True, "</s>", False)]


def encoded(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, turn, role, text, escaped and encoded): ids and mask of each turn, without the opening marker."""

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = packing.encoder(tokenizer)
        for batch in batches:
            role, text = (kernels.text_array(batch.column(k)) for k in (2, 3))
            for i, j in kernels.blocks(text):
                ids, masks, sizes = [np.zeros(0, np.int32)], [np.zeros(0, bool)], []
                for r, t in zip(role[i:j].to_pylist(), text[i:j].to_pylist()):
                    parts = segments(escape(r) if r not in ("user", "system", "assistant") else r, escape(t), False)
                    tokens = [np.array([_ID[x]], np.int32) if marker else code.ids(x, special=False).astype(np.int32) for marker, x, _ in parts]
                    # 1 where a segment's loss begins, -1 where it ends: the running sum is the mask
                    ends = np.cumsum([0] + [len(k) for k in tokens])
                    edge = np.zeros(ends[-1] + 1, np.int8)
                    for (_, _, loss), a, b in zip(parts, ends[:-1], ends[1:]):
                        edge[a] += loss
                        edge[b] -= loss
                    ids += tokens
                    masks.append(np.cumsum(edge[:-1]).astype(bool))
                    sizes.append(int(ends[-1]))
                at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                columns = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (ids, masks)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], role[i:j].cast(pa.string()), text[i:j].cast(pa.string()), *columns], ["conv_id", "turn", "role", "text", "ids", "mask"])

    source = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return source.mapInArrow(run, "conv_id long, turn long, role string, text string, ids array<int>, mask array<boolean>")


def format_chats(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, part, offset, ids, mask): each turn's tokens, at its place in the conversation's sequence.

    The parts of a conversation, in order, are its token sequence and loss mask.
    """
    turns = encoded(conversations, tokenizer).withColumn("_range", F.expr(f"turn div {RANGE} - IF(turn % {RANGE} < 0, 1, 0)"))
    turns = shared.saved(turns.withColumn("_size", F.size("ids").cast("long")), "turns")
    ranges = turns.groupBy("conv_id", "_range").agg(F.count("*").alias("_n"), F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("conv_id").orderBy("_range")  # nulls first, as turns are
    ranges = ranges.select(F.col("conv_id").alias("_c"), F.col("_range").alias("_r"), (F.sum("_n").over(earlier) - F.col("_n")).alias("_parts"), (F.sum("_sum").over(earlier) - F.col("_sum")).alias("_offset"))
    own = Window.partitionBy("conv_id", "_range").orderBy("turn", "role", "text", F.monotonically_increasing_id()).rowsBetween(Window.unboundedPreceding, 0)
    placed = turns.withColumns({"_n": F.count("*").over(own) - 1, "_before": F.sum("_size").over(own) - F.col("_size")})
    placed = placed.join(ranges, F.expr("conv_id <=> _c AND _range <=> _r")).withColumn("part", F.col("_parts") + F.col("_n"))
    first = F.col("part") == 0
    opened = lambda marker, column: F.when(first, F.concat(F.array(F.lit(marker)), column)).otherwise(F.col(column))
    offset = F.when(first, F.lit(0)).otherwise(F.col("_offset") + F.col("_before") + 1)  # after the opening marker
    return placed.select("conv_id", "part", offset.cast("long").alias("offset"), opened(_ID["<s>"], "ids").alias("ids"), opened(False, "mask").alias("mask"))


def _turn(code: packing.Encoder, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, int]:
    """(what is hashed of a turn, its loss text, characters) of one turn's tokens: runs between reserved ids are texts."""
    at = np.flatnonzero(ids >= FIRST_ID)
    marks = [MARKERS[i - FIRST_ID] for i in ids[at].tolist()]
    edges = np.concatenate([[-1], at, [len(ids)]]).tolist()
    got = [code.text(ids[a + 1 : b]) for a, b in zip(edges[:-1], edges[1:])]
    chars = sum(map(len, got)) + sum(map(len, marks))
    if marks[0] == "<s>":
        marks, got = marks[1:], got[1:]
    # what stands before each marker: user and system texts end at the second, assistant's at the first
    role, text = {"[INST]": ("user", got[1]), "<<SYS>>": ("system", got[1]), "</s>": ("assistant", got[0])}.get(marks[0], (unescape(got[1]), got[2] if len(got) > 2 else ""))
    return f"{role}\n{unescape(text)}\n", unescape(code.text(ids[mask])), chars


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """What the token sequences say, by conversation; ``formatted`` as ``format_chats`` leaves it."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    @kernels.tidied
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = packing.encoder(tokenizer)
        for batch in batches:
            ids, masks = (batch.column(k) for k in (2, 3))
            at = ids.offsets.to_numpy()
            flat, mask = ids.values.to_numpy(), masks.values.to_numpy(zero_copy_only=False)
            shift = masks.offsets[0].as_py() - int(at[0])
            got = [_turn(code, flat[a:b], mask[a + shift : b + shift]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64())))], ["conv_id", "part", "said", "loss", "chars"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, chars, loss_chars, every, loss = None, 0, 0, 0, None, None
        for batch in batches:
            done = []
            for conv_id, part, said, lost, n in zip(*(c.to_pylist() for c in batch.columns)):
                if part == 0:
                    if turns:
                        done.append((now, turns, every.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    now, turns, chars, loss_chars, every, loss = conv_id, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                every.update(said.encode())
                loss.update(lost.encode())
                turns, chars, loss_chars = turns + 1, chars + n, loss_chars + len(lost)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], names)
        if turns:
            last = (now, turns, every.hexdigest(), loss_chars, loss.hexdigest(), chars)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(last, types)], names)

    texts = formatted.select("conv_id", "part", "ids", "mask").mapInArrow(decoded, "conv_id long, part long, said string, loss string, chars long")
    ordered = texts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = shared.table(spark, sf_dir, "conversations").select(*own.columns).unionByName(own)
    return read_back(format_chats(turns, packing.tokenizer_path()), packing.tokenizer_path())


def _sql() -> str:
    """DuckDB: the same from the plain texts. Escaping adds one character per marker found (they never overlap)."""
    marked = "|".join("{}\\\\*{}".format(re.escape(m[0]), re.escape(m[1:])) for m in MARKERS).replace("\\<", "<").replace("\\/", "/").replace("\\>", ">")
    escapes = lambda c: f"length(regexp_extract_all({c}, '{marked}'))"
    sizes = {m: len(m) for m in MARKERS}
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), s AS (
  SELECT *, length(text) + {escapes('text')} + CASE role
    WHEN 'user' THEN {sizes['[INST]'] + sizes['[/INST]']}
    WHEN 'system' THEN {sizes['<<SYS>>'] + sizes['<</SYS>>']}
    WHEN 'assistant' THEN {sizes['</s>']}
    ELSE {sizes['<<ROLE>>'] + sizes['<</ROLE>>'] + sizes['</s>']} + length(role) + {escapes('role')} END AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) + {sizes['<s>']} AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id"""


ORACLE_SQL = _sql()
