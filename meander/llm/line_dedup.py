"""Line dedup by a deletion-neighbourhood join; DataFrame functions only.

Lines are compared lower-cased and trimmed; empty ones are left alone (and those
of under ``min_chars`` characters, which a caller may raise from 1). Places are
ordered by (doc_id, hash of the text, line number).
A line is dropped if an equal line, or one within one edit (a character added,
removed or replaced), stands at an earlier place; what is left of each text is
put together again.

1. Equal lines are reduced to their first place by two 64-bit hashes.
2. A distinct line can only be within one edit of another if they share a long
   prefix or suffix, so only lines that share one with some other line (first of
   a length on a coarse grid, then of half the exact length) go on. This loses
   no pair; it spares the mass of lines their neighbourhoods.
3. Each such line is cut into windows; where all outside a window equals another
   line's, the edit must be inside it, so the line emits the hashes of all its
   one-deletion variants in that window. A variant
   equal to another line is a removal; the same variant with the same gap is a
   replacement. So each hash stands for lines that are within one edit of the
   earliest with that hash: one candidate per member, never all pairs. The edit
   distance of each is then verified with ``levenshtein``.

Which keys occur twice is written before it is joined, so that both sides of each
join are plain exchanges and the rows of a hot key can be split. Tables of places
grow with the documents: they are merged with the texts, never broadcast.

Edge cases: null text stays null, empty text empty; null ids come first; rows
that repeat id and text are one document; an empty table gives an empty result;
extra columns pass through (those named n_lines, n_kept or with a leading ``_ld_``
are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

WINDOW = 16


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, row, pos, t): each compared line at its place; row stands for (doc_id, text)."""
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("row"), F.posexplode(F.split("text", "\n")).alias("pos", "t"))
    return rows.select("id", "row", "pos", F.lower(F.trim("t")).alias("t")).where(F.length("t") >= min_chars)


def _shared_ends(t: Column, n: Column, exact: bool) -> Column:
    """Keys of the prefixes and suffixes a line must share with one that is an edit away and not shorter by more than one."""
    out = []
    for m in (n, n - 1):
        g = F.floor(m / 2) if exact else F.floor(F.pow(F.lit(2.0), F.floor(F.log2(m / 2) * 4) / 4))
        g = g.cast("int")
        label = m if exact else g
        out += [F.xxhash64(label, F.lit(0), F.substr(t, F.lit(1), g)), F.xxhash64(label, F.lit(1), F.substr(t, -g if not exact else g - m, m))]
    return F.array_distinct(F.array(*out))


def _windows(lines: DataFrame) -> DataFrame:
    """(place, key, inside, longer) per window of (place, t): key stands for all outside it, for the line's length and the one below."""
    sized = lines.withColumn("n", F.length("t")).select("place", "t", "n", F.explode(F.array("n", F.col("n") - 1)).alias("m"))
    sized = sized.withColumn("count", F.greatest(F.lit(2), F.expr(f"m div {WINDOW}")).cast("int"))
    cut = sized.select("place", "t", "n", "m", "count", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("j"))
    cut = cut.withColumns({"a": F.expr("CAST((j * m) div count AS int)"), "b": F.expr("CAST(((j + 1) * m) div count AS int)")})
    key = F.expr("xxhash64(m, j, substr(t, 1, a), substr(t, n - m + b + 1))")
    return cut.select("place", key.alias("key"), F.expr("substr(t, a + 1, n - m + b - a)").alias("inside"), F.expr("m < n").alias("longer"))


def _paired(rows: DataFrame, keys: Column, *ids: str) -> DataFrame:
    """The distinct ``ids`` of rows that share a key with another row."""
    keyed = rows.select(*ids, F.explode(keys).alias("key"))
    return keyed.join(_twice(keyed), "key").select(*ids).distinct()


def _twice(keyed: DataFrame) -> DataFrame:
    return shared.saved(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "twice")


def dedup_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """``docs`` with the remaining ``text``, ``n_lines`` (of the compared length) and ``n_kept`` of them."""
    lines = _lines(docs, min_chars)
    t, n = F.col("t"), F.length("t")
    named = lines.select(F.struct("id", "row", "pos").alias("place"), F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"), _shared_ends(t, n, False).alias("ends"))
    ends = [F.max(F.get("ends", F.lit(i))).alias(f"e{i}") for i in range(4)]
    first = named.groupBy("h1", "h2").agg(F.min("place").alias("place"), *ends).select("place.*", "e0", "e1", "e2", "e3")
    first = shared.saved(first, "first")

    some = _paired(first, F.array_compact(F.array("e0", "e1", "e2", "e3")), "id", "row", "pos")
    at = shared.saved(some.groupBy("id", "row").agg(F.sort_array(F.collect_list("pos")).alias("at")), "places")
    source = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("row"), F.split("text", "\n").alias("all"))
    texts = source.join(at.hint("merge"), "row").where(F.col("_id").eqNullSafe(F.col("id")))
    texts = texts.select("id", "row", F.explode(F.transform("at", lambda p: F.struct(p.alias("pos"), F.lower(F.trim(F.get("all", p))).alias("t")))).alias("x")).select("id", "row", "x.*").distinct()
    texts = shared.saved(texts, "texts")
    close = _paired(texts, _shared_ends(t, n, True), "id", "row", "pos")
    near = texts.alias("a").join(close.alias("c"), F.expr("a.row = c.row AND a.pos = c.pos AND a.id <=> c.id"), "left_semi")
    near = shared.saved(near.select(F.struct("id", "row", "pos").alias("place"), "t"), "near")

    # the windows of about WINDOW characters outside which a line equals some other
    parts = shared.saved(_windows(near), "windows")
    parts = shared.saved(parts.join(_twice(parts), "key"), "windows")
    size = F.length("inside")
    gap = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(i.alias("i"), F.concat(F.substr("inside", F.lit(1), i - 1), F.substr("inside", i + 1)).alias("v")))
    variant = lambda label, text, role: F.struct(F.xxhash64("key", label, text).alias("variant"), F.lit(role).alias("role"))
    variants = F.when(F.col("longer"), F.transform(gap, lambda x: variant(F.lit(0), x.v, 1))).otherwise(  # a character less
        F.concat(F.array(variant(F.lit(0), F.col("inside"), 0)), F.transform(gap, lambda x: variant(x.i, x.v, 2)))  # the line itself; the one at i replaced
    )
    emitted = parts.select("place", F.explode(F.array_distinct(variants)).alias("x")).select("place", "x.*")
    groups = emitted.groupBy("variant").agg(F.count("*").alias("n"), F.min(F.when(F.col("role") == 0, F.col("place"))).alias("own"), F.min(F.when(F.col("role") != 0, F.col("place"))).alias("other")).where("n > 1")
    groups = shared.saved(groups.drop("n"), "variants")
    earlier = F.when(F.col("role") == 1, F.col("own")).otherwise(F.col("other"))
    found = emitted.join(groups, "variant").select("place", earlier.alias("earlier")).where("earlier < place").distinct()
    found = found.join(near, "place").join(near.select(F.col("place").alias("earlier"), F.col("t").alias("u")), "earlier")
    gone = found.where(F.levenshtein("t", "u", 1) >= 0).select("place.*").distinct()

    kept = first.select("id", "row", "pos").alias("f").join(gone.alias("g"), F.expr("f.row = g.row AND f.pos = g.pos AND f.id <=> g.id"), "left_anti")
    kept = kept.groupBy(F.col("id").alias("_ld_id"), F.col("row").alias("_ld_row")).agg(F.collect_list("pos").alias("_ld_kept"))
    kept = shared.saved(kept, "kept")
    out = docs.drop("n_lines", "n_kept").withColumn("_ld_key", F.xxhash64("doc_id", "text"))
    out = out.join(kept.hint("merge"), F.expr("_ld_key = _ld_row AND doc_id <=> _ld_id"), "left")
    out = out.withColumn("_ld_lines", F.split("text", "\n")).withColumn("_ld_kept", F.coalesce("_ld_kept", F.array().cast("array<int>")))
    out = out.withColumn("_ld_short", F.filter(F.transform("_ld_lines", lambda x, i: F.when(F.length(F.trim(x)) < min_chars, i)), lambda i: i.isNotNull()))
    whole = F.array_join(F.transform(F.sort_array(F.concat("_ld_kept", "_ld_short")), lambda p: F.get("_ld_lines", p)), "\n")
    out = out.withColumns({"n_lines": (F.size("_ld_lines") - F.size("_ld_short")).cast("long"), "n_kept": F.size("_ld_kept").cast("long"), "text": F.when(F.col("text").isNotNull(), whole)})
    return out.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("n_lines"))).select(*[c for c in docs.columns if c not in ("n_lines", "n_kept")], "n_lines", "n_kept")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their remaining lines (and the length of what remains)."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))  # so that no column is mistaken for a count
    out = dedup_lines(rows)
    new = {"text": F.col("text"), "n_chars": F.length(F.coalesce("text", F.lit(""))).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


#: Lines that share half of their characters are compared character by character. Documents are taken to have distinct ids.
ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, pos, line, lower(trim(line, ' ')) AS t
  FROM (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))
), f AS (SELECT t, min((doc_id, pos)) AS place, length(t) AS n FROM l WHERE t <> '' GROUP BY t
), h AS (
  SELECT t, place, n, m, side, CASE side WHEN 0 THEN left(t, m // 2) ELSE right(t, m - m // 2) END AS half
  FROM (SELECT *, unnest([n, n - 1]) AS m FROM f), (SELECT unnest([0, 1]) AS side)
), pairs AS (
  SELECT DISTINCT a.place, a.t, b.t AS u FROM h a JOIN h b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND b.place < a.place AND abs(a.n - b.n) <= 1
), chars AS (
  SELECT place, regexp_extract_all(CASE WHEN length(t) <= length(u) THEN t ELSE u END, '(?s).') AS s, regexp_extract_all(CASE WHEN length(t) <= length(u) THEN u ELSE t END, '(?s).') AS g FROM pairs
), first AS (SELECT place, s, g, coalesce(nullif(list_position([z[1] IS DISTINCT FROM z[2] FOR z IN list_zip(s, g)], true), 0), len(s) + 1) AS p FROM chars
), gone AS (SELECT DISTINCT place FROM first WHERE s[p + CASE WHEN len(s) = len(g) THEN 1 ELSE 0 END:] = g[p + 1:]
), kept AS (SELECT place FROM f ANTI JOIN gone USING (place)
), marked AS (SELECT l.*, t <> '' AS compared, kept.place IS NOT NULL AS stays FROM l LEFT JOIN kept ON kept.place = (l.doc_id, l.pos)
), texts AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (stays OR NOT compared) AS text, count(*) FILTER (compared) AS n_lines, count(*) FILTER (stays) AS n_kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(x.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept
FROM documents d LEFT JOIN texts x ON x.doc_id = d.doc_id"""
