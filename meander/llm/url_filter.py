"""URL filters: rules, and a character language-model ratio for what no rule covers.

Host and path are cut from the url by built-in functions. A rule (host, path)
fits its host and all subdomains when the url's path starts with the rule's;
the longest wins: the longest host, then the longest path. The rules of a url
are looked up by its host's suffixes, not by trying all rules.

Urls that rules allow and block are the two corpora of a variable-order Markov
model over characters (code points). All of them are counted, by exact (order,
context and character), in a table in the shared folder that grows with the
corpus: nothing is hashed, capped or collected. Probabilities are interpolated
from order 0 up (Witten-Bell), so a character's log-ratio depends on it and the
ORDER characters before it alone; it is computed once for each such run that
occurs, and urls are scored by joining theirs with it. A url's statistic is the
mean log-ratio of its characters; it is blocked below a threshold calibrated on
all ruled urls: the one of the fewest balanced errors over a histogram of their
statistics. Equal urls are scored once and count as often as they occur.

Edge cases: null urls, and those without ``://``, have an empty host and path and
fit no rule. Null and empty urls have the statistic 0; all others, however long and
also without ``://``, that of their characters. Repeated rows are judged one by
one; an empty table gives an empty result; extra columns of any name are ignored.
If either class has no ruled url, all others are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels, shared

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 5
#: Bits of a symbol in a key: 0 stands before the url's begin, others are code points plus 1. A key is two longs of three symbols.
SYMBOL, CHARS = 21, 0x110000
#: Log-ratios are summed as integers of this unit, so that sums do not depend on the order of rows.
UNIT = 2.0**-32
#: Cells of the calibration histogram, over statistics from -SPAN to SPAN.
CELLS, SPAN = 2000, 10.0
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    before = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(before, r"(?s)^([^/]*)", 1)
    path = F.substr(before, F.length(host) + 1)
    return F.coalesce(F.translate(host, *_LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule and the rule's verdict (null where none fits)."""
    host, path = host_and_path(F.col("url"))
    cut = pages.withColumns({"host": host, "path": path})
    names = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    # the rules as one literal map from host to its rules; struct order is that of precedence
    by_host: dict[str, list[Column]] = {}
    for v, h, p in rules:
        by_host.setdefault(h, []).append(F.struct(F.lit(len(h)).alias("a"), F.lit(len(p)).alias("b"), F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")))
    lookup = F.create_map(*[x for h, r in by_host.items() for x in (F.lit(h), F.array(*r))])
    fits = F.flatten(F.filter(F.transform(ends, lambda e: F.try_element_at(lookup, e)), lambda r: r.isNotNull()))
    best = F.array_max(F.filter(fits, lambda r: F.col("path").startswith(r.path)))
    return cut.withColumn("_best", best).select("page_id", "url", "host", "path", F.concat("_best.host", "_best.path").alias("rule"), F.col("_best.verdict").alias("ruled"))


def _points(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points and row offsets of a large string array without nulls."""
    data, off = kernels.raw(text)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), before[off]


def _grams(points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per character: the key of it (lowest symbol) and the ORDER before it, as two longs, and its row."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.arange(len(points)) - off[:-1][row]
    symbol = points.astype(np.int64) + 1
    keys = np.zeros((2, len(points)), np.int64)
    for k in range(ORDER + 1):
        keys[k // 3, k:] += np.where(at[k:] >= k, symbol[: len(symbol) - k], 0) << (SYMBOL * (k % 3))
    return keys[1], keys[0], row


def _distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, and which of them each is."""
    order = np.lexsort((low, high))
    h, x = high[order], low[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (x[1:] != x[:-1])]) if len(h) else np.zeros(0, bool)
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    return h[new], x[new], which


def _suffix(order: int) -> list[Column]:
    """A key's lowest ``order`` + 1 symbols."""
    held = [F.lit((1 << SYMBOL * n) - 1) for n in (max(0, order - 2), min(3, order + 1))]
    return [F.col(c).bitwiseAND(mask).alias(c) for c, mask in zip(("high", "low"), held)]


def distinct_urls(ruled: DataFrame) -> DataFrame:
    """(id, url, allowed, copies) of ``ruled`` (url, allowed or null), null urls as empty; written, so that ids stay."""
    urls = ruled.groupBy(F.coalesce("url", F.lit("")).alias("url")).agg(F.first("allowed").alias("allowed"), F.count("*").alias("copies"))
    return shared.saved(urls.select(F.monotonically_increasing_id().alias("id"), "url", "allowed", "copies"), "urls")


def model_counts(urls: DataFrame) -> DataFrame:
    """(order, high, low, good, bad): how often allowed and blocked urls have each character after each context, over all runs that ``urls`` have."""

    @kernels.tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = kernels.text_array(batch.column(0))
            good, bad = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for i, j in kernels.blocks(text):
                *key, row = _grams(*_points(text[i:j]))
                *key, which = _distinct(*key)
                sums = [np.zeros(len(key[0]), np.int64) for _ in range(2)]
                for out, n in zip(sums, (good, bad)):
                    np.add.at(out, which, n[i:j][row])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*key, *sums)], ["high", "low", "good", "bad"])

    side = lambda name, held: F.when(held, F.col("copies")).otherwise(0).alias(name)
    found = urls.select("url", side("good", F.col("allowed")), side("bad", ~F.col("allowed"))).mapInArrow(count, "high long, low long, good long, bad long")
    sums = [F.sum(c).alias(c) for c in ("good", "bad")]
    grams = found.groupBy("high", "low").agg(*sums)
    orders = F.explode(F.array(*[F.struct(F.lit(k).alias("order"), *_suffix(k)) for k in range(ORDER + 1)]))
    each = grams.select(orders.alias("_"), "good", "bad").select("_.*", "good", "bad")
    return shared.saved(each.groupBy("order", "high", "low").agg(*sums), "url-counts")


def counts(ruled: DataFrame) -> np.ndarray:
    """The size of the model of ``ruled`` (url, allowed): [class; characters, characters after a context, distinct contexts and characters; order]."""
    sums = [F.sum(c) for c in ("good", "bad")] + [F.count_if(F.col(c) > 0) for c in ("good", "bad")]
    out = np.zeros((2, 3, ORDER + 1))
    for r in model_counts(distinct_urls(ruled)).groupBy("order").agg(*sums).collect():  # a row an order
        out[:, 0, r[0]] = out[:, 1, r[0]] = r[1:3]
        out[:, 2, r[0]] = r[3:5]
    return out


def log_ratios(model: DataFrame) -> DataFrame:
    """(high, low, ratio): the log-ratio, in UNIT, of each run of the highest order in ``model``."""
    same = Window.partitionBy("order", "high", F.shiftright("low", SYMBOL))  # at most a row a character of the alphabet
    step = []
    for c in ("good", "bad"):
        # p = add + times * (the probability one order lower)
        n, kinds = F.sum(c).over(same), F.sum((F.col(c) > 0).cast("long")).over(same)
        step += [F.when(n > 0, F.col(c) / (n + kinds)).otherwise(0.0).alias(f"add_{c}"), F.when(n > 0, kinds / (n + kinds)).otherwise(1.0).alias(f"times_{c}")]
    steps = shared.saved(model.select("order", "high", "low", *step), "url-steps")
    p = lambda c, low: (F.col(f"add_{c}") + F.col(f"times_{c}") * low).alias(f"p_{c}")
    below = steps.where("order = 0").select("high", "low", p("good", F.lit(1 / CHARS)), p("bad", F.lit(1 / CHARS)))
    for k in range(1, ORDER + 1):
        lower = below.select(F.col("high").alias("_high"), F.col("low").alias("_low"), F.col("p_good").alias("_good"), F.col("p_bad").alias("_bad"))
        here = steps.where(F.col("order") == k).withColumns(dict(zip(("_high", "_low"), _suffix(k - 1))))
        below = here.join(lower, ["_high", "_low"]).select("high", "low", p("good", F.col("_good")), p("bad", F.col("_bad")))
    ratios = below.select("high", "low", F.round((F.log("p_good") - F.log("p_bad")) / UNIT).cast("long").alias("ratio"))
    return shared.saved(ratios, "url-ratios")  # so that the rows of a run that all urls have can be split in the join


def scored(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """``urls`` with the column ``statistic``."""

    @kernels.tidied
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = kernels.text_array(batch.column(1))
            for i, j in kernels.blocks(text):
                *key, row = _grams(*_points(text[i:j]))
                *key, which = _distinct(*key)
                pair, n = np.unique((row << 32) | which, return_counts=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array((pair >> 32) + i)), *(pa.array(x[pair & 0xFFFFFFFF]) for x in key), pa.array(n)], ["id", "high", "low", "n"])

    grams = urls.select("id", "url").mapInArrow(runs, "id long, high long, low long, n long")
    sums = grams.join(ratios, ["high", "low"]).groupBy("id").agg(F.sum(F.col("n") * F.col("ratio")).alias("_sum"))
    mean = F.coalesce(F.col("_sum") * F.lit(UNIT) / F.char_length("url"), F.lit(0.0))
    return urls.join(sums, "id", "left").select(*urls.columns, mean.alias("statistic"))


def calibrated(urls: DataFrame) -> float:
    """The threshold, from all ``urls`` with a rule (allowed, copies, statistic)."""
    cell = F.least(F.greatest(F.floor((F.col("statistic") + SPAN) * (CELLS / (2 * SPAN))), F.lit(0)), F.lit(CELLS - 1))
    histogram = urls.where("allowed IS NOT NULL").groupBy(cell.cast("int").alias("cell"), "allowed").agg(F.sum("copies")).collect()
    good, bad = np.zeros(CELLS), np.zeros(CELLS)
    for r in histogram:
        (good if r[1] else bad)[r[0]] += r[2]
    if not good.sum() or not bad.sum():
        return -np.inf
    # cut below cell k: allowed urls lost, blocked urls let through
    lost = np.concatenate([[0], np.cumsum(good)]) / good.sum() + 1 - np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    best = np.flatnonzero(lost <= lost.min() + 1e-12)
    return float(best[len(best) // 2] * 2 * SPAN / CELLS - SPAN)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    ruled = with_rule(pages, rules)
    urls = distinct_urls(ruled.select("url", (F.col("ruled") == "allow").alias("allowed")))
    urls = shared.saved(scored(urls, log_ratios(model_counts(urls))), "url-scores")
    verdict = F.coalesce("ruled", F.when(F.col("statistic") < F.lit(calibrated(urls)), "block").otherwise("allow"))
    found = ruled.withColumn("_url", F.coalesce("url", F.lit(""))).join(urls.select(F.col("url").alias("_url"), "statistic"), "_url")
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "statistic")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(shared.table(spark, sf_dir, "pages").select("page_id", "url")).drop("statistic")


def _sql() -> str:
    """DuckDB: counts by order and run of characters (those at a url's begin are shorter), probabilities order by order, threshold, verdicts."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    up, low = _LOWER
    levels = f"q0 AS (SELECT key, add_good + times_good / {CHARS} AS good, add_bad + times_bad / {CHARS} AS bad FROM steps WHERE k = 0)"
    for k in range(1, ORDER + 1):
        levels += f""", q{k} AS (SELECT s.key, s.add_good + s.times_good * q.good AS good, s.add_bad + s.times_bad * q.bad AS bad
  FROM steps s JOIN q{k - 1} q ON q.key = right(s.key, {k}) WHERE s.k = {k})"""
    side = lambda c: f"sum({c}) OVER same AS n_{c}, count(*) FILTER ({c} > 0) OVER same AS kinds_{c}"
    step = lambda c: f"CASE WHEN n_{c} > 0 THEN {c} / (n_{c} + kinds_{c}) ELSE 0 END AS add_{c}, CASE WHEN n_{c} > 0 THEN kinds_{c} / (n_{c} + kinds_{c}) ELSE 1 END AS times_{c}"
    return f"""
WITH rules(verdict, h, p) AS (VALUES {rules}), cut AS (
  SELECT page_id, coalesce(url, '') AS url, regexp_extract(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^?#]*') AS rest FROM pages
), hosts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/]*'), '{up}', '{low}') AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM cut
), fits AS (
  SELECT page_id, h || p AS rule, verdict FROM hosts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(p) DESC) = 1
), ruled AS (SELECT page_id, url, host, path, rule, verdict FROM hosts LEFT JOIN fits USING (page_id)
), urls AS (SELECT url, any_value(verdict) AS verdict, count(*) AS copies FROM ruled GROUP BY url
), places AS (SELECT url, verdict, copies, unnest(range(1, length(url) + 1)) AS i FROM urls
), counts AS (
  SELECT k, substr(url, greatest(1, i - k), least(i, k + 1)) AS key,
    CAST(coalesce(sum(copies) FILTER (verdict = 'allow'), 0) AS DOUBLE) AS good, CAST(coalesce(sum(copies) FILTER (verdict = 'block'), 0) AS DOUBLE) AS bad
  FROM places, range(0, {ORDER + 1}) o(k) GROUP BY ALL
), sums AS (SELECT *, {side('good')}, {side('bad')} FROM counts WINDOW same AS (PARTITION BY k, left(key, length(key) - 1))
), steps AS (SELECT k, key, {step('good')}, {step('bad')} FROM sums
), {levels}, scored AS (
  SELECT url, coalesce(sum(CAST(round((ln(q.good) - ln(q.bad)) / {UNIT!r}) AS HUGEINT)) * {UNIT!r} / length(url), 0) AS statistic
  FROM urls LEFT JOIN places USING (url) LEFT JOIN q{ORDER} q ON q.key = substr(url, greatest(1, i - {ORDER}), least(i, {ORDER + 1})) GROUP BY url
), cells AS (
  SELECT CAST(least(greatest(floor((statistic + {SPAN}) * {CELLS / (2 * SPAN)}), 0), {CELLS - 1}) AS INT) AS cell,
    sum(copies) FILTER (verdict = 'allow') AS good, sum(copies) FILTER (verdict = 'block') AS bad
  FROM urls JOIN scored USING (url) WHERE verdict IS NOT NULL GROUP BY ALL
), cuts AS (
  SELECT c, coalesce(sum(good) FILTER (cell < c), 0) / sum(good) + 1 - coalesce(sum(bad) FILTER (cell < c), 0) / sum(bad) AS lost FROM range(0, {CELLS + 1}) r(c), cells GROUP BY c
), best AS (SELECT list(c ORDER BY c) AS c FROM cuts WHERE lost <= (SELECT min(lost) FROM cuts) + 1e-12
), threshold AS (SELECT coalesce(c[len(c) // 2 + 1] * {2 * SPAN / CELLS} - {SPAN}, CAST('-inf' AS DOUBLE)) AS t FROM best)
SELECT page_id, host, path, rule, coalesce(ruled.verdict, CASE WHEN statistic < t THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN scored USING (url), threshold"""


ORACLE_SQL = _sql()
