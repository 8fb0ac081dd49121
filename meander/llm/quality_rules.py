"""Quality rules: a learned decision list over native text statistics.

``text_stats`` measures every whole text with built-in functions only.
``learn`` covers labelled statistics sequentially: each rule is a conjunction of
thresholds, grown on two thirds of the labelled rows, pruned on the rest, and
kept only if it is precise there; the rows it covers are then removed. The list
becomes one ordered ``CASE WHEN`` expression.

Edge cases: a null or empty text has no words and all counts 0 (so the base
rules reject it); repeated rows are judged one by one; an empty table gives an
empty result; extra columns pass through ``text_stats`` and statistics replace
columns of the same name. Without usable labels the list is empty and keeps all
that the base rules keep.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Labelled rows that are learned from at most (the first by hash of the id).
LEARN_ROWS = 8192
#: A text is rejected by the base rules under so many words, or over such a share of repeated ones.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: What rules may test: name and expression over the statistics.
RATIOS = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bang_share": "n_bang / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_bang", "n_digits")


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of each whole text; the work stays inside each row, so nothing is shuffled."""
    base = docs.withColumns({"_t": F.coalesce(F.col(text), F.lit("")), "_w": shared.words(F.col(text))})
    base = base.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "_lines": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")),
            # every 3-word window's hash
            "_h": F.expr("CASE WHEN size(_w) < 3 THEN array() ELSE transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) END"),
        }
    )
    # where any is found twice: (hash, place), equal ones side by side
    pairs = "sort_array(transform(_h, (h, i) -> struct(h, i)))"
    base = base.withColumn("_runs", F.expr(f"CASE WHEN size(array_distinct(_h)) < size(_h) THEN {pairs} ELSE array() END"))
    base = base.withColumns(
        {
            "_at": F.expr(
                "sort_array(transform(filter(_runs, (x, k) -> (k > 0 AND _runs[greatest(k - 1, 0)].h = x.h) "
                "OR (k < size(_runs) - 1 AND _runs[least(k + 1, size(_runs) - 1)].h = x.h)), x -> x.i))"
            ),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.expr(r"regexp_count(_t, '[#*$%&|<>]')").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_upper": F.expr(r"regexp_count(_t, '\\p{Lu}')").cast("long"),
            "n_bang": F.expr("regexp_count(_t, '!')").cast("long"),
            "n_digits": F.expr("regexp_count(_t, '[0-9]')").cast("long"),
        }
    )
    covered = F.expr("aggregate(_at, named_struct('last', -3, 'n', 0), (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n)")
    base = base.withColumn("n_repeat_words", covered.cast("long"))
    # A filter on a statistic must not be pushed below and inlined into its own lambdas: a generator of one row stops that.
    kept = [c for c in docs.columns if c not in COUNTS]
    return base.select(*kept, F.inline(F.array(F.struct(*COUNTS))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """All of ``tests`` (feature, '<=' or '>', threshold) hold."""

    tests: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (F.expr(f"({RATIOS[f]}) {op} {x!r}D") for f, op, x in self.tests))


@dataclass
class DecisionList:
    """Reject what any rule, in order, fits; keep the rest."""

    rules: list[Rule] = field(default_factory=list)

    def rejects(self) -> Column:
        out = F.lit(False)
        for rule in reversed(self.rules):
            out = F.when(F.coalesce(rule.column(), F.lit(False)), F.lit(True)).otherwise(out)
        return out

    def number(self) -> Column:
        """Which rule decides (from 1), 0 for the default."""
        out = F.lit(0)
        for k, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(F.coalesce(rule.column(), F.lit(False)), F.lit(k)).otherwise(out)
        return out


def learn(rows: list[tuple[list[float], bool]], names: list[str], min_cover: int = 5, min_precision: float = 0.9, most_rules: int = 24, most_tests: int = 3, cuts: int = 32) -> DecisionList:
    """Sequential covering of the rows to reject (second member true). Sets of rows are integers used as bit sets."""
    grow = sum(1 << i for i in range(len(rows)) if i % 3 != 2)
    prune = ((1 << len(rows)) - 1) & ~grow
    bad = sum(1 << i for i, (_, b) in enumerate(rows) if b)
    tests: list[tuple[tuple[str, str, float], int]] = []
    for j, name in enumerate(names):
        values = sorted({v[j] for v, _ in rows})
        marks = values if len(values) <= cuts else sorted({values[len(values) * k // cuts] for k in range(1, cuts)} | {values[len(values) * k // 400] for k in (1, 2, 4, 396, 398, 399)})
        for x in marks:
            low = sum(1 << i for i, (v, _) in enumerate(rows) if v[j] <= x)
            tests += [((name, "<=", x), low), ((name, ">", x), ((1 << len(rows)) - 1) & ~low)]

    def precision(s: int) -> float:
        return ((s & bad).bit_count() + 0.5) / (s.bit_count() + 1)

    def worth(s: int) -> float:
        """On rows held back for pruning: right minus wrong, by all covered."""
        n = (s & prune).bit_count()
        return (2 * (s & prune & bad).bit_count() - n) / n if n else -1.0

    left, found = grow | prune, []
    while len(found) < most_rules and (left & grow & bad).bit_count() >= min_cover:
        covered, chosen = left, []
        while len(chosen) < most_tests and precision(covered & grow) < 0.995:
            before = precision(covered & grow)
            best, gain = None, 0.0
            for test, s in tests:
                c = covered & s & grow
                hits = (c & bad).bit_count()
                if hits >= min_cover and (g := hits * (precision(c) - before)) > gain:
                    best, gain = (test, s), g
            if best is None:
                break
            chosen.append(best)
            covered &= best[1]
        while len(chosen) > 1:  # drop the last tests that don't pay on the rows held back
            shorter = reduce(lambda a, b: a & b, (s for _, s in chosen[:-1]), left)
            if worth(shorter) < worth(covered):
                break
            chosen, covered = chosen[:-1], shorter
        if not chosen or precision(covered & grow) < min_precision or precision(covered & prune) < min_precision - 0.05:
            break
        found.append(Rule(tuple(t for t, _ in chosen)))
        left &= ~covered
    return DecisionList(found)


def fit(docs: DataFrame, labels: DataFrame, most: int = LEARN_ROWS, **options) -> DecisionList:
    """Learn from at most ``most`` labelled documents (ids with the smallest hashes; a label is the rounded mean of its rows).

    An id is one row, however often it is repeated: that of the smallest statistics.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("_q"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    pool = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most `most` ids
    stats = text_stats(pool).where(~base_failed())
    rows = stats.select("doc_id", (F.col("_q") < 0.5).alias("bad"), F.array(*[F.expr(f"double({e})") for e in RATIOS.values()]).alias("x"))
    got = rows.groupBy("doc_id", "bad").agg(F.min("x").alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # a row an id
    return learn([(r.x, r.bad) for r in got], list(RATIOS), **options)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``rule`` (its number, 0: none) and ``kept``."""
    out = text_stats(docs).withColumn("base_failed", base_failed()).withColumn("rule", rules.number())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def query(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    rules = fit(docs, shared.table(spark, sf_dir, "labels"))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return judge(docs.select("doc_id", "text"), rules).select(*columns)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    rules = fit(docs, shared.table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")  # so that no column is mistaken for a statistic
    return judge(rows, rules).where("kept").select("row.*")
