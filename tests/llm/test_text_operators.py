"""Operators on documents, against brute force on small fixtures."""

import collections
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from meander.llm import decontaminate, kernels, line_dedup, minhash_dedup, packing, quality_rules
from meander.llm.components import components
from pyspark.sql import functions as F

from ..comparing import oracle, same

EDGE = "doc_id long, text string, score double, node long, n_words string, kept int, row string, n_lines int"
LONG = " ".join(f"w{i % 9973}" for i in range(60_000))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def edge(spark):
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "one two three four five six"), (5, "one two three four five six"), (None, "one two three four five six"), (6, "one"), (7, "one"), (8, LONG + " tail"), (5, "another text of one id")]
    return spark.createDataFrame([(i, t, 0.5, 1, "x", 3, "r", 2) for i, t in texts], EDGE)


def near_brute(rows, percent=75):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    shingles = lambda w: frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    sets = [(i, shingles(words(low(t)))) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), i if i is None or not s else find(i)) for i, s in sets), key=str)


def mutated(rng, base, share):
    return [w if rng.random() > share else f"z{rng.randrange(40)}" for w in base]


def test_near_duplicates(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for size in (30, 60, 150, 400):
        base = [f"b{rng.randrange(2000)}" for _ in range(size)]
        for share in (0, 0, 0.002, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.2):
            for _ in range(4):
                w = mutated(rng, base, share)
                rows.append((n, " ".join(w[: len(w) - rng.randrange(3)])))
                n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "a b"), (n + 3, "A  b"), (n + 4, "a")]
    rng.shuffle(rows)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == near_brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edges(spark, edge):
    got = minhash_dedup.near_duplicates(edge).collect()
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == near_brute(rows)
    assert minhash_dedup.near_duplicates(edge.limit(0)).collect() == []
    kept = minhash_dedup.stage(spark, edge, "")
    assert kept.columns == edge.columns and kept.where("doc_id IN (7, 8)").count() == 0 and kept.where("doc_id IS NULL").count() == 1


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = np.sort(pool[:300]), np.sort(pool[60:])
        sig = minhash_dedup.signatures([a, b])
        errors.append((sig[0] == sig[1]).mean() - 240 / 400)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.055
    one = minhash_dedup.signatures([np.array([7], np.uint64)])[0]
    assert sorted((one >> np.uint64(56)).tolist()) == list(range(128))


def test_signatures_vary_less_than_independent_ranks():
    """Small sets: the ranks of an element differ between components, so estimates vary less than 128 draws would."""
    rng = np.random.default_rng(5)
    for size, common, most in ((24, 16, 0.75), (80, 60, 0.93)):
        errors = []
        for _ in range(1500):
            pool = rng.integers(0, 2**63, 2 * size - common, dtype=np.uint64)
            sig = minhash_dedup.signatures([np.sort(pool[:size]), np.sort(pool[size - common :])])
            errors.append((sig[0] == sig[1]).mean() - common / len(pool))
        j = common / (2 * size - common)
        assert abs(np.mean(errors)) < 0.005 and np.std(errors) < most * np.sqrt(j * (1 - j) / 128)


def test_templates_do_not_all_meet(spark, monkeypatch):
    """Texts of one template, eight slots of 100 values: compared pairs grow about as the texts, components as brute force finds them."""
    rng = random.Random(21)
    fixed = [f"t{k}" for k in range(60)]
    rows = []
    for k in range(1200):
        w = list(fixed)
        for slot in range(8):
            w[3 + 7 * slot] = f"s{slot}v{rng.randrange(100)}"
        rows.append((k, " ".join(w)))
    for k in range(40):  # some are near copies of others
        w = rows[k * 7][1].split()
        w[3 + 7 * rng.randrange(8)] = "other"
        rows.append((3000 + k, " ".join(w)))
    compared, saved = [], minhash_dedup.shared.saved

    def counting(df, name):
        out = saved(df, name)
        if name == "pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(minhash_dedup.shared, "saved", counting)
    for n in (300, 600, 1200):
        some = [r for r in rows if r[0] < n or (r[0] >= 3000 and (r[0] - 3000) * 7 < n)]
        got = minhash_dedup.near_duplicates(spark.createDataFrame(some, "doc_id long, text string")).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == near_brute(some)
    assert compared[2] <= 4 * max(compared[0], 50), compared


def test_sets_of_a_repeated_id(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text)] * 50 + [(1, text.upper()), (2, text + " x y"), (3, "other " * 9), (1, "alone " + text[:20]), (4, "z " + text + " y z")]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == near_brute(rows)


def test_components_in_parts(spark, monkeypatch):
    import meander.llm.components as module

    monkeypatch.setattr(module, "HELD", 7)
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(70, 71)], "a long, b long").coalesce(1)
    assert {r.node: r.component for r in components(links).collect()} == {i: 1 for i in range(2, 61)} | {71: 70}


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (200, 200), (102, 101), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {101: 100, 102: 100}


def leak_brute(docs, items, percent=75):
    out = set()
    for doc_id, text in docs:
        d = words((text or "").lower())
        for item_id, item in items:
            w = words((item or "").lower())
            if not w:
                continue
            weight = lambda x: min(3, max(1, len(x.encode()) // 3))
            bag = lambda v: collections.Counter(tuple(v[k : k + 5]) for k in range(max(1, len(v) - 4)))
            want = bag(w)
            least = decontaminate.least_words(len(w))
            for a in range(least - len(w), len(d) - least + 1):
                have = bag(d[max(0, a) : a + len(w)])
                cost = lambda c: sum(n * sum(map(weight, s)) for s, n in c.items())
                if 100 * cost(want & have) >= percent * cost(want | have):
                    out.add((doc_id, item_id))
    return out


def test_leaks(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghié") for _ in range(rng.randrange(1, 10)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((1, 3, 5, 8, 16, 17, 25, 40, 70, 120))] + [(90, None), (91, ""), (9, "one two three four five six")]
    docs = []
    for k, (_, item) in enumerate(items[4:10] * 3):
        w = item.split()
        for _ in range(k // 6):
            w[rng.randrange(len(w))] = word()
        docs.append((k, " ".join([word() for _ in range(30)] + [x.upper() for x in w] + [word() for _ in range(20)])))
    docs += [(100, None), (101, ""), (102, items[3][1]), (103, items[8][1][:-8]), (104, LONG + " " + items[6][1] + " " + LONG), (105, " ".join(word() for _ in range(300))), (102, items[3][1])]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(d, b).collect()
    small = [x for x in docs if x[0] != 104]
    assert {(r.doc_id, r.item_id) for r in found if r.doc_id != 104} == leak_brute(small, items)
    assert {r.item_id for r in found if r.doc_id == 104} >= {6}
    assert {r.start_word for r in found if r.doc_id == 104 and r.item_id == 6} == {60_000}
    cleaned = decontaminate.clean(d, b)
    assert cleaned.columns == d.columns
    assert {r.doc_id for r in cleaned.collect()} == {i for i, _ in docs} - {r.doc_id for r in found}
    assert decontaminate.leaks(d.limit(0), b).collect() == [] and decontaminate.leaks(d, b.limit(0)).collect() == []
    assert decontaminate.clean(d, b.limit(0)).count() == len(docs)


def test_leaks_with_changed_edges(spark):
    """First and last words of weight 3 changed, further random changes, cut and turned items: all that brute force finds."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.choice((2, 4, 9))))
    long = lambda: "".join(rng.choice("abcdefghij") for _ in range(12))
    items = [(k, " ".join([long(), *(word() for _ in range(n - 2)), long()])) for k, n in enumerate((7, 10, 15, 20, 20, 22, 24, 30, 34, 40, 59, 120))]
    docs = []
    for _, item in items:
        for change in range(8):
            w = item.split()
            w[0], w[-1] = long(), long()
            for _ in range(change % 3):
                w[rng.randrange(len(w))] = word()
            w = w[len(w) // 2 :] + w[: len(w) // 2] if change == 5 else w[len(w) // 6 :] if change == 6 else w
            docs.append((len(docs), " ".join([word() for _ in range(25 * (change % 4 > 0))] + w + [word() for _ in range(15 * (change % 4 < 3 and change != 6))])))
    want = leak_brute(docs, items)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(d, b).collect()
    assert len(want) > 30 and {(r.doc_id, r.item_id) for r in found} == want
    assert any(r.hamming is not None and r.hamming > decontaminate.RADIUS for r in found)
    assert {r.doc_id for r in decontaminate.clean(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_leaks_with_insertions_and_removals(spark):
    """Substitutions, insertions, removals and doublings up to the bound, at places all over the text: what brute force finds."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.choice((1, 3, 5, 8, 12))))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((9, 15, 17, 20, 25, 31, 40, 44, 59, 90))]
    docs = []
    for _, item in items:
        for change in range(24):
            w = item.split()
            for _ in range(rng.randrange(1, 2 + len(w) // 14)):
                k = rng.randrange(len(w))
                w[k : k + 1] = [[word()], [], [w[k], word()], [w[k], w[k]]][change % 4]
            before, after = ([word() for _ in range(rng.choice((0, 1, 30)))] for _ in range(2))
            docs.append((len(docs), " ".join(before + w[: len(w) - (len(w) // 9 if change > 20 else 0)] + after)))
    want = leak_brute(docs, items)
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert len(want) > 40 and {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_leaks_in_passes(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(decontaminate.leaks(docs, items).collect())
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 7)
    assert whole and whole == sorted(decontaminate.leaks(docs, items).collect())
    clean = decontaminate.clean(docs, items)
    assert clean.count() == docs.count() - len({r.doc_id for r in whole})


@pytest.mark.parametrize("module", [decontaminate, line_dedup, minhash_dedup])
def test_query_against_duckdb(spark, module):
    same(module.query(spark, "/root/testdata/sf0.01"), oracle("/root/testdata/sf0.01"), module.ORACLE_SQL)


def test_hamming_blocks_miss_nothing():
    rng = np.random.default_rng(2)
    index = decontaminate.Index([(k, " ".join(f"w{rng.integers(500)}" for _ in range(20))) for k in range(6)])
    (w,) = index.classes
    marks = index.marks
    assert len(marks) == 12
    marks = marks[(index.shift > 0) | (np.arange(12) % 2 == 0)]
    near = np.array([int(m) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 15), replace=False)) for m in np.repeat(marks, 200)], np.uint64)
    at, item, _ = index.candidates(w, near)
    far = np.where((index.shift > 0) | (np.arange(12) % 2 == 0), np.bitwise_count(near[:, None] ^ index.marks[None]), 99)
    assert set(zip(at.tolist(), item.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(far <= decontaminate.RADIUS))))


def test_each_similar_window_holds_an_unchanged_part():
    """Parts weigh so much that a window similar enough has one at distance 0; those within the part radius are all found."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "stone", "considerable", "of", f"w{rng.randrange(400)}"]) for _ in range(rng.randrange(5, 60))) for _ in range(60)]
    index = decontaminate.Index(list(enumerate(texts)))
    assert len(index.parts) and len(index.parts) == len(index.part_item)
    for k, text in enumerate(texts):
        words = text.split()
        weigh = lambda ws: np.clip(np.array([len(w) for w in ws]) // 3, 1, 3)
        hashed = lambda ws: kernels.word_hashes(np.frombuffer(" ".join(ws).encode(), np.uint8), *kernels.word_bounds(np.frombuffer(" ".join(ws).encode(), np.uint8), np.array([0, len(" ".join(ws))]))[:2])
        own = decontaminate.weighted_shingles(hashed(words), weigh(words).astype(np.uint8))
        for _ in range(20):
            edited = list(words)
            for _ in range(rng.randrange(1, 6)):
                edited[rng.choice([0, -1, rng.randrange(len(edited))])] = f"other{rng.randrange(9)}"
            h, w = hashed(edited), weigh(edited).astype(np.uint8)
            both, either = decontaminate.overlap(decontaminate.weighted_shingles(h, w), own)
            if 100 * both >= decontaminate.PERCENT * either:
                runs = decontaminate.Sums(h, w, len(edited)).windows(5)
                assert k in index.parted(runs)[1].tolist()
    near = np.array([int(m) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for m in index.parts for _ in range(5)], np.uint64)
    at, item = index.parted(near)
    far = np.bitwise_count(near[:, None] ^ index.parts[None]) <= decontaminate.PART_RADIUS
    assert set(zip(at.tolist(), item.tolist())) == {(a, int(index.part_item[p])) for a, p in zip(*map(np.ndarray.tolist, np.nonzero(far)))}


def lines_brute(spark, rows):
    def close(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        a, b = sorted((a, b), key=len)
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]

    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS h")
    h = {(r.doc_id, r.text): r.h for r in frame.collect()}
    own = lambda t: [(k, x.strip(" ").lower()) for k, x in enumerate(t.split("\n")) if x.strip(" ")]
    first = {}
    for place, t in sorted((((i is not None, i or 0, h[i, x], k), t) for i, x in set(rows) if x is not None for k, t in own(x))):
        first.setdefault(t, place)
    keep = {p for t, p in first.items() if not any(q < p and close(t, u) for u, q in first.items() if u != t)}
    out = []
    for i, x in rows:
        if x is None:
            out.append((i, None))
            continue
        compared = dict(own(x))
        out.append((i, "\n".join(line for k, line in enumerate(x.split("\n")) if k not in compared or (i is not None, i or 0, h[i, x], k) in keep)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.choice([12, 13, 14, 20, 40, 41, 90]))).strip().ljust(12, "x") for _ in range(25)]

    def edited(s):
        k, i = rng.randrange(4), rng.randrange(len(s))
        return [s, s[:i] + "q" + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + "z" + s[i:]][k]

    line = lambda: edited(edited(rng.choice(base))) if rng.random() < 0.7 else rng.choice(["", "  ", "x", "É", "ab", "b c", "zero", "hero!", "heroes", "x1y2", "é" * rng.randrange(1, 14)])
    rows = [(rng.randrange(60), "\n".join(line() for _ in range(6))) for _ in range(90)]
    rows += [(None, base[3]), (None, None), (5, None), (6, ""), (7, base[0] + "\n" + base[0]), (7, base[0] + "\n" + base[0]), (70, LONG), (71, LONG + "\nend of it all"), (72, base[1].upper())]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == lines_brute(spark, rows)


def test_line_dedup_stage_keeps_clashing_columns(spark, edge):
    out = line_dedup.stage(spark, edge, "")
    assert out.dtypes == edge.dtypes and out.count() == edge.count()
    assert {(r.n_lines, r.row, r.n_words) for r in out.collect()} == {(2, "r", "x")}
    assert line_dedup.stage(spark, edge.limit(0), "").collect() == []
    one = spark.createDataFrame([(1, "a line of text here\na line of text hers", 0)], "doc_id long, text string, n_chars int")
    assert line_dedup.stage(spark, one, "").first()[:] == (1, "a line of text here", 19)


def stats_brute(text):
    w, t = words(text), text or ""
    n = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {p for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_stats(spark, edge):
    rng = random.Random(2)
    texts = [None, "", " \n ", "a b", "a b c a b c", "x\nx\n \ny\nx", "é $é# <|> z", LONG] + ["".join(rng.choice("ab #\n") for _ in range(rng.randrange(300))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.judge(df, quality_rules.DecisionList()).collect():
        want = stats_brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.kept == (not (want[0] < 50 or 100 * want[4] > 50 * want[0])) and r.base_failed != r.kept
    assert quality_rules.judge(edge.limit(0), quality_rules.DecisionList()).collect() == []


def test_decision_list_is_learned_and_precise():
    rng = random.Random(4)
    rows = [([float(rng.randrange(100)), rng.random()], False) for _ in range(600)]
    rows = [(v, (v[0] > 80 and v[1] < 0.5) or v[0] <= 5) for v, _ in rows]
    rules = quality_rules.learn(rows, ["n_words", "mean_word"])
    fits = lambda v: any(all((v[["n_words", "mean_word"].index(f)] <= x) == (op == "<=") for f, op, x in r.tests) for r in rules.rules)
    wrong = [sum(1 for v, b in rows if fits(v) and not b), sum(1 for v, b in rows if b and not fits(v))]
    assert rules.rules and wrong[0] <= 3 and wrong[1] <= 20
    assert quality_rules.learn([], ["n_words"]).rules == [] and quality_rules.learn([([1.0], False)] * 50, ["n_words"]).rules == []


def test_quality_stage(spark, edge, tmp_path):
    labels = spark.createDataFrame([(5, 1, 0), (5, None, 0), (None, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = quality_rules.stage(spark, edge, str(tmp_path))
    assert out.dtypes == edge.dtypes and {r.doc_id for r in out.collect()} <= {4, 8}


def test_packing(spark, edge):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["alpha", "Bêta", "x9", "<|endoftext|>", "don't"]) for _ in range(rng.choice([0, 1, 20, 300, 900, 4000])))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(edge.select("doc_id", "text")).withColumns({"length": F.lit("x"), "_row": F.lit(0), "start": F.lit(None)})
    packed = packing.pack(docs, path, keep_ids=True).collect()
    code = Tokenizer.from_file(path)
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array(code.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            want[r.doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed) == want
    held = collections.defaultdict(list)
    for r in packed:
        held[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == r.length
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(edge.limit(0), path).collect() == []


def test_any_run_of_blanks_is_encoded(spark):
    """Runs that overflow the fast encoder's matcher, alone, between words, mixed, and at the end; ids as ``tokenizers`` gives them."""
    from tokenizers import Tokenizer

    path, n = packing.tokenizer_path(), 1_000_000
    texts = [" " * n + "x", "a" + "\n" * 1_500_000 + "b", "\t" * n, "a " + " \n\t\u3000" * (n // 4) + "b <|endoftext|> c", "x" * n, "7" * n, "é!" * n, "word " * 30_000 + " " * n]
    code, whole, plain = packing.encoder(path), Tokenizer.from_file(path), Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    for text in [*texts, "a<|endoftext|>b", " " * (packing.BLANKS - 1) + "x"]:
        assert code.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids
        assert code.ids(text, special=False).tolist() == plain.encode(text, add_special_tokens=False).ids
        assert code.text(code.ids(text, special=False)) == text
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {r.doc_id: r for r in packing.pack(docs, path).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()}
    assert all(held[k].n == held[k]["all"] == len(code.ids(t)) + 1 for k, t in enumerate(texts))


@pytest.mark.parametrize("blanks,runs", [(" ", 10), ("\t", 10), (" \n\u3000\t", 10), (" ", 3)])
def test_runs_of_blanks_under_the_switch_take_linear_time(blanks, runs):
    from tokenizers import Tokenizer

    n = packing.BLANKS - 1 if runs == 10 else packing.BLANKS // 5
    code, text = packing.encoder(packing.tokenizer_path()), "x".join([(blanks * n)[:n]] * runs)
    began = time.perf_counter()
    ids = code.ids(text).tolist()
    assert time.perf_counter() - began < 5  # a search from every place of a run takes minutes
    assert ids == Tokenizer.from_file(packing.tokenizer_path()).encode(text, add_special_tokens=False).ids


def rounded(length):
    for longest, step, _ in packing.CLASSES:
        if longest is None or length <= longest:
            return -(-length // step) * step


@pytest.mark.parametrize("capacity,draw,most", [
    (2048, lambda rng: 1 + int(rng.expovariate(1 / 400)), 0.01), (2048, lambda rng: 1, 0.01), (2048, lambda rng: rng.randrange(1, 8), 0.03),
    (2048, lambda rng: rng.randrange(20, 60), 0.02), (256, lambda rng: rng.randrange(1, 257), 0.1),
])
def test_packing_wastes_little(capacity, draw, most):
    rng = random.Random(7)
    histogram = collections.Counter(rounded(min(capacity, draw(rng))) for _ in range(40_000))
    table = packing.slots(dict(histogram), capacity)
    used, ranks = collections.Counter(), collections.Counter()
    for size, a, b, first, per in table:
        for k in range(a, min(b, histogram[size])):
            used[first + (k - a) // per] += size
            ranks[size, k] += 1
    assert set(ranks.values()) == {1} and len(ranks) == sum(histogram.values())
    assert max(used.values()) <= capacity and sum(used.values()) >= (1 - most) * capacity * (len(used) - 1)


def test_packing_ranks_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "same words", "x", 5)] * 3000 + [(2, "others", "y", 6)], "doc_id long, text string, sequence_id string, length int")
    got = packing.pack(docs, packing.tokenizer_path()).collect()
    taken = collections.Counter((r.sequence_id, p) for r in got for p in range(r.offset, r.offset + r.length))
    assert len(got) == 3001 and set(taken.values()) == {1} and max(p for _, p in taken) < 2048


def test_column_generation_reaches_the_optimum():
    """Two of 6 and three of 4 fit in 12; demand 2, 3 needs two sequences."""
    found = packing.column_generation(np.array([4, 6]), np.array([3.0, 2.0]), 12)
    assert sum(x for _, x in found) == pytest.approx(2)
    assert sum(x * p for p, x in found) == pytest.approx(np.array([3.0, 2.0]))


def test_sequences(spark):
    packed = packing.pack(spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string"), packing.tokenizer_path(), keep_ids=True)
    out = packing.sequences(packed, pad_id=-1).collect()
    assert len(out) == 1 and out[0].used == 5 and len(out[0].ids) == 2048 and out[0].ids.count(-1) == 2043 and out[0].ids.count(1) == 2
    power = packing.sequences(packed.where("doc_id = 2"), pad_id=-1).collect()
    assert power[0].used == 2 and len(power[0].ids) == 2


def test_pipeline_columns(spark):
    import corpus_pipeline

    docs, sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_dedup", "decontaminate", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, sf)
        assert now.columns == docs.columns, name
        now = spark.createDataFrame(now.toPandas(), docs.schema)
        gone = before.count() - now.count()
        if name == "line_dedup":
            assert gone == 0
            want = lines_brute(spark, [(r.doc_id, r.text) for r in before.collect()])
            assert sorted(((r.doc_id, r.text) for r in now.collect()), key=str) == want
        elif name == "minhash_dedup":
            want = [i for i, _, c in near_brute([(r.doc_id, r.text) for r in before.collect()]) if i == c]
            assert sorted(r.doc_id for r in now.collect()) == sorted(want)
        elif name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            holds = lambda t: any(" ".join(words(i)).lower() in " ".join(words(t)).lower() for _, i in items)
            assert not any(holds(r.text) for r in now.collect())
            assert gone <= before.count() * 0.3
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert last.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("ok")).where("NOT ok").count() == 0
    assert last.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()
