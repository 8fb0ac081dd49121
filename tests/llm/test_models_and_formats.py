"""Learned operators on held-out rows; archives and chats by round trip and DuckDB."""

import bisect
import collections
import functools
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from meander.llm import chat_format, features, kernels, packing, quality_classifier, quality_rules, toxicity, url_filter, warc
from pyspark.sql import functions as F

from ..comparing import oracle, same

SF = "/root/testdata/sf0.1"


def auc(scores, labels):
    rank = np.argsort(np.argsort(scores)) + 1
    pos = labels == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("module,label,least", [(quality_classifier, "quality", 0.97), (toxicity, "toxic", 0.85)])
def test_held_out(spark, module, label, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = module.query(spark, SF).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 500 and auc(held.score.to_numpy(), held[label].to_numpy()) > least
    assert (held.predicted == held[label]).mean() > 0.94
    assert ((got.score >= module.THRESHOLD) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


@pytest.mark.parametrize("module,label", [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_edges(spark, module, label):
    docs = spark.createDataFrame([(0, None, 1.0), (1, "", 1.0), (2, "some text", 1.0), (2, "some text", 1.0), (None, "x", 1.0), (3, "long " * 40_000, 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 1) for i in range(4)], "doc_id long, quality int, toxic int")
    apply = (lambda m: quality_classifier.score(docs, m)) if label == "quality" else (lambda m: toxicity.tag(docs, m))
    for labels in (none, one):
        scores = [r.score for r in apply(module.fit(docs, labels)).collect()]
        assert len(scores) == 6 and len({round(s, 9) for s in scores}) == 1
    assert module.judged(apply(module.fit(docs, none)).limit(0), 0.5).collect() == []


def labelled(spark):
    rng = random.Random(11)
    text = lambda bad: " ".join(rng.choice("stone river cloud paper green".split() + (["vile", "rotten", "###"] if bad else ["calm", "kind"])) for _ in range(rng.randrange(52, 90)))
    rows = [(k, text(k % 3 == 0), "x") for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    return docs, docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("quality"), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("toxic"))


def plain_model(model):
    if isinstance(model, quality_rules.DecisionList):
        return model.rules
    if isinstance(model, toxicity.Field):
        return [model.tables.tolist(), model.bias, model.moves.tolist(), model.scale.tolist()]
    return [model.base, [x.tolist() for x in model.cuts + model.tables], [(p[0], p[1], *(x.tolist() for x in p[2:])) for p in model.pairs]]


@pytest.mark.parametrize("module", [quality_rules, quality_classifier, toxicity])
def test_a_repeated_id_is_one_learning_row(spark, module):
    docs, labels = labelled(spark)
    many = docs.unionByName(docs.where("doc_id IN (3, 4)").crossJoin(spark.range(20_000).drop("id"))).repartition(5)
    once = plain_model(module.fit(docs, labels))
    assert once and once == plain_model(module.fit(many, labels))


def test_conflicting_labels_of_equal_texts(spark):
    docs, labels = labelled(spark)
    copies = docs.unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", "label"))
    told = labels.unionByName(labels.select((F.col("doc_id") + 1000).alias("doc_id"), "quality", F.when(F.col("doc_id") < 9, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic")))
    models = [plain_model(toxicity.fit(copies.repartition(n), told.repartition(n))) for n in (1, 7)]
    assert models[0] == models[1]


def features_brute(text):
    """The eighteen numbers, one by one."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return [0.0] * 18
    size, low, raw = [len(w.encode()) for w in words], [w.lower() for w in words], text.encode()
    n, many = len(words), sum(size)
    share = lambda chars: sum(c in chars for c in text)
    lines = text.split("\n")
    runs = collections.Counter(zip(low, low[1:], low[2:])) if n >= 3 else collections.Counter([tuple(low)])
    equal, count = collections.Counter(x for x in lines if x), collections.Counter(low)
    return [
        np.log1p(n), many / n, share("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / many, share("0123456789") / many, share(".,;:?-'\"()") / n, share("!") / n, share("#*$%&|<>") / many, share("@/\\_=+{}[]~^`") / many, sum(b >= 128 for b in raw) / many,
        np.log1p(len(lines)), n / len(lines), sum(v for v in equal.values() if v > 1) / len(lines), sum(v for v in runs.values() if v > 1) / n, len(count) / n, max(count.values()) / n,
        sum(s <= 3 for s in size) / n, sum(s >= 12 for s in size) / n, sum(w in features.STOP_WORDS for w in low) / n,
    ]


def test_quality_scores_against_plain_sums(spark):
    rng = random.Random(9)
    texts = ["", " \n", "one", "one two", "É!", "\n\n a \n\n"] + ["".join(rng.choice("ab Tthe é\n!#.7/ ") for _ in range(rng.randrange(400))) for _ in range(60)]
    x = np.array([features_brute(t) for t in texts])
    got = features.features(kernels.text_array(pa.array(texts)))
    assert np.allclose(got, x, atol=1e-9), [(features.NAMES[b], repr(texts[a])) for a, b in zip(*np.nonzero(~np.isclose(got, x, atol=1e-9)))][:5]
    model = quality_classifier.fit(*labelled(spark))
    assert model.pairs
    scores = {r.doc_id: r.score for r in quality_classifier.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, row in enumerate(got.tolist()):
        total = model.base + sum(table[bisect.bisect_right(cuts.tolist(), v)] for v, cuts, table in zip(row, model.cuts, model.tables))
        total += sum(t[bisect.bisect_right(ca.tolist(), row[a]), bisect.bisect_right(cb.tolist(), row[b])] for a, b, ca, cb, t in model.pairs)
        assert scores[k] == pytest.approx(1 / (1 + np.exp(-total)))


def test_toxicity_scores_and_spans_against_plain_recursions(spark):
    model = toxicity.fit(*labelled(spark))
    rng = random.Random(10)
    texts = ["", "\n \n", "vile", "Été vile!\nkind"] + [" ".join(rng.choice(["vile", "rotten", "calm", "stone", "é", "rot\n", "VILEST,", "paper;"]) for _ in range(rng.randrange(40))) for _ in range(40)]
    mask = (1 << toxicity._BITS) - 1
    hashed = lambda w: int(kernels.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    kind = lambda v, k: int(kernels.mix(np.array([(v + (k << 56)) % 2**64], np.uint64))[0]) & mask
    edge = lambda bs: functools.reduce(lambda h, b: (h * 257 + b) % 2**64, bs, 0)

    def chain(line):
        tokens = [m.group().encode() for m in re.finditer(r"[0-9a-z\x80-\U0010ffff]+", line)]
        h = [hashed(w) for w in tokens]
        unary = []
        for k, w in enumerate(tokens):
            parts = [(h[k - 1] if k else 1), (h[k + 1] if k + 1 < len(h) else 2), edge(w[min(i, len(w) - 1)] for i in range(3)), edge(w[max(len(w) - 1 - i, 0)] for i in range(3))] + [hashed(w[:n]) for n in toxicity._BEGINNINGS]
            unary.append(model.bias + sum(model.tables[j, f] for j, f in enumerate([h[k] & mask] + [kind(v, j) for j, v in enumerate(parts, 1)])))
        forward = [np.array([0.0, u]) for u in unary[:1]]
        for u in unary[1:]:
            forward.append(np.logaddexp.reduce(forward[-1][:, None] + model.moves, axis=0) + [0, u])
        backward = [np.zeros(2)]
        for u in unary[:0:-1]:
            backward.insert(0, np.logaddexp.reduce(model.moves + (backward[0] + [0, u])[None], axis=1))
        return [float((f + b) @ [-1, 1]) for f, b in zip(forward, backward)]

    got = {r.doc_id: r for r in toxicity.tag(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(texts):
        low, logits, spans, at = text.lower(), [], [], 0
        for line in low.split("\n"):
            found = chain(line)
            last = None
            for m, logit in zip(re.finditer(r"[0-9a-z\x80-\U0010ffff]+", line), found):
                if logit >= 0 and last:
                    spans[-1] = (spans[-1][0], at + m.end())
                elif logit >= 0:
                    spans.append((at + m.start(), at + m.end()))
                last = logit >= 0
            logits += [min(30, max(-30, x)) for x in found]
            at += len(line) + 1
        x = [max(logits, default=-30), np.log(1e-6 + sum(1 / (1 + np.exp(-v)) for v in logits)), np.log1p(len(logits))]
        assert got[k].score == pytest.approx(1 / (1 + np.exp(-(model.scale[0] + model.scale[1:] @ x))), abs=1e-5), repr(text)
        assert [(s.start, s.end) for s in got[k].spans] == spans
    assert any(r.spans for r in got.values())


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    unary, moves, chains = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 4, 5, 9])
    forward, backward = toxicity.log_odds(unary, moves, chains)
    for a, b in zip(chains[:-1], chains[1:]):
        total = np.zeros((b - a, 2))
        for y in itertools.product((0, 1), repeat=int(b - a)):
            p = np.exp(sum(u * s for u, s in zip(unary[a:b], y)) + sum(moves[s, t] for s, t in zip(y, y[1:])))
            for k, s in enumerate(y):
                total[k, s] += p
        assert np.allclose(forward[a:b] + backward[a:b], np.log(total[:, 1] / total[:, 0]))


def test_spans_are_code_points(spark):
    docs = spark.createDataFrame([(k, f"Été {'vile' if k % 2 else 'kind'}! word{k}\nand more") for k in range(80)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    found = {r.doc_id: r for r in toxicity.tag(docs, toxicity.fit(docs, labels)).collect()}
    assert [(s.start, s.end) for s in found[1].spans] == [(4, 8)] and found[2].spans == []
    assert min(found[k].score for k in range(1, 80, 2)) > max(found[k].score for k in range(0, 80, 2))


def test_pair_tables_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    alone, pairs = quality_classifier.train(x, y, pairs=0), quality_classifier.train(x, y, pairs=3)
    assert auc(alone.scores(x), y) < 0.8 < 0.95 < auc(pairs.scores(x), y)


def rule_brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h), len(p), h + p) for _, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[2] if fit else None


URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.net", "http://example.net/", "https://a.example.net/en/1?x=/de/", "http://example.net/EN/", "http://notexample.net/en/x", "http://example.com/de/a", "http://x.example.com/de", "ftp://ex.org/fr/#y", "http://org/fr/", "http://a.org?/fr/", "http://a.b/c://d/e", "http://Ä.org/fr/ü", "http://net/\nx", "x://a.net#/", "http://a.net:80/"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id long, url string")
    for r in url_filter.with_rule(pages).collect():
        assert (r.host, r.path, r.rule) == rule_brute(URLS[r.page_id]), URLS[r.page_id]


def test_url_verdicts(spark):
    ruled = [(k, f"http://good{k % 9}.example.net/en/{k}") for k in range(60)] + [(k, f"http://casino-win{k % 9}.bets.net/{k}") for k in range(60, 120)]
    free = [(200, "http://good5.example.com/en/77"), (201, "http://casino-win7.bets.com/88"), (202, None), (203, ""), (200, "http://good5.example.com/en/77")]
    pages = spark.createDataFrame([(i, u, "x") for i, u in ruled + free], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in url_filter.judge(pages.select("page_id", "url")).collect()}
    assert (got[200].verdict, got[201].verdict) == ("allow", "block") and got[202].statistic == 0.0
    assert {got[k].verdict for k in range(60)} == {"allow"} and {got[k].verdict for k in range(60, 120)} == {"block"}
    alone = url_filter.judge(spark.createDataFrame(free, "page_id long, url string")).collect()
    assert len(alone) == 5 and {r.verdict for r in alone} == {"allow"}
    assert url_filter.judge(pages.select("page_id", "url").limit(0)).collect() == []


def test_counts_follow_the_corpus(spark):
    rows = spark.createDataFrame([(f"http://a{k}.org", k % 2 == 0) for k in range(40)], "url string, allowed boolean")
    once, twice = url_filter.counts(rows), url_filter.counts(rows.unionByName(rows))
    assert np.allclose(twice[:, :2], 2 * once[:, :2]) and np.allclose(twice[:, 2], once[:, 2])


def test_url_statistics_are_exact(spark):
    """More distinct contexts than any table of 65,536 cells holds, NUL bytes and repeated urls, against counts in dicts."""
    rng = random.Random(8)
    text = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé0123456789\x00") for _ in range(rng.randrange(20, 60)))
    urls = [f"http://{rng.choice(('a.example.net/en/', 'b.net/', 'c.com/'))}{text()}" for _ in range(3000)]
    urls += urls[:200] + [urls[0]] * 50 + ["", None, "\x00\x00", "no scheme, \U0001f600 \U0010ffff", "http://c.com/" + text() * 3000]
    order = url_filter.ORDER
    grams = lambda u: [((-1,) * order + tuple(u))[k : k + order + 1] for k in range(len(u))]
    n, seen = collections.Counter(), collections.defaultdict(set)
    for u in urls:
        rule = rule_brute(u)[2]
        if rule:
            side = next(v for v, h, p in url_filter.RULES if h + p == rule) == "allow"
            for g in grams(u):
                for k in range(order + 1):
                    context = (side, g[order - k : order])
                    n[context] += 1
                    n[*context, g[-1]] += 1
                    seen[context].add(g[-1])
    assert sum(len(c) == 2 and len(c[1]) == order for c in n) > 65536

    def statistic(u):
        total = 0.0
        for g in grams(u):
            p = {True: 1 / 0x110000, False: 1 / 0x110000}
            for side in p:
                for k in range(order + 1):
                    c = (side, g[order - k : order])
                    if n[c]:
                        p[side] = (n[*c, g[-1]] + len(seen[c]) * p[side]) / (n[c] + len(seen[c]))
            total += np.log(p[True]) - np.log(p[False])
        return total / max(1, len(u))

    pages = spark.createDataFrame([(k, u, "x", "y", "z") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string, id string")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(urls)
    assert np.allclose([r.statistic for r in got], [statistic(urls[r.page_id] or "") for r in got], rtol=0, atol=1e-8)


def test_url_query(spark):
    same(url_filter.query(spark, "/root/testdata/sf0.01"), oracle("/root/testdata/sf0.01"), url_filter.ORACLE_SQL)


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "x" * 150), (2, None, "x" * 150), (None, "u\nv", "x" * 150), (3, "b%0Ac", None), (4, "c", ""), (5, "d", "y" * 99), (6, "d", "y" * 99), (1, "http://a", "x" * 150), (7, "é", "é" * 200_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    folders = [warc.shared.new_path(spark, "warc") for _ in range(2)]
    files = [sorted(warc.write_warc(p, f, roll=400).collect()) for p, f in zip((pages, pages.repartition(5)), folders)]
    assert files[0] == files[1] and len(files[0]) > 3  # the same files, however the rows were dealt
    got = sorted(((r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, folders[0]).collect()), key=str)
    revisits = {(2, None), (None, "u\nv")}
    want = sorted(((i, u, len((h or "").encode()), "revisit" if (i, u) in revisits else "response", 1 if (i, u) in revisits else None) for i, u, h in rows), key=str)
    assert got == want
    warc.write_warc(pages.limit(0), empty := warc.shared.new_path(spark, "warc"))
    assert warc.read_warc(spark, empty).collect() == []


def test_warc_shards_follow_the_data(spark):
    """Outlying and extreme ids, one repeated id, many null ids, one hot payload: shards stay even, and many tasks read."""
    rows = [(k, f"u{k}", f"{k} " * 400) for k in range(300)] + [(2**63 - 1, "far", "z" * 900), (-(2**63), "low", "z" * 900)]
    rows += [(77, f"v{k}", f"again {k} " * 200) for k in range(300)] + [(None, None, f"none {k} " * 200) for k in range(300)] + [(1000 + k, "hot", "h" * 2000) for k in range(300)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, shard int")
    files = [warc.write_warc(p, warc.shared.new_path(spark, "warc"), shard=50_000).collect() for p in (pages, pages.repartition(7))]
    assert sorted(files[0]) == sorted(files[1])
    per = collections.Counter()
    for f in files[0]:
        per[f.shard] += f.records
    assert len(per) > 20 and max(per.values()) < 150 and sum(per.values()) == len(rows)
    folder = warc.shared.new_path(spark, "warc")
    warc.write_warc(pages, folder, shard=50_000)
    read = warc.read_warc(spark, folder)
    assert read.rdd.getNumPartitions() == len(files[0]) and read.select(F.spark_partition_id()).distinct().count() > 20
    first = {}
    for i, _, h in rows:
        first[h] = min(first.get(h, i), i, key=lambda x: (x is None, x))
    want = collections.Counter((i, len(h), "response" if i == first[h] else "revisit") for i, _, h in rows)
    assert collections.Counter((r.page_id, r.payload_bytes, r.record_type) for r in read.collect()) == want


def test_warc_damage_is_found(spark):
    data = warc.record(1, "u", b"payload" * 30, "d" * 64, 210, None)
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(data.replace(b"payload", b"pay1oad", 1))


def test_warc_query(spark):
    same(warc.query(spark, "/root/testdata/sf0.01"), oracle("/root/testdata/sf0.01"), warc.ORACLE_SQL)


def test_chat_query(spark):
    same(chat_format.query(spark, "/root/testdata/sf0.01"), oracle("/root/testdata/sf0.01"), chat_format.ORACLE_SQL)


@settings(max_examples=300, deadline=None)
@example("</s>[INST] ok [/INST]")
@given(st.text(alphabet="<>[]/\\sINT SYROLEx", max_size=40))
def test_escaping(text):
    held = chat_format.escape(text)
    assert chat_format.unescape(held) == text and not any(m in held for m in chat_format.MARKERS)


def test_chats_of_all_kinds(spark):
    turns = [(4, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(-2000, 3000)] + [(5, 0, "user", " " * 1_000_000 + "x"), (5, 1, "assistant", "a" + "\n" * 1_500_000 + "b<|endoftext|>")]
    turns += [(1, 1, "assistant", "b [INST]"), (1, 0, "user", "a"), (1, 2, "tool</s>", "[\\INST]"), (1, 2, "tool</s>", "[\\INST]"), (2, 0, None, None), (2, None, "system", "é" * 30_000), (None, 0, "assistant", ""), (3, 0, "assistant", "x"), (3, 0, "assistant", "<s>y")]
    frame = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, ids string")
    path = packing.tokenizer_path()
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(frame, path), path).collect()}
    import hashlib

    for conv in (1, 2, 3, 4, 5, None):
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_chats(frame.limit(0), path), path).collect() == []
    parts = chat_format.format_chats(frame.where("conv_id IN (1, 4)"), path).orderBy("conv_id", "part").collect()
    parts, long = parts[:4], parts[4:]
    assert [p.part for p in long] == list(range(5000)) and [p.offset for p in long] == list(np.cumsum([0] + [len(p.ids) for p in long])[:-1])
    assert [p.offset for p in parts] == list(np.cumsum([0] + [len(p.ids) for p in parts])[:-1]) and all(len(p.ids) == len(p.mask) for p in parts)
