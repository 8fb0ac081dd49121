"""Fill-in-the-middle, SentencePiece and prefix tries against plain Python, the library and DuckDB."""

import binascii
import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import example, given, settings
from hypothesis import strategies as st
from meander.llm import fill_middle, piece_codec, prefix_trie

from ..comparing import oracle, same

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture
def edge(spark):
    texts = [None, "", "\n", "a", "a\n", "\n\nb", "one <S> two", "x\r\ny z", "word " * 60_000 + "\nend", "\n" * 50_000, " ", "  a  b ", "a▁b ▁c", "\x00", "<s>[INST]<0x0A>", "日本語 \U0001f389 é", "x" * 100_000]
    rows = [(k, t, "n", "f") for k, t in enumerate(texts)] + [(3, "a", None, "f"), (None, "a\nb\nc", "n", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, form string")


# -- fill in the middle


def plain_fim(doc_id, text):
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    digest, n = sha(f"7:{'' if doc_id is None else doc_id}"), len(lines)
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < 50:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_middle(spark, edge):
    got = fill_middle.invert(fill_middle.transform(edge)).collect()
    want = collections.Counter((r.doc_id, *plain_fim(r.doc_id, r.text or ""), r.text or "") for r in edge.collect())
    assert collections.Counter(map(tuple, got)) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.invert(fill_middle.transform(edge.limit(0))).collect() == []


@pytest.mark.parametrize("sf", [SMALL, SF])
def test_fill_middle_query(spark, sf):
    same(fill_middle.query(spark, sf), oracle(sf), fill_middle.ORACLE_SQL)


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="a\né\U0001f389", max_size=40), st.integers(0, 45), st.integers(1, 7))
def test_ropes(text, at, size):
    whole, fill_middle.LEAF = fill_middle.LEAF, size
    try:
        rope = fill_middle.rope(text)
        assert "".join(fill_middle.leaves(rope)) == text and (rope.chars, rope.breaks) == (len(text), text.count("\n"))
        a, b = map(fill_middle.text_of, fill_middle.split_chars(rope, at))
        assert (a, b) == (text[:at], text[at:])
        a, b = map(fill_middle.text_of, fill_middle.split_lines(rope, at))
        assert (a, b) == ("".join(text.splitlines(True)[:at]), "".join(text.splitlines(True)[at:]))
        for doc_id in range(5):
            out = fill_middle.rearranged(doc_id, text)
            assert out == plain_fim(doc_id, text) and fill_middle.restored(out[4], out[1]) == text
    finally:
        fill_middle.LEAF = whole


def test_a_split_rebuilds_only_the_way_down():
    rope = fill_middle.rope("line\n" * 200_000)
    a, b = fill_middle.split_lines(rope, 123_457)
    nodes = lambda t: {id(t)} | (nodes(t.left) | nodes(t.right) if isinstance(t, fill_middle.Tree) else set())
    assert len((nodes(a) | nodes(b)) - nodes(rope)) < 40 and (a.breaks, b.breaks) == (123_457, 76_543)


def test_rates(spark):
    docs = spark.createDataFrame([(k, "a\nb\nc\n") for k in range(2000)], "doc_id long, text string")
    for fim, spm in ((0, 50), (100, 0), (100, 100), (50, 50)):
        forms = collections.Counter(r.form for r in fill_middle.transform(docs, 7, fim, spm).select("form").collect())
        assert abs(forms["plain"] - 20 * (100 - fim)) < 150 and abs(forms["spm"] - 20 * fim * spm / 100) < 150


# -- SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())


def own_ids(texts):
    ids, rows, said = piece_codec.codec(piece_codec.model_path()).encode(pa.array(texts, pa.large_string()))
    out = [ids[a:b].tolist() for a, b in zip(rows[:-1], rows[1:])]
    assert said.to_pylist() == [" ".join(map(str, x)) for x in out]
    return out


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ▁ab\n\tthein.,0129<s>x"), st.characters(codec="utf-8")), max_size=60), max_size=6))
@example(["▁", " ▁ ", "", "a▁▁ b", "\U0010ffff", "x\n\n y", "\r\n"])
def test_ids_are_the_librarys(texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())
    assert own_ids(texts) == lib.encode(texts)


@pytest.mark.parametrize("short", [1, 4, 48])
def test_heaps_and_steps_agree(library, monkeypatch, short):
    monkeypatch.setattr(piece_codec, "SHORT", short)
    code = piece_codec.codec(piece_codec.model_path())
    code.young.clear(), code.old.clear()
    rng = random.Random(short)
    texts = ["".join(rng.choice("  ▁theinaorst\n.1é日本\U0001f389") for _ in range(rng.randrange(120))) for _ in range(500)]
    assert own_ids(texts) == library.encode(texts)
    code.young.clear(), code.old.clear()


def test_generations_of_words(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "REMEMBERED", 5)
    texts = ["the first of many words in a row of words, and the first again"] * 3
    assert own_ids(texts) == library.encode(texts)


def test_long_parts(library):
    texts = [" " * 200_000 + "x" * 200_000, "日本" * 50_000, "!" * 100_000]
    assert own_ids(texts) == library.encode(texts)


def test_documents(spark, edge, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = collections.Counter()
    for doc_id, text in rows:
        ids = library.encode(text, add_eos=True)
        want[doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert collections.Counter(map(tuple, piece_codec.digests(edge.unionByName(docs, True).limit(0), piece_codec.model_path()).collect())) == collections.Counter()
    assert collections.Counter(map(tuple, piece_codec.digests(docs, piece_codec.model_path()).collect())) == want
    for check in ("parts", "texts"):
        encoded = piece_codec.encode(docs, piece_codec.model_path(), check)
        assert collections.Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == collections.Counter((d, tuple(library.encode(t, add_eos=True))) for d, t in rows)
    back = piece_codec.decode(encoded, piece_codec.model_path())
    assert collections.Counter(map(tuple, back.collect())) == collections.Counter((d, t.replace("▁", " ")) for d, t in rows)


def test_a_difference_is_an_error():
    code = piece_codec.codec(piece_codec.model_path())
    code.confirm({}, {})
    for parts, texts in (({"▁the": np.int32(5).tobytes()}, {}), ({}, {"the": np.int32(5).tobytes()})):
        with pytest.raises(ValueError, match="otherwise"):
            code.confirm(parts, texts)


# -- prefix tries


def plain_trie(rows):
    """Nodes by dictionaries of whole prefixes."""
    turns = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(t[2], t[4]) for t in sorted(x)] for c, x in turns.items()}
    members, ended = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(turns):
        h, g = binascii.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        path = tuple(turns.get(g, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ended[path].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    out = collections.Counter()
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        out[m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], sum(not children[q] for q in below), saved, sha(",".join(map(str, ended[p])))] += 1
    return out


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, total string")


def drawn(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*rng.sample(range(400), 60), -1, -100, -150, 5_000_000_123]:
        for turn in range(rng.choice([1, 2, 3, 6, 9, 14])):
            rows.append((c, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", "user", None, ""]), rng.choice(["a", "a", "a", "b", None, "é\U0001f389"])))
    rows += rng.sample(rows, 20) + [(None, 1, "user", "left out")]
    rng.shuffle(rows)
    return rows


def tried(spark, rows):
    return collections.Counter(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.placed(conversations(spark, rows)))).collect()))


@pytest.mark.parametrize("seed,size", [(1, 1024), (2, 4), (3, 2)])
def test_tries(spark, monkeypatch, seed, size):
    monkeypatch.setattr(prefix_trie, "RANGE", size)
    monkeypatch.setattr(prefix_trie, "JOINED", 2)
    rows = drawn(seed)
    assert tried(spark, rows) == plain_trie(rows)


def test_tries_of_few_rows(spark):
    assert tried(spark, [(None, 1, "user", "x")]) == collections.Counter()
    for rows in ([(7, None, None, None)], [(101, 0, "user", "x")], [(100, 0, "user", "x"), (101, 0, "user", "y")]):
        assert tried(spark, rows) == plain_trie(rows)


def test_snapshots_of_one_conversation(spark, monkeypatch):
    """Each conversation goes on where the one before it ended, one long one holds a third of all rows, and copies are many."""
    monkeypatch.setattr(prefix_trie, "RANGE", 16)
    growing = [(100 * k, t, "user", f"t{t}") for k in range(1, 25) for t in range(k)]
    forked = [(10_000 + 100 * k, t, "user", f"t{t}" if t < k else f"own{k}") for k in range(1, 12) for t in range(k + 1)]
    long = [(70_000, None if t % 2 else 5, "user", f"w{t}") for t in range(300)]
    copies = [(80_000 + k, 0, "user", "same") for k in range(200)]
    rows = growing + forked + long + copies
    assert tried(spark, rows) == plain_trie(rows)


@pytest.mark.parametrize("sf", [SMALL, SF])
def test_trie_query(spark, sf):
    same(prefix_trie.query(spark, sf), oracle(sf), prefix_trie.ORACLE_SQL)
