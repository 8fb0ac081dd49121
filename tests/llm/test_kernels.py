import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from meander.llm import features, kernels

TEXT = st.text(alphabet="ab Aé\n\t.x", max_size=60)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_bounds_and_shingles(texts):
    column = kernels.text_array(pa.array(texts, pa.string()))
    data, off = kernels.raw(column)
    starts, ends, rows = kernels.word_bounds(data, off)
    got = [[bytes(data[a:b]).decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(rows[:-1], rows[1:])]
    assert got == [words(t) for t in texts]
    sets = list(kernels.shingle_sets(column))
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    want = [set(zip(*[w[k:] for k in range(5)])) if len(w := words(low(t))) >= 5 else ({tuple(w)} if w else set()) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in want]
    for a in range(len(texts)):
        for b in range(len(texts)):
            assert len(np.intersect1d(sets[a], sets[b])) == len(want[a] & want[b])


def test_blocks_and_slices():
    column = kernels.text_array(pa.array(["x" * 10, None, "", "y z" * 400, "q"], pa.string()))
    assert list(kernels.blocks(column, 12)) == [(0, 3), (3, 4), (4, 5)]
    assert [len(s) for s in kernels.shingle_sets(column[1:])] == [0, 0, len(set(zip(*[words("y z" * 400)[k:] for k in range(5)]))), 1]


def test_features_do_not_depend_on_neighbours():
    texts = ["One two three.\nOne two three.\n", "", "ÉTÉ!! 12 %% word", "a " * 5000]
    column = kernels.text_array(pa.array(texts))
    together = features.features(column)
    for k in range(len(texts)):
        assert np.allclose(together[k], features.features(column[k : k + 1])[0])
    assert not together[1].any()
