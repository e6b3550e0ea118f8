from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lorespan.llm import text as T
from tests.llm.helpers import ALNUM, BLANK, LOWER

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("abAB é漢\t\n\v .,-1_ "), max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_patterns(texts):
    raw, offsets = T.buffers(pa.array(texts, pa.string()))
    for alphabet, pattern, lower in ((T.BLANK_SEPARATED, BLANK, False), (T.ALNUM_LOWERED, ALNUM, True)):
        words = T.Words(raw, offsets, alphabet, lower=lower)
        found = [raw[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends, strict=True)]
        expected = [pattern.findall((t or "").translate(LOWER) if lower else t or "") for t in texts]
        assert [w.translate(LOWER) if lower else w for w in found] == [w for ws in expected for w in ws]
        assert words.counts.tolist() == [len(ws) for ws in expected]
        same = {}
        for w, h in zip(found, words.hashes().tolist(), strict=True):
            assert same.setdefault(w.translate(LOWER) if lower else w, h) == h
        assert len(set(same.values())) == len(same)


def test_windows_equal_where_words_do():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 3, 4000).astype(np.uint64)
    for size in (2, 5, 9, 50):
        seen = {}
        for i, h in enumerate(T.windows(hashes, size).tolist()):
            assert seen.setdefault(tuple(hashes[i : i + size].tolist()), h) == h
        assert len(set(seen.values())) == len(seen)


def test_slices_cover_everything_once():
    texts = ["a" * n for n in (0, 10, 5000, 3, 0, 700, 90000, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["k", "t"])
    parts = list(T.slices(iter([batch]), "t", limit=1000))
    assert [k for p, _, _ in parts for k in p.column(0).to_pylist()] == [*range(8)]
    assert [n for _, _, o in parts for n in np.diff(o).tolist()] == [len(t) for t in texts]
