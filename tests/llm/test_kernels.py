import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import kernels as K
from lodestone.llm import repeats as R
from lodestone.llm import suffix
from lodestone.llm.suffix import Spool, suffixes

TEXTS = st.lists(st.one_of(st.none(), st.text("aé \t\n\x1f", max_size=30)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words(texts):
    data, offsets = K.text_bytes(pa.array(texts, pa.string()))
    w = K.Words(data, offsets)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    got = [bytes(data[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)]
    assert got == [x for v in words for x in v] and np.diff(w.rows).tolist() == [len(v) for v in words]
    h = w.hashes()
    assert len({*zip(got, h.tolist(), strict=True)}) == len(set(got)) == len(set(h.tolist()))


def test_pack():
    x = {"a": np.arange(5, dtype=np.int32), "b": np.zeros(0, np.uint64), "c": np.array([True, False])}
    y = K.unpack(K.pack(**x))
    assert all(np.array_equal(x[k], y[k]) and x[k].dtype == y[k].dtype for k in x)


def test_count_min_never_underestimates():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 500, 3000).astype(np.uint32)
    whole = R.CountMin(8)
    for part in np.array_split(v, 7):
        whole.merge(whole.sparse(*np.unique(part, return_counts=True)))
    u, n = np.unique(v, return_counts=True)
    assert (whole.estimate(u) >= np.minimum(n, 255)).all()


@pytest.mark.parametrize("batch", [5, 1 << 18])
@pytest.mark.parametrize("memory", [0, 1 << 30])
def test_suffixes(batch, memory, monkeypatch):
    monkeypatch.setattr(suffix, "BATCH", batch)
    monkeypatch.setattr(Spool, "memory", memory)
    rng = np.random.default_rng(batch + memory % 7)
    for trial in range(80):
        t = rng.integers(1, 2 + trial % 5, int(rng.integers(1, 60 if trial % 4 else 300)))
        if trial % 3 == 0:
            t = np.tile(t[:4], 12)
        t = np.append(t, 0).astype(np.uint8)
        with Spool() as spool:
            sa, common = (np.concatenate(x).tolist() for x in zip(*suffixes(t, int(t.max()) + 1, 7, spool), strict=True))
            assert (spool.files > 0) == (memory == 0)
        s = t.tolist()
        assert sa == sorted(range(len(s)), key=lambda i: s[i:])
        for i in range(1, len(s)):
            a, b = s[sa[i - 1] :], s[sa[i] :]
            assert common[i] == min(7, next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))))


def test_names_of_names():
    """Suffixes of a string of many names, with repeats that chain."""
    rng = np.random.default_rng(3)
    for t in (rng.integers(1, 500, 3000), np.tile(np.arange(1, 40), 50), np.repeat(rng.integers(1, 9, 60), 40), np.tile([3, 3, 1, 2], 200)):
        t = np.append(t, 0).astype(np.int32)
        with Spool() as spool:
            sa = suffix.sort_names(t, int(t.max()) + 1, spool).tolist()
        s = t.tolist()
        assert sa == sorted(range(len(s)), key=lambda i: s[i:])


def test_strings_of_alternating_patterns_differ():
    """Strings that polynomials modulo a power of two can't tell apart."""
    w = "a"
    while len(w) < 4096:
        w += w.translate(str.maketrans("ab", "ba"))
    texts = [w, w.translate(str.maketrans("ab", "ba"))]
    data, offsets = K.text_bytes(pa.array(texts))
    for h in K.Words(data, offsets).both_hashes():
        assert h[0] != h[1]
