import random

import numpy as np
import pytest

from careledger.llm import signature_trees as st
from careledger.llm.minhash import shingles as hashed

from .test_minhash import near_copies, shingles


def brute(rows, percent=80):
    """(doc_id, n, component) by comparing all sets; equal sets are one class."""
    sets = sorted({frozenset(shingles(t)) for i, t in rows if i is not None} - {frozenset()}, key=len)
    root = {s: s for s in sets}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for x, a in enumerate(sets):
        for b in sets[:x]:
            if 100 * len(a & b) >= percent * len(a | b):
                root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        s = frozenset(shingles(t))
        if i is not None and s:
            r = find(s)
            least[r] = min(least.get(r, i), i)
    out = []
    for i, t in rows:
        s = frozenset(shingles(t))
        out.append((i, len(s), i if i is None or not s else least[find(s)]))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_like_all_pairs(make_docs, monkeypatch):
    rows = near_copies()
    found = result(st.jaccard_groups(make_docs(rows)))
    assert found == brute(rows)
    assert len({r[2] for r in found}) < len(rows) - 80


def test_groups_in_parts(make_docs, monkeypatch):
    """Groups cut into parts of two and of seven, which send one set on and meet two by two."""
    rows = near_copies()
    want = brute(rows)
    for most in (2, 7):
        monkeypatch.setattr(st, "GROUP", most)
        assert result(st.jaccard_groups(make_docs(rows))) == want


def test_odd_rows(make_docs, odd_rows):
    assert result(st.jaccard_groups(make_docs(odd_rows))) == brute(odd_rows)


def test_short_texts_and_bounds(make_docs):
    rows = [(n, " ".join(["ha"] * n)) for n in (4, 5, 6, 9)] + [(20, "a b c d e"), (21, "A b c d e f"), (22, "a b c d")]
    for k, (common, own) in enumerate([(40, 5), (82, 9), (79, 10), (4, 1), (3, 1)] * 2):
        head = " ".join(f"h{k}x{i}" for i in range(common + 4))
        for side in "ab":
            rows.append((100 + 10 * k + (side == "b"), head + " " + " ".join(f"{side}{k}x{i}" for i in range(own))))
    found = result(st.jaccard_groups(make_docs(rows)))
    assert found == brute(rows)
    linked = {r[0] for r in found if r[2] != r[0] and r[0] >= 100}
    assert linked == {101, 111, 151, 161}


def test_an_id_with_different_texts(make_docs):
    a = " ".join(f"a{i}" for i in range(40))
    b = " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (6, a + " x"), (6, b), (7, b + " y"), (6, b), (8, "c " * 9)]
    found = result(st.jaccard_groups(make_docs(rows)))
    assert found == brute(rows)
    assert (7, 37, 6) in found and (6, 37, 5) in found


def test_empty_table(make_docs):
    assert st.jaccard_groups(make_docs([])).count() == 0
    assert result(st.jaccard_groups(make_docs([(1, None), (None, "a b")]))) == [(1, 0, 1), (None, 1, None)]


@pytest.mark.parametrize("seed", range(4))
def test_the_walk_leaves_every_link(seed):
    """Against all pairs, for sets of very different sizes; most pairs are pruned."""
    draw = random.Random(seed)
    sets = []
    for _ in range(80):
        base = [draw.getrandbits(64) for _ in range(int(5 * 1.07 ** draw.randrange(90)))]
        for _ in range(draw.randrange(1, 5)):
            own = [x if draw.random() > 0.05 else draw.getrandbits(64) for x in base]
            sets.append(np.unique(np.array(own, np.uint64)))
    sizes = np.array([len(s) for s in sets])
    labels = np.arange(len(sets))
    left = set()
    for i, j in st.candidates([st.signature(s) for s in sets], sizes, labels, 80):
        pairs = [tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)]
        assert not left & set(pairs) and len(set(pairs)) == len(pairs)
        left |= set(pairs)
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if st._linked(sets[i], sets[j], 80)}
    assert links <= left and len(links) > 30
    assert len(left) < 1.2 * len(links) + 200
    one = np.zeros(len(sets), np.int64)
    assert not list(st.candidates([st.signature(s) for s in sets], sizes, one, 80))


def test_hashes_of_shingles():
    assert len(hashed(b"a b c d e f")) == 2
