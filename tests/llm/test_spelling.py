import random
import zlib

import pytest

from careledger.llm import spelling as sp


def words_of(rows):
    counts = {}
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c.lower() <= "z" and c.isascii() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] = counts.get(run, 0) + 1
                run = ""
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words = words_of(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        f = form[w]
        out.append((w, f, root, n, len(near[w]), None if f is None else words[f]))
    return sorted(out)


def variants(seed=5):
    draw = random.Random(seed)
    letters = "abeinrstéßÿ÷"
    base = ["".join(draw.choices(letters, k=draw.randrange(4, 9))) for _ in range(60)]
    rows = []
    for i in range(250):
        own = []
        for _ in range(30):
            w = draw.choice(base[: draw.randrange(1, 61)])
            kind, k = draw.randrange(8), draw.randrange(len(w))
            if kind == 0:
                w = w[:k] + draw.choice(letters) + w[k:]
            elif kind == 1:
                w = w[:k] + w[k + 1 :]
            elif kind == 2:
                w = w[:k] + draw.choice(letters) + w[k + 1 :]
            own.append(w.upper() if draw.random() < 0.1 and w.isascii() else w)
        rows.append((i, draw.choice((" ", "-", "_1")).join(own)))
    return rows


@pytest.mark.parametrize(("cell", "sample"), [(sp.CELL, sp.SAMPLE), (32, 200), (8, 40)])
def test_like_all_pairs(make_docs, cell, sample):
    """With one cell a length, with many, and with cells that are cut by a hash."""
    chain = " ".join(["zuzuzu"] * 40 + ["zuzuzus"] * 16 + ["zuzuzusa"] * 6 + ["zuzuzusab"] * 3)
    rows = [*variants(), (900, chain)]
    found = sorted(map(tuple, sp.spelling_variants(make_docs(rows), cell, sample).collect()))
    expected = brute(rows)
    assert found == expected
    assert sum(r[1] is not None for r in expected) > 50 and any(r[1] != r[2] for r in expected if r[1])


def test_odd_rows(make_docs, odd_rows):
    rows = odd_rows + [(20, "naïve " * 3 + "naives " * 2 + "Naïve"), (21, "x" * 3000 + " "), (None, "naïves " * 9)] * 3
    assert sorted(map(tuple, sp.spelling_variants(make_docs(rows)).collect())) == brute(rows)


def test_empty_table(make_docs):
    assert sp.spelling_variants(make_docs([])).count() == 0
    assert sp.spelling_variants(make_docs([(1, None)])).count() == 0


def test_anagrams_in_one_cell_are_cut_by_a_hash(make_docs):
    """Words of equal letter counts, which no plane can part."""
    draw = random.Random(2)
    pool = {"".join(draw.sample("aabbbcc", 7)) for _ in range(400)}
    rows = [(i, " ".join(sorted(pool))) for i in range(6)]
    assert sorted(map(tuple, sp.spelling_variants(make_docs(rows), 8, 50).collect())) == brute(rows)
