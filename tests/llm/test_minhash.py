import random

import numpy as np

import corpus_pipeline
from careledger.llm import minhash as mh


def words(text):
    kept = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        kept = kept.replace(space, " ")
    return [w for w in kept.split(" ") if w]


def shingles(text):
    own = words(text)
    if len(own) < 5:
        return {tuple(own)} if own else set()
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)}


def brute(rows):
    """component by (doc_id, text) of rows with a doc_id."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for y, (j, b) in enumerate(sets[:x]):
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 85 * len(a | b):
                p, q = find(x), find(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    out = []
    for x, (i, a) in enumerate(sets):
        component = least[find(x)] if i is not None else None
        out.append((i, len(a), component, i is None or component == i))
    return sorted(out, key=repr)


def near_copies():
    """Families around the bound, a group of many near copies, and one passage in many texts."""
    draw = random.Random(3)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = draw.choices(vocabulary, k=60)
    rows, doc_id = [], 1000
    for _ in range(12):
        base = draw.choices(vocabulary, k=120)
        for _ in range(6):
            own = list(base)
            for _ in range(draw.randrange(6)):
                own[draw.randrange(len(own))] = draw.choice(vocabulary)
            rows.append((doc_id, " ".join(own)))
            doc_id += 1
    base = draw.choices(vocabulary, k=200)
    for k in range(60):
        rows.append((doc_id, " ".join([*base[:-2], f"end{k}", base[-1]])))
        doc_id += 1
    for k in range(60):
        rows.append((doc_id, " ".join([*draw.choices(vocabulary, k=draw.randrange(1, 40)), *passage, f"x{k}"])))
        doc_id += 1
    draw.shuffle(rows)
    return rows


def test_like_all_pairs(make_docs):
    rows = near_copies()
    found = sorted(map(tuple, mh.near_groups(make_docs(rows)).collect()), key=repr)
    assert found == brute(rows)
    assert len({r[2] for r in found}) < len(rows) - 80


def test_odd_rows(make_docs, odd_rows):
    found = sorted(map(tuple, mh.near_groups(make_docs(odd_rows)).collect()), key=repr)
    assert found == brute(odd_rows)


def test_five_words_and_more_of_the_same(make_docs):
    rows = [(n, " ".join(["ha"] * n)) for n in (4, 5, 6, 9)] + [(20, "a b c d e"), (21, "a b c d e f")]
    found = sorted(map(tuple, mh.near_groups(make_docs(rows)).collect()), key=repr)
    assert found == brute(rows) and {r[0]: r[2] for r in found}[9] == 5


def test_the_pipeline_links_from_four_fifths_on(spark, make_docs):
    """Pairs of 0.8 exactly, of 0.82, and of a little less than 0.8."""
    rows = []
    for k, (common, own) in enumerate([(40, 5), (82, 9), (79, 10)] * 4):
        head = " ".join(f"h{k}x{i}" for i in range(common + 4))
        for side in "ab":
            tail = " ".join(f"{side}{k}x{i}" for i in range(own))
            rows.append((10 * k + (side == "b"), f"{head} {tail}"))
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, make_docs(rows), "").collect()}
    assert left == {i for i, _ in rows if i % 10 == 0 or i // 10 % 3 == 2}
    assert mh.near_unique(make_docs(rows)).count() == len(rows)


def test_an_id_with_different_texts(make_docs):
    """Rows follow their own text: what is like nothing stays, also under the id of a near copy."""
    a = " ".join(f"a{i}" for i in range(40))
    b = " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (6, a + " x"), (6, b), (7, b + " y"), (6, b), (6, "c " * 9), (8, a.upper())]
    docs = make_docs(rows)
    # No row of b's component has a doc_id below 6; the row of 6 that is like 5 goes.
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in mh.near_groups(docs).collect())
    assert found == [
        (5, 36, 5, True), (6, 1, 6, True), (6, 36, 6, True), (6, 36, 6, True), (6, 37, 5, False), (7, 37, 6, False), (8, 36, 5, False)
    ]
    for left in (mh.near_unique(docs), corpus_pipeline.near_dedup(None, docs, "")):
        assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted([(5, a), (6, b), (6, b), (6, "c " * 9)])


def test_unique_keeps_columns(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    left = mh.near_unique(docs)
    assert left.columns == docs.columns
    # 9 and 7 are copies of 6 but for case and spaces; 12 is a near copy of 10.
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted(
        [1, 2, 3, 5, 6, 6, 10, 11, None, None], key=repr
    )


def test_empty_table(make_docs):
    assert mh.near_groups(make_docs([])).count() == 0


def test_signatures_estimate_resemblance():
    draw = np.random.default_rng(1)
    pool = draw.integers(0, 2**63, 3000).astype(np.uint64)
    for share in (0.3, 0.85):
        common = int(1000 * share)
        a = np.r_[pool[:common], pool[1000 : 2000 - common]]
        b = np.r_[pool[:common], pool[2000 : 3000 - common]]
        true = common / (2000 - common)
        assert abs((mh.signature(a) == mh.signature(b)).mean() - true) < 0.1


def test_the_permutations_are_permutations():
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    for multipliers in (mh._FIRST, mh._SECOND):
        assert len(np.unique(mh._permuted(x.copy(), multipliers))) == len(x)
