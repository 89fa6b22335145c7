import re
from collections import defaultdict

from careledger.llm.exact_dedup import exact_groups, exact_unique


def squeezed(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def brute(rows, sha):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[squeezed(text)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for doc_id, text in rows:
        own = groups[squeezed(text)]
        keep = min(own)[3]
        out.append((doc_id, keep, len(own), doc_id == keep, sha(squeezed(text))))
    return sorted(out, key=repr)


def test_groups_of_odd_rows(make_docs, odd_rows, sha):
    found = sorted(map(tuple, exact_groups(make_docs(odd_rows)).collect()), key=repr)
    assert found == brute(odd_rows, sha)


def test_the_longest_then_the_first_stays(make_docs):
    rows = [(4, "a b"), (3, "a  b"), (2, "ab"), (1, "a\tb ")]
    kept = {r.doc_id for r in exact_groups(make_docs(rows)).filter("kept").collect()}
    assert kept == {1}


def test_many_copies_in_many_tasks(spark, make_docs):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(600)]
    found = exact_groups(make_docs(rows).repartition(9)).filter("kept").collect()
    assert len(found) == 201 and max(r.group_size for r in found) == 400


def test_unique_keeps_columns_and_one_of_repeated_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    left = exact_unique(docs)
    assert left.columns == docs.columns
    # The null row of the empty group gives way to doc 2, which has the most characters.
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted([2, 5, 6, 9, 10, 11, 12, None], key=repr)


def test_empty_table(make_docs):
    assert exact_groups(make_docs([])).count() == 0
    assert exact_unique(make_docs([])).count() == 0
