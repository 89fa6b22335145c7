import re

import pytest
from pyspark.sql import functions as F

from careledger.llm import fingerprints as fp


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rows):
    """(doc_id, text, edited, next) in order of id, then text; the last is followed by the first."""
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (doc_id, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        out.append((doc_id, text, text[: len(text) - half] + after[:half], after))
    return out


def test_edits_and_likeness(make_docs, odd_rows, sha):
    rows = [r for r in odd_rows if r[0] is not None]
    found = {(r.doc_id, r.edited_sha256): r for r in fp.fingerprints(make_docs(rows)).collect()}
    for doc_id, text, new, after in edited(rows):
        row = found[doc_id, sha(new)]
        assert row.n_chars == len(text)
        few = max(len(shingles(x)) for x in (text, new, after)) < fp.SKETCH_SIZE / 2
        close = 1e-12 if few else 0.15
        assert row.near_edited == pytest.approx(likeness(text, new), abs=close)
        assert row.near_next == pytest.approx(likeness(text, after), abs=close)
        assert row.shingles == pytest.approx(len(shingles(text)), rel=0.3)
    by_text = {}
    for doc_id, text, new, _ in edited(rows):
        row = found[doc_id, sha(new)]
        assert by_text.setdefault(text, row.fingerprint) == row.fingerprint
    assert fp.fingerprints(make_docs(odd_rows)).count() == len(odd_rows)


@pytest.mark.parametrize("step", [1, 64, 1 << 20, 1 << 45, 1 << 57])
def test_next_document_over_gaps(make_docs, step):
    ids = [k * step - 20 * step for k in range(60)]
    docs = make_docs([(i, f"text {i}") for i in ids])
    found = {r.doc_id: r.next_text for r in fp.with_next(docs).collect()}
    assert found == {i: f"text {j}" for i, j in zip(ids, ids[1:] + ids[:1], strict=True)}


def test_a_single_document_follows_itself(make_docs):
    row = fp.fingerprints(make_docs([(5, "a b c d e f")])).first()
    assert row.near_next == 1.0 and row.near_edited < 1.0
    assert fp.fingerprints(make_docs([])).count() == 0


def test_merging_and_estimates(spark):
    words = [f"t{i}" for i in range(4000)]
    parts = [("a", " ".join(words[:2500])), ("a", " ".join(words[2400:])), ("b", " ".join(words[:1000]))]
    df = spark.createDataFrame(parts, "k string, text string").withColumn("h", fp.word_hashes(F.col("text")))
    sketched = df.withColumn("s", fp.sketch(F.col("h")))
    merged = {r.k: r.s for r in fp.merge_sketches(sketched, ["k"], "s").collect()}
    both = sketched.filter("k = 'a'").select("s").collect()
    assert merged["a"] == sorted(set(both[0].s) | set(both[1].s))[: fp.SKETCH_SIZE]
    pair = spark.createDataFrame([(merged["a"], merged["b"])], "a array<long>, b array<long>")
    row = pair.select(
        fp.distinct_shingles(F.col("a")).alias("n"),
        fp.containment(F.col("b"), F.col("a")).alias("inside"),
        fp.resemblance(F.col("a"), F.col("b")).alias("alike"),
        (fp.from_text(fp.as_text(F.col("a"))) == F.col("a")).alias("same"),
        F.size(fp.from_text(F.lit(""))).alias("none"),
    ).first()
    assert row.n == pytest.approx(3996, rel=0.3) and row.inside > 0.6
    assert row.alike == pytest.approx(0.25, abs=0.12) and row.same and row.none == 0
