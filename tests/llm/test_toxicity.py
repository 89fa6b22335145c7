import random
import tracemalloc
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from careledger.llm import toxicity as tx

CLEAN = [f"word{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(2)
    docs, labels = [], []
    for i in range(400):
        words = draw.choices(CLEAN, k=60)
        toxic = i % 5 == 0
        if toxic:
            for place, bad in zip((3, 30, 50), draw.sample(["moron", "snarfa", "snarfbo", "snarfcu"], 3), strict=True):
                words[place] = bad
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def labels(spark, corpus):
    rows = [*corpus[1], *corpus[1][:5], (None, 1, 1), (3, 1, None), (9999, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def scores(make_docs, labels, rows):
    return tx.toxicity_scores(make_docs(rows), labels).collect()


def test_held_out_rows_are_told_apart(make_docs, corpus, labels):
    found = {r.doc_id: r for r in scores(make_docs, labels, corpus[0])}
    for i, _, toxic in corpus[1]:
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert found[i].predicted == toxic and 0 <= found[i].score <= 1


def test_held_out_labels_are_not_learned(make_docs, corpus, labels):
    rows = tx.training_rows(make_docs(corpus[0]), labels).collect()
    texts = {t: i for i, t in corpus[0]}
    assert rows and all(zlib.crc32(str(texts[r.text]).encode()) % 4 != 2 for r in rows)
    assert tx.training_rows(make_docs(corpus[0]), labels, most=20).count() == 20


def test_disguises_and_exceptions(make_docs, corpus, labels):
    tests = [
        (1001, "what a m0r0n"), (1002, "what a mоrоn"), (1003, "ｍｏｒｏｎ!"), (1004, "what a mórón,"),
        (1005, "you snarfzzz and snarfqq"), (1006, "moronic oxymoron is fine"), (1007, " ".join(CLEAN * 40) + " moron"),
        (1008, "M0R0N"), (1009, "mo​ron"), (1010, None), (1011, ""),
    ]
    found = {r.doc_id: r for r in scores(make_docs, labels, corpus[0] + tests)}
    assert [k for k in range(1001, 1012) if found[k].predicted] == [1001, 1002, 1003, 1004, 1005, 1008, 1009]
    assert found[1010].score == found[1011].score == 0 and found[1007].hits == 1
    docs = make_docs(corpus[0] + tests)
    scored = tx.scored(docs, labels, exceptions=("what a moron",))
    assert {r.doc_id: r.h for r in scored.select("doc_id", F.col("_toxicity.hits").alias("h")).collect()}[1001] == 0


def test_the_stage_keeps_clean_rows_and_columns(make_docs, corpus, labels, odd_rows):
    docs = make_docs(corpus[0] + odd_rows)
    left = tx.without_toxic(docs, labels)
    assert left.columns == docs.columns
    clean = sum(not x[2] for x in corpus[1])
    assert left.count() == clean + len(odd_rows)


def test_copies_neither_hide_nor_make_a_word(spark):
    """A toxic template, a clean one with a toxic word, and exception phrases in clean rows."""
    draw = random.Random(4)
    rows = [(" ".join(draw.choices(CLEAN, k=40)), 0) for _ in range(300)]
    rows += [(" ".join([*draw.choices(CLEAN, k=40), word]), 1) for word in ("moron", "trash") for _ in range(40)]
    rows += [("grimbol " + " ".join(CLEAN[:30]), 1)] * 400
    rows += [("not a moron " + " ".join(CLEAN[30:60]), 0)] * 400
    rows += [(" ".join([*draw.choices(CLEAN, k=40), "trash can"]), 0) for _ in range(200)]
    weights = tx.learn(spark.createDataFrame(rows, "text string, toxic int"))
    caught = {w: any(tx.folded(w)[1:].startswith(p) for p in weights) for w in ("moron", "trash", "grimbol")}
    assert all(caught.values()), caught
    assert not any(tx.folded(w)[1:].startswith(p) for w in CLEAN for p in weights)


def test_without_labels_or_rows(make_docs, odd_rows, labels):
    assert {r.score for r in scores(make_docs, labels.limit(0), odd_rows)} == {0.0}
    assert scores(make_docs, labels, []) == []


def test_labels_of_the_test_tables(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = tx.toxicity_scores(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    rows = found.filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right / len(rows) > 0.97


def test_a_task_holds_the_features_of_few_texts(corpus):
    """However many texts Spark hands over at once, and all features of all texts come."""
    texts = [text for _, text in corpus[0]] * 10
    batch = pa.record_batch({"text": pa.array(texts)})
    known = {"word", "worda", "wordak ", "moron ", ""}
    for some in (None, known):
        tracemalloc.start()
        rows = Counter()
        for out in tx._by_text(iter([batch]), None, some):
            rows.update(zip(out["feature"].to_pylist(), out["family"].to_pylist(), strict=True))
            assert len(set(out["family"].to_pylist())) <= 200
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        want = Counter()
        for text in texts:
            words = tx.folded(text).split()
            found = tx._features(set(words)) | {""}
            family = tx._family(words)
            want.update((f, family) for f in (found if some is None else found & some))
        assert rows == want and peak < 60e6
