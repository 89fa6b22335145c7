from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from careledger.llm.catalog import corpus_queries, corpus_sql, tokenizer_file
from careledger.llm.packing import pack

FOLDER = "/root/testdata/sf0.001"


def test_registered_once_each():
    names = set(corpus_queries())
    assert names <= set(entry.queries()) and set(corpus_sql()) <= names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(corpus_sql()))
def test_like_the_sql(spark, name):
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = connection.execute(corpus_sql()[name])
    columns = [c[0] for c in want.description]
    found = corpus_queries()[name](spark, FOLDER)
    assert sorted(found.columns) == sorted(columns)
    rows = sorted(repr(tuple(r)) for r in found.select(*columns).collect())
    assert rows == sorted(repr(r) for r in want.fetchall())


def test_stages_one_by_one(spark):
    """Each stage on all that the one before kept; the last packs it."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = len(ids), stage(spark, docs, folder)
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and kept < ids and len(kept) > 0.85 * before, name
        ids = kept
    found = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in found.select("doc_id").distinct().collect()} == ids
    assert found.columns == pack(docs.limit(0), tokenizer_file("word_bpe_49k.json")).columns
