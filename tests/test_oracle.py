"""Every query against DuckDB SQL over the same tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as catalog
from oracle import oracle_queries

SF_DIR = "/root/testdata/sf0.001"
ORACLE = oracle_queries(catalog.SWEEP)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, bag, name):
    result = catalog.queries()[name](spark, SF_DIR)
    expected = duck.execute(ORACLE[name])
    names = [column[0] for column in expected.description]
    assert sorted(names) == sorted(result.columns)
    order = [names.index(column) for column in sorted(names)]
    rows = sorted(tuple(repr(row[i]) for i in order) for row in expected.fetchall())
    assert bag(result) == rows


def test_entry_is_the_flagship_report(spark):
    report = catalog.entry(spark)
    assert report.columns[:3] == ["cany_ind", "care_cost_reason_group", "eta_care_reasons"]
    assert report.count() > 0
