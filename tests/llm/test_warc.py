import pytest
from pyspark.sql import functions as F

from careledger.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>Größe 👍🏽\r\n\r\nWARC/1.1</p>" * 4000
    rows = [
        (5, "http://a/1", "x" * 100),
        (2, "http://a/2", "x" * 100),
        (9, "http://a/3", "x" * 100),
        (4, "http://a/4", "y" * 99),
        (3, "http://a/5", "y" * 99),
        (7, None, None),
        (8, "http://a\r\nWARC-Type: evil", ""),
        (10, "http://b", big),
        (11, "http://c", big + "!"),
        (11, "http://c", big + "!"),
        (12, "http://d", big),
        (None, "http://e", "no id"),
    ]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, block string, n int")


def brute(rows, sha):
    texts = [(r.page_id, r.html or "") for r in rows]
    out = []
    for page_id, text in texts:
        size = len(text.encode())
        first = min(i for i, t in texts if t == text and i is not None) if page_id is not None else None
        revisit = size >= 100 and page_id is not None and page_id > first
        out.append((page_id, size, sha(text), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(pages, sha):
    found = sorted(map(tuple, warc.archived(pages).collect()), key=repr)
    assert found == brute(pages.collect(), sha)


def test_long_blocks_are_segmented(pages):
    values = [r.value for r in warc.records(pages.filter("page_id = 10")).collect()]
    assert len(values) > 5
    heads = [v.split("\r\n\r\n")[0] for v in values]
    assert sum("WARC-Type: continuation" in h for h in heads) == len(values) - 1
    assert all(f"WARC-Segment-Number: {i + 1}" in h for i, h in enumerate(heads))
    assert ["WARC-Segment-Total-Length" in h for h in heads] == [False] * (len(values) - 1) + [True]


@pytest.fixture
def parts(spark, pages):
    data = "".join(r.value + warc.BETWEEN for r in warc.records(pages.filter("page_id = 10")).collect())
    return spark.createDataFrame(list(warc._rows(data.encode())), warc._SCHEMA)


def test_segments_in_any_order(parts, pages):
    html = pages.filter("page_id = 10").first().html.encode()
    [row] = warc.reassembled(parts.orderBy(F.desc("number"))).collect()
    assert warc.payload(bytes(row.block)) == html


@pytest.mark.parametrize("lost", ["number = 3", "number = 1", "total is not null"])
def test_missing_segments_raise(parts, lost):
    with pytest.raises(Exception, match="are missing"):
        warc.reassembled(parts.filter(f"not ({lost})")).collect()


def test_framing():
    assert warc.dechunked(b"3\r\nabc\r\n1;x=y\r\nd\r\n0\r\n\r\n") == b"abcd"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n", b""):
        with pytest.raises(ValueError):
            warc.dechunked(bad)
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.parse_records(b"junk"))


def test_empty_table(pages):
    assert warc.archived(pages.limit(0)).count() == 0
