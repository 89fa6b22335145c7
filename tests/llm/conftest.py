import hashlib

import pytest

#: Columns whose names operators use inside.
CLASHING = ("digest", "rep", "component", "score", "chars", "copies", "salt", "part", "node", "bucket", "n", "hits")

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text) rows, with extra columns of clashing names."""

    def make(rows):
        full = [(i, t, "en", "src0", None if t is None else len(t), *CLASHING) for i, t in rows]
        extra = ", ".join(f"{c} string" for c in CLASHING)
        return spark.createDataFrame(
            full, f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
        )

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen"
    return [
        (3, None),
        (1, ""),
        (2, " \t\n"),
        (5, "Ünï 日本 👍🏽 ▁ </s>"),
        (7, base),
        (6, base),
        (6, base),
        (9, base.upper().replace(" ", "\n\n")),
        (12, LONG),
        (10, LONG + " tail"),
        (11, "short"),
        (None, "no id " + base),
        (None, None),
    ]


@pytest.fixture(scope="session")
def sha():
    return lambda text: hashlib.sha256(text.encode()).hexdigest()
