"""The rule tables: every rule, their order, and what they do with NULL."""

import re

import pytest
from pyspark.sql import functions as F

from careledger.functions import fixed_values as fixed
from careledger.functions.columns import classify, lookup, matchable, max_label, sql_text
from careledger.operators.orders import normal_reason


def first_match(text, rules, otherwise):
    """The rules as ordered, unanchored regular expressions."""
    if text is not None:
        for pattern, result in rules:
            if re.search(pattern, text.lower()):
                return result
    return otherwise


PHRASES = sorted(
    {p for rules in (fixed.REASON_RULES, fixed.GROUP_RULES) for pattern, _ in rules for p in pattern.split("|")}
)
TEXTS = [
    *PHRASES,
    *[p.upper() for p in PHRASES],
    *[f"the {a} and {b}" for a in PHRASES[::3] for b in PHRASES[::4]],
    "Red Plate",
    "chocolate",
    "Refund for 3 items",
    "refund due to missing sauce",
    "",
    None,
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(t,) for t in TEXTS], "text string")


def test_reason_rules(texts):
    rows = normal_reason(texts, "text", "normal").collect()
    for row in rows:
        lowered = None if row.text is None else row.text.lower()
        assert row.normal == first_match(row.text, fixed.REASON_RULES, lowered), row.text


def test_group_rules(texts):
    group = classify("m", fixed.GROUP_RULES, sql_text(fixed.NOT_GROUPED))
    for row in texts.withColumn("m", matchable(F.col("text"))).withColumn("g", group).collect():
        assert row.g == first_match(row.text, fixed.GROUP_RULES, fixed.NOT_GROUPED), row.text


def test_late_matches_inside_words(texts):
    found = {r.text: r.normal for r in normal_reason(texts, "text", "normal").collect()}
    assert found["Red Plate"] == found["chocolate"] == "late order"


def test_refund_rules_would_change_nothing():
    """Two documented rules on refund texts give what the fallback gives anyway."""
    for reason in TEXTS:
        for contact in TEXTS[:: len(TEXTS) // 25]:
            fallback = next((t.lower() for t in (contact, reason) if t is not None), None)
            plain = first_match(reason, fixed.REASON_RULES, None) or first_match(
                contact, fixed.REASON_RULES, None
            )
            refunds = (("refund due to|refund for", fallback),)
            with_refunds = plain or first_match(reason, refunds, None) or first_match(contact, refunds, None)
            assert (with_refunds or fallback) == (plain or fallback)


def test_max_label_is_the_alphabetical_maximum(spark):
    codes = [*fixed.SELF_SERVICE_REASONS, "UNKNOWN", None]
    rows = [(f"{a}-{b}", c) for a in codes for b in codes for c in (a, b)]
    found = (
        spark.createDataFrame(rows, "k string, code string")
        .groupBy("k")
        .agg(
            max_label(F.col("code"), fixed.SELF_SERVICE_REASONS).alias("by_rank"),
            F.max(lookup(F.col("code"), fixed.SELF_SERVICE_REASONS)).alias("by_text"),
        )
    )
    assert found.filter(~F.col("by_rank").eqNullSafe(F.col("by_text"))).count() == 0
    assert found.filter("by_rank is null").count() == 4
