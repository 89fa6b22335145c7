import gc
import random
import re
import weakref
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from careledger.llm import collocations as co


def brute(rows, top=2000, least=30):
    """By counting every phrase of every piece."""
    counts, totals = {}, {}
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] = totals.get(lang, 0) + len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i : i + k]))
                    counts[key] = counts.get(key, 0) + 1
    frequent = {key: n for key, n in counts.items() if n >= least}
    out = []
    for (lang, phrase), a in frequent.items():
        if len(phrase) < 2:
            continue
        cuts = []
        for k in range(1, len(phrase)):
            left, right = frequent[lang, phrase[:k]], frequent[lang, phrase[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        around = [
            n
            for (other, long), n in frequent.items()
            if other == lang
            and len(long) > len(phrase)
            and any(long[i : i + len(phrase)] == phrase for i in range(len(long) - len(phrase) + 1))
        ]
        if not any(100 * n >= 80 * a for n in around):
            out.append((lang, " ".join(phrase), a, left, right, totals[lang], score))
    found = []
    for lang in totals:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        found += [(lang, i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return sorted(found)


def prose(seed=1, n=300):
    draw = random.Random(seed)
    words = ["The", "new", "york", "city", "of", "a", "ünd", "x\x1cy", "ha", "ha", *[f"w{i}" for i in range(14)]]
    rows = []
    for i in range(n):
        own = []
        for _ in range(draw.randrange(5, 60)):
            own.append(draw.choice(words))
            if draw.random() < 0.15:
                own += ["new", "york", "city", "hall"][: draw.randrange(2, 5)]
            if draw.random() < 0.1:
                own.append(draw.choice([",", "a.b", "\n", "!?", "\t"]))
        rows.append((draw.choice(["en", "en", "de", None]), " ".join(own)))
    return rows


def make(spark, rows):
    full = [(i, t, lang, *"abcde") for i, (lang, t) in enumerate(rows)]
    extra = ", ".join(f"{c} string" for c in ("phrase", "n", "words", "score", "shard"))
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, {extra}")


def result(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(
    ("shards", "how"),
    [(3, {}), (1, {}), (5, {"bits": 64}), (4, {"limits": (500, 100, 7)})],
)
def test_like_counting_everything(spark, shards, how):
    """However many shards, with a table of bits that is nearly full, and with small batches."""
    rows = prose()
    found = result(co.collocations(make(spark, rows), shards=shards, **how))
    assert found == brute(rows) and len(found) > 20


def test_the_top_of_each_language(spark):
    rows = prose(2)
    assert result(co.collocations(make(spark, rows), top=5)) == brute(rows, top=5)


def test_overlaps_and_long_texts(spark):
    rows = [("en", "ha " * 50_000), ("en", "a b. " * 29 + "c d e f, " * 30), (None, None), ("und", "a b\n" * 30), ("en", "")]
    assert result(co.collocations(make(spark, rows * 2))) == brute(rows * 2)


def test_empty_table(spark):
    assert co.collocations(make(spark, [])).count() == 0
    assert co.collocations(make(spark, [("en", None)])).count() == 0


def test_tables_of_bits_are_given_up(spark, monkeypatch):
    """Each is broadcast once, and none stay."""
    passed, context = [], type(spark.sparkContext)
    send = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: passed.append(send(self, value)) or passed[-1])
    rows = prose(3)
    assert result(co.collocations(make(spark, rows))) == brute(rows)
    assert passed and len(passed) <= co.MOST_WORDS * co.SHARDS
    assert all(not x._jbroadcast.isValid() for x in passed)


def test_most_and_least_bits_of_the_table(spark):
    rows = [("en", "a b c d " * 40_000)]
    docs = make(spark, rows).selectExpr("lang", "cast(text as binary) as text")
    sizes = [co.reached(docs, 3, 30, bits).value.nbytes * 8 for bits in (co.BITS, 1 << 17, 64)]
    assert sizes == [1 << 18, 1 << 17, 64]


def test_the_driver_keeps_no_tables(spark, monkeypatch):
    """The table of a step goes once it is broadcast and the next one is made."""
    made, most, bits_of = [], [], co._bits_of

    def watched(keys, bits):
        gc.collect()
        most.append(sum(x() is not None for x in made))
        table = bits_of(keys, bits)
        made.append(weakref.ref(table))
        return table

    monkeypatch.setattr(co, "_bits_of", watched)
    rows = prose(4)
    assert result(co.collocations(make(spark, rows))) == brute(rows)
    assert len(most) > co.SHARDS and max(most) <= 1


def test_rows_of_the_last_scan():
    """A task passes a row for each group that it has phrases of, however many these are and however often it has met them."""
    every = SimpleNamespace(value=np.full(1 << 10, 255, np.uint8))
    draw = random.Random(6)
    texts = [(draw.choice(["en", "de"]), " ".join(draw.choices([f"w{i}" for i in range(30)], k=40)) + ".") for _ in range(200)]
    batch = pa.table({"lang": [x for x, _ in texts], "text": [t.encode() for _, t in texts]}).to_batches()[0]
    dealt = [b for b in co._spell(iter([batch, batch]), table=every, limits=(3000, 1000, 25), groups=4)]
    assert sum(b.num_rows for b in dealt) <= 4 * 2
    found = {}
    rows = pa.Table.from_batches(dealt)
    for lang in ("en", "de"):
        for group in range(4):
            own = rows.filter(pc.and_(pc.equal(rows["lang"], lang), pc.equal(rows["group"], group)))
            for b in co._added(iter(own.combine_chunks().to_batches()), 30):
                found |= {(r["lang"], r["phrase"], r["words"]): r["n"] for r in b.to_pylist()}
    want = Counter()
    for lang, text in texts * 2:
        words = text[:-1].split()
        want[lang, "", 0] += len(words)
        for k in range(1, 5):
            want.update((lang, " ".join(words[i : i + k]), k) for i in range(len(words) - k + 1))
    assert found == {key: n for key, n in want.items() if n >= 30}
