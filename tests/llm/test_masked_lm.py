from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from careledger.llm import masked_lm as lm
from careledger.llm.catalog import op8_masked_lm
from careledger.llm.shared import shared_folder


@pytest.fixture(scope="module")
def weights():
    draw = np.random.default_rng(0)
    return {k: v.astype(float) + 0.1 * draw.normal(size=v.shape) for k, v in lm.first_weights().items()}


def test_probabilities_sum_to_one(weights):
    around = np.repeat([[5, 1024, 900, 3]], lm.TOKENS, axis=0)
    assert np.exp(lm.log_likelihood(weights, around, np.arange(lm.TOKENS))).sum() == pytest.approx(1)


@pytest.mark.parametrize("name", list(lm.SHAPES))
def test_gradients(weights, name):
    draw = np.random.default_rng(1)
    around, target = draw.integers(0, lm.TOKENS + 1, (40, 4)), draw.integers(0, lm.TOKENS, 40)
    found = lm.gradients(weights, around, target)[name]
    place = np.unravel_index(np.abs(found).argmax(), found.shape)
    losses = []
    for step in (1e-5, -1e-5):
        moved = weights | {name: weights[name].copy()}
        moved[name][place] += step
        losses.append(-lm.log_likelihood(moved, around, target).mean())
    assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(found[place], rel=1e-4)


def test_scores_like_token_by_token(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    found = lm.pseudo_likelihood(docs).collect()
    texts = docs.select("text").na.fill("")
    words = lm.frequent_words(texts)
    trained = lm.train(texts, words)
    want = []
    for doc_id, text in odd_rows:
        ids = [lm.EDGE] * 2 + [words.index(w) if w in words else lm.FREQUENT + lm.zlib.crc32(w) % lm.SHARED for w in (text or "").encode().lower().split()] + [lm.EDGE] * 2
        places = range(2, len(ids) - 2)
        around = np.array([[ids[p + d] for d in lm.WINDOW] for p in places], int).reshape(-1, 4)
        logs = lm.log_likelihood(trained, around, np.array([ids[p] for p in places], int)) if len(around) else []
        want.append((repr(doc_id), len(logs), round(float(np.sum(logs)), 1)))
    for (i, n, total), r in zip(sorted(want), sorted(found, key=lambda r: (repr(r.doc_id), r.tokens, r.log_prob)), strict=True):
        assert (i, n) == (repr(r.doc_id), r.tokens) and r.log_prob == pytest.approx(total, rel=1e-3, abs=0.2)
        assert (r.score is None) == (n == 0)


def test_training_tells_order_from_chance(make_docs):
    draw = np.random.default_rng(3)
    cycle = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join((cycle * 8)[i % 30 : i % 30 + 150])) for i in range(150)]
    mixed = [(1000 + i, " ".join(draw.choice(cycle, 150))) for i in range(20)]
    found = {r.doc_id: r.score for r in lm.pseudo_likelihood(make_docs(rows + mixed)).collect()}
    assert np.mean([found[i] for i, _ in rows]) > np.mean([found[i] for i, _ in mixed]) + 0.5


def test_each_word_has_its_own_probability(make_docs, odd_rows):
    """Words of one shared token differ by their counts, whether tasks know them or not."""
    frequent = " ".join(f"f{i}" for i in range(lm.FREQUENT))
    same = [w for w in (f"x{i}" for i in range(2000)) if lm.zlib.crc32(w.encode()) % lm.SHARED == 7][:3]
    usual, junk, other = same
    rows = [(i, frequent) for i in range(20)] + [(100 + i, f"f1 {usual} f2") for i in range(9)]
    rows += [(200, f"f1 {junk} f2"), (201, f"{other} {other} {junk} f3"), (202, None), (203, "")]
    for rows in (rows, odd_rows):
        split = [(i, (t or "").encode().lower().split()) for i, t in rows]
        counts = Counter(w for _, own in split for w in own)
        top = set(sorted(counts, key=lambda w: (-counts[w], w))[: lm.FREQUENT])
        token = lambda w: lm.zlib.crc32(w) % lm.SHARED
        totals = Counter()
        for w in counts.keys() - top:
            totals[token(w)] += counts[w]
        want = sorted((repr(i), len(own), sum(np.log(counts[w] / totals[token(w)]) for w in own if w not in top)) for i, own in split)
        for common_share in (0, 3 / counts.total(), 1):
            found = lm.pseudo_likelihood(make_docs(rows), common_share).collect()
            got = sorted((repr(r.doc_id), r.tokens, r.word_log_prob - r.log_prob) for r in found)
            assert [g[:2] for g in got] == [w[:2] for w in want]
            assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-6)
            assert all(r.score == pytest.approx(r.word_log_prob / r.tokens) for r in found if r.tokens)


def test_empty_table(make_docs):
    assert lm.pseudo_likelihood(make_docs([])).count() == 0


@pytest.mark.parametrize("windows", [1, 3])
def test_counted_windows(make_docs, odd_rows, windows):
    """Just the rows with a window that stands elsewhere too have a gain, all words with joined shares."""
    rows = odd_rows + [(20, "a b c d e"), (21, "a b c d e"), (21, "a b x d e"), (22, "z b c d e"), (23, "a")]
    lines = [(i, (t or "").encode().lower().split()) for i, t in rows]
    total, own = Counter(), []
    for k, (_, line) in enumerate(lines):
        codes = np.array([lm._code(w, 0) for w in line], np.int64)
        pad = [b""] * 2 + line + [b""] * 2
        for at, h in enumerate(lm._windows(codes)):
            if h % np.uint64(windows) == 0:
                window = (*pad[at : at + 2], *pad[at + 3 : at + 5])
                total[window] += 1
                own.append((k, window))
    found = lm.pseudo_likelihood(make_docs(rows), 1, windows).collect()
    met = {k for k, window in own if total[window] > 1}
    want = sorted((repr(i), len(line), k in met) for k, (i, line) in enumerate(lines))
    assert sorted((repr(r.doc_id), r.tokens, r.window_gain != 0) for r in found) == want
    assert all(r.score == pytest.approx((r.word_log_prob + r.window_gain) / r.tokens) for r in found if r.tokens)


def test_window_gains(spark):
    """Against the definition, for windows alone, met around the same word and around others."""
    draw = np.random.default_rng(11)
    shares = {b"rare": -2.5, b"odd": -1.25}
    hits = [
        (row, int(draw.integers(0, 12)), int(draw.integers(0, 3)), -float(draw.integers(1, 80)) / 4)
        for row in range(15)
        for _ in range(row % 5)
    ]
    words = {0: None, 1: b"rare", 2: b"odd"}
    rows = [(r, [(w, m, p, words[m] and bytearray(words[m])) for k, w, m, p in hits if k == r]) for r in range(15)]
    scored = spark.createDataFrame(rows, f"row long, {lm._HITS}")
    table = spark.createDataFrame([(bytearray(w), x) for w, x in shares.items()], "word binary, log_share double")
    total, same = Counter(w for _, w, _, _ in hits), Counter((w, m) for _, w, m, _ in hits)
    want = Counter()
    for row, w, m, p in hits:
        if total[w] > 1:
            prior = np.exp(p + shares.get(words[m], 0))
            want[row] += np.log((same[w, m] - 1 + lm.PRIOR * prior) / (total[w] - 1 + lm.PRIOR)) - np.log(prior)
    found = {r.row: r.gain for r in lm.window_gains(scored, table).collect()}
    assert found == pytest.approx(dict(want), abs=1e-4)


def test_twice_told_apart(make_docs):
    draw = np.random.default_rng(5)
    text = lambda: " ".join(draw.choice([f"w{i}" for i in range(400)], 120))
    twice, once = [text() for _ in range(20)], [text() for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(twice + twice + once)]
    found = {r.doc_id: r.score for r in lm.pseudo_likelihood(make_docs(rows), windows=8).collect()}
    limit = np.quantile([found[i] for i in range(40, 240)], 0.9)
    assert np.mean([found[i] > limit for i in range(40)]) > 0.9


def test_the_query_counts_every_window(make_docs, spark, tmp_path):
    """A text that occurs twice has a gain, however short it is and whatever its windows hash to."""
    rows = [(i, " ".join(f"t{i % 40}x{k}" for k in range(5))) for i in range(80)] + [(80, "once only told here")]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.window_gain for r in op8_masked_lm(spark, str(tmp_path)).collect()}
    assert sorted(i for i, gain in found.items() if gain != 0) == list(range(80))


def test_windows_are_not_written(make_docs, spark):
    """What the shared folder holds of a word is its number; a window and its word take few bytes in a shuffle."""
    draw = np.random.default_rng(9)
    words = np.array([f"w{i}" for i in range(4000)])
    rows = [(i, " ".join(words[draw.zipf(1.3, 400) % 4000])) for i in range(500)]
    docs = make_docs(rows)
    folder = Path(shared_folder(spark).removeprefix("file:"))
    there = set(folder.iterdir())
    assert lm.pseudo_likelihood(docs, windows=1).count() == 500
    assert sum(p.stat().st_size for new in set(folder.iterdir()) - there for p in new.rglob("*.parquet")) < 4 * 500 * 400
    hashes, middles = draw.integers(0, 1 << 63, 1 << 18, np.uint64) << np.uint64(1), draw.zipf(1.3, 1 << 18) % 4000
    blobs = [x for b in lm._dealt(1, hashes, middles.astype(np.uint32), 8) for x in b.column("hits")]
    assert sum(len(x.as_py()) for x in blobs) < 7 * len(hashes)


def test_windows_in_parts(monkeypatch):
    """Slices that are dealt in several parts: the counts of a window come back to each of its places."""
    monkeypatch.setattr(lm, "_SLICE", 100)
    draw = np.random.default_rng(4)
    some = draw.integers(0, 1 << 63, 60, np.uint64) * np.uint64(2) + np.uint64(1)
    slices = {k: (some[draw.integers(0, 60, n)], draw.integers(0, 3, n).astype(np.uint32)) for k, n in ((5, 250), (9, 1), (12, 100))}
    dealt = lm.pa.Table.from_batches([b for k, (hashes, middles) in slices.items() for b in lm._dealt(k, hashes, middles, 4)])
    answers = lm.pa.concat_tables(
        [lm._counted(dealt.filter(lm.pc.equal(dealt["group"], g))) for g in set(dealt["group"].to_pylist())]
    )
    total = Counter(h for hashes, _ in slices.values() for h in hashes)
    same = Counter(x for own in slices.values() for x in zip(*own, strict=True))
    for k, (hashes, middles) in slices.items():
        p = draw.uniform(0.01, 0.9, len(hashes))
        found = lm._gains(hashes, np.log(p), lm._answers(answers.filter(lm.pc.equal(answers["slice"], k))))
        want = [
            np.log((same[h, m] - 1 + lm.PRIOR * q) / (total[h] - 1 + lm.PRIOR) / q) if total[h] > 1 else 0
            for h, m, q in zip(hashes, middles, p, strict=True)
        ]
        assert found == pytest.approx(np.array(want))
