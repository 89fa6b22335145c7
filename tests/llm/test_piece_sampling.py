import math
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from careledger.llm import piece_sampling as ps

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", "a", " ", "  a  b\n\tc", "▁x ▁", "日本語テキスト 👍🏽", "\x00\x01 é\U0010ffff", "aaaa" * 50, " lead", "trail "]


@pytest.fixture(scope="module")
def sampler():
    return ps.PieceSampler(PATH)


def test_decoding_is_lossless(sampler):
    ids = sampler.encode(list(range(len(TEXTS))), TEXTS)
    assert [sampler.decode(i.tolist()).decode() for i in ids] == TEXTS


def test_a_row_does_not_depend_on_its_batch(sampler):
    together = sampler.encode(list(range(len(TEXTS))), TEXTS)
    alone = [sampler.encode([k], [t])[0] for k, t in enumerate(TEXTS)]
    assert [a.tolist() for a in alone] == [t.tolist() for t in together]
    again = sampler.encode([7] * 3, ["some words here"] * 3, seed=1)
    assert again[0].tolist() == again[1].tolist() == again[2].tolist()


def test_all_paths_with_their_probability(sampler):
    """Against every path through the lattice of one word."""
    model = SentencePieceProcessor(model_file=PATH)
    ids = {model.id_to_piece(i): i for i in range(model.vocab_size())}

    def paths(rest):
        if not rest:
            yield ()
        for n in range(1, len(rest) + 1):
            if rest[:n] in ids:
                for path in paths(rest[n:]):
                    yield (ids[rest[:n]], *path)

    def weight(i):
        rank = -model.get_score(i)
        return (min(rank, model.vocab_size()) + 2) ** -ps.SHARPNESS

    weights = {p: math.prod(map(weight, p)) for p in paths("▁there")}
    n, total = 60_000, sum(weights.values())
    found = Counter(tuple(x.tolist()) for x in sampler.encode(list(range(n)), ["there"] * n))
    assert set(found) <= set(weights)
    for path, w in weights.items():
        assert found[path] / n == pytest.approx(w / total, abs=0.01)


def test_odd_rows(make_docs, odd_rows, sha):
    docs = make_docs(odd_rows)
    found = ps.sampled_round_trip(docs, PATH).collect()
    want = sorted((repr(i), sha(t or "")) for i, t in odd_rows)
    assert sorted((repr(r.doc_id), r.text_sha256) for r in found) == want
    assert all(r.n_pieces == len(r.ids) and (r.n_pieces > 0 or r.text_sha256 == sha("")) for r in found)
    again = ps.sampled_round_trip(docs.repartition(5), PATH).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    other = ps.sampled_round_trip(docs, PATH, seed=9).collect()
    assert sorted(map(repr, other)) != sorted(map(repr, found))


def test_empty_table(make_docs):
    assert ps.sampled_round_trip(make_docs([]), PATH).count() == 0


def test_all_lists_of_a_batch_are_decoded_at_once(sampler, monkeypatch):
    """As one by one, in any slices; bytes that are no UTF-8 raise an error."""
    texts = TEXTS + ["some words, here and there"] * 50
    ids = [x.tolist() for x in sampler.encode(list(range(len(texts))), texts)]
    lists = pa.array([[1], *ids], pa.list_(pa.int32())).slice(1)
    for size in (1, 40, 500_000):
        monkeypatch.setattr(ps, "BATCH_CHARS", size)
        assert sampler.decode_all(lists).to_pylist() == texts
    assert sampler.decode_all(lists.slice(0, 0)).to_pylist() == []
    space, high = (sampler._bytes.index(x) for x in (b" ", b"\xff"))
    with pytest.raises(pa.ArrowInvalid):
        sampler.decode_all(pa.array([[space, high]], pa.list_(pa.int32())))
    with pytest.raises(ValueError):
        sampler.decode_all(pa.array([[space, None]], pa.list_(pa.int32())))


def test_decoding_makes_no_object_for_an_id(sampler):
    ids = sampler.encode(list(range(500)), ["some words, here and there " * 40] * 500)
    lists = pa.array(ids, pa.list_(pa.int32()))

    def seconds(do):
        found = []
        for _ in range(3):
            start = time.process_time()
            do()
            found.append(time.process_time() - start)
        return min(found)

    assert seconds(lambda: sampler.decode_all(lists)) < seconds(lambda: [sampler.decode(x) for x in ids]) / 2


def test_words_of_any_length_side_by_side(sampler):
    """Depths past 16 bits are sorted too, and long words change nothing for short ones."""
    texts = ["a", "x" * 70_000, "there " * 30, "日" * 300]
    together = sampler.encode([1, 2, 3, 4], texts)
    assert [sampler.decode(x.tolist()).decode() for x in together] == texts
    for key, text, ids in zip((1, 2, 3, 4), texts, together, strict=True):
        assert np.array_equal(ids, sampler.encode([key], [text])[0])
