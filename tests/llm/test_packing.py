import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from careledger.llm.packing import pack, plan
from careledger.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(counts, capacity):
    used = Counter()
    sequences = 0
    for runs, times in plan(counts, capacity):
        assert times > 0 and sum(length * n for length, n in runs) <= capacity
        for length, n in runs:
            used[length] += n * times
        sequences += times
    assert used == Counter({k: v for k, v in counts.items() if v})
    return sequences


@pytest.mark.parametrize("seed", range(60))
def test_plans_use_every_piece_once(seed):
    draw = random.Random(seed)
    capacity = draw.choice([8, 20, 64])
    check({draw.randint(1, capacity): draw.randint(1, 9) for _ in range(draw.randint(0, 12))}, capacity)


def test_exact_combinations_come_first():
    assert check({7: 5, 3: 5}, 10) == 5
    assert check({6: 2, 3: 2, 1: 2, 5: 1, 4: 1}, 10) == 3  # with a pair for the gap
    assert check({4: 1, 3: 1, 2: 1, 1: 1, 5: 2}, 10) == 2  # with a triple
    assert check({5: 3}, 10) == 2


def test_close_to_the_least_number():
    draw = np.random.default_rng(0)
    lengths = np.clip(draw.lognormal(6.2, 1, 50_000).astype(int), 1, 2048)
    counts = Counter(lengths.tolist())
    assert check(counts, 2048) <= 1.002 * -(-int(lengths.sum()) // 2048)
    assert check({700: 10**9, 3: 10**10}, 2048) == 5 * 10**8


def verify(rows, found, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start : start + capacity]
            want[doc_id, piece, start, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


@pytest.mark.parametrize("capacity", [2048, 16])
def test_odd_rows(make_docs, odd_rows, capacity):
    found = pack(make_docs(odd_rows).repartition(5), PATH, capacity).collect()
    sequences = verify(odd_rows, found, capacity)
    assert sequences <= 1 + sum(r.length for r in found) // capacity * 1.02 + 1


def test_one_very_common_length(make_docs):
    rows = [(i, "same words here") for i in range(500)] + [(1000 + i, "w " * i) for i in range(60)]
    found = pack(make_docs(rows).repartition(7), PATH, 64).collect()
    assert verify(rows, found, 64) == -(-sum(r.length for r in found) // 64)


def test_empty_table(make_docs):
    assert pack(make_docs([]), PATH).count() == 0


def test_words_give_the_ids_of_texts():
    draw = random.Random(1)
    texts = ["Don't I'LL S’s Ünï £€ ¼ x²", "<|endoftext|>x a<|startoftext|> <| z", "\x1c\x85\xa0 b　c é ΣΑΣ İ", "", " ́ a", "''s'tt 're"]
    texts += ["".join(chr(draw.choice([draw.randrange(256), draw.randrange(0x3000), 32, 39])) for _ in range(60)) for _ in range(400)]
    own, plain = WordTokenizer(PATH, keep=500), Tokenizer.from_file(PATH)
    for text, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_remembered_words_are_bounded():
    """In sum over Latin and other texts, also where one text has more words than may be kept."""
    own, plain = WordTokenizer(PATH, keep=500), Tokenizer.from_file(PATH)
    texts = [" ".join(f"{sign}{k}q{i}" for i in range(n)) for k, n in enumerate([40, 90, 700, 200, 5]) for sign in ("x", "日")]
    for _ in range(2):
        for text, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert 0 < len(own._known_words) + len(own._known_parts) <= 500
