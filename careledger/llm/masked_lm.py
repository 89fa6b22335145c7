"""Masked pseudo-likelihood of documents by a bidirectional window network, in numpy.

The network sees two tokens on either side of a masked one and predicts it: embeddings,
one hidden layer, and a softmax in two steps, over blocks of the vocabulary and then inside
the block. The sum of the log-probabilities of all tokens scores a document.

Everything is learned from the whole corpus. Words are counted over all documents; every
document is trained on once, in rounds. In a round each task runs gradient steps on its
documents and the parameters are averaged, weighted by tokens, in a grouped aggregation.

The vocabulary is every word of the corpus, a table of counts that grows with it. A word
without a token of its own has the probability of its token times its share of the words
counted for that token, so the probabilities of all words sum to one. Tasks know the shares
of common words; those of the others are joined in. The driver sees the common words, at
most 1 / COMMON_SHARE, and the parameters, whose number is fixed here.

Texts are split once: slices of word numbers in the shared folder are what training, counting
and scoring read. On demand the network is the prior of counts that grow with the corpus: how
often the words on both sides occur elsewhere in it, and how often around the same word. For
these, a slice sends a sorted hash of every window and the word in it to groups of hashes, and
gets two counts for each back. The windows themselves are never written; they follow from the slice.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careledger.llm.shared import cut, documents_of, loose_bytes, squeezed_bytes

#: Words with a token of their own, and tokens that all other words share by hash.
FREQUENT, SHARED = 768, 256
TOKENS = FREQUENT + SHARED
#: The two steps of the softmax: TOKENS = BLOCKS * BLOCKS.
BLOCKS = 32
#: Padding outside a document.
EDGE = TOKENS
WINDOW = (-2, -1, 1, 2)
EMBEDDING, HIDDEN = 8, 16
ROUNDS, RATE, STEP_TOKENS = 2, 0.05, 2048
#: Share of all tokens from which tasks know a word's share; the other words are joined.
COMMON_SHARE = 1e-6
#: Occurrences elsewhere that the network's probability weighs against counted windows.
PRIOR = 1.0
#: Bound on all inputs of a softmax below which their exponentials need no shift.
_SAFE = 40.0
_LEAST = np.finfo(np.float32).tiny
#: Bits of the place of a window in the part of a slice that is dealt at once; tokens of a slice.
_PLACE = 20
_SLICE = 1 << _PLACE
#: Bits of a window's hash that it is sorted by, and those that follow; more are not sent.
_SORTED, _LOW = 64 - _PLACE, 8
#: Windows of a group at least, as a power of two, and bits of the number of groups at most.
_GROUP, _MOST_BITS = 17, 11
#: From here on a word's number in a window is a hash.
_RARE = 1 << 23
#: Different words that a task counts before it passes its counts on.
_COUNTED = 400_000

SHAPES = {
    "embedding": (TOKENS + 1, EMBEDDING),
    "hidden": (len(WINDOW) * EMBEDDING, HIDDEN),
    "hidden_bias": (HIDDEN,),
    "block": (HIDDEN, BLOCKS),
    "block_bias": (BLOCKS,),
    "block_shift": (BLOCKS, HIDDEN),
    "inner": (HIDDEN, BLOCKS),
    "inner_bias": (BLOCKS, BLOCKS),
}
Weights = dict[str, np.ndarray]


def first_weights(seed: int = 7) -> Weights:
    random = np.random.default_rng(seed)
    return {
        name: np.zeros(shape, np.float32)
        if name.endswith("bias")
        else random.normal(0, 1 / np.sqrt(shape[-1]), shape).astype(np.float32)
        for name, shape in SHAPES.items()
    }


def _exponents(x: np.ndarray, bound: float) -> np.ndarray:
    """exp(x) up to a factor per row; ``bound`` is one on all of ``abs(x)``."""
    if bound >= _SAFE:
        x = x - x.max(axis=1, keepdims=True)
    return np.exp(x)


def _row_sums(x: np.ndarray) -> np.ndarray:
    """One column; a product is faster than a sum of short rows."""
    return x @ np.ones((x.shape[1], 1), x.dtype)


@dataclass
class _Forward:
    """Layers of the network, and the exponents of both steps of the softmax."""

    inputs: np.ndarray
    hidden: np.ndarray
    to_block: np.ndarray
    shifted: np.ndarray
    to_inner: np.ndarray


def _forward(w: Weights, around: np.ndarray, block: np.ndarray) -> _Forward:
    inputs = w["embedding"].take(around, axis=0).reshape(len(block), -1)
    hidden = np.tanh(inputs @ w["hidden"] + w["hidden_bias"])
    bound = np.abs(w["block"]).sum(axis=0).max() + np.abs(w["block_bias"]).max()
    to_block = _exponents(hidden @ w["block"] + w["block_bias"], bound)
    shifted = hidden + w["block_shift"].take(block, axis=0)
    most = 1 + np.abs(w["block_shift"]).max()
    bound = most * np.abs(w["inner"]).sum(axis=0).max() + np.abs(w["inner_bias"]).max()
    to_inner = _exponents(shifted @ w["inner"] + w["inner_bias"].take(block, axis=0), bound)
    return _Forward(inputs, hidden, to_block, shifted, to_inner)


def log_likelihood(w: Weights, around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log-probability of each target between the tokens ``around`` it."""
    block, at = target // BLOCKS, np.arange(len(target)) * BLOCKS
    f = _forward(w, around, block)
    first = f.to_block.ravel().take(at + block) / _row_sums(f.to_block)[:, 0]
    second = f.to_inner.ravel().take(at + target % BLOCKS) / _row_sums(f.to_inner)[:, 0]
    # Shares that are zero in single precision have a finite log too.
    return np.log(np.maximum(first, _LEAST)) + np.log(np.maximum(second, _LEAST))


def _sums(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Row sums of ``values`` by index."""
    return np.stack([np.bincount(rows, c, size) for c in values.T], axis=1).astype(np.float32)


def gradients(w: Weights, around: np.ndarray, target: np.ndarray) -> Weights:
    """Of the mean negative log-likelihood."""
    n = len(target)
    block, at = target // BLOCKS, np.arange(n) * BLOCKS
    f = _forward(w, around, block)
    is_block = np.zeros((n, BLOCKS), f.hidden.dtype)
    is_block.ravel()[at + block] = 1
    to_block = f.to_block * (1 / (n * _row_sums(f.to_block))) - is_block / n
    to_inner = f.to_inner * (1 / (n * _row_sums(f.to_inner)))
    to_inner.ravel()[at + target % BLOCKS] -= 1 / n
    to_shifted = to_inner @ w["inner"].T
    to_sum = (to_shifted + to_block @ w["block"].T) * (1 - f.hidden * f.hidden)
    to_inputs = (to_sum @ w["hidden"].T).reshape(-1, EMBEDDING)
    return {
        "embedding": _sums(around.ravel(), to_inputs, TOKENS + 1),
        "hidden": f.inputs.T @ to_sum,
        "hidden_bias": to_sum.sum(axis=0),
        "block": f.hidden.T @ to_block,
        "block_bias": to_block.sum(axis=0),
        "block_shift": is_block.T @ to_shifted,
        "inner": f.shifted.T @ to_inner,
        "inner_bias": is_block.T @ to_inner,
    }


class Trainer:
    """Gradient steps with step sizes by the past gradients of each weight."""

    def __init__(self, weights: Weights):
        self.weights = {k: v.copy() for k, v in weights.items()}
        self._past = {k: np.full_like(v, 1e-6) for k, v in weights.items()}
        self.tokens = 0

    def step(self, around: np.ndarray, target: np.ndarray) -> None:
        for name, g in gradients(self.weights, around, target).items():
            self._past[name] += g * g
            self.weights[name] -= RATE * g / np.sqrt(self._past[name])
        self.tokens += len(target)


def _code(word: bytes, place: int) -> int:
    """A place below, 31 bits of the word's hash above."""
    return zlib.crc32(word) >> 1 << 32 | place


class _Numbers(dict):
    """Numbers of words: those known to all tasks come first, then a slice's others as they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


#: Odd multipliers of the hash of a window, by place in it.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _windows(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words on both sides of each word."""
    line = np.zeros(len(codes) + 4, np.uint64)
    line[2:-2] = codes >> 32
    return _mixed(line, np.arange(2, len(codes) + 2))


def _mixed(line: np.ndarray, places: np.ndarray) -> np.ndarray:
    mixed = np.zeros(len(line) - 4, np.uint64)
    for d, by in zip(WINDOW, _MIX, strict=True):
        mixed += line[2 + d : 2 + d + len(mixed)] * by
    return _finished(mixed[places - 2])


def _finished(mixed: np.ndarray) -> np.ndarray:
    mixed = (mixed ^ mixed >> np.uint64(29)) * _MIX[0]
    return mixed ^ mixed >> np.uint64(32)


def _planes(numbers: np.ndarray, some: slice = slice(None)) -> np.ndarray:
    """Some bytes of all numbers, the lowest of each first; those that are mostly zero take little when squeezed."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.strides[0]).T[some])


def _from_planes(planes: np.ndarray, kind: type) -> np.ndarray:
    full = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    full[:, : len(planes)] = planes.T
    return full.view(kind)[:, 0]


class _Vocabulary:
    """The words that all tasks know, those with a token first: their tokens, hashes and log-shares."""

    def __init__(self, words: list[bytes], known: list[tuple[bytes, float]] = ()):
        self.words = words + [w for w, _ in known]
        self.log_shares = np.concatenate([np.zeros(len(words)), [share for _, share in known]])
        self.hashes = np.array([zlib.crc32(w) for w in self.words], np.uint32)
        self.tokens = FREQUENT + self.hashes % SHARED
        self.tokens[: len(words)] = np.arange(len(words))


class _Slice:
    """The words of some texts: their numbers, tokens, and places in a line with two edges around each text."""

    def __init__(self, known: _Vocabulary, sizes: list[int], codes: bytes, rare: bytes):
        self.number = _from_planes(np.frombuffer(loose_bytes(codes), np.uint8).reshape(4, -1), np.uint32)
        self.sizes = np.array(sizes, np.int64)
        self.known, self.rare = known, loose_bytes(rare).split()
        self.hashes = np.concatenate([known.hashes, np.array([zlib.crc32(w) for w in self.rare], np.uint32)])
        self.row = np.repeat(np.arange(len(sizes)), self.sizes)
        self.places = np.arange(len(self.row)) + 4 * self.row + 2

    def line(self, values: np.ndarray, edge: int, kind: type) -> np.ndarray:
        full = np.full(len(self.row) + 4 * len(self.sizes), edge, kind)
        full[self.places] = values
        return full

    def stretches(self) -> Iterator[_Stretch]:
        """All tokens, STEP_TOKENS at a time; ``row`` is the index of their text."""
        tokens = np.concatenate([self.known.tokens, FREQUENT + self.hashes[len(self.known.words) :] % SHARED])
        line = self.line(tokens[self.number], EDGE, np.int64)
        for start in range(0, len(self.row), STEP_TOKENS):
            at = self.places[start : start + STEP_TOKENS]
            around = np.stack([line[at + d] for d in WINDOW], axis=1)
            yield _Stretch(around, line[at], self.row[start : start + STEP_TOKENS])

    def windows(self, windows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, number of the word inside and index of the windows whose hash ``windows`` divides."""
        hashes = _mixed(self.line(self.hashes[self.number] >> 1, 0, np.uint64), self.places)
        at = np.flatnonzero(hashes % np.uint64(windows) == 0) if windows > 1 else np.arange(len(hashes))
        middles = np.arange(len(self.hashes), dtype=np.uint32)
        own = len(self.known.words)
        middles[own:] = _RARE | self.hashes[own:] >> 1 & _RARE - 1
        return hashes[at], middles[self.number[at]], at


@dataclass
class _Stretch:
    """Tokens of some documents, or of a part of a long one, with their surroundings."""

    around: np.ndarray
    target: np.ndarray
    row: np.ndarray


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n of every word of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def counted() -> pa.RecordBatch:
            arrays = [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["word", "n"])

        for batch in batches:
            for text in batch.column("text"):
                counts.update(text.as_py().lower().split())
                if len(counts) > _COUNTED:
                    yield counted()
                    counts.clear()
        yield counted()

    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, most: int) -> list[bytes]:
    return [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]


def frequent_words(docs: DataFrame, most: int = FREQUENT) -> list[bytes]:
    """The most frequent words of all documents; ties by the word."""
    return _most_frequent(word_counts(docs), most)


def word_shares(counts: DataFrame, words: list[bytes]) -> DataFrame:
    """word, n and log_share of all words but ``words``: the log of n in the sum of its token."""
    rest = counts.join(F.broadcast(_as_table(counts, words)), "word", "left_anti")
    rest = rest.withColumn("token", F.crc32("word") % SHARED)
    totals = rest.groupBy("token").agg(F.sum("n").alias("total"))
    return rest.join(F.broadcast(totals), "token").select("word", "n", F.log(F.col("n") / F.col("total")).alias("log_share"))


def _as_table(like: DataFrame, words: list[bytes]) -> DataFrame:
    return like.sparkSession.createDataFrame([(bytearray(w),) for w in words], "word binary")


#: A word between its window: hashes of window and word, its log-share or log-probability,
#: and the word itself if its share is still to be joined.
_HITS = "hits array<struct<window long, middle int, log_prob float, word binary>>"
_LINES = "slice long, turn int, docs array<long>, sizes array<int>, codes binary, rare binary"


def encoded(docs: DataFrame, known: _Vocabulary, rounds: int = ROUNDS) -> DataFrame:
    """All rows of ``docs`` in slices of about _SLICE words: slice, turn, docs, sizes, codes and rare.

    docs holds the rows' doc_ids, sizes their numbers of words, codes the numbers of these words,
    rare the words that ``known`` has not. turn, the round of training, is the same for a slice.
    Written, as the slices must stay the same.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _Numbers({w: i for i, w in enumerate(known.words)})
        begun, ends = {}, TaskContext.get().partitionId() << 32

        def passed(turn: int) -> pa.RecordBatch:
            nonlocal ends
            numbers, ids, lines = begun.pop(turn)
            codes = squeezed_bytes(_planes(np.concatenate(lines)).tobytes())
            rare = squeezed_bytes(b" ".join(list(numbers)[len(first) :]))
            ends += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([ends], pa.int64()),
                    pa.array([turn], pa.int32()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([[len(x) for x in lines]], pa.list_(pa.int32())),
                    pa.array([codes], pa.binary()),
                    pa.array([rare], pa.binary()),
                ],
                ["slice", "turn", "docs", "sizes", "codes", "rare"],
            )

        size = Counter()
        for batch in batches:
            columns = (batch.column("doc_id").to_pylist(), batch.column("turn").to_pylist(), batch.column("text"))
            for doc_id, turn, text in zip(*columns, strict=True):
                own = text.as_py().lower().split()
                if turn in begun and size[turn] + len(own) > _SLICE:
                    yield passed(turn)
                if turn not in begun:
                    begun[turn], size[turn] = (_Numbers(first), [], []), 0
                numbers, ids, lines = begun[turn]
                ids.append(doc_id)
                lines.append(np.fromiter(map(numbers.__getitem__, own), np.uint32, len(own)))
                # Texts without words take room too.
                size[turn] += len(own) + 8
        for turn in list(begun):
            yield passed(turn)

    texts = docs.select(
        "doc_id",
        F.pmod(F.xxhash64("text"), F.lit(rounds)).cast("int").alias("turn"),
        F.col("text").cast("binary").alias("text"),
    )
    return cut(texts.mapInArrow(encode, _LINES), "encoded")


def _slices(batch: pa.RecordBatch | pa.Table, known: _Vocabulary) -> Iterator[_Slice]:
    columns = [batch.column(c).to_pylist() for c in ("sizes", "codes", "rare")]
    for sizes, codes, rare in zip(*columns, strict=True):
        yield _Slice(known, sizes, codes, rare)


def train(docs: DataFrame, words: list[bytes], rounds: int = ROUNDS) -> Weights:
    """Weights from one pass over all documents, in ``rounds`` parts by a hash of the text."""
    known = _Vocabulary(words)
    lines = encoded(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), known, rounds)
    return train_encoded(lines, known, rounds)


def train_encoded(lines: DataFrame, known: _Vocabulary, rounds: int = ROUNDS) -> Weights:
    """Like ``train``, of texts that are encoded."""
    weights = first_weights()

    for turn in range(rounds):
        start = weights

        def learn(batches: Iterator[pa.RecordBatch], start: Weights = start) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(start)
            for batch in batches:
                for own in _slices(batch, known):
                    for part in own.stretches():
                        trainer.step(part.around, part.target)
            if trainer.tokens:
                flat = np.concatenate([trainer.weights[k].ravel() for k in SHAPES]).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(len(flat))),
                        pa.array(flat * trainer.tokens),
                        pa.array(np.full(len(flat), trainer.tokens, np.int64)),
                    ],
                    ["place", "total", "tokens"],
                )

        own = lines.filter(F.col("turn") == turn).select("sizes", "codes", "rare")
        parts = own.mapInArrow(learn, "place long, total double, tokens long")
        mean = parts.groupBy("place").agg((F.sum("total") / F.sum("tokens")).alias("mean")).collect()
        if mean:
            # Rounded, as the order of the sums is not fixed.
            flat = np.empty(len(mean))
            flat[[r["place"] for r in mean]] = [round(r["mean"], 6) for r in mean]
            sizes = [int(np.prod(s)) for s in SHAPES.values()]
            cuts = np.split(flat.astype(np.float32), np.cumsum(sizes)[:-1])
            weights = {k: x.reshape(s) for (k, s), x in zip(SHAPES.items(), cuts, strict=True)}
    return weights


def _sorted(hashes: np.ndarray) -> np.ndarray:
    """The hashes of a part of a slice in order, with their places in the lowest bits."""
    return np.sort(hashes >> np.uint64(_PLACE) << np.uint64(_PLACE) | np.arange(len(hashes), dtype=np.uint64))


def _places(ordered: np.ndarray) -> np.ndarray:
    return (ordered & np.uint64((1 << _PLACE) - 1)).astype(np.int64)


_DEALT = "slice long, part int, group int, hits binary"


def _dealt(own: int, hashes: np.ndarray, middles: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """The windows of a slice and the words inside, by the highest ``bits`` of their hashes.

    In order, so that the differences of hashes are small numbers.
    """
    for part, start in enumerate(range(0, len(hashes), _SLICE)):
        some = slice(start, start + _SLICE)
        ordered = _sorted(hashes[some])
        at = _places(ordered) + start
        top = ordered >> np.uint64(_PLACE)
        width = np.uint64(_SORTED - bits)
        bounds = np.searchsorted(top, np.arange(1 << bits, dtype=np.uint64) << width).tolist() + [len(top)]
        begun = [b for b, e in zip(bounds, bounds[1:], strict=False) if b < e]
        gaps = np.diff(top, prepend=np.uint64(0))
        gaps[begun] = top[begun] & (np.uint64(1) << width) - np.uint64(1)
        low = (hashes[at] >> np.uint64(_PLACE - _LOW)).astype(np.uint8)
        gaps, middle = _planes(gaps, slice(0, 6)), _planes(middles[at], slice(0, 3))
        full = np.concatenate([gaps[:3], low[None], middle[:1]])
        rest = np.concatenate([gaps[3:], middle[1:]])
        groups, blobs = [], []
        for group, (b, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if b < e:
                groups.append(group)
                blobs.append(squeezed_bytes(rest[:, b:e].tobytes()) + full[:, b:e].tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(groups), own), pa.int64()),
                pa.array(np.full(len(groups), part), pa.int32()),
                pa.array(groups, pa.int32()),
                pa.array(blobs, pa.binary()),
            ],
            ["slice", "part", "group", "hits"],
        )


def _hits(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and words of the windows of a part in one group."""
    size = int.from_bytes(blob[:8], "little") // 5
    full = np.frombuffer(blob, np.uint8)[len(blob) - 5 * size :].reshape(5, size)
    rest = np.frombuffer(loose_bytes(blob[: len(blob) - 5 * size]), np.uint8).reshape(5, size)
    top = np.cumsum(_from_planes(np.concatenate([full[:3], rest[:3]]), np.uint64))
    return top << np.uint64(_LOW) | full[3], _from_planes(np.concatenate([full[4:], rest[3:]]), np.uint32)


def _others(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each value stands elsewhere, and the number of each."""
    order = np.argsort(values)
    ordered = values[order]
    run = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
    others, number = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
    others[order], number[order] = np.bincount(run)[run] - 1, run
    return others, number


def _counted(table: pa.Table) -> pa.Table:
    """Of each window of a group, how often it stands elsewhere, and there around other words."""
    parts = [_hits(x.as_py()) for x in table.column("hits")]
    window, middle = (np.concatenate(x) for x in zip(*parts, strict=True))
    total, number = _others(window)
    some = np.flatnonzero(total)
    different = np.zeros(len(total), np.int64)
    different[some] = total[some] - _others(number[some] << 24 | middle[some])[0] if len(some) else 0
    both = np.stack([total, different], axis=1).astype(np.uint32)
    ends = np.cumsum([len(w) for w, _ in parts])
    answers = [squeezed_bytes(_planes(x).tobytes()) for x in np.split(both, ends[:-1])]
    return pa.table(
        {c: table.column(c) for c in ("slice", "part", "group")} | {"answer": pa.array(answers, pa.binary())}
    )


_ANSWERS = "slice long, part int, group int, answer binary"


def _gains(hashes: np.ndarray, log_prob: np.ndarray, answers: dict[int, list[bytes]]) -> np.ndarray:
    """What the counts of its window add to the log-probability of each word; 0 for windows that stand once.

    ``answers``: by part, of its groups in order.
    """
    total, different = np.zeros(len(hashes)), np.zeros(len(hashes))
    for part, start in enumerate(range(0, len(hashes), _SLICE)):
        at = _places(_sorted(hashes[start : start + _SLICE])) + start
        found = [_from_planes(np.frombuffer(loose_bytes(x), np.uint8).reshape(8, -1), np.uint64) for x in answers[part]]
        both = np.concatenate(found).view(np.uint32).reshape(-1, 2)
        total[at], different[at] = both[:, 0], both[:, 1]
    gain, some = np.zeros(len(hashes)), np.flatnonzero(total)
    n = total[some] - different[some]
    # As a factor of p, so that a p of nearly zero is no log of zero where n is 0.
    gain[some] = np.log((n * np.exp(-log_prob[some]) + PRIOR) / (total[some] + PRIOR))
    return gain


def _answers(table: pa.Table) -> dict[int, list[bytes]]:
    """By part, in the order of their groups."""
    found: dict[int, list[tuple[int, bytes]]] = {}
    for part, group, answer in zip(*(table.column(c).to_pylist() for c in ("part", "group", "answer")), strict=True):
        found.setdefault(part, []).append((group, answer))
    return {part: [x for _, x in sorted(own)] for part, own in found.items()}


def _counts(dealt: DataFrame) -> DataFrame:
    return dealt.groupBy("group").applyInArrow(_counted, _ANSWERS)


def window_gains(scored: DataFrame, shares: DataFrame) -> DataFrame:
    """row and gain: what counts of the windows in ``hits`` add to the log-probabilities.

    A window that also stands elsewhere, ``total`` times, and there ``n`` times around the same
    word, gives this word (n + PRIOR * p) / (total + PRIOR) in place of the network's p. All hits
    of a window meet in one of a fixed number of groups, as arrays; Spark deals and adds up.
    """
    hits = scored.select("row", F.posexplode("hits").alias("place", "hit")).select("row", "place", "hit.*")
    joined = hits.join(shares.select("word", "log_share"), "word", "left")
    log_prob = F.col("log_prob") + F.coalesce("log_share", F.lit(0.0))
    rows = joined.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("place", "window", "middle", log_prob.alias("log_prob")))).alias("hits")
    )

    def arrays(own: list[dict]) -> list[np.ndarray]:
        window = _finished(np.array([h["window"] for h in own], np.int64).view(np.uint64))
        return [window, np.array([h["middle"] for h in own], np.uint32), np.array([h["log_prob"] for h in own])]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, own in zip(batch.column("row").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                hashes, middles, _ = arrays(own)
                yield from _dealt(row, hashes, middles % (1 << 24), _MOST_BITS)

    def gains(rows: pa.Table, answers: pa.Table) -> pa.Table:
        hashes, _, log_prob = arrays(rows.column("hits")[0].as_py())
        gain = _gains(hashes, log_prob, _answers(answers))
        some = [gain.sum()] if gain.any() else []
        return pa.table({"row": rows.column("row")[: len(some)], "gain": pa.array(some, pa.float64())})

    counts = _counts(rows.mapInArrow(deal, _DEALT)).withColumnRenamed("slice", "row")
    return rows.groupBy("row").cogroup(counts.groupBy("row")).applyInArrow(gains, "row long, gain double")


def _rare_shares(lines: DataFrame, shares: DataFrame, groups: int) -> DataFrame:
    """The log-shares of the ``rare`` words of all slices, in part -1, by group of their hash."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, rare in zip(batch.column("slice").to_pylist(), batch.column("rare").to_pylist(), strict=True):
                dealt: dict[int, list[bytes]] = {}
                for word in loose_bytes(rare).split():
                    dealt.setdefault(zlib.crc32(word) % groups, []).append(word)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([own] * len(dealt), pa.int64()),
                        pa.array(list(dealt), pa.int32()),
                        pa.array([squeezed_bytes(b" ".join(x)) for x in dealt.values()], pa.binary()),
                    ],
                    ["slice", "group", "words"],
                )

    def look_up(dealt: pa.Table, shares: pa.Table) -> pa.Table:
        words = [loose_bytes(x.as_py()).split() for x in dealt.column("words")]
        every = pa.array([w for own in words for w in own], pa.binary())
        found = pc.index_in(every, shares.column("word").combine_chunks()).to_numpy(zero_copy_only=False)
        log_shares = shares.column("log_share").to_numpy()[found.astype(np.int64)] if len(every) else np.zeros(0)
        ends = np.cumsum([len(own) for own in words])
        answers = [x.tobytes() for x in np.split(log_shares, ends[:-1])] if words else []
        return pa.table(
            {
                "slice": dealt.column("slice"),
                "part": pa.array(np.full(len(words), -1), pa.int32()),
                "group": dealt.column("group"),
                "answer": pa.array(answers, pa.binary()),
            }
        )

    dealt = lines.select("slice", "rare").mapInArrow(deal, "slice long, group int, words binary")
    own = shares.select("word", "log_share", (F.crc32("word") % groups).cast("int").alias("group"))
    return dealt.groupBy("group").cogroup(own.groupBy("group")).applyInArrow(look_up, _ANSWERS)


def pseudo_likelihood(docs: DataFrame, common_share: float = COMMON_SHARE, windows: int = 0) -> DataFrame:
    """doc_id, tokens, log_prob, word_log_prob and score of every document.

    log_prob sums what the network gives to its own tokens, word_log_prob what each word
    itself has, which is less where words share a token; score is the latter per token.
    A null or empty text has no tokens, sums of 0 and no score. Repeated rows count as
    often as they stand and score alike. Other columns are not read. The scores depend a
    little on how rows are spread over tasks, as training does, not on ``common_share``.

    With ``windows``, counts of the windows whose hash it divides, of all documents, add
    window_gain, which is also part of the score; see ``window_gains``.
    """
    texts = documents_of(docs).select(F.col("doc_id").cast("long"), "text")
    counts = cut(word_counts(texts), "words")
    words = _most_frequent(counts, FREQUENT)
    shares = word_shares(counts, words)
    size = counts.agg(F.sum("n")).first()[0] or 0
    least = common_share * size
    common = shares.filter(F.col("n") >= least).collect()
    # The most frequent ones have the least numbers, which take least when squeezed.
    common.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    known = _Vocabulary(words, [(bytes(r["word"]), r["log_share"]) for r in common])
    lines = encoded(texts, known)
    weights = train_encoded(lines, known)
    bits = min(max((size >> _GROUP).bit_length(), 4), _MOST_BITS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, own in zip(batch.column("slice").to_pylist(), _slices(batch, known), strict=True):
                hashes, middles, _ = own.windows(windows)
                yield from _dealt(number, hashes, middles, bits)

    def score(slices: pa.Table, answers: pa.Table) -> pa.Table:
        own, by_part = next(_slices(slices, known)), _answers(answers)
        rows, words_known = len(own.sizes), len(known.words)
        log_prob = np.concatenate([np.zeros(0), *(log_likelihood(weights, p.around, p.target) for p in own.stretches())])
        # Groups have the rare words in the order of the slice.
        group = own.hashes[words_known:] % groups
        rare = np.zeros(len(group))
        rare[np.argsort(group, kind="stable")] = np.frombuffer(b"".join(by_part.get(-1, [])), np.float64)
        word_log_prob = log_prob + np.concatenate([known.log_shares, rare])[own.number]
        gain = np.zeros(len(log_prob))
        if windows:
            hashes, _, at = own.windows(windows)
            gain[at] = _gains(hashes, word_log_prob[at], by_part)
        sums = [np.bincount(own.row, x, rows).astype(float) for x in (log_prob, word_log_prob, gain)]
        docs = slices.column("docs").combine_chunks().flatten()
        return pa.table([docs, *map(pa.array, (own.sizes, *sums))], names=names)

    groups = 1 << bits - 2
    answers = _rare_shares(lines, shares.filter(F.col("n") < least), groups)
    if windows:
        dealt = lines.select("slice", "sizes", "codes", "rare").mapInArrow(deal, _DEALT)
        answers = answers.unionByName(_counts(dealt))
    names = ["doc_id", "tokens", "log_prob", "word_log_prob", "window_gain"]
    schema = "doc_id long, tokens long, log_prob double, word_log_prob double, window_gain double"
    # A slice has no row without its texts, but may have no answers.
    found = lines.drop("turn").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(score, schema)
    total = F.col("word_log_prob") + F.col("window_gain")
    found = found.withColumn("score", F.when(F.col("tokens") > 0, total / F.col("tokens")))
    return found if windows else found.drop("window_gain")
