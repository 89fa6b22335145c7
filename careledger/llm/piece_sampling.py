"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

A text is a path through the lattice of vocabulary pieces over its characters. Weights of
all paths to each position are summed going forward; going backward each piece is drawn in
proportion to the paths that end in it. Draws come from a hash of row key, word and step,
so a row gets the same segmentation in any batch, task or run.

Pieces never cross from a word into the space before the next one, so the lattice falls
into words. Each different word of a batch is filtered once; all its occurrences are
sampled together, one step at a time.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careledger.llm.shared import documents_of

#: How sharply frequent pieces are preferred: a piece of merge rank r weighs r ** -SHARPNESS.
SHARPNESS = 0.7
#: Characters that are segmented at a time, whole texts at least.
BATCH_CHARS = 500_000

SPACE = "▁"
#: Stands for a literal ``SPACE`` in a text; lone surrogates are in no valid text.
_LITERAL = "\udc81"
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Index:
    """Numbers by 64-bit key, looked up for whole arrays: open addressing, linear probing."""

    def __init__(self, keys: np.ndarray):
        self._bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self._keys = np.zeros(1 << self._bits, np.uint64)
        self._values = np.full(1 << self._bits, -1, np.int32)
        for value, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            while self._values[slot] >= 0:
                slot = (slot + 1) & ((1 << self._bits) - 1)
            self._keys[slot], self._values[slot] = key, value

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _BASE) >> np.uint64(64 - self._bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        slots = self._slots(keys)
        out = self._values[slots]
        open_ = np.flatnonzero((out >= 0) & (self._keys[slots] != keys))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self._bits) - 1)
            out[open_] = self._values[slots[open_]]
            open_ = open_[(out[open_] >= 0) & (self._keys[slots[open_]] != keys[open_])]
        return out


class PieceSampler:
    """Encodes with random segmentations, decodes without loss."""

    def __init__(self, model_path: str, sharpness: float = SHARPNESS):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_path)
        size = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self._bytes_from = names.index("<0x00>")
        byte_ids = range(self._bytes_from, self._bytes_from + 256)
        own = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        own = [i for i in own if SPACE not in names[i].lstrip(SPACE)]
        #: What each id stands for when decoding.
        self._bytes = [names[i].replace(SPACE, " ").encode() for i in range(size)]
        for i in byte_ids:
            self._bytes[i] = bytes([i - self._bytes_from])
        self._pieces = pa.array(self._bytes, pa.binary())
        # Pieces that a merge never made, such as runs of spaces, count as the rarest.
        rank = np.array([-model.get_score(i) for i in own])
        rank[rank >= 1e6] = size
        self._weights = -sharpness * np.log(rank + 2)
        self._byte_weight = -sharpness * np.log(size)
        self._ids = np.array(own, np.int32)
        self._longest = max(len(names[i]) for i in own)
        starts = sorted({names[i][:n] for i in own for n in range(1, len(names[i]) + 1)})
        self._starts = _Index(np.array([_key(s) for s in starts], np.uint64))
        where = {s: k for k, s in enumerate(starts)}
        self._piece_at = np.full(len(starts), -1, np.int32)  # a start that is a whole piece
        for k, i in enumerate(own):
            self._piece_at[where[names[i]]] = k

    def encode(self, keys: list[int], texts: list[str], seed: int = 0) -> list[np.ndarray]:
        """The sampled ids of each text; an empty text has none."""
        words, counts = [], []
        for text in texts:
            own = _WORDS.findall(SPACE + text.replace(SPACE, _LITERAL).replace(" ", SPACE)) if text else []
            words += own
            counts.append(len(own))
        if not words:
            return [np.empty(0, np.int32) for _ in texts]
        number = dict.fromkeys(words)
        different = list(number)
        number.update(zip(different, range(len(different)), strict=True))
        which = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        lattice = _Lattice(self, different)
        counts = np.array(counts)
        firsts = np.cumsum(counts) - counts
        row = np.repeat(np.arange(len(texts)), counts)
        row_keys = _mixed(np.array([(k or 0) & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64) ^ np.uint64(seed))
        draws = _mixed(row_keys[row] + (np.arange(len(words)) - firsts[row]).astype(np.uint64) * _BASE)
        ids, lengths = lattice.sample(which, draws)
        per_row = np.bincount(row, weights=lengths, minlength=len(texts)).astype(np.int64)
        return np.split(ids, np.cumsum(per_row)[:-1])

    def decode(self, ids: list[int]) -> bytes:
        """The UTF-8 text of ids, exactly as it was encoded."""
        return b"".join(map(self._bytes.__getitem__, ids))[1:]

    def decode_all(self, lists: pa.ListArray) -> pa.Array:
        """The texts of lists of ids, whole lists at a time; an error if one is no valid UTF-8."""
        texts = []
        for part in _slices(pc.list_value_length(lists).to_pylist()):
            some = lists.slice(part.start, part.stop - part.start)
            pieces = self._pieces.take(some.flatten())
            if pieces.null_count:
                raise ValueError("an id is null")
            if not len(pieces):
                texts.append(pa.array([""] * len(some), pa.string()))
                continue
            # The bytes of a text's pieces lie side by side; the first of them is the space before it.
            _, at, data = (x and np.frombuffer(x, t) for x, t in zip(pieces.buffers(), ("u1", "i4", "u1"), strict=True))
            ends = at[some.offsets.to_numpy() - some.offsets[0].as_py()]
            spaces = np.r_[0, np.cumsum(ends[1:] > ends[:-1])]
            data = np.delete(data[: ends[-1]], ends[:-1][ends[1:] > ends[:-1]])
            buffers = [None, pa.py_buffer((ends - spaces).astype(np.int32)), pa.py_buffer(data)]
            texts.append(pa.Array.from_buffers(pa.binary(), len(some), buffers).cast(pa.string()))
        return pa.concat_arrays(texts) if texts else pa.array([], pa.string())


def _key(text: str) -> int:
    key = 0
    for c in text:
        key = (key * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return key


class _Lattice:
    """The filtered lattices of different words, side by side.

    A node is a position in a word; an edge is a piece, or the bytes of a character that
    is no piece, and belongs to the node it ends in.
    """

    def __init__(self, sampler: PieceSampler, words: list[str]):
        lengths = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        word = np.repeat(np.arange(len(words)), lengths)
        char = np.arange(len(points))
        left = np.repeat(np.cumsum(lengths), lengths) - char  # characters up to the word's end
        self._first = np.cumsum(lengths + 1) - (lengths + 1)  # first node of each word
        self._last = self._first + lengths
        node = char + word  # the node before each character

        active, keys = char, np.zeros(len(char), np.uint64)
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        for length in range(1, sampler._longest + 1):
            inside = left[active] >= length
            active, keys = active[inside], keys[inside]
            keys = keys * _BASE + points[active + (length - 1)] + np.uint64(1)
            start = sampler._starts.find(keys)
            piece = np.where(start >= 0, sampler._piece_at[start], -1)
            found.append((active[piece >= 0], piece[piece >= 0], length))
            if length == 1:
                unknown = active[piece < 0]
            active, keys = active[start >= 0], keys[start >= 0]

        # Bytes of the characters without a piece, as one edge each.
        spelled = [chr(p).replace(_LITERAL, SPACE).encode() for p in points[unknown].tolist()]
        sizes = np.array([len(s) for s in spelled], np.int64)
        at = np.concatenate([*(f[0] for f in found), unknown])
        length = np.concatenate([*(np.full(len(f[0]), f[2]) for f in found), np.ones(len(unknown), np.int64)])
        piece = np.concatenate([f[1] for f in found])
        weight = np.concatenate([sampler._weights[piece], sampler._byte_weight * sizes])
        flat = np.frombuffer(b"".join(spelled), np.uint8).astype(np.int32) + sampler._bytes_from
        self._codes = np.concatenate([sampler._ids[piece], flat])
        code_count = np.concatenate([np.ones(len(piece), np.int64), sizes])
        code_start = np.cumsum(code_count) - code_count

        # In order of target, then length. Edges of a length are in order already, and so is what a stable
        # sort finds; no two edges are alike.
        target = node[at] + length
        order = np.argsort((target << 8) | length, kind="stable")
        at, target, length, weight = at[order], target[order], length[order], weight[order]
        source = target - length
        depth = target - self._first[word[at]]  # how far into its word an edge ends

        # By depth, all words side by side. Small numbers are sorted in one pass over them.
        by_depth = np.argsort(depth.astype(np.min_scalar_type(depth.max())), kind="stable")
        depth, from_, to = depth[by_depth], source[by_depth], target[by_depth]
        total = np.zeros(int(self._last[-1]) + 1)
        upto = weight[by_depth]
        heads = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        steps = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1], True])
        cuts = np.searchsorted(heads, steps)
        for a, b, c, d in zip(steps[:-1], steps[1:], cuts[:-1], cuts[1:], strict=True):
            upto[a:b] += total[from_[a:b]]
            total[to[heads[c:d]]] = np.logaddexp.reduceat(upto[a:b], heads[c:d] - a)
        score = np.empty(len(source))
        score[by_depth] = upto

        # Shares as whole numbers, whose sums are the same in any company of words.
        share = (np.exp(score - total[target]) * 2.0**32).astype(np.int64)
        ends = np.flatnonzero(np.r_[target[1:] != target[:-1], True])
        run = np.cumsum(share)
        before = np.r_[0, run[ends[:-1]]]
        bound = np.minimum(run - np.repeat(before, np.diff(np.r_[-1, ends])), 2**32 - 1).astype(np.uint64)
        bound[ends] = np.uint64(2**32 - 1)
        self._bounds = (target.astype(np.uint64) << np.uint64(32)) | bound
        self._source = source
        self._code_count, self._code_start = code_count[order], code_start[order]

    def sample(self, words: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all occurrences in a row, and how many each has."""
        node, first = self._last[words], self._first[words]
        # In order of word, as neighbours then search the same edges.
        active, taken, steps = np.argsort(words), [], np.zeros(len(words), np.int64)
        step = np.uint64(0)
        while len(active):
            step += np.uint64(1)
            luck = _mixed(draws[active] + step) >> np.uint64(32)
            edge = np.searchsorted(self._bounds, (node[active].astype(np.uint64) << np.uint64(32)) | luck)
            taken.append((active, edge))
            steps[active] += 1
            node[active] = self._source[edge]
            active = active[node[active] > first[active]]
        # The last piece is drawn first: each goes to its place from the end of its word.
        place = np.cumsum(steps) - 1
        edge = np.empty(int(steps.sum()), np.int64)
        for number, (active, drawn) in enumerate(taken):
            edge[place[active] - number] = drawn
        occurrence = np.repeat(np.arange(len(words)), steps)
        count = self._code_count[edge]
        places = np.repeat(self._code_start[edge] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        lengths = np.bincount(occurrence, weights=count, minlength=len(words)).astype(np.int64)
        return self._codes[places], lengths


def _sampler(path: str) -> PieceSampler:
    """One per worker process, kept with its main module as this code arrives with each task."""
    kept = vars(sys.modules["__main__"]).setdefault("_piece_samplers", {})
    if path not in kept:
        kept[path] = PieceSampler(path)
    return kept[path]


def _slices(sizes: list[int]) -> Iterator[slice]:
    """Ranges of rows with about BATCH_CHARS characters (or ids)."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > BATCH_CHARS:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def sampled(docs: DataFrame, model_path: str, seed: int = 0) -> DataFrame:
    """doc_id, n_pieces and ids of one sampled segmentation per text.

    The row key is doc_id, a null one counts as 0. A null or empty text has no ids.
    Repeated rows get the same ids. Other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(model_path)
        for batch in batches:
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("text")]
            for part in _slices(sizes):
                some = batch.slice(part.start, part.stop - part.start)
                ids = sampler.encode(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), seed)
                lengths = np.array([len(x) for x in ids], np.int64)
                offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(lengths), lists], ["doc_id", "n_pieces", "ids"]
                )

    texts = documents_of(docs).select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(encode, "doc_id long, n_pieces long, ids array<int>")


def decoded(df: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with the text of its ids; ids that are no valid UTF-8 raise an error."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        return _sampler(model_path).decode_all(lists)

    return df.withColumn(text, decode(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def sampled_round_trip(docs: DataFrame, model_path: str, seed: int = 0) -> DataFrame:
    """doc_id, n_pieces, ids and text_sha256 of the text that decoding the ids gives."""
    back = decoded(sampled(docs, model_path, seed), model_path)
    return back.select("doc_id", "n_pieces", "ids", F.sha2("text", 256).alias("text_sha256"))
