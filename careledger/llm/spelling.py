"""Spelling variants of the corpus' words, by k-d trees over letter counts.

One inserted, deleted or replaced letter moves a word's vector of letter counts by at most
two (L1): a replacement lowers one count and raises one, an insertion only raises one. So for each
pair of word lengths, the near words of a word lie in a tiny box around its vector. Every
length has a k-d tree. Its upper part, cut from a bounded sample of words, deals the words to
cells; a word is sent to each cell that its box reaches, and the cell's own tree is
searched there. What the boxes let through is compared letter by letter.

The sample decides only where cells are cut. Every word is indexed and searched, and a cell that
gets too many words is cut by a hash, with its searches sent to all parts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careledger.llm.shared import cut, documents_of

#: Words have so many code points at least, and stand so often in the corpus.
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: A form is at least so many times as frequent as its variant.
FORM_FACTOR = 2
#: One run in so many loses a letter, by a hash of its document and itself.
TYPO_EVERY = 97
#: Words that the cuts of cells are fitted on, words of a cell, and words of a leaf in a cell.
SAMPLE, CELL, LEAF = 100_000, 16_384, 16
#: Counts: one for each of a-z, and six that all other letters share.
LETTERS = 32
#: Different words that a task counts before it passes its counts on.
_COUNTED = 400_000
#: Pairs that are compared letter by letter at a time.
_PAIRS = 1 << 20
#: Queries that search a cell at a time.
_QUERIES = 1 << 15

# In UTF-8, U+00C0 to U+00FF are the byte C3 and one more.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_PLACE = np.array([p - 97 if 97 <= p <= 122 else 26 + p % 6 for p in range(256)])

#: A node is (axis, most, left, right), where left has counts up to ``most``; or the rows or number of a leaf.
Node = tuple | np.ndarray | int


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n: the runs of letters of all texts, typos put in, that are long and frequent enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def counted() -> pa.RecordBatch:
            kept = [(w, n) for w, n in counts.items() if n and len(w) >= LEAST_LETTERS]
            words = pa.array([w for w, _ in kept], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                runs = _RUN.findall(text.as_py().lower())
                counts.update(runs)
                start = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
                start = zlib.crc32(b":", start)
                hit = [w for w in set(runs) if zlib.crc32(w, start) % TYPO_EVERY == 0]
                if hit:
                    own = Counter(runs)
                    for w in hit:
                        letters = w.decode()
                        k = zlib.crc32(w, start) % len(letters)
                        counts[w] -= own[w]
                        counts[(letters[:k] + letters[k + 1 :]).encode()] += own[w]
                if len(counts) > _COUNTED:
                    yield counted()
                    counts.clear()
        yield counted()

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return (
        rows.mapInArrow(count, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .filter((F.col("n") >= LEAST_COUNT) & (F.char_length("word") >= LEAST_LETTERS))
    )


def letters_of(words: list[bytes]) -> np.ndarray:
    """Latin-1 words of one length as rows of code points."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def vectors(letters: np.ndarray) -> np.ndarray:
    """The letter counts of each row."""
    found, rows = np.zeros((len(letters), LETTERS), np.int16), np.arange(len(letters))
    for column in _PLACE[letters].T:
        found[rows, column] += 1
    return found


def build(x: np.ndarray, most: int) -> Node:
    """A k-d tree of the rows of ``x`` with leaves of at most ``most`` rows, but for equal ones."""

    def node(rows: np.ndarray) -> Node:
        if len(rows) <= most:
            return rows
        own = x[rows]
        best = (0, 0, 0)
        for cut_at in {int(v) for v in np.percentile(own, (35, 50, 65), axis=0).ravel()} | {0}:
            low = (own <= cut_at).sum(axis=0)
            even = np.minimum(low, len(rows) - low)
            axis = int(even.argmax())
            best = max(best, (int(even[axis]), axis, cut_at))
        even, axis, cut_at = best
        if not even:
            return rows
        low = own[:, axis] <= cut_at
        return axis, cut_at, node(rows[low]), node(rows[~low])

    return node(np.arange(len(x)))


def numbered(node: Node, start: int = 0) -> tuple[Node, int]:
    """The tree with its leaves numbered from ``start`` on, and the next number."""
    if not isinstance(node, tuple):
        return start, start + 1
    left, middle = numbered(node[2], start)
    right, end = numbered(node[3], middle)
    return (node[0], node[1], left, right), end


def search(tree: Node, q: np.ndarray, more: int, fewer: int, found: Callable[[Node, np.ndarray], None]) -> None:
    """Calls ``found`` with each leaf and the queries whose box meets its region.

    The box of a query holds what has at most ``more`` letters that the query lacks, and lacks
    at most ``fewer`` of its letters.
    """
    low, high = np.zeros(LETTERS, np.int16), np.full(LETTERS, np.iinfo(np.int16).max, np.int16)

    def visit(node: Node, at: np.ndarray, up: np.ndarray, down: np.ndarray) -> None:
        if not len(at):
            return
        if not isinstance(node, tuple):
            found(node, at)
            return
        axis, most, left, right = node
        own = q[at, axis]
        before = high[axis]
        below = down - np.maximum(own - before, 0) + np.maximum(own - min(most, before), 0)
        keep = below <= fewer
        high[axis] = min(most, before)
        visit(left, at[keep], up[keep], below[keep])
        high[axis] = before
        before = low[axis]
        above = up - np.maximum(before - own, 0) + np.maximum(max(most + 1, before) - own, 0)
        keep = above <= more
        low[axis] = max(most + 1, before)
        visit(right, at[keep], above[keep], down[keep])
        low[axis] = before

    none = np.zeros(len(q), np.int16)
    visit(tree, np.arange(len(q)), none, none)


def _parities(x: np.ndarray) -> np.ndarray:
    return ((x & 1).astype(np.uint64) << np.arange(LETTERS, dtype=np.uint64)).sum(axis=1).astype(np.uint32)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether one edit makes row of ``b`` from row of ``a``; ``b`` is as long or one letter longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    n = a.shape[1]
    head = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= n


def near_pairs(index: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (query, index) of all words one edit apart, index words as long or one longer."""
    longer = index.shape[1] - queries.shape[1]
    x = vectors(index)
    tree, odd = build(x, LEAF), _parities(x)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, len(queries), _QUERIES):
        part = queries[start : start + _QUERIES]
        q = vectors(part)
        own = _parities(q)
        open_: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def verify(open_=open_, part=part, start=start) -> None:
            if open_:
                a, b = (np.concatenate(x) for x in zip(*open_, strict=True))
                keep = one_edit(part[a], index[b])
                out.append((a[keep] + start, b[keep]))
                open_.clear()

        def found(leaf: np.ndarray, at: np.ndarray, own=own, open_=open_, verify=verify) -> None:
            nonlocal size
            # One edit changes whether a count is odd for two letters at most.
            i, j = np.nonzero(np.bitwise_count(own[at][:, None] ^ odd[leaf][None, :]) <= 2 - longer)
            open_.append((at[i], leaf[j]))
            size += len(i)
            if size > _PAIRS:
                verify()
                size = 0

        search(tree, q, 1, 1 - longer, found)
        verify()
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _cells(words: DataFrame, cell: int, sample: int) -> dict[int, Node]:
    """The upper tree of each length with more than ``cell`` words, fitted on a bounded sample."""
    sizes = {r[0]: r[1] for r in words.groupBy(F.char_length("word")).count().collect()}
    every = max(1, sum(sizes.values()) // sample)
    by_length: dict[int, list[bytes]] = {}
    if max(sizes.values(), default=0) > cell:
        for r in words.filter(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select("word").collect():
            by_length.setdefault(len(r[0]), []).append(r[0].encode("latin-1"))
    trees: dict[int, Node] = dict.fromkeys(sizes, 0)
    for length, own in by_length.items():
        if sizes[length] > cell:
            most = max(LEAF, cell * len(own) // sizes[length])
            trees[length] = numbered(build(vectors(letters_of(sorted(own))), most))[0]
    return trees


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield length, rows, [words[i] for i in rows]


def _places(x: np.ndarray, tree: Node, more: int, fewer: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of each cell that a row's box meets."""
    rows, cells = [], []

    def found(cell: int, at: np.ndarray) -> None:
        rows.append(at)
        cells.append(np.full(len(at), cell))

    search(tree, x, more, fewer, found)
    return np.concatenate(rows), np.concatenate(cells)


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """word, near (count of its near words), best: (-n, word) of the most frequent of them.

    Words without near words have no row.
    """
    trees = _cells(words, cell, sample)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, own in _by_length(batch):
                _, cells = _places(vectors(letters_of(own)), trees[length], 0, 0)
                yield pa.RecordBatch.from_arrays([pa.array(length << 32 | cells)], ["place"])

    # How many parts a cell has. Cells are as many as the sample makes, however many words there are.
    loads = words.mapInArrow(homes, "place long").groupBy("place").count().filter(F.col("count") > 4 * cell)
    parts = {r["place"]: -(-r["count"] // (2 * cell)) for r in loads.collect()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, rows, own in _by_length(batch):
                x = vectors(letters_of(own))
                for role, there in ((0, length), (1, length), (2, length + 1)):
                    if there not in trees:
                        continue
                    at, cells = _places(x, trees[there], min(role, 1), int(role == 1))
                    place = there << 32 | cells
                    split = [i for i, p in enumerate(place.tolist()) if p in parts] if parts else []
                    part = np.zeros(len(at), np.int64)
                    if split and not role:
                        for i in split:
                            part[i] = zlib.crc32(own[at[i]]) % parts[int(place[i])]
                    elif split:
                        many = np.ones(len(at), np.int64)
                        many[split] = [parts[int(place[i])] for i in split]
                        at, place = np.repeat(at, many), np.repeat(place, many)
                        part = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                    taken = pa.array(rows[at])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(place),
                            pa.array(part),
                            pa.array(np.full(len(at), role, np.int32)),
                            batch.column("word").take(taken),
                            batch.column("n").take(taken),
                        ],
                        ["place", "part", "role", "word", "n"],
                    )

    def compare(rows: pa.Table) -> pa.Table:
        role = rows.column("role").to_numpy()
        text = rows.column("word").to_pylist()
        n = rows.column("n").to_numpy()
        words = [w.encode("latin-1") for w in text]
        index = np.flatnonzero(role == 0)
        a, b = [], []
        for asked in (1, 2):
            queries = np.flatnonzero(role == asked)
            if len(index) and len(queries):
                q, i = near_pairs(letters_of([words[k] for k in index]), letters_of([words[k] for k in queries]))
                a.append(queries[q])
                b.append(index[i])
                if asked == 2:  # the longer word does not search for the shorter one
                    a.append(index[i])
                    b.append(queries[q])
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        order = np.lexsort((np.argsort(np.argsort(np.array(words)))[b], -n[b], a)) if len(a) else a
        a, b = a[order], b[order]
        word, first, many = np.unique(a, return_index=True, return_counts=True)
        best = b[first] if len(a) else a
        taken = rows.column("word").combine_chunks()
        return pa.table(
            [taken.take(pa.array(word)), pa.array(many.astype(np.int64)), pa.array(-n[best]), taken.take(pa.array(best))],
            ["word", "near", "less", "best"],
        )

    dealt = words.mapInArrow(deal, "place long, part long, role int, word string, n long")
    found = dealt.groupBy("place", "part").applyInArrow(compare, "word string, near long, less long, best string")
    return found.groupBy("word").agg(F.sum("near").alias("near"), F.min(F.struct("less", "best")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of (word, form) rows. Forms are more frequent each time, so no chain is a circle.

    Each round doubles the steps, so there are about as many as the logarithm of the longest chain.
    """
    state = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        state = cut(
            state.join(next_, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ),
            "roots",
        )
        if not state.filter("moved").limit(1).count():
            return state.select("word", "root")
        state = state.select("word", "root")


def spelling_variants(docs: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs`` that is long and frequent enough.

    Null and empty texts have no words; a null doc_id counts as empty text in the hash that
    chooses typos. Repeated rows count as often as they stand. Ties among near words go to
    the smallest in code-point order. Other columns are not read; an empty table gives no rows.
    """
    words = cut(word_counts(documents_of(docs)), "words")
    near = near_words(words, cell, sample)
    own = cut(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
            F.when(-F.col("best.less") >= FORM_FACTOR * F.col("n"), F.col("best")).alias("form"),
        ),
        "near",
    ).select("word", "n", "n_near", F.col("form.best").alias("form"), (-F.col("form.less")).alias("form_n"))
    roots = _roots(own.filter("form is not null"))
    return own.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
