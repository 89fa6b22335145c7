"""Jaccard join of shingle sets by signature trees.

A set's signature is a bitmap of its hashed shingles. A tree's nodes hold the OR of the bitmaps
below them, the range of their sizes, and how many shingles at most share a bit with
another of their set. Two trees are walked together: a pair of nodes is left out when not even the
bits both have, and those shared ones, make the overlap that two sets of such sizes need. What
is left at the end is compared on the full sets.

Trees stand on groups of sets that Spark deals. Of n shingles, the first n - ceil(n * percent / 100) + 1
in the order of their hashes hold one that a linked set holds there too, so linked sets meet in the
group of such a shingle. First every set is in the groups of a few of its shared shingles only,
the least ones in HOMES orders; links found there make components. Then the trees of all groups that still hold several components
are walked, and pairs of nodes within one component are left out. So a group of
thousands of near copies is not expanded into its pairs, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careledger.llm.components import components
from careledger.llm.minhash import shingles
from careledger.llm.shared import cut, documents_of

#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Orders of shingles in the first step. They change where links are found, not which.
HOMES = 3
#: Children of a node, and sets in a part of a group.
FAN, GROUP = 8, 2048
#: Bits of a signature: four for each shingle, rounded up to a power of two between these.
LEAST_BITS, MOST_BITS = 256, 1 << 16
#: Words of bitmaps that are compared at a time.
_WORDS = 1 << 20


def probed(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """Shingles of a set's head, one of which is in the head of each linked set, and of its longer head.

    Linked sets lack at most (head - 1) of a set's shingles, so of the longer head all but so many are
    shared with others.
    """
    head = n - -(-n * percent // 100) + 1
    return head, min(n, head + head // 2)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The bitmap of a set, as 64-bit words."""
    bits = min(max(LEAST_BITS, 1 << int(4 * len(hashes) - 1).bit_length()), MOST_BITS)
    at = (hashes ^ (hashes >> np.uint64(32))) & np.uint64(bits - 1)
    marked = np.zeros(bits, bool)
    marked[at] = True
    return np.packbits(marked, bitorder="little").view(np.uint64)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


@dataclass
class Level:
    """Nodes of one level; on the lowest, ``row`` has the number of each set."""

    bits: np.ndarray
    least: np.ndarray
    most: np.ndarray
    doubled: np.ndarray
    low: np.ndarray
    high: np.ndarray
    row: np.ndarray | None = None


def tree(bits: np.ndarray, sizes: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> list[Level]:
    """The levels of a tree, sets first. Sets alike in size and first bits are close to each other."""
    band = (np.log(sizes) / np.log(1.25)).astype(np.int64)
    order = np.lexsort((*(bits[:, k] for k in range(min(4, bits.shape[1]) - 1, -1, -1)), band))
    bits, sizes, labels, rows = bits[order], sizes[order], labels[order], rows[order]
    doubled = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    levels = [Level(bits, sizes, sizes, doubled, labels, labels, rows)]
    while len(levels[-1].least) > FAN:
        below = levels[-1]
        starts = np.arange(0, len(below.least), FAN)
        levels.append(
            Level(
                np.bitwise_or.reduceat(below.bits, starts, axis=0),
                np.minimum.reduceat(below.least, starts),
                np.maximum.reduceat(below.most, starts),
                np.maximum.reduceat(below.doubled, starts),
                np.minimum.reduceat(below.low, starts),
                np.maximum.reduceat(below.high, starts),
            )
        )
    return levels


def _open(a: Level, b: Level, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets below nodes i and j can be linked and are not yet in one component."""
    keep = ~((a.low[i] == a.high[i]) & (b.low[j] == b.high[j]) & (a.low[i] == b.low[j]))
    keep &= (100 * a.most[i] >= percent * b.least[j]) & (100 * b.most[j] >= percent * a.least[i])
    at = np.flatnonzero(keep)
    i, j = i[at], j[at]
    most = np.bitwise_count(a.bits[i] & b.bits[j]).sum(axis=1, dtype=np.int64) + np.minimum(a.doubled[i], b.doubled[j])
    most = np.minimum(most, np.minimum(a.most[i], b.most[j]))
    keep[at] = (100 + percent) * most >= percent * (a.least[i] + b.least[j])
    return keep


def walk(
    one: list[Level], other: list[Level], same: bool, percent: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the sets that can be linked, from walking two trees together; each pair once."""
    top = max(len(one), len(other)) - 1

    def level(tree_: list[Level], k: int) -> Level:
        return tree_[min(k, len(tree_) - 1)]

    i, j = (x.ravel() for x in np.meshgrid(*(np.arange(len(t[-1].least)) for t in (one, other)), indexing="ij"))
    stack = [(top, i, j)]
    while stack:
        k, i, j = stack.pop()
        a, b = level(one, k), level(other, k)
        slice_ = max(64, _WORDS // a.bits.shape[1])
        if len(i) > slice_:
            stack += [(k, i[s : s + slice_], j[s : s + slice_]) for s in range(0, len(i), slice_)]
            continue
        if same:
            keep = i <= j if k else i < j
            i, j = i[keep], j[keep]
        keep = _open(a, b, i, j, percent)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if not k:
            yield a.row[i], b.row[j]
            continue
        for side, levels in ((0, one), (1, other)):
            if k < len(levels):  # else this tree is lower and waits
                grown = (np.repeat(x, FAN) for x in (i, j))
                child = np.tile(np.arange(FAN), len(i))
                i, j = grown
                if side:
                    j = j * FAN + child
                else:
                    i = i * FAN + child
                keep = (j if side else i) < len(levels[k - 1].least)
                i, j = i[keep], j[keep]
        stack.append((k - 1, i, j))


def candidates(
    bits: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, percent: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the pairs of sets that the trees leave; one tree for each length of bitmaps.

    Linked sets have bitmaps of the same length or of double length, which are folded.
    """
    lengths = np.array([len(b) for b in bits])
    made = {}
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        made[length] = rows, np.stack([bits[r] for r in rows])
    for length, (rows, own) in made.items():
        here = tree(own, sizes[rows], labels[rows], rows)
        yield from walk(here, here, True, percent)
        if 2 * length in made:
            rows, double = made[2 * length]
            folded = double[:, :length] | double[:, length:]
            yield from walk(here, tree(folded, sizes[rows], labels[rows], rows), False, percent)


def _spanning(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what all links among the sets connect."""
    root = np.arange(len(sets))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []

    def meet(i: int, j: int) -> None:
        p, q = find(i), find(j)
        if p != q and _linked(sets[i], sets[j], percent):
            root[max(p, q)] = min(p, q)
            links.append((i, j))

    # Neighbours in order of size first, so that most near copies are one component before the walk.
    bits, sizes = [signature(s) for s in sets], np.array([len(s) for s in sets])
    order = sorted(range(len(sets)), key=lambda i: (len(bits[i]), bits[i].tobytes()))
    for i, j in zip(order, order[1:], strict=False):
        meet(i, j)
    by_size = np.argsort(sizes, kind="stable").tolist()
    for i, j in zip(by_size, by_size[1:], strict=False):
        meet(i, j)
    labels = np.array([find(i) for i in range(len(sets))])
    for i, j in candidates(bits, sizes, labels, percent):
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            meet(p, q)
    return links


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _summed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    key = TaskContext.get().partitionId() << 40
    for batch in batches:
        found = [shingles(text.as_py()) for text in batch.column("text")]
        heads = [probed(len(s), percent) for s in found]
        tokens = [s[: q if len(s) else 0].view(np.int64) for s, (_, q) in zip(found, heads, strict=True)]
        lists = pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *map(len, tokens)], dtype=np.int32)),
            pa.array(np.concatenate(tokens) if tokens else np.empty(0, np.int64)),
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(key, key + batch.num_rows)),
                batch.column("doc_id"),
                pa.array([_digest(s) for s in found], pa.binary()),
                pa.array([len(s) for s in found], pa.int64()),
                pa.array([p for p, _ in heads], pa.int64()),
                pa.array([q - p + 1 for p, q in heads], pa.int64()),
                lists,
            ],
            ["key", "doc_id", "digest", "n_shingles", "head", "enough", "tokens"],
        )
        key += batch.num_rows


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows with a wanted digest those whose text has it, with their bitmap."""
    for batch in batches:
        keep, bits = [], []
        for i, (want, text) in enumerate(zip(batch.column("digest"), batch.column("text"), strict=True)):
            own = shingles(text.as_py())
            if _digest(own) == want.as_py():
                keep.append(i)
                bits.append(signature(own).tobytes())
        kept = batch.select(["digest", "n_shingles", "text"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(bits, pa.binary())], [*kept.schema.names, "bits"])


def _within(rows: pa.Table, percent: int) -> pa.Table:
    """(home, part, a, b): links inside a part of a group, and its first set with itself."""
    digests = rows.column("digest").to_pylist()
    links = _spanning([shingles(t.as_py()) for t in rows.column("text")], percent)
    pairs = [(digests[i], digests[j]) for i, j in links]
    # Of the sets that have most links: the one that stands for this part further on.
    times = np.bincount(np.array(links, np.int64).ravel(), minlength=len(digests))
    first = max(range(len(digests)), key=lambda i: (times[i], digests[i]))
    pairs.append((digests[first], digests[first]))
    home, part = (pa.array([rows.column(c)[0].as_py()] * len(pairs), pa.int64()) for c in ("home", "part"))
    a, b = (pa.array(x, pa.binary()) for x in zip(*pairs, strict=True))
    return pa.table([home, part, a, b], ["home", "part", "a", "b"])


def _between(rows: pa.Table, percent: int) -> pa.Table:
    """(a, b): pairs of sets of different components that the trees of a group leave."""
    digests = rows.column("digest").to_pylist()
    labels = np.unique(np.array([x.hex() for x in rows.column("label").to_pylist()]), return_inverse=True)[1]
    bits = [np.frombuffer(b.as_buffer(), np.uint64) for b in rows.column("bits")]
    before = [frozenset(x) for x in rows.column("before").to_pylist()]
    part = rows.column("own").to_numpy()
    single = len(rows) and rows.column("i")[0] == rows.column("j")[0]
    a, b = [], []
    for i, j in candidates(bits, rows.column("n_shingles").to_numpy(), labels, percent):
        apart = (labels[i] != labels[j]) & (single | (part[i] != part[j]))
        at = np.flatnonzero(apart)
        met = [not before[p].isdisjoint(before[q]) for p, q in zip(i[at].tolist(), j[at].tolist(), strict=True)]
        apart[at[np.array(met, bool)]] = False
        a += [digests[k] for k in i[apart].tolist()]
        b += [digests[k] for k in j[apart].tolist()]
    return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = zip(batch.column("text_a"), batch.column("text_b"), strict=True)
        keep = [i for i, (a, b) in enumerate(both) if _linked(shingles(a.as_py()), shingles(b.as_py()), percent)]
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _parts(count: Column) -> Column:
    return F.ceil(count / F.lit(GROUP)).cast("long")


def _grouped_links(classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b): links among the sets with the same least shared shingle in some order, found in parts of groups.

    Each part then sends one set on, until a group is one part.
    """
    least = [
        F.expr(f"array_min(transform(tokens, t -> named_struct('h', xxhash64({seed}, t), 'token', t)))")
        for seed in range(HOMES)
    ]
    homes = classes.select("digest", F.explode(F.array_distinct(F.array(*[x["token"] for x in least]))).alias("home"))
    sizes = homes.groupBy("home").count().filter("count > 1")
    parted = cut(
        homes.join(sizes, "home")
        .withColumn("part", F.pmod(F.xxhash64("digest"), _parts(F.col("count"))))
        .select("home", "part", "digest"),
        "homes",
    )
    out = None
    most = parted.agg(F.max("part")).first()[0]
    while most is not None:
        found = cut(
            parted.join(texts, "digest")
            .select("home", "part", "digest", "text")
            .groupBy("home", "part")
            .applyInArrow(lambda rows: _within(rows, percent), "home long, part long, a binary, b binary"),
            "within",
        )
        links = found.filter("a != b").select("a", "b")
        out = links if out is None else out.union(links)
        if most == 0:
            break
        parted = found.filter("a = b").select("home", F.floor(F.col("part") / GROUP).alias("part"), F.col("a").alias("digest"))
        several = parted.groupBy("home").count().filter("count > 1").select("home")
        parted, most = parted.join(several, "home", "left_semi"), most // GROUP
    return out if out is not None else classes.select(F.col("digest").alias("a"), F.col("digest").alias("b")).limit(0)


def _open_pairs(classes: DataFrame, labels: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs from different components that may be linked."""
    label = F.coalesce("component", "digest").alias("label")
    named = classes.join(labels, classes["digest"] == labels["node"], "left").select("digest", "tokens", label)
    members = cut(named.select(F.explode("tokens").alias("token"), "digest", "label"), "members")
    same = [F.sum(F.xxhash64(F.lit(seed), "digest").cast("decimal(38,0)")).alias(f"sum{seed}") for seed in (1, 2)]
    mixed = (
        members.groupBy("token")
        .agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("count"), *same)
        .filter("lo < hi")
    )
    # Shingles of the same sets make the same group; one of them is enough.
    groups = mixed.groupBy("count", "sum1", "sum2").agg(F.min("token").alias("token"))
    open_ = members.join(groups.select("token", _parts(F.col("count")).alias("parts")), "token")
    own = open_.groupBy("digest", "label").agg(F.sort_array(F.collect_set(F.struct("token", "parts"))).alias("all"))
    rows = (
        own.join(texts.select("digest", "n_shingles", "bits"), "digest")
        .select("digest", "label", "n_shingles", "bits", "all.token", F.posexplode("all").alias("place", "group"))
        # Two sets are compared in the first group that has both.
        .withColumn("before", F.expr("slice(token, 1, place)"))
        .withColumn("own", F.pmod(F.xxhash64("digest"), F.col("group.parts")))
        # Parts of a large group meet two by two.
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("group.parts").cast("int") - 1)))
        .select(
            F.col("group.token").alias("token"),
            F.least("own", "with").alias("i"),
            F.greatest("own", "with").alias("j"),
            "own",
            "digest",
            "label",
            "n_shingles",
            "bits",
            "before",
        )
    )
    pairs = rows.groupBy("token", "i", "j").applyInArrow(lambda rows: _between(rows, percent), "a binary, b binary")
    return pairs


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    right = pairs.join(texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(partial(_near, percent=percent), "a binary, b binary")


def jaccard_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    The component is the least doc_id that links lead to. Equal sets are one class, whatever
    their doc_ids, so a doc_id that repeats with another text joins the classes of both only if
    they are linked; each row follows its own text. A null text counts as empty; texts without words
    are linked with nothing, also not with their copies. Rows without a doc_id are linked with
    nothing and have no component. Other columns are not read; an empty table gives no rows.
    """
    rows = documents_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = "key long, doc_id long, digest binary, n_shingles long, head long, enough long, tokens array<long>"
    # Written, as the numbers of rows must stay the same.
    sets = cut(rows.mapInArrow(partial(_summed, percent=percent), schema), "sets")
    linkable = sets.filter("doc_id is not null and n_shingles > 0")

    # Sets with enough shingles in their longer head that another row has there.
    probes = linkable.select("key", "head", F.posexplode("tokens").alias("place", "token")).select(
        "key", "token", (F.col("place") < F.col("head")).alias("front")
    )
    shared = probes.withColumn("rows", F.count("*").over(Window.partitionBy("token"))).filter("rows > 1")
    kept = (
        shared.groupBy("key")
        .agg(
            F.count("*").alias("hits"),
            F.sort_array(F.collect_set(F.when(F.col("front"), F.col("token")))).alias("tokens"),
        )
        .filter("size(tokens) > 0")
    )
    classes = cut(
        linkable.select("key", "doc_id", "digest", "n_shingles", "enough")
        .join(kept, "key")
        .filter("hits >= enough")
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", "n_shingles", "tokens")).alias("one"))
        .select("digest", "one.doc_id", "one.n_shingles", "one.tokens"),
        "classes",
    )
    wanted = classes.select("doc_id", "digest", "n_shingles")
    texts = cut(
        rows.join(wanted, "doc_id")
        .select("digest", "n_shingles", "text")
        .mapInArrow(_signed, "digest binary, n_shingles long, text binary, bits binary")
        .dropDuplicates(["digest"]),
        "texts",
    )
    links = cut(_grouped_links(classes, texts, percent), "links")
    further = cut(_verified(_open_pairs(classes, components(links, "a", "b"), texts, percent), texts, percent), "links")
    found = components(links.union(further), "a", "b")

    own = sets.select("doc_id", "digest", "n_shingles").join(found, sets["digest"] == found["node"], "left")
    # Rows without words or id stand alone; copies of a set share its component.
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    placed = own.select("doc_id", "n_shingles", F.when(~alone, F.coalesce("component", "digest")).alias("root"))
    least = placed.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")
    )
