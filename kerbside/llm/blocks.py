"""Near-duplicate candidates through blocks of shared shingles.

Two sets of a Jaccard similarity of t or more have at least t of the larger one
in common.  In whatever one order all shingles stand, the first that both have
is then among the first n - ceil(t * n) + 1 of each (n its size).  These are a
set's keys; the sets that hold a key are its block, and every such pair shares
a block.  Work grows with the keys, not with the pairs of all sets.

Rare shingles come first in the order, so that a line which very many texts
have makes no large block.  The order is fitted on some FITTED texts (common
shingles, by rising frequency, stand behind all others); it decides how large
blocks are, never which pairs are found: every text is dealt by all its keys.
A block that is large all the same is cut in pieces that meet two at a time.

Within a block, pairs of fitting sizes link if their fingerprints are within
the radius.  A task hands on a spanning forest of the links in all its blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import materialise

#: Texts on which the order is fitted, how often a shingle occurs there to be common, and common ones that are told apart.
FITTED, COMMON, TOLD = 20_000, 8, 500_000
#: Key rows (32 bytes each) of a task, and parts that a task works through one after the other.
KEYED, PARTS = 500_000, 4
#: Texts whose rows a task packs at once.
TOGETHER = 1_000
#: Blocks up to SMALL rows are compared all at once; those over PIECE rows are cut.
SMALL, PIECE = 64, 16_384
#: Links that are held before they give way to their forest.
HELD = 2_000_000
LOW = np.uint64(0xFFFFFFFF)


def forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of stars that connect what the pairs (a, b) of places connect."""
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), TOGETHER):
            yield batch.slice(at, TOGETHER)


def packed(part: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (part, data), one for each part."""
    order = np.argsort(part, kind="stable")
    parts, begin = np.unique(part[order], return_index=True)
    data = [x.tobytes() for x in np.split(rows[order], begin[1:])] if len(parts) else []
    yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int64)), pa.array(data, pa.binary())], ["part", "data"])


def unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """What ``packed`` has made, gathered by part; nothing is copied before its part's turn."""
    parts = {}
    for batch in batches:
        for part, data in zip(batch.column("part").to_pylist(), batch.column("data")):
            parts.setdefault(part, []).append(np.frombuffer(data.as_buffer(), dtype=np.uint64).reshape(-1, width))
    while parts:
        part, rows = parts.popitem()
        yield part, np.concatenate(rows)


class Order:
    """Of shingles: by hash, the common ones last, by rising frequency."""

    def __init__(self, common: np.ndarray, similarity: float):
        self.similarity = similarity
        self.rank = np.argsort(common, kind="stable")
        self.common = common[self.rank]

    def keys(self, h: np.ndarray) -> np.ndarray:
        """The keys of a set of ascending hashes."""
        n = len(h) and len(h) - math.ceil(self.similarity * len(h) - 1e-9) + 1
        if not n or not len(self.common):
            return h[:n]
        at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
        known = self.common[at] == h
        rare = h[~known][:n]
        last = at[known]
        return np.concatenate([rare, self.common[last[np.argsort(self.rank[last])[: n - len(rare)]]]])


def fitted_order(docs: DataFrame, hashed: Callable[[str | None], np.ndarray], similarity: float) -> Order:
    """The order for ``docs``; ``hashed`` gives a text's distinct hashes."""

    def dealt(batches):
        for batch in slices(batches):
            h = np.concatenate([*map(hashed, batch.column("text").to_pylist()), np.zeros(0, dtype=np.uint64)])
            yield from packed(h % np.uint64(64), h)

    least = COMMON

    def counted(batches):
        for _, h in unpacked(batches, 1):
            key, n = np.unique(h, return_counts=True)
            often = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(key[often].view(np.int64)), pa.array(n[often])], ["key", "n"])

    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(max(1, docs.count() // FITTED))) == 0)
    found = some.mapInArrow(dealt, "part long, data binary").repartition(64, "part").mapInArrow(counted, "key long, n long")
    # some MB at most, whatever the size of the input
    common = found.orderBy(F.desc("n"), "key").limit(TOLD).toArrow()
    return Order(common.column("key").to_numpy().view(np.uint64)[::-1], similarity)


def fitting(rows: np.ndarray, x, y, words: int, radius: int) -> np.ndarray:
    """Whether the fingerprints of the places x and y are within the radius."""
    return sum(np.bitwise_count(rows[x, 2 + w] ^ rows[y, 2 + w]).astype(np.int64) for w in range(words)) <= radius


def met(rows: np.ndarray, words: int, radius: int, similarity: float, listed: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yield links (a, b, n) of the blocks of rows (key and size, node, w0, ..) in order: all, or as many as connect what they connect.

    n adds up to the number of links, near enough: a link is found under each key that both sets have.
    """
    size = (rows[:, 0] & LOW).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], rows[1:, 0] >> np.uint64(32) != rows[:-1, 0] >> np.uint64(32)]))
    count = np.diff(np.concatenate([begin, [len(rows)]]))
    each = 1 / np.maximum(1, (1 - similarity) * size)
    end = np.repeat(begin + count, count)
    x = np.flatnonzero(np.repeat(count <= SMALL, count))
    for d in range(1, SMALL):
        x = x[x + d < end[x]]
        x = x[size[x] >= similarity * size[x + d] * (1 - 1e-9)]  # sizes ascend in a block
        if not len(x):
            break
        near = x[fitting(rows, x, x + d, words, radius)]
        yield rows[near, 1], rows[near + d, 1], each[near]
    for at, n in zip(begin[count > SMALL].tolist(), count[count > SMALL].tolist()):
        left = np.arange(at + (not listed), at + n)  # in order, so by size
        queue, counted = [at], listed
        while len(left):
            if listed:
                x, left = left[0], left[1:]
            else:
                if not queue:
                    queue, left = [int(left[0])], left[1:]
                x = queue.pop()
            fits = slice(*np.searchsorted(size[left], [similarity * size[x] * (1 - 1e-9), size[x] / similarity * (1 + 1e-9)]))
            is_near = fitting(rows, x, left[fits], words, radius)
            near = left[fits][is_near]
            if len(near):
                yield np.repeat(rows[x, 1], len(near)), rows[near, 1], np.repeat(each[x] * (1 if counted else n / 2), len(near))
            counted = True
            if not listed and len(near):
                queue += near.tolist()
                left = np.concatenate([left[: fits.start], left[fits][~is_near], left[fits.stop :]])


def tree(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of links; a tree's first edge has the number of its links."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    child, root = forest(np.arange(len(nodes)), place[: len(a)], place[len(a) :])
    top = np.arange(len(nodes))
    top[child] = root
    per = np.bincount(top[place[: len(a)]], weights=n, minlength=len(nodes))
    first, at = np.unique(root, return_index=True)
    number = np.zeros(len(child))
    number[at] = per[first]
    return nodes[child], nodes[root], number


def gathered(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], listed: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All links, each once in a while, or a forest of them."""
    held, n = [], 0
    for x in found:
        held.append(x)
        n += len(x[0])
        if n > HELD:
            less = [np.concatenate(y) for y in zip(*held)]
            if listed:
                yield less
                held, n = [], 0
            else:
                held, n = [tree(*less)], 0
    if held:
        less = [np.concatenate(y) for y in zip(*held)]
        yield less if listed else tree(*less)


def links(keyed: DataFrame, words: int, radius: int, similarity: float, listed: bool = False) -> DataFrame:
    """Edges (a, b, n) from rows (node, size, keys, w0, ..): what links within the radius in some block is connected, n adds up to some number of links.

    If listed, every link is there once.
    """
    names, width = [f"w{i}" for i in range(words)], 2 + words
    total = keyed.agg(F.sum(F.lit(1 - similarity) * F.col("size") + 1)).first()[0] or 0
    tasks = max(1, int(total) // KEYED)
    parts = np.uint64(tasks * PARTS)

    def dealt(batches):
        for batch in slices(batches):
            _, one = np.unique(batch.column("node").to_numpy(), return_index=True)
            batch = batch.take(pa.array(one))
            keys = [np.frombuffer(x, dtype=np.uint64) for x in batch.column("keys").to_pylist()]
            own = np.stack([batch.column(x).to_numpy().astype(np.int64).view(np.uint64) for x in ("size", "node", *names)], axis=1)
            rows = np.repeat(own, [len(x) for x in keys], axis=0)
            key = np.concatenate([*keys, np.zeros(0, dtype=np.uint64)])
            rows[:, 0] |= (key & LOW) << np.uint64(32)
            yield from packed((key >> np.uint64(32)) % parts, rows)

    def batch_of(a, b, n):
        return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64)), "n": pa.array(n)} | {x: pa.nulls(len(a), t) for x, t in kinds.items()})

    most = PIECE
    kinds = {"block": pa.int64(), "piece": pa.int64(), "pieces": pa.int64(), "data": pa.binary()}
    large = []

    def blocks(batches):
        for part, rows in unpacked(batches, width):
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            same = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1])
            rows = rows[np.concatenate([[True], ~same])]  # copies of a text
            _, at, count = np.unique(rows[:, 0] >> np.uint64(32), return_index=True, return_counts=True)
            for i, n in zip(at[count > most].tolist(), count[count > most].tolist()):
                large.append((part << 32 | int(rows[i, 0] >> np.uint64(32)), rows[i : i + n]))
            yield from met(rows[np.repeat((count > 1) & (count <= most), count)], words, radius, similarity, listed)

    def search(batches):
        large.clear()
        for x in gathered(blocks(batches), listed):
            yield batch_of(*x)
        for block, rows in large:
            pieces = -(-len(rows) // most)
            for i in range(pieces):
                yield pa.RecordBatch.from_pydict({"a": pa.nulls(1, pa.int64()), "b": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.float64())} | {k: pa.array([v], kinds[k]) for k, v in zip(kinds, (block, i, pieces, rows[i::pieces].tobytes()))})

    def search_two(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, dtype=np.uint64).reshape(-1, width) for x in table.column("data").to_pylist()])
        found = list(gathered(met(rows[np.lexsort((rows[:, 1], rows[:, 0]))], words, radius, similarity, listed), listed))
        a, b, n = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0))
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64)), "n": pa.array(n)})

    rows = keyed.select("node", "size", "keys", *names).mapInArrow(dealt, "part long, data binary").repartition(tasks, "part")
    found = materialise(rows.mapInArrow(search, "a long, b long, n double, block long, piece long, pieces long, data binary"))
    near, cut = found.where("block is null").select("a", "b", "n"), found.where("block is not null")
    if cut.count():
        cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).where("piece <> other")
        cells = cells.select("block", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "data")
        near = near.unionByName(materialise(cells.groupBy("block", "i", "j").applyInArrow(search_two, "a long, b long, n double")))
    if listed:
        near = near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.first("n").alias("n"))
    return near
