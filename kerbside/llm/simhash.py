"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are sorted by their Gray rank (neighbours in that order
share long bit patterns) and dealt by ranges into blocks.  A block is a tree:
each upper node holds the bits on which all below it agree, less those that
its own parents already hold, so a query adds up differences on its way down
and leaves a whole group as soon as it has too many.  The same test between
the roots of two blocks tells whether the blocks need to meet at all.

Fingerprints of several 64-bit words and larger radii use several tables, one
for each 16-bit part, rotated to the front: within the radius, some part
differs in at most (radius / parts) bits, and that part's table finds the pair.

A pair of blocks hands on a spanning forest of its links, never all pairs, and
the components are found by Spark.

Where a similarity is asked for, fingerprints only propose: each candidate link
is checked on the two texts' distinct shingles before it counts.  So wide a
radius lets a fixed share of all pairs through any such table, so there the
fingerprints meet in blocks of shared shingles (``blocks``), which no pair of
that similarity misses.  The nodes of a group so proposed then meet in sets of
some CHECKED nodes, two sets at a time, with their shingles: each task finds the
links within the radius anew, checks them, and hands on a forest of the good
ones, so pairs are never rows.  Only a large group of few links has these
listed.  Texts with the same distinct shingles are one node.

A text that is null or has no word has the
fingerprint zero, linked like any other; of repeated rows each has a result;
a null doc_id is never a component's id unless it has no other.  Other columns
are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm import blocks
from kerbside.llm.blocks import forest
from kerbside.llm.common import fresh, materialise, text_bytes
from kerbside.llm.components import components

#: Blocks of a table: this many at least (if they have FEWEST rows), and so many that none holds over MOST rows.
BLOCKS, FEWEST, MOST = 32, 256, 1_000_000
FANOUT = 16
#: Queries that go down a tree together, and nodes of a level that they look at together.
TOGETHER, EXPANDED = 2_048, 500_000
#: Nodes of a set whose candidate links are checked together.
CHECKED = 1_000
#: A large group's links are listed if its blocks have fewer than this share of the rows that its sets would take.
LISTED = 0.25
#: Groups whose ids may be broadcast (16 bytes each).
BROADCAST_GROUPS = 1_000_000
SEEDS = (42, 43)


def words_of(text: str | None) -> list[bytes]:
    return text_bytes(text).lower().split()  # bytes: A-Z, and the six white bytes


def shingles(text: str | None, shingle: int, distinct: bool = False) -> list[bytes]:
    ws = words_of(text)
    if not ws:
        return []
    whole = b" ".join(ws)
    sizes = np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)) + 1
    ends = np.cumsum(sizes)
    n = max(1, len(ws) - shingle + 1)
    begin, end = (ends - sizes)[:n].tolist(), (ends[min(shingle, len(ws)) - 1 :] - 1).tolist()
    parts = [whole[a:b] for a, b in zip(begin, end)]
    return list(set(parts)) if distinct else parts


def hashes(parts: list[bytes], seed: int) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(x, seed) for x in parts], dtype=np.uint64)


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3, seeds: tuple[int, ...] = (42,), distinct: bool = False) -> list[int]:
    """A 64-bit word for each seed."""
    parts = shingles(text, shingle, distinct)
    return [_majority(hashes(parts, seed)) for seed in seeds]


def fingerprints(docs: DataFrame, shingle: int = 3, seeds: tuple[int, ...] = (42,), distinct: bool = False, order: blocks.Order | None = None) -> DataFrame:
    """(doc_id, text_hash, node, w0, w1, ..) for each row; the node stands for the distinct shingles if these are asked for, or else for the words.

    With an order of shingles, which are distinct then, also how many they are and their keys in that order: (size, keys).
    """
    import xxhash

    names = [f"w{i}" for i in range(len(seeds))]
    more = [] if order is None else ["size", "keys"]

    def compute(batches):
        for batch in batches:
            got, sizes, keys = [], [], []
            for text in batch.column("text").to_pylist():
                parts = shingles(text, shingle, distinct)
                h = [hashes(parts, seed) for seed in seeds]
                words = [_majority(x) for x in h]
                one = np.unique(h[0]) if distinct else None
                got.append([xxhash.xxh64_intdigest(one.tobytes()) if distinct else 0, *words])
                if more:
                    sizes.append(len(one))
                    keys.append(order.keys(one).tobytes())
            rows = np.array(got, dtype=np.uint64).reshape(-1, 1 + len(seeds)).view(np.int64)
            cols = [batch.column("doc_id"), batch.column("text_hash"), *[pa.array(rows[:, i]) for i in range(1 + len(seeds))]]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())] if more else []), ["doc_id", "text_hash", "node", *names, *more])

    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, node long, " + ", ".join(f"{n} long" for n in names)
    got = docs.mapInArrow(compute, schema + (", size long, keys binary" if more else ""))
    return got if distinct else got.withColumn("node", F.col("w0") if len(seeds) == 1 else F.xxhash64(*names))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the Gray order."""
    x = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x if by == 0 else (x << np.uint64(by)) | (x >> np.uint64(64 - by))


class Tables:
    """Which words lead in which table, and how far a leading part may differ."""

    def __init__(self, words: int, radius: int):
        self.words, self.radius = words, radius
        if words == 1 and radius < 4:
            self.leads, self.mask, self.limit = [(0, 0)], np.uint64(0xFFFFFFFFFFFFFFFF), radius
        else:
            self.leads = [(w, by) for w in range(words) for by in (0, 16, 32, 48)]
            self.mask, self.limit = np.uint64(0xFFFF000000000000), radius // (4 * words)

    def keys(self, rows: np.ndarray, table: int) -> np.ndarray:
        """The leading words of rows (node, w0, w1, ..)."""
        w, by = self.leads[table]
        return rotated(rows[:, 1 + w], by)


def agreed(keys: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mask of the bits on which each group of keys agrees, and their pattern."""
    same = ~(np.bitwise_or.reduceat(keys, groups) ^ np.bitwise_and.reduceat(keys, groups))
    return same, keys[groups] & same


class Index:
    """The tree over the Gray-ordered rows of a block."""

    def __init__(self, rows: np.ndarray, tables: Tables, table: int):
        keys = tables.keys(rows, table)
        order = np.argsort(gray_rank(keys), kind="stable")
        self.rows, self.tables = rows[order], tables
        keys = keys[order]
        self.levels, step = [], FANOUT
        while True:  # from the leaves' groups up to a single root
            groups = np.arange(0, len(keys), step)
            mask, pattern = agreed(keys, groups)
            self.levels.insert(0, [mask & tables.mask, pattern & tables.mask])
            if step >= len(keys):
                break
            step *= FANOUT
        self.keys = keys
        for i in range(len(self.levels) - 1, 0, -1):  # what a parent holds is not held again
            held = np.repeat(self.levels[i - 1][0], FANOUT)[: len(self.levels[i][0])]
            self.levels[i] = [x & ~held for x in self.levels[i]]

    def near(self, rows: np.ndarray, keys: np.ndarray):
        """Yield (query, found) places of rows within the radius, in chunks."""
        t = self.tables
        for at in range(0, len(rows), TOGETHER):
            some = keys[at : at + TOGETHER]
            mask, pattern = (x[0] for x in self.levels[0])
            far = np.bitwise_count((some ^ pattern) & mask)
            q = np.flatnonzero(far <= t.limit)
            for a, b in self._down(some, q, np.zeros(len(q), dtype=np.int64), far[q], 1):
                far_all = sum(np.bitwise_count(rows[at + a, 1 + w] ^ self.rows[b, 1 + w]).astype(np.int64) for w in range(t.words)) if len(a) else np.zeros(0)
                keep = far_all <= t.radius
                yield at + a[keep], b[keep]

    def _down(self, keys: np.ndarray, q: np.ndarray, node: np.ndarray, far: np.ndarray, depth: int):
        """Yield (query, leaf) below these nodes, so many children at a time that a dense block takes no more memory than a sparse one."""
        for i in range(0, len(q), EXPANDED // FANOUT):
            some = slice(i, i + EXPANDED // FANOUT)
            a, below = np.repeat(q[some], FANOUT), (node[some, None] * FANOUT + np.arange(FANOUT)).ravel()
            there = below < len(self.keys if depth == len(self.levels) else self.levels[depth][0])
            a, below = a[there], below[there]
            if depth == len(self.levels):
                keep = np.bitwise_count((keys[a] ^ self.keys[below]) & self.tables.mask) <= self.tables.limit
                yield a[keep], below[keep]
                continue
            mask, pattern = self.levels[depth]
            f = np.repeat(far[some], FANOUT)[there] + np.bitwise_count((keys[a] ^ pattern[below]) & mask[below])
            keep = f <= self.tables.limit
            if keep.any():
                yield from self._down(keys, a[keep], below[keep], f[keep], depth + 1)


def linked(left: np.ndarray, right: np.ndarray | None, tables: Tables, table: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one block (right is None), or between two."""
    index = Index(left if right is None else right, tables, table)
    rows = index.rows if right is None else left
    shift = 0 if right is None else len(rows)
    nodes = index.rows[:, 0] if right is None else np.concatenate([rows[:, 0], index.rows[:, 0]])
    a, b, n = [], [], 0
    for x, y in index.near(rows, tables.keys(rows, table)):
        if right is None:
            x, y = x[x < y], y[x < y]
        a.append(x)
        b.append(y + shift)
        n += len(x)
        if n > 2_000_000:  # links so far give way to their forest
            a, b, n = *([z] for z in _shrunk(len(nodes), np.concatenate(a), np.concatenate(b))), 0
    if not a:
        return nodes[:0], nodes[:0]
    return forest(nodes, np.concatenate(a), np.concatenate(b))


def _shrunk(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return forest(np.arange(n), a, b)


def links(distinct: DataFrame, words: int, radius: int) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within the radius, from rows (node, w0, w1, ..)."""
    tables = Tables(words, radius)
    names = ["node", *[f"w{i}" for i in range(words)]]
    n = distinct.count()
    per = max(1, min(max(BLOCKS, -(-n // MOST)), n // FEWEST))
    m = len(tables.leads)

    def keyed(batches):
        for batch in batches:
            rows = np.stack([batch.column(x).to_numpy(zero_copy_only=False).view(np.uint64) for x in names], axis=1)
            for t in range(m):
                rank = (gray_rank(tables.keys(rows, t)) ^ np.uint64(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(rows), pa.int32()), pa.array(rank), *[batch.column(x) for x in names]], ["t", "rank", *names])

    def by_table(batches):
        parts = {}
        for batch in batches:
            rows = np.stack([batch.column(x).to_numpy(zero_copy_only=False).view(np.uint64) for x in names], axis=1)
            t = batch.column("t").to_numpy(zero_copy_only=False)
            for k in np.unique(t):
                parts.setdefault(int(k), []).append(rows[t == k])
        return {k: np.concatenate(x) for k, x in parts.items()}

    def edges(a, b):
        return {"a": pa.array(a.astype(np.uint64).view(np.int64)), "b": pa.array(b.astype(np.uint64).view(np.int64))}

    def block(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, rows in by_table(batches).items():
            mask, pattern = agreed(tables.keys(rows, k), np.array([0]))
            yield pa.RecordBatch.from_arrays([pa.array([part * m + k], pa.int64()), pa.array([k], pa.int32()), pa.array((mask & tables.mask).view(np.int64)), pa.array((pattern & tables.mask).view(np.int64)), pa.array([rows.tobytes()], pa.binary())], ["id", "t", "mask", "pattern", "data"])

    cols = ", ".join(f"{x} long" for x in names)
    dealt = distinct.select(*names).mapInArrow(keyed, f"t int, rank long, {cols}").repartitionByRange(per * m, "t", "rank")
    blocks = materialise(dealt.mapInArrow(block, "id long, t int, mask long, pattern long, data binary"))
    # some dozen bytes for each block, of which there are BLOCKS a table, or one for each million fingerprints
    roots = blocks.select("id", "t", "mask", "pattern").orderBy("t", "id").toArrow()
    ids, ts = roots.column("id").to_numpy(), roots.column("t").to_numpy()
    masks, patterns = (roots.column(x).to_numpy().view(np.uint64) for x in ("mask", "pattern"))

    def meet(batches):
        """Each block goes to every pair of blocks that it may have links in, with those rows that may be linked there."""
        for batch in batches:
            for me, t, data in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist(), batch.column("data").to_pylist()):
                rows = np.frombuffer(data, dtype=np.uint64).reshape(-1, len(names))
                keys = tables.keys(rows, t)
                for i in np.flatnonzero(ts == t):
                    other = int(ids[i])
                    part = rows if other == me else rows[np.bitwise_count((keys ^ patterns[i]) & masks[i]) <= tables.limit]
                    if len(part):
                        yield pa.RecordBatch.from_arrays([pa.array([min(me, other)], pa.int64()), pa.array([max(me, other)], pa.int64()), pa.array([t], pa.int32()), pa.array([me > other], pa.bool_()), pa.array([part.tobytes()], pa.binary())], ["p", "q", "t", "second", "data"])

    def search(table: pa.Table) -> pa.Table:
        t, p, q = (table.column(x)[0].as_py() for x in ("t", "p", "q"))
        sides = {x["second"]: np.frombuffer(x["data"], dtype=np.uint64).reshape(-1, len(names)) for x in table.select(["second", "data"]).to_pylist()}
        none = np.zeros(0, dtype=np.uint64)
        return pa.table(edges(*(linked(sides[False], sides[True] if p != q else None, tables, t) if p == q or len(sides) == 2 else (none, none))))

    met = blocks.select("id", "t", "data").mapInArrow(meet, "p long, q long, t int, second boolean, data binary")
    return met.groupBy("p", "q", "t").applyInArrow(search, "a long, b long")


def shingle_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of rows (node, one): the distinct shingles' hashes in order, from the row of ``docs`` that ``one`` names."""

    def compute(batches):
        for batch in batches:
            sets = [np.unique(hashes(shingles(t, shingle, True), SEEDS[0])).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "hashes"])

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    named = nodes.select("node", F.col("one.doc_id").alias("s_id"), F.col("one.text_hash").alias("s_hash"))
    one = texts.join(named, texts["doc_id"].eqNullSafe(named["s_id"]) & (texts["text_hash"] == named["s_hash"]))
    return one.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(compute, "node long, hashes binary")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) of rows (bucket, i, j, a, b) whose shingles' Jaccard similarity is high enough."""

    def check(key, left: pa.Table, right: pa.Table) -> pa.Table:
        have = {k: np.frombuffer(v, dtype=np.uint64) for k, v in zip(right.column("node").to_pylist(), right.column("hashes").to_pylist())}
        keep = np.zeros(len(left), dtype=bool)
        for at, (a, b) in enumerate(zip(left.column("a").to_pylist(), left.column("b").to_pylist())):
            x, y = have[a], have[b]
            if min(len(x), len(y)) >= similarity * max(len(x), len(y)) * (1 - 1e-9):
                both = np.concatenate([x, y])
                both.sort()
                n = int((both[1:] == both[:-1]).sum())
                keep[at] = n / max(1, len(both) - n) >= similarity
        return left.select(["a", "b"]).filter(pa.array(keep))

    keys = ["bucket", "i", "j"]
    wanted = pairs.select(*keys, F.explode(F.array("a", "b")).alias("node")).distinct()
    held = wanted.join(sets, "node").select(*[F.col(k).alias(f"of_{k}") for k in keys], "node", "hashes")
    return pairs.groupBy(*keys).cogroup(held.groupBy(*[f"of_{k}" for k in keys])).applyInArrow(check, "a long, b long")


class Sets:
    """Sorted distinct hashes of some nodes, by the hash."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        _, self.word = np.unique(np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), return_inverse=True)
        self.holder = np.repeat(np.arange(len(sets)), self.size)[np.argsort(self.word, kind="stable")]
        self.n = np.bincount(self.word)
        self.at = np.cumsum(self.n) - self.n

    def similarity(self, x: int) -> np.ndarray:
        """Jaccard, of the x-th with each."""
        word = self.word[self.begin[x] : self.begin[x + 1]]
        n = self.n[word]
        held = np.repeat(self.at[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(self.holder[held], minlength=len(self.size))
        return both / np.maximum(1, self.size[x] + self.size - both)


def similar_among(nodes: DataFrame, sets: DataFrame, words: int, radius: int, similarity: float) -> DataFrame:
    """A forest (a, b) of the links within the radius and of the similarity, within each root of rows (node, w0, .., bucket, part, parts)."""
    names = [f"w{i}" for i in range(words)]

    def check(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        part = table.column("part").to_numpy()
        order = np.argsort(part, kind="stable")  # the first set's nodes come first
        fps = np.stack([table.column(x).to_numpy().view(np.uint64) for x in names], axis=1)[order]
        held = table.column("hashes").to_pylist()
        sets = Sets([np.frombuffer(held[k], dtype=np.uint64) for k in order])
        one = int((part == i).sum())
        left, a, b = np.arange(len(fps)), [], []  # left: not reached yet
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                x = queue.pop()
                y = left if i == j else left[(left >= one) == (x < one)]
                y = y[np.bitwise_count(fps[y] ^ fps[x]).sum(axis=1) <= radius]
                if len(y):
                    y = y[sets.similarity(x)[y] >= similarity]
                if len(y):
                    a += [x] * len(y)
                    b += y.tolist()
                    queue += y.tolist()
                    left = np.setdiff1d(left, y, assume_unique=True)
        node = table.column("node").to_numpy()[order]
        return pa.table({"a": pa.array(node[np.array(a, dtype=np.int64)]), "b": pa.array(node[np.array(b, dtype=np.int64)])})

    cells = nodes.join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = cells.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", *names, "hashes")
    return cells.groupBy("bucket", "i", "j").applyInArrow(check, "a long, b long")


def proposed_groups(keyed: DataFrame, words: int, radius: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(node, root) of what links within the radius connect, from rows (node, size, keys, w0, ..), and (root, n, found): its nodes, and some number of links.

    Nodes without a link are left out.
    """
    near = materialise(blocks.links(keyed, words, radius, similarity))
    root = materialise(components(near.select("a", "b")))
    counted = root.join(near.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")), "node", "left")
    return root, materialise(counted.groupBy("root").agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("found")))


def listed_links(keyed: DataFrame, some: DataFrame, words: int, radius: int, similarity: float) -> DataFrame:
    """(bucket, i, j, a, b): the links between rows (node, bucket, part), the lesser part first."""
    found = blocks.links(keyed.join(some.select("node"), "node", "left_semi"), words, radius, similarity, listed=True)
    left, right = (some.select(F.col("node").alias(x), "bucket", F.col("part").alias(f"part_{x}")) for x in "ab")
    return found.join(left, "a").join(right, ["b", "bucket"]).select("bucket", F.least("part_a", "part_b").alias("i"), F.greatest("part_a", "part_b").alias("j"), "a", "b")


def checked_components(docs: DataFrame, fps: DataFrame, each: DataFrame, words: int, radius: int, shingle: int, similarity: float) -> DataFrame:
    """(node, root) of what the links within the radius and of the similarity connect, from rows (node, w0, w1, .., one); ``fps`` has their keys."""
    root, sizes = proposed_groups(fps, words, radius, similarity)
    # a large group has a bucket of its own (below zero), cut in parts
    large, parts = F.col("n") > CHECKED, F.ceil(F.col("n") / CHECKED)
    sparse = large & (F.col("found") < LISTED * F.col("n") * parts)
    total, lists = sizes.agg(F.sum("n"), F.count(F.when(sparse, 1))).first()
    buckets = max(1, (total or 0) // CHECKED)
    bucket = F.when(large, -1 - F.pmod(F.xxhash64("root"), F.lit(1 << 62))).otherwise(F.pmod(F.xxhash64("root"), F.lit(buckets)))
    part = F.when(large, F.pmod(F.xxhash64("node"), parts)).otherwise(0).cast("long")
    dealt = root.join(sizes, "root").select("node", bucket.alias("bucket"), part.alias("part"), F.when(large, parts).otherwise(1).cast("long").alias("parts"), sparse.alias("sparse"))
    some = materialise(each.join(dealt, "node"))
    sets = materialise(shingle_sets(docs, some, shingle))
    good = similar_among(some.where("not sparse"), sets, words, radius, similarity)
    if lists:
        good = good.unionByName(similar(materialise(listed_links(fps, some.where("sparse"), words, radius, similarity)), sets, similarity))
    return components(good)


def groups(docs: DataFrame, shingle: int = 3, radius: int = 2, seeds: tuple[int, ...] = (42,), similarity: float | None = None) -> DataFrame:
    """doc_id, text_hash, the fingerprint's words, root (of its group) and component_id for each row of ``docs``.

    With a similarity, fingerprints are those of the distinct shingles, and links are checked on these.
    """
    names = [f"w{i}" for i in range(len(seeds))]
    order = None if similarity is None else blocks.fitted_order(docs, lambda text: hashes(shingles(text, shingle, True), seeds[0]), similarity)
    fps = materialise(fingerprints(docs, shingle, seeds, similarity is not None, order))
    one = [] if similarity is None else [F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("one")]
    each = materialise(fps.groupBy("node", *names).agg(F.min("doc_id").alias("least"), *one))
    root = components(links(each, len(seeds), radius)) if similarity is None else checked_components(docs, fps, each, len(seeds), radius, shingle, similarity)
    named = each.join(root, "node", "left").select("node", "least", "root")
    # one row for each group of two nodes or more; a large group's nodes do not meet in one task while this is small
    mins = materialise(named.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id")))
    mins = F.broadcast(mins) if mins.count() <= BROADCAST_GROUPS else mins
    ids = named.join(mins, "root", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(ids, "node").select("doc_id", "text_hash", *names, "root", "component_id")


#: For whole documents: five words, a similarity of 0.8 or more.  Two fingerprints of 64 bits differ in
#: 128 * acos(2 * 0.8 / 1.8) / pi = 19.4 bits on average, give or take 4, where 0.8 of all distinct shingles
#: are shared, and in 13.3, give or take 3.4, at 0.9; unrelated texts in 64, give or take 5.7.  The radius
#: proposes 99.6 % of pairs at 0.8.
SHINGLE, WIDE_RADIUS, SIMILARITY = 5, 31, 0.8


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = WIDE_RADIUS, seeds: tuple[int, ...] = SEEDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the least doc_id (nulls last), then text hash."""
    found = groups(docs, shingle, radius, seeds, similarity)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("m")
    stay = found.groupBy("root").agg(first).select(F.col("m.doc_id").alias("s_id"), F.col("m.text_hash").alias("s_hash")).distinct()
    name = fresh(docs, "near_duplicate_hash")
    keyed = docs.withColumn(name, F.xxhash64("text"))
    left = keyed.join(stay, keyed["doc_id"].eqNullSafe(stay["s_id"]) & (keyed[name] == stay["s_hash"]), "left_semi")
    return left.dropDuplicates(["doc_id", name]).select(*docs.columns)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id: three words, 64 bits, two bits apart at most."""
    return groups(docs).select("doc_id", F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"), "component_id")
