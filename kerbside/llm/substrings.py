"""Suffix-array dedup: every byte inside a 200-byte string that also starts elsewhere.

Only text that may repeat is sorted.  Each 200-byte window belongs to the
least hash of its 64-byte strings, so equal windows share that key wherever
they start, and neighbouring windows of one key form a run.  Keys are counted
over the whole corpus; runs whose key occurs once are done with.  The runs that
stay are grouped by key and content: equal runs repeat as wholes, and a key
with one content has nothing else to be compared with.  Runs of one key that
differ (the ends of passages, the places of edits) go to a shard by their key.
A shard drops windows whose first and last 64 bytes occur once in it, keeps
each of the stretches that are left once, with its number, and puts their
suffixes in order by external induced sorting (``suffixes``): neighbours whose
common prefix, carried through the induction, is 200 bytes repeat.

Keys that very many runs share (a common line in ever new surroundings) are
split by the bytes around it: windows that hold the line at much the same
place must also agree in the 137 bytes that all of these have in common.
Where the differing runs of one key still fill much of a shard, their windows
are counted by Spark instead, over all tasks, and cut into stretches of which
each distinct window has one only; equal stretches become one row before they
are dealt, and different ones are dealt apart.

Two bitmaps of a fixed size tell each scan which keys to pass on; what they
let through by chance is dropped, or sorted to no effect, later on.

A null text is empty, texts under 200 bytes keep all bytes, and repeated rows
repeat each other, like any other copies.  Rows are told apart by doc_id and
text, so a null id is no obstacle.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import fresh, materialise
from kerbside.llm.suffixes import Store, suffix_order

LENGTH, GRAM = 200, 64
SPAN = LENGTH - GRAM + 1
#: Runs of a key beyond which it is split; windows of a part.
HOT, PART = 1_000, 64
CORE = LENGTH - PART + 1
#: The bitmaps have so many bits: 16 MB and 2 MB, at any size of the corpus.
BITS, HOT_BITS = 1 << 27, 1 << 24
#: Bytes of a shard that is aimed at; a key's runs count as large from this part of it.
SHARD_BYTES, LARGE = 8_000_000, 4
#: Windows of a text that are looked at together, so that a long text takes no more memory than a short one.
BLOCK = 400_000
#: Rows of a table that may be broadcast (under 50 bytes each), and of a content that is not shuffled to its verdict.
BROADCAST_ROWS, HEAVY = 500_000, 2_000
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def grams(raw: bytes) -> np.ndarray:
    """A hash of the 64-byte string at each place that has one."""
    h, step = _BYTE[np.frombuffer(raw, np.uint8)], 1
    while step < GRAM:
        later = h[step:]
        h = (h[:-step] * _A) ^ ((later >> np.uint64(29)) + later * _B)
        step *= 2
    h ^= h >> np.uint64(31)
    return h


def ends_of(raw: bytes) -> np.ndarray:
    """A hash of the first and last 64 bytes of each window."""
    h = grams(raw)
    return (h[: len(h) - SPAN + 1] * _A) ^ h[SPAN - 1 :]


def blocks(raw: bytes):
    """(place, bytes) of parts of a text that hold each of its windows once."""
    for at in range(0, len(raw) - LENGTH + 1, BLOCK):
        yield at, raw[at : at + BLOCK + LENGTH - 1]


def runs(raw: bytes):
    """(key, first window, windows, key's places) of each run, and all places with the run of each; of a block."""
    n, h = len(raw) - LENGTH + 1, grams(raw)
    least = _slide(h, np.minimum)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    # a place is a key's if some window around it has its hash as the least
    pad = np.zeros(SPAN - 1, dtype=np.uint64)
    place = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), np.maximum) == h)
    value = h[place]
    starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    return least[first], first, np.diff(np.append(first, n)), np.diff(np.append(starts, len(place))), place, starts


def _slide(x: np.ndarray, least) -> np.ndarray:
    """The least (or greatest) of each SPAN neighbours."""
    step = 1
    while step * 2 <= SPAN:
        x = least(x[:-step], x[step:])
        step *= 2
    rest = SPAN - step
    return least(x[: len(x) - rest], x[rest:])


def has(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def pieces(raw: bytes, repeated: np.ndarray, hot: np.ndarray, wanted: np.ndarray | None = None):
    """(key, content, start, windows, itself) of the runs, or parts of runs, that may repeat; wanted keys only, where these are given."""
    for at, part in blocks(raw):
        for k, ch, begin, n, itself in _pieces(part, repeated, hot, wanted):
            yield k, ch, at + begin, n, itself


def _pieces(raw: bytes, repeated: np.ndarray, hot: np.ndarray, wanted: np.ndarray | None):
    import xxhash

    key, first, n, places, place, starts = runs(raw)
    some = np.flatnonzero(has(repeated, key))
    is_hot = has(hot, key[some])
    if wanted is not None:
        stay = is_hot | has(wanted, key[some])
        some, is_hot = some[stay], is_hot[stay]
    for r, k, a, m, itself, split in zip(some.tolist(), key[some].tolist(), first[some].tolist(), n[some].tolist(), (places[some] > 1).tolist(), is_hot.tolist()):
        if not split:
            yield k, xxhash.xxh64_intdigest(raw[a : a + m + LENGTH - 1]), a, m, itself
            continue
        own = place[starts[r] : starts[r] + places[r]]
        w = np.arange(a, a + m)
        i = np.searchsorted(own, w)  # the key's first place in each window
        part = (own[i] - w) // PART
        cut = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (part[1:] != part[:-1])]))
        for x, y in zip(cut.tolist(), np.append(cut[1:], m).tolist()):
            core = int(own[i[x]]) - int(part[x]) * PART
            yield xxhash.xxh64_intdigest(raw[core : core + CORE], k ^ int(part[x])), xxhash.xxh64_intdigest(raw[a + x : a + y + LENGTH - 1]), a + x, y - x, itself


def _raw(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, dtype=np.uint64).view(np.int64))


def _bitmap(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of a fixed size, put together in Spark word by word."""
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("r2"), F.xxhash64("doc_id").alias("r1"))


def key_counts(docs: DataFrame) -> DataFrame:
    """(k, n) of the keys that occur more than once."""

    def count(batches):
        for batch in batches:
            keys, n = [], []
            for text in batch.column("text").to_pylist():
                for _, part in blocks(_raw(text)):
                    got = runs(part)
                    keys.append(got[0])
                    n.append(got[3])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(n))], ["k", "n"])

    return docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where("n > 1")


def stretches(mask: np.ndarray) -> list[tuple[int, int]]:
    """(first, number) of each row of neighbours that are set."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist()))


def again(values: np.ndarray, store: Store) -> np.ndarray:
    """Whether a value occurs more than once; many values are dealt by hash and looked at part by part."""
    out = store.array(len(values), bool)
    out[:] = False
    parts = -(-2 * len(values) // store.in_memory)
    if parts <= 1:
        out[_twice(values)] = True
        return out

    def rows(a, b):
        return (values[a:b] >> np.uint64(20)) % np.uint64(parts), values[a:b].view(np.int64), np.arange(a, b)

    for _, (some, place) in store.dealt(len(values), parts, rows):
        out[place[_twice(some)]] = True
    return out


def _twice(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values)
    same = np.concatenate([[False], values[order][1:] == values[order][:-1], [False]])
    return order[same[1:] | same[:-1]]


def repeated_windows(strings: list[bytes], store: Store) -> list[np.ndarray]:
    """For each of the distinct strings, which of its windows also start elsewhere, from the suffix order of all."""
    sizes = np.array([len(x) for x in strings])
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = store.array(int(sizes.sum()) + len(sizes), np.uint16)
    for a, raw in zip(begin.tolist(), strings):
        text[a : a + len(raw)] = np.frombuffer(raw, np.uint8)
        text[a : a + len(raw)] += 1
        text[a + len(raw)] = 0
    order, common = suffix_order(text, store)
    hit = store.array(len(text), bool)
    hit[:] = False
    for a, b in store.spans(len(order)):
        alike = a + np.flatnonzero(common[a:b] >= LENGTH)
        hit[order[alike]] = True
        hit[order[alike - 1]] = True
    return [hit[a : a + n - LENGTH + 1] for a, n in zip(begin.tolist(), sizes.tolist())]


def sort_shard(batches):
    """The repeated windows of each run of a shard (key, content, times it occurs, bytes), as lists of first windows and numbers of windows."""
    rows: dict[tuple[int, int], list] = {}
    for batch in batches:
        for k, ch, c, raw in zip(*(batch.column(x).to_pylist() for x in ("k", "ch", "c", "raw"))):
            if (k, ch) not in rows or rows[k, ch][0] < c:
                rows[k, ch] = [c, raw]
    if not rows:
        return
    with Store() as store:
        stay = again(store.gathered((ends_of(raw) for _, raw in rows.values()), np.uint64), store)
        found, times, at = [], Counter(), 0
        for key, (c, raw) in rows.items():
            n = len(raw) - LENGTH + 1
            for a, m in [(0, n)] if c > 1 else stretches(stay[at : at + n]):
                part = raw[a : a + m + LENGTH - 1]
                found.append((key, a, part))
                times[part] += c
            at += n
        rows.clear()
        del stay
        strings = list(times)
        hits = dict(zip(strings, repeated_windows(strings, store))) if strings else {}
        out = []
        for key, a, part in found:
            here = stretches(hits[part]) if times[part] == 1 else [(0, len(part) - LENGTH + 1)]
            out += [(*key, a + b, m) for b, m in here]
        for i in range(0, len(out), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out[i : i + 100_000])], ["k", "ch", "off", "len"])


SHARD_RESULT = "k long, ch long, off long, len long"


def sorted_large(contents: DataFrame) -> DataFrame:
    """The same for rows (k, ch, raw) of large keys, whose windows are counted over all tasks.

    A stretch of repeated windows is cut where a window has more than one
    window before it, or after it, anywhere: then each distinct window lies in
    one distinct stretch only, wherever it occurs.  Equal stretches become one
    row, and different ones need not meet, so no shard fills up with one key.
    """
    spark = contents.sparkSession

    def hashed(k: int, raw: bytes) -> np.ndarray:
        return ends_of(raw) ^ np.uint64(k % (1 << 64))

    def count(batches):
        for batch in batches:
            for k, raw in zip(batch.column("k").to_pylist(), batch.column("raw").to_pylist()):
                w = hashed(k, raw).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w, np.append(-1, w[:-1]), np.append(w[1:], -1))], ["w", "before", "after"])

    seen = contents.mapInArrow(count, "w long, before long, after long").groupBy("w")
    often = materialise(seen.agg(F.count("*").alias("c"), (F.min("before") != F.max("before")).alias("begins"), (F.min("after") != F.max("after")).alias("ends")).where("c > 1"))
    repeated, begins, ends = (spark.sparkContext.broadcast(_bitmap(often.where(x), "w", BITS)) for x in ("true", "begins", "ends"))

    def prune(batches):
        import xxhash

        for batch in batches:
            out = [[], [], [], [], []]
            for k, ch, raw in zip(*(batch.column(x).to_pylist() for x in ("k", "ch", "raw"))):
                w = hashed(k, raw)
                cut = has(begins.value, w) | np.append(False, has(ends.value, w)[:-1])
                for first, m in stretches(has(repeated.value, w)):
                    starts = [0, *(np.flatnonzero(cut[first + 1 : first + m]) + 1).tolist(), m]
                    for a, b in zip(starts, starts[1:]):
                        part = raw[first + a : first + b + LENGTH - 1]
                        for o, v in zip(out, (k, ch, first + a, xxhash.xxh3_64_intdigest(part), part)):
                            o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), _signed(out[3]), pa.array(out[4], pa.binary())], ["k", "of", "at", "ch", "raw"])

    parts = materialise(contents.mapInArrow(prune, "k long, of long, at long, ch long, raw binary"))
    distinct = materialise(parts.groupBy("k", "ch").agg(F.count("*").alias("c"), F.first("raw").alias("raw")))
    shards = _shards(distinct.agg(F.sum(F.length("raw"))).first()[0])
    got = materialise(distinct.repartition(shards, "k", "ch").mapInArrow(sort_shard, SHARD_RESULT))
    return _joined(parts.select("k", "ch", "of", "at"), got, ["k", "ch"]).select("k", F.col("of").alias("ch"), (F.col("at") + F.col("off")).alias("off"), "len")


def _shards(size: int | None) -> int:
    return max(1, -(-(size or 0) // SHARD_BYTES))


class Contents:
    """A set of pairs (key, content), looked up by their ranks."""

    def __init__(self, pairs: pa.Table):
        k, ch = (pairs.column(x).to_numpy() for x in ("k", "ch"))
        self.k, self.ch = np.unique(k), np.unique(ch)
        self.both = np.unique(np.searchsorted(self.k, k) * len(self.ch) + np.searchsorted(self.ch, ch))

    def has(self, k: np.ndarray, ch: np.ndarray) -> np.ndarray:
        if not len(self.both):
            return np.zeros(len(k), dtype=bool)
        a, b = (np.minimum(np.searchsorted(x, y), len(x) - 1) for x, y in ((self.k, k), (self.ch, ch)))
        both = a * len(self.ch) + b
        there = self.both[np.minimum(np.searchsorted(self.both, both), len(self.both) - 1)] == both
        return there & (self.k[a] == k) & (self.ch[b] == ch)


def covered(found: DataFrame, contents: DataFrame) -> DataFrame:
    """(r1, r2, begin, end) of the runs with one of these few contents; neighbours in a text are one span."""
    known = found.sparkSession.sparkContext.broadcast(Contents(contents.toArrow()))

    def cover(batches):
        for batch in batches:
            k, ch, begin, n, r1, r2 = (batch.column(x).to_numpy() for x in ("k", "ch", "begin", "n", "r1", "r2"))
            some = known.value.has(k, ch)
            begin, r1, r2 = begin[some], r1[some], r2[some]
            end = begin + n[some] + LENGTH - 1
            if len(begin):
                new = (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1]) | (begin[1:] < begin[:-1]) | (begin[1:] > end[:-1])
                first = np.flatnonzero(np.concatenate([[True], new]))
                yield pa.RecordBatch.from_arrays([pa.array(r1[first]), pa.array(r2[first]), pa.array(begin[first]), pa.array(np.maximum.reduceat(end, first))], ["r1", "r2", "begin", "end"])

    return found.mapInArrow(cover, "r1 long, r2 long, begin long, end long")


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join to a table that is broadcast up to a checked size."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on)


def spans(docs: DataFrame) -> DataFrame:
    """(r1, r2, begin, end): bytes to remove from each row (overlapping spans, repeats included)."""
    spark = docs.sparkSession
    counts = materialise(key_counts(docs))
    repeated = spark.sparkContext.broadcast(_bitmap(counts, "k", BITS))
    hot = spark.sparkContext.broadcast(_bitmap(counts.where(F.col("n") > HOT), "k", HOT_BITS))

    def candidates(batches):
        for batch in batches:
            out = [[], [], [], [], [], [], []]
            for text, r1, r2 in zip(*(batch.column(x).to_pylist() for x in ("text", "r1", "r2"))):
                for got in pieces(_raw(text), repeated.value, hot.value):
                    for o, v in zip(out, (*got, r1, r2)):
                        o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([_signed(out[0]), _signed(out[1]), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.bool_()), pa.array(out[5], pa.int64()), pa.array(out[6], pa.int64())], ["k", "ch", "begin", "n", "itself", "r1", "r2"])

    ids = _identified(docs)
    found = materialise(ids.select("text", "r1", "r2").mapInArrow(candidates, "k long, ch long, begin long, n int, itself boolean, r1 long, r2 long"))
    contents = found.groupBy("k", "ch").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.max("itself").alias("itself"))
    keys = contents.groupBy("k").agg((((F.count("*") > 1) & (F.min("c") == 1)) | F.max("itself")).alias("sort"), (F.sum("c") > 1).alias("many"), F.sum(F.col("n") + LENGTH).alias("size"))
    verdict = contents.join(keys, "k").where("sort or many").select("k", "ch", "c", "n", (F.col("c") > 1).alias("whole"), "sort", (F.col("size") * LARGE > SHARD_BYTES).alias("large"))
    verdict = materialise(verdict.where("whole or sort"))
    sizes = {r["large"]: r["size"] for r in verdict.where("sort").groupBy("large").agg(F.sum(F.col("n") + LENGTH).alias("size")).collect()}
    wanted = spark.sparkContext.broadcast(_bitmap(verdict.where("sort").select("k"), "k", BITS))
    large = spark.sparkContext.broadcast(_bitmap(verdict.where("sort and large").select("k"), "k", HOT_BITS))

    def texts(batches):
        seen: set = set()
        for batch in batches:
            out = [[], [], []]
            for text in batch.column("text").to_pylist():
                raw = _raw(text)
                got = list(pieces(raw, repeated.value, hot.value, wanted.value))
                for (k, ch, begin, n, _), yes in zip(got, has(wanted.value, np.array([x[0] for x in got], dtype=np.uint64))):
                    if yes and (k, ch) not in seen:
                        seen.add((k, ch))
                        for o, v in zip(out, (k, ch, raw[begin : begin + n + LENGTH - 1])):
                            o.append(v)
            if len(seen) > 300_000:
                seen.clear()
            if out[0]:
                yield pa.RecordBatch.from_arrays([_signed(out[0]), _signed(out[1]), pa.array(out[2], pa.binary()), pa.array(has(large.value, np.array(out[0], dtype=np.uint64)))], ["k", "ch", "raw", "large"])

    differing = docs.select("text").mapInArrow(texts, "k long, ch long, raw binary, large boolean")
    if True in sizes:
        differing = materialise(differing)
    dealt = differing.where("not large").select("k", "ch", F.lit(1).cast("long").alias("c"), "raw").repartition(_shards(sizes.get(False)), "k")
    parts = dealt.mapInArrow(sort_shard, SHARD_RESULT)
    if True in sizes:
        some = differing.where("large").groupBy("k", "ch").agg(F.first("raw").alias("raw"))
        parts = parts.unionByName(sorted_large(materialise(some)))
    parts = materialise(parts)
    pieces_ = ["r1", "r2", "begin", (F.col("begin") + F.col("n") + LENGTH - 1).alias("end")]
    # a content that very many rows share does not meet in one task: its verdict goes to the rows
    whole = verdict.where("whole").select("k", "ch", "c")
    heavy = materialise(whole.where(F.col("c") > HEAVY).select("k", "ch"))
    if heavy.count() <= BROADCAST_ROWS:
        rest = found.join(F.broadcast(heavy), ["k", "ch"], "left_anti")
        light = rest.join(whole.where(F.col("c") <= HEAVY).select("k", "ch"), ["k", "ch"])
        done = light.select(*pieces_).unionByName(covered(found, heavy))
    else:
        rest = found
        done = found.join(whole, ["k", "ch"]).select(*pieces_)
    # what repeats as a whole is done with; the others occur once, so a row has its own ranges only
    parts = parts.join(verdict.where("not whole").select("k", "ch"), ["k", "ch"], "left_semi")
    some = rest.join(parts, ["k", "ch"]).select("r1", "r2", (F.col("begin") + F.col("off")).alias("begin"), (F.col("begin") + F.col("off") + F.col("len") + LENGTH - 1).alias("end"))
    return done.unionByName(some)


def _with_spans(docs: DataFrame, name: str) -> DataFrame:
    """Every row of ``docs`` with its spans in a further column; a row has as many as its text has windows at most."""
    per = spans(docs).groupBy("r1", "r2").agg(F.collect_set(F.struct("begin", "end")).alias(name))
    r1, r2 = F.xxhash64(docs["doc_id"]), F.xxhash64(docs["doc_id"], docs["text"])
    return docs.join(per, (r1 == per["r1"]) & (r2 == per["r2"]), "left").select(*[docs[c] for c in docs.columns], per[name])


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept(raw: bytes, cuts: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in cuts:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _cuts(found) -> list[tuple[int, int]]:
    return merged([(s["begin"], s["end"]) for s in found]) if found else []


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row."""

    def digest(batches):
        for batch in batches:
            out = [[], [], [], []]
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw, cuts = _raw(text), _cuts(found)
                for o, v in zip(out, (len(raw), sum(b - a for a, b in cuts), len(cuts), hashlib.sha256(kept(raw, cuts)).hexdigest())):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(o, pa.int64()) for o in out[:3]], pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_spans(docs, "spans").mapInArrow(digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text`` (and what is left of a character that is cut)."""

    name = fresh(docs, "spans")

    def cut(batches):
        for batch in batches:
            left = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column(name).to_pylist()):
                left.append(text if not found else kept(_raw(text), _cuts(found)).decode("utf-8", "ignore"))
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, "text", pa.array(left, pa.string())).select([c for c in batch.schema.names if c != name])

    return _with_spans(docs, name).mapInArrow(cut, docs.schema)
