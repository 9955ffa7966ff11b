"""op3: against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.accumulators import AccumulatorParam

from kerbside.llm import queries, substrings, suffixes

L = 200


class Longest(AccumulatorParam):
    def zero(self, value):
        return []

    def addInPlace(self, a, b):
        return a + b


def brute(texts):
    raws = [(k, (t or "").encode()) for k, t in texts]
    seen = Counter(r[i : i + L] for _, r in raws for i in range(len(r) - L + 1))
    out = []
    for k, r in raws:
        hit = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - L + 1):
            if seen[r[i : i + L]] > 1:
                hit[i : i + L] = True
        left = bytes(np.frombuffer(r, np.uint8)[~hit[:-1]])
        out.append((k, len(r), int(hit.sum()), int((hit[:-1] & ~np.concatenate([[False], hit[:-2]])).sum()) if r else 0, hashlib.sha256(left).hexdigest()))
    return Counter(out)


def check(df):
    assert brute([(r.doc_id, r.text) for r in df.collect()]) == Counter(tuple(r) for r in substrings.repeats(df).collect())


def test_op3(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert brute([(r.doc_id, r.text) for r in docs.collect()]) == Counter(tuple(r) for r in queries.op3_suffix_array_dedup(spark, sf).collect())


def made(seed=4):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared, line = word(900), word(90)
    texts = [word(300) + shared[rng.randrange(300) : rng.randrange(350, 900)] + word(rng.randrange(250)) for _ in range(60)]
    texts += [word(150) + line + word(150) for _ in range(80)]  # a common line, never 200 bytes of it alike
    texts += [word(100) + line + "x" * 20 + line + word(30 + i) for i in range(20)]
    texts += [shared, shared, "ab" * 400, "z" * 450, word(500) * 2, word(199), "abc" * 66 + "ab", None, ""]
    return list(enumerate(texts))


@pytest.mark.parametrize("hot", [1_000, 5])
def test_op3_made(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 20_000)
    check(spark.createDataFrame(made(), "doc_id long, text string").repartition(5))


def test_op3_large_keys_are_counted_by_spark(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_BYTES", 2_000)
    monkeypatch.setattr(substrings, "HEAVY", 1)
    check(spark.createDataFrame(made(7), "doc_id long, text string").repartition(5))


def test_op3_long_texts_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 150)
    check(spark.createDataFrame(made(8), "doc_id long, text string").repartition(3))


def test_op3_a_footer_in_ever_new_surroundings_fills_no_shard(spark, monkeypatch):
    """Shards are counted as they are sorted: none may hold over twice what is aimed at."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    footer = word(400)
    df = spark.createDataFrame([(i, word(150) + footer + word(150)) for i in range(3_000)], "doc_id long, text string").repartition(6)
    size, shard, seen = 50_000, substrings.sort_shard, spark.sparkContext.accumulator([], Longest())

    def counted(batches):
        batches = list(batches)
        seen.add([sum(len(x) for b in batches for x in b.column("raw").to_pylist())])
        return shard(iter(batches))

    monkeypatch.setattr(substrings, "SHARD_BYTES", size)
    monkeypatch.setattr(substrings, "sort_shard", counted)
    check(df)
    assert seen.value and max(seen.value) <= 2 * size


def test_op3_recursion_and_queues_on_disk_of_the_registered_query(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3_000)]
    made = []
    for i in range(1_600):  # copies in pairs to tens, each with edits of its own
        if i % 16 == 0:
            base = rng.choices(words, k=500)
        text = list(base)
        for _ in range(6):
            text[rng.randrange(500)] = str(rng.random())
        made.append((i, " ".join(text)))
    spark.createDataFrame(made, "doc_id long, text string").coalesce(4).write.parquet(f"{tmp_path}/documents.parquet")
    seen = spark.sparkContext.accumulator([], Longest())

    def noted(batches):
        class Noted(suffixes.Store):
            def __exit__(self, *error):
                seen.add([(self.depth, self.spilled, self.n)])
                super().__exit__(*error)

        substrings.Store = Noted
        try:
            yield from substrings.sort_shard(batches)  # a worker's own, not this one
        finally:
            substrings.Store = suffixes.Store

    monkeypatch.setattr(substrings, "sort_shard", noted)
    got = Counter(tuple(r) for r in queries.op3_suffix_array_dedup(spark, str(tmp_path)).collect())
    assert max(x[0] for x in seen.value) >= 2 and max(x[1] for x in seen.value) > 0 and max(x[2] for x in seen.value) > 0
    assert got == brute(made)


def test_a_shard_of_twenty_times_the_memory_is_sorted(monkeypatch):
    monkeypatch.setattr(suffixes, "RANGE", 256)
    rng = np.random.default_rng(3)
    part = rng.integers(1, 60, 6_000)
    text = np.concatenate([np.append(part[a : a + 900], 0) for a in rng.integers(0, 5_100, 60)]).astype(np.uint16)
    with suffixes.Store() as store:
        expected = suffixes.suffix_order(text, store)
        assert store.depth == 1 and not store.spilled
    with suffixes.Store(len(text) // 20, 1_000) as store:
        got = suffixes.suffix_order(text, store)
        assert store.depth > 1 and store.spilled
    assert (got[1] == expected[1]).all()
    view = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(200, np.uint16)), 200)
    ends = np.append(text, 0) == 0
    end = np.flatnonzero(ends)[np.searchsorted(np.flatnonzero(ends), np.arange(len(text)))]

    def cut(p):
        return tuple(view[p][: min(200, end[p] - p)])

    assert [cut(p) for p in got[0]] == [cut(p) for p in expected[0]]


def test_values_that_occur_again():
    values = np.random.default_rng(1).integers(0, 3_000, 5_000).astype(np.uint64) * np.uint64(1 << 40)
    n = Counter(values.tolist())
    for in_memory in (7, 700, 10**6):
        with suffixes.Store(in_memory) as store:
            assert substrings.again(values, store).tolist() == [n[x] > 1 for x in values.tolist()]


def test_op3_edges(edge, empty):
    check(edge)
    assert substrings.repeats(empty).count() == 0
    clash = edge.selectExpr("doc_id", "text", "1 AS s1", "2 AS r1", "3 AS spans", "4 AS SPANS_")
    assert substrings.removed(clash).select("doc_id", "text").exceptAll(substrings.removed(edge).select("doc_id", "text")).count() == 0
    assert {tuple(r)[2:] for r in substrings.removed(clash).collect()} == {(1, 2, 3, 4)} and substrings.removed(clash).columns == clash.columns
    left = {(r.doc_id, r.text) for r in substrings.removed(edge).collect()}
    assert {(7, ""), (8, ""), (1, None), (2, "")} <= left and substrings.removed(edge).columns == edge.columns


def test_suffix_order_of_any_strings():
    rng = random.Random(1)
    for _ in range(400):
        k = rng.choice([1, 2, 3, 4, 30])
        segs = [[rng.randint(1, k) for _ in range(rng.randint(0, rng.choice([3, 12, 40])))] for _ in range(rng.randint(1, 6))]
        t = [x for s in segs + segs[: rng.randint(0, 1)] for x in s + [0]]
        suffixes.RANGE = rng.choice([1, 2, 5, 2_048])
        with suffixes.Store(rng.choice([5, 10**6]), rng.choice([3, 20, 10**6])) as store:
            order, common = suffixes.suffix_order(np.array(t), store)
        order = order.tolist()
        suffixes.RANGE = 16_384
        key = lambda i: t[i : t.index(0, i) + 1]
        want = sorted((i for i in range(len(t)) if t[i]), key=key)
        assert [key(i) for i in order] == [key(i) for i in want] and len(set(order)) == len(want)
        for a, b, n in zip(order, order[1:], common.tolist()[1:]):
            x, y = key(a)[:-1], key(b)[:-1]
            assert n == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_runs_of_heavy_contents_are_one_span(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HEAVY", 20)
    rng = random.Random(31)
    letters = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    passage = letters(6_000)
    texts = [letters(rng.randrange(50)) + passage + letters(rng.randrange(50)) for _ in range(60)] + [passage[:700] + letters(40) + passage[900:1500]] * 2 + [None, passage]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    check(df)
    assert substrings.spans(df).count() <= 6 * len(texts)


def test_contents_are_looked_up_as_pairs():
    import pyarrow as pa

    some = substrings.Contents(pa.table({"k": [5, -7, 5], "ch": [1, 2, 1 << 62]}))
    k, ch = np.array([5, 5, -7, -7, 5, 9, 1 << 62]), np.array([1, 2, 2, 1, 1 << 62, 1, 5])
    assert some.has(k, ch).tolist() == [True, False, True, False, True, False, False]
    assert not substrings.Contents(pa.table({"k": pa.array([], pa.int64()), "ch": pa.array([], pa.int64())})).has(k, ch).any()
