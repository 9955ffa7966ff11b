"""Blocks of shared shingles: no similar pair is missed, unrelated texts do not meet."""

import numpy as np
import pytest

from kerbside.llm import blocks, simhash

from .test_near_dedup import brute, edited, words


def hashed(text):
    return simhash.hashes(simhash.shingles(text, 5, True), 42)


def groups_of(pairs):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in list(root)}


def with_lines(rng, n, lines):
    return [" ".join([*words(rng, 60), *(w for x in rng.choice(len(lines), 3, replace=False) for w in lines[x])]) for _ in range(n)]


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(21)
    pool = rng.integers(0, 1 << 63, 4_000, dtype=np.uint64)
    seen = 0
    for common in (pool[:0], rng.permutation(pool)[:1_500]):
        order = blocks.Order(common, 0.8)
        for n in [*range(1, 60), 200, 777]:
            for _ in range(5):
                both = rng.choice(pool, n, replace=False)
                union = int(n / 0.8 + 1e-9)
                rest = rng.choice(np.setdiff1d(pool, both), union - n, replace=False)
                at = int(rng.integers(0, len(rest) + 1))
                x, y = np.union1d(both, rest[:at]), np.union1d(both, rest[at:])
                assert n / union >= 0.8 and set(order.keys(x)) & set(order.keys(y))
                seen += union > n
    assert seen > 500 and len(order.keys(np.zeros(0, dtype=np.uint64))) == 0


def test_unrelated_texts_do_not_meet(spark):
    rng = np.random.default_rng(22)
    lines = [words(rng, 12) for _ in range(6)]
    pairs = {}
    for n in (500, 2_000):
        df = spark.createDataFrame(list(enumerate(with_lines(rng, n, lines))), "doc_id long, text string")
        order = blocks.fitted_order(df, hashed, simhash.SIMILARITY)
        rows = simhash.fingerprints(df, 5, simhash.SEEDS, True, order).collect()
        _, count = np.unique(np.concatenate([np.frombuffer(r["keys"], dtype=np.uint64) for r in rows]), return_counts=True)
        pairs[n] = int((count * (count - 1) // 2).sum())
        _, met = np.unique(np.concatenate([blocks.Order(np.zeros(0, dtype=np.uint64), 0.8).keys(np.unique(hashed(t))) for t in (r.text for r in df.collect())]), return_counts=True)
        assert (met * (met - 1) // 2).sum() > n * n / 16  # by hash alone, a line makes a block
        # the eight tables let 1.06 % of all pairs through each
        assert pairs[n] < n / 10 < 0.085 * n * n / 2


@pytest.mark.parametrize("small", [4, 64])
def test_links_of_blocks_of_any_size(monkeypatch, small):
    monkeypatch.setattr(blocks, "SMALL", small)
    rng = np.random.default_rng(23)
    base = rng.integers(0, 1 << 63, (6, 2), dtype=np.uint64)
    rows = []
    for key, n in enumerate([2, 3, 5, 40, 90, 400]):
        for node in range(n):
            near = base[rng.integers(6)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (int(rng.integers(1, 14)), 2), dtype=np.uint64), axis=0)
            rows.append([key << 32 | int(rng.integers(70, 130)), key << 32 | node, *near.tolist()])
    rows = np.array(sorted(rows), dtype=np.uint64)
    size = (rows[:, 0] & blocks.LOW).astype(int)
    want = set()
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if rows[i, 0] >> np.uint64(32) == rows[j, 0] >> np.uint64(32) and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]) and np.bitwise_count(rows[i, 2:] ^ rows[j, 2:]).sum() <= 22:
                want.add(tuple(sorted((int(rows[i, 1]), int(rows[j, 1])))))
    for listed in (True, False):
        found = [x for a, b, _ in blocks.met(rows, 2, 22, 0.8, listed) for x in zip(a.tolist(), b.tolist())]
        assert {tuple(sorted(x)) for x in found} <= want and groups_of(found) == groups_of(want)
        assert not listed or sorted(tuple(sorted(x)) for x in found) == sorted(want)
    forest = [x for a, b, _ in blocks.gathered(blocks.met(rows, 2, 22, 0.8, False), False) for x in zip(a.tolist(), b.tolist())]
    assert groups_of(forest) == groups_of(want) and len(forest) == len(groups_of(want)) - len(set(groups_of(want).values()))


@pytest.mark.parametrize("listed", [False, True])
def test_blocks_that_are_cut(spark, monkeypatch, listed):
    """Texts of little but common lines, whose blocks stay large, beside near copies."""
    monkeypatch.setattr(blocks, "PIECE", 24)
    monkeypatch.setattr(blocks, "KEYED", 2_000)
    if listed:
        monkeypatch.setattr(simhash, "LISTED", 1e9)
        monkeypatch.setattr(simhash, "CHECKED", 10)
    rng = np.random.default_rng(24)
    lines = [words(rng, 30) for _ in range(8)]
    texts = [" ".join(w for x in rng.choice(8, 4, replace=False) for w in lines[x]) for _ in range(120)] + with_lines(rng, 100, lines)
    base = words(rng, 200)
    texts += [" ".join(edited(rng, base, int(n))) for n in rng.integers(1, 8, 80)]
    want, _ = brute(texts, simhash.WIDE_RADIUS)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == want and 100 < len(want) < 260
