"""The pipeline's near-duplicates against brute force over shingles."""

import numpy as np
import pytest

from kerbside.llm import simhash


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]


def edited(rng, ws, n):
    ws = list(ws)
    for i in rng.choice(len(ws), n, replace=False):
        ws[i] = words(rng, 1)[0]
    return ws


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts, radius):
    """The first text of each group that links within the radius and at a similarity of 0.8 connect, and how many pairs only the radius links."""
    fps = np.array([simhash.fingerprint(t, 5, simhash.SEEDS, True) for t in texts], dtype=np.uint64)
    sets, root, false = [shingles(t) for t in texts], list(range(len(texts))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in np.flatnonzero(np.bitwise_count(fps[:a] ^ fps[a]).sum(axis=1) <= radius).tolist():
            n = len(sets[a] & sets[b])
            if sets[a] == sets[b] or n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
            else:
                false += 1
    return {find(i) for i in range(len(texts))}, false


@pytest.mark.parametrize("most", [1_000, 20])
def test_pipeline_links_are_checked(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "CHECKED", most)
    rng = np.random.default_rng(11)
    shared = words(rng, 200)
    clean = [" ".join(shared + words(rng, 80)) for _ in range(150)]  # much in common, yet less than 0.8
    base = words(rng, 300)
    copies = [" ".join(edited(rng, base, int(n))) for n in rng.integers(0, 9, 60)]
    chain = [words(rng, 400)]
    for _ in range(12):
        chain.append(edited(rng, chain[-1], 4))
    texts = [*clean, *copies, *map(" ".join, chain), clean[3], clean[3].upper(), "a b c d e f", "a b c d e g", "", " ", "x"]
    want, false = brute(texts, simhash.WIDE_RADIUS)
    assert false > 1_000
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in simhash.one_of_each(df).collect()}
    assert set(range(150)) <= got and got == want


def test_pipeline_finds_pairs_at_the_similarity(spark):
    rng = np.random.default_rng(12)
    texts = []
    while len(texts) < 500:  # single pairs, without a third copy to link them
        a = words(rng, 300)
        b = list(a)
        at = int(rng.integers(0, 240))
        b[at : at + 28] = words(rng, 28)
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        assert 0.8 <= len(x & y) / len(x | y) < 0.85
        texts += [" ".join(a), " ".join(b)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in simhash.one_of_each(df).collect()}
    assert set(range(0, 500, 2)) <= got and sum(i not in got for i in range(1, 500, 2)) >= 0.98 * 250


def test_dense_blocks_are_searched_in_chunks(monkeypatch):
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 1 << 63, (3_000, 3), dtype=np.uint64)
    rows[:, 1] &= np.uint64(0xFFFF)  # all agree in the leading bits
    tables = simhash.Tables(2, 31)
    found = []
    for expanded in (500_000, 160):
        monkeypatch.setattr(simhash, "EXPANDED", expanded)
        index = simhash.Index(rows, tables, 0)
        found.append({(int(a), int(b)) for x, y in index.near(index.rows[:50], tables.keys(index.rows[:50], 0)) for a, b in zip(x, y)})
    far = np.bitwise_count(index.rows[:50, None, 1:] ^ index.rows[None, :, 1:]).sum(axis=2)
    assert found[0] == found[1] == {(int(a), int(b)) for a, b in zip(*np.nonzero(far <= 31))}


def test_one_of_each_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 8), (3, "x", 9)], "doc_id long, text string, near_duplicate_hash int")
    assert sorted(map(tuple, simhash.one_of_each(df).collect())) == [(1, "a b c d e f", 7), (3, "x", 9)]


@pytest.mark.parametrize("share", [0.25, 1e9])
def test_pairs_of_a_large_group_are_not_rows(spark, monkeypatch, share):
    for name, value in (("CHECKED", 150), ("BLOCKS", 6), ("FEWEST", 16)):
        monkeypatch.setattr(simhash, name, value)
    if share > 1:  # a large group's links are listed
        monkeypatch.setattr(simhash, "LISTED", share)
    rng = np.random.default_rng(13)
    base = words(rng, 150)
    texts = [" ".join(edited(rng, base, int(n))) for n in rng.integers(1, 7, 500)] + [" ".join(words(rng, 60)) for _ in range(100)]
    want, _ = brute(texts, simhash.WIDE_RADIUS)
    sizes, written = [], simhash.materialise

    def noted(df, *args):
        out = written(df, *args)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialise", noted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in simhash.one_of_each(df).collect()}
    assert got == want and 100 < len(want) < 550
    assert max(sizes) > 20_000 if share > 1 else max(sizes) <= 8 * len(texts)
