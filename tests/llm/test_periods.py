"""op13: against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kerbside.llm import periods, queries


def brute_runs(words):
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - s >= max(12, 2 * p):
                best.setdefault((s, i + p), p)
    return sorted(((s, e - s, p) for (s, e), p in best.items()), key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(ws)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    found = brute_runs(ws)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
    return (doc_id, len(found), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), sha(lines), sha(kept))


def check(df, docs):
    assert Counter(map(tuple, df.collect())) == Counter(brute(r.doc_id, r.text) for r in docs.collect())


def test_op13(spark, sf, edge, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op13_periodic_runs(spark, sf)
    check(got, docs)
    assert got.where("period >= 32").count() > 3
    short = edge.where("doc_id is null or doc_id <> 7")
    check(periods.periodic_runs(short), short)
    constant = periods.periodic_runs(edge.where("doc_id = 7"), planted=False).first()
    assert (constant.n_runs, constant.start, constant.length, constant.period) == (1, 0, 9000, 1)
    assert constant.collapsed_sha256 == hashlib.sha256(b"word").hexdigest()
    assert periods.periodic_runs(empty).count() == 0


def found(words):
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return [(s, e - s, p) for s, e, p in periods.runs(np.array([ids[w] for w in words], dtype=np.int64), len(words)).tolist()]


piece = st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 40))


@settings(max_examples=150, deadline=None)
@given(st.lists(piece, min_size=1, max_size=9), st.integers(1, 4), st.booleans())
def test_runs_of_runs(pieces, times, cut):
    words = list("".join(w * n for w, n in pieces) * times)[: 1200 - 7 * cut]
    assert found(words) == brute_runs(words)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**31), st.integers(33, 300), st.integers(2, 5), st.sampled_from([1, 2, 3, 30]))
def test_planted_periods(seed, period, times, letters):
    rng = np.random.default_rng(seed)
    block = rng.integers(0, letters + 1, period)
    words = np.concatenate([rng.integers(0, 3, 50), np.tile(block, times), rng.integers(0, 3, 50)])
    words[rng.integers(0, len(words))] = 9
    assert found(words.tolist()) == brute_runs(words.tolist())


def test_touching_inner_runs():
    for unit, tail in (("aab", 2), ("aab", 1), ("abcab", 3), ("ab", 1), ("abb", 2)):
        for n in (12, 20, 45):
            words = list(unit * n + unit[:tail] + unit * n)
            for around in ("", "x", "b"):
                w = list(around) + words + list(around)
                assert found(w) == brute_runs(w)


def test_fibonacci_words():
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    assert found(list(b)) == brute_runs(list(b))
    thue = [str(bin(i).count("1") % 2) for i in range(1024)]
    assert found(thue) == brute_runs(thue)


def test_long_text(spark):
    """A text of over a million bytes, made of one block of 30,011 words, repeated, and a constant stretch."""
    rng = np.random.default_rng(3)
    block = [f"w{x}" for x in rng.integers(0, 50_000, 30_011)]
    text = " ".join(block * 3 + ["z"] * 50_000 + ["end"])
    docs = spark.createDataFrame([(1, text), (2, "end"), (1, text)], "doc_id long, text string")
    got = periods.periodic_runs(docs, planted=False).collect()
    assert {(r.doc_id, r.n_runs, r.start, r.length, r.period) for r in got} == {(1, 2, 0, 90_033, 30_011), (2, 0, None, None, None)}
    assert all(r.collapsed_sha256 == hashlib.sha256(" ".join([*block, "z", "end"]).encode()).hexdigest() for r in got if r.doc_id == 1)
