"""op12: against DuckDB and plain Python."""

import re
from collections import Counter

import duckdb
import numpy as np

from kerbside.llm import collocations, queries

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {k: c for k, c in f.items() if c >= least and len(k[1]) > 1}
    out = []
    for (lang, w), a in often.items():
        if any(
            x == lang and len(v) > len(w) and 100 * b >= 80 * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
            for (x, v), b in often.items()
        ):
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        s, _, left, right = min(cuts)
        out.append((lang, " ".join(w), a, left, right, n[lang], s))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return Counter(ranked)


def test_op12(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op12_collocations(spark, sf)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(f"select {', '.join(NAMES)} from ({queries.oracle_sql()['op12_collocations']})").fetchall()
    assert Counter(want) == Counter(tuple(r[c] for c in NAMES) for r in got.collect()) and len(want) > 200


def test_op12_small(spark, sf, edge, empty, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    extra = [(1, "A b c d. a B c d! a\tb c x\ny z " * 40, None), (2, "naïve ÀÉ ẞ naïve ÀÉ " * 30, "fr"), (3, "漢字 仮名 " * 31, "und"), (3, None, "fr"), (4, "", "fr"), (5, "\x00 \x1c q " * 33, "x")]
    docs = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    rows = [(r.lang, r.text) for r in docs.collect()]
    plain = lambda df: Counter(tuple(r[c] for c in NAMES) for r in df.collect())
    assert plain(collocations.collocations(docs)) == brute(rows)
    assert plain(collocations.collocations(docs, least=10, top=7)) == brute(rows, 10, 7)
    monkeypatch.setattr(collocations, "RANGE", 20_000)
    monkeypatch.setattr(collocations, "BLOCK", 3_000)
    assert plain(collocations.collocations(docs, least=10)) == brute(rows, 10)
    assert plain(collocations.collocations(edge)) == brute([(r.lang, r.text) for r in edge.collect()])
    assert collocations.collocations(empty).count() == 0


def test_large_counts_are_exact(spark, monkeypatch):
    """Counts whose products pass 64 bits."""
    big = 2**61
    rows = [("x", [], None, 2 * big), ("x", [1], "p", big + 1), ("x", [2], "q", big), ("x", [1, 2], None, big - 1)]
    monkeypatch.setattr(collocations, "counts", lambda docs, least: spark.createDataFrame(rows, "lang string, path array<long>, word string, f long"))
    got = collocations.collocations(None).first()
    assert tuple(got) == ("x", 1, "p q", big - 1, big + 1, big, 2 * big, 2_000_000 * (big - 1) // (2 * big + 1))


def test_transducers_sum():
    rng = np.random.default_rng(1)
    words = [b"\xff", *(b"w%d" % i for i in range(6))]
    parts = [np.append(rng.integers(0, 7, 300), 0) for _ in range(3)]
    for ranges in (1, 5):
        by: dict[int, list[bytes]] = {}
        for p in parts:
            for k, load in collocations.transducer(p, words, ranges):
                by.setdefault(k, []).append(load)
        got, total = [], 0
        for loads in by.values():
            rows, n = collocations.united(loads, 2)
            got += rows
            total += n
        spelt = {path[0]: w for path, w, _ in got if w is not None}
        want = Counter()
        for p in parts:
            for piece in "".join(map(str, p.tolist())).split("0"):
                for k in (1, 2, 3, 4):
                    want.update(piece[i : i + k] for i in range(len(piece) - k + 1))
        names = {w: str(i) for i, w in enumerate(words)}
        assert {"".join(names[spelt[h]] for h in path): n for path, _, n in got} == {k: n for k, n in want.items() if n >= 2}
        assert total == sum(n for k, n in want.items() if len(k) == 1) and len(got) == len({tuple(r[0]) for r in got})
