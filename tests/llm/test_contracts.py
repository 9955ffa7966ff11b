"""op2, op4, op8, op9: against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from kerbside.llm import components, decontaminate, language, queries, simhash, transport


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def check_media(rows, texts):
    by = Counter()
    for t in texts:
        raw = (t[1] or "").encode()
        pay = raw + bytes(-len(raw) % 64 if raw else 64)
        by[(t[0], len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))] += 1
    assert by == Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows)
    for r in rows:
        assert r.media_bytes % 188 == 0 and "gaps=0;errors=0" in r.feature


def test_op2(spark, sf, edge, empty):
    check_media(queries.op2_media_columns(spark, sf).collect(), [(r.doc_id, r.text) for r in documents(spark, sf).collect()])
    check_media(transport.media_features(edge).collect(), [(r.doc_id, r.text) for r in edge.collect()])
    assert transport.media_features(empty).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 40_000), st.integers(1, 9_000), st.integers(0, 255))
def test_op2_round_trip(n, unit, seed):
    payload = np.random.default_rng(seed).integers(0, 256, n, dtype=np.uint8).tobytes()
    media = transport.mux(payload, unit=unit)
    s = transport.demux(media).streams[transport.MEDIA_PID]
    assert s.data() == payload and s.gaps == 0 and len(media) % 188 == 0
    assert [t for t, _, _ in s.packets] == [at * 90_000 // 8_000 for at in range(0, n, unit)] and all(r for _, r, _ in s.packets)


def test_op2_damage(spark):
    media = transport.mux(bytes(range(256)) * 100)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    lost = transport.demux(b"".join(packets[:10] + packets[11:])).streams[transport.MEDIA_PID]
    assert lost.gaps == 1
    twice = transport.demux(b"".join(packets[:10] + packets[9:])).streams[transport.MEDIA_PID]
    assert twice.gaps == 0 and twice.repeats == 1 and twice.data() == bytes(range(256)) * 100
    broken = transport.demux(packets[0][:20] + b"\x01" + packets[0][21:] + b"".join(packets[1:]) + b"x")
    assert broken.sync_errors == 1
    assert transport.demux(b"").streams == {} and transport.demux(b"junk" * 100).sync_errors == 3
    df = spark.createDataFrame([(1, media), (2, None), (3, b"G" * 400)], "id long, m binary")
    rows = transport.elementary_packets(df, "m", "id").orderBy("packet").collect()
    assert b"".join(bytes(r.data) for r in rows) == bytes(range(256)) * 100 and {r.key for r in rows} == {1}


def brute_fingerprint(text, k=3):
    ws = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + k]), 42) for i in range(max(1, len(ws) - k + 1))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(keys, fps, radius=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        if keys[i] is not None:
            least[find(i)] = min(keys[i], least.get(find(i), keys[i]))
    return [least.get(find(i)) for i in range(len(fps))]


def check_simhash(rows, texts):
    fps = [brute_fingerprint(t) for _, t in texts]
    want = Counter((k, f"{f:016x}", c) for (k, _), f, c in zip(texts, fps, brute_components([k for k, _ in texts], fps)))
    assert want == Counter(tuple(r) for r in rows)


def test_op4(spark, sf, edge, empty):
    docs = documents(spark, "/root/testdata/sf0.01")
    check_simhash(queries.op4_simhash_near_dedup(spark, "/root/testdata/sf0.01").collect(), [(r.doc_id, r.text) for r in docs.collect()])
    check_simhash(simhash.near_duplicates(edge).collect(), [(r.doc_id, r.text) for r in edge.collect()])
    assert simhash.near_duplicates(empty).count() == 0


def test_op4_index_finds_every_link(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    flip = lambda x, n: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, len(x)), dtype=np.uint64), axis=0)
    words = np.unique(np.concatenate([base, flip(base[:700], 1), flip(base[:700], 2), flip(base[:300], 3), np.uint64(1) << np.arange(64, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x), int(x)) for x in words.view(np.int64)], "node long, w0 long")
    roots = {r.node: r.root for r in components.components(simhash.links(df, 1, 2)).collect()}
    signed = words.view(np.int64).tolist()
    want = brute_components(signed, [int(x) for x in words])
    groups = Counter(want)
    assert all(roots.get(k, k) == c for k, c in zip(signed, want)) and max(groups.values()) > 60


def test_op4_wide_fingerprints(spark):
    rng = np.random.default_rng(8)
    a = rng.integers(0, 1 << 62, (400, 2), dtype=np.uint64)
    b = a.copy()
    for row in b:
        for bit in rng.choice(128, 19, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    rows = np.concatenate([a, b]).view(np.int64)
    df = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(rows)], "node long, w0 long, w1 long")
    got = {(r.node, r.root) for r in components.components(simhash.links(df, 2, 19)).collect()}
    assert got == {(i, i) for i in range(400)} | {(i + 400, i) for i in range(400)}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)}


def brute_hits(text, items, n=10):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = word(text), set(), set()
    for item, t in items:
        b = word(t)
        k = min(n, len(b))
        wins = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if b else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in wins:
                hit.update(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_op8(spark, sf, edge, empty):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_decontamination(spark, sf).collect()
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = con.sql(f"select {', '.join(cols)} from ({queries.oracle_sql()['op8_decontamination']})").fetchall()
    assert Counter(want) == Counter(tuple(r[c] for c in cols) for r in got) and any(r.contaminated for r in got)


def test_op8_edges(spark, edge, empty):
    items = [(1, "Hello WORLD"), (2, "word " * 30), (3, None), (4, "?!"), (5, "naïve ÀÉ ẞ"), (10, "hello world"), (None, "x9")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((r.doc_id, *brute_hits(r.text, [x for x in items if x[0] is not None] + [("", "x9")][:0])) for r in edge.collect())
    got = decontaminate.contamination(edge, bench.where("item_id is not null")).collect()
    assert want == Counter(tuple(r) for r in got)
    con = duckdb.connect()
    con.register("documents", edge.select("doc_id", "text").toArrow())
    con.register("benchmark", bench.toArrow())
    with_null = decontaminate.contamination(edge, bench)
    assert Counter(con.sql(f"select {', '.join(with_null.columns)} from ({queries.oracle_sql()['op8_decontamination']})").fetchall()) == Counter(map(tuple, with_null.collect()))
    only = decontaminate.contamination(edge, bench.where("item_id is null")).where("contaminated").collect()
    assert [(r.doc_id, r.n_hit, r.n_items, r.items_sha256) for r in only] == [(5, 1, 1, hashlib.sha256(b"").hexdigest())]
    assert decontaminate.contamination(edge, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0
    assert sorted(r.doc_id or 0 for r in decontaminate.clean(edge, bench.where("item_id = 2")).collect()) == [0, 1, 2, 3, 3, 4, 5, 6, 8, 9]


def test_op9(spark, edge, empty):
    docs = documents(spark, "/root/testdata/sf0.01")
    truth = {r.doc_id: r for r in docs.collect()}
    got = queries.op9_language_id(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.97 * len(held)
    profiles = language.learn(docs.where("doc_id % 3 = 0"))
    rows = {(r.doc_id, r.lang_pred, r.score) for r in language.predict(edge, profiles).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (9, "und", 0.0)} <= rows and len(rows) == 10
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.predict(edge, {}).collect()} == {"und"}


def test_op9_grams_and_profiles():
    for text in ("Ab, cab!  éa", " -x", "", None, "12 3", "aaa aaa b"):
        want = Counter()
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            w = f"_{w}_"
            want.update(g for n in (1, 2, 3) for i in range(len(w) - n + 1) if (g := w[i : i + n]) != "_")
        codes, counts = language.grams(text)
        spelt = {"".join(chr(c >> s & 0x1FFFFF) for s in (0, 21, 42) if c >> s & 0x1FFFFF): n for c, n in zip(codes.tolist(), counts.tolist())}
        assert spelt == want
    codes, counts = np.arange(900), np.arange(900) % 7
    assert language.profile(codes, counts).tolist() == sorted(range(900), key=lambda i: (-counts[i], i))[:300]


def test_op9_distance_by_hand():
    a, b = (language.profile(*language.grams(t)) for t in ("the cat and the hat", "der Hund und der Hut"))
    sorted_ = {k: (np.sort(p), np.argsort(p, kind="stable")) for k, p in (("en", a), ("de", b))}
    own = language.profile(*language.grams("the and")).tolist()
    far = {k: sum(abs(i - p.tolist().index(g)) if g in p.tolist() else 300 for i, g in enumerate(own)) for k, p in (("en", a), ("de", b))}
    assert language.nearest("the and", sorted_) == ("en", round(1 - far["en"] / (300 * len(own)), 6)) and far["en"] < far["de"]
