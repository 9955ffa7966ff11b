"""op1, op5, op7: against the library over whole texts."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kerbside.llm import bpe, counts, packing, queries, wavelet

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
T = Tokenizer.from_file(BYTE)


def ids(text, end):
    return np.array([*T.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def test_segments_give_the_librarys_ids(sf, spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    got = bpe.encoder(BYTE).encode(texts)
    for t, g in zip(texts, got):
        assert np.frombuffer(g, "<u2").tolist() == T.encode(t, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'sdétre<|>1  ᠎ \x1c\x85"), st.characters(codec="utf-8")), max_size=40))
def test_segments_of_any_text(text):
    text += " <|endoftext|>" * (len(text) % 7 == 3)
    assert np.frombuffer(bpe.encoder(BYTE).encode([text])[0], "<u2").tolist() == T.encode(text, add_special_tokens=False).ids


def check_pieces(rows, texts):
    want, pieces, seqs = Counter(), {}, {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    by = {}
    for key, text in texts:
        a = ids(text, 1)
        by.setdefault((key, len(a)), []).append(a)
    assert set(by) == set(pieces)
    for k, ps in pieces.items():
        copies, a = len(by[k]), by[k][0]
        covered = Counter()
        for p in ps:
            assert p.ids_crc32 == zlib.crc32(a[p.start : p.start + p.length].tobytes())
            covered.update(range(p.start, p.start + p.length))
        assert covered == Counter({i: copies for i in range(len(a))})
    last = max(seqs)
    assert sorted(seqs) == list(range(last + 1))
    for s, ps in seqs.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == 2048 or s == last and at <= 2048
    return want


def test_op1_pieces(spark, sf):
    check_pieces(queries.op1_packing(spark, sf).collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_op1_edges_and_parts(edge, empty):
    check_pieces(packing.pack(edge.repartition(3), BYTE).collect(), [(r.doc_id, r.text) for r in edge.collect()])
    assert packing.pack(empty, BYTE).count() == 0


def test_op1_windows_hold_the_mixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    rows = packing.pack(docs, BYTE).collect()
    total = Counter()
    for r in rows:
        total[r.source] += r.length
    n, sent = sum(total.values()), Counter()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for s in range(max(by)):
        for r in by[s]:
            sent[r.source] += r.length
        for q, k in total.items():  # deficits are carried, so none ever grows beyond a few ids
            assert abs(sent[q] - (s + 1) * 2048 * k / n) <= 2


def test_op1_weights_until_a_queue_runs_dry():
    mix = packing.Mixture([10_000, 5_000, 1], [3.0, 1.0, 1.0], 100)
    c = mix.before(np.arange(0, 152))
    assert (c.sum(axis=1) == np.minimum(np.arange(0, 152) * 100, 15_001)).all()
    assert (np.diff(c, axis=0) >= 0).all() and c[-1].tolist() == [10_000, 5_000, 1]
    assert abs(c[50][0] - 3 * c[50][1]) <= 4


def test_op1_sequences(edge):
    got = packing.sequences(packing.pack(edge, BYTE, with_ids=True)).collect()
    flat = Counter(np.concatenate([np.frombuffer(bytes(r.ids), "<u2") for r in got]).tolist())
    assert flat == Counter(np.concatenate([ids(r.text, 1) for r in edge.collect()]).tolist())
    with pytest.raises(ValueError):
        packing.pack(edge, BYTE, weights={"a": 1.0})


def check_output(rows, texts):
    rows = sorted(rows, key=lambda r: r.start)
    key = lambda k: (k is not None, k or 0)
    assert [key(r.doc_id) for r in rows] == sorted(key(k) for k, _ in texts)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    want = Counter((k, len(a := ids(t, 0)), zlib.crc32(a.tobytes())) for k, t in texts)
    assert want == Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows)


def test_op5_output(spark, sf, edge, empty):
    check_output(queries.op5_token_output(spark, sf).collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    check_output(wavelet.token_output(edge, BYTE).collect(), [(r.doc_id, r.text) for r in edge.collect()])
    assert wavelet.token_output(empty, BYTE).count() == 0


def test_op5_small_shards(edge):
    shards = wavelet.write_shards(edge, BYTE, 0, shard_tokens=50)
    assert shards.count() > 3
    check_output(wavelet.read_documents(shards).collect(), [(r.doc_id, r.text) for r in edge.collect()])


def test_op5_occurrences(edge):
    shards = wavelet.write_shards(edge, BYTE, 0, shard_tokens=50)
    token = int(ids("the cat the cat", 0)[0])
    want = Counter((r.doc_id, i) for r in edge.collect() for i, x in enumerate(ids(r.text, 0).tolist()) if x == token)
    assert Counter(tuple(r) for r in wavelet.occurrences(shards, token).collect()) == want
    ends = Counter((r.doc_id, len(ids(r.text, 0)) - 1) for r in edge.collect())
    assert Counter(tuple(r) for r in wavelet.occurrences(shards, 0).collect()) >= ends


def test_op5_questions_inflate_only_what_they_touch():
    rng = np.random.default_rng(3)
    values = rng.zipf(1.3, 300_000) % 50_000
    w = wavelet.WaveletMatrix(wavelet.build(values))
    i = 123_456
    assert w.access(i) == values[i] and len(w.kept) <= w.bits
    assert w.rank(int(values[i]), i) == int((values[:i] == values[i]).sum()) and len(w.kept) <= 3 * w.bits
    k = w.rank(int(values[i]), i)
    assert w.select(int(values[i]), k) == i
    assert len(w.data) < 2 * len(values)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 65535) | st.integers(0, 5), max_size=1500))
def test_op5_rank_and_select(values):
    w = wavelet.WaveletMatrix(wavelet.build(np.array(values, dtype=np.uint16)))
    assert w.all().tolist() == values
    for i in range(0, len(values), 97):
        v = values[i]
        assert w.access(i) == v and w.count(v) == values.count(v) and w.rank(v, i) == values[:i].count(v)
        assert w.occurrences(v)[:5] == [j for j, x in enumerate(values) if x == v][:5]
    assert w.count(40000) == values.count(40000)


def test_op7_counts(spark, sf, edge, empty):
    t = Tokenizer.from_file(WORD)
    for docs, hot in ((spark.read.parquet(f"{sf}/documents.parquet"), 100), (edge, 2), (edge, 100_000)):
        want = Counter((r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 2048) for r in docs.collect())
        assert want == Counter(tuple(r) for r in counts.token_counts(docs, WORD, hot_runs=hot).collect())
    assert counts.token_counts(empty, WORD).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sdéΣσA1<|>  ́"), st.characters(codec="utf-8")), max_size=30))
def test_op7_runs_are_independent(text):
    t = Tokenizer.from_file(WORD) if not hasattr(test_op7_runs_are_independent, "t") else test_op7_runs_are_independent.t
    test_op7_runs_are_independent.t = t
    n = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    assert n(text) == sum(n(x.decode()) for x in text.encode().split())
