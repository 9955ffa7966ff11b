"""op11: its parts against plain Python, held-out accuracy, planted texts."""

import re
import zlib

import numpy as np

from kerbside.llm import queries, toxicity


def plain_grams(word):
    w = f"_{word}_"
    return [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)]


def test_subwords_and_means():
    spelt = {}
    for text in ("Ab, cab!  éa", "the other mother", " -x", "", None, "12 3", "漢字かな交じり文 \U0001f600 abc"):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        ids, sizes = toxicity.subwords(text)
        assert sizes.tolist() == [len(plain_grams(w)) for w in words]
        for w, part in zip(words, np.split(ids, np.cumsum(sizes)[:-1]) if words else []):
            assert spelt.setdefault(w, part.tolist()) == part.tolist()
    rng = np.random.default_rng(1)
    odds = rng.normal(size=toxicity.BUCKETS).astype(np.float32)
    for text in ("one two three four five", "one two", "a", "x y z"):
        words = [float(np.mean(odds[toxicity.subwords(w)[0]])) for w in text.split()]
        starts = range(0, len(words), toxicity.STRETCH)
        means = [np.mean(words[max(0, min(i, len(words) - toxicity.STRETCH)) : i + toxicity.STRETCH]) for i in starts]
        clean = np.prod([1 / (1 + np.exp(m - 1)) for m in means])
        assert abs(toxicity.toxicity(text, odds, -1.0) - (1 - clean)) < 1e-5


def test_joint_training_learns_and_spreads_to_misspellings():
    rng = np.random.default_rng(2)
    syllables = ["ba", "co", "di", "fu", "gel", "hom", "jar", "kil", "mon", "nes", "pra", "que"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    texts, toxic = [], np.arange(600) % 4 == 0
    for bad in toxic:
        words = [word() for _ in range(rng.integers(5, 60))]
        for _ in range(2 * bad):
            words.insert(rng.integers(0, len(words)), str(rng.choice(["wretchling", "vexomite"])))
        texts.append(" ".join(words))
    table, weights, offsets = toxicity.train(texts, toxic.astype(np.int64))
    again = toxicity.train(texts, toxic.astype(np.int64))
    assert np.array_equal(table, again[0]) and weights.shape == (toxicity.DIM, 2)
    odds, begin = toxicity.folded(table, weights, offsets)
    # the folded table gives what the softmax of the averaged vectors gives
    ids, sizes = toxicity.subwords("wretchling ba co")
    z = toxicity.by_word(table[ids], sizes).mean(axis=0) @ weights + offsets
    assert abs(toxicity.toxicity("wretchling ba co", odds, begin) - np.exp(z[1]) / np.exp(z).sum()) < 1e-4
    score = lambda t: toxicity.toxicity(t, odds, begin)
    assert score("ba co wretchling di fu gel") > 0.5 and score("baco hom wretchlling vexomites jar") > 0.5
    clean = [score(" ".join(word() for _ in range(40))) for _ in range(200)]
    assert np.mean(np.array(clean) >= toxicity.THRESHOLD) <= 0.02


def test_op11(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op11_toxicity(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    caught = [p for t, p in held if t == 1]
    wrong = [p for t, p in held if t == 0]
    assert np.mean(caught) >= 0.8 and np.mean(wrong) <= 0.03 and len(caught) > 80


def test_op11_edges(spark, edge, empty):
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 0), (5, 1, 1), (5, 0, 0), (None, 1, 1), (6, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxic_documents(edge, labels).collect()
    assert len(rows) == 11 and {(r.doc_id, r.score) for r in rows if r.doc_id in (1, 2, 9)} == {(1, 0.0), (2, 0.0), (9, 0.0)}
    assert len({r.score for r in rows if r.doc_id == 3}) == 1 and not [r for r in rows if r.doc_id is None][0].held_out
    sample = toxicity.labelled_sample(edge, labels).collect()
    assert sorted((r.doc_id, r.toxic) for r in sample) == [(i, t) for i, t in ((3, 1), (3, 1), (4, 0), (5, 1)) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(toxicity.labelled_sample(edge, labels.where("doc_id < 99"), toxic=1, clean=1).collect()) == 2
    none = labels.where("toxic = 1")
    assert {(r.score, r.predicted) for r in toxicity.toxic_documents(edge, none).collect()} == {(0.0, 0)}
    assert toxicity.toxic_documents(empty, labels).count() == 0
