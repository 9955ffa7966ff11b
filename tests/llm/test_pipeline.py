"""Each stage on what its predecessor kept, against brute force."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np

from kerbside.llm import quality, simhash

from .test_contracts import brute_hits
from .test_substrings import L
from .test_tokens import check_pieces

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, text = docs.columns, lambda df: {r.doc_id: r.text for r in df.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = stages["quality_filter"](spark, docs, SF).cache()
    assert good.columns == columns
    assert set(text(good)) == {r.doc_id for r in quality.classify(docs, labels).collect() if r.keep}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert sum((k in text(good)) == (q == 1) for k, q in truth.items()) >= 0.99 * len(truth)

    single = stages["near_dedup"](spark, good, SF).cache()
    before, after = text(good), text(single)
    assert single.columns == columns and set(after) < set(before)
    words = lambda t: re.findall(rb"[^\s]+", (t or "").lower().encode())
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(max(1, len(w) - 4))}
    ids = sorted(before)
    sets = [shingles(before[i]) for i in ids]
    fps = np.array([simhash.fingerprint(before[i], 5, simhash.SEEDS, True) for i in ids], dtype=np.uint64)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, i in enumerate(ids):
        near = np.flatnonzero(np.bitwise_count(fps[:a] ^ fps[a]).sum(axis=1) <= simhash.WIDE_RADIUS)
        for b in near.tolist():
            if len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b]):  # a fingerprint only proposes
                continue
            x, y = sorted((find(i), find(ids[b])))
            root[y] = x
    assert set(after) == {find(i) for i in ids}
    for i in set(before) - set(after):  # what goes resembles something of its group
        mine = shingles(before[i])
        assert max(len(mine & (o := shingles(before[j]))) / len(mine | o) for j in ids if j != i and find(j) == find(i)) >= 0.8

    cut = stages["substring_dedup"](spark, single, SF).cache()
    left = text(cut)
    assert cut.columns == columns and set(left) == set(after)
    raws = {i: (t or "").encode() for i, t in after.items()}
    seen = Counter(r[i : i + L] for r in raws.values() for i in range(len(r) - L + 1))
    for k, r in raws.items():
        hit = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - L + 1):
            if seen[r[i : i + L]] > 1:
                hit[i : i + L] = True
        assert bytes(np.frombuffer(r, np.uint8)[~hit]).decode("utf-8", "ignore") == (left[k] or "")

    clean = stages["decontamination"](spark, cut, SF).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    some = sorted(left)[:: max(1, len(left) // 80)]
    kept = text(clean)
    assert clean.columns == columns and set(kept) < set(left)
    for k in some:
        assert (k in kept) != brute_hits(left[k], items)[-1]

    check_pieces(stages["packing"](spark, clean, SF).collect(), list(kept.items()))


def test_run_and_edges(spark, edge, empty, tmp_path):
    labels = spark.createDataFrame([(3, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "漢字かな交じり文")], "item_id long, text string")
    for name, docs in (("edge", edge), ("empty", empty)):
        d = tmp_path / name
        docs.write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        bench.write.parquet(f"{d}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, str(d)).collect()
        assert bool(rows) == (name == "edge")
