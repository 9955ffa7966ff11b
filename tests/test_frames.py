"""Near-duplicate frames: groups of equal prints, fingerprints of many words and long chains."""

import random

from kerbside.operators import datasets, lineage


def greedy(near, items):
    kept = []
    for k in items:
        if not any((x, k) in near for x in kept):
            kept.append(k)
    return kept


def test_long_chains_are_decided_in_few_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(lineage, "cut", lambda df, cut=lineage.cut: cuts.append(1) or cut(df))
    monkeypatch.setattr(datasets, "SETTLED", 300)
    chain = spark.createDataFrame([(i, i + 1) for i in range(2_000)], "k long, other long").coalesce(1)
    items = spark.range(2_001).withColumnRenamed("id", "k")
    assert {r.k for r in datasets.keep_first(chain, items, "k").collect()} == set(range(0, 2_001, 2))
    assert len(cuts) <= 1 + 3 * 8
    cuts.clear()
    monkeypatch.setattr(datasets, "SETTLED", 200_000)
    assert datasets.keep_first(chain, items, "k").count() == 1_001 and len(cuts) <= 4


def test_greedy_of_random_pairs(spark, monkeypatch):
    rng = random.Random(9)
    for stretch in (7, 60, 10_000):
        monkeypatch.setattr(datasets, "SETTLED", stretch)
        near = {tuple(sorted(rng.sample(range(120), 2))) for _ in range(200)}
        df = spark.createDataFrame(sorted(near), "k long, other long").coalesce(2)
        got = datasets.keep_first(df, spark.range(130).withColumnRenamed("id", "k"), "k")
        assert sorted(r.k for r in got.collect()) == greedy(near, range(130))
    assert datasets.keep_first(df.limit(0), spark.range(3).withColumnRenamed("id", "k"), "k").count() == 3


def signed(words):
    return [w - (1 << 64) if w >> 63 else w for w in words]


def test_prints_of_many_words(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(256) for _ in range(12)]
    flipped = lambda b: b ^ sum(1 << x for x in rng.sample(range(256), rng.choice([0, 0, 1, 5, 6, 10, 11])))
    rows = [(i, flipped(rng.choice(base))) for i in range(150)] + [(150, None), (151, None)]
    words = [(k, None if b is None else signed([b >> 64 * i & (1 << 64) - 1 for i in range(4)])) for k, b in rows]
    df = spark.createDataFrame(words, "k long, bits array<long>").repartition(3)
    first = {}
    for k, b in rows:
        first.setdefault(b, k)
    near = {(a, b): (x ^ y).bit_count() for x, a in first.items() for y, b in first.items() if x is not None and y is not None and a < b and (x ^ y).bit_count() <= 10}
    got = datasets.near_pairs(df, "k", "bits").collect()
    assert {(r.k, r.other): r.distance for r in got} == near and len(got) == len(near) > 20
    same = {(r.k, r.other) for r in datasets.members(df, "k", "bits").collect()}
    assert same == {(k, first[b]) for k, b in rows if b is not None and first[b] != k} and same
    all_near = {(a, b) for a, x in rows for b, y in rows if a < b and x is not None and y is not None and (x ^ y).bit_count() <= 10}
    assert sorted(r.k for r in datasets.kept(df, "k", "bits").collect()) == greedy(all_near, [k for k, _ in rows])


def test_words_of_bits(spark):
    from pyspark.sql import functions as F

    bits = [i % 3 == 0 or i == 63 for i in range(130)]
    got = spark.range(1).select(datasets.words(lambda i: F.get(F.array(*map(F.lit, bits)), i), 130).alias("w")).first().w
    assert [x & (1 << 64) - 1 for x in got] == [sum(1 << i for i, b in enumerate(bits[at : at + 64]) if b) for at in (0, 64, 128)]


def test_join_rows_stay_few(spark):
    """Rows of the join by stretches of bits, before distances: under a hundredth of all pairs."""
    from kerbside.plans import reports

    p = lineage.cut(reports.prints(spark, "/root/testdata/sf0.01"))
    spans = [(i * 256 // 11, (i + 1) * 256 // 11) for i in range(11)]
    from pyspark.sql import functions as F

    filed = datasets.representatives(p, "frame_id", "bits").select(F.posexplode(F.array(*[datasets._stretch(F.col("bits"), *s) for s in spans])).alias("band", "part"))
    rows = filed.groupBy("band", "part").count().select(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    assert rows < 0.01 * p.count() ** 2
