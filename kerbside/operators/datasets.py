"""Preparation of annotation sets: matching, splits, caps, near-duplicate frames."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matched(images: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return images.join(labels.select(key).distinct(), key, "left_semi")


def without_label(images: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return images.join(labels.select(key), key, "left_anti")


def set_counts(images: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Stems on one side only, on both, and on either."""
    a, b = images.select(key), labels.select(key)
    n = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return n(a.subtract(b), "images_only").unionByName(n(b.subtract(a), "labels_only")).unionByName(n(a.intersect(b), "both")).unionByName(n(a.union(b).distinct(), "either"))


def split(items: DataFrame, key: str, seed: int = 42, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """train, val and test by a hash order with whole cuts.

    Items are dealt by 65,536 ranges of their hash, and a range's start is the
    number of items in those before it.  Only the two ranges that a cut falls
    into are ranked; all others lie on one side of it as a whole.  Equal keys
    are ranked one after the other; a null key comes last.
    """
    h = F.coalesce(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"_{seed}"))), F.lit("~"))
    d = items.select(key, h.alias("h")).withColumn("bin", F.substr("h", F.lit(1), F.lit(4)))
    bins = d.groupBy("bin").agg(F.count("*").alias("n"))  # 65,537 rows at most
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("bin", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    a, b = F.floor(F.col("total") * train), F.floor(F.col("total") * val)
    inside = lambda at: (at > F.col("before")) & (at < F.col("before") + F.col("n"))
    bins = bins.select("bin", "before", a.alias("a"), (a + b).alias("b"), (inside(a) | inside(a + b)).alias("cut"))
    d = d.join(F.broadcast(bins), "bin")
    ranked = d.where("cut").withColumn("rank", F.row_number().over(Window.partitionBy("bin").orderBy("h", key)) + F.col("before"))
    r = ranked.unionByName(d.where("not cut").withColumn("rank", (F.col("before") + 1).cast("long")))
    return r.select(key, F.when(F.col("rank") <= F.col("a"), "train").when(F.col("rank") <= F.col("b"), "val").otherwise("test").alias("split"))


def capped(rows: DataFrame, keys: list[str], order: list, most: int, in_all: int | None = None) -> DataFrame:
    """The first rows of each key, and of all."""
    r = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("place") <= most)
    return r if in_all is None else r.orderBy(*keys, "place").limit(in_all)


def by_priority(items: DataFrame, name: str, words: list[str], default: int = 10) -> DataFrame:
    """Items in order of the first of some words that their name holds, in any case; then by name."""
    rank = F.lit(default)
    for i, word in reversed(list(enumerate(words))):
        rank = F.when(F.contains(F.lower(name), F.lit(word.lower())), i).otherwise(rank)
    return items.withColumn("priority", rank).orderBy("priority", name)


def merged_sources(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Several sets in one, their keys prefixed by the set's name."""
    out = None
    for name, df in sets.items():
        one = df.withColumn(key, F.concat_ws("_", F.lit(name), F.col(key).cast("string"))).withColumn("source_set", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def write_split(manifest: DataFrame, path: str) -> None:
    """The manifest of a split; files stay where they are."""
    manifest.write.mode("overwrite").partitionBy("split").parquet(path)


def words(bit: Callable[[Column], Column], size: int) -> Column:
    """A fingerprint as an array of longs, 64 bits in each, the first lowest; ``bit`` gives the truth of a bit by its number."""

    def word(k: Column) -> Column:
        def with_bit(a: Column, i: Column) -> Column:
            on = (k * 64 + i < size) & bit(k * 64 + i)
            return F.when(on, a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(a)

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), with_bit)

    return F.transform(F.sequence(F.lit(0), F.lit(-(-size // 64) - 1)), word)


def _stretch(print_: Column, first: int, end: int) -> Column:
    """The bits of a fingerprint from ``first`` to ``end`` (63 at most) as one number."""
    word, off = divmod(first, 64)
    x = F.shiftrightunsigned(print_[word], off)
    if off + end - first > 64:
        x = x.bitwiseOR(F.call_function("shiftleft", print_[word + 1], F.lit(64 - off)))
    return x.bitwiseAND(F.lit((1 << (end - first)) - 1))


def representatives(prints: DataFrame, key: str, column: str) -> DataFrame:
    """The first key of each distinct fingerprint; a null fingerprint has none."""
    return prints.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(key).alias(key))


def members(prints: DataFrame, key: str, column: str) -> DataFrame:
    """Each key that is not its fingerprint's first, with the key that is."""
    first = representatives(prints, key, column).select(F.col(key).alias("other"), column)
    return prints.join(first, column).where(F.col(key) > F.col("other")).select(key, "other").distinct()


def near_pairs(prints: DataFrame, key: str, column: str, most: int = 10, bits: int = 256) -> DataFrame:
    """Pairs of fingerprints (arrays of longs) within a Hamming distance, by the first keys of both.

    Of ``most`` + 1 stretches of the bits at least one is equal in both, so
    prints meet in an equi join by stretch, and count where their first equal
    stretch is.  Equal fingerprints are one here (see ``members``); null ones
    are near nothing.
    """
    edges = [i * bits // (most + 1) for i in range(most + 2)]
    spans = list(zip(edges, edges[1:]))
    filed = representatives(prints, key, column)
    filed = filed.select(key, column, F.posexplode(F.array(*[_stretch(F.col(column), *s) for s in spans])).alias("band", "part"))
    others = filed.select(F.col(key).alias("other"), F.col(column).alias("other_print"), "band", "part")
    j = filed.join(others, ["band", "part"]).where(F.col(key) < F.col("other"))
    apart = [F.col(column)[i].bitwiseXOR(F.col("other_print")[i]) for i in range(-(-bits // 64))]
    distance = sum((F.bit_count(x) for x in apart[1:]), F.bit_count(apart[0]))
    same = F.coalesce(*[F.when(_stretch(F.array(*apart), *s) == 0, i) for i, s in enumerate(spans)])
    return j.where((distance <= most) & (F.col("band") == same)).select(key, "other", distance.alias("distance"))


def kept(prints: DataFrame, key: str, column: str, most: int = 10, bits: int = 256) -> DataFrame:
    """Keys kept when each, in order, is kept unless a kept one before it has a near print.

    What is near a print's first key is near its other keys, so these go with it or
    because of it, and only the first keys need to be joined.  Null prints are kept.
    """
    from kerbside.operators.lineage import cut

    prints = cut(prints.select(key, column))
    items = prints.select(key).join(members(prints, key, column), key, "left_anti")
    return keep_first(near_pairs(prints, key, column, most, bits), items, key)


#: Pairs of items that one task settles at a time.
SETTLED = 200_000


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """Decides what the pairs of a stretch of the order allow: an item goes if one before it stays, and stays if all before it go."""
    stays: dict = {}
    for item, before in rows.groupby("item", sort=True)["before"]:
        near = [stays.get(b) for b in before.dropna()]  # None: of another stretch, or not decided
        stays[item] = False if True in near else None if None in near else True
    known = [(k, v) for k, v in stays.items() if v is not None]
    return pd.DataFrame(known, columns=["item", "stays"]).astype({"stays": "bool"})


def keep_first(pairs: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Items kept when each, in order, is kept unless a kept one before it is near.

    The order is cut into stretches of some SETTLED pairs.  In each round every
    stretch decides, one item after the other, all that its own pairs and what
    is known of earlier stretches allow; then pairs with a decided item go.  So a
    chain takes as many rounds as it has stretches at most, however long it is.
    ``pairs`` has ``key`` and the later item ``other``; all pairs of one item are in one stretch.
    """
    from kerbside.operators.lineage import cut

    left = cut(pairs.select(F.col(key).alias("before"), F.col("other").alias("item")))
    kind = left.schema["item"].dataType.simpleString()
    parts = left.count() // SETTLED + 1
    starts = []
    if parts > 1:
        ranged = left.select("item").repartitionByRange(int(parts), "item").groupBy(F.spark_partition_id().alias("part"))
        starts = sorted(r["first"] for r in ranged.agg(F.min("item").alias("first")).collect())[1:]
    stretch = F.size(F.filter(F.array(*map(F.lit, starts)), lambda b: b <= F.col("item"))) if starts else F.lit(0)
    gone = None
    while left.head(1):
        marks = left.select(F.lit(None).cast(kind).alias("before"), F.col("before").alias("item")).distinct()
        asked = left.select("before", "item").unionByName(marks).groupBy(stretch.alias("stretch"))
        known = cut(asked.applyInPandas(_settle, f"item {kind}, stays boolean"))
        stay = known.where("stays").select(F.col("item").alias("before"))
        out = left.join(stay, "before", "left_semi").select("item").unionByName(known.where("not stays").select("item")).distinct()
        gone = cut(out if gone is None else gone.unionByName(out).distinct())
        left = left.join(known.select("item"), "item", "left_anti").join(gone, "item", "left_anti")
        left = cut(left.join(gone.select(F.col("item").alias("before")), "before", "left_anti").select("before", "item"))
    return items if gone is None else items.join(gone.select(F.col("item").alias(key)), key, "left_anti")
