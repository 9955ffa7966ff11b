"""Plate reads to plates: votes over variants, positions and trajectories."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import plate_text as p

TRACK = ["camera_id", "track_id"]


def _bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a costly column, worked out once a row where it stands.

    Filters on the column are not pushed below a generator, so they do not
    work it out again; texts are skewed, so reads are not shuffled by them.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def rounded(value: Column, places: int, even: bool = False) -> Column:
    """A mean to so many places; what lies on a half does so however it was summed."""
    scaled = F.round(value * 10**places, 9 - places)
    return (F.bround(scaled, 0) if even else F.round(scaled, 0)) / 10**places


def corrected(reads: DataFrame) -> DataFrame:
    """Reads with the valid plate in their text, or null."""
    return _bound(reads, "plate", p.extract(p.clean(F.col("raw_text"))))


def repaired(reads: DataFrame) -> DataFrame:
    return _bound(reads, "plate", p.repair(F.col("raw_text")))


def variant_vote(reads: DataFrame, keys: list[str]) -> DataFrame:
    """The best plate of each group of reads: status, plate, conf and support.

    Valid texts vote with a half plus their confidence; without any, the
    longest and surest text of at least six characters is a partial plate.
    """
    r = repaired(reads).withColumn("cleaned", p.clean(F.col("raw_text")))
    sure = F.struct(F.round(F.length("cleaned") * F.col("ocr_conf"), 9).alias("sure"), (-F.col("event_id")).alias("early"), "cleaned", "ocr_conf")
    # reads without a plate are a group of their own, so both answers come from one pass
    per = r.groupBy(*keys, "plate").agg(F.sum(F.col("ocr_conf") + 0.5).alias("s"), F.avg("ocr_conf").alias("conf"), F.count("*").alias("support"), F.min("event_id").alias("first"), F.max(F.when(F.length("cleaned") >= 6, sure)).alias("l"))
    order = F.when(F.col("plate").isNotNull(), F.struct(F.round("s", 9), -F.col("first")))
    all_ = per.groupBy(*keys).agg(F.max_by(F.struct("plate", "conf", "support"), order).alias("v"), F.max("l").alias("l"))
    valid, partial = F.col("v").isNotNull(), F.col("l").isNotNull()
    return all_.select(
        *keys,
        F.when(valid, "valid").when(partial, "partial").otherwise("none").alias("status"),
        F.coalesce("v.plate", "l.cleaned").alias("plate"),
        rounded(F.coalesce("v.conf", "l.ocr_conf", F.lit(0.0)), 6).alias("conf"),
        F.coalesce("v.support", F.lit(0).cast("long")).alias("support"),
    )


def position_vote(reads: DataFrame, keys: list[str], fewest: int = 3) -> DataFrame:
    """The plate that the valid reads of the commonest length spell position by position, if it is valid itself."""
    r = repaired(reads).where("plate is not null").withColumn("n", F.length("plate"))
    size = r.groupBy(*keys, "n").agg(F.count("*").alias("c"))
    size = size.groupBy(*keys).agg(F.max(F.struct("c", "n")).alias("m")).where(F.col("m.c") >= fewest).select(*keys, F.col("m.n").alias("n"))
    r = r.join(size, [*keys, "n"])
    chars = r.select(*keys, "event_id", "ocr_conf", F.posexplode(F.split("plate", "")).alias("pos", "ch"))
    per = chars.groupBy(*keys, "pos", "ch").agg(F.sum(F.col("ocr_conf") + 0.5).alias("s"), F.min("event_id").alias("first"))
    best = per.groupBy(*keys, "pos").agg(F.max_by("ch", F.struct(F.round("s", 9), -F.col("first"))).alias("ch"))
    spelt = best.groupBy(*keys).agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"])).alias("plate"))
    return spelt.where(p.extract(F.col("plate")) == F.col("plate"))


def modal_plate(reads: DataFrame) -> DataFrame:
    """The commonest valid plate of a track (else the commonest text of six characters or more), its hits, and all reads counted."""
    r = corrected(reads).withColumn("cleaned", p.clean(F.col("raw_text")))
    def most(text, name):
        n = r.where(text.isNotNull()).groupBy(*TRACK, text.alias("t")).agg(F.count("*").alias("hits"), F.min("frame_idx").alias("first"))
        return n.groupBy(*TRACK).agg(F.max_by(F.struct("t", "hits"), F.struct("hits", -F.col("first"))).alias(name), F.sum("hits").alias(f"{name}_n"))
    a, b = most(F.col("plate"), "a"), most(F.when(F.length("cleaned") >= 6, F.col("cleaned")), "b")
    j = a.join(b, TRACK, "full")
    return j.select(*TRACK, F.coalesce("a.t", "b.t").alias("plate"), F.coalesce("a.hits", "b.hits").alias("hits"), F.coalesce("a_n", "b_n").alias("n_reads"))


def exact_consensus(reads: DataFrame, least_conf: float = 0.45) -> DataFrame:
    """Plates of tracks by weight over equal corrected texts: the order-free form of ``trajectory_consensus``."""
    r = corrected(reads).where("plate is not null").withColumn("weight", F.col("det_conf") * F.col("ocr_conf") * F.sqrt(F.col("bbox_area").cast("double")))
    per = r.groupBy(*TRACK, "plate").agg(F.sum("weight").alias("w"), F.count("*").alias("support"), F.max("ocr_conf").alias("top"), F.avg("ocr_conf").alias("conf"), F.min("frame_idx").alias("first"))
    ok = per.where((F.col("support") >= 2) | (F.col("top") >= least_conf))
    best = ok.groupBy(*TRACK).agg(F.max_by(F.struct("plate", "support", "conf"), F.struct(F.round("w", 6), -F.col("first"))).alias("b"))
    return best.select(*TRACK, "b.plate", "b.support", rounded(F.col("b.conf"), 2, even=True).alias("conf"), (F.col("b.support") == 1).alias("provisional"))


def _distance_within(a: str, b: str, most: int) -> bool:
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1] <= most


def fold_reads(reads: list[tuple[str, float, float]], most_reads: int = 15, distance: int = 2, least_conf: float = 0.45):
    """Plate, support, conf and provisional from (plate, weight, conf) in order; reading stops once a plate is confirmed."""
    clusters: list[list[tuple[str, float, float]]] = []
    result = None
    for n, read in enumerate(reads[:most_reads], 1):
        home = next((c for c in clusters if _distance_within(c[0][0], read[0], distance)), None)
        if home is None:
            clusters.append([read])
        else:
            home.append(read)
        good = [c for c in clusters if len(c) >= 2 or max(x[2] for x in c) >= least_conf]
        if not good:
            continue
        best = max(good, key=lambda c: round(sum(x[1] for x in c), 9))
        weight: dict[str, float] = {}
        for text, w, _ in best:
            weight[text] = weight.get(text, 0.0) + w
        plate = max(weight, key=lambda t: round(weight[t], 9))
        confs = [x[2] for x in best if x[0] == plate]
        result = (plate, len(best), round(sum(confs) / len(confs), 2), len(best) == 1)
        if not result[3]:
            break
    return result


def trajectory_consensus(reads: DataFrame) -> DataFrame:
    """Plates of tracks from their reads in order: near texts join the first cluster within two edits, the heaviest cluster wins.

    A track is read 15 times at most, whether or not a read is a plate; empty
    reads are not counted.  The fold depends on the order, so the plates among
    these reads go to one call.
    """
    rank = F.row_number().over(Window.partitionBy(*TRACK).orderBy("frame_idx"))
    r = reads.where("raw_text <> ''").withColumn("rank", rank).where("rank <= 15")
    r = corrected(r).where("plate is not null").withColumn("weight", F.col("det_conf") * F.col("ocr_conf") * F.sqrt(F.col("bbox_area").cast("double")))

    per = r.groupBy(*TRACK).agg(F.array_sort(F.collect_list(F.struct("rank", "plate", "weight", "ocr_conf"))).alias("reads"))

    def fold(batches):
        for batch in batches:
            got = [fold_reads([(x["plate"], x["weight"], x["ocr_conf"]) for x in reads]) for reads in batch.column("reads").to_pylist()]
            found = pa.array([i for i, x in enumerate(got) if x is not None], pa.int64())
            values = zip(*[x for x in got if x is not None]) if len(found) else [[]] * 4
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(found) for k in TRACK], *[pa.array(list(v), t) for v, t in zip(values, (pa.string(), pa.int64(), pa.float64(), pa.bool_()))]], [*TRACK, "plate", "support", "conf", "provisional"])

    return per.mapInArrow(fold, "camera_id long, track_id long, plate string, support long, conf double, provisional boolean")


def snapshot_or_live(snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """A track's plate: the snapshots' if it is new, has two votes or is surer than the live one."""
    j = snapshot.where("status = 'valid'").select(*TRACK, F.col("plate").alias("s_plate"), F.col("conf").alias("s_conf"), F.col("support").alias("s_support")).join(live.select(*TRACK, F.col("plate").alias("l_plate"), F.col("conf").alias("l_conf")), TRACK, "full")
    take = F.col("s_plate").isNotNull() & (F.col("l_plate").isNull() | (F.col("s_support") >= 2) | (F.col("s_conf") > F.col("l_conf")))
    return j.select(*TRACK, F.when(take, F.col("s_plate")).otherwise(F.col("l_plate")).alias("plate"), F.when(take, "snapshot").otherwise("live").alias("origin"))


def total_plates(plates: DataFrame) -> DataFrame:
    return plates.where("plate is not null").agg(F.count_distinct(*TRACK).alias("total_plates"))


def token_plates(tokens: DataFrame) -> DataFrame:
    """Plates from text boxes: each box with its near ones, joined line by line, the surest and longest valid text of an image."""
    a = tokens.select("image_id", F.col("tok_no").alias("seed"), ((F.col("tx1") + F.col("tx2")) / 2.0).alias("ax"), ((F.col("ty1") + F.col("ty2")) / 2.0).alias("ay"), (F.col("ty2") - F.col("ty1")).alias("ah"), (F.col("tx2") - F.col("tx1")).alias("aw"))
    b = tokens.withColumn("bx", (F.col("tx1") + F.col("tx2")) / 2.0).withColumn("by", (F.col("ty1") + F.col("ty2")) / 2.0)
    near = (F.abs(F.col("by") - F.col("ay")) <= F.col("ah") * 2.2) & (F.abs(F.col("bx") - F.col("ax")) <= F.greatest(F.col("aw"), F.col("ah") * 3) * 3.5)
    j = a.join(b, "image_id").where(near)
    line = F.floor((F.col("by") - F.col("ay")) / F.col("ah") + 0.5)
    text = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(line.alias("line"), F.col("bx"), F.col("text")))), lambda x: x["text"]))
    g = j.groupBy("image_id", "seed").agg(text.alias("raw_text"), F.avg("conf").alias("conf"))
    g = repaired(g).where("plate is not null")
    best = g.groupBy("image_id").agg(F.max_by(F.struct("plate", "conf"), F.struct(F.round(F.col("conf") * F.length("plate"), 9), -F.col("seed"))).alias("b"))
    return best.select("image_id", "b.plate", rounded(F.col("b.conf"), 6).alias("conf"))


def text_lines(tokens: DataFrame) -> DataFrame:
    """The line of each box of an image: a new line begins where the step down is half the line's mean height or more.

    The mean runs over the line so far, so the boxes of an image (some dozens)
    are folded in order inside one row.
    """
    b = F.struct(((F.col("ty1") + F.col("ty2")) / 2.0).alias("cy"), F.col("tx1"), F.col("tok_no"), (F.col("ty2") - F.col("ty1")).cast("double").alias("h"))
    per = tokens.groupBy("image_id").agg(F.array_sort(F.collect_list(b)).alias("b"))
    kind = "struct<line:bigint,n:bigint,h:double,cy:double,out:array<struct<line:bigint,x:bigint,tok:bigint>>>"
    start = F.lit(None).cast(kind)
    first = F.struct(F.lit(0).cast("long").alias("line"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("h"), F.lit(0.0).alias("cy"), F.array().cast("array<struct<line:bigint,x:bigint,tok:bigint>>").alias("out")).cast(kind)

    def step(acc, x):
        a = F.coalesce(acc, first)
        same = (a["n"] == 0) | (F.abs(x["cy"] - a["cy"]) < a["h"] / F.greatest(a["n"], F.lit(1)) * 0.5)
        line = F.when(same, a["line"]).otherwise(a["line"] + 1)
        n, h = F.when(same, a["n"] + 1).otherwise(F.lit(1).cast("long")), F.when(same, a["h"] + x["h"]).otherwise(x["h"])
        return F.struct(line.alias("line"), n.alias("n"), h.alias("h"), x["cy"].alias("cy"), F.concat(a["out"], F.array(F.struct(line.alias("line"), x["tx1"].alias("x"), x["tok_no"].alias("tok")))).alias("out")).cast(kind)

    out = per.select("image_id", F.inline(F.aggregate("b", start, step, lambda a: a["out"])))
    place = F.row_number().over(Window.partitionBy("image_id", "line").orderBy("x", "tok"))
    return out.select("image_id", F.col("tok").alias("tok_no"), F.col("line").alias("line_no"), place.cast("long").alias("place"))
