"""Evaluation of predictions: confusion, rates, track votes, training curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, classes: list[str]) -> DataFrame:
    """Rows of true classes, a column for each prediction (n_<class>), unknown included."""
    columns = [F.count_if(F.col("pred") == c).alias(f"n_{c}") for c in [*classes, "unknown"]]
    return rows.groupBy("truth").agg(*columns, F.count("*").alias("support"))


def class_metrics(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each true class; an unknown prediction is a miss; 0 where undefined."""
    names = rows.select(F.col("truth").alias("class")).distinct()
    t = rows.groupBy(F.col("truth").alias("class")).agg(F.count("*").alias("support"), F.count_if(F.col("truth") == F.col("pred")).alias("tp"))
    p = rows.groupBy(F.col("pred").alias("class")).agg(F.count("*").alias("predicted"))
    j = names.join(t, "class").join(p, "class", "left")
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    j = j.withColumn("precision", share(F.col("tp"), F.coalesce("predicted", F.lit(0)))).withColumn("recall", share(F.col("tp"), F.col("support")))
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return j.select("class", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def accuracy(rows: DataFrame) -> DataFrame:
    hit, unknown = F.col("truth") == F.col("pred"), F.col("pred") == "unknown"
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias("accuracy"), F.round(F.avg(F.when(unknown, 1.0).otherwise(0.0)), 6).alias("abstained"))


def track_accuracy(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Share of tracks whose predictions, weighed by confidence, agree with their last true label."""
    known = rows.where("pred <> 'unknown'").groupBy(*keys, "pred").agg(F.sum("conf").alias("s"), F.min(order).alias("first"))
    voted = known.groupBy(*keys).agg(F.max_by("pred", F.struct(F.round("s", 9), -F.col("first"))).alias("voted"))
    truth = rows.groupBy(*keys).agg(F.max_by("truth", order).alias("truth"))
    j = truth.join(voted, keys, "left")
    return j.agg(F.count("*").alias("n_tracks"), F.round(F.avg(F.when(F.col("voted") == F.col("truth"), 1.0).otherwise(0.0)), 6).alias("track_accuracy"))


def rating(score: Column) -> Column:
    return F.when(score >= 0.9, "EXCELLENT").when(score >= 0.8, "VERY GOOD").when(score >= 0.7, "GOOD").when(score >= 0.55, "FAIR").otherwise("POOR")


def best_epoch(curve: DataFrame, epoch: str, score: str) -> DataFrame:
    """The epoch of the highest score, the first of equals, with its rating."""
    best = curve.agg(F.max_by(F.struct(epoch, score), F.struct(score, -F.col(epoch))).alias("b"))
    return best.select(F.col(f"b.{epoch}").alias("epoch"), F.col(f"b.{score}").alias("score"), rating(F.col(f"b.{score}")).alias("rating"))


def markdown(metrics: DataFrame, confused: DataFrame, classes: list[str]) -> DataFrame:
    """An evaluation report as ordered lines."""
    spark = metrics.sparkSession
    top = spark.createDataFrame([(0, "# Evaluation"), (1, "| class | precision | recall | F1 | support |"), (2, "|-|-|-|-|-|")], "row_no long, line string")
    place = lambda c, base: (F.row_number().over(Window.orderBy(c)) + base).cast("long").alias("row_no")  # noqa: E731  a row for each class
    body = metrics.select(place("class", 100), F.format_string("| %s | %.1f %% | %.1f %% | %.1f %% | %d |", "class", F.col("precision") * 100, F.col("recall") * 100, F.col("f1") * 100, "support").alias("line"))
    head = spark.createDataFrame([(10_000, "| true | " + " | ".join([*classes, "unknown"]) + " |"), (10_001, "|-" * (len(classes) + 2) + "|")], "row_no long, line string")
    cells = F.concat_ws(" | ", *[F.col(f"n_{c}").cast("string") for c in [*classes, "unknown"]])
    return top.unionByName(body).unionByName(head).unionByName(confused.select(place("truth", 10_100), F.concat(F.lit("| "), "truth", F.lit(" | "), cells, F.lit(" |")).alias("line")))


def training_report(curve: DataFrame, epoch: str, scores: dict[str, str], main: str) -> DataFrame:
    """A training report as ordered lines: the best epoch by the score ``main``, the last one, and all epochs.

    ``scores`` names a column of the curve (a share) for each title.  Missing values are
    printed as a dash, rows without an epoch are left out; an empty curve gives the heads alone.
    """
    spark = curve.sparkSession
    rows = curve.where(F.col(f"`{epoch}`").isNotNull()).select(F.col(f"`{epoch}`").cast("long").alias("epoch"), *[F.col(f"`{c}`").alias(f"s{i}") for i, c in enumerate(scores.values())])
    shown = lambda c: F.when(c.isNull(), "-").otherwise(F.format_string("%.2f %%", c * 100))
    by = F.col(f"s{list(scores).index(main)}")
    all_of = F.struct("epoch", *[f"s{i}" for i in range(len(scores))])
    ends = rows.agg(F.max_by(all_of, F.struct(by, -F.col("epoch"))).alias("best"), F.max_by(all_of, "epoch").alias("last")).where("last is not null")
    lines = []
    for at, name in ((10, "best"), (100, "last")):
        lines.append((F.lit(at), F.format_string(f"## {name.title()} epoch: %d", F.col(f"{name}.epoch"))))
        lines += [(F.lit(at + 1 + i), F.concat(F.lit(f"| {title} | "), shown(F.col(f"{name}.s{i}")), F.lit(" |"))) for i, title in enumerate(scores)]
    lines.append((F.lit(50), F.concat(F.lit("Rating: "), rating(F.col(f"best.s{list(scores).index(main)}")))))
    body = ends.select(F.explode(F.array(*[F.struct(n.cast("long").alias("row_no"), x.alias("line")) for n, x in lines])).alias("l")).select("l.*")
    head = spark.createDataFrame([(0, "# Training"), (1_000, "| epoch | " + " | ".join(scores) + " |"), (1_001, "|-" * (len(scores) + 1) + "|")], "row_no long, line string")
    cells = F.concat_ws(" | ", F.col("epoch").cast("string"), *[shown(F.col(f"s{i}")) for i in range(len(scores))])
    return head.unionByName(body).unionByName(rows.select((F.col("epoch") + 10_000).alias("row_no"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line")))
