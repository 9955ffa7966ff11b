"""Readers for logs, session reports, annotations and label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside.operators.reports import LOG_SCHEMA, REPORT_TITLE, SECTIONS

FILE = "_metadata.file_path"


def stem(path: Column) -> Column:
    """A file's name without folder and ending."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def snapshot_log(spark: SparkSession, path: str) -> DataFrame:
    """A log with a header; fields that do not fit their type are null."""
    return spark.read.csv(path, header=True, schema=LOG_SCHEMA, mode="PERMISSIVE", timestampFormat="yyyy-MM-dd'T'HH:mm:ss")


def written_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a log that was written by the source "headed_log"."""
    return spark.read.csv(path, header=False, schema=LOG_SCHEMA, timestampFormat="yyyy-MM-dd'T'HH:mm:ss", recursiveFileLookup=True, pathGlobFilter="part-*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, numbered from 0; a large file is read in blocks by many tasks.

    Rows of a block have ids in a row, so a line's number is its place in the
    block and the number of lines in the blocks of its file before it.
    """
    by = ["file", "block"]
    lines = spark.read.text(path).select(F.col(FILE).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    blocks = lines.groupBy(*by).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*by, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(blocks, by).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("line_no"), "line")


def parsed_log(lines: DataFrame, stretch: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Time-series lines and report lines (with their section) of log files that end in a session report.

    A file's lines are looked through in stretches; whether a stretch begins in
    the report, and in which section, comes from a row for each stretch before
    it.  The first line that is not blank is the header.  Blank and null lines are left out.
    """
    by = ["file", "stretch"]
    w = Window.partitionBy(*by).orderBy("line_no")
    title = F.coalesce(*[F.when(F.col("line") == f"-- {title} --", name) for name, title, _ in SECTIONS])
    d = lines.where("trim(line) <> ''").withColumns({"stretch": F.floor(F.col("line_no") / stretch), "is_report": F.contains("line", F.lit(REPORT_TITLE)), "title": title})
    ends = d.groupBy(*by).agg(F.max("is_report").alias("is_report"), F.max_by("title", F.when(F.col("title").isNotNull(), F.col("line_no"))).alias("title"))
    before = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, F.max("is_report").over(before).alias("was_report"), F.last("title", ignorenulls=True).over(before).alias("was_section"))
    d = d.withColumns({"nth": F.row_number().over(w), "in_report": F.max("is_report").over(w), "section": F.last("title", ignorenulls=True).over(w)}).join(ends, by)
    d = d.withColumns({"in_report": F.col("in_report") | F.coalesce("was_report", F.lit(False)), "section": F.coalesce("section", "was_section")})
    heads = [",".join(c) for _, _, c in SECTIONS]
    body = d.where("in_report and section is not null and title is null").where(~F.col("line").isin(heads))
    series = d.where("not in_report and not (nth = 1 and was_report is null)")
    return series.select("file", "line_no", "line"), body.select("file", "line_no", "section", "line")


def log_series(series: DataFrame) -> DataFrame:
    """Typed rows of time-series lines."""
    row = F.from_csv("line", LOG_SCHEMA, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"})
    return series.select("file", "line_no", row.alias("r")).select("file", "line_no", "r.*")


def report_section(body: DataFrame, name: str) -> DataFrame:
    """The rows of a section as its columns, all text; commas in quotes do not part fields."""
    columns = next(c for n, _, c in SECTIONS if n == name)
    row = F.from_csv("line", ", ".join(f"{c} string" for c in columns))
    return body.where(F.col("section") == name).select("file", "line_no", row.alias("r")).select("file", "line_no", *[F.trim(f"r.{c}").alias(c) for c in columns])


def yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of label files: lines of five numbers; the class becomes 0, the old one is kept beside it."""
    lines = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.txt").select(stem(F.col(FILE)).alias("stem"), F.split(F.trim("value"), r"\s+").alias("t")).where(F.size("t") == 5)
    n = lambda i: F.col("t")[i].try_cast("double")
    return lines.select("stem", F.lit(0).alias("class_id"), F.col("t")[0].try_cast("int").alias("raw_class"), n(1).alias("cx"), n(2).alias("cy"), n(3).alias("w"), n(4).alias("h")).where("cx is not null and cy is not null and w is not null and h is not null")


def sanitised(labels: DataFrame) -> DataFrame:
    """For each label file: its boxes, and how many had another class than 0."""
    return labels.groupBy("stem").agg(F.count("*").alias("n_boxes"), F.count_if(F.coalesce("raw_class", F.lit(0)) != 0).alias("n_changed"))


VOC = "filename string, size struct<width:int,height:int>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"


def voc_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of annotation files in normalised centre form: sorted, clipped to the image, empty ones dropped."""
    x = spark.read.format("xml").option("rowTag", "annotation").schema(VOC).load(path)
    x = x.select(stem(F.col("filename")).alias("stem"), F.col("size.width").cast("double").alias("iw"), F.col("size.height").cast("double").alias("ih"), F.explode("object.bndbox").alias("b")).where("iw > 0 and ih > 0")
    clip = lambda v, m: F.greatest(F.lit(0.0), F.least(m, v))
    x = x.select("stem", "iw", "ih", clip(F.least("b.xmin", "b.xmax"), F.col("iw")).alias("x1"), clip(F.greatest("b.xmin", "b.xmax"), F.col("iw")).alias("x2"), clip(F.least("b.ymin", "b.ymax"), F.col("ih")).alias("y1"), clip(F.greatest("b.ymin", "b.ymax"), F.col("ih")).alias("y2")).where("x2 > x1 and y2 > y1")
    return x.select("stem", F.lit(0).alias("class_id"), ((F.col("x1") + F.col("x2")) / 2 / F.col("iw")).alias("cx"), ((F.col("y1") + F.col("y2")) / 2 / F.col("ih")).alias("cy"), ((F.col("x2") - F.col("x1")) / F.col("iw")).alias("w"), ((F.col("y2") - F.col("y1")) / F.col("ih")).alias("h"))


def yolo_lines(boxes: DataFrame) -> DataFrame:
    return boxes.select("stem", F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "cx", "cy", "w", "h").alias("line"))


def evaluation_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Labelled and pending crops of a label file."""
    d = spark.read.csv(path, header=True, schema="crop_file string, true_label string").select(F.trim("crop_file").alias("crop_file"), F.lower(F.trim(F.coalesce("true_label", F.lit("")))).alias("true_label"))
    return d.where("true_label <> ''"), d.where("true_label = ''")


def training_curve(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a results file with trimmed names; all numbers."""
    d = spark.read.csv(path, header=True)
    return d.select(*[F.trim(F.col(f"`{c}`")).try_cast("double").alias(c.strip()) for c in d.columns])


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, stem, folder, length) of the files below a folder; contents are not read. Files without a byte are not listed: the source "file_listing" lists them too."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return d.select("path", stem(F.col("path")).alias("stem"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), "length")


def label_of_image(images: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each image with its label file of the first location in order: candidates have stem, path and priority."""
    best = candidates.groupBy("stem").agg(F.min_by("path", "priority").alias("label_path"))
    return images.join(best, "stem", "left")
