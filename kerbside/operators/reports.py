"""Session reports, packed log columns, dashboard figures, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import labels
from kerbside.operators.lineage import numbered

TRACK = ["camera_id", "track_id"]
NOT_DETECTED = "not detected"
#: Columns of the snapshot log.
LOG_SCHEMA = "timestamp timestamp, total_vehicles int, cars int, trucks int, buses int, auto_rickshaws int, motorcycles int, scooters int, bicycles int, plates_detected string, helmet_violations int, violation_details string, pedestrians_detected int, males int, females int, children int, unknown_pedestrians int"
# Titles and headers of the sections of a session report.
SECTIONS = [
    ("counts", "Vehicle counts by class", ["vehicle_class", "count"]),
    ("humans", "Humans detected", ["category", "count"]),
    ("plates", "Recognized license plates detail", ["track_id", "vehicle_class", "plate_number", "confidence"]),
    ("two_wheelers", "Two-wheeler helmet compliance detail", ["track_id", "vehicle_class", "plate_number", "rider_helmet", "pillion_helmet", "verdict"]),
    ("vehicles", "Per-vehicle detail (every vehicle counted this run)", ["track_id", "vehicle_class", "plate_number", "helmet_status"]),
]
REPORT_TITLE = "===== FINAL SESSION REPORT ====="


def vehicle_rows(crossed: DataFrame, voted: DataFrame, last: DataFrame, plates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each counted track with class (voted, else last seen), plate and helmet status; tracks that never crossed are left out."""
    j = crossed.select(*TRACK).join(voted.select(*TRACK, "vehicle_class"), TRACK, "left").join(last.select(*TRACK, "last_class"), TRACK, "left")
    j = j.join(plates.select(*TRACK, "plate"), TRACK, "left").join(verdicts.select(*TRACK, "verdict"), TRACK, "left")
    cls = F.coalesce("vehicle_class", labels.reporting_class(F.col("last_class")))
    helmet = F.when(~labels.is_two_wheeler(cls), "N/A").otherwise(F.coalesce("verdict", F.lit("UNVERIFIED")))
    return j.select(*TRACK, cls.alias("vehicle_class"), F.coalesce("plate", F.lit(NOT_DETECTED)).alias("plate"), helmet.alias("helmet_status"))


def packed(df: DataFrame, keys: list[str], left: str, right: Column, name: str) -> DataFrame:
    """``id:value`` strings of each key, joined by bars in order of the id, or "none"; and how many."""
    items = F.array_sort(F.collect_list(F.when(right.isNotNull(), F.struct(F.col(left).alias("id"), right.alias("v")))))
    g = df.groupBy(*keys).agg(items.alias("items"))
    text = F.array_join(F.transform("items", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["v"])), "|")
    return g.select(*keys, F.when(F.size("items") > 0, text).otherwise("none").alias(name), F.size("items").cast("long").alias(f"n_{name}"))


def unpacked(df: DataFrame, column: str, order: str) -> DataFrame:
    """Rows (order, id, value) of packed strings; items without a colon are dropped."""
    item = df.where(F.col(column).isNotNull() & (F.col(column) != "none")).select(order, F.posexplode(F.split(column, r"\|")).alias("pos", "item"))
    item = item.withColumn("item", F.trim("item")).where(F.contains("item", F.lit(":")))
    return item.select(order, "pos", F.split_part("item", F.lit(":"), F.lit(1)).alias("id"), F.split_part("item", F.lit(":"), F.lit(2)).alias("value"))


def unique_plates(log: DataFrame, order: str = "line_no") -> DataFrame:
    """Each plate of a log with the track that showed it first."""
    u = unpacked(log, "plates_detected", order).where("value <> ''")
    return u.groupBy(F.col("value").alias("plate")).agg(F.min(F.struct(order, "pos", "id")).alias("f")).select("plate", F.col("f.id").alias("track_id"))


def violation_tracks(log: DataFrame, order: str = "line_no") -> DataFrame:
    u = unpacked(log, "violation_details", order)
    g = u.groupBy(F.col("id").alias("track_id")).agg(F.bool_or(F.contains("value", F.lit("rider"))).alias("r"), F.bool_or(F.contains("value", F.lit("pillion"))).alias("p"))
    return g.select("track_id", F.when(F.col("r"), "NO HELMET").otherwise("HELMET").alias("rider_helmet"), F.when(F.col("p"), "NO HELMET").otherwise("None").alias("pillion_helmet"))


def non_empty(log: DataFrame) -> DataFrame:
    """Log rows that say anything."""
    return log.where((F.col("total_vehicles") > 0) | (F.col("plates_detected") != "none") | (F.col("violation_details") != "none"))


def headline(log: DataFrame, order: str = "line_no") -> DataFrame:
    """Figures of the last row of a log; classes rolled up, unknown people never below zero."""
    last = log.where("total_vehicles is not null").agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    people = n("males") + n("females") + n("children")
    total = F.when(n("pedestrians_detected") > 0, n("pedestrians_detected")).otherwise(people)
    return last.select(n("total_vehicles").alias("total"), n("cars").alias("cars"), (n("motorcycles") + n("scooters")).alias("bikes"), n("buses").alias("buses"), n("trucks").alias("trucks"), total.alias("people"), F.greatest(F.lit(0), total - people).cast("long").alias("unknown"))


def kpis(rows: DataFrame, people: DataFrame) -> DataFrame:
    """Cards of the dashboard; the rate of compliance is whole per cents, 100 without two-wheelers."""
    k = rows.agg(F.count("*").alias("vehicles"), F.count_distinct(F.when(F.col("plate") != NOT_DETECTED, F.col("plate"))).alias("unique_plates"), F.count_if(F.col("helmet_status").startswith("VIOLATION")).alias("violations"), F.count_if(F.col("helmet_status") != "N/A").alias("two_wheelers"))
    ok = labels.half_up((F.col("two_wheelers") - F.col("violations")) * 100 / F.nullif("two_wheelers", F.lit(0)))
    return k.crossJoin(F.broadcast(people.select(F.col("total").alias("pedestrians")))).select("vehicles", "unique_plates", "violations", "pedestrians", F.coalesce(ok, F.lit(100).cast("long")).alias("compliance"))


def shares(rows: DataFrame) -> DataFrame:
    """Share of each class in per cent."""
    n = rows.groupBy("vehicle_class").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("total")))).select("vehicle_class", "n", F.round(F.col("n") * 100 / F.col("total"), 6).alias("percent"))


def people_shares(people: DataFrame) -> DataFrame:
    """Whole per cents of men, women and children; what is left of a hundred is unknown."""
    part = lambda c: F.coalesce(labels.half_up(F.col(c) * 100 / F.nullif("total", F.lit(0))), F.lit(0)).cast("long")
    p = people.select("total", part("males").alias("male_percent"), part("females").alias("female_percent"), part("children").alias("child_percent"))
    left = F.greatest(F.lit(0), 100 - F.col("male_percent") - F.col("female_percent") - F.col("child_percent"))
    return p.withColumn("unknown_percent", F.when(F.col("total") > 0, left).otherwise(0).cast("long"))


def rolled(counts: DataFrame) -> DataFrame:
    """Counts of classes with vans among the others."""
    name = F.when(F.col("vehicle_class") == "Van", labels.OTHERS).otherwise(F.col("vehicle_class"))
    return counts.groupBy(name.alias("vehicle_class")).agg(F.sum("n").cast("long").alias("n"))


def active(counts: DataFrame) -> DataFrame:
    """The classes that were seen at all."""
    return counts.where("n > 0")


def detailed_rows(rows: DataFrame, votes: DataFrame, live: DataFrame, verdicts: DataFrame, best: DataFrame) -> DataFrame:
    """The table of analysed vehicles: plate with status, helmets of both seats, people, verdict and the best snapshot.

    ``rows`` are counted tracks with vehicle_class, ``votes`` the plates of their
    kept snapshots by ``plates.variant_vote``, ``live`` the plates of all frames,
    ``best`` has the frame of a track's best snapshot.  A valid plate of the
    snapshots goes before the live one, and that before a partial one, which
    ends in a question mark.  A track without snapshots was not analysed: it has
    neither plate of the snapshots nor verdict, and no file.
    """
    two = labels.is_two_wheeler(F.col("vehicle_class"))
    seen = lambda c: F.nullif(F.col(c), F.lit("None"))
    sits = lambda c: seen(c).isNotNull().cast("long")
    j = rows.select(*TRACK, "vehicle_class").join(votes.select(*TRACK, F.col("plate").alias("v_plate"), F.col("status").alias("v_status"), F.col("conf").alias("v_conf")), TRACK, "left")
    j = j.join(live.select(*TRACK, F.col("plate").alias("l_plate"), F.col("conf").alias("l_conf")), TRACK, "left")
    j = j.join(verdicts, TRACK, "left").join(best.select(*TRACK, F.col("frame_idx").alias("snapshot_frame")), TRACK, "left")
    valid, is_live, partial = F.col("v_status") == "valid", F.col("l_plate").isNotNull(), F.col("v_status") == "partial"
    first = lambda v, l, p, none: F.when(valid, v).when(is_live, l).when(partial, p).otherwise(none)  # noqa: E731, E741
    percent = lambda c: labels.percent_text(F.round(c, 6))
    plate = first(F.col("v_plate"), F.col("l_plate"), F.concat("v_plate", F.lit("?")), F.lit(NOT_DETECTED))
    tag = F.when(plate == NOT_DETECTED, "noplate").otherwise(F.replace(plate, F.lit("?"), F.lit("_partial")))
    kind = F.translate("vehicle_class", "/ ", "-")
    name = F.concat(F.format_string("cam%d_id%04d_", "camera_id", "track_id"), kind, F.lit("_"), tag, F.lit(".jpg"))
    return j.select(
        *TRACK,
        "vehicle_class",
        plate.alias("plate"),
        first(F.lit("valid"), F.lit("live"), F.lit("partial"), F.lit("none")).alias("plate_status"),
        first(percent(F.col("v_conf")), percent(F.col("l_conf")), percent(F.col("v_conf")), F.lit("")).alias("plate_conf"),
        F.when(two, F.coalesce(seen("rider_helmet"), F.lit("NOT VISIBLE"))).otherwise("N/A").alias("rider_helmet"),
        F.when(two, F.coalesce("pillion_helmet", F.lit("None"))).otherwise("N/A").alias("pillion_helmet"),
        F.when(two, sits("rider_helmet") + sits("pillion_helmet")).otherwise(0).cast("long").alias("n_people"),
        F.when(two, F.coalesce("verdict", F.lit("UNVERIFIED (no head detected)"))).otherwise("N/A").alias("verdict"),
        "snapshot_frame",
        F.when(F.col("snapshot_frame").isNotNull(), name).alias("snapshot"),
    )


# Columns of the table of analysed vehicles and of the sheet of figures.
DETAILED = "track_id vehicle_class plate plate_status plate_conf rider_helmet pillion_helmet n_people verdict snapshot_frame snapshot".split()
FIGURES = "timestamp total_vehicles cars trucks buses auto_rickshaws motorcycles scooters bicycles plates_detected".split()


def _number() -> Column:
    return F.concat(F.lit("#"), F.col("track_id").cast("string")).alias("Track ID")


def plates_sheet(rows: DataFrame) -> DataFrame:
    """Sheet of recognised plates; conf is a share."""
    number = F.coalesce(F.concat(F.lit("#"), F.col("track_id").cast("string")), F.lit("N/A")).alias("Track ID")
    percent = F.concat(labels.half_up(F.col("conf") * 100).cast("string"), F.lit("%")).alias("Confidence")
    kind = F.coalesce("vehicle_class", F.lit("Car")).alias("Vehicle Classification")
    return rows.select(number, kind, F.col("plate").alias("Number Plate"), percent, F.date_format("ts", "HH:mm:ss").alias("Detection Time"))


def two_wheelers_sheet(rows: DataFrame) -> DataFrame:
    """Sheet of two-wheelers from statuses helmet, no_helmet, none and unknown; one without a helmet makes a violation."""
    bad = lambda c: F.col(c) == "no_helmet"
    return rows.select(
        _number(),
        F.coalesce("vehicle_class", F.lit("Bike/Motorcycle")).alias("Vehicle Type"),
        F.coalesce("plate", F.lit(NOT_DETECTED)).alias("Number Plate"),
        F.when(bad("rider_helmet"), "NO HELMET").otherwise("HELMET").alias("Rider Helmet"),
        F.when(bad("pillion_helmet"), "NO HELMET").when(F.col("pillion_helmet") == "helmet", "HELMET").otherwise("None").alias("Pillion Helmet"),
        F.when(bad("rider_helmet") | bad("pillion_helmet"), "VIOLATION").otherwise("COMPLIANT").alias("Verdict"),
    )


def crossings_sheet(rows: DataFrame) -> DataFrame:
    """Sheet of counted vehicles."""
    text = lambda c, default, name: F.coalesce(c, F.lit(default)).alias(name)
    return rows.select(_number(), text("vehicle_class", "Unknown", "Vehicle Type"), text("plate", NOT_DETECTED, "Number Plate"), text("helmet_status", "N/A", "Helmet Status"))


def figures_sheet(log: DataFrame) -> DataFrame:
    """Sheet of a log's figures, unquoted when written."""
    return log.select(*FIGURES)


def write_detailed(rows: DataFrame, path: str) -> None:
    """The table of analysed vehicles as CSV in order of tracks; other columns stay out."""
    rows.orderBy("track_id").select(*DETAILED).write.mode("overwrite").option("header", True).csv(path)


def search(rows: DataFrame, term: str) -> DataFrame:
    """Rows whose plate, track or class holds the term, in any case."""
    t = F.lit(term.lower())
    hit = F.contains(F.lower("plate"), t) | F.contains(F.col("track_id").cast("string"), t) | F.contains(F.lower("vehicle_class"), t)
    return rows.where(hit)


def mode(rows: DataFrame, name: str) -> DataFrame:
    """The table's modes: violations, compliant, two_wheelers, with_plates or all."""
    bad, two = F.col("helmet_status").startswith("VIOLATION"), F.col("helmet_status") != "N/A"
    keep = {"violations": bad, "compliant": two & ~bad, "two_wheelers": two, "with_plates": F.col("plate") != NOT_DETECTED, "all": F.lit(True)}
    return rows.where(keep[name])


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def last_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(F.col(order).desc()).limit(n)


def frame_rate(df: DataFrame, keys: list[str], ts: str, keep: float = 0.9, stretch: int = 3600) -> DataFrame:
    """Smoothed rate of a device: 0.9 of the last and 0.1 of one over the time step; steps of no time are passed over.

    The average depends on all before it, but a stretch of time changes it by
    a factor and a summand, so a device's stretches are folded each in a row of
    its own, and then one after the other.
    """
    t = df.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).distinct()
    t = t.withColumn("stretch", F.floor(F.col("t") / (stretch * 1_000_000)))
    per = t.groupBy(*keys, "stretch").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    before = F.lag(F.element_at("ts", -1)).over(Window.partitionBy(*keys).orderBy("stretch"))
    start = lambda a, b: F.struct(a.alias("factor"), b.alias("sum"), F.col("first").alias("last"))
    def step(a, x):
        dt = (x - a["last"]) / 1e6
        moved = F.struct((a["factor"] * keep).alias("factor"), (a["sum"] * keep + (1 - keep) / dt).alias("sum"), x.alias("last"))
        return F.when(a["last"].isNull() | (dt <= 0), F.struct(a["factor"].alias("factor"), a["sum"].alias("sum"), x.alias("last"))).otherwise(moved)

    per = per.withColumn("first", before).select(*keys, "stretch", F.aggregate("ts", start(F.lit(1.0), F.lit(0.0)), step).alias("f"))
    g = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("stretch", "f.factor", "f.sum"))).alias("s"))
    return g.select(*keys, F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a * x["factor"] + x["sum"]), 6).alias("rate"))


def report_lines(sections: dict[str, DataFrame], generated_at: str) -> DataFrame:
    """A session report as ordered lines (section_no, row_no, line), sections that are not given left out (the counts have a TOTAL).

    A section's rows come in order of their first column as a number, then as text; nulls are empty fields.
    """
    spark = next(iter(sections.values())).sparkSession
    head = [(0, 0, ""), (0, 1, REPORT_TITLE), (0, 2, f"generated_at,{generated_at}"), (0, 3, "")]
    out = spark.createDataFrame(head, "section_no int, row_no long, line string")
    for i, (name, title, columns) in enumerate(SECTIONS, 1):
        if name not in sections:
            continue
        df = sections[name].select(*columns)
        line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
        out = out.unionByName(spark.createDataFrame([(i, 0, f"-- {title} --"), (i, 1, ",".join(columns)), (i, 1 << 40, "")], "section_no int, row_no long, line string"))
        body = numbered(df.select(F.col(columns[0]).try_cast("double").alias("n"), F.col(columns[0]).cast("string").alias("first"), line.alias("line")), ["n", "first", "line"], "place")
        out = out.unionByName(body.select(F.lit(i).alias("section_no"), (F.col("place") + 1).cast("long").alias("row_no"), "line"))
        if name == "counts":
            total = df.agg(F.concat(F.lit("TOTAL,"), F.coalesce(F.sum("count"), F.lit(0)).cast("string")).alias("line"))
            out = out.unionByName(total.select(F.lit(i).alias("section_no"), F.lit((1 << 40) - 1).alias("row_no"), "line"))
    return out


def write_report(lines: DataFrame, path: str) -> None:
    """Text files that are the report when put together in order of their names; each is a range of its lines."""
    lines.orderBy("section_no", "row_no").select("line").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, quoted: bool = False, by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """CSV files with their header; mode "append" adds files to a log, and readers see each header once a file, never as a row."""
    df.write.mode(mode).partitionBy(*by).option("header", True).option("quoteAll", quoted).csv(path)
