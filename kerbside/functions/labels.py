"""Class names, demographic labels and small text functions as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical vehicle classes, their reporting classes, and model names for them.
CANONICAL = ["car", "truck", "bus", "auto-rickshaw", "motorcycle", "scooter", "bicycle", "van"]
REPORTING = {
    "car": "Car",
    "motorcycle": "Bike/Motorcycle",
    "scooter": "Bike/Motorcycle",
    "bus": "Bus",
    "truck": "Truck",
    "auto-rickshaw": "Auto Rickshaw",
    "bicycle": "Bicycle",
    "van": "Van",
}
MODEL_NAMES = {
    "three-wheeler": "auto-rickshaw",
    "two-wheeler": "motorcycle",
    "hatchback": "car",
    "sedan": "car",
    "suv": "car",
    "muv": "car",
    "bus": "bus",
    "mini-bus": "bus",
    "tempo-traveller": "bus",
    "truck": "truck",
    "lcv": "truck",
    "van": "van",
    "bicycle": "bicycle",
    "others": "car",
    "auto": "auto-rickshaw",
    "autorickshaw": "auto-rickshaw",
    "rickshaw": "auto-rickshaw",
    "bike": "motorcycle",
    "motorbike": "motorcycle",
}
COCO_IDS = {1: "bicycle", 2: "car", 3: "motorcycle", 5: "bus", 7: "truck"}
PLATE_CLASSES = ["car", "truck", "bus", "auto-rickshaw", "motorcycle", "scooter"]
NO_PLATE_CLASSES = ["bicycle"]
CROP_PASS_CLASSES = ["motorcycle", "scooter", "auto-rickshaw", "bike/motorcycle", "bike"]
TWO_WHEELER_WORDS = "bike|motorcycle|scooter|two-wheeler|two_wheeler|moped"
SMALL_VEHICLE_WORDS = "bike|motorcycle|scooter|two-wheeler|bicycle|auto|rickshaw|three-wheeler"
HELMET_NAMES = {
    "with helmet": "helmet",
    "without helmet": "no_helmet",
    "with_helmet": "helmet",
    "without_helmet": "no_helmet",
    "helmet": "helmet",
    "no_helmet": "no_helmet",
    "head": "no_helmet",
}
OTHERS = "Others"


def mapping(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def normal_name(name: Column) -> Column:
    return F.trim(F.replace(F.lower(name), F.lit("_"), F.lit("-")))


def canonical_class(name: Column, class_id: Column | None = None) -> Column:
    """The canonical class of a model's name, else of its class id, else null."""
    n = normal_name(name)
    found = [mapping(MODEL_NAMES)[n], F.when(n.isin(CANONICAL), n)]
    if class_id is not None:
        found.append(mapping(COCO_IDS)[class_id.cast("int")])
    return F.coalesce(*found)


def reporting_class(raw: Column) -> Column:
    return F.coalesce(mapping(REPORTING)[raw], F.lit(OTHERS))


def is_two_wheeler(name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(name)).rlike(TWO_WHEELER_WORDS), F.lit(False))


def is_small_vehicle(name: Column) -> Column:
    """Vehicles whose riders sit in the open; an unknown class counts as one."""
    n = F.coalesce(F.lower(F.trim(name)), F.lit(""))
    return n.rlike(SMALL_VEHICLE_WORDS) | (n == "")


def helmet_class(name: Column) -> Column:
    """The mapped head class, or the name itself."""
    n = F.lower(name)
    return F.coalesce(mapping(HELMET_NAMES)[n], n)


def is_no_helmet(name: Column) -> Column:
    return helmet_class(name).rlike("no_helmet|without_helmet|head")


def demographic(label: Column, confidence: Column, least: float = 0.5, height: Column | None = None, adult_height: Column | None = None, child_ratio: float = 0.6) -> Column:
    """child, female_adult, male_adult or unknown; heights, where given, may turn an uncertain label into child."""
    n = F.lower(F.trim(label))
    out = F.when(confidence < least, "unknown").when(n.rlike("child|kid"), "child").when(n.rlike("female|woman|girl"), "female_adult").when(n.rlike("male|man|boy"), "male_adult").otherwise("unknown")
    if height is not None:
        small = (confidence < least) & (adult_height > 0) & (height < adult_height * child_ratio)
        out = F.when(small, "child").otherwise(out)
    return out


def evaluation_label(label: Column) -> Column:
    """male, female or unknown."""
    n = F.lower(F.trim(label))
    return F.when(n.isin("male", "male_adult", "man", "boy"), "male").when(n.isin("female", "female_adult", "woman", "girl"), "female").otherwise("unknown")


def track_of_file(name: Column) -> Column:
    """The track number in a crop's file name, or -1."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"_t(\d+)_", 1), F.lit("")).cast("long"), F.lit(-1).cast("long"))


def run_folder(ts: Column) -> Column:
    """The folder of a run that begins at a time, to the second."""
    return F.date_format(ts, "'run_'yyyyMMdd_HHmmss")


def percent_text(share: Column) -> Column:
    return F.concat(F.bround(share * 100, 1).cast("string"), F.lit("%"))


def share_of_text(text: Column) -> Column:
    """A confidence in 0..1 from '88.0%', '0.88' or '88'."""
    x = F.regexp_replace(text, "[%\\s]", "").try_cast("double")
    return F.when(x > 1, x / 100).otherwise(x)


def title(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def half_up(x: Column) -> Column:
    """Rounding with halves up, as dashboards do."""
    return F.floor(x + 0.5).cast("long")
