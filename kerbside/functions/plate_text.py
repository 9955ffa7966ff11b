"""Number-plate text as column expressions: cleaning, positional correction, recovery."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# State codes, confusions of letters and digits, plate patterns, misread states.
STATES = "AN AP AR AS BH BR CH CG DD DL DN GA GJ HR HP JK JH KA KL LA LD MP MH MN ML MZ NL OD OR PY PB RJ SK TN TS TG TR UP UK UA WB".split()
TO_DIGIT = ("OQDILZSGBATJ", "000112568473")
TO_LETTER = ("012456783", "OIZASGTBE")
STANDARD = "^[A-Z]{2}[0-9]{1,2}[A-Z]{1,3}[0-9]{4}$"
TWO_DIGIT = "^[A-Z]{2}[0-9]{2}[A-Z]{1,3}[0-9]{4}$"
BHARAT = "^[0-9]{2}BH[0-9]{4}[A-HJ-NP-Z]{1,2}$"
BHARAT_MARKS = ["BH", "8H", "B1", "81"]
#: What may become a plate: digits, or letters that pass for them, where digits must stand.
POSSIBLE = f"^..([0-9{TO_DIGIT[0]}].{{1,4}}|({'|'.join(BHARAT_MARKS)}))[0-9{TO_DIGIT[0]}]{{4}}.{{0,3}}$"
MISREAD_STATES = {"MA": "MH", "CQ": "CG", "KB": "KA", "OL": "DL", "QL": "DL"}
PRIOR_STATE = "KA"


def clean(text: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]", "")


def digits(text: Column) -> Column:
    return F.translate(text, *TO_DIGIT)


def letters(text: Column) -> Column:
    return F.translate(text, *TO_LETTER)


def part(text: Column, first: int | Column, length: int | Column) -> Column:
    return F.substr(text, F.lit(first) if isinstance(first, int) else first, F.lit(length) if isinstance(length, int) else length)


def _standard(s: Column) -> Column:
    n, fourth = F.length(s), digits(part(s, 4, 1))
    series = F.when(fourth.rlike("[0-9]"), F.concat(fourth, letters(part(s, 5, n - 8)))).otherwise(letters(part(s, 4, n - 7)))
    states = F.create_map(*[F.lit(x) for pair in MISREAD_STATES.items() for x in pair])
    state = F.coalesce(F.try_element_at(states, letters(part(s, 1, 2))), letters(part(s, 1, 2)))
    return F.concat(state, digits(part(s, 3, 1)), series, digits(part(s, n - 3, 4)))


def _bharat(s: Column) -> Column:
    tail = F.translate(letters(part(s, 9, 3)), "IO", "AA")
    return F.concat(digits(part(s, 1, 2)), F.lit("BH"), digits(part(s, 5, 4)), tail)


def _form(s: Column) -> Column:
    """Cleaned text of 8 to 11 characters with digits and letters where they must stand; null for other lengths.

    The two forms cannot be taken for each other: the third character is a
    digit in one and a B in the other.
    """
    return F.when(F.length(s).between(8, 11), F.when(part(s, 3, 2).isin(BHARAT_MARKS), _bharat(s)).otherwise(_standard(s)))


def _valid(form: Column) -> Column:
    return form.rlike(BHARAT) | (part(form, 1, 2).isin(STATES) & form.rlike(STANDARD))


def _first_valid(candidates: Column) -> Column:
    """The first form of an array of texts that is a plate; the lambda binds a form, so that it is built once.

    Texts that no exchange of letters and digits can make a plate are passed over by one pattern first.
    """
    return F.get(F.filter(F.transform(F.filter(candidates, lambda x: x.rlike(POSSIBLE)), _form), _valid), F.lit(0))


def correct(s: Column) -> Column:
    """A valid plate from cleaned text of 8 to 11 characters by what may stand where, or null."""
    return _first_valid(F.array(s))


def _windows(s: Column, n: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.substr(s, i, F.lit(size)))


def extract(s: Column) -> Column:
    """A valid plate in cleaned text: the whole, else the first of its windows of 10, 9 and 8 characters; or null."""
    n = F.length(s)
    windows = [F.when((n >= w) & (n > 8), _windows(s, n, w)).otherwise(F.array().cast("array<string>")) for w in (10, 9, 8)]
    return F.coalesce(correct(s), _first_valid(F.flatten(F.array(*windows))))


def repair(text: Column) -> Column:
    """A valid plate, also from text with a damaged state or a stray end character; or null."""
    s = clean(text)
    n = F.length(s)
    damaged = ~part(s, 1, 2).isin(STATES) & ((part(s, 1, 1) == "K") | (part(s, 2, 1) == "A"))
    tries = [extract(s), F.when(damaged, extract(F.concat(F.lit(PRIOR_STATE), part(s, 3, 100)))), extract(part(s, 2, 100)), extract(part(s, 1, n - 1))]
    return F.when(n >= 8, F.coalesce(*tries))


def is_valid_length(text: Column) -> Column:
    return F.length(text).between(8, 10)


def is_two_digit(text: Column) -> Column:
    """Whether a text is a standard plate with a district of two digits; false for null."""
    return F.coalesce(text.rlike(TWO_DIGIT), F.lit(False))


def near(a: Column, b: Column, most: int = 2) -> Column:
    """Whether two strings are within an edit distance."""
    return F.levenshtein(a, b, most) >= 0
