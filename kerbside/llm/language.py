"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (one to five
characters of a lower-cased word with a mark at either end), most frequent
first, ties by the n-gram's code.  A document's profile is compared to each
language's by the out-of-place distance; the nearest language wins, ties by its
name.  The code of an n-gram is its characters' numbers, 21 bits each, in one
long; of four or five characters, a 63-bit hash of these below zero.

Learning counts the n-grams of all labelled documents outside the held-out
quarter; only the profiles, some hundred n-grams a language, reach the driver.
A text that is null or has no letter is ``und`` with score 0, and so is every
text if nothing could be learned.  Repeated rows get equal results, a null id
is never held out, other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 300
#: Characters of the longest n-grams that are learned and compared.
LONGEST = 5
UNKNOWN = "und"
MARK = ord("_")
#: Distinct n-grams of documents that a task gathers before it adds them up.
GATHERED = 1_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_letters: list[np.ndarray] = []


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0)) == 2


def is_letter() -> np.ndarray:
    """For every character whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def hashed(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """A code below zero for each n-gram of more than three characters: the first three, and the others."""
    h = head.astype(np.uint64) * _A + tail.astype(np.uint64) * _B
    h = (h ^ (h >> np.uint64(32))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return ((h ^ (h >> np.uint64(32))) | np.uint64(1 << 63)).view(np.int64)


def grams(text: str | None, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a text's n-grams of three (or up to five) characters at most, in order, and how often each occurs."""
    u = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = np.zeros(len(u) + 2, dtype=bool)
    letter[1:-1] = is_letter()[u]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.full(len(letter), MARK, dtype=np.int64)
    c[1:-1][letter[1:-1]] = u[letter[1:-1]]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one mark after each word
    keep[0] = True
    c, letter = c[keep], letter[keep]
    two = (c[:-1] | c[1:] << 21)[letter[:-1] | letter[1:]]
    three, inner = c[:-2] | c[1:-1] << 21 | c[2:] << 42, letter[1:-1]
    found = [c[letter], two, three[inner]]
    for n in range(4, longest + 1):  # inner: all but the two ends are letters
        inner = inner[:-1] & letter[n - 2 : -1]
        at = np.flatnonzero(inner)
        found.append(hashed(three[at], c[at + 3] if n == 4 else c[at + 3] | c[at + 4] << 21))
    return np.unique(np.concatenate(found), return_counts=True)


def profile(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.lexsort((codes, -counts))][:size]


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(all_, kind="stable")
    all_, n = all_[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]]))
    return all_[first], np.add.reduceat(n, first)


def learn(docs: DataFrame, size: int = PROFILE, longest: int = LONGEST) -> dict[str, np.ndarray]:
    """The profile of each language of the rows of ``docs`` with text and lang."""

    def count(batches):
        parts: dict[str, tuple[list, list]] = {}
        held = 0

        def rows():
            for lang, (codes, n) in parts.items():
                a, b = _summed(codes, n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(b)], ["lang", "gram", "n"])

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                a, b = grams(text, longest)
                if len(a):
                    codes, n = parts.setdefault(lang, ([], []))
                    codes.append(a)
                    n.append(b)
                    held += len(a)
                if held > GATHERED:
                    for k, (codes, n) in parts.items():
                        a, b = _summed(codes, n)
                        parts[k] = ([a], [b])
                    held = 0
        yield from rows()

    sums = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    top = sums.withColumn("rank", rank).where(F.col("rank") <= size).collect()
    found: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(codes, dtype=np.int64) for lang, codes in found.items()}


def nearest(text: str | None, sorted_: dict[str, tuple[np.ndarray, np.ndarray]], size: int = PROFILE, longest: int = 3) -> tuple[str, float]:
    """The language of a text, and how near its profile comes: 1 if it is the language's own, 0 if nothing is shared."""
    own = profile(*grams(text, longest), size)
    if not len(own) or not sorted_:
        return UNKNOWN, 0.0
    place, best = np.arange(len(own)), None
    for lang, (codes, ranks) in sorted_.items():
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        far = int(np.where(codes[at] == own, np.abs(place - ranks[at]), size).sum())
        if best is None or (far, lang) < best:
            best = (far, lang)
    return best[1], round(1 - best[0] / (size * len(own)), 6)


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE, longest: int = LONGEST) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row."""
    sorted_ = {lang: (np.sort(p), np.argsort(p, kind="stable")) for lang, p in profiles.items()}

    def guess(batches):
        for batch in batches:
            got = [nearest(t, sorted_, size, longest) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return docs.mapInArrow(guess, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, size: int = PROFILE, longest: int = LONGEST) -> DataFrame:
    """Learn from the documents that are not held out, and predict all of them."""
    return predict(docs, learn(docs.where(~held_out(F.col("doc_id"))), size, longest), size, longest)
