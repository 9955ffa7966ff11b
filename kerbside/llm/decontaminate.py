"""Benchmark decontamination with DataFrame functions only.

Words are runs of letters and digits after A-Z are lowered.  Every run of n
words of a benchmark item (the whole item if it is shorter, but not empty) is
a window.  One pass over the documents looks the hash of every window up, for
all lengths that occur, in the broadcast set of the benchmark's hashes (joined
by key beyond a checked size); only the hash and the place of a window travel.
The documents that were hit are then read again, and each hit is compared word
by word before it counts.

A null text has no words; documents and items without words are never hit.
Repeated rows get equal results, one for each.  Null document ids are kept.
Items without an id count as one item, which the digest of ids leaves out.
Other columns are not read.  An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import materialise

WINDOW = 10
#: Hashes of windows, or of documents that were hit, that may be broadcast (8 bytes each); beyond it they are joined by key.
BROADCAST_HASHES = 2_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, SEPARATORS), "")


def bound(value: Column, function) -> Column:
    """``function`` of a costly column that is worked out once, also where the function has lambdas that use it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _hash(hashes: Column, first: Column, length: int | Column) -> Column:
    """The hash of a window of words, from the hashes of all words; first counts from 1."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.xxhash64(F.slice(hashes, first, length), length)


def _word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _windows(hashes: Column, length: int) -> Column:
    """(begin, length, hash) of each window of so many words; an empty array if there is none."""
    at = F.sequence(F.lit(0), F.size(hashes) - length)
    found = F.transform(at, lambda i: F.struct(i.alias("begin"), F.lit(length).alias("length"), _hash(hashes, i + 1, length).alias("hash")))
    return F.when(F.size(hashes) >= length, found).otherwise(F.array().cast("array<struct<begin:int,length:int,hash:bigint>>"))


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(length, hash, item, window) of every distinct window of every item."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).withColumn("size", F.size("w")).where("size > 0")
    b = b.withColumn("length", F.least("size", F.lit(n)))
    at = b.select("item", "w", "length", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)).alias("i"))
    win = F.slice("w", F.col("i"), F.col("length"))
    return at.select("length", _hash(_word_hashes(F.col("w")), F.col("i"), F.col("length")).alias("hash"), "item", win.alias("window")).distinct()


def _known(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows whose key is among the distinct keys, which are broadcast up to a checked size."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_HASHES else keys, name, "left_semi")


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame | None:
    """(h_id, h_hash, found) for each distinct document that was hit; found holds begin, length and hash of its windows.

    begin counts words from 0.  None if the benchmark has no window.
    """
    windows = materialise(windows)
    lengths = [r[0] for r in windows.select("length").distinct().orderBy("length").collect()]  # n of them at most
    if not lengths:
        return None
    # the generator has short columns beside it only: what stands there is copied for every window
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _word_hashes(words(F.col("text"))).alias("hashes"))
    every = F.concat(*[_windows(F.col("hashes"), n) for n in lengths])
    each = d.select("doc_id", "text_hash", F.explode_outer(every).alias("x")).select("doc_id", "text_hash", "x.begin", "x.length", "x.hash")
    hit = materialise(_known(each, windows.select("hash").distinct(), "hash"))
    spelt = windows.select("hash", "length", "window").distinct()
    # a document has as many windows of a length as words at most
    per = hit.join(spelt, ["hash", "length"]).groupBy(F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash")).agg(F.collect_set(F.struct("begin", "length", "hash", "window")).alias("found"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = _known(texts, hit.select("text_hash").distinct(), "text_hash").dropDuplicates(["doc_id", "text_hash"])
    both = texts.join(per, texts["doc_id"].eqNullSafe(per["h_id"]) & (texts["text_hash"] == per["h_hash"]))
    same = bound(words(F.col("text")), lambda w: F.filter("found", lambda x: F.slice(w, x["begin"] + 1, x["length"]) == x["window"]))
    return materialise(both.select("h_id", "h_hash", same.alias("found"))).where(F.size("found") > 0)


def _covered(spans: Column) -> Column:
    """Words covered by sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["begin"], a["to"]))).cast("long").alias("n"), F.greatest(a["to"], s["end"]).alias("to"))
    return F.aggregate(spans, start, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row for each document, with its words, its hit words and the items found in it."""
    windows = materialise(benchmark_windows(benchmark, n))
    found = hits(docs, windows)
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = F.sha2(F.lit(""), 256)
    if found is None:
        return base.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"))
    spans = F.sort_array(F.transform("found", lambda x: F.struct(x["begin"].alias("begin"), (x["begin"] + x["length"]).alias("end"))))
    hit = found.select("h_id", "h_hash", _covered(spans).alias("hit"))
    # a window that stands in a document many times brings its items once
    seen = found.select("h_id", "h_hash", F.explode("found").alias("x")).select("h_id", "h_hash", "x.hash", "x.window").distinct()
    items = seen.join(windows.select("hash", "window", "item"), ["hash", "window"]).groupBy("h_id", "h_hash").agg(F.sort_array(F.collect_set(F.struct("item"))).alias("items"))
    items = items.select(F.col("h_id").alias("i_id"), F.col("h_hash").alias("i_hash"), F.size("items").cast("long").alias("found"), F.sha2(F.concat_ws(",", F.col("items.item")), 256).alias("digest"))
    per = hit.join(items, hit["h_id"].eqNullSafe(items["i_id"]) & (hit["h_hash"] == items["i_hash"]))
    all_ = base.join(per, base["doc_id"].eqNullSafe(per["h_id"]) & (base["text_hash"] == per["h_hash"]), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return all_.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("found", F.lit(0).cast("long")).alias("n_items"), F.coalesce("digest", none).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The documents in which no window occurs, as they were."""
    bad = hits(docs, benchmark_windows(benchmark, n))
    if bad is None:
        return docs
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["h_id"]) & (F.xxhash64(docs["text"]) == bad["h_hash"]), "left_anti")


#: DuckDB's form, with the same words and windows.
CONTAMINATION_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT *, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT n, item_id, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
lens AS (SELECT DISTINCT n FROM wins),
dwins AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lens WHERE len(w) >= n)),
found AS (SELECT DISTINCT r, d.n, i, item_id FROM dwins d JOIN wins USING (n, win)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256 FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
