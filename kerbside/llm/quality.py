"""Quality classifier: importance resampling over hashed n-grams.

Two generative models, of the target text (labelled good) and of the raw text
(all documents), give each word, pair of words and mark a probability by its
hash bucket.  A document's log importance weight is the sum over its n-grams
of log(target / raw), brought to a standard length (the mean times STANDARD),
so that length alone neither dooms nor saves a document.  Adding Gumbel noise, drawn from the document itself,
and keeping the k largest is sampling without replacement in proportion to
the weights.

The target is learned from a bounded sample of the labelled documents; the raw
model and all sums cover every document.  k is the number of documents whose
weight reaches the level that best parts the labelled sample, unless it is
given.  Null texts and texts without n-grams have weight 0 and count as
rejected when k is found from labels.  The noise is drawn from doc_id and text,
so repeated rows tie: ties at the k-th place are broken by doc_id, and rows
equal in both are kept together, as long as k allows.  Without labels of both
kinds every document is kept.  Null ids have no label.  Columns other than
those named are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import materialise

BUCKETS = 10_000
#: N-grams of a document of standard length.
STANDARD = 200
#: Labelled documents from which the target is learned (those with the smallest hashes of their ids).
LABELLED = 20_000
SMOOTHING = 1.0
SEED = 17
#: Bins of one pass of the search for the k-th largest key.
BINS = 4_096
#: Word hashes that a worker remembers.
MEMO_WORDS = 300_000
_memo: dict[str, int] = {}
_patterns: list = []


def _hash(word: str) -> int:
    h = _memo.get(word)
    if h is None:
        if len(_memo) >= MEMO_WORDS:
            _memo.clear()
        h = _memo[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return h


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of a text's words, marks and pairs, repeats included.

    A pair of equal words is the pair of the mark "same", whichever word it is.
    """
    if not _patterns:
        import regex

        _patterns.append(regex.compile(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"))
    words = _patterns[0].findall(text.lower()) if text else []
    h = np.fromiter(map(_hash, words), dtype=np.uint64, count=len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(24)
    pairs[h[:-1] == h[1:]] = 0
    return np.concatenate([h, pairs]).astype(np.uint64) % np.uint64(buckets)


def labelled_sample(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, good) of a bounded number of labelled documents."""
    good = F.col("quality") == 1
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(good.cast("int")).alias("good"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("l_id"), "good")


def with_labels(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, text and good (null if not in the sample); the sample's size is bounded, so it is broadcast."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return docs.join(F.broadcast(sample), docs["doc_id"] == sample["l_id"], "left").select("doc_id", "text", "text_hash", "good")


def learn(labelled: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of each bucket: a row for the raw text, a row for the target."""

    def count(batches):
        sums = np.zeros((2, buckets), dtype=np.int64)
        for batch in batches:
            for text, good in zip(batch.column("text").to_pylist(), batch.column("good").to_pylist()):
                c = np.bincount(features(text, buckets).astype(np.int64), minlength=buckets)
                sums[0] += c
                if good == 1:
                    sums[1] += c
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.array(sums[0]), pa.array(sums[1])], ["bucket", "raw", "target"])

    got = labelled.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    sums = np.zeros((2, buckets))
    for i, name in enumerate(("raw", "target")):
        sums[i, got.column("bucket").to_numpy()] = got.column(name).to_numpy()
    return sums


def log_p(counts: np.ndarray) -> np.ndarray:
    return np.log(counts + SMOOTHING) - np.log(counts.sum() + SMOOTHING * len(counts))


def gumbel(doc_id, text: str | None, seed: int = SEED) -> float:
    """Noise that depends on the row alone."""
    import xxhash

    u = (xxhash.xxh64_intdigest(f"{doc_id}\0{text or ''}".encode("utf-8", "surrogatepass"), seed) + 0.5) / 2**64
    return -math.log(-math.log(min(max(u, 1e-300), 1 - 1e-16)))


def without_own(f: np.ndarray, counts: np.ndarray, raw: np.ndarray) -> float:
    """The log weight of a document that was counted in the target, as if it had not been."""
    own, n = np.unique(f, return_counts=True)
    p = np.log(counts[own] - n + SMOOTHING) - np.log(counts.sum() - len(f) + SMOOTHING * len(counts))
    return float((n * (p - raw[own])).sum() / max(1, len(f)) * STANDARD)


def score(labelled: DataFrame, counts: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, good, n_grams, log_weight, key (the weight with noise) and fair (the weight by the other documents)."""
    buckets, raw = counts.shape[1], log_p(counts[0])
    ratio = log_p(counts[1]) - raw

    def weigh(batches):
        for batch in batches:
            n, w, k, fair = [], [], [], []
            for doc_id, text, good in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "text", "good"))):
                f = features(text, buckets)
                n.append(len(f))
                w.append(round(float(ratio[f].sum() / max(1, len(f)) * STANDARD), 6))
                k.append(round(w[-1] + gumbel(doc_id, text, seed), 6))
                fair.append(without_own(f, counts[1], raw) if good == 1 else w[-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), batch.column("good"), pa.array(n, pa.int64()), pa.array(w, pa.float64()), pa.array(k, pa.float64()), pa.array(fair, pa.float64())], ["doc_id", "text_hash", "good", "n_grams", "log_weight", "key", "fair"])

    kind = labelled.schema["doc_id"].dataType.simpleString()
    return labelled.mapInArrow(weigh, f"doc_id {kind}, text_hash long, good int, n_grams long, log_weight double, key double, fair double")


def level(scored: DataFrame) -> float | None:
    """The weight that best parts the labelled sample: most good ones kept and bad ones rejected, in shares."""
    rows = scored.where("good is not null").select("fair", "good").toArrow()  # the bounded sample
    w, good = rows.column("fair").to_numpy(), rows.column("good").to_numpy() == 1
    if not good.any() or good.all():
        return None
    order = np.argsort(w, kind="stable")
    w, good = w[order], good[order]
    # keeping w[i:]: good ones kept less bad ones kept
    gain = np.cumsum(~good)[:-1] / (~good).sum() - np.cumsum(good)[:-1] / good.sum()
    cuts = np.flatnonzero(w[1:] > w[:-1])
    if not len(cuts):
        return None
    i = cuts[np.argmax(gain[cuts])]
    return float((w[i] + w[i + 1]) / 2)


def kth_largest(keys: DataFrame, k: int) -> tuple[float, int]:
    """The k-th largest key, and how many are larger: histograms of ever smaller spans, a few numbers for each bin."""
    lo, hi, above = *keys.agg(F.min("key"), F.max("key")).first(), 0
    while lo < hi:
        width = (hi - lo) / BINS
        at = F.least(F.floor((F.col("key") - lo) / width), F.lit(BINS - 1))
        bins = keys.where((F.col("key") >= lo) & (F.col("key") <= hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        for b in sorted(bins.collect(), key=lambda b: -b["bin"]):
            if above + b["n"] >= k:
                if (b["lo"], b["hi"]) == (lo, hi):
                    raise ArithmeticError("keys too close to be parted")
                lo, hi = b["lo"], b["hi"]
                break
            above += b["n"]
    return lo, above


def decide(docs: DataFrame, labels: DataFrame, k: int | None = None, buckets: int = BUCKETS, labelled: int = LABELLED) -> DataFrame:
    """doc_id, text_hash, n_grams, log_weight, key and keep for each row of ``docs``."""
    with_ = with_labels(docs, materialise(labelled_sample(labels, labelled)))
    scored = materialise(score(with_, learn(with_, buckets)))
    out = scored.select("doc_id", "text_hash", "n_grams", "log_weight", "key")
    if k is None:
        at = level(scored)
        if at is None:
            return out.withColumn("keep", F.lit(True))
        k = scored.where((F.col("log_weight") >= at) & (F.col("n_grams") > 0)).count()
        out = out.withColumn("key", F.when(F.col("n_grams") > 0, F.col("key")).otherwise(F.lit(-1e300)))
    n = scored.count()
    if k <= 0 or k >= n:
        return out.withColumn("keep", F.lit(k > 0))
    least, above = kth_largest(out, k)
    # of those at the k-th place itself, the first by doc_id
    tied = out.where(F.col("key") == least).groupBy("doc_id").count().orderBy("doc_id").limit(k - above).collect()
    room, chosen = k - above, []
    for r in tied:
        if r["count"] <= room:
            chosen.append(r["doc_id"])
            room -= r["count"]
    same = F.lit(False)
    for d in chosen:
        same = same | F.col("doc_id").eqNullSafe(F.lit(d))
    return out.withColumn("keep", (F.col("key") > least) | ((F.col("key") == least) & same))


def classify(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, n_grams, log_weight, key and keep for each row of ``docs``."""
    return decide(docs, labels, k).drop("text_hash")


def good_documents(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, as they were."""
    bad = decide(docs, labels, k).where("not keep").select(F.col("doc_id").alias("b_id"), F.col("text_hash").alias("b_hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["b_id"]) & (F.xxhash64(docs["text"]) == bad["b_hash"]), "left_anti")
