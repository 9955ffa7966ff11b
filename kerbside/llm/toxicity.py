"""Toxicity: bags of subword embeddings, averaged into a linear softmax.

A word is a run of letters of the lower-cased text, between two marks; its
vector is the mean of the vectors of its n-grams of three to five characters,
which share a table by their hash.  So a misspelt or inflected word that was
never seen has most of its n-grams, and most of its vector, in common with the
word it comes from.  A stretch is STRETCH words in a row (the last two
stretches of a text overlap, so that none is short but in a short text); its
vector is the mean of its words' and goes through a linear softmax over the two
labels.  A text is toxic if one of its stretches is, so a few words weigh the
same in a text of any length: its score is the probability that not all of its
stretches are clean.

Embeddings and softmax are trained together, in numpy, by gradient steps that
are scaled for each coordinate and bounded.  The training rows are a bounded
sample of the labelled ones (see ``labelled_sample``), learned from in one
task; the driver gets only one number for each bucket of the table.

Null and empty texts and texts without letters score 0, and so does every text
if the labels are not of both kinds.  Repeated rows get equal scores.  An id
labelled more than once is toxic if any label says so; null ids and null labels
teach nothing, and a null id is never held out.  Other columns are not read.  A
text's memory is some 200 bytes for each of its characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.language import MARK, held_out, is_letter

BUCKETS = 1 << 17
DIM = 4
SHORTEST, LONGEST = 3, 5
#: Words of a stretch.
STRETCH = 3
#: Labelled rows to learn from, of label 1 and of label 0 (those with the smallest hashes of their ids).
TOXIC, CLEAN = 1_000, 2_000
EPOCHS = 50
RATE = 2.0
#: The share of the first gradients that are not scaled up in full, so that what few rows hold is learned more slowly.
FLOOR = 0.99
#: The longest step of a coordinate.
STEP = 0.25
#: Embeddings begin within this of 0; the log odds of label 0 begin at BEGIN.
SPREAD = 0.01
BEGIN = 4.0
THRESHOLD = 0.3
SEED = 11
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def subwords(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of a text's words, a word after the other, and how many each word has."""
    u = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = np.zeros(len(u) + 2, dtype=bool)
    letter[1:-1] = is_letter()[u]
    if not letter.any():
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    c = np.full(len(letter), MARK, dtype=np.uint64)
    c[1:-1][letter[1:-1]] = u[letter[1:-1]]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one mark after each word
    keep[0] = True
    c, letter = c[keep], letter[keep]
    word = np.cumsum(~letter) - 1  # of a letter its word; of a mark the word after it
    h, inner, found, of = c[:-1] * _A + c[1:], np.ones(len(c) - 1, dtype=bool), [], []
    for n in range(3, LONGEST + 1):
        h = h[:-1] * _A + c[n - 1 :]
        inner = inner[:-1] & letter[n - 2 : -1]  # a mark is only the first or the last of an n-gram
        if n >= SHORTEST:
            at = np.flatnonzero(inner)
            x = (h[at] ^ (h[at] >> np.uint64(29))) * _B
            found.append(((x >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32))
            of.append(word[at])
    of_, ids = np.concatenate(of), np.concatenate(found)
    order = np.argsort(of_, kind="stable")
    return ids[order], np.bincount(of_)


def by_word(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The mean of the values of each word."""
    starts = np.cumsum(sizes) - sizes
    return np.add.reduceat(values, starts, axis=0) / sizes.reshape(-1, *[1] * (values.ndim - 1))


def stretches(n: int, size: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each stretch of n words, and the word after its last."""
    ends = np.append(np.arange(size, n, size), n)
    return np.maximum(ends - size, 0), ends


def by_stretch(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return (sums[end] - sums[first]) / (end - first).reshape(-1, *[1] * (values.ndim - 1))


class Bags:
    """Training texts as distinct words, the words of each stretch, and the stretches of each text."""

    def __init__(self, texts: list[str], buckets: int = BUCKETS) -> None:
        known: dict[bytes, int] = {}
        grams, words, first, end, self.sizes = [], [], [], [], []
        at = 0
        for text in texts:
            ids, sizes = subwords(text, buckets)
            raw, a = ids.tobytes(), 0
            for b in np.cumsum(sizes * ids.itemsize).tolist():
                key, a = raw[a:b], b
                if key not in known:
                    known[key] = len(known)
                words.append(known[key])
            f, e = stretches(len(sizes)) if len(sizes) else (np.zeros(0, np.int64),) * 2
            first.append(f + at)
            end.append(e + at)
            self.sizes.append(len(f))
            at += len(sizes)
        for key in known:
            grams.append(np.frombuffer(key, dtype=np.int32))
        self.grams = np.concatenate(grams) if grams else np.zeros(0, np.int32)
        self.lengths = np.array([len(g) for g in grams], dtype=np.int64)
        self.words = np.array(words, dtype=np.int64)
        self.first, self.end = np.concatenate(first), np.concatenate(end)
        self.sizes = np.array(self.sizes, dtype=np.int64)


def train(
    texts: list[str],
    toxic: np.ndarray,
    buckets: int = BUCKETS,
    dim: int = DIM,
    epochs: int = EPOCHS,
    rate: float = RATE,
    floor: float = FLOOR,
    step: float = STEP,
    seed: int = SEED,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of embeddings, the softmax's weights (a column for each label) and its offsets."""
    bags = Bags(texts, buckets)
    toxic = toxic[bags.sizes > 0]
    sizes = bags.sizes[bags.sizes > 0]
    rng = np.random.default_rng(seed)
    table = rng.uniform(-SPREAD, SPREAD, (buckets, dim)).astype(np.float32)
    weights = rng.uniform(-1, 1, (dim, 2)).astype(np.float32)
    offsets = np.array([BEGIN, 0], dtype=np.float32)
    if not len(sizes):
        return table, weights, offsets
    starts, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    width = bags.end - bags.first
    word_of_gram = np.repeat(np.arange(len(bags.lengths)), bags.lengths)
    order = np.argsort(bags.grams, kind="stable")
    sorted_grams = bags.grams[order]
    heads = np.flatnonzero(np.append(True, sorted_grams[1:] != sorted_grams[:-1]))
    used, by_gram = sorted_grams[heads], word_of_gram[order]
    past = [np.zeros((len(used), dim), np.float32), np.zeros_like(weights), np.zeros_like(offsets)]
    small = None
    for epoch in range(epochs):
        words = by_word(table[bags.grams], bags.lengths)
        z = by_stretch(words[bags.words], bags.first, bags.end)
        logits = z @ weights + offsets
        p = 1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -30, 30)))
        clean = np.exp(np.add.reduceat(np.log1p(-p), starts))  # the probability that no stretch of the text is toxic
        pull = np.where(toxic == 1, clean / np.maximum(1 - clean, 1e-9), -1.0)[doc] * p / len(sizes)
        back = np.stack([pull, -pull], axis=1)  # of the loss by the logits
        d_z = (back @ weights.T) / width[:, None]
        # a word's gradient: the sum over the stretches it is in, by the differences at their ends
        n = len(bags.words)
        steps = [np.bincount(bags.first, d, n + 1) - np.bincount(bags.end, d, n + 1) for d in d_z.T]
        d_word = np.stack([np.bincount(bags.words, np.cumsum(x)[:-1], len(bags.lengths)) for x in steps], axis=1)
        d_word /= bags.lengths[:, None]
        d_table = np.add.reduceat(d_word.astype(np.float32)[by_gram], heads, axis=0)
        if small is None:
            small = float(np.quantile(np.abs(d_table), floor)) + 1e-12
        for i, (x, g) in enumerate([(used, d_table), (slice(None), z.T @ back), (slice(None), back.sum(axis=0))]):
            g = g.astype(np.float32)
            past[i] += g * g
            move = np.clip(rate * g / (np.sqrt(past[i]) + small), -step, step)
            (table, weights, offsets)[i][x] -= (1 - epoch / epochs) * move
    return table, weights, offsets


def folded(table: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, float]:
    """What each bucket adds to the log odds of label 1, and what they begin with; means of vectors are means of these."""
    return (table @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(offsets[1] - offsets[0])


def toxicity(text: str | None, odds: np.ndarray, begin: float) -> float:
    """The probability that a stretch of the text has label 1."""
    ids, sizes = subwords(text, len(odds))
    if not len(sizes):
        return 0.0
    each = np.clip(by_stretch(by_word(odds[ids], sizes), *stretches(len(sizes))) + begin, -50, 50)
    return round(float(-np.expm1(-np.logaddexp(0, each).sum())), 6)


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> DataFrame:
    """(text, toxic) of at most so many labelled rows of each kind that are not held out."""
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("l_id"), "toxic")
    first = [F.xxhash64("l_id"), "l_id"]
    ids = rows.where("toxic = 1").orderBy(*first).limit(toxic).unionByName(rows.where("toxic = 0").orderBy(*first).limit(clean))
    texts = docs.select("doc_id", "text").where("text is not null")
    found = texts.join(F.broadcast(ids), texts["doc_id"] == ids["l_id"]).select("doc_id", "text", "toxic")
    # ids may repeat, so the bound is set again
    first = [F.xxhash64("doc_id"), "doc_id", "text"]
    return found.where("toxic = 1").orderBy(*first).limit(toxic).unionByName(found.where("toxic = 0").orderBy(*first).limit(clean))


def learn(sample: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, float] | None:
    """The folded model of a bounded sample (text, toxic); None if it is not of both kinds."""

    def fit(batches):
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            toxic += batch.column("toxic").to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (texts[i], toxic[i]))  # the same model from any order of rows
        texts, toxic = [texts[i] for i in order], np.array([toxic[i] for i in order])
        if len(set(toxic.tolist())) < 2:
            return
        odds, begin = folded(*train(texts, toxic, buckets))
        yield pa.RecordBatch.from_arrays([pa.array([odds.tobytes()], pa.binary()), pa.array([begin], pa.float64())], ["odds", "begin"])

    got = sample.select("text", "toxic").repartition(1).mapInArrow(fit, "odds binary, begin double").collect()
    return (np.frombuffer(got[0]["odds"], dtype=np.float32), got[0]["begin"]) if got else None


def predict(docs: DataFrame, model: tuple[np.ndarray, float] | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))

    def rate(batches):
        for batch in batches:
            score = [toxicity(t, *model) if model else 0.0 for t in batch.column("text").to_pylist()]
            kind = [int(s >= threshold) for s in score]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array(kind, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(rate, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Learn from the labelled documents that are not held out, and score all of them."""
    return predict(docs, learn(labelled_sample(docs, labels)), threshold)
