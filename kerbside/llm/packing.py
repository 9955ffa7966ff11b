"""Packing: windows of a fixed length, filled by deficit round-robin over sources.

Each source is a queue of token ids.  In every round a source's deficit grows
by its share of the window and shrinks by what it sends.  Served one id at a
time, this is a merge of the queues by virtual time: the i-th id of a source
with weight p is due at (i + 1/2) / p.  The ids due first fill window 0, the
next window 1, and so on, so a deficit never exceeds one id for long, and the
state that a window carries into the next (what each queue has sent so far)
can be computed for any window alone.  Every partition therefore starts with
the exact deficits that the partitions before it would have handed over, with
no pass in order over the windows.  A source that runs dry leaves the rounds,
and the others keep their proportions.

Null texts count as empty (their end id is packed); a null source is a queue
of its own; repeated rows are packed as often as they occur; the order in a
queue is the order of the input's partitions.  An empty table gives no rows.
Columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.bpe import encoder, in_groups
from kerbside.llm.common import materialise

WINDOW = 2048
TOKEN_SCHEMA = "part int, queue string, queue_before long, doc_id long, ids binary"
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
ROWS_PER_BATCH = 2_000
#: Up to so many rows (one for each write task and source, under 100 bytes each) the queues' bases are broadcast; beyond it they are joined by key.
BROADCAST_ROWS = 500_000


class Mixture:
    """What each queue has sent before any window, for queue lengths and weights."""

    def __init__(self, lengths: list[int], weights: list[float], window: int):
        self.n = np.asarray(lengths, dtype=np.int64)
        self.p = np.asarray(weights, dtype=np.float64)
        if len(self.n) and not ((self.p > 0).all() and np.isfinite(self.p).all()):
            raise ValueError("weights must be positive")
        self.window, self.total = window, int(self.n.sum())
        # ids sent by virtual time t: the sum of min(n, t p), a line between the times at which queues run dry
        dry = np.unique(np.concatenate([[0.0], self.n / self.p])) if len(self.n) else np.zeros(1)
        self.times, self.sent = dry, np.array([np.minimum(self.n, t * self.p).sum() for t in dry])

    def before(self, windows: np.ndarray) -> np.ndarray:
        """A row for each window: ids that each queue has sent before it."""
        want = np.minimum(np.asarray(windows, dtype=np.int64) * self.window, self.total)
        n, p, inf = self.n[None, :], self.p[None, :], np.inf
        t = np.interp(want.astype(np.float64), self.sent, self.times)
        c = np.clip(np.floor(t[:, None] * p + 0.5).astype(np.int64), 0, n)
        rows = np.arange(len(want))
        due = lambda i: np.where(i < n, (i + 0.5) / p, inf)  # noqa: E731  of the next id
        last = lambda i: np.where(i > 0, (i - 0.5) / p, -inf)  # noqa: E731  of the last id sent

        def newest(i):  # among equals the later queue
            x = last(i)
            return x.shape[1] - 1 - np.argmax(x[:, ::-1], axis=1)

        while len(rows):
            over = c.sum(axis=1) - want
            nxt, lst = due(c), last(c)
            a, b = np.argmin(nxt, axis=1), newest(c)
            first, final = nxt[rows, a], lst[rows, b]
            swap = (over == 0) & ((first < final) | ((first == final) & (a < b)))
            add, cut = (over < 0) | swap, (over > 0) | swap
            if not (add | cut).any():
                break
            c[rows[add], a[add]] += 1
            c[rows[cut], b[cut]] -= 1
        return c


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Ids of each document as 16-bit units, with its place in its source's queue within its part."""

    def encode(batches):
        from pyspark import TaskContext

        part, sent, end = TaskContext.get().partitionId(), {}, int(end_id).to_bytes(2, "little")
        enc = encoder(tokenizer_path)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            keys, queues = batch.column("doc_id").to_pylist(), batch.column("source").to_pylist()
            for s in in_groups(texts):
                ids = [x + end for x in enc.encode(texts[s])]
                before = []
                for q, x in zip(queues[s], ids):
                    before.append(sent.get(q, 0))
                    sent[q] = before[-1] + len(x) // 2
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(queues[s], pa.string()), pa.array(before, pa.int64()), pa.array(keys[s], pa.int64()), pa.array(ids, pa.binary())], ["part", "queue", "queue_before", "doc_id", "ids"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    return materialise(narrow.mapInArrow(encode, TOKEN_SCHEMA))


def cut(at: np.ndarray, lengths: np.ndarray, queue: int, mix: Mixture) -> np.ndarray:
    """Windows that some id at these places of a queue may fall into (and the one after them)."""
    slack, p = len(mix.n) + 2, mix.p[queue]
    near = np.interp(np.array([at.min(), (at + lengths).max()]) / p, mix.times, mix.sent)
    return np.arange(max(0, int((near[0] - slack) // mix.window)), int((near[1] + slack) // mix.window) + 3)


def pieces_of(at: np.ndarray, lengths: np.ndarray, group: np.ndarray, queue: np.ndarray, mix: Mixture):
    """(document, start, length, window, offset) of every piece of a batch.

    at: the place of each document's first id in its queue; group: documents
    of equal group stand near each other in their queue.
    """
    groups = [np.flatnonzero(group == g) for g in np.unique(group)]
    windows = np.unique(np.concatenate([cut(at[g], lengths[g], queue[g[0]], mix) for g in groups]))
    c = mix.before(windows)
    held = np.diff(c, axis=0, append=c[-1:])
    inside = np.cumsum(held, axis=1) - held  # where a queue's ids begin in the window; meaningless before a gap, and not used there
    out = []
    for g in groups:
        q = queue[g[0]]
        g = g[np.argsort(at[g])]
        starts, ends, bounds = at[g], at[g] + lengths[g], c[:, q]
        points = np.unique(np.concatenate([starts, ends, bounds[(bounds > starts[0]) & (bounds < ends[-1])]]))
        begin, length = points[:-1], np.diff(points)
        d = np.searchsorted(starts, begin, "right") - 1
        real = begin < ends[d]
        begin, length, d = begin[real], length[real], d[real]
        w = np.searchsorted(bounds, begin, "right") - 1
        out.append(np.stack([g[d], begin - starts[d], length, windows[w], inside[w, q] + begin - bounds[w]]))
    return np.concatenate(out, axis=1)


def pack(docs: DataFrame, tokenizer_path: str, weights: dict[str | None, float] | None = None, window: int = WINDOW, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document.

    weights: the wanted share of each source in every window, a positive
    number for each source that occurs (null included, as None); by default
    the sources' own shares of all ids, so that every window mirrors the whole
    corpus.  with_ids adds the ids of the piece (binary, 16-bit units).  The
    totals of each source, one number each, are all that the driver sees.
    """
    tokens = tokenise(docs, tokenizer_path, end_id)
    sums = tokens.groupBy("part", "queue").agg(F.sum(F.length("ids") / 2).cast("long").alias("n"))
    sums = materialise(sums)  # a row for each write task and source
    totals = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    queues = sorted(totals, key=lambda x: (x is not None, x or ""))
    missing = [q for q in queues if weights is not None and q not in weights]
    if missing:
        raise ValueError(f"no weight for {missing[:5]}")
    number = {q: i for i, q in enumerate(queues)}
    mix = Mixture([totals[q] for q in queues], [totals[q] if weights is None else weights[q] for q in queues], window)
    if not queues:
        return tokens.sparkSession.createDataFrame([], PIECE_SCHEMA + ", ids binary" * with_ids)
    w = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", "queue", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    small = sums.count() <= BROADCAST_ROWS
    base = base.select(F.col("part").alias("b_part"), F.col("queue").alias("b_queue"), "base")
    placed = tokens.join(F.broadcast(base) if small else base, (F.col("part") == F.col("b_part")) & F.col("queue").eqNullSafe(F.col("b_queue")))
    placed = placed.select("part", "queue", (F.col("base") + F.col("queue_before")).alias("at"), "doc_id", "ids")

    def cut_up(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS_PER_BATCH):
                batch = whole.slice(i, ROWS_PER_BATCH)
                names, keys = batch.column("queue").to_pylist(), batch.column("doc_id").to_pylist()
                ids = [np.frombuffer(x, dtype="<u2").astype("<u4") for x in batch.column("ids").to_pylist()]
                lengths = np.array([len(x) for x in ids], dtype=np.int64)
                queue = np.array([number[q] for q in names])
                group = batch.column("part").to_numpy().astype(np.int64) * len(number) + queue
                doc, start, length, seq, offset = pieces_of(batch.column("at").to_numpy(), lengths, group, queue, mix)
                d, a, n = doc.tolist(), start.tolist(), length.tolist()
                crc = [zlib.crc32(ids[x][y : y + z].data) for x, y, z in zip(d, a, n)]
                cols = [pa.array([keys[x] for x in d], pa.int64()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(lengths[doc]), pa.array(seq), pa.array(offset), pa.array([names[x] for x in d], pa.string())]
                if with_ids:
                    cols.append(pa.array([ids[x][y : y + z].astype("<u2").tobytes() for x, y, z in zip(d, a, n)], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", *["ids"] * with_ids])

    return placed.mapInArrow(cut_up, PIECE_SCHEMA + ", ids binary" * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed windows themselves, from ``pack(..., with_ids=True)``: sequence_id, n_tokens, ids, doc_ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    w = pieces.groupBy("sequence_id").agg(ordered.alias("p"))  # at most a window of ids in a group
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda x, y: F.concat(x, y["ids"]))
    return w.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda x, y: x + y["length"]).alias("n_tokens"), joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"))
