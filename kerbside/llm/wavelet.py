"""Token-ID output: a wavelet matrix for each shard of token ids.

A shard is one byte string.  Each bit of the ids (most significant first) is a
plane; a plane is cut into chunks of 32,768 bits, each compressed by itself
where that makes it smaller.  The header holds the planes' numbers of zeros
and, for each chunk, the ones before it and where it ends.  ``WaveletMatrix``
reads the header and answers access, rank, count and select by inflating the
few chunks that a question touches, without the ids beside it.

Null texts count as empty; an empty document has its end id alone.  Repeated
rows are kept, one result row for each.  Documents without an id come first.
Other columns of the input are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.bpe import encoder, in_groups
from kerbside.llm.common import materialise

MAGIC = b"KWM2"
HEADER = struct.Struct("<4sQB")
#: Bits of a chunk, and inflated chunks that a reader keeps.
CHUNK, KEPT = 1 << 15, 256
#: A shard is closed when it holds this many ids (a longer document is a shard of its own).
SHARD_TOKENS = 1_000_000
SHARD_COLUMNS = ["part", "shard", "before", "doc_ids", "lengths", "n_tokens", "data"]
SHARD_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
#: ``before`` counts the ids of the part's earlier shards.
SHARD_SCHEMA = "part int, shard int, before long, doc_ids array<bigint>, lengths array<bigint>, n_tokens long, data binary"


def build(ids: np.ndarray) -> bytes:
    """The shard's bytes for ids below 65,536."""
    ids = np.asarray(ids, dtype=np.uint16)
    n = len(ids)
    bits = max(1, int(ids.max()).bit_length()) if n else 1
    chunks = -(-max(n, 1) // CHUNK)
    zeros, before, stored = [], np.zeros((bits, chunks), dtype="<u8"), []
    plane = np.zeros(chunks * (CHUNK // 8), dtype=np.uint8)
    for level, b in enumerate(range(bits - 1, -1, -1)):
        bit = (ids & np.uint16(1 << b)) != 0
        packed = np.packbits(bit, bitorder="little")
        plane[: len(packed)] = packed
        ones = np.bitwise_count(plane.view("<u8")).reshape(chunks, -1).sum(axis=1, dtype=np.int64)
        before[level, 1:] = np.cumsum(ones)[:-1]
        zeros.append(n - int(ones.sum()))
        for k in range(chunks):
            raw = packed[k * (CHUNK // 8) : (k + 1) * (CHUNK // 8)].tobytes()
            small = zlib.compress(raw, 1)
            stored.append(small if len(small) < len(raw) else raw)
        ids = np.concatenate([ids.take(np.flatnonzero(~bit)), ids.take(np.flatnonzero(bit))])
    ends = np.cumsum([len(x) for x in stored]).astype("<u8")
    return b"".join([HEADER.pack(MAGIC, n, bits), np.array(zeros, dtype="<u8").tobytes(), before.tobytes(), ends.tobytes(), *stored])


class WaveletMatrix:
    """Rank and select over one shard; chunks are inflated as they are needed."""

    def __init__(self, data: bytes):
        magic, self.n, self.bits = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        self.chunks = -(-max(self.n, 1) // CHUNK)
        table = np.frombuffer(data, dtype="<u8", offset=HEADER.size, count=self.bits * (1 + 2 * self.chunks)).astype(np.int64)
        self.zeros = table[: self.bits].tolist()
        self.before = table[self.bits : self.bits * (1 + self.chunks)].reshape(self.bits, self.chunks)
        start = HEADER.size + 8 * self.bits * (1 + 2 * self.chunks)
        self.at = np.concatenate([[0], table[self.bits * (1 + self.chunks) :]]) + start
        self.data, self.kept = memoryview(data), OrderedDict()

    def inflated(self, level: int, k: int) -> bytes:
        i = level * self.chunks + k
        raw = self.data[self.at[i] : self.at[i + 1]]
        size = -(-min(CHUNK, self.n - k * CHUNK) // 8)
        return bytes(raw) if len(raw) == size else zlib.decompress(raw)

    def _chunk(self, level: int, k: int) -> np.ndarray:
        """The bytes of a chunk; the ones used last are kept."""
        if (level, k) in self.kept:
            self.kept.move_to_end((level, k))
        else:
            self.kept[level, k] = np.frombuffer(self.inflated(level, k), dtype=np.uint8)
            if len(self.kept) > KEPT:
                self.kept.popitem(last=False)
        return self.kept[level, k]

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i <= 0:
            return 0
        k, rest = divmod(i, CHUNK)
        if k == self.chunks:
            return self.n - self.zeros[level]
        ones = int(self.before[level, k])
        if rest:
            chunk = self._chunk(level, k)
            ones += int(np.bitwise_count(chunk[: rest // 8]).sum())
            ones += (int(chunk[rest // 8]) & ((1 << (rest % 8)) - 1)).bit_count() if rest % 8 else 0
        return ones

    def _select(self, level: int, one: int, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a plane."""
        before = self.before[level] if one else np.arange(self.chunks) * CHUNK - self.before[level]
        chunk = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self._chunk(level, chunk), count=min(CHUNK, self.n - chunk * CHUNK), bitorder="little")
        return chunk * CHUNK + int(np.flatnonzero(bits == one)[k - int(before[chunk])])

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            k, rest = divmod(i, CHUNK)
            bit = int(self._chunk(level, k)[rest // 8] >> (rest % 8)) & 1
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often a token stands among the first i ids."""
        lo, hi = self._range(token, min(i, self.n))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence (from 0) of a token."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            at = self._select(level, one, at - self.zeros[level] if one else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def all(self) -> np.ndarray:
        """Every id in order, read from the last plane up to the first."""
        n = self.n
        value = np.zeros(n, dtype=np.uint16)
        for level in range(self.bits - 1, -1, -1):
            plane = np.frombuffer(b"".join(self.inflated(level, k) for k in range(self.chunks)), dtype=np.uint8) if n else np.zeros(0, np.uint8)
            bit = np.unpackbits(plane, count=n, bitorder="little").view(bool)
            up, zeros = np.empty(n, dtype=np.uint16), self.zeros[level]
            up[np.flatnonzero(~bit)] = value[:zeros]
            up[np.flatnonzero(bit)] = value[zeros:] | np.uint16(1 << (self.bits - 1 - level))
            value = up
        return value


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each shard, in ascending doc_id order over (part, shard).

    Texts are dealt by ranges of doc_id; within a range they are encoded in
    order and closed into shards of a bounded number of ids.  Documents without
    an id have shards of their own.
    """

    def encode(batches):
        from pyspark import TaskContext

        part, shard, before, ids, lens, parts, size = TaskContext.get().partitionId(), 0, 0, [], [], [], 0
        end = b"" if end_id is None else int(end_id).to_bytes(2, "little")

        def row():
            flat = np.frombuffer(b"".join(parts), dtype="<u2")
            one = [[part], [shard], [before], [ids], [lens], [len(flat)], [build(flat)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, SHARD_TYPES)], SHARD_COLUMNS)

        enc = encoder(tokenizer_path)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            keys = batch.column("doc_id").to_pylist()
            for s in in_groups(texts):
                for key, packed in zip(keys[s], enc.encode(texts[s])):
                    packed += end
                    if parts and (size + len(packed) // 2 > shard_tokens or (key is None) != (ids[-1] is None)):
                        yield row()
                        shard, before, ids, lens, parts, size = shard + 1, before + size, [], [], [], 0
                    ids.append(key)
                    lens.append(len(packed) // 2)
                    parts.append(packed)
                    size += len(packed) // 2
        if parts:
            yield row()

    dealt = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialise(ordered.mapInArrow(encode, SHARD_SCHEMA))


def read_documents(shards: DataFrame) -> DataFrame:
    """One row for each document, from the shards: doc_id, start, n_tokens, ids_crc32."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row for each write task
    base, at = [], 0
    for r in totals:
        base.append((r["part"], at))
        at += r["n"]
    bases = F.broadcast(shards.sparkSession.createDataFrame(base, "part int, part_start long"))
    placed = shards.join(bases, "part").select("doc_ids", "lengths", "data", (F.col("part_start") + F.col("before")).alias("shard_start"))

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lens, data, start = (batch.column(k)[i].as_py() for k in range(4))
                flat = WaveletMatrix(data).all().astype("<u4")
                lens = np.asarray(lens, dtype=np.int64)
                ends = np.cumsum(lens)
                firsts = ends - lens
                crc = [zlib.crc32(flat[a:b].data) for a, b in zip(firsts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(firsts + start), pa.array(lens), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """(doc_id, place) of every occurrence of a token, the place counted within its document, by rank and select in each shard."""

    def find(batches):
        for batch in batches:
            for ids, lens, data in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "lengths", "data"))):
                at = np.array(WaveletMatrix(data).occurrences(token), dtype=np.int64)
                ends = np.cumsum(np.array(lens, dtype=np.int64))
                doc = np.searchsorted(ends, at, "right")
                place = at - (ends[doc] - np.array(lens, dtype=np.int64)[doc])
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in doc.tolist()], pa.int64()), pa.array(place)], ["doc_id", "place"])

    return shards.select("doc_ids", "lengths", "data").mapInArrow(find, "doc_id long, place long")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write the shards of ``docs`` and read each document back from them."""
    return read_documents(write_shards(docs, tokenizer_path, end_id))
