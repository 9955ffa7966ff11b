"""Phrase collocations by weighted acyclic automata.

Texts are lower-cased (A-Z), cut at marks into pieces and at spaces and tabs
into words; n-grams of up to four words within pieces are counted for each
language.  Each task builds, for some words at a time, the count transducer of
its sorted n-grams: a tree of states by their first words, level by level, whose
arcs carry a word and the count of the n-gram that ends there.  It is cut by
ranges of the first two words (of a single word, by that word) and shuffled by
language and range.  There the transducers of all tasks are united: weights of
equal paths are summed, level by level, and what occurs too seldom goes with all
that continues it, since no longer phrase is more frequent than its beginning.
A range takes the n-grams of some RANGE bytes of text, so a range's size does
not grow with the corpus, and a frequent first word is spread over many ranges.

Words are symbols by a 64-bit hash.  All words with one hash meet in one range
and are compared there; two that differ stop the job, so counts are exact.  The
united table (only what occurs often enough) is composed with the cuts of its
phrases by joins on the paths of both parts.

A null text has no words, a null language is ``und``.  Repeated rows count each
time.  Ids and other columns are not read.  Text without words gives no rows.  A
document's words are held by one task at a time.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import materialise

#: Least count of a phrase, per cent of its count that a longer one needs to replace it, and rows of a language.
LEAST, INSIDE, TOP = 30, 80, 2_000
SCALE = 2_000_000
UNKNOWN = "und"
#: Words (and marks) of one transducer.
BLOCK = 2_000_000
#: Bytes of text whose n-grams make a range.
RANGE = 8_000_000
SEED = 5
_MARK = b"\xff"  # no byte of UTF-8
_FROM = bytes(range(0x41, 0x5B)) + b".,;:!?\x0a\x0b\x0c\x0d\x09"
_TABLE = bytes.maketrans(_FROM, bytes(range(0x61, 0x7B)) + _MARK * 10 + b" ")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_and_marks(text: str | None) -> list[bytes]:
    """The words of a text, with a mark wherever a piece ends."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    return raw.replace(_MARK, b" \xff ").split() + [_MARK]


def mixed(a: np.ndarray, b: np.ndarray | None, ranges: int) -> np.ndarray:
    """The range of each beginning of one or two words."""
    h = a * _MIX
    h ^= h >> np.uint64(32)
    if b is not None:
        h = (h + b) * _MIX
        h ^= h >> np.uint64(29)
    return (h % np.uint64(ranges)).astype(np.int64)


def packed(arrays: list[np.ndarray], names: bytes) -> bytes:
    import zstandard

    raw = [x.tobytes() for x in arrays] + [names]
    return zstandard.compress(struct.pack(f"<{len(raw)}Q", *map(len, raw)) + b"".join(raw), 1)


def unpacked(load: bytes, kinds: list[type]) -> tuple[list[np.ndarray], bytes]:
    import zstandard

    raw = zstandard.decompress(load)
    sizes = struct.unpack_from(f"<{len(kinds) + 1}Q", raw)
    at, parts = 8 * len(sizes), []
    for size, kind in zip(sizes, kinds):
        parts.append(np.frombuffer(raw, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
        at += size
    return parts, raw[at:]


#: Of a slice: hashes; symbols and counts of single words; both symbols and counts of pairs; parents, symbols and counts of longer ones.
_KINDS = [np.uint64, np.int32, np.int64, np.int32, np.int32, np.int64] + [np.int32, np.int32, np.int64] * 2


def transducer(ids: np.ndarray, words: list[bytes], ranges: int) -> list[tuple[int, bytes]]:
    """(range, slice) of the count transducer of a sequence of symbols; symbol 0 is the mark between pieces."""
    import xxhash

    size = len(words)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), dtype=np.uint64, count=size)
    word = ids != 0
    single = np.bincount(ids, minlength=size)
    first = np.argsort(mixed(hashes[1:], None, ranges), kind="stable") + 1
    first = first[single[first] > 0]
    # codes in the order of range, first and second word; then of parent and next word
    at = np.flatnonzero(word[:-1] & word[1:])
    code = (mixed(hashes[ids[at]], hashes[ids[at + 1]], ranges) * size + ids[at]) * size + ids[at + 1]
    levels = []
    for n in (2, 3, 4):
        code, node, times = np.unique(code, return_inverse=True, return_counts=True)
        levels.append((code, times))
        at, node = (x[: np.searchsorted(at, len(ids) - n)] for x in (at, node))
        on = word[at + n]
        at, node = at[on], node[on]
        code = node * size + ids[at + n]
    pairs, n2 = levels[0]
    own = pairs // (size * size)
    parents = [levels[1][0] // size, levels[2][0] // size]
    edges = np.arange(ranges + 1)
    cut1 = np.searchsorted(mixed(hashes[first], None, ranges), edges)
    cut2 = np.searchsorted(own, edges)
    cut3 = np.searchsorted(parents[0], cut2)
    cut4 = np.searchsorted(parents[1], cut3)
    out = []
    for k in np.flatnonzero((np.diff(cut1) > 0) | (np.diff(cut2) > 0)).tolist():
        a, b, c, d = (slice(*cut[k : k + 2]) for cut in (cut1, cut2, cut3, cut4))
        symbols = [first[a], pairs[b] // size % size, pairs[b] % size, levels[1][0][c] % size, levels[2][0][d] % size]
        used, new = np.unique(np.concatenate(symbols), return_inverse=True)
        s1, s2, t2, s3, s4 = np.split(new.astype(np.int32), np.cumsum([len(x) for x in symbols])[:-1])
        up3, up4 = (parents[0][c] - b.start).astype(np.int32), (parents[1][d] - c.start).astype(np.int32)
        arrays = [hashes[used], s1, single[first[a]], s2, t2, n2[b], up3, s3, levels[1][1][c], up4, s4, levels[2][1][d]]
        out.append((k, packed(arrays, b"\n".join(words[i] for i in first[a].tolist()))))
    return out


def summed(code: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, the sum of each, and the place of each row's code."""
    code, node = np.unique(code, return_inverse=True)
    order = np.argsort(node, kind="stable")
    heads = np.searchsorted(node[order], np.arange(len(code)))
    return code, (np.add.reduceat(times[order], heads) if len(code) else times[:0]), node


def united(loads: list[bytes], least: int) -> tuple[list[tuple[list[int], bytes | None, int]], int]:
    """(path, word, count) of all that occurs ``least`` times or more in the slices of a range, and the words in all."""
    slices = [unpacked(x, _KINDS) for x in loads]
    hashes, symbol = np.unique(np.concatenate([x[0] for x, _ in slices]), return_inverse=True)
    size = len(hashes)
    starts = np.cumsum([0] + [len(x[0]) for x, _ in slices])

    def put(i: int) -> np.ndarray:
        return np.concatenate([symbol[s : s + len(x[0])][x[i]] for s, (x, _) in zip(starts, slices)])

    def times(i: int) -> np.ndarray:
        return np.concatenate([x[i] for x, _ in slices])

    names = [w for _, raw in slices for w in (raw.split(b"\n") if raw else [])]
    code, total, node = summed(put(1), times(2))
    spelt: list[bytes | None] = [None] * len(code)
    for i, w in zip(node.tolist(), names):
        if spelt[i] is None:
            spelt[i] = w
        elif spelt[i] != w:
            raise ArithmeticError("two words share a hash; take another seed")
    out = [([int(hashes[code[i]])], spelt[i], int(total[i])) for i in np.flatnonzero(total >= least).tolist()]

    paths = np.stack([put(3), put(4)], axis=1)
    code, n, node = summed(paths[:, 0] * size + paths[:, 1], times(5))
    paths = np.stack([code // size, code % size], axis=1)
    offset = np.cumsum([0] + [len(x[3]) for x, _ in slices])
    for level in (6, 9, None):
        often = n >= least
        rows = hashes[paths[often]].view(np.int64).tolist()
        out += [(path, None, m) for path, m in zip(rows, n[often].tolist())]
        if level is None:
            break
        # rows below what is kept; the others cannot be frequent
        parent = np.concatenate([x[level].astype(np.int64) + o for o, (x, _) in zip(offset, slices)])
        offset = np.cumsum([0] + [len(x[level]) for x, _ in slices])
        live = often[node[parent]]
        code, n, found = summed(node[parent[live]] * size + put(level + 1)[live], times(level + 2)[live])
        paths = np.concatenate([paths[code // size], (code % size)[:, None]], axis=1)
        node = np.full(len(parent), len(code))  # those left out go to a last node that is never frequent
        node[live] = found
        n, paths = np.append(n, 0), np.concatenate([paths, np.zeros((1, paths.shape[1]), np.int64)])
    return [([h - (1 << 64) if h >= 1 << 63 else h for h in path], w, m) for path, w, m in out], int(total.sum())


def slices(docs: DataFrame, ranges: int) -> DataFrame:
    """(lang, range, load): the transducers of the tasks' words, cut by ranges."""

    def build(batches):
        held: dict[str, tuple[dict, list]] = {}
        words = 0

        def flush():
            for lang, (known, parts) in held.items():
                got = transducer(np.concatenate(parts), list(known), ranges)
                for i in range(0, len(got), 64):
                    some = got[i : i + 64]
                    columns = [pa.array([lang] * len(some), pa.string()), pa.array([k for k, _ in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([x for _, x in some], pa.binary())], ["lang", "range", "load"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                tokens = words_and_marks(text)
                if lang not in held:
                    known = defaultdict(count().__next__)
                    known[_MARK]  # symbol 0
                    held[lang] = (known, [])
                known, parts = held[lang]
                parts.append(np.fromiter(map(known.__getitem__, tokens), dtype=np.int64, count=len(tokens)))
                words += len(tokens)
                if words >= BLOCK:
                    yield from flush()
                    held.clear()
                    words = 0
        yield from flush()

    texts = docs.where("text is not null").select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    return texts.mapInArrow(build, "lang string, range long, load binary")


def counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, path, word, f): what occurs ``least`` times or more, single words spelt; the row without path has a range's words."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(size // RANGE) + 1

    def unite(table: pa.Table) -> pa.Table:
        rows, total = united(table.column("load").to_pylist(), least)
        paths, spelt, n = [[], *(r[0] for r in rows)], [None, *(r[1] for r in rows)], [total, *(r[2] for r in rows)]
        spelt = [None if w is None else w.decode("utf-8", "surrogatepass") for w in spelt]
        lang = pa.array([table.column("lang")[0].as_py()] * len(n), pa.string())
        columns = [lang, pa.array(paths, pa.list_(pa.int64())), pa.array(spelt, pa.string()), pa.array(n, pa.int64())]
        return pa.Table.from_arrays(columns, ["lang", "path", "word", "f"])

    return slices(docs, ranges).groupBy("lang", "range").applyInArrow(unite, "lang string, path array<long>, word string, f long")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's best phrases."""
    found = materialise(counts(docs, least))
    totals = found.where("size(path) = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    words = found.where("size(path) = 1").select("lang", F.col("path")[0].alias("symbol"), "word")
    grams = found.where("size(path) > 0").select("lang", "path", "f")
    phrases = grams.where("size(path) > 1")

    # of a phrase all parts of two words or more, with the phrase's own count
    longer = phrases.where("size(path) > 2").select(
        "lang",
        F.col("f").alias("outer"),
        F.explode(
            F.expr(
                "filter(flatten(transform(sequence(2, size(path) - 1), k ->"
                " transform(sequence(1, size(path) - k + 1), i -> slice(path, i, k)))), x -> size(x) > 1)"
            )
        ).alias("path"),
    )
    widest = longer.groupBy("lang", "path").agg(F.max("outer").alias("outer"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    kept = phrases.join(widest, ["lang", "path"], "left").where(F.col("outer").isNull() | (wide("outer") * 100 < wide("f") * inside))

    cuts = kept.select("lang", "path", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size(path) - 1)")).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("slice(path, 1, k)"), "right": F.expr("slice(path, k + 1, size(path))")})
    cuts = cuts.join(grams.select("lang", F.col("path").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(grams.select("lang", F.col("path").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr(f"(cast(a as decimal(38,0)) * {SCALE}) div (cast(l as decimal(38,0)) + cast(r as decimal(38,0)))")
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "path", "a").agg(worst).select("lang", "path", "a", "cut.l", "cut.r", "cut.score")

    # ties by phrase need the words; all that may be among the first by score and count get theirs
    order = [F.col("score").desc(), F.col("a").desc()]
    near = scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("place")
    parts = near.select("lang", "path", F.posexplode("path").alias("at", "symbol")).join(words, ["lang", "symbol"])
    spelt = parts.groupBy("lang", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = near.join(spelt, ["lang", "path"])
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).where(F.col("rank") <= top)
    columns = ["lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"]
    return ranked.join(F.broadcast(totals), "lang").select(*columns)


#: DuckDB's form: phrases are joined by spaces, which no word has.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
        FROM documents)
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0
), sized AS (
  SELECT lang, w, i, unnest([1, 2, 3, 4]) AS k FROM places
), f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM sized WHERE i + k - 1 <= len(w) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), often AS (
  SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE f >= 30
), within_ AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS outer_f
  FROM (SELECT lang, k, w, f, m, unnest(range(1, k - m + 2)) AS i
        FROM (SELECT lang, k, w, f, unnest(range(2, k)) AS m FROM often WHERE k > 2))
  GROUP BY ALL
), kept AS (
  SELECT o.* FROM often o LEFT JOIN within_ x ON o.lang = x.lang AND o.phrase = x.phrase
  WHERE o.k > 1 AND (x.outer_f IS NULL OR 100::HUGEINT * x.outer_f < 80::HUGEINT * o.f)
), cuts AS (
  SELECT lang, k, phrase, f AS a, c, array_to_string(w[1:c], ' ') AS lp, array_to_string(w[c + 1:k], ' ') AS rp
  FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)
), scored AS (
  SELECT t.lang, t.phrase, t.a, x.f AS l, y.f AS r, t.c,
    ((2000000::HUGEINT * t.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts t JOIN often x ON x.lang = t.lang AND x.phrase = t.lp JOIN often y ON y.lang = t.lang AND y.phrase = t.rp
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
