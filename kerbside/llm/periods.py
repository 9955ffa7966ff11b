"""Periodic runs of words, found by minimizers of many scales.

A run is a stretch of words with smallest period q, at least max(12, 2 q) words
long, that no neighbouring word extends.  Periods below SHORT are found by
comparing the words with themselves at each lag.  Longer ones are looked for by
scales: at scale w (a power of two, for periods from w to 2 w - 1) each place
has the hash of its gram of w / 2 words, and the smallest hash of every w / 2
places in a row is a minimizer.  The first w words of a run and those a period
later are equal, so their minimizers are: pairs of equal minimizers w to 2 w - 1
apart are the seeds, which are extended to both sides by comparing hashes of
ever shorter stretches; what is found is compared word by word.

Grams that are periodic themselves (period of at most an eighth of w) would be
minimizers everywhere in a long run of that period, which is known from an
earlier scale, so they are left out, and all other equal grams lie over w / 8
apart: a minimizer has few partners.  If the first grams of a run are all of
that kind, they lie in one such inner run.  Where that ends within the first
period, the ends of inner runs repeat at the run's period, and are the seeds.
Otherwise both halves are inner runs that touch, whose common phase gives the
periods.  So no run is missed.

A null text has no words.  The words of a tenth of the documents (by the crc32
of the id) are first made periodic from some place on, if ``planted`` is set; a
null id is never one of these.  Repeated rows get equal results, other columns
are not read.  Whole documents are gathered to groups of some GROUP words, with
a mark between them that equals nothing; a longer document is a group by
itself, in memory linear in its words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Periods below this are found by lags.
SHORT = 32
LEAST = 12
#: Words of the documents that are worked on together.
GROUP = 200_000
_PRIMES = (np.uint64(2147483647), np.uint64(2147483629))
_BASES = (np.uint64(1103515245), np.uint64(214013931))


class Hashes:
    """Hashes of all stretches of a sequence of numbers, by two primes."""

    def __init__(self, a: np.ndarray) -> None:
        self.n = len(a)
        self.powers, self.sums = [], []
        x = (a.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        for p, base in zip(_PRIMES, _BASES):
            power = np.ones(1, dtype=np.uint64)
            step = base
            while len(power) <= self.n:
                power = np.concatenate([power, power * step % p])
                step = step * step % p
            self.powers.append(power[: self.n + 1])
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x % p * power[: self.n] % p)]) % p)

    def grams(self, size: int) -> np.ndarray:
        """One number for each stretch of that size, equal for equal stretches."""
        out = np.zeros(self.n - size + 1, dtype=np.uint64)
        for p, power, sums in zip(_PRIMES, self.powers, self.sums):
            h = (sums[size:] + p - sums[:-size]) % p * power[self.n - size :: -1] % p
            out = out << np.uint64(31) | h
        return out

    def same(self, at: np.ndarray, lag: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches at ``at`` and at ``at + lag`` are equal."""
        ok = np.ones(len(at), dtype=bool)
        for p, power, sums in zip(_PRIMES, self.powers, self.sums):
            first = (sums[at + size] + p - sums[at]) % p * power[lag] % p
            ok &= first == (sums[at + lag + size] + p - sums[at + lag]) % p
        return ok


def extended(h: Hashes, at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the longest stretch of period ``lag`` round the pair (at, at + lag)."""
    right, left = np.zeros_like(at), np.zeros_like(at)
    step = 1 << max(0, int(h.n).bit_length() - 1)
    while step:
        fits = at + lag + right + step <= h.n
        i = np.flatnonzero(fits)
        i = i[h.same(at[i] + right[i], lag[i], np.full(len(i), step))]
        right[i] += step
        i = np.flatnonzero(at - left - step >= 0)
        i = i[h.same(at[i] - left[i] - step, lag[i], np.full(len(i), step))]
        left[i] += step
        step >>= 1
    return at - left, at + lag + right


def lagged(a: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of all stretches of a period, of max(LEAST, 2 lag) words at least."""
    same = np.flatnonzero(a[:-lag] == a[lag:])
    if not len(same):
        return same, same
    cut = np.flatnonzero(np.diff(same) > 1)
    first, last = same[np.append(0, cut + 1)], same[np.append(cut, len(same) - 1)]
    long = last - first + 1 + lag >= max(LEAST, 2 * lag)
    return first[long], last[long] + 1 + lag


def slid(x: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` of every ``size`` numbers in a row."""
    have = 1
    while 2 * have <= size:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (size - have)], x[size - have :]) if have < size else x


def partners(at: np.ndarray, key: np.ndarray, near: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of equal keys at a distance from ``near`` to ``far`` - 1: the first place and the distance."""
    order = np.lexsort((at, key))
    at, key = at[order], key[order]
    found, t = [], 1
    live = np.arange(max(0, len(at) - 1))
    while len(live):
        live = live[live + t < len(at)]
        gap = at[live + t] - at[live]
        live, gap = (x[(key[live + t] == key[live]) & (gap < far)] for x in (live, gap))
        found.append((at[live[gap >= near]], gap[gap >= near]))
        t += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def touching(grams: np.ndarray, inner: np.ndarray, w: int) -> tuple[list[int], list[int]]:
    """Seeds whose two halves are inner runs that touch: of these, all periods from w to 2 w - 1 of the common phase."""
    at, lag = [], []
    rows = sorted(map(tuple, inner.tolist()))
    for (s1, e1, q1), (s2, e2, q2) in zip(rows, rows[1:]):
        if q1 != q2 or s2 > e1:
            continue
        same = np.flatnonzero(grams[s1 : s1 + q1] == grams[s2])
        if not len(same):
            continue
        most = min(e1 - s1, e2 - s2, 2 * w - 1)
        least = (s2 - s1 - int(same[0])) % q1
        for p in range(least + -(-max(0, w - least) // q1) * q1, most + 1, q1):
            at.append(max(s1, s2 - p))
            lag.append(p)
    return at, lag


def runs(a: np.ndarray, longest: int) -> np.ndarray:
    """(start, end, period) of all runs, sorted by start and period, of a sequence whose pieces have ``longest`` words at most."""
    found = [np.zeros((0, 3), np.int64)]

    def known() -> np.ndarray:
        """Of stretches found by several periods the smallest, which is the stretch's own."""
        x = np.concatenate(found)
        x = x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))]
        new = np.append(True, (x[1:, :2] != x[:-1, :2]).any(axis=1))[: len(x)]
        return x[new]

    for lag in range(1, min(SHORT, longest // 2 + 1)):
        first, end = lagged(a, lag)
        found.append(np.stack([first, end, np.full(len(first), lag)], axis=1))
    found = [known()]
    w = SHORT
    h = Hashes(a) if 2 * w <= longest else None
    while 2 * w <= longest:
        size = w // 2
        grams = h.grams(size)
        runs_ = found[0]
        inner = runs_[(runs_[:, 1] - runs_[:, 0] >= size) & (runs_[:, 2] <= size // 4)]
        cover = np.zeros(len(grams) + 1, dtype=np.int64)
        np.add.at(cover, inner[:, 0], 1)
        np.subtract.at(cover, inner[:, 1] - size + 1, 1)
        plain = np.cumsum(cover[:-1]) == 0
        key = np.where(plain, grams, np.uint64(2**63))
        if len(key) >= size:
            least = slid(key, size, np.minimum)
            edge = np.zeros(size - 1, dtype=np.uint64)
            chosen = np.flatnonzero((slid(np.concatenate([edge, least, edge]), size, np.maximum) == key) & plain)
        else:
            chosen = np.flatnonzero(plain)
        ends = inner[:, 1] - size
        at, lag = partners(chosen, grams[chosen], w, 2 * w)
        more_at, more_lag = partners(ends, grams[ends], w, 2 * w)
        last_at, last_lag = touching(grams, inner, w)
        at = np.concatenate([at, more_at, np.array(last_at, dtype=np.int64)])
        lag = np.concatenate([lag, more_lag, np.array(last_lag, dtype=np.int64)])
        if len(at):
            first, end = extended(h, at, lag)
            rows = np.stack([first, end, lag], axis=1)
            rows = np.unique(rows[end - first >= np.maximum(LEAST, 2 * lag)], axis=0)
            exact = [np.array_equal(a[s : e - p], a[s + p : e]) for s, e, p in rows.tolist()]
            found.append(rows[np.array(exact, dtype=bool)])
            found = [known()]
        w *= 2
    out = found[0]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def words_of(doc_id, text: str | None, planted: bool) -> list[bytes]:
    """The words of a text; those of a tenth of the documents become periodic from some place on."""
    words = (text or "").encode("utf-8", "surrogatepass").split()  # at the bytes 9 to 13 and 32
    if planted and words and doc_id is not None:
        crc, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = crc // 10
        if crc % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + i % p] for i in range(n - a)]
    return words


def described(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    """n_runs, the longest run's start, length, period and exponent, and the digests of the runs and of the words that stay."""
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2])) if found else None
    lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in found)
    kept = words
    if found:
        depth = np.zeros(len(words) + 1, dtype=np.int64)
        for s, e, p in found:
            depth[s + p] += 1
            depth[e] -= 1
        kept = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
    top = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    return len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def in_groups(rows: Iterator[tuple], planted: bool) -> Iterator[list[tuple]]:
    """(doc_id, words) of some documents at a time."""
    group, held = [], 0
    for doc_id, text in rows:
        words = words_of(doc_id, text, planted)
        if group and held + len(words) > GROUP:
            yield group
            group, held = [], 0
        group.append((doc_id, words))
        held += len(words)
    if group:
        yield group


def of_group(group: list[tuple]) -> list[tuple]:
    """The results of some documents, in order."""
    ids: dict[bytes, int] = {}
    parts, starts, at = [], [], 0
    for i, (_, words) in enumerate(group):
        part = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=len(words))
        parts += [part, np.array([-2 - i])]  # a mark that equals nothing
        starts.append(at)
        at += len(words) + 1
    found = runs(np.concatenate(parts), max(len(words) for _, words in group))
    of = np.searchsorted(np.array(starts), found[:, 0], side="right") - 1
    cuts = np.searchsorted(of, np.arange(len(group) + 1))
    out = []
    for i, (_, words) in enumerate(group):
        mine = found[cuts[i] : cuts[i + 1]] - np.array([starts[i], starts[i], 0])
        out.append(described(words, list(map(tuple, mine.tolist()))))
    return out


def periodic_runs(docs: DataFrame, planted: bool = True) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256 and collapsed_sha256 for each row of ``docs``."""
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            got = [r for group in in_groups(rows, planted) for r in of_group(group)]
            columns = [pa.array([r[k] for r in got], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    kinds_of = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {id_kind}, {kinds_of}")
