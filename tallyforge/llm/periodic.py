"""Periodic runs of words by a harmonic grid of longest-common-extension queries.

A run of period p and at least 3 p words holds two neighbouring multiples of p, j p and (j + 1) p, so the run
is found by extending those two forwards and backwards as far as they agree. Extensions come from a suffix array, that of
the reversed text, and range minima over the lengths of common prefixes. Over all p a text of n words has n log n grid pairs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyforge.llm import words as W

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 24, 3
#: Words by which a grid pair is screened: inside a run some pair agrees in so many words (see ``grid_pairs``).
GRAM = 8
#: Grid pairs extended at a time.
STEP = 1 << 20
RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def grams(ids: np.ndarray) -> np.ndarray:
    """A hash of GRAM words from each position at which so many are left."""
    out, size = ids, 1
    while size < GRAM:
        out = W.mix(out[:-size] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)) + out[size:]
        size *= 2
    return out


def grid_pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, p), i a multiple of p, at which GRAM words from i and from i + p agree, for all p of which TIMES fit.

    In a run of period p the words i and i + p agree for at least max(2 p, LEAST - p) consecutive i, among
    the first p of which is a multiple of p, so that at least max(p, LEAST - 2 p) + 1 > GRAM words follow it: no run is lost.
    Periods up to the root of n are taken one by one, longer ones one multiple at a time.
    """
    n = len(ids)
    most = n // TIMES
    if n < LEAST or not most:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = grams(ids)
    root = min(isqrt(n), most)
    at, periods = [], []
    for p in range(1, root + 1):
        x = code[::p]
        i = np.flatnonzero(x[:-1] == x[1:])
        if p <= GRAM:  # what follows at once belongs to the same run
            i = i[np.concatenate(([True], np.diff(i) > 1))] if len(i) else i
        at.append(i * p)
        periods.append(np.full(len(i), p))
    low, j = root + 1, 0
    while low <= (high := min(most, (len(code) - 1) // (j + 1))):
        one = code[j * low : j * high + 1 : j] if j else code[0]
        p = low + np.flatnonzero(one == code[(j + 1) * low : (j + 1) * high + 1 : j + 1])
        at.append(j * p)
        periods.append(p)
        j += 1
    return np.concatenate(at), np.concatenate(periods)


class Extensions:
    """Lengths of the longest common prefixes of two suffixes of ``ids``: suffix array, prefix lengths, range minima.

    Takes 4 bytes a word for each doubling of the longest repeat while it is built.
    """

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
        levels, size = [rank.astype(np.int32)], 1
        while rank.max() < n - 1:
            key = rank * np.int64(n + 1)
            key[: n - size] += rank[size:] + 1
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
            levels.append(rank.astype(np.int32))
            size *= 2
        self.n, self.rank = n, rank
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        one, two, common = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero(np.maximum(one, two) < n)
            same = inside[levels[k][one[inside]] == levels[k][two[inside]]]
            for x in (one, two, common):
                x[same] += 1 << k
        self.common = common

    def query(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For positions x and y, all different; a position beyond the text agrees with nothing."""
        out = np.zeros(len(x), np.int64)
        ask = np.flatnonzero(np.maximum(x, y) < self.n)
        a, b = self.rank[x[ask]], self.rank[y[ask]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1
        least, size = self.common, 1
        for k in range(int(level.max()) + 1 if len(level) else 0):
            mine = np.flatnonzero(level == k)
            out[ask[mine]] = np.minimum(least[low[mine]], least[high[mine] - size])
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        return out


def find_runs(ids: np.ndarray) -> np.ndarray:
    """(start, length, period) of every maximal run, by start and period, of a sequence of word hashes."""
    at, period = grid_pairs(ids)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    ahead, back, n = Extensions(ids), Extensions(ids[::-1]), len(ids)
    found = []
    for k in range(0, len(at), STEP):
        i, p = at[k : k + STEP], period[k : k + STEP]
        before = back.query(n - i, n - i - p)
        length = before + p + ahead.query(i, i + p)
        long = length >= np.maximum(LEAST, TIMES * p)
        found.append(np.unique(np.stack((i - before, length, p), axis=1)[long], axis=0))
    runs = np.unique(np.concatenate(found), axis=0)
    # of one stretch the smallest period counts; the others are multiples of it
    runs = runs[np.concatenate(([True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)))] if len(runs) else runs
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def best_run(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period; of equal ones that of the smallest start, then period."""
    if not len(runs):
        return None
    ratio = runs[:, 1] / runs[:, 2]
    top = runs[ratio >= ratio.max() * (1 - 1e-12)].tolist()
    return tuple(min(top, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])))


def repeated_tail(n: int, doc_id: int | None) -> np.ndarray:
    """Which of its n words each word of a document becomes: of one in ten ids the tail repeats its first words."""
    source = np.arange(n)
    if doc_id is None or not n:
        return source
    g, tenth = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if tenth == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[a:] = a + (source[a:] - a) % p
    return source


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """False for words that some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] == 0


def collapse_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """One row per document: ``runs`` (start, length, period in words) and ``text`` with each run cut to its first period.

    Words are joined by one space. Null, empty and wordless texts have no runs and an empty text; repeated rows give
    equal rows; a null id stays. ``plant`` first gives the tail of one in ten ids a period (``repeated_tail``).
    Columns beyond doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in W.chunks(batch.column("text")):
                ids = batch.column("doc_id").slice(at, to - at)
                w = W.find_words(data, offsets, lower=False)
                hashes, texts, runs = w.hashes(), [], []
                for k, doc in enumerate(ids.to_pylist()):
                    lo, hi = w.bounds[k], w.bounds[k + 1]
                    source = lo + (repeated_tail(hi - lo, doc) if plant else np.arange(hi - lo))
                    found = find_runs(hashes[source])
                    source = source[kept_words(hi - lo, found)]
                    texts.append(W.joined(w.data, w.starts[source], w.ends[source])[0][:-1].tobytes())
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found.tolist()])
                shape = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(runs, shape), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "text"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, text string")


def run_digests(collapsed: DataFrame) -> DataFrame:
    """RUNS rows of ``collapse_runs``: the number of runs, the strongest one, and digests of all runs and of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, runs, text in zip(batch.column("doc_id").to_pylist(), batch.column("runs").to_pylist(), batch.column("text"), strict=True):
                rows = np.array([[r["start"], r["length"], r["period"]] for r in runs], np.int64).reshape(-1, 3)
                best = best_run(rows) or (None, None, None)
                lines = "".join(f"{a},{b},{c}\n" for a, b, c in rows.tolist())
                milli = None if best[0] is None else 1000 * best[1] // best[2]
                out.append((doc, len(rows), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.as_py().encode()).hexdigest()))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in RUNS.split(", ")])

    return collapsed.mapInArrow(run, RUNS)
