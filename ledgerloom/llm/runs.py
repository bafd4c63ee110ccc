"""Periodic runs of words by string synchronising sets.

A run is a maximal stretch of words with smallest period q that holds at least three periods and a
least number of words. Texts are searched together, as one array of word numbers in which every
text ends in a number of its own.

- Periods up to DIRECT are found by comparing the array with itself moved by them. Their stretches
  are also the highly periodic regions of the smaller scales.
- At each scale t = 4, 8, 16, ... a position is selected by the hashes of the stretches of t words
  in the window that begins there: it is one whose own stretch, or the one t words on, has the
  least hash of all in the window. That depends on the next 2t words alone, so positions of equal
  contexts are selected alike. Stretches of period up to t/3 do not count; without them equal
  contexts lie more than t/3 apart, and any two selected positions nearby are at most t apart
  unless all between is highly periodic.
- Selected positions of equal context, 1.5t to 3t apart, propose their distance as a period. Any
  run of such a period q has a selected position whose context, and the same one q words on, lie
  within it; a run whose windows were all highly periodic would have a smaller period.
- Proposals are extended both ways by the hashes of dyadic stretches, and what is long enough is
  compared word by word.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

MIN_WORDS = 24
DIRECT = 8           # periods found by direct comparison
CHUNK = 1 << 17      # words searched at once, whole texts
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

Edit = Callable[[int | None, list[bytes]], list[bytes]]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _C
    return x ^ (x >> np.uint64(29))


class _Hashes:
    """Hashes of all stretches of 2**k items that begin in the first `covered[k]` items."""

    def __init__(self, items: np.ndarray):
        self.levels = [_mixed(items.astype(np.uint64) * _A + _B)]

    def level(self, k: int, covered: int) -> np.ndarray:
        """Level k over at least the first `covered` items; levels are asked for in order."""
        if k == len(self.levels):
            half = 1 << (k - 1)
            h = self.levels[-1][:max(0, covered - half + 1)]
            self.levels.append(_mixed(h[:-half] * _A + h[half:] * _B) if len(h) > half else h[:0])
        return self.levels[k]

    def common(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        """Items that agree from i and j on (way 1), or before them (way -1); i < j."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            h, step = self.levels[k], 1 << k
            if not len(h):
                continue
            live = np.arange(len(i))
            while len(live):
                a = i[live] + n[live] if way > 0 else i[live] - n[live] - step
                b = j[live] + n[live] if way > 0 else j[live] - n[live] - step
                inside = (a >= 0) & (b < len(h))
                live, a, b = live[inside], a[inside], b[inside]
                live = live[h[a] == h[b]]
                n[live] += step
        return n


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], equal.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def _selected(h: np.ndarray, t: int, regions: np.ndarray) -> np.ndarray:
    """Synchronising positions for the hashes h of all stretches of t items. regions has a row
    (start, length, period) for each stretch of at least t items and period up to t / 3."""
    ids = h.copy()
    if len(regions):
        mark = np.zeros(len(ids) + 1, np.int64)
        np.add.at(mark, regions[:, 0], 1)
        np.add.at(mark, regions[:, 0] + regions[:, 1] - t + 1, -1)
        ids[np.cumsum(mark[:-1]) > 0] = _NONE
    low, width = ids, 1
    while width < t:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:-1], low[1:])          # t + 1 stretches
    n = len(low)
    return np.flatnonzero((low != _NONE) & ((ids[:n] == low) | (ids[t:t + n] == low)))


def _proposals(key: np.ndarray, at: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of positions of equal key, 1.5t to 3t apart."""
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    out_i, out_d = [], []
    for step in range(1, len(at)):
        d = at[step:] - at[:-step]
        near = (key[step:] == key[:-step]) & (d < 3 * t)
        if not near.any():
            break
        take = near & (2 * d >= 3 * t)
        out_i.append(at[:-step][take])
        out_d.append(d[take])
    if not out_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_d)


def _exact(items: np.ndarray, start: int, end: int, d: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of what holds three periods d within bounds that hashes gave."""
    a, b = _stretches(items[start:end - d] == items[start + d:end])
    long = b - a >= 2 * d
    return [(start + x, y - x + d, d) for x, y in zip(a[long].tolist(), b[long].tolist())]


def find_runs(texts: list[np.ndarray], min_words: int = MIN_WORDS) -> list[list[tuple]]:
    """Runs (start, length, period) of each text, given as numbers of its words, by start and then
    period. Memory is 8 bytes for each word and scale, of which there are log2 of the longest."""
    out: list[list[tuple]] = [[] for _ in texts]
    order = sorted((i for i, t in enumerate(texts) if len(t) >= min_words),
                   key=lambda i: -len(texts[i]))
    if not order:
        return out
    sizes = np.array([len(texts[i]) for i in order])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    items = np.full(starts[-1], -1, np.int64)
    for i, s, n in zip(order, starts, sizes):
        items[s:s + n] = texts[i]
        items[s + n] = -1 - i
    found, regions = [], np.empty((0, 3), np.int64)
    for q in range(1, DIRECT + 1):
        a, b = _stretches(items[:-q] == items[q:])
        long = b - a >= 2 * q
        rows = np.stack([a[long], b[long] - a[long] + q, np.full(long.sum(), q)], axis=1)
        regions = np.concatenate([regions, rows])
        found.append(rows[rows[:, 1] >= min_words])
    hashes, k = _Hashes(items), 1
    while 9 << k <= 2 * sizes[0]:                # a run needs 3 periods of at least 1.5 t words
        t = 1 << k
        covered = int(starts[np.searchsorted(-sizes, -(9 * t // 2), side="right")])
        h, context = hashes.level(k, covered), hashes.level(k + 1, covered)
        k += 1
        if t < 4 or not len(context):
            continue
        here = regions[(3 * regions[:, 2] <= t) & (regions[:, 1] >= t)
                       & (regions[:, 0] + regions[:, 1] <= covered)]
        at = _selected(h[:covered - t + 1], t, here)
        at = at[at < len(context)]
        i, d = _proposals(context[at], at, t)
        new = _extended(items, hashes, i, d)
        found.append(new[new[:, 1] >= min_words])
        regions = np.concatenate([regions, new])
    rows = np.unique(np.concatenate(found), axis=0)          # by start, length, period
    if len(rows):
        first = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1)))
        for s, n, q in rows[first].tolist():
            x = int(np.searchsorted(starts, s, side="right")) - 1
            out[order[x]].append((s - int(starts[x]), n, q))
    for found_here in out:
        found_here.sort(key=lambda r: (r[0], r[2]))
    return out


def _extended(items: np.ndarray, hashes: _Hashes, i: np.ndarray, d: np.ndarray) -> np.ndarray:
    """(start, length, period) of what holds three periods around the proposals."""
    if not len(i):
        return np.empty((0, 3), np.int64)
    start = i - hashes.common(i, i + d, -1)
    end = i + d + hashes.common(i, i + d, 1)
    long = end - start >= 3 * d
    bounds = np.unique(np.stack([start, end, d], axis=1)[long], axis=0).tolist()
    return np.array([r for b in bounds for r in _exact(items, *b)], np.int64).reshape(-1, 3)


def collapsed(words: list[bytes], runs: list[tuple]) -> list[bytes]:
    """words without those that a run holds after its first period."""
    if not runs:
        return words
    mark = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        mark[s + q] += 1
        mark[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) == 0).tolist()]


def _searched(batch: list[list[bytes]], min_words: int) -> list[list[tuple]]:
    numbers: dict[bytes, int] = {}
    return find_runs([np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
                      if len(words) >= min_words else np.empty(0, np.int64) for words in batch],
                     min_words)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  min_words: int = MIN_WORDS, edit: Edit | None = None) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row of docs.

    Words are parted by ASCII white space. runs is an array of (start, length, period) in words,
    by start and then period; collapsed is the text, its words joined by one space, without the
    words that a run holds after its first period. edit, if given, changes the words of a text
    first. Null and empty texts have no words, no runs and an empty collapsed text. Rows are
    independent: a null key, a shared one or a repeated row changes nothing. A very long text is
    searched whole, in memory in proportion to it. Other columns of docs are left out, whatever
    their names.
    """
    run_type = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def flush(keys: list, batch: list[list[bytes]]) -> pa.RecordBatch:
        runs = _searched(batch, min_words)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([len(w) for w in batch], pa.int64()),
             pa.array([[dict(zip(("start", "length", "period"), x)) for x in r] for r in runs],
                      run_type),
             pa.array([b" ".join(collapsed(w, r)) for w, r in zip(batch, runs)], pa.binary())],
            names=["key", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words, n = [], [], 0
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                here = (t.as_py() or b"").split()
                words.append(edit(k, here) if edit else here)
                keys.append(k)
                n += len(here)
                if n >= CHUNK:
                    yield flush(keys, words)
                    keys, words, n = [], [], 0
            if keys:
                yield flush(keys, words)

    rows = docs.select(F.col(key).cast("long").alias("key"),
                       F.col(text).cast("binary").alias("text"))
    out = rows.mapInArrow(run, "key long, n_words long, runs array<struct<start: bigint, "
                               "length: bigint, period: bigint>>, collapsed binary")
    return out.select(F.col("key").alias(key), "n_words", "runs",
                      F.col("collapsed").cast("string").alias("collapsed"))


def most_periods(runs: Column) -> Column:
    """The run with the greatest length by period; of equal ones the first, by start and period."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    more = lambda best, r: (
        r["length"] * best["period"] > best["length"] * r["period"])
    return F.reduce(runs, none, lambda best, r: F.when(best.isNull() | more(best, r), r).otherwise(
        best))


def planted(key: int | None, words: list[bytes]) -> list[bytes]:
    """Of one key in ten, the words from some place on repeat the first few of them."""
    n, h = len(words), zlib.crc32(str(key).encode())
    if key is None or not n or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs after planted() has edited it; without a doc_id it is as it is."""
    out = periodic_runs(c.table(spark, sf_dir, "documents"), edit=planted)
    spelled = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(
        ",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = out.withColumn("best", most_periods(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length",
        "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(spelled, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
