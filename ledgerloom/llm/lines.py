"""Substring dedup by line hashing.

A text's units are its lines, its paragraphs, or its lines cut at sentence ends. Units are
normalised and hashed; of each digest the earliest occurrence stays, by key and then place in the
text, and the others are repeats. Repeats are removed where they stand in a stretch of adjacent
repeats of at least `min_run` words: a single short line recurs by chance.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.skew import heavy_keys

from . import common as c

MIN_WORDS = 5        # default of the operator, below which units stay; the query has no minimum
RUN_WORDS = 25       # words of adjacent repeats from which the query removes them
LONG_WORD = 20       # longer words, as of scripts without spaces, count once for each 6 letters
HEAVY = 1 / 1024     # share of all units from which a digest's rows are not shuffled
LINE = r"\n"
PARAGRAPH = r"\n[ \t\r]*\n\s*"
SENTENCE = r"\n|(?<=[.!?])[ \t]+|(?<=[。！？])"


def units(text: str, separator: str = LINE) -> list[tuple[int, int]]:
    """(start, end) in code points of each unit, separators left out."""
    out, at = [], 0
    for m in re.finditer(separator, text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))]


def normalised(unit: str) -> list[str]:
    """Words in lower case, without what surrounds their letters and digits."""
    return re.findall(r"\w+", unit.lower())


def hashed_words(unit: str, min_words: int) -> list[str]:
    """What a unit is hashed by, empty if it is not: with a minimum of one word, a unit of signs
    alone goes by its signs, and only blank units stay."""
    words = normalised(unit)
    if not words and min_words == 1:
        return unit.split()
    return words if len(words) >= min_words else []


def n_words(words: list[str]) -> int:
    return sum(1 if len(w) <= LONG_WORD else -(-len(w) // 6) for w in words)


def digests(docs: DataFrame, text: str, separator: str, min_words: int) -> DataFrame:
    """(row, key, unit, place, h1, h2) of every unit of docs that hashed_words takes. docs has
    columns row, key and the text. The digest has 128 bits. unit is its number within its row and
    its words, place its start and end, each pair as the halves of one long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            hashes = bytearray()
            keys = batch.column(1)
            take = []
            for i, (row, t) in enumerate(zip(batch.column(0).to_pylist(),
                                             batch.column(2).to_pylist())):
                unit = 0
                for s, e in units(t or "", separator):
                    words = hashed_words((t or "")[s:e], min_words)
                    if words:
                        hashes += hashlib.blake2b(" ".join(words).encode(
                            "utf-8", "surrogatepass"), digest_size=16).digest()
                        take.append(i)
                        for column, x in zip(out, (row, unit << 32 | n_words(words), s << 32 | e)):
                            column.append(x)
                        unit += 1
            h = np.frombuffer(bytes(hashes), np.int64).reshape(-1, 2)
            row, *rest = (pa.array(x, pa.int64()) for x in out)
            yield pa.RecordBatch.from_arrays(
                [row, keys.take(pa.array(take, pa.int64())), *rest,
                 pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())],
                names=["row", "key", "unit", "place", "h1", "h2"])

    return docs.select("row", "key", text).mapInArrow(
        run, "row long, key long, unit long, place long, h1 long, h2 long")


def _repeats(found: DataFrame, share: float = HEAVY) -> DataFrame:
    """Rows (row, unit, place) of found, a written table of digests(), that are not the first of
    their digest.

    Digests that may hold at least `share` of all rows, of which a sketch names no more than
    1 / share, are reduced to their first where their rows are, and that is broadcast. All others
    are sent once, to be numbered by rank, so that no task gets more than that share for one.
    """
    rank = [F.col("key").isNull(), F.col("key"), F.col("row"), F.col("place")]
    same = ["h1", "h2"]
    heavy = F.broadcast(heavy_keys(found, "h1", share, min_rows=2))
    here = found.join(heavy, "h1")
    first = here.groupBy(*same).agg(F.min(F.struct(*rank)).alias("first"))
    first = first.select(*same, F.col("first.row").alias("first_row"),
                         F.col("first.place").alias("first_place"))
    again = here.join(F.broadcast(first), same).where(
        "row <> first_row or place <> first_place")
    others = found.join(heavy, "h1", "left_anti").withColumn(
        "nth", F.row_number().over(Window.partitionBy(*same).orderBy(*rank))).where("nth > 1")
    names = ["row", "unit", "place"]
    return again.select(*names).unionByName(others.select(*names))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    separator: str = LINE, min_words: int = MIN_WORDS, min_run: int = 0
                    ) -> DataFrame:
    """(key, text, n_removed, removed) of every row of docs: text without repeated units.

    removed is an array of (start, end) in code points of the original text, by start. A unit
    goes with the separator after it, or before it at the text's end. Units that are not hashed
    (blank ones, those under min_words) stay and do not part what stands around them. Repeats go
    only in stretches of at least min_run words. Keys rank occurrences, null last; rows that share
    a key, or have none, rank by the order in which they were first written. Null texts stay null
    and empty ones empty; repeated rows lose all that the first of them keeps. A very long text is
    one row of one task, its units rows of their own. Other columns of docs are left out, whatever
    their names.
    """
    rows = c.cut(docs.select(F.monotonically_increasing_id().alias("row"),
                             F.col(key).cast("long").alias("key"), F.col(text).alias("t")), "zstd")
    found = c.cut(digests(rows, "t", separator, min_words), "zstd")
    again = _repeats(found)
    spans = again.groupBy("row").agg(F.sort_array(F.collect_list(
        F.struct("unit", "place"))).alias("removed"))
    joined = rows.join(spans, "row", "left")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed = [in_runs(r or [], min_run) for r in batch.column(2).to_pylist()]
            new = [t if not r else _cut_out(t, r, separator)
                   for t, r in zip(batch.column(1).to_pylist(), removed)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(new, pa.string()),
                 pa.array([len(r) for r in removed], pa.int64()),
                 pa.array([[{"start": a, "end": b} for a, b in r] for r in removed], span)],
                names=["key", "text", "n_removed", "removed"])

    out = joined.select("key", "t", "removed").mapInArrow(
        run, "key long, text string, n_removed long, "
             "removed array<struct<start: bigint, end: bigint>>")
    return out.withColumnRenamed("key", key)


def in_runs(repeats: list[dict], min_run: int) -> list[tuple[int, int]]:
    """(start, end) of the repeats (unit, place), by unit, in stretches of at least min_run words."""
    out: list[tuple[int, int]] = []
    stretch: list[tuple[int, int, int, int]] = []
    for x in [*repeats, None]:
        unit, words = divmod(x["unit"], 1 << 32) if x else (-1, 0)
        if stretch and unit != stretch[-1][0] + 1:
            if sum(s[1] for s in stretch) >= min_run:
                out += [s[2:] for s in stretch]
            stretch = []
        if x:
            stretch.append((unit, words, *divmod(x["place"], 1 << 32)))
    return out


def _cut_out(text: str, spans: list[tuple[int, int]], separator: str) -> str:
    """text without the spans, each with the separator after it, or before it at the end."""
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        after = re.compile(separator).match(text, e)
        at = after.end() if after else e
    rest = text[at:]
    kept = "".join(out)
    if not rest and spans and spans[-1][1] == len(text):
        ends = [m for m in re.finditer(separator, kept) if m.end() == len(kept)]
        kept = kept[:ends[0].start()] if ends else kept
    return kept + rest


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages: lines cut at sentence ends, short ones too,
    in stretches of at least RUN_WORDS words; removed as start:end, comma-joined."""
    out = without_repeats(c.table(spark, sf_dir, "documents"), separator=SENTENCE, min_words=1,
                          min_run=RUN_WORDS)
    return out.select("doc_id", "text", "n_removed", F.array_join(F.transform(
        "removed", lambda r: F.concat_ws(":", r["start"], r["end"])), ",").alias("removed"))
