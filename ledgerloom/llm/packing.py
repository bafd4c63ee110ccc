"""Best-fit packing of token sequences, in bulk-synchronous rounds.

A round range-sorts the unplaced pieces and the gaps of open sequences by size, descending.
Each range sweeps its own pieces over its own gaps, every piece taking the smallest gap that
holds it. What a range could not place is matched with gaps of the ranges before it, the
nearest first, by rank: as piece and gap counts of the ranges alone decide who gets which gap,
no two pieces claim one place. Gaps are updated and the next round begins; pieces that no gap
holds open new sequences, the largest class of sizes first. Once all that is left fits into
one range, its sweep opens sequences as it needs them and is the last.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k"
SPECIAL = {"<|endoftext|>": 50256}   # texts with an id of their own, cut out before all else
END = 0                  # id after every document
CACHE = 400_000          # word pieces whose ids a task remembers
PER_RANGE = 200_000      # rows that one range of a round holds, about


# --- tokens ---------------------------------------------------------------------------------

def pieces_of(text: str) -> list[str]:
    """Cut a text where a space follows something that is not white space.

    The tokenizer's pattern never joins characters across such a place, so the ids of the text
    are those of its pieces in a row.
    """
    out, parts = [], iter(text.split(" "))
    piece = next(parts)
    for p in parts:
        if piece and not piece[-1].isspace():
            out.append(piece)
            piece = " " + p
        else:
            piece += " " + p
    out.append(piece)
    return out


class Tokens:
    """Ids of texts as bytes (little-endian unsigned 32-bit), remembering those of pieces."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks,
                                          special_tokens={})
        self.known: dict[str, bytes] = {}
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in SPECIAL.items()}
        self.cuts = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")

    def encode(self, text: str) -> bytes:
        if not self.cuts.search(text):
            return self._ordinary(text)
        return b"".join(self.special[t] if t in self.special else self._ordinary(t)
                        for t in self.cuts.split(text))

    def _ordinary(self, text: str) -> bytes:
        pieces = pieces_of(text)
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            return b"".join(map(self._one, pieces))

    def _one(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            ids = self.encoding.encode_ordinary(piece)
            found = np.array(ids, "<u4").tobytes()
            if len(self.known) < CACHE and len(piece) < 64:
                self.known[piece] = found
        return found


def tokens(path: str | None = None) -> Tokens:
    """The tokenizer of this process; path names the vocabulary's file of ranks."""
    import public_tokenizers as p

    path = path or p.path(f"{TOKENIZER}.tiktoken")
    return c.once(("tokens", path), lambda: Tokens(path, p.PATTERN))


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of a document's pieces: all are full but perhaps the first."""
    return [0] if n <= capacity else sorted({0, *range(n % capacity, n, capacity)})


def tokenized_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text",
                     capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every document's pieces.

    A document is its ids and then END; null text counts as empty, which leaves END alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk = tokens()
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for key_, text_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tk.encode(text_ or "") + end
                n = len(ids) // 4
                starts = cut_points(n, capacity)
                for i, (s, e) in enumerate(zip(starts, [*starts[1:], n])):
                    b = ids[4 * s:4 * e]
                    row = (key_, i, s, e - s, zlib.crc32(b))
                    out.append((*row, np.frombuffer(b, "<u4").astype(np.int64)) if with_ids
                               else row)
            cols = list(zip(*out))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(),
                     pa.list_(pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"][:len(cols)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), t) for x, t in zip(cols, types)], names=names)

    schema = "id long, piece int, start long, length long, ids_crc32 long"
    found = docs.select(F.col(key).cast("long"), text).mapInArrow(
        run, schema + (", ids array<long>" if with_ids else ""))
    return found.withColumnRenamed("id", key)


# --- packing --------------------------------------------------------------------------------

class Gaps:
    """Open gaps of one range by size: at most as many different sizes as the capacity."""

    def __init__(self):
        self.at: dict[int, list] = {}
        self.sizes: list[int] = []

    def put(self, size: int, gap: tuple) -> None:
        if size not in self.at:
            self.at[size] = []
            bisect.insort(self.sizes, size)
        self.at[size].append(gap)

    def take(self, least: int) -> tuple[int, tuple] | None:
        """Smallest gap of at least this size."""
        i = bisect.bisect_left(self.sizes, least)
        if i == len(self.sizes):
            return None
        size = self.sizes[i]
        gap = self.at[size].pop()
        if not self.at[size]:
            del self.at[size], self.sizes[i]
        return size, gap


PLACED, GAP, ITEM = 0, 1, 2


def sweep(ids: np.ndarray, sizes: np.ndarray, is_item: np.ndarray, opens: int, capacity: int,
          last: bool) -> list[tuple]:
    """One range, its rows by size descending. Rows (what, id, bin, size, offset, fresh, rank):
    pieces placed, gaps left (fresh if untouched) and pieces left. Pieces larger than `opens`
    open sequences, as many to each as all fit; a sequence is named by its first piece. In the
    last sweep every piece without a gap opens one."""
    out: list[tuple] = []
    gaps, current = Gaps(), None
    for i, s in zip(ids[~is_item].tolist(), sizes[~is_item].tolist()):
        gaps.put(s, (i, True))
    rank = 0
    for i, s in zip(ids[is_item].tolist(), sizes[is_item].tolist()):
        if s > opens:
            if current is None or current[1] < s:
                if current is not None:
                    gaps.put(current[1], (current[0], False))
                current = [i, capacity]
            out.append((PLACED, i, current[0], s, capacity - current[1], False, 0))
            current[1] -= s
            continue
        if current is not None:
            gaps.put(current[1], (current[0], False))
            current = None
        got = gaps.take(s)
        if got is None and last:
            out.append((PLACED, i, i, s, 0, False, 0))
            gaps.put(capacity - s, (i, False))
        elif got is None:
            out.append((ITEM, i, 0, s, 0, False, rank))
            rank += 1
        else:
            room, (name, _) = got
            out.append((PLACED, i, name, s, capacity - room, False, 0))
            gaps.put(room - s, (name, False))
    if current is not None:
        gaps.put(current[1], (current[0], False))
    fresh = 0
    for s in reversed(gaps.sizes):
        for name, untouched in gaps.at[s]:
            if s > 0:
                out.append((GAP, 0, name, s, 0, untouched, fresh if untouched else -1))
                fresh += untouched
    return out


def match_ranges(counts: list[dict]) -> list[tuple]:
    """Pair the ranges' left pieces with gaps of ranges before them, nearest first.

    counts: part, items, largest, gaps, smallest by range, in range order. A gap takes as many
    pieces as surely fit. Rows (item part, first rank, pieces, gap part, gap rank, pieces each);
    gaps go by rank downwards.
    """
    stack: list[list[int]] = []
    out = []
    for r in counts:
        need, at = r["items"], 0
        while need and stack:
            part, free, smallest = stack[-1]
            each = max(1, smallest // r["largest"])
            n = min(need, free * each)
            out.append((r["part"], at, n, part, free - 1, each))
            used = -(-n // each)
            stack[-1][1] -= used
            if not stack[-1][1]:
                stack.pop()
            need, at = need - n, at + n
        if r["gaps"]:
            stack.append([r["part"], r["gaps"], r["smallest"]])
    return out


_ROW = "part int, what int, id long, bin long, size long, offset long, fresh boolean, rank long"


def pack(items: DataFrame, capacity: int = CAPACITY, per_range: int = PER_RANGE) -> DataFrame:
    """(id, bin, offset) for each row of items (id long, unique; size from 1 to capacity).

    Every sequence holds at most `capacity`, its pieces gapless from offset 0. An empty table
    gives no rows. Each round writes its state to the shared folder, so a lost executor costs
    part of a round.
    """
    spark = items.sparkSession
    whole = items.where(F.col("size") >= capacity).select(
        "id", F.col("id").alias("bin"), F.lit(0).cast("long").alias("offset"))
    state = c.cut(items.where(F.col("size") < capacity).select(
        "id", F.col("size").cast("long").alias("size"), F.lit(True).alias("item")))
    placed = [whole]
    while True:
        seen = state.agg(F.count_if("item").alias("items"), F.count("*").alias("n"),
                         F.max(F.when(F.col("item"), F.col("size"))).alias("largest"),
                         F.max(F.when(~F.col("item"), F.col("size"))).alias("gap")).first()
        if not seen["items"]:
            break
        order = [F.desc("size"), F.asc("item"), F.xxhash64("id")]
        if seen["n"] <= per_range:
            ranged = state.coalesce(1).sortWithinPartitions(*order)
            swept = c.cut(_sweep_ranges(ranged, capacity, capacity, True))
            placed.append(swept.where(F.col("what") == PLACED).select("id", "bin", "offset"))
            break
        gap, largest = seen["gap"] or 0, seen["largest"]
        opens = capacity
        if largest > gap:
            fit = capacity // largest
            opens = max(gap, capacity // (fit + 1) if fit < 8 else largest // 2)
        ranges = -(-2 * seen["n"] // per_range)
        ranged = state.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        swept = c.cut(_sweep_ranges(ranged, opens, capacity, False))
        counts = swept.where((F.col("what") == ITEM) | F.col("fresh")).groupBy("part").agg(
            F.count_if(F.col("what") == ITEM).alias("items"), F.count_if("fresh").alias("gaps"),
            F.max(F.when(F.col("what") == ITEM, F.col("size"))).alias("largest"),
            F.min(F.when(F.col("fresh"), F.col("size"))).alias("smallest"))
        plan = match_ranges(sorted((r.asDict() for r in counts.collect()),
                                   key=lambda r: r["part"]))
        placed.append(swept.where(F.col("what") == PLACED).select("id", "bin", "offset"))
        left = swept.where(F.col("what") == ITEM).select("part", "rank", "id", "size")
        gaps = swept.where(F.col("what") == GAP).select("part", "rank", "bin", "size")
        if plan:
            matched = c.cut(_place_by_rank(spark, left, gaps, plan, capacity))
            placed.append(matched.select("id", "bin", "offset"))
            used = matched.groupBy("bin").agg(F.sum("size").alias("used"))
            left = left.join(matched.select("id"), "id", "left_anti")
            gaps = gaps.join(used, "bin", "left").withColumn(
                "size", F.col("size") - F.coalesce("used", F.lit(0))).where("size > 0")
        smallest = left.agg(F.min("size")).first()[0]
        gaps = gaps.where(F.col("size") >= F.lit(smallest))
        was = state
        state = c.cut(left.select("id", "size", F.lit(True).alias("item")).union(
            gaps.select(F.col("bin").alias("id"), "size", F.lit(False).alias("item"))))
        c.discard(was)
    out = placed[0]
    for more in placed[1:]:
        out = out.union(more)
    return out


def _sweep_ranges(ranged: DataFrame, opens: int, capacity: int, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = [[x.to_numpy(zero_copy_only=False) for x in b.columns] for b in batches]
        if not held:
            return
        ids, sizes, item = (np.concatenate(x) for x in zip(*held))
        rows = sweep(ids, sizes, item.astype(bool), opens, capacity, last)
        if rows:
            cols = list(zip(*rows))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(),
                     pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), pa.int32()),
                 *(pa.array(list(x), t) for x, t in zip(cols, types))],
                names=["part", "what", "id", "bin", "size", "offset", "fresh", "rank"])

    return ranged.select("id", "size", "item").mapInArrow(run, _ROW)


def _place_by_rank(spark: SparkSession, left: DataFrame, gaps: DataFrame, plan: list[tuple],
                   capacity: int) -> DataFrame:
    """Pieces placed by the plan, of at most two rows for each range and so broadcast."""
    steps = F.broadcast(spark.createDataFrame(
        plan, "ipart int, first long, n long, gpart int, top long, each long"))
    at = F.col("rank") - F.col("first")
    items = left.join(steps, (F.col("part") == F.col("ipart")) & (at >= 0) & (at < F.col("n")))
    items = items.select("id", "size", "gpart", (F.col("top") - F.floor(at / F.col("each"))).cast(
        "long").alias("grank"), (at % F.col("each")).alias("turn"))
    fresh = gaps.where("rank >= 0").select(
        F.col("part").alias("gpart"), F.col("rank").alias("grank"), "bin",
        F.col("size").alias("room"))
    turn = Window.partitionBy("gpart", "grank").orderBy("turn").rowsBetween(
        Window.unboundedPreceding, -1)
    both = items.join(fresh, ["gpart", "grank"])
    return both.select("id", "bin", "size", (
        capacity - F.col("room") + F.coalesce(F.sum("size").over(turn), F.lit(0))).alias("offset"))


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY
           ) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs.

    Repeated rows, and rows that share a key or have none, are documents of their own: pieces
    are numbered when they are first written, and only read after that.
    """
    pieces = tokenized_pieces(docs, key, text, capacity)
    pieces = c.cut(pieces.withColumn("id", F.monotonically_increasing_id()))
    place = pack(pieces.select("id", F.col("length").alias("size")), capacity)
    place = place.withColumnRenamed("bin", "sequence_id")
    return pieces.join(place, "id").select(key, "piece", "start", "length", "ids_crc32",
                                           "sequence_id", "offset")


def sequences(docs: DataFrame, placement: DataFrame, key: str = "doc_id", text: str = "text",
              capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the packed sequences' ids, from documents with distinct keys.

    A sequence has at most `capacity` ids, so no group is larger.
    """
    ids = tokenized_pieces(docs, key, text, capacity, with_ids=True).select(key, "piece", "ids")
    placed = ids.join(placement.select(key, "piece", "sequence_id", "offset"), [key, "piece"])
    rows = placed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias(
        "ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(c.table(spark, sf_dir, "documents"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the last; its rows are the pieces with their places."""
    return packed(docs)
