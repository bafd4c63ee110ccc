"""How filters interact: what each removes in every order, by decision diagrams.

Rows are reduced to the mask of the filters they fail, counted by part. A part's counts form a
decision diagram: a level for each filter, a low child for rows that pass it and a high child for
those that fail, equal subdiagrams shared, and at the leaves the counts. A node weighs what its
leaves weigh. Neighbouring levels are swapped in place, so that every order of the filters comes by
in turn; in each, the path of rows that pass everything holds what is kept after each step, and the
high children beside it what each step removes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

LETTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT = 80        # least distinct words of 100
CAPITALS = 10        # most capitals of 100 characters
SIGNS = b"#$%&*|"
MOST_FILTERS = 8     # orders grow as the factorial
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_INNER = bytes(range(0x80, 0xC0))        # bytes that begin no character

Test = Callable[[bytes, list[bytes]], bool]


def too_short(text: bytes, words: list[bytes]) -> bool:
    return len(words) < MIN_WORDS


def too_repetitive(text: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < DISTINCT * len(words)


def too_loud(text: bytes, words: list[bytes]) -> bool:
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return 100 * capitals > CAPITALS * len(text.translate(None, _INNER))


def has_signs(text: bytes, words: list[bytes]) -> bool:
    return len(text.translate(None, SIGNS)) < len(text)


TESTS: tuple[Test, ...] = (too_short, too_repetitive, too_loud, has_signs)


def failure_masks(docs: DataFrame, tests: tuple[Test, ...] = TESTS, key: str = "doc_id",
                  text: str = "text", part: str = "lang") -> DataFrame:
    """(key, part, mask, h1, h2) of every row of docs: bit i of mask is set if tests[i] finds that
    the text fails; h1 and h2 are a 128-bit digest of the text. A null text is empty, a null part
    the empty string; keys may be null or shared. A text is tested whole, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for value in batch.column(2):
                t = value.as_py() or b""
                words = t.split()
                masks.append(sum(1 << i for i, fails in enumerate(tests) if fails(t, words)))
                d = hashlib.blake2b(t, digest_size=16).digest()
                digests.append((int.from_bytes(d[:8], "little", signed=True),
                                int.from_bytes(d[8:], "little", signed=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(masks, pa.int32()),
                 pa.array([d[0] for d in digests], pa.int64()),
                 pa.array([d[1] for d in digests], pa.int64())],
                names=["key", "part", "mask", "h1", "h2"])

    rows = docs.select(F.col(key).cast("long").alias("key"),
                       F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "key long, part string, mask int, h1 long, h2 long")


def mask_counts(masks: DataFrame, flags: DataFrame, n_tests: int = len(TESTS)) -> DataFrame:
    """(part, mask, n, *flags): rows of failure_masks by part and mask, and of those the ones that
    each boolean column of flags (key, ...) marks. Bit n_tests is set for a copy: a row whose text
    some row of a smaller key has.

    A row without a key has no smaller one and is no copy; of rows that share the smallest key
    none is. Keys of flags may repeat, one mark is enough; null ones mark nothing. Rows of equal
    text are counted by key, and then summed, before they meet in one task.
    """
    names = [x for x in flags.columns if x != "key"]
    marks = flags.where("key is not null").groupBy("key").agg(
        *[F.max(F.coalesce(F.col(x), F.lit(False))).alias(x) for x in names])
    keyed = masks.where("key is not null").join(marks, "key", "left").select(
        *masks.columns, *[F.coalesce(F.col(x), F.lit(False)).alias(x) for x in names])
    bare = masks.where("key is null").select(
        *masks.columns, *[F.lit(False).alias(x) for x in names])
    alike = ["h1", "h2", "part", "mask", *names]
    by_key = keyed.unionByName(bare).groupBy(*alike, "key").agg(F.count("*").alias("n"))
    low = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "n")))
    by_text = c.cut(by_key.groupBy(*alike).agg(
        F.sum("n").alias("n"), low.alias("low"),
        F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("bare")))
    least = by_text.groupBy("h1", "h2").agg(F.min("low.key").alias("least"))
    first = F.col("bare") + F.when(F.col("low.key") == F.col("least"), F.col("low.n")).otherwise(0)
    told = by_text.join(least, ["h1", "h2"]).withColumn("first", first)
    split = told.select("part", *names, F.explode(F.array(
        F.struct("mask", F.col("first").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << n_tests)).alias("mask"),
                 (F.col("n") - F.col("first")).alias("n")))).alias("x"))
    counts = [F.sum(F.when(F.col(x), F.col("x.n")).otherwise(0)).alias(x) for x in names]
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), *counts)


class Diagram:
    """Counts by mask, as a diagram whose level k tests filter order[k].

    A node is a number; low, high and weight hold its children and the sum of its leaves. Every
    path tests every filter, so a swap touches the nodes of two levels only.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], n_filters: int):
        self.order = list(range(n_filters))
        self.low: list[int] = []
        self.high: list[int] = []
        self.weight: list[tuple[int, ...]] = []
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in range(n_filters)]
        width = len(next(iter(counts.values())))
        leaves: dict[tuple[int, ...], int] = {}
        row = []
        for mask in range(1 << n_filters):
            w = counts.get(mask, (0,) * width)
            if w not in leaves:
                leaves[w] = self._add(-1, -1, w)
            row.append(leaves[w])
        for level in range(n_filters - 1, -1, -1):      # bit `level` of a mask is the highest left
            half = 1 << level
            row = [self._node(level, row[m], row[m + half]) for m in range(half)]
            # Filters of lower number stay above: bits below `level` still tell the nodes apart.
        self.root = row[0]

    def _add(self, low: int, high: int, weight: tuple[int, ...]) -> int:
        self.low.append(low)
        self.high.append(high)
        self.weight.append(weight)
        return len(self.low) - 1

    def _node(self, level: int, low: int, high: int) -> int:
        known = self.levels[level]
        if (low, high) not in known:
            weight = tuple(a + b for a, b in zip(self.weight[low], self.weight[high]))
            known[low, high] = self._add(low, high, weight)
        return known[low, high]

    def swap(self, level: int) -> None:
        """Exchange the filters of this level and the next. Nodes of this level stay the same
        functions under the same numbers; those of the next are made anew."""
        upper = self.levels[level]
        self.levels[level], self.levels[level + 1] = {}, {}
        for (a, b), node in upper.items():
            low = self._node(level + 1, self.low[a], self.low[b])
            high = self._node(level + 1, self.high[a], self.high[b])
            self.low[node], self.high[node] = low, high
            self.levels[level][low, high] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """(kept, removed) weights of each step along the path that passes everything."""
        node, out = self.root, []
        for _ in self.order:
            out.append((self.weight[self.low[node]], self.weight[self.high[node]]))
            node = self.low[node]
        return out


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places whose neighbours are exchanged, one after the other, to see every order of n once:
    the last item sweeps through each order of the others."""
    if n < 2:
        return
    down = True
    for place in [*adjacent_swaps(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if place is not None:
            yield place + 1 if down else place       # the sweeping item is now at that end
            down = not down


def all_orders(counts: dict[int, tuple[int, ...]], n_filters: int) -> list[tuple]:
    """(order, step, kept, removed) of every order and step; kept and removed are weights."""
    diagram = Diagram(counts, n_filters)
    out = [(tuple(diagram.order), k, *x) for k, x in enumerate(diagram.steps())]
    for place in adjacent_swaps(n_filters):
        diagram.swap(place)
        out += [(tuple(diagram.order), k, *x) for k, x in enumerate(diagram.steps())]
    return out


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What every filter does at every step of every order, by part.

    counts (part, mask, n, ...) comes from mask_counts and has at most 2 ** len(letters) rows a
    part. Returns (part, filter_order, step, kept, removed, redundant, unique_fails, shapley) and
    <column>_lost for the other columns of counts. No counts give no rows.
    """
    n_filters = len(letters)
    if n_filters > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} filters have too many orders")
    flags = [x for x in counts.columns if x not in ("part", "mask", "n")]
    numbers = ["kept", "removed", "redundant", "unique_fails", *[f"{x}_lost" for x in flags],
               "shapley"]

    def audit(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        steps = all_orders({r["mask"]: tuple(r[x] for x in ("n", *flags)) for r in rows}, n_filters)
        fails, unique, share = {}, {}, dict.fromkeys(range(n_filters), 0)
        for order, k, _, removed in steps:
            share[order[k]] += removed[0]
            if k == 0:
                fails[order[k]] = removed[0]
            if k == n_filters - 1:
                unique[order[k]] = removed[0]
        out = []
        for order, k, kept, removed in steps:
            f = order[k]
            out.append({"part": rows[0]["part"], "filter_order": "".join(letters[x] for x in order),
                        "step": k + 1, **dict(zip(numbers, (
                            kept[0], removed[0], fails[f] - removed[0], unique[f], *removed[1:],
                            share[f])))})
        return pa.Table.from_pylist(out, pa.schema(
            [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()),
             *[(x, pa.int64()) for x in numbers]]))

    return counts.groupBy("part").applyInArrow(
        audit, "part string, filter_order string, step int, "
               + ", ".join(f"{x} long" for x in numbers))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of the four tests and the copies, by language."""
    flags = c.table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("long").alias("key"), (F.col("quality") == 1).alias("good"),
        (F.col("toxic") == 1).alias("toxic"))
    masks = failure_masks(c.table(spark, sf_dir, "documents"))
    return interactions(mask_counts(masks, flags))


ORACLES = {"op11_audit": r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t AS same, min(doc_id) AS first FROM texts GROUP BY t),
marks AS (SELECT doc_id AS marked, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
          FROM labels GROUP BY doc_id),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM texts),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(words) < 100)::INT
         + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM worded JOIN firsts ON t = same LEFT JOIN marks ON doc_id = marked),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
           FROM masks GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
places AS (SELECT filter_order, place, 1 << (ascii(substr(filter_order, place, 1)) - 65) AS bit
           FROM orders, (SELECT unnest(range(1, 6)) AS place)),
steps AS (
  SELECT filter_order, place AS step, substr(filter_order, place, 1) AS letter, bit,
         (sum(bit) OVER (PARTITION BY filter_order ORDER BY place) - bit)::INT AS before
  FROM places),
told AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)
           AS removed,
         coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)
           AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)
           AS good_lost,
         coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)
           AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM told"""}
