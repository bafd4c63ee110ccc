"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into parts, correlated bits together. Each part gets a threshold of
its own; they sum to the distance less the parts plus one, so two fingerprints within the
distance must be within the threshold of some part. Dynamic programming picks the thresholds,
and the number of parts, that promise the fewest rows and candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

BITS = 64
SEED = 42
DISTANCE = 3
SHINGLE = 3
SAMPLE = 4000        # distinct fingerprints that the design is estimated on
PARTS = (2, 3, 4)
ROW_COST = 100.0     # a signature row against comparing one candidate pair
RUN = 2048           # fingerprints of one key compared in memory; larger keys are split again
LEVELS = 3
CHUNK = 1 << 16      # shingles hashed at once
NO_ID = 1 << 62      # keys of rows without a doc_id begin here


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority of the hashes' bits; a null text or one without words has fingerprint 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
    ends = len(words) - shingle + 1 if len(words) >= shingle else 1
    digest, votes = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, ends, CHUNK):
        if len(words) < shingle:
            h = [digest(words[0], SEED)]
        else:
            part = words[at:at + CHUNK + shingle - 1]
            h = [digest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(shingle)))]
        bits = np.unpackbits(np.array(h, np.uint64).view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        votes += bits.sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > ends, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): the fingerprint as a signed 64-bit number, of every row."""

    def rows(cols: dict[str, pa.Array]) -> dict[str, list]:
        fps = np.array([fingerprint(x, shingle) for x in cols["t"].to_pylist()], np.uint64)
        return {"id": cols["id"], "fp": fps.view(np.int64)}

    return c.map_arrow(docs.select(F.col(key).cast("long").alias("id"),
                                   F.col(text).cast("binary").alias("t")), rows,
                       "id long, fp long")


def group_bits(bits: np.ndarray, parts: int) -> list[np.ndarray]:
    """Bit numbers in groups of near equal size, each grown from its most correlated bits."""
    width = bits.shape[1]
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.abs(np.nan_to_num(np.corrcoef(bits.T))) if len(bits) > 1 else np.eye(width)
    np.fill_diagonal(corr, 0)
    left, groups = list(range(width)), []
    for i in range(parts):
        size = width // parts + (i < width % parts)
        sub = corr[np.ix_(left, left)]
        group = [left[int(sub.sum(1).argmax())]]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(rest[int(corr[np.ix_(rest, group)].mean(1).argmax())])
        left = [b for b in left if b not in group]
        groups.append(np.array(sorted(group)))
    return groups


def ball(width: int, radius: int) -> int:
    """How many keys of `width` bits lie within `radius`."""
    total, term = 0, 1
    for d in range(radius + 1):
        total += term
        term = term * (width - d) // (d + 1)
    return total


def allocate(cost: np.ndarray, total: int) -> list[int]:
    """Thresholds from -1 (part unused) up, summing to `total`, of least summed cost.

    cost[i, t + 1] is the cost of threshold t in part i.
    """
    parts, options = cost.shape
    span = total + parts
    best = np.full((parts + 1, span + 1), np.inf)
    best[0, 0] = 0
    pick = np.zeros((parts + 1, span + 1), int)
    for i in range(parts):
        for s in range(span + 1):
            for t in range(min(options, s + 1)):
                if best[i, s - t] + cost[i, t] < best[i + 1, s]:
                    best[i + 1, s], pick[i + 1, s] = best[i, s - t] + cost[i, t], t
    out, s = [], span
    for i in range(parts, 0, -1):
        out.append(int(pick[i, s]) - 1)
        s -= pick[i, s]
    return out[::-1]


def design(sample: np.ndarray, n: int, distance: int = DISTANCE
           ) -> list[tuple[np.ndarray, int]]:
    """Parts (bit numbers, threshold) for n distinct fingerprints, estimated on a sample."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    plans = []
    for parts in PARTS:
        groups = group_bits(bits.astype(np.float32), parts)
        total = distance - parts + 1
        cost = np.zeros((parts, total + parts + 1))
        for i, g in enumerate(groups):
            x = bits[:, g].astype(np.float32)
            apart = (x @ (1 - x).T + (1 - x) @ x.T).round().astype(int)
            np.fill_diagonal(apart, BITS + 1)
            seen = np.bincount(np.minimum(apart.ravel(), len(g) + 1), minlength=len(g) + 2)
            pairs = max(1, len(x) * (len(x) - 1))
            for t in range(total + parts):
                within = max(seen[:t + 1].sum() / pairs, ball(len(g), t) / 2.0 ** len(g))
                cost[i, t + 1] = ROW_COST * n * ball(len(g), t) + within * float(n) * n / 2
        ts = allocate(cost, total)
        plans.append((sum(cost[i, t + 1] for i, t in enumerate(ts)),
                      [(g, t) for g, t in zip(groups, ts) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


def _project(fps: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The given bits of each fingerprint, packed into one number."""
    key = np.zeros(len(fps), np.uint64)
    for j, b in enumerate(bits):
        key |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return key


def signatures(nodes: DataFrame, plan: list[tuple[np.ndarray, int]]) -> DataFrame:
    """(part, key, role, fp, id): each node under its own key of every part, and as a probe
    under the keys within the part's threshold. Roles: 2 probe, 3 probe and index."""

    def rows(cols: dict[str, pa.Array]) -> dict[str, np.ndarray]:
        fp = cols["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
        ids = cols["id"].to_numpy(zero_copy_only=False)
        part, key, role, at = [], [], [], []
        for i, (bits, t) in enumerate(plan):
            own = _project(fp, bits)
            for d in range(t + 1):
                for flips in combinations(range(len(bits)), d):
                    mask = np.uint64(sum(1 << f for f in flips))
                    part.append(np.full(len(fp), i, np.int32))
                    key.append(own ^ mask)
                    role.append(np.full(len(fp), 3 if d == 0 else 2, np.int32))
                    at.append(np.arange(len(fp)))
        where = np.concatenate(at)
        return {"part": np.concatenate(part), "key": np.concatenate(key).view(np.int64),
                "role": np.concatenate(role), "fp": fp[where].view(np.int64), "id": ids[where]}

    return c.map_arrow(nodes, rows, "part int, key long, role int, fp long, id long")


def near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def forest(fp: np.ndarray, role: np.ndarray, ids: np.ndarray, distance: int
           ) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row number, root row number) joining what links join: rows less components."""
    n = len(fp)
    label = np.arange(n)
    while True:
        new = label.copy()
        for at in range(0, n, 512):
            b = slice(at, at + 512)
            ok = near(fp[b, None], fp[None, :], distance)
            ok &= ((role[b, None] & role[None, :] & 1) | (role[b, None] + role[None, :] == 5)) > 0
            ok[np.arange(ok.shape[0]), np.arange(at, at + ok.shape[0])] = True
            new[b] = np.where(ok, label[None, :], n).min(1)
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def compare_runs(sorted_rows: DataFrame, distance: int, limit: int) -> DataFrame:
    """Link rows of equal (part, key) in partitions sorted by them.

    kind 0: an edge between ids a and b. kind 1: a row of a key with more than `limit` rows,
    not compared (part, key, role, fp and id as they came).
    """

    def edges(part, key, role, fp, ids):
        """Compare within runs, all complete and of at most `limit` rows."""
        n = len(fp)
        same = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate([[0], same, [n]])
        size = np.diff(starts)
        a, b = [], []
        end = np.repeat(starts[1:], size)
        small = np.repeat(size <= 32, size)
        alive = np.flatnonzero(small & (np.arange(n) + 1 < end))
        shift = 1
        while len(alive):
            j = alive + shift
            pair = (role[alive] & role[j] & 1) | (role[alive] + role[j] == 5)
            ok = (pair > 0) & near(fp[alive], fp[j], distance)
            a.append(ids[alive[ok]])
            b.append(ids[j[ok]])
            shift += 1
            alive = alive[alive + shift < end[alive]]
        for s, e in zip(starts[:-1][size > 32], starts[1:][size > 32]):
            x, y = forest(fp[s:e], role[s:e], ids[s:e], distance)
            a.append(ids[s:e][x])
            b.append(ids[s:e][y])
        return np.concatenate(a or [ids[:0]]), np.concatenate(b or [ids[:0]])

    def out(kind, part, key, role, fp, a, b):
        n = len(a)
        fill = lambda v, t: np.full(n, v, t) if np.isscalar(v) else v
        return pa.RecordBatch.from_arrays(
            [pa.array(fill(kind, np.int32)), pa.array(fill(part, np.int32)),
             pa.array(fill(key, np.int64)), pa.array(fill(role, np.int32)),
             pa.array(fill(fp, np.int64)), pa.array(a), pa.array(b)],
            names=["kind", "part", "key", "role", "fp", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None   # the last run, perhaps not complete
        large = None                           # key of a run already known to be too large
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if not len(new[0]):
                continue
            rows = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            part, key = rows[0], rows[1]
            cutat = int(np.flatnonzero((part != part[-1]) | (key != key[-1]))[-1]) + 1 \
                if ((part != part[-1]) | (key != key[-1])).any() else 0
            yield from done([x[:cutat] for x in rows], large)
            last = (int(part[-1]), int(key[-1]))
            held = [x[cutat:] for x in rows]
            if len(held[0]) > limit or large == last:
                p, k, r, f, i = held
                yield out(1, p, k, r, f.view(np.int64), i, i)
                large, held = last, None
        if held is not None:
            yield from done(held, large)

    def done(rows, large):
        part, key, role, fp, ids = rows
        if not len(fp):
            return
        change = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1
        size = np.diff(np.concatenate([[0], change, [len(fp)]]))
        over = np.repeat(size > limit, size)
        if large is not None:
            over |= (part == large[0]) & (key == large[1])
        if over.any():
            yield out(1, part[over], key[over], role[over], fp[over], ids[over], ids[over])
            part, key, role, fp, ids = (x[~over] for x in rows)
            if not len(fp):
                return
        a, b = edges(part, key, role, fp.view(np.uint64), ids)
        if len(a):
            yield out(0, 0, 0, 0, 0, a, b)

    return sorted_rows.select("part", "key", "role", "fp", "id").mapInArrow(
        run, "kind int, part int, key long, role int, fp long, a long, b long")


def _split_again(rest: DataFrame, level: int, distance: int) -> DataFrame:
    """Rows of too large keys under finer ones: four new parts of the bits, one of which two
    near fingerprints must share."""
    order = np.random.default_rng(level).permutation(BITS)
    groups = [np.sort(g) for g in np.array_split(order, distance + 1)]

    def rows(cols: dict[str, pa.Array]) -> dict[str, np.ndarray]:
        part, key, role, fp, ids = (cols[x].to_numpy(zero_copy_only=False)
                                    for x in ("part", "key", "role", "fp", "id"))
        n = len(fp)
        mixed = []
        for i, g in enumerate(groups):
            k = _project(fp.view(np.uint64), g) * np.uint64(0x9E3779B97F4A7C15)
            k ^= key.view(np.uint64) + part.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            mixed.append(k * np.uint64(0x165667B19E3779F9) + np.uint64(i))
        m = len(groups)
        return {"part": np.repeat(np.arange(m, dtype=np.int32), n),
                "key": np.concatenate(mixed).view(np.int64), "role": np.tile(role, m),
                "fp": np.tile(fp, m), "id": np.tile(ids, m)}

    return c.map_arrow(rest, rows, "part int, key long, role int, fp long, id long")


def _block_pairs(rest: DataFrame) -> DataFrame:
    """Rows of too large keys under every pair of blocks that holds them, so that any two rows
    of a key still meet and no group is larger than two blocks of about half a run."""
    size = rest.groupBy("part", "key").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / F.lit(RUN // 4)).cast("int")
    own = F.pmod(F.xxhash64("fp", "id"), F.col("blocks")).cast("int")
    paired = rest.join(size, ["part", "key"]).withColumn("blocks", blocks).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = paired.select("*", other.alias("other"))
    key = F.xxhash64("part", "key", F.least("own", "other"), F.greatest("own", "other"))
    return paired.select(F.lit(0).alias("part"), key.alias("key"), "role", "fp", "id")


def link(nodes: DataFrame, distance: int = DISTANCE, run: int = RUN, levels: int = LEVELS
         ) -> DataFrame:
    """Edges (a, b) between ids of nodes (fp, id; fp distinct) whose transitive closure is that
    of all pairs within the distance. Dense keys give a spanning forest, not all pairs."""
    spark = nodes.sparkSession
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("fp")).select("fp").limit(SAMPLE).toArrow()
    fps = sample.column("fp").to_numpy().astype(np.int64).view(np.uint64)
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    rows = signatures(nodes, design(fps, n, distance))
    found, level = None, 0
    while True:
        dealt = rows.repartition("part", "key").sortWithinPartitions("part", "key")
        last = level > levels
        got = c.cut(compare_runs(dealt, distance, (1 << 60) if last else run))
        edges = got.where("kind = 0").select("a", "b")
        found = edges if found is None else found.union(edges)
        rest = got.where("kind = 1").select("part", "key", "role", "fp", F.col("a").alias("id"))
        if last or rest.isEmpty():
            return found
        level += 1
        rows = _split_again(rest, level, distance) if level <= levels else _block_pairs(rest)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(key, fingerprint, component_id) of every row of docs.

    component_id is the smallest key reachable by links of at most `distance` differing bits
    between fingerprints of `shingle` words.
    Null and empty texts share fingerprint 0 and link like any other. A row with a null key is
    fingerprinted, and gets the component of its fingerprint, null if that has no other key.
    Repeated rows come back as often as they came. A very long text is fingerprinted whole, in
    chunks of shingles; other columns are left out, whatever their names.
    """
    fps = c.cut(fingerprints(docs, key, text, shingle))
    nodes = c.cut(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("id")))
    roots = components_of(nodes, distance)
    named = nodes.join(roots, nodes.id == roots.node, "left").select(
        "fp", F.coalesce("root", "id").alias("component_id"))
    return fps.join(named, "fp", "left").select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id")


def components_of(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    return c.components(link(nodes, distance))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates (op6_simhash's shingle length and distance)
    the row with the smallest doc_id stays.

    Of rows that share that doc_id, one stays. Rows without a doc_id stay unless their text is
    a near duplicate of one that has an id.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID) + F.shiftrightunsigned(
        F.xxhash64(F.coalesce("text", F.lit(""))), 3))
    groups = c.cut(near_duplicates(docs.select(key.alias("doc_id"), "text")))
    kept = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = c.cut(kept.withColumnRenamed("doc_id", "__kept")).hint("merge")
    once = docs.join(kept.where("n = 1").select("__kept"), F.col("doc_id") == F.col("__kept"),
                     "left_semi")
    repeated = kept.where("n > 1")
    out = once
    if not repeated.isEmpty():
        again = docs.join(repeated.select("__kept"), F.col("doc_id") == F.col("__kept"),
                          "left_semi")
        first = again.groupBy("doc_id").agg(
            F.min_by(F.struct(*docs.columns), F.xxhash64(F.struct(*docs.columns))).alias("r"))
        out = out.unionByName(first.select("r.*"))
    if not docs.where("doc_id is null").isEmpty():
        alone = groups.where((F.col("doc_id") >= NO_ID) & (F.col("component_id") >= NO_ID))
        alone = alone.select(F.col("doc_id").alias("__kept")).distinct()
        out = out.unionByName(docs.where("doc_id is null").join(
            alone, key == F.col("__kept"), "left_semi"))
    return out
