"""Near-duplicate embeddings by an inverted multi-index.

Each half of a vector has a codebook of its own; a pair of codes is a cell of a grid. A vector
looks into the cells nearest to it in the order that the multi-sequence algorithm visits them,
as many as a brute-force check on a sample needs for the target recall, and every pair met is
verified in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

COSINE = 0.95
PER_CELL = 200       # vectors of a cell, about; the codes of a half follow from it
CODES = (4, 256)     # fewest and most codes of a half; the grid has as many squared
SAMPLE = 20_000      # vectors that the codebooks are fitted on, at most
QUERIES = 1000       # vectors compared with all others to choose the cells visited
TARGET = 1.0         # mean share of a sampled vector's links that the visited cells must hold
LEAST = 4            # cells visited at least
ROUNDS = 12          # of k-means
BLOCK = 1024         # vectors of one side in one comparison


def codebook(x: np.ndarray, codes: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means centres of x, from evenly spread rows; an empty code keeps its centre."""
    if len(x) == 0:
        return np.zeros((1, x.shape[1]))
    centres = x[np.linspace(0, len(x) - 1, min(codes, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = distances(x, centres).argmin(1)
        for k in range(len(centres)):
            if (near == k).any():
                centres[k] = x[near == k].mean(0)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


def visited(units: np.ndarray, books: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Numbers of the n nearest cells of each vector, nearest first (vectors x n).

    The multi-sequence traversal for a block of vectors at once: with the codes of each half
    sorted by distance, the cell of the i-th and j-th code can only be among the first n if
    i * j is at most n, so only those sums are made and ranked.
    """
    half = units.shape[1] // 2
    a, b = distances(units[:, :half], books[0]), distances(units[:, half:], books[1])
    ia, ib = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
    i, j = np.array([(x, y) for x in range(min(n, a.shape[1])) for y in range(
        min(n // (x + 1), b.shape[1]))]).T
    sums = np.take_along_axis(a, ia[:, i], 1) + np.take_along_axis(b, ib[:, j], 1)
    first = np.argsort(sums, axis=1, kind="stable")[:, :n]
    return np.take_along_axis(ia[:, i] * b.shape[1] + ib[:, j], first, 1)


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: str) -> Column:
    """Neither null, empty nor zero, and every component a finite number."""
    return F.coalesce(
        F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(vector, lambda v: v != 0), F.lit(False))


def fit(classes: DataFrame, width: int, cosine: float, target: float
        ) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """Codebooks, and how many cells to visit for the target recall.

    Both samples are bounded and drawn by a hash of id; the sampled queries are compared with
    every vector, in blocks, on the executors, which send back how many links of which query
    needed how many cells (a table no longer than queries times cells).
    """
    sample = classes.orderBy(F.xxhash64("id")).select("v").limit(SAMPLE).toArrow()
    units = unit(as_matrix(sample.column("v").combine_chunks(), width))
    half, codes = width // 2, int(np.clip((classes.count() / PER_CELL) ** 0.5, *CODES))
    books = (codebook(units[:, :half], codes), codebook(units[:, half:], codes))
    cells = len(books[0]) * len(books[1])
    queries = units[:QUERIES]
    order = visited(queries, books, cells)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(cells)[None, :].repeat(len(queries), 0), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros((0, 2), np.int64)]
        for batch in batches:
            x = unit(as_matrix(batch.column(0), width))
            own = visited(x, books, 1)[:, 0]
            q, r = np.nonzero(queries @ x.T >= cosine)
            found.append(np.stack([q, place[q, own[r]]], axis=1))
        keys, n = np.unique(np.concatenate(found), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n)], names=["q", "at", "n"])

    got = classes.select("v").mapInArrow(run, "q long, at long, n long").groupBy("q", "at").agg(
        F.sum("n").alias("n")).toArrow()
    q, at, n = (got.column(x).to_numpy() for x in ("q", "at", "n"))
    share = n / np.maximum(np.bincount(q, n, len(queries)), 1)[q]
    gained = np.bincount(at, share, cells)
    enough = int(np.searchsorted(np.cumsum(gained), target * gained.sum() - 1e-9)) + 1
    return books, min(cells, max(LEAST, enough))


def _indexed(classes: DataFrame, width: int, books, n: int) -> DataFrame:
    """classes with the unit vector, its cells in order of visit (the first is its own)."""

    def rows(cols: dict[str, pa.Array]) -> dict[str, list]:
        x = unit(as_matrix(cols["v"], width))
        return {"id": cols["id"], "size": cols["size"], "u": list(x),
                "cells": list(visited(x, books, n).astype(np.int32))}

    return c.map_arrow(classes.select("id", "size", "v"), rows,
                       "id long, size long, u array<double>, cells array<int>")


def spanning(links: np.ndarray, left: np.ndarray, right: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, root id) that join what a matrix of links joins; fewer than ids."""
    a, b = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        na = np.minimum(a, np.where(links, b[None, :], top).min(1))
        nb = np.minimum(b, np.where(links, na[:, None], top).min(0))
        if (na == a).all() and (nb == b).all():
            break
        a, b = na, nb
    ids, roots = np.concatenate([left, right]), np.concatenate([a, b])
    linked = np.concatenate([links.any(1), links.any(0)]) & (ids != roots)
    pairs = np.unique(np.stack([ids[linked], roots[linked]]), axis=1)
    return pairs[0], pairs[1]


def compare(indexed: DataFrame, width: int, cosine: float, block: int = BLOCK) -> DataFrame:
    """(kind, a, b): kind 0 says b more links of a, kind 1 joins a and b.

    Visitors and members meet by cell. A cell's members and visitors are cut into blocks that
    meet pairwise, so no group is larger than two blocks; cell sizes are a table of at most
    the grid's size. A link counts for the visitor, and for the member as well if its own
    visits miss the visitor's cell, so counts are the same from both ends.
    """
    spark = indexed.sparkSession
    own = F.element_at("cells", 1)
    members = {r["cell"]: r["n"] for r in indexed.groupBy(own.alias("cell")).agg(
        F.count("*").alias("n")).collect()}
    guests = {r["cell"]: r["n"] for r in indexed.select(F.explode("cells").alias("cell")).groupBy(
        "cell").agg(F.count("*").alias("n")).collect()}
    blocks = spark.createDataFrame(
        [(k, -(-n // block), -(-guests.get(k, 0) // block)) for k, n in members.items()],
        "cell int, mblocks int, gblocks int")
    salt = F.xxhash64("id")
    member = indexed.withColumn("cell", own).join(F.broadcast(blocks), "cell")
    member = member.withColumn("m", F.pmod(salt, F.col("mblocks")).cast("int")).withColumn(
        "g", F.explode(F.sequence(F.lit(0), F.greatest(F.col("gblocks") - 1, F.lit(0)))))
    guest = indexed.withColumn("cell", F.explode("cells")).join(F.broadcast(blocks), "cell")
    guest = guest.withColumn("g", F.pmod(salt, F.col("gblocks")).cast("int")).withColumn(
        "m", F.explode(F.sequence(F.lit(0), F.col("mblocks") - 1)))
    columns = ["cell", "m", "g", "id", "size", "u", "cells"]
    both = member.select(*columns, F.lit(True).alias("member")).union(
        guest.select(*columns, F.lit(False).alias("member")))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        is_member = table.column("member").to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy()
        sizes = table.column("size").to_numpy()
        u = as_matrix(table.column("u").combine_chunks(), width)
        cells = np.stack(table.column("cells").to_numpy(zero_copy_only=False))
        cell = key[0].as_py()
        m, g = np.flatnonzero(is_member), np.flatnonzero(~is_member)
        links = (u[g] @ u[m].T >= cosine) & (ids[g][:, None] != ids[m][None, :])
        rows, cols = np.nonzero(links)
        # the member's visits that miss the guest's own cell
        missed = ~(cells[m][cols] == cells[g][rows, :1]).any(1)
        count = np.bincount(g[rows], sizes[m][cols], len(ids)) + np.bincount(
            m[cols[missed]], sizes[g][rows[missed]], len(ids))
        at = np.flatnonzero(count)
        a, b = spanning(links, ids[g], ids[m])
        return pa.table({
            "kind": pa.array(np.repeat([0, 1], [len(at), len(a)]).astype(np.int32)),
            "a": pa.array(np.concatenate([ids[at], a])),
            "b": pa.array(np.concatenate([count[at].astype(np.int64), b]))})

    return both.groupBy("cell", "m", "g").applyInArrow(run, "kind int, a long, b long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
                    cosine: float = COSINE, target: float = TARGET, block: int = BLOCK
                    ) -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing. Equal vectors are one class: linked with each other, and with what their class is
    linked with, but compared once. Vectors of different lengths never link; each length has an
    index of its own. A row without a key counts in nobody's links and comes back with 0 links
    and no component. Rows that share a key are copies or separate vectors of that key: they
    count as links of each other where they are linked.
    """
    rows = c.cut(vectors.select(F.col(key).cast("long").alias("id"),
                                F.col(vector).cast("array<double>").alias("v")))
    good = rows.where(usable("v") & F.col("id").isNotNull())
    classes = c.cut(good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("size")))
    widths = [r[0] for r in classes.select(F.size("v")).distinct().collect()]
    counts = edges = None
    for width in sorted(widths):
        same = c.cut(classes.where(F.size("v") == width))
        padded = same if width > 1 else same.withColumn("v", F.concat("v", F.array(F.lit(0.0))))
        books, n = fit(padded, max(width, 2), cosine, target)
        got = c.cut(compare(c.cut(_indexed(padded, max(width, 2), books, n)), max(width, 2),
                            cosine, block))
        a = got.where("kind = 0").groupBy("a").agg(F.sum("b").alias("more"))
        b = got.where("kind = 1").select("a", "b")
        counts, edges = (a, b) if counts is None else (counts.union(a), edges.union(b))
    if counts is None:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"),
                           F.col("id").alias("component_id"),
                           F.col("id").isNotNull().alias("kept"))
    roots = c.components(edges)
    known = classes.join(counts, F.col("id") == F.col("a"), "left").drop("a").join(
        roots, F.col("id") == F.col("node"), "left")
    known = known.select(
        F.col("v").alias("cv"),
        (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
        F.coalesce("root", "id").alias("component_id"))
    one = F.when(usable("v") & F.col("id").isNotNull(), F.col("v"))
    out = rows.withColumn("kv", one).join(known, F.col("kv") == F.col("cv"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "embeddings"))
