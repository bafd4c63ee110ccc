"""Helpers shared by the operators: tables, lineage cuts, splits, Arrow maps and components."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = r"\x20\x09-\x0D"
HUB = 1 / 1024       # share of all edges from which a node's minimum is broadcast


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; only a local session may go without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set")
    made = tempfile.mkdtemp(prefix="ledgerloom-llm-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: a plan of one scan, safe to recompute."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._llm_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Remove tables made by cut() that nothing will read again."""
    for df in frames:
        path = getattr(df, "_llm_path", None)
        if path:
            jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def _kept() -> dict:
    """What this process keeps between tasks."""
    return sys.modules.setdefault("_ledgerloom_llm_kept", types.ModuleType("kept")).__dict__


def once(key: object, make: Callable):
    """make()'s value, kept for the life of the process: a task's functions come by value, and
    what they keep in module globals would be made anew for every task."""
    kept = _kept()
    if key not in kept:
        kept[key] = make()
    return kept[key]


def newest(slot: str, key: object, make: Callable):
    """make()'s value, kept until another key asks for the slot. For what belongs to one job:
    processes outlive jobs, and once() would keep what each of them has left."""
    kept = _kept()
    if slot not in kept or kept[slot][0] != key:
        kept.pop(slot, None)                     # first, so that there are never two
        kept[slot] = key, make()
    return kept[slot][1]


def remainder(id_column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_column).cast("string")) % F.lit(n)


def map_arrow(df: DataFrame, rows: Callable[[dict[str, pa.Array]], dict[str, list]],
              schema: str) -> DataFrame:
    """Apply rows to the columns of each Arrow batch; it returns the columns of schema."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    arrow = pa.schema([(n, _ARROW[x.strip().split(" ", 1)[1]])
                       for n, x in zip(names, schema.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = rows({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
    "boolean": pa.bool_(), "float": pa.float32(), "array<float>": pa.list_(pa.float32()),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()), "binary": pa.binary(),
    "array<string>": pa.list_(pa.string()),
}


def _fingerprint(edges: DataFrame) -> tuple:
    """Count and order-free hash of a set of edges."""
    h = F.xxhash64("big", "small")
    row = edges.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)),
                    F.sum(F.shiftrightunsigned(h, 32))).first()
    return tuple(row)


def _looked_up(rows: DataFrame, low: DataFrame, key: str, total: int) -> DataFrame:
    """rows with m of their key from low (key, m, n). Keys of at least HUB of `total` rows, at most
    1 / HUB of them, are looked up by broadcast where the rows are; the others by a shuffle."""
    least = F.lit(max(2, int(total * HUB)))
    hubs = F.broadcast(low.where(F.col("n") >= least).select(key, "m"))
    others = rows.join(hubs.select(key), key, "left_anti")
    return rows.join(hubs, key).unionByName(
        others.join(low.where(F.col("n") < least).select(key, "m").hint("merge"), key))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges, root being the smallest node reachable.

    Alternating large and small stars: each round is two grouped minima and two equi-joins on
    edges, repeated until the edges stop changing (logarithmically many rounds). Groups are
    only ever reduced to a minimum, so a node with very many edges costs no task more than a
    partial aggregate, and the minima of such nodes are looked up by broadcast.
    """
    x, y = F.col(a), F.col(b)
    now = cut(edges.where(x != y).select(F.greatest(x, y).alias("big"),
                                         F.least(x, y).alias("small")).distinct())
    was = _fingerprint(now)
    while was[0]:
        both = now.select(F.col("big").alias("u"), F.col("small").alias("v")).union(
            now.select(F.col("small").alias("u"), F.col("big").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        low = low.select("u", F.least("u", "m").alias("m"), "n")
        large = _looked_up(both.where("v > u"), low, "u", 2 * was[0]).where("v <> m").select(
            F.col("v").alias("big"), F.col("m").alias("small")).distinct()
        low = large.groupBy("big").agg(F.min("small").alias("m"), F.count("*").alias("n"))
        small = _looked_up(large, low, "big", 2 * was[0]).where("small <> m").select(
            F.col("small").alias("big"), F.col("m").alias("small")).union(
            low.select("big", F.col("m").alias("small"))).distinct()
        new = cut(small)
        discard(now)
        now, is_ = new, _fingerprint(new)
        if is_ == was:
            break
        was = is_
    leaves = now.groupBy("big").agg(F.min("small").alias("root"))
    out = leaves.select(F.col("big").alias("node"), "root")
    return out.union(leaves.select(F.col("root").alias("node"), "root").distinct())
