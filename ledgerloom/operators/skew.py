"""Building blocks that keep hot keys and hot groups from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALT_BUCKETS = 64
SPREAD = 1 << 16
BROADCAST_ROWS = 100_000


def sized(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A table kept for joining to a large one: broadcast if it has at most `limit` rows, else
    hinted to meet it by a shuffle. It is counted, so it should be cheap to read."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small.hint("merge")


def heavy_keys(
    df: DataFrame, key: str, share: float | None = None, min_rows: int = 100_000
) -> DataFrame:
    """Keys holding at least `share` of the rows: never more than 1/share of them.

    The share defaults to that of one shuffle partition, or 1/500 if there are fewer. One
    pass with a fixed-size sketch per task and no shuffle by key; sketches are merged by
    groups of tasks before one task merges the groups. The answer only steers salting, so an
    approximate count is enough.
    """
    if share is None:
        share = 1 / max(500, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    most = int(1 / share)
    tracked = min(1_000_000, 8 * most)
    tasks = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"),
        F.pmod(F.spark_partition_id(), F.lit(SALT_BUCKETS)).alias("_tasks"),
    )
    by_tasks = tasks.groupBy("_tasks").agg(
        F.expr(f"approx_top_k_accumulate(_key, {tracked})").alias("_sketch"),
        F.count(F.lit(1)).alias("_rows"),
    )
    # Grouped by a constant: without input there is nothing to merge, and no row.
    stats = by_tasks.withColumn("_all", F.lit(0)).groupBy("_all").agg(
        F.expr(f"approx_top_k_combine(_sketch, {tracked})").alias("_sketch"),
        F.sum("_rows").alias("n"),
    ).select(F.expr(f"approx_top_k_estimate(_sketch, {most})").alias("top"), "n")
    return (
        stats.select(F.explode("top").alias("t"), "n")
        .where(F.col("t.count") >= F.greatest(F.col("n") * share, F.lit(min_rows)))
        .select(F.col("t.item").alias(key))
    )


def largest_groups(
    groups: DataFrame, rows: str, share: float | None = None, min_rows: int = 2
) -> DataFrame:
    """Of a table with a row per key, the keys with most rows: no more than 1/share of them, so
    that any other key holds less than that share of all rows, and only those of at least
    `min_rows`. The share defaults to that of one shuffle partition, or 1/500 if there are fewer."""
    if share is None:
        share = 1 / max(500, int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return groups.orderBy(F.desc(rows)).limit(int(1 / share)).where(F.col(rows) >= min_rows)


def spread_left_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    order: Column,
    known: DataFrame,
    buckets: int = SPREAD,
) -> DataFrame:
    """Left join of raw rows to a lookup that is unique on `key`.

    `known` holds the lookup's rows for the heavy keys, with the columns that are wanted; it comes
    from largest_groups and is broadcast. Rows with a heavy or null key travel under a made-up key,
    spread by a hash of their order so that a retried task repeats itself, and ignore whatever they
    meet; all others find their partner by the shuffle. The lookup is neither repeated nor
    shuffled again if it is already partitioned by key.
    """
    names = [c for c in lookup.columns if c != key]
    partner = F.struct(*names)
    heavy = known.select(key, F.lit(True).alias("_hot"), partner.alias("_known"))
    marked = rows.join(F.broadcast(heavy), key, "left")
    aside = F.col("_hot").isNotNull() | F.col(key).isNull()
    spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(order), F.lit(buckets)).cast("string"))
    marked = marked.withColumn("_key", F.when(aside, spread).otherwise(F.col(key)))
    others = lookup.select(F.col(key).alias("_key"), partner.alias("_met"))
    joined = marked.join(others, "_key", "left")
    found = F.when(F.col("_hot"), F.col("_known")).when(~aside, F.col("_met"))
    return joined.select(*rows.columns, *[found[c].alias(c) for c in names])


def first_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First `n` rows of each group, ranked from 1, in two steps.

    Each input partition keeps its own first n (a partial group limit), groups are then
    cut per salt, and only n rows per salt reach the task that ranks the whole group.
    """
    salt = F.pmod(F.spark_partition_id(), F.lit(SALT_BUCKETS))
    salted = df.withColumn("_salt", salt)
    by_salt = W.partitionBy(*keys, "_salt").orderBy(*order)
    by_group = W.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn(rank, F.row_number().over(by_salt))
        .where(F.col(rank) <= n)
        .drop("_salt")
        .withColumn(rank, F.row_number().over(by_group))
        .where(F.col(rank) <= n)
    )
