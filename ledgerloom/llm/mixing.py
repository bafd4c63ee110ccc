"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations.

A document's key is u ** (1 / weight) for a uniform u drawn from its id; larger keys come first
(the same order as exponential keys -ln(u) / weight from the smallest). A source takes whole
epochs of all its documents first, then documents in key order until the rest of its budget is
spent, the last one only if that brings the total nearer.

Prefix sums need no sort of a source: keys are cut into bins of equal width, sizes are summed
by source and bin, and only documents of the one bin in which a budget ends are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5          # of all sizes, given out in total
REPEAT = 2.0         # no source, and no document, gives more than so many times its size
BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """In [0, 1), from the first 52 bits of the md5 of the key's text; reruns agree."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            repeat: float = REPEAT) -> DataFrame:
    """target by source, from (source, source_size): one row for each source.

    Sources by code point, null last, get the weights in turn. A target above repeat times the
    source's size stops there and its excess goes to the others by weight, until none is above.
    With sources in the order of size by weight, those that stop come first: the level (target
    by weight) of the others is that of the first that does not stop, and falls after it.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(
        cycle, (F.row_number().over(order) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.lit(repeat) * F.col("source_size"))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding,
                                                      Window.unboundedFollowing)
    total = F.lit(share) * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level)
    settled = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    free = F.coalesce(F.col("weight") * settled, F.col("cap"))
    return leveled.select("source", "source_size", F.least("cap", free).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size",
        weight: str = "weight", bins: int = BINS, carry: tuple[str, ...] = (), **limits
        ) -> DataFrame:
    """(key, size, source_size, target, taken, *carry) of every row of docs.

    docs has a size (words, tokens; not null) and a positive quality weight for each row. taken
    is the size times the copies the mix takes. Null sources are one source. Rows of size 0 are
    taken as their keys come; it costs nothing. Other columns of docs are left out, whatever their
    names. Repeated rows draw the same key and are taken
    one after the other; null keys draw like the empty text. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(source).alias("source"),
                       F.col(size).cast("long").alias("size"),
                       F.col(weight).cast("double").alias("weight"),
                       *[F.col(x).alias(f"carried_{x}") for x in carry])
    u = uniform(F.col("id"))
    rank = F.pow(u, 1.0 / F.col("weight"))
    rows = rows.withColumn("rank", rank).drop("weight")
    rows = c.cut(rows.withColumn("bin", F.least(F.lit(bins - 1), F.floor(
        (1.0 - F.col("rank")) * bins)).cast("int")))
    per_bin = c.cut(rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")))
    goal = targets(per_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")),
                   **limits)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(
        F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = c.cut(goal.withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    edges = per_bin.withColumn("upto", F.sum("bin_size").over(upto)).withColumnRenamed(
        "source", "s")
    edges = edges.join(goal, F.col("s").eqNullSafe(F.col("source")))
    edges = edges.select(
        F.col("s").alias("edge_source"), F.col("bin").alias("edge_bin"), "source_size", "target",
        "epochs", "rest", (F.col("upto") - F.col("bin_size")).alias("before"),
        (F.col("upto") <= F.col("rest")).alias("whole"),
        (F.col("upto") - F.col("bin_size") < F.col("rest")).alias("begun"))
    placed = rows.join(edges, (F.col("bin") == F.col("edge_bin"))
                       & F.col("source").eqNullSafe(F.col("edge_source")))
    fine = placed.where("begun and not whole")
    order = Window.partitionBy("source").orderBy(F.desc("rank"), F.col("id"), F.col("size"))
    fine = fine.withColumn("end", F.col("before") + F.sum("size").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    over = F.col("end") - F.col("rest")
    under = F.col("rest") - (F.col("end") - F.col("size"))
    fine = fine.withColumn("more", ((over <= 0) | ((under > 0) & (over < under))).cast("long"))
    coarse = placed.where("whole or not begun").withColumn(
        "more", F.col("whole").cast("long"))
    kept = [f"carried_{x}" for x in carry]
    columns = ["id", "size", "source_size", "target", "epochs", "more", *kept]
    both = fine.select(*columns).union(coarse.select(*columns))
    return both.select(F.col("id").alias(key), "size", "source_size", "target",
                       ((F.col("epochs") + F.col("more")) * F.col("size")).alias("taken"),
                       *[F.col(k).alias(x) for k, x in zip(kept, carry)])


def with_quality(docs: DataFrame, labels: DataFrame, *carry: str) -> DataFrame:
    """(doc_id, source, size, weight, *carry): weight 2 for label 1, 1/2 for label 0, else 1."""
    best = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max("quality").alias("best")).withColumnRenamed("doc_id", "label_id")
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), *carry)
    weight = F.when(F.col("best") >= 1, 2.0).when(F.col("best") == 0, 0.5).otherwise(1.0)
    return sized.join(best, F.col("doc_id") == F.col("label_id"), "left").select(
        "doc_id", "source", "size", weight.alias("weight"), *carry)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels")
    return mix(with_quality(docs, labels))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it, copies as rows of their own.

    Documents without words carry no size; they have no part in the mix and go. Rows are numbered
    as they are written once, and each is taken as often as its own row of the mix says, whether it
    shares its doc_id with others, repeats them or has none. Columns of docs may have any names but
    those that begin with __mix_.
    """
    rows = c.cut(docs.where(size_of(F.col("text")) > 0).withColumn(
        "__mix_row", F.monotonically_increasing_id()))
    sized = with_quality(rows, c.table(spark, sf_dir, "labels"), "__mix_row")
    plan = mix(sized, carry=("__mix_row",)).where("taken > 0").select("__mix_row", (
        F.col("taken") / F.col("size")).cast("int").alias("__mix_copies"))
    copies = F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))
    return rows.join(plan, "__mix_row").withColumn("__mix_copy", copies).select(*docs.columns)


ORACLES = {"op1_mixing": rf"""
WITH best AS (SELECT doc_id AS label_id, max(quality) AS best FROM labels
              WHERE doc_id IS NOT NULL GROUP BY doc_id),
sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE
           / {float(1 << 52)!r} AS u, best
  FROM documents LEFT JOIN best ON doc_id = label_id),
drawn AS (SELECT *, CASE WHEN best >= 1 THEN sqrt(u) WHEN best = 0 THEN u * u ELSE u END AS rank
          FROM sized),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (
             ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS weight,
           2.0::DOUBLE * source_size AS cap FROM sizes),
leveled AS (
  SELECT *, cap / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
goal AS (
  SELECT source, source_size,
         least(cap, coalesce(weight * max(CASE WHEN level <= ratio THEN level END) OVER (), cap))
           AS target FROM leveled),
epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs
  FROM goal),
ends AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs,
         target - epochs * source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.rank DESC, d.doc_id, d.size
           ROWS UNBOUNDED PRECEDING) AS fin
  FROM drawn d JOIN epochs e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (epochs + CASE WHEN fin <= rest OR (rest > fin - size AND fin - rest < rest - fin + size)
                      THEN 1 ELSE 0 END) * size AS taken
FROM ends"""}
