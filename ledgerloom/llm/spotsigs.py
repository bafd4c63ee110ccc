"""SpotSigs fingerprints, in DataFrame operations only.

A signature is a common word (an anchor) and the chain of content words after it; a text's
fingerprint is the set of its signatures. Likeness is the Jaccard measure of two sets.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

# Common words of English, French, German and Spanish.
ANCHORS = """
a an and are as at be by for from had he in is it not of on or that the there this to was with
au aux ce dans des du elle est et il la le les ne par pas pour que qui se sur un une
als auf das dem den der des die ein eine er es fur für im in ist mit sich und von zu
al con de del el en es la las lo los no para por que se su un una y
""".split()
CHAIN = 3
NOT_A_WORD = r"[^\p{L}\p{N}]+"
NEAR = 0.8
BUCKET_ROWS = 4096


def spelled(signatures_: Column) -> Column:
    """A fingerprint as text: the signatures' last 32 bits in hexadecimal, in order."""
    return F.array_join(F.transform(signatures_, lambda h: F.lpad(
        F.hex(h.bitwiseAND(0xFFFFFFFF)), 8, "0")), "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct sets; equal sets are told by comparison."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(a == b, 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _chain_of(content: Column, chain: int):
    """Hash of the j-th anchor (struct i, w) and the chain after it, null if that is cut short."""
    return lambda s, j: F.when(
        s["i"] - j + chain <= F.size(content),
        F.xxhash64(s["w"], F.slice(content, s["i"] - j + 1, F.lit(chain))))


def fingerprinted(rows: DataFrame, columns: dict[str, str], chain: int = CHAIN) -> DataFrame:
    """rows with a set of signatures for each text column; columns names text -> set.

    A set is the sorted distinct hashes (bigint). Words are lower-cased runs of letters and
    digits. Chains that the text's end cuts short give no signature; a text without any has one
    made of all its words, so an empty text (or a null) is like another one without words only.
    Rows are independent: keys may be null, shared or repeated. A very long text is one row's arrays;
    columns of rows stay, unless their names begin with __ and a set's name.
    The j-th anchor, at word i, has i - j content words before it. Arrays are columns of their
    own on the way, so that each is made once.
    """
    anchors = sorted(set(ANCHORS))
    for text, made in columns.items():
        words, marked, content, found = (f"__{made}_{x}" for x in ("w", "m", "c", "f"))
        rows = rows.withColumn(words, F.filter(
            F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_A_WORD), lambda x: x != ""))
        rows = rows.withColumn(marked, F.filter(F.transform(words, lambda x, i: F.struct(
            i.alias("i"), x.alias("w"))), lambda s: s["w"].isin(*anchors)))
        rows = rows.withColumn(content, F.filter(words, lambda x: ~x.isin(*anchors)))
        rows = rows.withColumn(found, F.array_sort(F.array_distinct(F.filter(
            F.transform(marked, _chain_of(F.col(content), chain)), lambda h: h.isNotNull()))))
        rows = rows.withColumn(made, F.when(F.size(found) > 0, F.col(found)).otherwise(
            F.array(F.xxhash64(words)))).drop(words, marked, content, found)
    return rows


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text",
              bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(key, text, next_text) of every row, next by descending key; the last's is the first's.

    Null keys come last; rows of one key follow each other by text, null text as empty. Keys
    are cut into ranges of about bucket_rows rows. The first row of a range is sent to the
    range before it as well, so that each is a window of its own and texts move once. A plan
    holds three numbers a range, in arrays that count as one literal each.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(key).cast("long").alias("id"))
    n = ids.count()
    wanted = max(1, n // bucket_rows)
    bounds = ids.where("id is not null").agg(F.percentile_approx(
        "id", F.array(*[F.lit(i / wanted) for i in range(1, wanted)]) if wanted > 1
        else F.array(F.lit(0.5)), 10 * wanted)).first()[0] or []
    bounds = sorted(set(bounds))
    below = _count_at_most(F.col("id"), bounds)
    bucket = F.when(F.col("id").isNull(), len(bounds) + 1).otherwise(
        F.lit(len(bounds)) - below).cast("int")
    top = ids.groupBy(bucket.alias("bucket")).agg(F.max("id").alias("top")).collect()
    firsts = dict(sorted((r["bucket"], r["top"]) for r in top))
    rows = docs.select(F.col(key).cast("long").alias("id"),
                       F.coalesce(text, F.lit("")).alias("t")).withColumn("bucket", bucket)
    before = dict(zip(firsts, [*list(firsts)[-1:], *firsts]))
    every, place = range(len(bounds) + 2), F.col("bucket") + 1
    goes = F.try_element_at(_numbers([before.get(b) for b in every], "int"), place)
    first = F.try_element_at(_numbers([firsts.get(b) for b in every], "bigint"), place)
    lead = F.col("id").eqNullSafe(first)
    own = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("ghost"))
    ghost = F.struct(goes.alias("b"), F.lit(True).alias("ghost"))
    sent = rows.withColumn("to", F.explode(F.when(lead, F.array(own, ghost)).otherwise(
        F.array(own)))).select("id", "t", "to.b", "to.ghost")
    order = Window.partitionBy("b").orderBy("ghost", F.desc_nulls_last("id"), "t")
    nexts = sent.withColumn("next", F.lead("t").over(order)).where("not ghost")
    return nexts.select(F.col("id").alias(key), F.col("t").alias("text"),
                        F.coalesce("next", "t").alias("next_text"))


def _numbers(values: list[int | None], kind: str) -> Column:
    """values as an array that Spark folds to one literal, not an expression for each."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _count_at_most(x: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most x, by halving. Each step is told by the value of the
    one before, not by its expression, which would hold that of every step before four times."""
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    return F.aggregate(_numbers(steps, "int"), F.lit(0), lambda at, step: F.when(
        F.try_element_at(_numbers(cuts, "bigint"), at + step) <= x, at + step).otherwise(at))


def edited(rows: DataFrame) -> DataFrame:
    """rows of with_next() with n_chars and the edited text: the last half of the code points
    replaced by the first as many of the next text, or by all of it."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")),
        F.substring("next_text", F.lit(1), half)))


def near_duplicates(sets: DataFrame, threshold: float = NEAR) -> DataFrame:
    """(a, b, likeness): pairs of ids of sets (id, signatures) at least so alike, a < b.

    sets has one row for each distinct set (copies share an id). Sets are partitioned by
    length: a set meets only lengths from threshold times its own. Two sets so alike share a
    signature among the rarest few of each, so only those are joined; the Jaccard measure is
    pruned by lengths before it is taken.
    """
    sized = sets.select("id", "signatures", F.size("signatures").alias("n"))
    each = sized.select("id", "n", F.explode("signatures").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(often, "s")
    ranked = shared.withColumn("place", F.row_number().over(
        Window.partitionBy("id").orderBy("df", "s")))
    # signatures of one set alone come first in the order of rarity and match nothing
    alone = ranked.groupBy("id").agg(F.max("place").alias("m")).withColumnRenamed("id", "i")
    ranked = ranked.join(alone, F.col("id") == F.col("i"))
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    probes = ranked.where(F.col("n") - F.col("m") + F.col("place") <= prefix)
    low, ratio = F.lit(threshold), F.lit(1.0 / threshold)
    level = F.floor(F.log("n") / F.log(ratio) + 1e-9).cast("int")
    probes = probes.select("id", "n", "s", level.alias("level"))
    a = probes.select(F.col("id").alias("a"), F.col("n").alias("na"), "s",
                      F.explode(F.array("level", F.col("level") + 1)).alias("level"))
    b = probes.select(F.col("id").alias("b"), F.col("n").alias("nb"), "s", "level")
    met = a.join(b, ["s", "level"]).where(
        ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
        & (F.col("na") >= low * F.col("nb") - 1e-9)).select("a", "b").distinct()
    left = sets.select(F.col("id").alias("a"), F.col("signatures").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("signatures").alias("y"))
    found = met.join(left, "a").join(right, "b").withColumn("likeness", jaccard(
        F.col("x"), F.col("y"))).where(F.col("likeness") >= threshold)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited(with_next(c.table(spark, sf_dir, "documents")))
    rows = fingerprinted(rows, {"text": "own", "edited": "changed", "next_text": "following"})
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spelled(F.col("own")).alias("fingerprint"),
        spelled(F.col("changed")).alias("edited_fingerprint"),
        jaccard(F.col("own"), F.col("changed")).alias("near_edited"),
        jaccard(F.col("own"), F.col("following")).alias("near_next"))
