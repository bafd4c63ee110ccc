"""Which column holds the transaction ID and which the amount.

Scores are rows (file, position, col, score); the best column of a file is the one with
the highest score, the leftmost winning ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import clean_header, lower_header
from ledgerloom.operators.profile import COLUMN

# Known headers of the ID column in our files.
OUR_ID_HEADERS = [
    "bank trx id", "banktrxid", "bank_trx_id", "bank transaction id",
    "banktransactionid", "bank_transaction_id", "trx id", "trxid",
    "transaction id", "transactionid", "bank ref", "bankref",
    "bank reference", "bankreference", "payment ref", "paymentref",
]

LEARNED_MINIMUM = 70
STATEMENT_ID_MINIMUM = 20
OUR_ID_WARNING = 50
MANUAL_SCORE = 100.0


def _any_in(c: Column, *words: str) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def _points(condition: Column, points: float) -> Column:
    return F.when(condition, F.lit(float(points))).otherwise(F.lit(0.0))


def _likely_id_length() -> Column:
    return (F.col("non_empty") > 0) & F.col("mean_length").between(8, 30)


def our_id_scores(profile: DataFrame) -> DataFrame:
    """Scores for the ID column of our own ledger."""
    name, clean = lower_header(F.col("col")), clean_header(F.col("col"))
    score = F.lit(0.0)
    for header in OUR_ID_HEADERS:
        bare = header.replace(" ", "").replace("_", "").replace("-", "")
        score = score + (
            F.when(clean == bare, 100.0)
            .when(name.contains(header), 80.0)
            .when(clean.contains(bare), 60.0)
            .otherwise(0.0)
        )
    score = (
        score
        + _points(_any_in(name, "bank", "trx", "transaction"), 40)
        + _points(_any_in(name, "id", "ref", "reference"), 20)
        + _points(F.col("uniqueness") > 0.8, 25)
        + _points(_likely_id_length(), 15)
    )
    return profile.select(*COLUMN, score.alias("score"))


def statement_id_scores(profile: DataFrame) -> DataFrame:
    """Scores for the ID column of a bank statement."""
    name = F.lower("col")
    score = (
        _points(_any_in(name, "trx", "transaction", "ref", "reference", "id"), 30)
        + _points(_any_in(name, "bank", "payment", "txn"), 20)
        + _points(F.col("uniqueness") > 0.7, 35)
        + _points(_likely_id_length(), 20)
    )
    return profile.select(*COLUMN, score.alias("score"))


def _parts(c: Column, lengths: Column) -> Column:
    """The distinct substrings of a header of these lengths; an empty header is its own."""
    chars, size = F.split(c, ""), F.length(c)
    fitting = F.filter(lengths, lambda n: (n > 0) & (n <= size))
    cut = lambda n: F.transform(
        F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(chars, i, n), ""))
    none = F.array().cast("array<string>")
    return F.when(size == 0, F.array(F.lit(""))).otherwise(
        F.coalesce(F.array_distinct(F.flatten(F.transform(fitting, cut))), none))


def keyword_matches(names: DataFrame, keywords: DataFrame) -> DataFrame:
    """Keywords found in each distinct header `col`, with kind and tenths of points.

    "Header contains keyword" is turned into an equi-join: the substrings of each
    distinct header, of the lengths that keywords have, are joined to the keyword texts, so
    neither table is scanned per row of the other and neither has to be small.
    """
    word = ["keyword", "priority", "is_exact_match"]
    clean = clean_header(F.col("keyword")).alias("clean")
    texts = names.select("col").distinct().select(
        "col", lower_header(F.col("col")).alias("lower"), clean_header(F.col("col")).alias("bare")
    )
    words = keywords.select(
        *word,
        clean,
        F.inline(
            F.array(
                F.struct(F.lit(True).alias("plain"), F.col("keyword").alias("part")),
                F.struct(F.lit(False).alias("plain"), clean_header(F.col("keyword")).alias("part")),
            )
        ),
    )
    # Two rows, as many numbers as there are lengths of keywords.
    lengths = words.groupBy("plain").agg(F.collect_set(F.length("part")).alias("lengths"))
    # Both readings of a header and of a keyword, as written and without separators,
    # meet in one join; `plain` keeps the two apart.
    forms = F.array(
        F.struct(F.lit(True).alias("plain"), F.col("lower").alias("text")),
        F.struct(F.lit(False).alias("plain"), F.col("bare").alias("text")),
    )
    parts = texts.select("col", "lower", "bare", F.inline(forms)).join(
        F.broadcast(lengths), "plain").select(
        "col", "lower", "bare", "plain", F.explode(_parts(F.col("text"), F.col("lengths"))).alias("part")
    )
    # A keyword found in both forms is one match.
    found = parts.join(words, ["plain", "part"]).where(
        F.col("plain") | ~F.col("lower").contains(F.col("keyword"))
    )
    exact = (F.col("clean") == F.col("bare")) | (F.col("keyword") == F.col("lower"))
    contained = F.col("lower").contains(F.col("keyword"))
    kind = (
        F.when(~F.col("is_exact_match"), "flexible").when(exact, "exact").when(contained, "partial")
    )
    tenths = (
        F.when(F.col("kind") == "exact", 10).when(F.col("kind") == "partial", 8).otherwise(7)
    )
    return (
        found.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            "col", "keyword", "kind", "priority",
            (F.col("priority") * tenths).alias("tenths"),
        )
    )


def keyword_scores(names: DataFrame, keywords: DataFrame) -> DataFrame:
    """Keyword score of every distinct header, with the list of matches."""
    match = F.struct("priority", "keyword", "kind", "tenths")
    scored = keyword_matches(names, keywords).groupBy("col").agg(
        (F.sum("tenths") / F.lit(10.0)).alias("score"),
        F.sort_array(F.collect_list(match), asc=False).alias("matches"),
    )
    listed = names.select("col").distinct().join(scored, "col", "left")
    text = F.transform(
        "matches", lambda x: F.format_string("%s:%s:%.1f", x["kind"], x["keyword"], x["tenths"] / F.lit(10.0))
    )
    return listed.select(
        "col",
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce(text, F.array().cast("array<string>")).alias("matches"),
    )


def amount_scores(
    profile: DataFrame, keywords: DataFrame, names: DataFrame | None = None
) -> DataFrame:
    """Scores for the amount column: keywords in the header plus numeric content.

    `names` holds the headers in `col`; without it they are taken from the profile, which
    is then computed twice.
    """
    named = keyword_matches(profile if names is None else names, keywords).groupBy("col").agg(
        (F.sum("tenths") / F.lit(10.0)).alias("named")
    )
    ratio = F.col("numeric_ratio")
    score = (
        F.coalesce("named", F.lit(0.0))
        + F.when(ratio > 0.8, 100.0).when(ratio > 0.5, 50.0).when(ratio > 0.3, 25.0).otherwise(0.0)
        + _points(F.col("positive_ratio") > 0.7, 30)
        + _points(F.col("mean_value").between(1, 1000000), 25)
    )
    return profile.join(named, "col", "left").select(*COLUMN, score.alias("score"))


def best_columns(scores: DataFrame) -> DataFrame:
    """Top column of every file; a file is one header wide, so this needs no ranking."""
    best = F.max_by(F.struct(*COLUMN[1:], "score"), F.struct("score", -F.col("position")))
    return scores.groupBy("file").agg(best.alias("best")).select("file", "best.*")


def top_columns(scores: DataFrame, n: int = 3) -> DataFrame:
    """The first `n` candidates of every file with their rank."""
    order = W.partitionBy("file").orderBy(F.desc("score"), "position")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def cascade(learned: DataFrame, rules: DataFrame) -> DataFrame:
    """Best column per file: the learned one above 70 percent, else the one by rules."""
    confident = best_columns(learned).where(F.col("score") > LEARNED_MINIMUM)
    other = best_columns(rules).join(confident.select("file"), "file", "left_anti")
    return confident.withColumn("source", F.lit("learned")).unionByName(
        other.withColumn("source", F.lit("rules"))
    )


def role_decisions(best: DataFrame, role: str, manual: dict[str, str] | None = None) -> DataFrame:
    """What to do with a detected column: accept, warn or reject.

    `role` is our_id, statement_id or amount. A manually chosen column (file -> column)
    replaces the detected one with score 100.
    """
    out = best.withColumn("manual", F.lit(False))
    if manual:
        pairs = [F.lit(x) for kv in manual.items() for x in kv]
        chosen = F.try_element_at(F.create_map(*pairs), F.col("file"))
        out = best.withColumns(
            {
                "manual": chosen.isNotNull(),
                "score": F.when(chosen.isNotNull(), MANUAL_SCORE).otherwise(F.col("score")),
                "col": F.coalesce(chosen, F.col("col")),
            }
        )
    score = F.col("score")
    if role == "statement_id":
        decision = F.when(score < STATEMENT_ID_MINIMUM, "reject").otherwise("accept")
    elif role == "our_id":
        decision = F.when(score < OUR_ID_WARNING, "warn").otherwise("accept")
    elif role == "amount":
        decision = F.when(score > 30, "accept").otherwise("skip")
    else:
        raise ValueError(f"unknown role: {role}")
    return out.withColumn("decision", decision)
