"""Amount comparison and row status.

Three tolerance tests are kept apart on purpose: a pair differing by exactly one cent
is not a discrepancy (> 0.01), not an amount match (< 0.01), and has status true (<= 0.01).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import DEFAULT_MONEY, Money, legacy_amount
from ledgerloom.operators.matching import (
    MATCHED,
    MISSING_IN_BANK,
    MISSING_IN_OURS,
    with_ids,
)
from ledgerloom.operators.skew import largest_groups, spread_left_join

TOLERANCE = "0.01"
CONFIDENCE_NEEDED = 30


def _cent() -> Column:
    return F.lit(TOLERANCE).cast("decimal(3,2)")


def difference() -> Column:
    return F.col("our_amount") - F.col("bank_amount")


def percentage() -> Column:
    """Difference in percent of our amount, which counts as at least 0.01."""
    base = F.greatest(F.col("our_amount"), _cent().cast("decimal(20,4)"))
    return difference().cast("double") / base.cast("double") * F.lit(100.0)


def is_discrepancy() -> Column:
    return F.abs(difference()) > _cent()


def discrepancies(pairs: DataFrame) -> DataFrame:
    """Matched pairs whose amounts differ by more than a cent."""
    return pairs.where(is_discrepancy()).select(
        "id",
        "our_amount",
        "bank_amount",
        difference().alias("difference"),
        percentage().alias("percentage_diff"),
    )


def run_summary(reconciled: DataFrame, *group: str) -> DataFrame:
    """Counts, totals and amount verdict of a reconciliation, in one aggregation.

    `total_difference_matched` compares matched IDs only, `total_difference_all` every
    ID of both sides; the two are different figures.
    """
    matched = F.col("status") == MATCHED
    zero = F.lit(0).cast(reconciled.schema["our_amount"].dataType)
    total = lambda c, when: F.coalesce(
        F.sum(F.when(when, F.col(c))), zero
    )
    always = F.lit(True)
    out = reconciled.groupBy(*group).agg(
        F.count("our_rows").alias("total_our_records"),
        F.count("bank_rows").alias("total_bank_records"),
        F.count_if(matched).alias("matched_records"),
        F.count_if(F.col("status") == MISSING_IN_BANK).alias("missing_in_bank_count"),
        F.count_if(F.col("status") == MISSING_IN_OURS).alias("missing_in_our_file_count"),
        F.count_if(matched & is_discrepancy()).alias("total_discrepancies"),
        total("our_amount", always).alias("our_total"),
        total("bank_amount", always).alias("bank_total"),
        total("our_amount", matched).alias("matched_total_our"),
        total("bank_amount", matched).alias("matched_total_bank"),
    )
    diff = F.col("matched_total_our") - F.col("matched_total_bank")
    percent = F.col("matched_records") / F.greatest("total_our_records", F.lit(1)) * F.lit(100.0)
    return out.select(
        "*",
        F.col("matched_records").alias("exact_matches"),
        F.lit(0).cast("bigint").alias("fuzzy_matches"),
        percent.alias("match_percentage"),
        (F.col("our_total") - F.col("bank_total")).alias("total_difference_all"),
        diff.alias("total_difference_matched"),
        (F.abs(diff) < _cent()).alias("amounts_match"),
    )


def status_summary(reconciled: DataFrame) -> DataFrame:
    """Count, discrepancies and totals per status."""
    return reconciled.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("status") == MATCHED) & is_discrepancy()).alias("discrepancies"),
        F.sum("our_amount").alias("our_total"),
        F.sum("bank_amount").alias("bank_total"),
    )


def comparison_gate(our_confidence: float, bank_confidence: float) -> tuple[bool, str | None]:
    """Whether amounts may be compared, and why not."""
    if our_confidence > CONFIDENCE_NEEDED and bank_confidence > CONFIDENCE_NEEDED:
        return True, None
    return False, (
        "Low confidence in amount column detection "
        f"(our: {our_confidence:.1f}%, bank: {bank_confidence:.1f}%, "
        f"threshold: {CONFIDENCE_NEEDED}%)"
    )


def result_amounts(reconciled: DataFrame) -> DataFrame:
    """Amounts of each stored result; differences exist on matched rows only."""
    matched = F.col("status") == MATCHED
    return reconciled.select(
        "*",
        F.when(matched, difference()).alias("amount_difference"),
        F.when(matched, F.abs(difference()) < _cent()).alias("amount_match"),
    )


def with_legacy_amount(
    df: DataFrame, text: Column, name: str = "amount", money: Money = DEFAULT_MONEY
) -> DataFrame:
    return df.withColumn(name, legacy_amount(text, money))


def _tagged(ours: DataFrame, bank: DataFrame) -> DataFrame:
    """Narrow rows of both sides, `our` telling them apart."""
    kind = "decimal(38,0)" if ours.schema["ordinal"] != bank.schema["ordinal"] else None
    order = F.col("ordinal").cast(kind) if kind else F.col("ordinal")
    narrow = lambda s, our: s.select(
        "id", "amount", order.alias("ordinal"), F.lit(our).alias("our"))
    return narrow(ours, True).unionByName(narrow(bank, False))


def last_of_both(tagged: DataFrame) -> DataFrame:
    """(id, our_amount, our_rows, bank_amount, bank_rows): of every ID the amount of its last row
    on each side (null amounts count as rows) and its rows there, in one aggregate."""
    our, bank = F.col("our"), ~F.col("our")
    last = lambda side: F.max_by(F.when(side, F.col("amount")), F.when(side, F.col("ordinal")))
    return with_ids(tagged.withColumn("original", F.col("id"))).groupBy("id").agg(
        last(our).alias("our_amount"), F.count_if(our).alias("our_rows"),
        last(bank).alias("bank_amount"), F.count_if(bank).alias("bank_rows"))


def _with_status(rows: DataFrame, lookup: DataFrame, known: DataFrame, order: Column) -> DataFrame:
    joined = spread_left_join(rows, lookup, "id", order, known)
    status = (
        F.when(~F.coalesce("_found", F.lit(False)), "false")
        .when(F.abs(F.col("amount") - F.col("other_amount")) > _cent(), "amt_diff")
        .otherwise("true")
    )
    return joined.withColumn("status", status).drop("_found")


def row_status(rows: DataFrame, other: DataFrame, **heavy) -> DataFrame:
    """Status of every row of one side, duplicates kept.

    true      the ID is on the other side and the amounts agree or cannot be compared
    amt_diff  the ID is there but the amounts differ by more than a cent
    false     the ID is not there

    Both sides are reduced to one row per ID by one aggregate: the other's last amount, and how
    many rows the ID has here, which tells the heavy ones. Rows of those and of null IDs are spread.
    """
    both = last_of_both(_tagged(rows, other))
    wanted = ["id", F.col("bank_amount").alias("other_amount"),
              (F.col("bank_rows") > 0).alias("_found")]
    known = largest_groups(both, "our_rows", **heavy).select(*wanted)
    return _with_status(rows, both.select(*wanted), known, F.col("ordinal"))


def status_counts(ours: DataFrame, bank: DataFrame, **heavy) -> DataFrame:
    """Rows per status on each side.

    The rows of both sides, tagged, are aggregated by ID once and meet that aggregate once. Equal
    rows, as a status depends only on ID and amount, are counted before.
    """
    tagged = _tagged(ours, bank)
    both = last_of_both(tagged).withColumn("rows", F.col("our_rows") + F.col("bank_rows"))
    wanted = ["id", "our_amount", "our_rows", "bank_amount", "bank_rows"]
    known = largest_groups(both, "rows", **heavy).select(*wanted)
    rows = tagged.groupBy("our", "id", "amount").agg(F.count(F.lit(1)).alias("n"))
    joined = spread_left_join(
        rows, both.select(*wanted), "id", F.struct("our", "amount"), known)
    found = F.when(F.col("our"), F.col("bank_rows")).otherwise(F.col("our_rows")) > 0
    gap = F.abs(F.col("amount") - F.when(F.col("our"), F.col("bank_amount")).otherwise(
        F.col("our_amount")))
    status = F.when(~F.coalesce(found, F.lit(False)), "false").when(
        gap > _cent(), "amt_diff").otherwise("true")
    side = F.when(F.col("our"), "our").otherwise("bank")
    return joined.groupBy(side.alias("side"), status.alias("status")).agg(F.sum("n").alias("n"))
