"""ID extraction, bank attribution and two-sided matching.

A *side* is a narrow table derived from one file:

    id        matching key (expanded ID), null for a null token
    original  trimmed source text of the ID
    amount    decimal, or null when the text is not an amount
    ordinal   row order
    bank      paying bank (ledger only)
    record    JSON snapshot of the row (only when asked for)
    row       the row itself as a struct (only when asked for)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import (
    display_id,
    parse_amount,
    record_json,
    strict_amount,
    strip,
)
from ledgerloom.functions.ids import is_null_text, normal_text
from ledgerloom.functions.money import DEFAULT_MONEY, Money
from ledgerloom.functions.records import quoted
from ledgerloom.operators.skew import largest_groups

MATCHED = "matched"
MISSING_IN_BANK = "missing_in_bank"
MISSING_IN_OURS = "missing_in_our_file"
STATUSES = (MATCHED, MISSING_IN_BANK, MISSING_IN_OURS)


def side(
    df: DataFrame,
    id_col: str,
    amount_col: str | None,
    order: str | Column,
    *,
    bank_col: str | None = None,
    record_cols: list[str] | None = None,
    row_cols: list[str] | None = None,
    money: Money = DEFAULT_MONEY,
    strict: bool = False,
) -> DataFrame:
    """Narrow view of a file for matching; null-token IDs keep a null `id`.

    `record_cols` adds a JSON snapshot of those columns, `row_cols` a struct of them.
    """
    parse = strict_amount if strict else parse_amount
    columns = [
        strip(F.col(quoted(id_col)).cast("string")).alias("original"),
        (
            parse(F.col(quoted(amount_col)).cast("string"), money)
            if amount_col
            else F.lit(None).cast(money.sql_type)
        ).alias("amount"),
        (F.col(quoted(order)) if isinstance(order, str) else order).alias("ordinal"),
    ]
    if bank_col:
        columns.append(F.col(quoted(bank_col)).alias("bank"))
    if record_cols:
        columns.append(record_json(record_cols).alias("record"))
    if row_cols:
        columns.append(F.struct(*[F.col(quoted(c)) for c in row_cols]).alias("row"))
    # The stripped text is a step of its own, so it is computed once per row.
    return df.select(*columns).select(normal_text(F.col("original")).alias("id"), "*")


def with_ids(s: DataFrame) -> DataFrame:
    """Rows that have an ID.

    The test reads the source text and the key is made non-null, so the optimizer does
    not push a second evaluation of the whole ID expression down to the scan.
    """
    kept = s.where(~is_null_text(F.col("original")))
    return kept.withColumn("id", F.coalesce("id", F.lit("")))


def distinct_ids(s: DataFrame) -> DataFrame:
    """Distinct expanded IDs of a side."""
    return with_ids(s).select("id").distinct()


def ids_with_display(s: DataFrame) -> DataFrame:
    """Distinct IDs with the original text of their first row and a display text."""
    first = with_ids(s).groupBy("id").agg(F.min_by("original", "ordinal").alias("original"))
    return first.withColumn("display", display_id(F.col("original"), F.col("id")))


def last_amounts(s: DataFrame, *keys: str) -> DataFrame:
    """Amount of the last row of each ID (null amounts count as rows) and its row count."""
    keys = keys or ("id",)
    return (
        with_ids(s)
        .groupBy(*keys)
        .agg(F.max_by("amount", "ordinal").alias("amount"), F.count(F.lit(1)).alias("n_rows"))
    )


def _collapsed(s: DataFrame, keys: list[str], prefix: str, with_records: bool) -> DataFrame:
    """One row per key: record and original of the first row, amount of the last.

    The aggregate is narrow and hash-based. Records are fetched afterwards by key and first
    ordinal, by the partitioning that the aggregate has; ordinals are unique within a side. Of the
    keys with most rows only the first row is sent.
    """
    s = with_ids(s)
    zero = F.lit(0).cast(s.schema["amount"].dataType)
    out = s.groupBy(*keys).agg(
        F.max_by(F.coalesce("amount", zero), "ordinal").alias(f"{prefix}_amount"),
        F.count(F.lit(1)).alias(f"{prefix}_rows"),
        F.min("ordinal").alias("_first"),
    )
    if not with_records:
        return out.drop("_first")
    named = {k: f"_{k}" for k in keys}
    same = lambda: [  # noqa: E731  IDs are never null here, banks may be
        F.col(k) == F.col(n) if k == "id" else F.col(k).eqNullSafe(F.col(n))
        for k, n in named.items()]
    heavy = largest_groups(out, f"{prefix}_rows").select(
        *[F.col(k).alias(n) for k, n in named.items()], "_first")
    rows = s.select(*keys, "ordinal", "original", "record").join(
        F.broadcast(heavy), same(), "left")
    rows = rows.where(F.col("_first").isNull() | (F.col("ordinal") <= F.col("_first")))
    rows = rows.select(*[F.col(k).alias(n) for k, n in named.items()], "ordinal",
                       F.col("original").alias(f"{prefix}_original"),
                       F.col("record").alias(f"{prefix}_record"))
    # No row of a key comes before its first, so this leaves one.
    found = out.join(rows.hint("merge"), [*same(), F.col("ordinal") <= F.col("_first")], "left")
    return found.drop("_first", "ordinal", *named.values())


def first_banks(ledger: DataFrame) -> DataFrame:
    """Bank of the first ledger row of each ID."""
    return with_ids(ledger).groupBy("id").agg(F.min_by("bank", "ordinal").alias("bank"))


def attribute(ledger: DataFrame, statement: DataFrame) -> DataFrame:
    """(id, bank) for each statement ID found in the ledger.

    The statement is joined before its IDs are deduplicated by the aggregate on the
    same key, so both sides are shuffled once, on `id`.
    """
    return first_banks(ledger).join(distinct_ids(statement), "id", "inner")


def attribution_counts(attributed: DataFrame) -> DataFrame:
    """Number of attributed IDs per bank."""
    return attributed.groupBy("bank").agg(F.count(F.lit(1)).alias("n_ids"))


def target_bank(attributed: DataFrame) -> DataFrame:
    """One row: the bank with most attributed IDs; ties go to the first name.

    Blank banks are counted by attribution_counts but never chosen; no row if all are blank.
    """
    named = attribution_counts(attributed).where(F.col("bank").isNotNull())
    return named.orderBy(F.desc("n_ids"), "bank").limit(1)


def of_bank(ledger: DataFrame, bank: str | DataFrame) -> DataFrame:
    """Ledger rows of one bank, given by name or as a one-row table."""
    if isinstance(bank, str):
        return ledger.where(F.col("bank") == bank)
    return ledger.join(F.broadcast(bank.select("bank").limit(1)), "bank")


def _status() -> Column:
    return (
        F.when(F.col("bank_rows").isNull(), MISSING_IN_BANK)
        .when(F.col("our_rows").isNull(), MISSING_IN_OURS)
        .otherwise(MATCHED)
    )


def reconcile_ids(
    ours: DataFrame, bank: DataFrame, *, with_records: bool = False
) -> DataFrame:
    """Every distinct ID of either side with its status and both amounts.

    Both sides are aggregated by `id` first; the full outer join reuses that hash
    partitioning, so each side is shuffled once and no key is hot any more. With
    `with_records`, both sides must carry `record`.
    """
    o = _collapsed(ours, ["id"], "our", with_records)
    b = _collapsed(bank, ["id"], "bank", with_records)
    return o.join(b, "id", "full_outer").withColumn("status", _status())


def matched_pairs(ours: DataFrame, bank: DataFrame, *, with_records: bool = False) -> DataFrame:
    o = _collapsed(ours, ["id"], "our", with_records)
    b = _collapsed(bank, ["id"], "bank", with_records)
    return o.join(b, "id", "inner")


def missing_in_bank(ours: DataFrame, bank: DataFrame, *, with_records: bool = False) -> DataFrame:
    o = _collapsed(ours, ["id"], "our", with_records)
    return o.join(distinct_ids(bank), "id", "left_anti")


def missing_in_ours(ours: DataFrame, bank: DataFrame, *, with_records: bool = False) -> DataFrame:
    b = _collapsed(bank, ["id"], "bank", with_records)
    return b.join(distinct_ids(ours), "id", "left_anti")


def reconcile_all_banks(
    ledger: DataFrame, statement: DataFrame, *, with_records: bool = False
) -> DataFrame:
    """Reconcile every bank of the ledger at once, keyed by (bank, id).

    A statement ID belongs to the bank of its first ledger row; statement IDs unknown
    to the ledger come out with a null bank. So do ledger rows with a blank bank, which are
    matched among themselves: with a null bank, only `missing_in_our_file` means unknown.
    """
    o = _collapsed(ledger, ["bank", "id"], "our", with_records)
    b = _collapsed(statement, ["id"], "bank", with_records)
    b = b.join(first_banks(ledger), "id", "left")
    b = b.withColumnsRenamed({"bank": "_bank", "id": "_id"})
    same = (F.col("id") == F.col("_id")) & F.col("bank").eqNullSafe(F.col("_bank"))
    both = o.join(b, same, "full_outer").withColumn("status", _status())
    return both.withColumn(
        "bank", F.when(F.col("id").isNull(), F.col("_bank")).otherwise(F.col("bank"))
    ).withColumn("id", F.coalesce("id", "_id")).drop("_bank", "_id")


def null_id_rows(ours: DataFrame, bank: DataFrame) -> DataFrame:
    """One row: rows of each side left out of matching for want of an ID."""
    both = ours.select("id", F.lit(True).alias("our")).unionByName(
        bank.select("id", F.lit(False).alias("our"))
    )
    none = F.col("id").isNull()
    return both.agg(
        F.count_if(none & F.col("our")).alias("our_null_id_rows"),
        F.count_if(none & ~F.col("our")).alias("bank_null_id_rows"),
    )
