"""Registered queries for matching, attribution, comparison and row status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import functions as fn
from ledgerloom.functions.money import Money
from ledgerloom.operators import comparison as cmp
from ledgerloom.operators import matching as m

from . import tables
from .oracle import AMOUNT, over_sides, parse_amount
from .tables import LEDGER, duck

MONEY = Money(18, 2)
TOTAL = "DECIMAL(38,2)"


def ours_all(spark: SparkSession, sf: str, strict: bool = False) -> DataFrame:
    df = tables.ledger(spark, sf)
    return m.side(
        df, "bank_trx_id", "paid_amt", "row_id", bank_col="paying_bank_name", money=MONEY,
        strict=strict,
    )


def bank_side(spark: SparkSession, sf: str, strict: bool = False) -> DataFrame:
    df = tables.statement(spark, sf)
    return m.side(df, "transaction_id", "credit", "row_id", money=MONEY, strict=strict)


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Ledger rows of the bank the statement belongs to, and the statement."""
    ledger, bank = ours_all(spark, sf), bank_side(spark, sf)
    return m.of_bank(ledger, m.target_bank(m.attribute(ledger, bank))), bank


def money_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast(TOTAL) for n in names})


def recon_summary(spark, sf):
    out = cmp.status_summary(m.reconcile_ids(*sides(spark, sf)))
    return money_columns(out, "our_total", "bank_total")


def recon_status(spark, sf):
    return m.reconcile_ids(*sides(spark, sf)).select(
        "id", "status", "our_amount", "bank_amount", "our_rows", "bank_rows"
    )


def run_summary(spark, sf):
    out = cmp.run_summary(m.reconcile_ids(*sides(spark, sf)))
    names = [c for c in out.columns if "total_" in c and "records" not in c and "disc" not in c]
    return money_columns(out, *names, "our_total", "bank_total").withColumn(
        "match_percentage", F.round("match_percentage", 6)
    )


def matched_pairs(spark, sf):
    return m.matched_pairs(*sides(spark, sf)).select("id", "our_amount", "bank_amount")


def missing_in_bank(spark, sf):
    return m.missing_in_bank(*sides(spark, sf)).select("id", "our_amount")


def missing_in_ours(spark, sf):
    return m.missing_in_ours(*sides(spark, sf)).select("id", "bank_amount")


def attributed_ids(spark, sf):
    return m.attribute(ours_all(spark, sf), bank_side(spark, sf))


def bank_attribution(spark, sf):
    return m.attribution_counts(attributed_ids(spark, sf))


def target_bank(spark, sf):
    return m.target_bank(attributed_ids(spark, sf))


def recon_all_banks(spark, sf):
    both = m.reconcile_all_banks(ours_all(spark, sf), bank_side(spark, sf))
    out = both.groupBy("bank", "status").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("our_amount").alias("our_total"),
        F.sum("bank_amount").alias("bank_total"),
    )
    return money_columns(out, "our_total", "bank_total")


def distinct_ids(spark, sf):
    return m.distinct_ids(bank_side(spark, sf))


def ids_with_display(spark, sf):
    out = m.ids_with_display(bank_side(spark, sf))
    return out.withColumn("lost", fn.precision_lost(F.col("original")))


def null_id_rows(spark, sf):
    return m.null_id_rows(ours_all(spark, sf), bank_side(spark, sf))


def clean_amounts(spark, sf):
    df = tables.ledger(spark, sf)
    text = F.col("paid_amt")
    return df.select(
        "row_id",
        fn.parse_amount(text, MONEY).alias("amount"),
        fn.amount_or_zero(text, MONEY).alias("amount_or_zero"),
        fn.strict_amount(text, MONEY).alias("strict_amount"),
    )


def legacy_amounts(spark, sf):
    df = tables.ledger(spark, sf)
    return df.select("row_id", fn.legacy_amount(F.col("paid_amt"), MONEY).alias("amount"))


def amount_totals(spark, sf):
    out = cmp.run_summary(m.reconcile_ids(*sides(spark, sf)))
    names = ["our_total", "bank_total", "matched_total_our", "matched_total_bank",
             "total_difference_all"]
    return money_columns(out.select(*names), *names)


def discrepancies(spark, sf):
    out = cmp.discrepancies(m.matched_pairs(*sides(spark, sf)))
    return out.withColumns({
        "difference": F.col("difference").cast(TOTAL),
        "percentage_diff": F.round("percentage_diff", 6),
    })


def comparison_summary(spark, sf):
    out = cmp.run_summary(m.matched_pairs(*sides(spark, sf)).withColumn("status", F.lit(m.MATCHED)))
    return out.select(
        "total_discrepancies",
        F.col("total_difference_matched").cast(TOTAL).alias("total_difference"),
        "amounts_match",
    )


def result_amounts(spark, sf):
    out = cmp.result_amounts(m.reconcile_ids(*sides(spark, sf)))
    return out.select(
        "id", "status", F.col("amount_difference").cast(TOTAL).alias("amount_difference"),
        "amount_match",
    )


def our_status(spark, sf):
    ours, bank = sides(spark, sf)
    return cmp.row_status(ours, bank).select("ordinal", "id", "amount", "other_amount", "status")


def bank_status(spark, sf):
    ours, bank = sides(spark, sf)
    return cmp.row_status(bank, ours).select("ordinal", "id", "amount", "other_amount", "status")


def our_status_strict(spark, sf):
    ledger, bank = ours_all(spark, sf, strict=True), bank_side(spark, sf, strict=True)
    ours = m.of_bank(ledger, m.target_bank(m.attribute(ledger, bank)))
    return cmp.row_status(ours, bank).select("ordinal", "status")


def status_counts(spark, sf):
    return cmp.status_counts(*sides(spark, sf))


SPREADING = {"share": 0.0001, "min_rows": 2}  # so that repeated IDs count as heavy


def our_status_hot(spark, sf):
    """our_status with the plan that large inputs take: repeated IDs are looked up and spread."""
    ours, bank = sides(spark, sf)
    found = cmp.row_status(ours, bank, **SPREADING)
    return found.select("ordinal", "id", "amount", "other_amount", "status")


def status_counts_hot(spark, sf):
    """status_counts with the plan that large inputs take."""
    return cmp.status_counts(*sides(spark, sf), **SPREADING)


def text_formats(spark, sf):
    df = tables.read(spark, sf, "orders")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return df.select(
        "o_orderkey",
        fn.number_text(price).alias("number_text"),
        fn.percent_text(F.col("o_custkey") - F.lit(700)).alias("percent_text"),
        fn.timestamp_text(F.col("o_orderdate")).alias("time_text"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        recon_summary, recon_status, run_summary, matched_pairs, missing_in_bank,
        missing_in_ours, attributed_ids, bank_attribution, target_bank, recon_all_banks,
        distinct_ids, ids_with_display, null_id_rows, clean_amounts, legacy_amounts,
        amount_totals, discrepancies, comparison_summary, result_amounts, our_status,
        bank_status, our_status_strict, status_counts, our_status_hot, status_counts_hot,
        text_formats,
    )
}

_STATUS_CASE = """CASE WHEN l.id IS NULL THEN 'false'
  WHEN abs(r.amount - l.raw_amount) > 0.01 THEN 'amt_diff' ELSE 'true' END"""

_STRICT_SIDES = over_sides("").rstrip().replace(
    parse_amount("paid_amt"), f"try_cast(trim(paid_amt) AS {AMOUNT})"
).replace(parse_amount("credit"), f"try_cast(trim(credit) AS {AMOUNT})")

_SUMMARY = f"""
SELECT count(our_rows) AS total_our_records, count(bank_rows) AS total_bank_records,
  count(*) FILTER (status = 'matched') AS matched_records,
  count(*) FILTER (status = 'missing_in_bank') AS missing_in_bank_count,
  count(*) FILTER (status = 'missing_in_our_file') AS missing_in_our_file_count,
  count(*) FILTER (status = 'matched' AND abs(our_amount - bank_amount) > 0.01)
    AS total_discrepancies,
  CAST(coalesce(sum(our_amount), 0) AS {TOTAL}) AS our_total,
  CAST(coalesce(sum(bank_amount), 0) AS {TOTAL}) AS bank_total,
  CAST(coalesce(sum(our_amount) FILTER (status = 'matched'), 0) AS {TOTAL}) AS matched_total_our,
  CAST(coalesce(sum(bank_amount) FILTER (status = 'matched'), 0) AS {TOTAL}) AS matched_total_bank
FROM recon"""

ORACLES = {
    "recon_summary": over_sides(f"""
SELECT status, count(*) AS n,
  count(*) FILTER (status = 'matched' AND abs(our_amount - bank_amount) > 0.01) AS discrepancies,
  CAST(sum(our_amount) AS {TOTAL}) AS our_total, CAST(sum(bank_amount) AS {TOTAL}) AS bank_total
FROM recon GROUP BY status"""),
    "recon_status": over_sides(
        "SELECT id, status, our_amount, bank_amount, our_rows, bank_rows FROM recon"),
    "run_summary": over_sides(f"""
SELECT *, matched_records AS exact_matches, CAST(0 AS BIGINT) AS fuzzy_matches,
  round(CAST(matched_records AS DOUBLE) / greatest(total_our_records, 1) * 100.0, 6)
    AS match_percentage,
  CAST(our_total - bank_total AS {TOTAL}) AS total_difference_all,
  CAST(matched_total_our - matched_total_bank AS {TOTAL}) AS total_difference_matched,
  abs(matched_total_our - matched_total_bank) < 0.01 AS amounts_match
FROM ({_SUMMARY})"""),
    "matched_pairs": over_sides(
        "SELECT id, our_amount, bank_amount FROM recon WHERE status = 'matched'"),
    "missing_in_bank": over_sides(
        "SELECT id, our_amount FROM recon WHERE status = 'missing_in_bank'"),
    "missing_in_ours": over_sides(
        "SELECT id, bank_amount FROM recon WHERE status = 'missing_in_our_file'"),
    "attributed_ids": over_sides("SELECT id, bank FROM attributed"),
    "bank_attribution": over_sides(
        "SELECT bank, count(*) AS n_ids FROM attributed GROUP BY bank"),
    "target_bank": over_sides("SELECT bank, n_ids FROM target"),
    "recon_all_banks": over_sides(f"""
SELECT bank, status, count(*) AS n, CAST(sum(our_amount) AS {TOTAL}) AS our_total,
  CAST(sum(bank_amount) AS {TOTAL}) AS bank_total
FROM recon_all GROUP BY bank, status"""),
    "distinct_ids": over_sides("SELECT DISTINCT id FROM bank WHERE id IS NOT NULL"),
    "ids_with_display": over_sides("""
SELECT id, original, CASE WHEN original <> id THEN original || ' | ' || id ELSE id END AS display,
  regexp_matches(original, '^[0-9.]+[eE][+]')
    AND length(replace(regexp_extract(original, '^([0-9.]+)[eE]', 1), '.', '')) < length(id) AS lost
FROM (SELECT id, original, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS rn
      FROM bank WHERE id IS NOT NULL) WHERE rn = 1"""),
    "null_id_rows": over_sides("""
SELECT (SELECT count(*) FROM ours_all WHERE id IS NULL) AS our_null_id_rows,
       (SELECT count(*) FROM bank WHERE id IS NULL) AS bank_null_id_rows"""),
    "clean_amounts": f"""
SELECT row_id, {parse_amount('paid_amt')} AS amount,
  coalesce({parse_amount('paid_amt')}, CAST(0 AS {AMOUNT})) AS amount_or_zero,
  try_cast(trim(paid_amt) AS {AMOUNT}) AS strict_amount
FROM ({duck(LEDGER)})""",
    "legacy_amounts": f"""
SELECT row_id, CASE WHEN regexp_matches(replace(replace(paid_amt, '.', ''), '-', ''), '^[0-9]+$')
  THEN coalesce(try_cast(paid_amt AS {AMOUNT}), CAST(0 AS {AMOUNT}))
  ELSE CAST(0 AS {AMOUNT}) END AS amount
FROM ({duck(LEDGER)})""",
    "amount_totals": over_sides(f"""
SELECT our_total, bank_total, matched_total_our, matched_total_bank,
  CAST(our_total - bank_total AS {TOTAL}) AS total_difference_all FROM ({_SUMMARY})"""),
    "discrepancies": over_sides(f"""
SELECT id, our_amount, bank_amount, CAST(our_amount - bank_amount AS {TOTAL}) AS difference,
  round(CAST(our_amount - bank_amount AS DOUBLE)
        / CAST(greatest(our_amount, 0.01) AS DOUBLE) * 100.0, 6) AS percentage_diff
FROM recon WHERE status = 'matched' AND abs(our_amount - bank_amount) > 0.01"""),
    "comparison_summary": over_sides(f"""
SELECT total_discrepancies,
  CAST(matched_total_our - matched_total_bank AS {TOTAL}) AS total_difference,
  abs(matched_total_our - matched_total_bank) < 0.01 AS amounts_match FROM ({_SUMMARY})"""),
    "result_amounts": over_sides(f"""
SELECT id, status,
  CASE WHEN status = 'matched' THEN CAST(our_amount - bank_amount AS {TOTAL}) END
    AS amount_difference,
  CASE WHEN status = 'matched' THEN abs(our_amount - bank_amount) < 0.01 END AS amount_match
FROM recon"""),
    "our_status": over_sides(f"""
SELECT r.ordinal, r.id, r.amount, l.raw_amount AS other_amount, {_STATUS_CASE} AS status
FROM ours r LEFT JOIN bank_last l ON r.id = l.id"""),
    "bank_status": over_sides(f"""
SELECT r.ordinal, r.id, r.amount, l.raw_amount AS other_amount, {_STATUS_CASE} AS status
FROM bank r LEFT JOIN our_last l ON r.id = l.id"""),
    "our_status_strict": _STRICT_SIDES + f"""
SELECT r.ordinal, {_STATUS_CASE} AS status FROM ours r LEFT JOIN bank_last l ON r.id = l.id""",
    "status_counts": over_sides(f"""
SELECT side, status, count(*) AS n FROM (
  SELECT 'our' AS side, {_STATUS_CASE} AS status FROM ours r LEFT JOIN bank_last l ON r.id = l.id
  UNION ALL
  SELECT 'bank', {_STATUS_CASE} FROM bank r LEFT JOIN our_last l ON r.id = l.id)
GROUP BY side, status"""),
    "text_formats": """
SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS number_text,
  printf('%+.1f%%', CAST(o_custkey - 700 AS DOUBLE)) AS percent_text,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS time_text
FROM orders""",
}
ORACLES |= {f"{name}_hot": ORACLES[name] for name in ("our_status", "status_counts")}
