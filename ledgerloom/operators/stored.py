"""Queries over stored jobs, results and discrepancies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import number_text, percent_text, timestamp_text
from ledgerloom.operators.matching import MISSING_IN_BANK, MISSING_IN_OURS, STATUSES
from ledgerloom.operators.skew import first_per_group

VIEW = ["job_id", "bank_trx_id", "status", "paying_bank_name", "amount", "created_at"]
RECENT_RESULTS = 50
SHOWN_RESULTS = 100
RECENT_JOBS = 5
SECTION_LIMITS = {"discrepancies": 20, MISSING_IN_BANK: 10, MISSING_IN_OURS: 10}
DETAIL_LIMIT = 50


def _newest() -> list[Column]:
    return [F.desc("created_at"), F.desc("job_id")]


def match_percentage() -> Column:
    ours = F.greatest("total_our_records", F.lit(1))
    return F.col("matched_records") / ours * F.lit(100.0)


def jobs_newest_first(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(*_newest())


def job_table(jobs: DataFrame) -> DataFrame:
    """Jobs with created time and match percentage as text, newest first."""
    return jobs.orderBy(*_newest()).select(
        "job_id", "job_name", "bank_name", "our_file_name", "bank_file_name", "status",
        timestamp_text(F.col("created_at")).alias("created"),
        "matched_records", "total_our_records", "total_bank_records",
        percent_text(match_percentage(), signed=False).alias("match_percent"),
    )


def recent_jobs(jobs: DataFrame, n: int = RECENT_JOBS) -> DataFrame:
    return jobs.orderBy(*_newest()).limit(n).select("job_id", "job_name")


def job_with_results(
    jobs: DataFrame, results: DataFrame, job_id: int
) -> tuple[DataFrame, DataFrame]:
    """One job and its results; both filters prune partitions."""
    return jobs.where(F.col("job_id") == job_id), results.where(F.col("job_id") == job_id)


def show_results(results: DataFrame, job_id: int | None = None) -> DataFrame:
    """Results of a job, or the last 50 of all jobs, newest first."""
    order = [F.desc("created_at"), F.col("job_id"), F.col("bank_trx_id")]
    if job_id is not None:
        return results.where(F.col("job_id") == job_id).select(*VIEW).orderBy(*order)
    return results.select(*VIEW).orderBy(*order).limit(RECENT_RESULTS)


def results_by_status(
    results: DataFrame, job_id: int, status: str | None = None, n: int = SHOWN_RESULTS
) -> DataFrame:
    """First results of a job with the given status, and how many there are in all."""
    chosen = results.where(F.col("job_id") == job_id)
    if status:
        chosen = chosen.where(F.col("status") == status)
    total = chosen.agg(F.count(F.lit(1))).scalar()
    return chosen.select(*VIEW, total.alias("total")).orderBy("bank_trx_id").limit(n)


def total_results(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total"))


def result_slice(results: DataFrame, job_id: int) -> DataFrame:
    """(bank_trx_id, status, amount) of a job, for export."""
    return results.where(F.col("job_id") == job_id).select("bank_trx_id", "status", "amount")


def report_sections(results: DataFrame, discrepancies: DataFrame) -> DataFrame:
    """First items of every report section of every job, with the number left out.

    20 discrepancies and 10 IDs per missing side. Counting is an aggregate of its own;
    only the items shown go through ranking.
    """
    id_or_display = F.coalesce("bank_trx_id_display", "bank_trx_id")
    missing = results.where(F.col("status").isin(MISSING_IN_BANK, MISSING_IN_OURS)).select(
        "job_id", F.col("status").alias("section"), "bank_trx_id", id_or_display.alias("display"),
        *[F.lit(None).cast(discrepancies.schema[c].dataType).alias(c)
          for c in ("our_amount", "bank_amount", "difference", "percentage_diff")],
    )
    different = discrepancies.select(
        "job_id", F.lit("discrepancies").alias("section"), "bank_trx_id",
        F.col("bank_trx_id").alias("display"),
        "our_amount", "bank_amount", "difference", "percentage_diff",
    )
    items = missing.unionByName(different)
    limit = reduce(
        lambda acc, kv: F.when(F.col("section") == kv[0], kv[1]).otherwise(acc),
        SECTION_LIMITS.items(),
        F.lit(0),
    )
    counts = items.groupBy("job_id", "section").agg(F.count(F.lit(1)).alias("total"))
    largest = max(SECTION_LIMITS.values())
    first = first_per_group(items, ["job_id", "section"], [F.col("bank_trx_id")], largest)
    shown = first.where(F.col("rank") <= limit)
    return shown.join(counts, ["job_id", "section"]).withColumn(
        "more", F.greatest(F.col("total") - limit, F.lit(0))
    )


def detail_sections(results: DataFrame, n: int = DETAIL_LIMIT) -> DataFrame:
    """First results per job and status as printed in the detailed report."""
    known = results.where(F.col("status").isin(*STATUSES))
    counts = known.groupBy("job_id", "status").agg(F.count(F.lit(1)).alias("total"))
    first = first_per_group(
        known.select(*VIEW, F.coalesce("bank_trx_id_display", "bank_trx_id").alias("display")),
        ["job_id", "status"], [F.col("bank_trx_id")], n,
    )
    amount = F.when(F.col("amount") != 0, number_text(F.col("amount"))).otherwise("N/A")
    return first.join(counts, ["job_id", "status"]).select(
        "job_id", "status", "rank", "display", "paying_bank_name",
        amount.alias("amount"),
        timestamp_text(F.col("created_at")).alias("created"),
        F.greatest(F.col("total") - n, F.lit(0)).alias("more"),
    )


def statistics_table(jobs: DataFrame) -> DataFrame:
    """Metric, count and percent of our records, five rows per job."""
    share = lambda c: percent_text(
        F.col(c) / F.greatest("total_our_records", F.lit(1)) * F.lit(100.0), signed=False
    )
    metrics = [
        ("Total Our Records", "total_our_records", F.lit("100%")),
        ("Total Bank Records", "total_bank_records", F.lit("100%")),
        ("Matched Records", "matched_records", share("matched_records")),
        ("Missing in Bank", "unmatched_our_records", share("unmatched_our_records")),
        ("Missing in Our File", "unmatched_bank_records", share("unmatched_bank_records")),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("line"), F.lit(name).alias("metric"),
                F.col(c).cast("bigint").alias("n"), p.alias("percent"),
            )
            for i, (name, c, p) in enumerate(metrics, 1)
        ]
    )
    return jobs.select("job_id", F.inline(rows))


def report_lines(
    jobs: DataFrame, results: DataFrame, discrepancies: DataFrame, *, live: bool = False
) -> DataFrame:
    """The text report of every job as numbered lines.

    A `live` report, made right after the run, names the confidences that kept amounts
    from being compared; a later one only says that they were not.

    The report shows a bounded number of items per section, so numbering the lines of a
    job in one window is bounded too.
    """
    money = lambda c: number_text(F.col(c))
    say = lambda text, *cols: F.format_string(text, *cols)
    head = [
        say("RECONCILIATION REPORT - %s", F.col("bank_name")),
        F.lit("=" * 50),
        F.lit(""),
        F.lit("TRANSACTION MATCHING SUMMARY:"),
        say("- Total records in our file: %d", F.col("total_our_records")),
        say("- Total records in bank file: %d", F.col("total_bank_records")),
        say("- Matched records: %d", F.col("matched_records")),
        say("- Missing in bank file: %d", F.col("unmatched_our_records")),
        say("- Missing in our file: %d", F.col("unmatched_bank_records")),
        say("- Match percentage: %.2f%%", match_percentage()),
        F.lit(""),
        F.lit("AMOUNT COMPARISON SUMMARY:"),
    ]
    yes_no = F.when(F.col("amounts_match"), "✅ YES").otherwise("❌ NO")
    compared = [
        say("- Our amount column: '%s'", F.col("our_amount_column")),
        say("- Bank amount column: '%s'", F.col("bank_amount_column")),
        say("- Our total (all transactions): %s", money("our_total_amount")),
        say("- Bank total (all transactions): %s", money("bank_total_amount")),
        say("- Matched total (our): %s", money("matched_total_our")),
        say("- Matched total (bank): %s", money("matched_total_bank")),
        say("- Difference: %s", money("total_difference_matched")),
        say("- Amounts match: %s", yes_no),
        say("- Transaction discrepancies: %d", F.col("total_discrepancies")),
        F.lit(""),
    ]
    not_detected = lambda c: F.coalesce(F.col(c), F.lit("Not detected"))
    reason = F.lit("- Reason: Amount comparison was not performed during reconciliation")
    if live:
        reason = say(
            "- Reason: Low confidence in amount column detection "
            "(our: %.1f%%, bank: %.1f%%, threshold: 30%%)",
            F.col("our_amount_confidence"), F.col("bank_amount_confidence"),
        )
    skipped = [
        F.lit("- Amount comparison: ⚠️ Not performed"),
        reason,
        say("- Our amount column: '%s'", not_detected("our_amount_column")),
        say("- Bank amount column: '%s'", not_detected("bank_amount_column")),
        F.lit(""),
    ]
    lines = F.when(F.col("amount_comparison_performed"), F.array(*head, *compared)).otherwise(
        F.array(*head, *skipped)
    )
    top = jobs.select("job_id", F.posexplode(lines).alias("b", "text")).select(
        "job_id", F.lit(0).alias("a"), F.lit(0).alias("rank"), "b", "text"
    )

    sections = report_sections(results, discrepancies)
    order = {"discrepancies": 1, MISSING_IN_BANK: 2, MISSING_IN_OURS: 3}
    titles = {
        "discrepancies": "AMOUNT DISCREPANCIES:",
        MISSING_IN_BANK: "MISSING IN BANK FILE:",
        MISSING_IN_OURS: "MISSING IN OUR FILE:",
    }
    section = F.col("section")
    number = reduce(lambda e, kv: e.when(section == kv[0], kv[1]), order.items(), F.when(F.lit(False), 0))
    title = reduce(lambda e, kv: e.when(section == kv[0], kv[1]), titles.items(), F.when(F.lit(False), ""))
    is_diff = section == "discrepancies"
    titled = F.when(
        F.col("rank") == 1,
        F.concat(F.when(is_diff, F.array().cast("array<string>")).otherwise(F.array(F.lit(""))),
                 F.array(title, F.lit("-" * 30))),
    ).otherwise(F.array().cast("array<string>"))
    item = F.when(
        is_diff,
        F.array(
            say("%d. Transaction ID: %s", F.col("rank"), F.col("display")),
            say("   Our amount: %s", money("our_amount")),
            say("   Bank amount: %s", money("bank_amount")),
            say("   Difference: %s (%s)", money("difference"),
                percent_text(F.col("percentage_diff"))),
            F.lit(""),
        ),
    ).otherwise(F.array(say("Bank Trx ID: %s", F.col("display"))))
    shown = reduce(lambda e, kv: e.when(section == kv[0], kv[1]), SECTION_LIMITS.items(),
                   F.when(F.lit(False), 0))
    ended = F.when(
        (F.col("rank") == shown) & (F.col("more") > 0),
        F.when(is_diff, F.array(say("... and %d more discrepancies", F.col("more")), F.lit("")))
        .otherwise(F.array(say("... and %d more", F.col("more")))),
    ).otherwise(F.array().cast("array<string>"))
    body = sections.select(
        "job_id", number.alias("a"), "rank", F.posexplode(F.concat(titled, item, ended)).alias("b", "text")
    )
    by_job = W.partitionBy("job_id").orderBy("a", "rank", "b")
    return top.unionByName(body).select(
        "job_id", F.row_number().over(by_job).alias("line_no"), "text"
    )

