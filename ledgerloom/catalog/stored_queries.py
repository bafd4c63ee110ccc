"""Registered queries for stored jobs, reports, records, file rules and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import functions as fn
from ledgerloom.operators import comparison as cmp
from ledgerloom.operators import keywords as kw
from ledgerloom.operators import learning
from ledgerloom.operators import matching as m
from ledgerloom.operators import profile as pf
from ledgerloom.operators import roles as rl
from ledgerloom.operators import stored
from ledgerloom.plans import training
from ledgerloom.sources import files
from ledgerloom.sources import keyword_files as kf

from . import detection_queries as dq
from . import tables
from .detection_queries import (
    _HEADERS,
    _STATEMENT_ID_SCORE,
    PART_KEYWORDS,
    _number,
    _profile_ctes,
    keyword_table,
    long_table,
    sample_table,
)
from .matching_queries import MONEY, TOTAL, bank_side, money_columns, ours_all
from .oracle import AMOUNT, over_long, over_sides
from .tables import LEDGER, duck

# --- stored tables: one job per bank, plus job 99 for statement IDs of no bank ----------


def results(spark: SparkSession, sf: str) -> DataFrame:
    both = m.reconcile_all_banks(ours_all(spark, sf), bank_side(spark, sf))
    rows = cmp.result_amounts(both)
    job = F.coalesce(F.substring_index("bank", " ", -1).cast("int") + 1, F.lit(99))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return rows.select(
        job.alias("job_id"),
        F.col("id").alias("bank_trx_id"),
        F.col("id").alias("bank_trx_id_display"),
        "status",
        F.coalesce("bank", F.lit("none")).alias("paying_bank_name"),
        F.coalesce("our_amount", F.lit(0).cast(MONEY.sql_type)).alias("amount"),
        "our_amount", "bank_amount", "amount_difference", "amount_match",
        (start + F.make_dt_interval(job % 3)).alias("created_at"),
    )


def discrepancy_table(rows: DataFrame) -> DataFrame:
    found = rows.where(F.col("status") == m.MATCHED).where(cmp.is_discrepancy())
    return found.select(
        "job_id", "bank_trx_id", "our_amount", "bank_amount",
        cmp.difference().cast(AMOUNT).alias("difference"),
        cmp.percentage().alias("percentage_diff"), "created_at",
    )


def jobs(rows: DataFrame) -> DataFrame:
    one = lambda *s: F.when(F.col("status").isin(*s), 1)
    sided = rows.withColumns(
        {
            "our_rows": one(m.MATCHED, m.MISSING_IN_BANK),
            "bank_rows": one(m.MATCHED, m.MISSING_IN_OURS),
        }
    )
    summary = cmp.run_summary(sided, "job_id", "created_at", "paying_bank_name")
    label = F.concat(F.lit("job "), F.col("job_id").cast("string"))
    return summary.select(
        "job_id", label.alias("job_name"), F.lit("ours.csv").alias("our_file_name"),
        F.lit("bank.csv").alias("bank_file_name"), F.col("paying_bank_name").alias("bank_name"),
        "created_at", F.lit("completed").alias("status"),
        "total_our_records", "total_bank_records", "matched_records",
        F.col("missing_in_bank_count").alias("unmatched_our_records"),
        F.col("missing_in_our_file_count").alias("unmatched_bank_records"),
        F.lit("paid_amt").alias("our_amount_column"), F.lit("credit").alias("bank_amount_column"),
        F.lit(True).alias("amount_comparison_performed"),
        F.col("our_total").alias("our_total_amount"),
        F.col("bank_total").alias("bank_total_amount"),
        "matched_total_our", "matched_total_bank", "total_difference_all",
        "total_difference_matched", "amounts_match", "total_discrepancies",
    )


def _text_time(df: DataFrame) -> DataFrame:
    return df.withColumn("created_at", fn.timestamp_text(F.col("created_at")))


def jobs_newest(spark, sf):
    out = _text_time(stored.jobs_newest_first(jobs(results(spark, sf))))
    money = [c for c in out.columns if c.endswith("_amount") or "total_" in c]
    keep = [c for c in money if "records" not in c and "disc" not in c]
    return money_columns(out, *keep)


def jobs_recent(spark, sf):
    return stored.job_table(jobs(results(spark, sf)))


def jobs_top5(spark, sf):
    return stored.recent_jobs(jobs(results(spark, sf)))


def results_recent(spark, sf):
    return _text_time(stored.show_results(results(spark, sf)))


def results_of_job(spark, sf):
    return _text_time(stored.show_results(results(spark, sf), 2))


def results_by_status(spark, sf):
    return _text_time(stored.results_by_status(results(spark, sf), 2, m.MISSING_IN_BANK))


def results_total(spark, sf):
    return stored.total_results(results(spark, sf))


def result_slice(spark, sf):
    return stored.result_slice(results(spark, sf), 3)


def report_sections(spark, sf):
    rows = results(spark, sf)
    out = stored.report_sections(rows, discrepancy_table(rows))
    return out.withColumn("percentage_diff", F.round("percentage_diff", 6))


def detail_sections(spark, sf):
    return stored.detail_sections(results(spark, sf))


def report_lines(spark, sf):
    rows = results(spark, sf)
    return stored.report_lines(jobs(rows), rows, discrepancy_table(rows))


def stats_table(spark, sf):
    return stored.statistics_table(jobs(results(spark, sf)))


# --- records, file rules, text rules ----------------------------------------------------


def record_json(spark, sf):
    """Ledger rows to JSON snapshots and back."""
    names = ["row_id", "bank_trx_id", "paying_bank_name", "paid_amt"]
    df = tables.ledger(spark, sf).select(fn.record_json(names).alias("record"))
    return fn.records_to_columns(df, "record", names)


def event_props(spark, sf):
    """Field of the events' JSON text."""
    events = tables.read(spark, sf, "events")
    return fn.records_to_columns(events, "props", ["k"]).groupBy("k").agg(
        F.count(F.lit(1)).alias("n")
    )


def preview(spark, sf):
    return files.preview(tables.ledger(spark, sf), order="row_id")


def column_policy(spark, sf):
    return files.column_policy(sample_table(spark, sf))


def typed_columns(spark, sf):
    """The tagged statement layout with amounts and numbers typed by policy."""
    df = tables.wide(spark, sf, "bank_tagged").select("Reference", "Debit", "`Credit دائن`")
    policies = {"Reference": "id", "Debit": "amount", "Credit دائن": "amount"}
    return files.apply_policy(df, policies, MONEY)


BANK_TEXT = """
SELECT o_orderkey, CASE o_custkey % 10
  WHEN 0 THEN 'HSBC transfer' WHEN 1 THEN 'via Standard Chartered' WHEN 2 THEN 'processing fee'
  WHEN 3 THEN 'bank of america ' || o_orderpriority WHEN 4 THEN 'RBC-' || o_orderstatus
  WHEN 5 THEN 'ING' WHEN 6 THEN 'First National' WHEN 7 THEN 'Paribas, Paris'
  WHEN 8 THEN 'intercity' ELSE o_orderpriority END AS note
FROM {orders}
"""


def bank_name_class(spark, sf):
    df = spark.sql(BANK_TEXT, orders=tables.read(spark, sf, "orders"))
    return df.select("o_orderkey", fn.bank_of(F.col("note")).alias("bank"))


KEYWORD_LINES = """
SELECT CASE p_partkey % 6
  WHEN 0 THEN '# ' || p_name WHEN 1 THEN '   '
  WHEN 2 THEN p_name || ', our' WHEN 3 THEN p_name
  WHEN 4 THEN p_name || ',bank,ar,' || CAST(p_size AS STRING) || ', Yes ,' || p_brand
  ELSE p_name || ',both,en,high' END AS value
FROM {part}
"""


def keyword_import(spark, sf):
    lines = spark.sql(KEYWORD_LINES, part=tables.read(spark, sf, "part"))
    return kf.parse_keyword_lines(lines)[0]


def keyword_rejects(spark, sf):
    lines = spark.sql(KEYWORD_LINES, part=tables.read(spark, sf, "part"))
    return kf.parse_keyword_lines(lines)[1]


def keyword_export(spark, sf):
    return kf.keyword_lines(keyword_table(spark, sf))


# --- learning: 75 files, 25 per layout ----------------------------------------------------


def training_files(spark: SparkSession, sf: str) -> DataFrame:
    part = F.concat_ws(
        "_", F.substring_index("file", "_", 1), (F.col("ordinal") % 25).cast("string")
    )
    return long_table(spark, sf).withColumn("file", F.concat(part, F.lit(".csv")))


def labels(long: DataFrame, ours: str, plain: str, tagged: str) -> DataFrame:
    kind = F.substring_index("file", "_", 1)
    label = F.when(kind == "ours", ours).when(kind == "plain", plain).otherwise(tagged)
    return long.select("file").distinct().select(F.col("file").alias("file_name"),
                                                 label.alias("label_col"))


ID_LABELS = ("Bank Trx ID", "Transaction_ID", "")
AMOUNT_LABELS = ("Paid Amt", "Credit", "Credit دائن")


def label_check(spark, sf):
    long = training_files(spark, sf)
    return learning.validate_labels(pf.headers(long), labels(long, *ID_LABELS))


def split_counts(spark, sf):
    long = training_files(spark, sf)
    features = pf.headers(long).select("file", "col")
    labelled = learning.labelled_set(features, labels(long, *AMOUNT_LABELS))
    return learning.split(labelled).groupBy("label", "train", "test").agg(
        F.count(F.lit(1)).alias("n")
    )


def rule_metrics(spark, sf):
    """The evaluation measures, applied to the rule-based statement ID detector."""
    long = training_files(spark, sf)
    best = rl.best_columns(rl.statement_id_scores(pf.column_profile(long)))
    labelled = learning.labelled_set(
        pf.headers(long).select("file", "col"), labels(long, *ID_LABELS)
    )
    chosen = best.select("file", "col", F.lit(1.0).alias("predicted"))
    out = learning.evaluate(
        labelled.join(chosen, ["file", "col"], "left").select(
            "label", F.coalesce("predicted", F.lit(0.0)).alias("predicted")
        )
    )
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1")})


def train_eval(spark, sf):
    """Amount detector: metrics on the held-out columns."""
    long = training_files(spark, sf)
    return training.train(long, labels(long, *AMOUNT_LABELS), "amount").metrics


# A file of a layout that the detector has not learned: name and text of its columns.
UNLEARNED = [("Kind", "o_orderstatus"), ("Amount due", "o_orderpriority"), ("Remark", "o_orderpriority")]


def unlearned_file(spark: SparkSession, sf: str) -> DataFrame:
    picked = ", ".join(f"{sql} AS `{name}`" for name, sql in UNLEARNED)
    return pf.to_long(spark.sql(
        f"SELECT 'odd_0.csv' AS file, o_orderkey AS ordinal, {picked} FROM {{orders}}",
        orders=tables.read(spark, sf, "orders")))


def learned_roles(spark, sf):
    """Learned amount column per file, rules where the detector is unsure: by its table of
    weights."""
    known = training_files(spark, sf)
    trained = training.train(known, labels(known, *AMOUNT_LABELS), "amount")
    long = known.unionByName(unlearned_file(spark, sf))
    words = kw.detection_keywords(kw.seed_keywords(spark), "bank", spark)
    rules = rl.amount_scores(pf.column_profile(long), words, pf.headers(long))
    learned = learning.table_confidence(
        learning.model_table(trained.model), training.FEATURES["amount"](long))
    return rl.cascade(learned, rules).select("file", "position", "col", "source")


# A detector of six weights, stated: feature, mean, standard deviation, weight; then the intercept.
STATED = [
    ("name_amt", 0.25, 0.5, 1.5), ("name_credit", 0.125, 0.25, 2.0), ("numeric_ratio", 0.5, 0.4, 1.25),
    ("has_decimal", 0.3, 0.45, 0.75), ("near_date", 0.5, 0.5, -0.5), ("has_currency", 0.0, 0.0, 9.0),
    (None, 0.0, 1.0, -1.5),
]


def linear_scores(spark, sf):
    """Scores of a stated detector over the features of every column."""
    table = spark.createDataFrame(STATED, "feature string, mean double, std double, weight double")
    out = learning.table_confidence(table, dq.amount_features(spark, sf))
    return out.withColumn("score", F.round("score", 6))


QUERIES = {
    f.__name__: f
    for f in (
        jobs_newest, jobs_recent, jobs_top5, results_recent, results_of_job, results_by_status,
        results_total, result_slice, report_sections, detail_sections, report_lines, stats_table,
        record_json, event_props, preview, column_policy, typed_columns, bank_name_class,
        keyword_import, keyword_rejects, keyword_export, label_check, split_counts, rule_metrics,
        train_eval, learned_roles, linear_scores,
    )
}


# --- oracle SQL -----------------------------------------------------------------------

_STORED = f""",
results AS (
  SELECT coalesce(CAST(right(bank, 1) AS INTEGER) + 1, 99) AS job_id, id AS bank_trx_id, status,
    coalesce(bank, 'none') AS paying_bank_name,
    CAST(coalesce(our_amount, 0) AS {AMOUNT}) AS amount, our_amount, bank_amount,
    strftime(DATE '2024-01-01' + CAST(coalesce(CAST(right(bank, 1) AS INTEGER) + 1, 99) % 3
      AS INTEGER), '%Y-%m-%d 00:00:00') AS created_at
  FROM recon_all),
diffs AS (
  SELECT *, CAST(our_amount - bank_amount AS {AMOUNT}) AS difference,
    round(CAST(our_amount - bank_amount AS DOUBLE)
          / CAST(greatest(our_amount, 0.01) AS DOUBLE) * 100.0, 6) AS percentage_diff
  FROM results WHERE status = 'matched' AND abs(our_amount - bank_amount) > 0.01),
jobs AS (
  SELECT job_id, 'job ' || job_id AS job_name, 'ours.csv' AS our_file_name,
    'bank.csv' AS bank_file_name, paying_bank_name AS bank_name, created_at,
    'completed' AS status,
    count(*) FILTER (status <> 'missing_in_our_file') AS total_our_records,
    count(*) FILTER (status <> 'missing_in_bank') AS total_bank_records,
    count(*) FILTER (status = 'matched') AS matched_records,
    count(*) FILTER (status = 'missing_in_bank') AS unmatched_our_records,
    count(*) FILTER (status = 'missing_in_our_file') AS unmatched_bank_records,
    CAST(coalesce(sum(our_amount), 0) AS {TOTAL}) AS our_total_amount,
    CAST(coalesce(sum(bank_amount), 0) AS {TOTAL}) AS bank_total_amount,
    CAST(coalesce(sum(our_amount) FILTER (status = 'matched'), 0) AS {TOTAL}) AS matched_total_our,
    CAST(coalesce(sum(bank_amount) FILTER (status = 'matched'), 0) AS {TOTAL})
      AS matched_total_bank,
    count(*) FILTER (status = 'matched' AND abs(our_amount - bank_amount) > 0.01)
      AS total_discrepancies
  FROM results GROUP BY job_id, created_at, paying_bank_name)"""


def over_stored(select: str, more: str = "") -> str:
    return over_sides("").rstrip() + _STORED + more + "\n" + select


_VIEW = "job_id, bank_trx_id, status, paying_bank_name, amount, created_at"
_PERCENT = "printf('%.1f%%', CAST({} AS DOUBLE) / greatest(total_our_records, 1) * 100.0)"
_STATS = " UNION ALL ".join(
    f"SELECT job_id, {i} AS line, '{name}' AS metric, {c} AS n, "
    f"{_PERCENT.format(c) if i > 2 else repr('100%')} AS percent FROM jobs"
    for i, (name, c) in enumerate(
        [
            ("Total Our Records", "total_our_records"),
            ("Total Bank Records", "total_bank_records"),
            ("Matched Records", "matched_records"),
            ("Missing in Bank", "unmatched_our_records"),
            ("Missing in Our File", "unmatched_bank_records"),
        ],
        1,
    )
)

_SECTIONS = """,
items AS (
  SELECT job_id, status AS section, bank_trx_id, bank_trx_id AS display,
    NULL AS our_amount, NULL AS bank_amount, NULL AS difference, NULL AS percentage_diff
  FROM results WHERE status <> 'matched'
  UNION ALL
  SELECT job_id, 'discrepancies', bank_trx_id, bank_trx_id, our_amount, bank_amount, difference,
    percentage_diff FROM diffs),
sections AS (
  SELECT *, CASE section WHEN 'discrepancies' THEN 20 ELSE 10 END AS cap,
    CAST(row_number() OVER (PARTITION BY job_id, section ORDER BY bank_trx_id) AS INTEGER) AS rank,
    count(*) OVER (PARTITION BY job_id, section) AS total
  FROM items),
shown AS (SELECT *, greatest(total - cap, 0) AS more FROM sections WHERE rank <= cap)"""

_F2 = "format('{{:,.2f}}', CAST({} AS DOUBLE))"


def _money(c: str) -> str:
    return _F2.format(c)


_HEAD_LINES = [
    "'RECONCILIATION REPORT - ' || bank_name", "repeat('=', 50)", "''",
    "'TRANSACTION MATCHING SUMMARY:'",
    "'- Total records in our file: ' || total_our_records",
    "'- Total records in bank file: ' || total_bank_records",
    "'- Matched records: ' || matched_records",
    "'- Missing in bank file: ' || unmatched_our_records",
    "'- Missing in our file: ' || unmatched_bank_records",
    "printf('- Match percentage: %.2f%%',"
    " CAST(matched_records AS DOUBLE) / greatest(total_our_records, 1) * 100.0)",
    "''", "'AMOUNT COMPARISON SUMMARY:'",
    "'- Our amount column: ''paid_amt'''", "'- Bank amount column: ''credit'''",
    f"'- Our total (all transactions): ' || {_money('our_total_amount')}",
    f"'- Bank total (all transactions): ' || {_money('bank_total_amount')}",
    f"'- Matched total (our): ' || {_money('matched_total_our')}",
    f"'- Matched total (bank): ' || {_money('matched_total_bank')}",
    f"'- Difference: ' || {_money('matched_total_our - matched_total_bank')}",
    "'- Amounts match: ' || CASE WHEN abs(matched_total_our - matched_total_bank) < 0.01"
    " THEN '✅ YES' ELSE '❌ NO' END",
    "'- Transaction discrepancies: ' || total_discrepancies", "''",
]

_DASHES = "repeat('-', 30)"
_REPORT = f""",
blocks AS (
  SELECT job_id, 0 AS a, 0 AS rank, [{', '.join(_HEAD_LINES)}] AS texts FROM jobs
  UNION ALL
  SELECT job_id, 1, rank,
    CASE WHEN rank = 1 THEN ['AMOUNT DISCREPANCIES:', {_DASHES}] ELSE [] END
    || [rank || '. Transaction ID: ' || display, '   Our amount: ' || {_money('our_amount')},
        '   Bank amount: ' || {_money('bank_amount')},
        '   Difference: ' || {_money('difference')}
          || printf(' (%+.1f%%)', percentage_diff), '']
    || CASE WHEN rank = cap AND more > 0
       THEN ['... and ' || more || ' more discrepancies', ''] ELSE [] END
  FROM shown WHERE section = 'discrepancies'
  UNION ALL
  SELECT job_id, CASE section WHEN 'missing_in_bank' THEN 2 ELSE 3 END, rank,
    CASE WHEN rank = 1 THEN ['', CASE section WHEN 'missing_in_bank' THEN 'MISSING IN BANK FILE:'
      ELSE 'MISSING IN OUR FILE:' END, {_DASHES}] ELSE [] END
    || ['Bank Trx ID: ' || display]
    || CASE WHEN rank = cap AND more > 0 THEN ['... and ' || more || ' more'] ELSE [] END
  FROM shown WHERE section <> 'discrepancies'),
lines AS (
  SELECT job_id, a, rank, unnest(texts) AS text, generate_subscripts(texts, 1) AS b FROM blocks)"""

_ID_WORD = "(regexp_matches(lower(col), '(^|[^a-z])id([^a-z]|$)')" \
    " OR (ends_with(lower(col), 'id') AND NOT ends_with(lower(col), 'paid')))"


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(col), '{w}')" for w in words) + ")"


def _amount(x: str) -> str:
    from .oracle import parse_amount

    return parse_amount(x)


def _bank_case() -> str:
    cases = []
    for bank, words in fn.BANK_PATTERNS.items():
        parts = [w + "([^a-z0-9]|$)" if len(w) <= 3 else w for w in words]
        pattern = "(^|[^a-z0-9])(" + "|".join(parts) + ")"
        cases.append(f"WHEN regexp_matches(lower(note), '{pattern}') THEN '{bank}'")
    return "CASE " + " ".join(cases) + " END"


_PART_LINES = KEYWORD_LINES.replace("{part}", "part")
_FIELDS = f"""WITH raw AS ({_PART_LINES}),
f AS (SELECT value, list_transform(string_split(value, ','), lambda x: trim(x)) AS f FROM raw
      WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#')),
parsed AS (
  SELECT value, f[1] AS keyword, f[2] AS file_type, coalesce(f[3], 'en') AS language,
    try_cast(coalesce(f[4], '50') AS INTEGER) AS priority,
    coalesce(lower(f[5]) IN ('true', '1', 'yes'), false) AS is_exact_match,
    coalesce(f[6], '') AS description
  FROM f WHERE len(f) >= 2)"""

# The training files regroup the long table by row number.
_FILES = over_long("", "").rstrip() + """,
training AS (SELECT * REPLACE (split_part(file, '_', 1) || '_' || (ordinal % 25) || '.csv' AS file)
             FROM long),
columns AS (SELECT DISTINCT file, position, n_cols, col FROM training)"""


def _label(ours: str, plain: str, tagged: str) -> str:
    return (
        f"CASE split_part(file, '_', 1) WHEN 'ours' THEN '{ours}'"
        f" WHEN 'plain' THEN '{plain}' ELSE '{tagged}' END"
    )


_CASH = "CAST(coalesce(CAST({0} AS DOUBLE) / greatest({1}, 1), 0) AS DOUBLE)"

ORACLES = {
    "jobs_newest": over_stored(f"""
SELECT *, 'paid_amt' AS our_amount_column, 'credit' AS bank_amount_column,
  true AS amount_comparison_performed,
  CAST(our_total_amount - bank_total_amount AS {TOTAL}) AS total_difference_all,
  CAST(matched_total_our - matched_total_bank AS {TOTAL}) AS total_difference_matched,
  abs(matched_total_our - matched_total_bank) < 0.01 AS amounts_match
FROM jobs ORDER BY created_at DESC, job_id DESC"""),
    "jobs_recent": over_stored(f"""
SELECT job_id, job_name, bank_name, our_file_name, bank_file_name, status, created_at AS created,
  matched_records, total_our_records, total_bank_records,
  {_PERCENT.format('matched_records')} AS match_percent
FROM jobs ORDER BY created_at DESC, job_id DESC"""),
    "jobs_top5": over_stored(
        "SELECT job_id, job_name FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 5"),
    "results_recent": over_stored(
        f"SELECT {_VIEW} FROM results ORDER BY created_at DESC, job_id, bank_trx_id LIMIT 50"),
    "results_of_job": over_stored(f"SELECT {_VIEW} FROM results WHERE job_id = 2"),
    "results_by_status": over_stored(f"""
SELECT {_VIEW}, count(*) OVER () AS total FROM results
WHERE job_id = 2 AND status = 'missing_in_bank' ORDER BY bank_trx_id LIMIT 100"""),
    "results_total": over_stored("SELECT count(*) AS total FROM results"),
    "result_slice": over_stored("SELECT bank_trx_id, status, amount FROM results WHERE job_id = 3"),
    "report_sections": over_stored("SELECT * EXCLUDE (cap) FROM shown", _SECTIONS),
    "detail_sections": over_stored(f"""
SELECT job_id, status, CAST(rnk AS INTEGER) AS rank, bank_trx_id AS display, paying_bank_name,
  CASE WHEN amount <> 0 THEN {_money('amount')} ELSE 'N/A' END AS amount, created_at AS created,
  greatest(total - 50, 0) AS more
FROM (SELECT *, row_number() OVER (PARTITION BY job_id, status ORDER BY bank_trx_id) AS rnk,
        count(*) OVER (PARTITION BY job_id, status) AS total FROM results) WHERE rnk <= 50"""),
    "report_lines": over_stored("""
SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY a, rank, b) AS INTEGER)
  AS line_no, text FROM lines""", _SECTIONS + _REPORT),
    "stats_table": over_stored(_STATS),
    "record_json": f"""SELECT CAST(row_id AS VARCHAR) AS row_id, bank_trx_id, paying_bank_name,
  paid_amt FROM ({duck(LEDGER)})""",
    "event_props": "SELECT props->>'k' AS k, count(*) AS n FROM events GROUP BY 1",
    "preview": f"SELECT * FROM ({duck(LEDGER)}) ORDER BY row_id LIMIT 3",
    "column_policy": over_long(
        _HEADERS + f""",
shares AS (SELECT file, position, CAST(count({_number('val')}) AS DOUBLE) / count(*) AS share
           FROM present WHERE rn <= 10 GROUP BY file, position)""",
        f"""SELECT h.file, h.position, h.col, share AS numeric_share,
  CASE WHEN {_ID_WORD} OR {_any(files.ID_WORDS)} THEN 'id'
    WHEN {_any(files.AMOUNT_WORDS)} THEN 'amount'
    WHEN share > 0.7 THEN 'numeric' ELSE 'text' END AS policy
FROM headers h LEFT JOIN shares s ON s.file = h.file AND s.position = h.position""",
    ),
    "typed_columns": "SELECT "
    + ", ".join(
        f'{_amount(f"({sql})") if name != "Reference" else sql} AS "{name}"'
        for name, sql in tables.LAYOUTS["bank_tagged"][1]
        if name in ("Reference", "Debit", "Credit دائن")
    )
    + " FROM orders",
    "bank_name_class": f"SELECT o_orderkey, {_bank_case()} AS bank FROM ({duck(BANK_TEXT)})",
    "keyword_import": _FIELDS + "SELECT * EXCLUDE (value) FROM parsed WHERE priority IS NOT NULL",
    "keyword_rejects": _FIELDS + "SELECT value FROM parsed WHERE priority IS NULL",
    "keyword_export": f"""SELECT keyword || ',' || file_type || ',' || language || ',' || priority
  || ',' || CASE WHEN is_exact_match THEN 'True' ELSE 'False' END || ',' || description AS value
FROM ({PART_KEYWORDS.replace('{part}', 'part')}) WHERE is_active
ORDER BY priority DESC, keyword""",
    "label_check": _FILES + f""",
labelled AS (SELECT DISTINCT file, {_label(*ID_LABELS)} AS label FROM columns)
SELECT count(*) AS labelled_files, count(*) FILTER (label <> '') AS valid_labels,
  CASE WHEN count(*) FILTER (label <> '') = 0 THEN 'fail'
    WHEN count(*) FILTER (label <> '') < 3 THEN 'warn' ELSE 'ok' END AS verdict FROM labelled""",
    "split_counts": _FILES + f""",
sizes AS (SELECT CAST(col = {_label(*AMOUNT_LABELS)} AS DOUBLE) AS label, count(*) AS n
          FROM columns GROUP BY 1),
cut AS (SELECT label, n, CAST(round(n * 0.2) AS BIGINT) AS k FROM sizes)
SELECT label, false AS train, true AS test, k AS n FROM cut
UNION ALL SELECT label, true, false, n - k FROM cut""",
    # Every held-out column is told right, at any scale: the classes are apart.
    "train_eval": _FILES + f""",
sizes AS (SELECT col = {_label(*AMOUNT_LABELS)} AS label, CAST(round(count(*) * 0.2) AS BIGINT) AS k
          FROM columns GROUP BY 1),
held AS (SELECT sum(k) AS n, sum(k) FILTER (label) AS hits FROM sizes)
SELECT CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS correct, CAST(hits AS BIGINT) AS true_positives,
  CAST(hits AS BIGINT) AS predicted_positives, CAST(hits AS BIGINT) AS actual_positives,
  1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1
FROM held""",
    "learned_roles": _FILES + f"""
SELECT file, position, col, 'learned' AS source FROM columns
WHERE col = {_label(*AMOUNT_LABELS)}
UNION ALL SELECT 'odd_0.csv', 1, 'Amount due', 'rules'""",
    "linear_scores": f"""SELECT file, CAST(position AS INTEGER) AS position, col, round(100.0 / (1.0 + exp(-(-1.5
  + (name_amt - 0.25) / 0.5 * 1.5 + (name_credit - 0.125) / 0.25 * 2.0
  + (numeric_ratio - 0.5) / 0.4 * 1.25 + (has_decimal - 0.3) / 0.45 * 0.75
  + (near_date - 0.5) / 0.5 * -0.5))), 6) AS score FROM ({dq.ORACLES["amount_features"]})""",
    "rule_metrics": _FILES.replace("training AS", "files AS").replace(
        "FROM training", "FROM files"
    ) + _profile_ctes(100).replace("FROM long", "FROM files") + f""",
best AS (SELECT file, col FROM (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, position) AS rnk
  FROM (SELECT *, {_STATEMENT_ID_SCORE} AS score FROM profile)) WHERE rnk = 1),
pairs AS (
  SELECT c.col = {_label(*ID_LABELS).replace('file', 'c.file')} AS label, b.col IS NOT NULL AS hit
  FROM columns c LEFT JOIN best b ON b.file = c.file AND b.col = c.col),
tally AS (
  SELECT count(*) AS n, count(*) FILTER (label = hit) AS correct,
    count(*) FILTER (label AND hit) AS true_positives,
    count(*) FILTER (hit) AS predicted_positives, count(*) FILTER (label) AS actual_positives
  FROM pairs),
rated AS (
  SELECT *, {_CASH.format('correct', 'n')} AS accuracy,
    {_CASH.format('true_positives', 'predicted_positives')} AS "precision",
    {_CASH.format('true_positives', 'actual_positives')} AS recall FROM tally)
SELECT n, correct, true_positives, predicted_positives, actual_positives,
  round(accuracy, 9) AS accuracy, round("precision", 9) AS "precision",
  round(recall, 9) AS recall,
  round(2.0 * "precision" * recall / greatest("precision" + recall, 1e-8), 9) AS f1 FROM rated""",
}
