"""Registered queries that go through files and the store.

Each run writes what it needs to a new folder under the checkpoint directory and reads it
back with the library's own sources.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans import reconcile as rc
from ledgerloom.sources import files
from ledgerloom.sources import keyword_files as kf
from ledgerloom.sources.store import Store, checkpoint_dir, dump

from . import tables
from .detection_queries import PART_KEYWORDS, keyword_table
from .matching_queries import _SUMMARY, MONEY
from .oracle import AMOUNT, over_sides
from .tables import LEDGER, STATEMENT, duck


def run_folder(spark: SparkSession) -> str:
    return os.path.join(checkpoint_dir(spark), f"run-{uuid.uuid4().hex}")


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.options(
        header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def csv_directory(spark, sf):
    """Ledger and statement as CSV files of two layouts, read as one directory."""
    folder = run_folder(spark)
    _write_csv(tables.ledger(spark, sf), os.path.join(folder, "ours"))
    _write_csv(tables.statement(spark, sf), os.path.join(folder, "bank"))
    cells = files.read_directory(spark, folder)
    return cells.groupBy("position", "n_cols", "col").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count("val").alias("n_values"),
        F.count_distinct("val").alias("n_distinct"),
        F.sum(F.length("val")).alias("n_chars"),
    )


def csv_ledger(spark, sf):
    """The ledger written as CSV and read back: texts untouched, blanks null."""
    folder = run_folder(spark)
    _write_csv(tables.ledger(spark, sf), folder)
    return files.read_csv(spark, folder).drop("file", "ordinal")


ENCODED = "SELECT 'café ' || CAST(o_orderkey AS STRING) AS value FROM {orders}"


def file_encodings(spark, sf):
    """Lines and invalid lines per encoding of the same text written in two encodings."""
    folder = run_folder(spark)
    text = spark.sql(ENCODED, orders=tables.read(spark, sf, "orders"))
    for name in ("UTF-8", "ISO-8859-1"):
        text.write.option("encoding", name).csv(os.path.join(folder, name))
    return files.encodings(spark, folder).groupBy("encoding").agg(
        F.sum("n_lines").alias("n_lines"), F.sum("n_invalid").alias("n_invalid")
    )


def header_lines(spark, sf):
    """Distinct header lines of a directory of CSV files."""
    folder = run_folder(spark)
    _write_csv(tables.ledger(spark, sf), os.path.join(folder, "ours"))
    _write_csv(tables.statement(spark, sf), os.path.join(folder, "bank"))
    return files.header_lines(spark, folder).select("header").distinct()


def _job(spark: SparkSession, sf: str) -> tuple[Store, rc.Run]:
    ledger = tables.ledger(spark, sf).withColumn("ordinal", F.col("row_id"))
    statement = tables.statement(spark, sf).withColumn("ordinal", F.col("row_id"))
    roles = rc.Roles("bank_trx_id", "transaction_id", "paid_amt", "credit")
    store = Store(spark, run_folder(spark), MONEY)
    run = rc.reconcile(
        ledger, statement, store, job_name="all", roles=roles, bank_column="paying_bank_name"
    )
    return store, run


def stored_job(spark, sf):
    """Job row of a whole run, from the store."""
    return _job(spark, sf)[1].job.select(
        "job_id", "bank_name", "status", "total_our_records", "total_bank_records",
        "matched_records", "unmatched_our_records", "unmatched_bank_records",
        "our_total_amount", "bank_total_amount", "matched_total_our", "matched_total_bank",
        "amount_comparison_performed", "total_discrepancies",
    )


def stored_results(spark, sf):
    """Result rows of a whole run, from the store."""
    return _job(spark, sf)[1].results.select(
        "bank_trx_id", "bank_trx_id_display", "status", "our_amount", "bank_amount",
        "amount_difference", "amount_match",
        F.get_json_object("our_record_data", "$.row_id").alias("our_row"),
        F.get_json_object("bank_record_data", "$.row_id").alias("bank_row"),
    )


def stored_discrepancies(spark, sf):
    out = _job(spark, sf)[1].discrepancies
    return out.select("bank_trx_id", "difference")


def exported_job(spark, sf):
    """Rows per status of both sides of an exported stored job."""
    store, run = _job(spark, sf)
    paths = rc.export_job(
        store, run.job_id, run_folder(spark), bank_column="paying_bank_name"
    )
    sides = [
        files.read_csv(spark, path).select(
            F.lit(name).alias("side"), F.col(f"`{rc.STATUS_COLUMN}`").alias("status")
        )
        for name, path in zip(("our", "bank"), paths)
    ]
    return sides[0].unionByName(sides[1]).groupBy("side", "status").agg(
        F.count(F.lit(1)).alias("n")
    )


def dumped_results(spark, sf):
    """Results dumped from the store, counted per status."""
    store, _ = _job(spark, sf)
    folder = run_folder(spark)
    dump(store, folder)
    return spark.read.parquet(os.path.join(folder, "results")).groupBy("status").agg(
        F.count(F.lit(1)).alias("n")
    )


def exported_rows(spark, sf):
    """Every row of both sides of an exported stored job, with its status."""
    store, run = _job(spark, sf)
    paths = rc.export_job(
        store, run.job_id, run_folder(spark), bank_column="paying_bank_name"
    )
    sides = [
        files.read_csv(spark, path).select(
            F.lit(name).alias("side"), F.col("row_id").cast("long").alias("row_id"),
            F.col(trx).alias("trx"), F.col(f"`{rc.STATUS_COLUMN}`").alias("status"))
        for name, path, trx in zip(
            ("our", "bank"), paths, ("bank_trx_id", "transaction_id"))
    ]
    return sides[0].unionByName(sides[1])


def dumped_rows(spark, sf):
    """Rows of the dumped results."""
    store, _ = _job(spark, sf)
    folder = run_folder(spark)
    dump(store, folder)
    return spark.read.parquet(os.path.join(folder, "results")).select(
        "job_id", "bank_trx_id", "bank_trx_id_display", "status", "our_amount", "bank_amount")


def keyword_file(spark, sf):
    """Keywords written to a file and imported again."""
    folder = run_folder(spark)
    kf.write_keywords(keyword_table(spark, sf), folder)
    return kf.read_keywords(spark, folder)[0]


QUERIES = {
    f.__name__: f
    for f in (
        csv_directory, csv_ledger, file_encodings, header_lines, stored_job, stored_results,
        stored_discrepancies, exported_job, exported_rows, dumped_results, dumped_rows, keyword_file,
    )
}


# Texts that the reader takes for missing cells, spelled out again for the check.
_NA = """'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN',
  '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"""


def _present(value: str) -> str:
    return f"CASE WHEN {value} NOT IN ({_NA}) THEN {value} END"


def _cells(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS position, {len(columns)} AS n_cols, '{c}' AS col,"
        f" {_present(f'CAST({c} AS VARCHAR)')} AS val FROM {name}"
        for i, c in enumerate(columns)
    )


_OURS = ["row_id", "bank_trx_id", "paying_bank_name", "paid_amt"]
_BANK = ["row_id", "transaction_id", "credit"]

_FIRST = """,
our_first AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS rn FROM ours
  WHERE id IS NOT NULL) WHERE rn = 1),
bank_first AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS rn FROM bank
  WHERE id IS NOT NULL) WHERE rn = 1)"""

_PAIR = """CASE WHEN l.id IS NULL THEN 'false'
  WHEN abs(r.amount - l.amount) > 0.01 THEN 'amt_diff' ELSE 'true' END"""

ORACLES = {
    "csv_directory": f"""WITH ledger AS ({duck(LEDGER)}), statement AS ({duck(STATEMENT)}),
cells AS ({_cells('ledger', _OURS)} UNION ALL {_cells('statement', _BANK)})
SELECT position, n_cols, col, count(*) AS n_cells, count(val) AS n_values,
  count(DISTINCT val) AS n_distinct, CAST(sum(length(val)) AS BIGINT) AS n_chars
FROM cells GROUP BY position, n_cols, col""",
    "csv_ledger": f"""SELECT CAST(row_id AS VARCHAR) AS row_id,
  {_present('bank_trx_id')} AS bank_trx_id, {_present('paying_bank_name')} AS paying_bank_name,
  {_present('paid_amt')} AS paid_amt FROM ({duck(LEDGER)})""",
    "file_encodings": """SELECT 'UTF-8' AS encoding, count(*) AS n_lines,
  CAST(0 AS BIGINT) AS n_invalid FROM orders
UNION ALL SELECT 'ISO-8859-1', count(*), count(*) FROM orders""",
    "header_lines": f"SELECT '{','.join(_OURS)}' AS header UNION ALL SELECT '{','.join(_BANK)}'",
    "stored_job": over_sides(f"""
SELECT 1 AS job_id, (SELECT bank FROM target) AS bank_name, 'completed' AS status,
  total_our_records, total_bank_records, matched_records,
  missing_in_bank_count AS unmatched_our_records,
  missing_in_our_file_count AS unmatched_bank_records, our_total AS our_total_amount,
  bank_total AS bank_total_amount, matched_total_our, matched_total_bank,
  true AS amount_comparison_performed, total_discrepancies
FROM ({_SUMMARY})"""),
    "stored_results": over_sides("").rstrip() + _FIRST + f"""
SELECT r.id AS bank_trx_id,
  CASE WHEN b.original <> r.id THEN b.original || ' | ' || r.id ELSE r.id END
    AS bank_trx_id_display,
  r.status, r.our_amount, r.bank_amount,
  CASE WHEN status = 'matched' THEN CAST(our_amount - bank_amount AS {AMOUNT}) END
    AS amount_difference,
  CASE WHEN status = 'matched' THEN abs(our_amount - bank_amount) < 0.01 END AS amount_match,
  CAST(o.ordinal AS VARCHAR) AS our_row, CAST(b.ordinal AS VARCHAR) AS bank_row
FROM recon r LEFT JOIN our_first o ON o.id = r.id LEFT JOIN bank_first b ON b.id = r.id""",
    "stored_discrepancies": over_sides(f"""
SELECT id AS bank_trx_id, CAST(our_amount - bank_amount AS {AMOUNT}) AS difference
FROM recon WHERE status = 'matched' AND abs(our_amount - bank_amount) > 0.01"""),
    "exported_job": over_sides("").rstrip() + _FIRST + f"""
SELECT side, status, count(*) AS n FROM (
  SELECT 'our' AS side, {_PAIR} AS status
  FROM our_first r LEFT JOIN bank_first l ON r.id = l.id
  UNION ALL
  SELECT 'bank', {_PAIR} FROM bank_first r LEFT JOIN our_first l ON r.id = l.id)
GROUP BY side, status""",
    "exported_rows": over_sides("").rstrip() + _FIRST + f"""
SELECT 'our' AS side, r.ordinal AS row_id, r.original AS trx, {_PAIR} AS status
FROM our_first r LEFT JOIN bank_first l ON r.id = l.id
UNION ALL
SELECT 'bank', r.ordinal, r.original, {_PAIR} FROM bank_first r LEFT JOIN our_first l ON r.id = l.id""",
    "dumped_rows": over_sides("").rstrip() + _FIRST + """
SELECT 1 AS job_id, r.id AS bank_trx_id,
  CASE WHEN b.original <> r.id THEN b.original || ' | ' || r.id ELSE r.id END
    AS bank_trx_id_display, r.status, r.our_amount, r.bank_amount
FROM recon r LEFT JOIN bank_first b ON b.id = r.id""",
    "dumped_results": over_sides("SELECT status, count(*) AS n FROM recon GROUP BY status"),
    "keyword_file": f"""SELECT keyword, file_type, language, priority, is_exact_match, description
FROM ({PART_KEYWORDS.replace('{part}', 'part')}) WHERE is_active""",
}
