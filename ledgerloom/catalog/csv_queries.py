"""Registered queries over CSV files as they come: quotes, bad rows, mixed headers and encodings.

Every query writes files derived from the order data to a new folder and reads them back.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ledgerloom.plans import reconcile as rc
from ledgerloom.sources import files
from ledgerloom.sources.store import Store

from . import tables
from .file_queries import run_folder
from .matching_queries import MONEY
from .oracle import over_sides

_KEY = "CAST(o_orderkey AS STRING)"
_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"

# Lines under the header id,amt,note: an extra field, an open quote, quoted separators and quotes,
# a field too few, and plain ones.
LINES = f"""
SELECT o_orderkey, CASE
  WHEN o_orderkey % 7 = 0 THEN {_KEY} || ',' || {_PRICE} || ',"x, y",EXTRA'
  WHEN o_orderkey % 11 = 0 THEN {_KEY} || ',"' || {_PRICE} || ',open'
  WHEN o_orderkey % 5 = 0 THEN {_KEY} || ',"1,' || {_PRICE} || '","say ""' || o_orderpriority
    || '"", C:' || chr(92) || '"'
  WHEN o_orderkey % 3 = 0 THEN {_KEY} || ',' || {_PRICE}
  ELSE {_KEY} || ',' || {_PRICE} || ',5" ' || o_orderpriority END AS value
FROM {{orders}}"""


def _lines(spark, sf):
    """A folder with files of LINES, each under its header."""
    folder = run_folder(spark)
    lines = spark.sql(LINES, orders=tables.read(spark, sf, "orders"))
    part = F.pmod(F.xxhash64("o_orderkey"), F.lit(4))
    for i in range(4):
        head = spark.createDataFrame([("id,amt,note",)], "value string").coalesce(1)
        rows = lines.where(part == i).select("value").coalesce(1)
        head.unionByName(rows).coalesce(1).write.text(os.path.join(folder, f"part{i}"))
    return folder


def csv_bad_rows(spark, sf):
    """Rows that are set aside, and why."""
    bad = files.CsvFiles.open(spark, _lines(spark, sf)).rejected()
    return bad.select("problem", "n_fields", "n_cols", "line")


def csv_quoted(spark, sf):
    """Rows that stay, with what their quotes hold."""
    return files.load_file(spark, _lines(spark, sf), fmt="csv").select("id", "amt", "note")


# Three layouts of the same rows: header and text columns.
SWAPPED = {
    "a": [("id", _KEY), ("amt", _PRICE), ("no,te", "o_orderpriority")],
    "b": [("amt", _PRICE), ("id", _KEY)],
    "c": [("id", "o_orderstatus"), ("id ", _KEY), ("Amt", _PRICE), ("day", "o_orderpriority"),
          ("x", "''")],
}


def csv_mixed_headers(spark, sf):
    """Cells of a directory whose files have three headers."""
    folder = run_folder(spark)
    orders = tables.read(spark, sf, "orders")
    for name, columns in SWAPPED.items():
        picked = ", ".join(f"{sql} AS `{col}`" for col, sql in columns)
        spark.sql(f"SELECT {picked} FROM {{orders}}", orders=orders).write.options(
            header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(
            os.path.join(folder, name))
    return files.read_directory(spark, folder).select("position", "n_cols", "col", "val")


ACCENTED = f"""
SELECT {_KEY} AS id, 'café ' || o_orderpriority || ' ü' AS note, o_orderkey % 2 AS half
FROM {{orders}}"""


def csv_mixed_encodings(spark, sf):
    """One header, files of two encodings, read as one table."""
    folder = run_folder(spark)
    rows = spark.sql(ACCENTED, orders=tables.read(spark, sf, "orders"))
    for half, name in enumerate(("UTF-8", "ISO-8859-1")):
        rows.where(F.col("half") == half).drop("half").write.options(
            header=True, encoding=name).csv(os.path.join(folder, name))
    return files.load_file(spark, folder).select("id", "note")


def recon_directory(spark, sf):
    """A ledger directory of two encodings against a parquet statement."""
    folder = run_folder(spark)
    ledger = tables.ledger(spark, sf).withColumn("note", F.lit("café"))
    late = F.col("row_id") >= 1_000_000_000
    for name, rows, encoding in (("a", ledger.where(~late), "UTF-8"),
                                 ("b", ledger.where(late), "ISO-8859-1")):
        ordered = rows.repartitionByRange(4, "row_id").sortWithinPartitions("row_id")
        ordered.write.options(
            header=True, encoding=encoding, ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False).csv(os.path.join(folder, "ours", name))
    statement = tables.statement(spark, sf).repartitionByRange(3, "row_id")
    statement.sortWithinPartitions("row_id").write.parquet(os.path.join(folder, "bank.parquet"))
    run = rc.reconcile_files(
        spark, os.path.join(folder, "ours"), os.path.join(folder, "bank.parquet"),
        Store(spark, os.path.join(folder, "store"), MONEY), job_name="directory",
        roles=rc.Roles("bank_trx_id", "transaction_id", "paid_amt", "credit"),
        bank_column="paying_bank_name")
    return run.results.select(
        "bank_trx_id", "status", "our_amount", "bank_amount", "paying_bank_name",
        F.get_json_object("our_record_data", "$.row_id").alias("our_row"),
        F.get_json_object("our_record_data", "$.note").alias("our_note"))


QUERIES = {f.__name__: f for f in (
    csv_bad_rows, csv_quoted, csv_mixed_headers, csv_mixed_encodings, recon_directory)}

_DUCK_LINES = tables.duck(LINES)
ORACLES = {
    "csv_bad_rows": f"""SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'extra_fields' ELSE 'open_quote' END
  AS problem, CASE WHEN o_orderkey % 7 = 0 THEN 4 ELSE 2 END AS n_fields, 3 AS n_cols,
  value AS line
FROM ({_DUCK_LINES}) WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0""",
    "csv_quoted": f"""SELECT {_KEY} AS id,
  CASE WHEN o_orderkey % 5 = 0 THEN '1,' ELSE '' END || {_PRICE} AS amt,
  CASE WHEN o_orderkey % 5 = 0 THEN 'say "' || o_orderpriority || '", C:' || chr(92)
       WHEN o_orderkey % 3 = 0 THEN NULL ELSE '5" ' || o_orderpriority END AS note
FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0""",
    "csv_mixed_headers": " UNION ALL ".join(
        f"SELECT {i} AS position, {len(columns)} AS n_cols, '{col}' AS col,"
        f" nullif({sql}, '') AS val FROM orders"
        for columns in SWAPPED.values() for i, (col, sql) in enumerate(columns)),
    "csv_mixed_encodings": f"SELECT id, note FROM ({tables.duck(ACCENTED)})",
    "recon_directory": over_sides("").rstrip() + """,
our_first AS (SELECT id, ordinal FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS rn FROM ours
  WHERE id IS NOT NULL) WHERE rn = 1)
SELECT r.id AS bank_trx_id, r.status, r.our_amount, r.bank_amount,
  (SELECT bank FROM target) AS paying_bank_name, CAST(o.ordinal AS VARCHAR) AS our_row,
  CASE WHEN o.id IS NOT NULL THEN 'café' END AS our_note
FROM recon r LEFT JOIN our_first o ON o.id = r.id""",
}
