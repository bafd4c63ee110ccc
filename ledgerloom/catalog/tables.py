"""Ledger and statement tables derived from the order data.

The given data holds no ledgers, so both sides are built from `orders` by SQL that
runs unchanged in Spark and DuckDB. The rules plant the cases that matter: null IDs,
scientific IDs, dirty amounts, duplicates, missing rows, differences of 0.01 and 5.00.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LEDGER = """
SELECT o_orderkey AS row_id,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 103 = 0 THEN ' null '
       WHEN o_orderkey % 13 = 0 THEN '1' || lpad(CAST(o_orderkey AS STRING),7,'0') || '0000000000'
       ELSE 'TBPM' || lpad(CAST(o_orderkey AS STRING),14,'0') END AS bank_trx_id,
  'Bank ' || CAST(o_custkey % 5 AS STRING) AS paying_bank_name,
  CASE WHEN o_orderkey % 23 = 0 THEN '' WHEN o_orderkey % 29 = 0 THEN 'N/A'
       WHEN o_orderkey % 17 = 0 THEN '$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)
       WHEN o_orderkey % 19 = 0 THEN '1,' || lpad(CAST(o_orderkey % 1000 AS STRING),3,'0') || '.50'
       ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS paid_amt
FROM {orders}
UNION ALL
SELECT o_orderkey + 1000000000, 'TBPM' || lpad(CAST(o_orderkey AS STRING),14,'0'),
  'Bank ' || CAST(o_custkey % 5 AS STRING),
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) + 1 AS STRING)
FROM {orders} WHERE o_orderkey % 50 = 3
"""

STATEMENT = """
SELECT o_orderkey AS row_id,
  CASE WHEN o_orderkey % 13 = 0 THEN '1.' || lpad(CAST(o_orderkey AS STRING),7,'0') || 'E+17'
       ELSE 'TBPM' || lpad(CAST(o_orderkey AS STRING),14,'0') END AS transaction_id,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) +
       CASE WHEN o_orderkey % 11 = 0 THEN 5.00 WHEN o_orderkey % 7 = 0 THEN 0.01 ELSE 0.00 END
       AS STRING) AS credit
FROM {orders}
WHERE o_orderkey % 10 <> 0 AND (o_custkey % 5 = 1 OR (o_custkey % 5 = 2 AND o_orderkey % 4 = 0))
UNION ALL
SELECT o_orderkey + 2000000000, 'XTRA' || lpad(CAST(o_orderkey AS STRING),14,'0'), '10.00'
FROM {orders} WHERE o_orderkey % 37 = 0
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LEDGER, orders=read(spark, sf_dir, "orders"))


def statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STATEMENT, orders=read(spark, sf_dir, "orders"))


# Text of one order row as the files of three layouts carry it: header and SQL text.
_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"
_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_TRX = (
    "CASE WHEN o_orderkey % 101 = 0 THEN NULL"
    " WHEN o_orderkey % 13 = 0 THEN '1' || lpad(CAST(o_orderkey AS STRING),7,'0') || '0000000000'"
    " ELSE 'TBPM' || lpad(CAST(o_orderkey AS STRING),14,'0') END"
)
_DIRTY = (
    "CASE WHEN o_orderkey % 23 = 0 THEN '' WHEN o_orderkey % 29 = 0 THEN 'N/A'"
    f" WHEN o_orderkey % 17 = 0 THEN '$' || {_PRICE}"
    " WHEN o_orderkey % 19 = 0 THEN '1,' || lpad(CAST(o_orderkey % 1000 AS STRING),3,'0') || '.50'"
    f" ELSE {_PRICE} END"
)

LAYOUTS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "ours": (
        "'ours_' || CAST(o_custkey % 5 AS STRING) || '.csv'",
        [
            ("No", "CAST(o_orderkey AS STRING)"),
            ("Biller Name", "'Biller ' || CAST(o_custkey % 11 AS STRING)"),
            ("Paying Bank Name", "'Bank ' || CAST(o_custkey % 5 AS STRING)"),
            ("Settlement Bank Name", "'Bank ' || CAST(o_custkey % 3 AS STRING)"),
            ("Service Name", "o_orderpriority"),
            ("Billing No", "CAST(o_custkey * 100000 + o_orderkey AS STRING)"),
            ("Payment Type", "CASE WHEN o_orderkey % 2 = 0 THEN 'Prepaid' ELSE 'Postpaid' END"),
            ("Payment Status", "o_orderstatus"),
            ("JOEBPPSTrx", "'JB' || lpad(CAST(o_custkey AS STRING),10,'0')"),
            ("Bank Trx ID", _TRX),
            ("Corridor", "CAST(NULL AS STRING)"),
            ("Access Channel", "CASE WHEN o_orderkey % 3 = 0 THEN 'ATM' ELSE 'Web' END"),
            ("Procces Date", _DAY),
            ("Settlement Date", _DAY),
            ("Due Amt", _PRICE),
            ("Paid Amt", _DIRTY),
        ],
    ),
    "bank_plain": (
        "'plain_' || CAST(o_custkey % 3 AS STRING) || '.csv'",
        [
            ("Transaction_ID", _TRX),
            ("Credit", _PRICE),
            ("Description", "'Payment (' || o_orderpriority || ')'"),
        ],
    ),
    "bank_tagged": (
        "'tagged_' || CAST(o_custkey % 2 AS STRING) || '.csv'",
        [
            ("Transaction Date", _DAY),
            ("Narration", "o_orderpriority || ' / ' || o_orderstatus"),
            ("Reference", "'Ref' || lpad(CAST(o_orderkey AS STRING),10,'0')"),
            ("Amount Tag", "CASE WHEN o_orderkey % 3 = 0 THEN 'DR' ELSE 'CR' END"),
            ("Value Date", _DAY),
            ("Debit", f"CASE WHEN o_orderkey % 3 = 0 THEN '-' || {_PRICE} END"),
            ("Credit دائن", f"CASE WHEN o_orderkey % 3 <> 0 THEN {_DIRTY} END"),
            ("Balance", "CAST(CAST(o_totalprice * 3 AS DECIMAL(18,2)) AS STRING)"),
        ],
    ),
}


def wide(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """One layout as a table of text columns with `file` and `ordinal`."""
    file, columns = LAYOUTS[layout]
    picked = ", ".join(f"{sql} AS `{name}`" for name, sql in columns)
    return spark.sql(
        f"SELECT {file} AS file, o_orderkey AS ordinal, {picked} FROM {{orders}}",
        orders=read(spark, sf_dir, "orders"),
    )


def duck(sql: str) -> str:
    """The same SQL over the tables' plain names."""
    return sql.replace("{orders}", "orders")


def long_sql() -> str:
    """All layouts in long form, as SQL."""
    parts = []
    for file, columns in LAYOUTS.values():
        for position, (name, sql) in enumerate(columns):
            parts.append(
                f"SELECT {file} AS file, o_orderkey AS ordinal, {position} AS position,"
                f" {len(columns)} AS n_cols, '{name}' AS col, {sql} AS val FROM orders"
            )
    return "\nUNION ALL\n".join(parts)
