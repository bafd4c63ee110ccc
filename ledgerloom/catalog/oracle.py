"""SQL fragments shared by the oracle queries."""

from __future__ import annotations

from .tables import LEDGER, STATEMENT, duck, long_sql

AMOUNT = "DECIMAL(18,2)"
_SCI = "^[0-9]+([.][0-9]+)?[eE][+][0-9]{1,3}$"


def null_token(x: str) -> str:
    return f"({x} IS NULL OR lower(trim({x})) IN ('','nan','none','null'))"


def normal_id(x: str) -> str:
    digits = f"replace(regexp_extract(trim({x}), '^([0-9.]+)[eE]', 1), '.', '')"
    exponent = f"CAST(regexp_extract(trim({x}), '[eE][+]([0-9]+)$', 1) AS INTEGER)"
    return (
        f"CASE WHEN {null_token(x)} THEN NULL"
        f" WHEN regexp_matches(trim({x}), '{_SCI}')"
        f" THEN rpad({digits}, greatest(CAST(length({digits}) AS INTEGER), {exponent} + 1), '0')"
        f" ELSE trim({x}) END"
    )


def parse_amount(x: str) -> str:
    clean = f"trim(translate(trim({x}), ',$€£', ''))"
    return (
        f"CASE WHEN contains(lower({x}), 'e') THEN try_cast(trim({x}) AS {AMOUNT})"
        f" ELSE try_cast({clean} AS {AMOUNT}) END"
    )


SIDES = f"""
ledger AS ({duck(LEDGER)}),
statement AS ({duck(STATEMENT)}),
ours_all AS (
  SELECT {normal_id('bank_trx_id')} AS id, trim(bank_trx_id) AS original,
         {parse_amount('paid_amt')} AS amount, row_id AS ordinal, paying_bank_name AS bank
  FROM ledger),
bank AS (
  SELECT {normal_id('transaction_id')} AS id, trim(transaction_id) AS original,
         {parse_amount('credit')} AS amount, row_id AS ordinal
  FROM statement),
first_bank AS (
  SELECT id, bank FROM (
    SELECT id, bank, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS rn
    FROM ours_all WHERE id IS NOT NULL) WHERE rn = 1),
attributed AS (
  SELECT f.id, f.bank FROM first_bank f
  WHERE f.id IN (SELECT id FROM bank WHERE id IS NOT NULL)),
target AS (
  SELECT bank, count(*) AS n_ids FROM attributed GROUP BY bank ORDER BY n_ids DESC, bank LIMIT 1),
ours AS (SELECT o.* FROM ours_all o JOIN target t ON o.bank = t.bank),
our_last AS (
  SELECT id, coalesce(amount, 0) AS our_amount, amount AS raw_amount, n_rows FROM (
    SELECT id, amount, count(*) OVER (PARTITION BY id) AS n_rows,
           row_number() OVER (PARTITION BY id ORDER BY ordinal DESC) AS rn
    FROM ours WHERE id IS NOT NULL) WHERE rn = 1),
bank_last AS (
  SELECT id, coalesce(amount, 0) AS bank_amount, amount AS raw_amount, n_rows FROM (
    SELECT id, amount, count(*) OVER (PARTITION BY id) AS n_rows,
           row_number() OVER (PARTITION BY id ORDER BY ordinal DESC) AS rn
    FROM bank WHERE id IS NOT NULL) WHERE rn = 1),
recon AS (
  SELECT coalesce(o.id, b.id) AS id, o.our_amount, b.bank_amount,
         o.n_rows AS our_rows, b.n_rows AS bank_rows,
         CASE WHEN b.id IS NULL THEN 'missing_in_bank'
              WHEN o.id IS NULL THEN 'missing_in_our_file' ELSE 'matched' END AS status
  FROM our_last o FULL OUTER JOIN bank_last b ON o.id = b.id),
all_last AS (
  SELECT bank, id, coalesce(amount, 0) AS our_amount FROM (
    SELECT bank, id, amount,
           row_number() OVER (PARTITION BY bank, id ORDER BY ordinal DESC) AS rn
    FROM ours_all WHERE id IS NOT NULL) WHERE rn = 1),
recon_all AS (
  SELECT coalesce(o.bank, b.bank) AS bank, coalesce(o.id, b.id) AS id,
         o.our_amount, b.bank_amount,
         CASE WHEN b.id IS NULL THEN 'missing_in_bank'
              WHEN o.id IS NULL THEN 'missing_in_our_file' ELSE 'matched' END AS status
  FROM all_last o
  FULL OUTER JOIN (SELECT l.id, l.bank_amount, f.bank
                   FROM bank_last l LEFT JOIN first_bank f ON l.id = f.id) b
  ON o.id = b.id AND o.bank = b.bank)
"""


def over_sides(select: str) -> str:
    return f"WITH {SIDES}\n{select}"


LONG = f"long AS ({long_sql()})"


def over_long(ctes: str, select: str) -> str:
    return f"WITH {LONG}{ctes}\n{select}"
