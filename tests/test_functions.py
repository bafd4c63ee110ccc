from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom import functions as fn
from ledgerloom.functions.money import is_number

def apply(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("c")).alias("x")).collect()]


def test_null_tokens(spark):
    values = [None, "", "  ", "NaN", " none ", "NULL", "0", "nil"]
    assert apply(spark, values, fn.is_null_token) == [True] * 6 + [False] * 2


@pytest.mark.parametrize(
    "text, expanded",
    [
        ("5.45E+17", "545000000000000000"),
        ("2.5022816E+16", "25022816000000000"),
        ("5e+3", "5000"),
        ("1.23456e+2", "123456"),  # more digits than the exponent asks for are kept
        ("ABCDE+12", "ABCDE+12"),  # not a number
        ("-5.45E+17", "-5.45E+17"),
        ("5.45E-17", "5.45E-17"),
        ("1E+1000", "1E+1000"),  # exponents end at three digits
        (" TBPM25160112163910187\t", "TBPM25160112163910187"),
        ("BMC-2025-001234", "BMC-2025-001234"),
        ("Pay/2025/001/456789", "Pay/2025/001/456789"),
        ("1234567890123456789", "1234567890123456789"),
        ("0012", "0012"),
        (" null ", None),
    ],
)
def test_normal_id(spark, text, expanded):
    assert apply(spark, [text], fn.normal_id) == [expanded]


def test_precision_lost_and_display(spark):
    values = ["5.45E+17", "1.23E+2", "TB1"]
    assert apply(spark, values, fn.precision_lost) == [True, False, False]
    shown = apply(spark, values, lambda c: fn.display_id(c, fn.normal_id(c)))
    assert shown == ["5.45E+17 | 545000000000000000", "1.23E+2 | 123", "TB1"]


AMOUNTS = ["1,500.00", "$2,500.50", "3000", "4.5e3", "5000.75", "invalid", "", "6,789.99"]


def test_amount_texts(spark):
    got = apply(spark, AMOUNTS, fn.parse_amount)
    assert [None if v is None else float(v) for v in got] == [
        1500, 2500.5, 3000, 4500, 5000.75, None, None, 6789.99,
    ]
    zeros = apply(spark, AMOUNTS, fn.amount_or_zero)
    assert zeros[5] == zeros[6] == 0


def test_amount_edges(spark):
    values = ["€ 12.5", "£1", "-3", "+4", ".5", "5.", "1,5e3", "1d", "nan", "Infinity", " $ 7 "]
    got = apply(spark, values, fn.parse_amount)
    assert [None if v is None else float(v) for v in got] == [
        12.5, 1, -3, 4, 0.5, 5, None, None, None, None, 7,
    ]
    assert apply(spark, ["1d", "nan", "Infinity", "1e5", ".", "-"], is_number) == [
        False, False, False, True, False, False,
    ]


def test_strict_and_legacy_amounts(spark):
    values = ["1,500", "$2", " 3.5 ", "1e2", "-4", "1.2.3", "5-6", None, "--"]
    strict = apply(spark, values, fn.strict_amount)
    assert [None if v is None else float(v) for v in strict] == [
        None, None, 3.5, 100, -4, None, None, None, None,
    ]
    legacy = apply(spark, values, fn.legacy_amount)
    assert [float(v) for v in legacy] == [0, 0, 0, 0, -4, 0, 0, 0, 0]


def test_headers(spark):
    assert apply(spark, ["  Bank_Trx-ID "], fn.clean_header) == ["banktrxid"]


def test_formats(spark):
    df = spark.createDataFrame([(Decimal("1234.50"),)], "d decimal(18,2)")
    row = df.select(
        fn.number_text(F.col("d")),
        fn.percent_text(F.lit(12.34)),
        fn.percent_text(F.lit(-0.5)),
        fn.percent_text(F.lit(75.0), signed=False),
        fn.timestamp_text(F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")),
    ).first()
    assert tuple(row) == ("1,234.50", "+12.3%", "-0.5%", "75.0%", "2024-01-01 10:00:00")


def test_records_keep_nulls_and_odd_names(spark):
    df = spark.createDataFrame([("5.45E+17", None)], "`Bank Trx.ID` string, `Credit دائن` string")
    out = df.select(fn.record_json(df.columns).alias("j"))
    assert out.first()[0] == '{"Bank Trx.ID":"5.45E+17","Credit دائن":null}'
    back = fn.records_to_columns(out, "j", df.columns)
    assert back.columns == df.columns and tuple(back.first()) == ("5.45E+17", None)


def test_bank_names(spark):
    values = ["HSBC London", "processing", "ING", "my bofa card", "Chase", "First National", "x"]
    assert apply(spark, values, fn.bank_of) == [
        "HSBC", None, "ING Bank", "Bank of America", "JPMorgan Chase", "National Bank", None,
    ]
