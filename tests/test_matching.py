from __future__ import annotations

from decimal import Decimal as D

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions.money import Money
from ledgerloom.operators import comparison as cmp
from ledgerloom.operators import matching as m
from ledgerloom.operators.skew import first_per_group, heavy_keys

MONEY = Money(18, 2)
LEDGER = "row_id bigint, trx string, amt string, bank string"
STATEMENT = "row_id bigint, trx string, amt string"


def ours(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], LEDGER)
    return m.side(df, "trx", "amt", "row_id", bank_col="bank", money=MONEY)


def bank(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], STATEMENT)
    return m.side(df, "trx", "amt", "row_id", money=MONEY)


def by_id(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture
def example(spark):
    rows = [("T001", "1000.00"), ("T002", "1500.50"), ("T003", "2000.00"), ("T004", "2500.75")]
    other = [("T001", "1000.00"), ("T002", "1500.60"), ("T003", "2000.00"), ("T005", "3000.00")]
    return ours(spark, [(*r, "Test Bank") for r in rows]), bank(spark, other)


def test_full_run(example):
    reconciled = m.reconcile_ids(*example)
    row = cmp.run_summary(reconciled).first()
    assert (row.matched_records, row.missing_in_bank_count, row.missing_in_our_file_count) == (3, 1, 1)
    assert row.match_percentage == 75.0
    assert (row.our_total, row.bank_total) == (D("7001.25"), D("7500.60"))
    assert (row.matched_total_our, row.matched_total_bank) == (D("4500.50"), D("4500.60"))
    assert row.total_difference_matched == D("-0.10") and not row.amounts_match
    assert row.total_difference_all == D("-499.35")
    assert row.total_discrepancies == 1
    found = cmp.discrepancies(m.matched_pairs(*example)).collect()
    assert [(r.id, r.difference) for r in found] == [("T002", D("-0.10"))]
    assert found[0].percentage_diff == pytest.approx(-0.1 / 1500.5 * 100)


def test_separate_operators_agree_with_the_full_join(example):
    status = by_id(m.reconcile_ids(*example), "status")
    parts = {
        m.MATCHED: m.matched_pairs(*example),
        m.MISSING_IN_BANK: m.missing_in_bank(*example),
        m.MISSING_IN_OURS: m.missing_in_ours(*example),
    }
    for name, df in parts.items():
        assert {r.id for r in df.collect()} == {k for k, v in status.items() if v == (name,)}


def test_expanded_ids_match_and_keep_amounts(spark):
    o = ours(spark, [("545000000000000000", "10", "A"), (" null ", "1", "A"), (None, "2", "A")])
    b = bank(spark, [("5.45E+17", "10.02"), ("nan", "5"), (None, "6")])
    assert by_id(m.reconcile_ids(o, b), "status", "our_amount", "bank_amount") == {
        "545000000000000000": (m.MATCHED, D("10.00"), D("10.02"))
    }
    assert tuple(m.null_id_rows(o, b).first()) == (2, 2)
    shown = m.ids_with_display(b).collect()
    assert [(r.original, r.display) for r in shown] == [
        ("5.45E+17", "5.45E+17 | 545000000000000000")
    ]


def test_first_row_gives_record_and_bank_last_row_the_amount(spark):
    rows = [(0, "X", "1", "A"), (1, "X", "2", "B"), (2, "X", "bad", "A")]
    df = spark.createDataFrame(rows, LEDGER).repartition(3)
    o = m.side(df, "trx", "amt", "row_id", bank_col="bank", record_cols=df.columns, money=MONEY)
    b = bank(spark, [("X", "2")]).withColumn("record", F.lit("{}"))
    row = m.reconcile_ids(o, b, with_records=True).first()
    assert '"row_id":"0"' in row.our_record
    assert (row.our_amount, row.our_rows) == (D("0.00"), 3)  # the last row is no amount: 0
    assert by_id(m.attribute(o, b), "bank") == {"X": ("A",)}
    assert m.last_amounts(o).first().amount is None


@pytest.mark.parametrize(
    "diff, discrepancy, match, status",
    [("0.00", False, True, "true"), ("0.01", False, False, "true"), ("0.02", True, False, "amt_diff")],
)
def test_one_cent_boundary(spark, diff, discrepancy, match, status):
    o = ours(spark, [("X", "10.00", "A")])
    b = bank(spark, [("X", str(D("10.00") + D(diff)))])
    reconciled = m.reconcile_ids(o, b)
    assert (cmp.discrepancies(reconciled).count() == 1) is discrepancy
    assert cmp.result_amounts(reconciled).first().amount_match is match
    assert cmp.row_status(o, b).first().status == status


def test_percentage_guards_small_amounts(spark):
    o = ours(spark, [("X", "", "A"), ("Y", "-5", "A")])
    b = bank(spark, [("X", "1"), ("Y", "5")])
    got = by_id(cmp.discrepancies(m.matched_pairs(o, b)), "percentage_diff")
    assert got == {"X": (pytest.approx(-10000),), "Y": (pytest.approx(-100000),)}


def test_row_status_keeps_duplicates_and_blank_amounts(spark):
    o = ours(spark, [("X", "1", "A"), ("X", "2", "A"), ("Y", "", "A"), ("Z", "1", "A"), (None, "1", "A")])
    b = bank(spark, [("X", "9"), ("X", "2"), ("Y", "7")])
    got = cmp.row_status(o, b).orderBy("ordinal").collect()
    assert [r.status for r in got] == ["amt_diff", "true", "true", "false", "false"]
    counts = {(r.side, r.status): r.n for r in cmp.status_counts(o, b).collect()}
    assert counts == {
        ("our", "amt_diff"): 1, ("our", "true"): 2, ("our", "false"): 2,
        ("bank", "amt_diff"): 1, ("bank", "true"): 2,
    }


def test_strict_amounts_turn_formatted_text_into_true(spark):
    df = spark.createDataFrame([(0, "X", "$5", "A")], LEDGER)
    b = bank(spark, [("X", "9")])
    status = lambda strict: cmp.row_status(
        m.side(df, "trx", "amt", "row_id", money=MONEY, strict=strict), b
    ).first().status
    assert (status(False), status(True)) == ("amt_diff", "true")


def test_target_bank_ties_go_to_the_first_name(spark):
    o = ours(spark, [("1", "1", "B"), ("2", "1", "A"), ("3", "1", "C")])
    b = bank(spark, [("1", "1"), ("2", "1")])
    assert tuple(m.target_bank(m.attribute(o, b)).first()) == ("A", 1)
    assert {r.id for r in m.of_bank(o, "A").collect()} == {"2"}


def test_all_banks_at_once(spark):
    o = ours(spark, [("1", "1", "A"), ("2", "2", "B"), ("3", "3", "B"), ("1", "9", "B")])
    b = bank(spark, [("1", "1"), ("2", "2"), ("9", "9")])
    got = {(r.bank, r.id): r.status for r in m.reconcile_all_banks(o, b).collect()}
    assert got == {
        ("A", "1"): m.MATCHED, ("B", "1"): m.MISSING_IN_BANK, ("B", "2"): m.MATCHED,
        ("B", "3"): m.MISSING_IN_BANK, (None, "9"): m.MISSING_IN_OURS,
    }


def test_comparison_gate():
    assert cmp.comparison_gate(31, 31) == (True, None)
    done, why = cmp.comparison_gate(30, 494)
    assert not done and "our: 30.0%" in why


IDS = st.one_of(st.none(), st.sampled_from(["", "nan", "A1", "A2", "A3", "5E+3", "5000", "7.1E+2"]))
AMOUNTS = st.sampled_from(["1", "1.01", "1.02", "", "x", "$2", "1,000"])
ROWS = st.lists(st.tuples(IDS, AMOUNTS), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=ROWS, right=ROWS)
def test_counts_add_up(spark, left, right):
    o, b = ours(spark, [(*r, "A") for r in left]), bank(spark, right)
    row = cmp.run_summary(m.reconcile_ids(o, b)).first()
    assert row.matched_records + row.missing_in_bank_count == m.distinct_ids(o).count()
    assert row.matched_records + row.missing_in_our_file_count == m.distinct_ids(b).count()
    itself = cmp.run_summary(m.reconcile_ids(o, o.drop("bank"))).first()
    assert itself.total_discrepancies == 0
    assert itself.matched_records == itself.total_our_records


def hot_sides(spark, n=4000):
    """A third of the rows share one ID, a third have none."""
    base = spark.range(n).withColumn("k", F.col("id") % 3)
    trx = F.when(F.col("k") == 0, "HOT").when(F.col("k") == 1, F.lit(None)).otherwise(
        F.concat(F.lit("T"), F.col("id").cast("string"))
    )
    rows = base.select(
        F.col("id").alias("row_id"), trx.cast("string").alias("trx"),
        (F.col("id") % 5).cast("string").alias("amt"), F.lit("A").alias("bank"),
    )
    o = m.side(rows, "trx", "amt", "row_id", bank_col="bank", money=MONEY)
    b = m.side(rows.where("row_id % 2 = 0"), "trx", "amt", "row_id", money=MONEY)
    return o, b


def test_heavy_keys_are_found_and_spreading_changes_nothing(spark):
    o, b = hot_sides(spark)
    assert [r.id for r in heavy_keys(o, "id", min_rows=100).collect()] == ["HOT"]
    assert heavy_keys(o, "id").count() == 0  # few rows are never worth spreading
    plain = cmp.row_status(o, b)
    spread = cmp.row_status(o, b, min_rows=100)
    assert plain.exceptAll(spread).count() == spread.exceptAll(plain).count() == 0
    assert spread.count() == o.count()
    counted = lambda df: sorted(map(tuple, df.collect()))
    assert counted(cmp.status_counts(o, b)) == counted(cmp.status_counts(o, b, min_rows=100))


def test_join_spreads_the_hot_and_null_rows(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        o, b = hot_sides(spark)
        out = cmp.row_status(o, b, min_rows=100).withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(sizes) < 2 * 4000 / len(sizes)


def test_result_does_not_depend_on_partitioning(spark):
    o, b = hot_sides(spark, 900)
    want = sorted(map(tuple, m.reconcile_ids(o, b).collect()), key=str)
    moved = m.reconcile_ids(o.repartition(7, "amount"), b.repartition(3))
    assert sorted(map(tuple, moved.collect()), key=str) == want


def test_first_per_group(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id").repartition(5)
    got = first_per_group(df, ["g"], [F.col("id")], 3).orderBy("g", "rank").collect()
    assert [(r.g, r.id, r["rank"]) for r in got] == [
        (0, 0, 1), (0, 2, 2), (0, 4, 3), (1, 1, 1), (1, 3, 2), (1, 5, 3),
    ]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_full_join_shuffles_each_side_once(spark, example):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(m.reconcile_ids(*example))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2
    assert "SortAggregate" not in text


def without_broadcasts(spark, make):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan(make())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_records_are_fetched_after_hash_aggregates(spark, tmp_path):
    from ledgerloom.sources import files

    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(f"id,amt,bank\nA{k},1,X\nA0,{k},X\n")
    df = files.load_file(spark, str(tmp_path), fmt="csv")
    s = m.side(df, "id", "amt", "ordinal", bank_col="bank", record_cols=["id", "amt"], money=MONEY)
    text = without_broadcasts(spark, lambda: m.reconcile_ids(s, s, with_records=True))
    assert "SortAggregate" not in text and "HashAggregate" in text
    # Each side by ID: its aggregate and its records, which meet without another shuffle.
    assert text.count("Exchange hashpartitioning") <= 6
    rows = {r["id"]: r for r in m.reconcile_ids(s, s, with_records=True).collect()}
    assert set(rows) == {"A0", "A1", "A2"} and rows["A0"]["our_rows"] == 4
    assert (str(rows["A0"]["our_amount"]), rows["A0"]["bank_record"]) == (
        "2.0000" if rows["A0"]["our_amount"].as_tuple().exponent == -4 else "2.00",
        '{"id":"A0","amt":"1"}')


def test_records_of_hot_ids_and_blank_banks(spark):
    o, b = hot_sides(spark, 600)
    banks = F.when(F.col("ordinal") % 2 == 0, "A")
    o = o.withColumn("record", F.concat(F.lit("r"), F.col("ordinal"))).withColumn("bank", banks)
    b = b.withColumn("record", F.concat(F.lit("b"), F.col("ordinal")))
    got = {r["id"]: r for r in m.reconcile_ids(o, b, with_records=True).collect()}
    assert got["HOT"]["our_record"] == "r0" and got["HOT"]["bank_record"] == "b0"
    assert got["HOT"]["our_rows"] == 200 and got["T5"]["our_record"] == "r5"
    assert got["T5"]["bank_record"] is None
    all_banks = m.reconcile_all_banks(o, b, with_records=True).collect()
    hot = {r["bank"]: r["our_record"] for r in all_banks if r["id"] == "HOT"}
    assert hot == {"A": "r0", None: "r3"}


def test_status_counts_shuffle_by_id_twice(spark):
    o, b = hot_sides(spark)
    text = without_broadcasts(spark, lambda: cmp.status_counts(o, b))
    assert "SortAggregate" not in text and text.count("Exchange hashpartitioning") <= 5
