from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import keywords as kw
from ledgerloom.operators import stored
from ledgerloom.plans import reconcile as rc
from ledgerloom.sources import files
from ledgerloom.sources import keyword_files as kf
from ledgerloom.sources.store import Store, dump

OUR = """Bank Trx ID,Paid Amt,Customer Name,Paying Bank Name
TBPM001,1000.00,Customer A,Test Bank
TBPM002,1500.50,Customer B,Test Bank
TBPM003,2000.00,Customer C,Test Bank
TBPM004,2500.75,Customer D,Test Bank
ZZZ9,1.00,Customer E,Other Bank
"""
BANK = """Transaction_ID,Credit,Description
TBPM001,1000.00,Payment A
TBPM002,1500.60,Payment B
TBPM003,2000.00,Payment C
TBPM005,3000.00,Payment E
"""


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.fixture(scope="module")
def job(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("job")
    store = Store(spark, str(d / "store"))
    run = rc.reconcile_files(
        spark, write(d / "our.csv", OUR), write(d / "bank.csv", BANK), store,
        job_name="first", keywords=kw.seed_keywords(spark),
    )
    return store, run, d


def test_job_row(job):
    _, run, _ = job
    row = run.job.first()
    assert (run.roles.our_trx_score, run.roles.bank_trx_score) == (525.0, 65.0)
    assert (run.roles.our_amount_score, run.roles.bank_amount_score) == (494.0, 255.0)
    assert row.bank_name == "Test Bank" and row.amount_comparison_performed
    assert (row.total_our_records, row.total_bank_records, row.matched_records) == (4, 4, 3)
    assert (row.unmatched_our_records, row.unmatched_bank_records) == (1, 1)
    assert float(row.our_total_amount) == 7001.25 and float(row.bank_total_amount) == 7500.60
    assert float(row.total_difference_matched) == -0.10 and row.amounts_match is False
    assert [r.bank_trx_id for r in run.discrepancies.collect()] == ["TBPM002"]
    assert {r.bank: r.n_ids for r in run.bank_matches.collect()} == {"Test Bank": 3}


def test_report_text(job):
    store, run, _ = job
    lines = [r.text for r in run.report.orderBy("line_no").collect()]
    assert lines[0] == "RECONCILIATION REPORT - Test Bank"
    for text in ("- Match percentage: 75.00%", "- Difference: -0.10", "- Amounts match: ❌ NO",
                 "1. Transaction ID: TBPM002", "   Difference: -0.10 (-0.0%)",
                 "Bank Trx ID: TBPM004", "Bank Trx ID: TBPM005"):
        assert text in lines
    again = rc.job_report(store, run.job_id)
    assert [r.text for r in again.orderBy("line_no").collect()] == lines
    with pytest.raises(rc.JobNotFound):
        rc.job_report(store, 77)


def test_stored_queries(job):
    store, run, _ = job
    jobs, results = store.jobs(), store.results()
    assert stored.job_table(jobs).first().match_percent == "75.0%"
    assert stored.recent_jobs(jobs).first().job_name == "first"
    assert stored.show_results(results).count() == stored.total_results(results).first().total == 5
    shown = stored.results_by_status(results, run.job_id, "matched", 2).collect()
    assert len(shown) == 2 and shown[0].total == 3
    assert {r.metric: r.percent for r in stored.statistics_table(jobs).collect()} == {
        "Total Our Records": "100%", "Total Bank Records": "100%", "Matched Records": "75.0%",
        "Missing in Bank": "25.0%", "Missing in Our File": "25.0%",
    }
    plan = results.where(F.col("job_id") == run.job_id)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(job_id" in plan


def test_export_of_a_stored_job(spark, job):
    store, run, d = job
    ours, bank = rc.export_job(store, run.job_id, str(d / "out"))
    read = lambda p, c: {
        r[c]: r[rc.STATUS_COLUMN] for r in spark.read.option("header", True).csv(p).collect()
    }
    assert read(ours, "Bank Trx ID") == {
        "TBPM001": "true", "TBPM002": "amt_diff", "TBPM003": "true", "TBPM004": "false",
    }
    assert read(bank, "Transaction_ID") == {
        "TBPM001": "true", "TBPM002": "amt_diff", "TBPM003": "true", "TBPM005": "false",
    }


def test_a_repeated_job_leaves_no_duplicates(spark, job):
    store, run, d = job
    rc.reconcile_files(spark, str(d / "our.csv"), str(d / "bank.csv"), store,
                       job_name="first", job_id=run.job_id, replace_job=True,
                       keywords=kw.seed_keywords(spark))
    assert store.results().where(F.col("job_id") == run.job_id).count() == 5
    assert store.jobs().where(F.col("job_id") == run.job_id).count() == 1
    assert store.next_job_id() == run.job_id + 1
    equal = write(d / "equal.csv", BANK.replace("1500.60", "1500.50"))
    rc.reconcile_files(spark, str(d / "our.csv"), equal, store,
                       job_name="first", job_id=run.job_id, replace_job=True,
                       keywords=kw.seed_keywords(spark))
    assert store.discrepancies().where(F.col("job_id") == run.job_id).count() == 0
    dump(store, str(d / "dump"))
    assert spark.read.parquet(str(d / "dump" / "results")).count() == store.results().count()


def test_no_column_and_no_match_are_typed_errors(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    ledger = files.load_file(spark, write(tmp_path / "o.csv", OUR))
    vague = files.load_file(spark, write(tmp_path / "v.csv", "A,B\nx,y\nx,y\n"))
    with pytest.raises(rc.ColumnNotFound) as e:
        rc.reconcile(ledger, vague, store, job_name="x")
    assert e.value.available_columns == ["A", "B"] and e.value.suggested == "A"
    other = files.load_file(spark, write(tmp_path / "b.csv", BANK.replace("TBPM", "QQ")))
    with pytest.raises(rc.NoMatchingIds):
        rc.reconcile(ledger, other, store, job_name="x")
    with pytest.raises(ValueError):
        files.load_file(spark, "x.pdf")


def test_comparison_is_skipped_without_confidence(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    roles = rc.Roles("Bank Trx ID", "Transaction_ID", "Paid Amt", "Description",
                     bank_amount_score=30.0)
    run = rc.reconcile(
        files.load_file(spark, write(tmp_path / "o.csv", OUR)),
        files.load_file(spark, write(tmp_path / "b.csv", BANK)), store, job_name="x", roles=roles,
    )
    row = run.job.first()
    assert row.amount_comparison_performed is False and row.amounts_match is False
    assert run.discrepancies.count() == 0
    assert run.results.where("our_amount is not null").count() == 0
    assert any("Not performed" in r.text for r in run.report.collect())
    assert any("bank: 30.0%, threshold" in r.text for r in run.report.collect())
    later = [r.text for r in rc.job_report(store, run.job_id).collect()]
    assert any("was not performed during" in text for text in later)


def test_analyze(spark, tmp_path):
    got = rc.analyze(
        files.load_file(spark, write(tmp_path / "o.csv", OUR)),
        files.load_file(spark, write(tmp_path / "b.csv", BANK)),
    )
    assert got["our_file"]["suggested_trx_column"] == "Bank Trx ID"
    assert got["bank_file"]["columns"] == ["Transaction_ID", "Credit", "Description"]
    assert [r[0] for r in got["bank_file"]["preview"].collect()] == ["TBPM001", "TBPM002", "TBPM003"]


def test_bounded_sections(spark):
    results = spark.range(120).select(
        F.lit(1).alias("job_id"), F.format_string("T%04d", "id").alias("bank_trx_id"),
        F.lit(None).cast("string").alias("bank_trx_id_display"),
        F.when(F.col("id") < 55, "missing_in_bank").otherwise("matched").alias("status"),
        F.lit("B").alias("paying_bank_name"), F.lit(0).cast("decimal(18,2)").alias("amount"),
        F.lit(1).cast("decimal(18,2)").alias("our_amount"),
        F.lit(2).cast("decimal(18,2)").alias("bank_amount"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )
    diffs = results.where("status = 'matched'").select(
        "job_id", "bank_trx_id", "our_amount", "bank_amount",
        (F.col("our_amount") - F.col("bank_amount")).alias("difference"),
        F.lit(-100.0).alias("percentage_diff"), "created_at",
    )
    got = stored.report_sections(results, diffs)
    sizes = {r.section: (r["count"], r.more) for r in got.groupBy("section", "more").count().collect()}
    assert sizes == {"discrepancies": (20, 45), "missing_in_bank": (10, 45)}
    detail = stored.detail_sections(results).where("status = 'missing_in_bank'")
    assert detail.count() == 50 and detail.first().more == 5 and detail.first().amount == "N/A"


def test_directory_of_mixed_files(spark, tmp_path):
    d = tmp_path / "in"
    write(d / "a.csv", "A,B,A\n1,x,2\n3,y,4\n")
    write(d / "sub" / "Credit دائن+1 %20[x].csv", "A,B,A\n5,é,6\n", "latin-1")
    write(d / "c.csv", "﻿P,,Q\n5,z,2\n")
    write(d / "notes.txt", "no")
    enc = {r.path.rsplit("/", 1)[-1]: r.encoding for r in files.encodings(spark, str(d)).collect()}
    assert enc == {"a.csv": "UTF-8", "Credit دائن+1 %20[x].csv": "ISO-8859-1", "c.csv": "UTF-8"}
    long = files.read_directory(spark, str(d))
    rows = {(files_name(r.file), r.col, r.val) for r in long.collect()}
    assert ("a.csv", "A.1", "4") in rows and ("c.csv", "Unnamed: 1", "z") in rows
    assert ("Credit دائن+1 %20[x].csv", "B", "é") in rows and len(rows) == 12
    with pytest.raises(FileNotFoundError):
        files.read_directory(spark, str(d), glob="*.tsv")


def files_name(path):
    return path.rsplit("/", 1)[-1]


def test_row_order_follows_the_file(spark, tmp_path):
    text = "n,pad\n" + "".join(f"{i},{'x' * 40}\n" for i in range(3000))
    path = write(tmp_path / "big.csv", text)
    write(tmp_path / "many" / "a.csv", "n,pad\n1,x\n2,x\n")
    write(tmp_path / "many" / "b.csv", "n,pad\n" + "".join(f"{i},x\n" for i in range(3, 9)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = files.read_csv(spark, path)
        assert df.rdd.getNumPartitions() > 3
        got = [int(r.n) for r in df.orderBy("ordinal").collect()]
        many = files.read_csv(spark, str(tmp_path / "many"))
        order = [int(r.n) for r in many.orderBy("ordinal").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(range(3000)) and order == list(range(1, 9))
    assert [r.n for r in files.preview(df).collect()] == ["0", "1", "2"]


def test_ids_stay_text(spark, tmp_path):
    df = files.load_file(spark, write(tmp_path / "x.csv", "id,amt\n5.45E+17,1\n007,2\n"))
    assert [r.id for r in df.orderBy("ordinal").collect()] == ["5.45E+17", "007"]


def test_column_policy(spark, tmp_path):
    text = "Paid Amt,Payment Ref,CustomerId,Fee,Note,Count\n\"1,500\",9,1,$2,a,3\n,8,2,3,b,4\n"
    df = files.load_file(spark, write(tmp_path / "p.csv", text))
    from ledgerloom.operators.profile import to_long

    names = [c for c in df.columns if c not in ("file", "ordinal")]
    long = to_long(df, names, file=F.lit("p"), order=F.col("ordinal"))
    policies = {r["col"]: r.policy for r in files.column_policy(long).collect()}
    assert policies == {
        "Paid Amt": "amount", "Payment Ref": "id", "CustomerId": "id", "Fee": "amount",
        "Note": "text", "Count": "numeric",
    }
    typed = files.apply_policy(df.orderBy("ordinal"), policies).collect()
    assert float(typed[0]["Paid Amt"]) == 1500 and typed[0]["Payment Ref"] == "9"
    assert typed[1]["Paid Amt"] is None and typed[1]["Count"] == 4.0


def test_keyword_files(spark, tmp_path):
    text = "# head\n\nNet Pay , our\nfee,bank,ar,70,YES,a fee\nx,both,en,high\nlonely\n"
    good, bad = kf.read_keywords(spark, write(tmp_path / "k.txt", text))
    assert [tuple(r) for r in good.collect()] == [
        ("Net Pay", "our", "en", 50, False, ""), ("fee", "bank", "ar", 70, True, "a fee"),
    ]
    assert [r.value for r in bad.collect()] == ["x,both,en,high"]
    out = str(tmp_path / "out")
    kf.write_keywords(kw.seed_keywords(spark).where("is_active"), out)
    again, rejected = kf.read_keywords(spark, out)
    assert again.count() == 30 and rejected.count() == 0
    lines = [line for f in sorted(os.listdir(out)) if f.startswith("part") for line in open(f"{out}/{f}")]
    assert sum(line.startswith("#") for line in lines) == 3


def test_sample_of_leading_rows_equals_that_of_all(spark, tmp_path):
    from ledgerloom.operators.profile import column_profile, to_long
    from ledgerloom.plans.reconcile import data_columns, sampled

    text = "n,late,none,rare\n" + "".join(
        f"{i},{i if i > 2000 else ''},,{i if i % 90 == 0 else ''}\n" for i in range(3000))
    write(tmp_path / "many" / "a.csv", text)
    write(tmp_path / "many" / "b.csv", text)
    one = files.load_file(spark, str(tmp_path / "many" / "a.csv"))
    many = files.load_file(spark, str(tmp_path / "many"), fmt="csv")
    short = files.load_file(spark, write(tmp_path / "s.csv", "a,b\n1,\n2,x\n"))
    empty = files.load_file(spark, write(tmp_path / "e.csv", "a,b\n"))
    own = one.where("n < 0 or n >= 5")  # row numbers do not start from 0
    for df in (one, many, short, empty, own):
        full = to_long(df, data_columns(df), file=F.lit("f"), order=F.col("ordinal"))
        got, want = (column_profile(x) for x in (sampled(df, "f"), full))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # Columns that the leading rows fill are not read through; a file read whole is not again.
    plan = sampled(one, "f")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<late:string,none:string,rare:string>" in plan
    assert "FileScan" not in sampled(short, "f")._jdf.queryExecution().executedPlan().toString()


# --- commits ---

def small(spark, rows):
    schema = ("id long, bank_trx_id string, our_amount double, bank_amount double, "
              "difference double, percentage_diff double, created_at timestamp_ntz")
    return spark.createDataFrame([(i, t, 1.0, 2.0, 1.0, 1.0, None) for i, t in rows], schema)


def staged(store, rows, **options):
    attempt = store.begin(**options)
    attempt.write("discrepancies", small(store.spark, rows))
    return attempt


def seen(store):
    return sorted((r["job_id"], r["bank_trx_id"]) for r in store.discrepancies().collect())


def test_jobs_that_start_together_keep_apart(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    assert seen(one) == [] and one.next_job_id() == 1
    a, b = one.begin(), two.begin()
    assert (a.job_id, b.job_id) == (1, 2)
    for attempt, text in ((b, "B"), (a, "A")):
        attempt.write("discrepancies", small(spark, [(1, text)]))
    assert seen(one) == []                     # nothing is finished
    b.commit()
    before = two.discrepancies()
    assert seen(one) == [(2, "B")]
    a.commit()
    assert seen(two) == [(1, "A"), (2, "B")] and before.count() == 1
    assert two.next_job_id() == 3


def test_numbers_taken_by_many_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = Store(spark, str(tmp_path / "s"))
    with ThreadPoolExecutor(8) as pool:
        ids = [a.job_id for a in pool.map(lambda _: store.begin(), range(16))]
    assert sorted(ids) == list(range(1, 17))


def test_a_finished_job_is_replaced_only_if_asked(spark, tmp_path):
    from ledgerloom.sources.store import JobExists

    store = Store(spark, str(tmp_path / "s"))
    staged(store, [(1, "old")], job_id=7).commit()
    with pytest.raises(JobExists):
        store.begin(7)
    failed = staged(store, [(1, "lost")], job_id=7, replace=True)   # never committed
    assert seen(store) == [(7, "old")]
    new = staged(store, [(1, "new"), (2, "more")], job_id=7, replace=True)
    new.commit()
    assert seen(store) == [(7, "more"), (7, "new")]
    with pytest.raises(JobExists):
        failed.commit()                        # another attempt was first
    assert seen(store) == [(7, "more"), (7, "new")] and store.next_job_id() == 8
    first, second = store.begin(9), store.begin(9)
    second.write("discrepancies", small(spark, [(1, "second")]))
    second.commit()
    with pytest.raises(JobExists):
        first.commit()
    assert seen(store)[-1] == (9, "second")


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    from types import SimpleNamespace as Fake

    from ledgerloom.sources.store import checkpoint_dir

    def session(master):
        made = []
        context = Fake(getCheckpointDir=lambda: None, setCheckpointDir=made.append, master=master)
        return Fake(sparkContext=context, conf=Fake(get=lambda k, d: d)), made

    for master in ("local-cluster[3,2,1024]", "spark://h:7077", "yarn"):
        with pytest.raises(RuntimeError):
            checkpoint_dir(session(master)[0])
    for master in ("local", "local[8]", "local[*]"):
        spark, made = session(master)
        assert made == [checkpoint_dir(spark)]


def test_files_are_parsed_once(spark, tmp_path):
    ours = write(tmp_path / "our.csv", OUR)
    bank = write(tmp_path / "bank.csv", BANK)
    run = rc.reconcile_files(spark, ours, bank, Store(spark, str(tmp_path / "store")), job_name="j",
                             roles=rc.Roles("Bank Trx ID", "Transaction_ID", "Paid Amt", "Credit"),
                             target_bank="Test Bank")
    plan = run.bank_matches._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "csv" not in plan
    assert {r.bank: r.n_ids for r in run.bank_matches.collect()} == {"Test Bank": 3}


def test_paths_are_decoded_once_a_file(spark, tmp_path):
    write(tmp_path / "a +%20é.csv", "n\n1\n2\n")
    found = files.file_headers(spark, str(tmp_path)).first()
    assert found.path.endswith("/a +%20é.csv") and found.encoded != found.path
    rows = files.CsvFiles.open(spark, str(tmp_path)).rows().collect()
    assert [(r.file, r.vals) for r in rows] == [(found.path, ["1"]), (found.path, ["2"])]
