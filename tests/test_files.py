"""CSV as real files have it, several files per side, blank banks and long keywords."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import keywords as kw
from ledgerloom.operators import matching as m
from ledgerloom.operators import roles as rl
from ledgerloom.sources import files as f


def put(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


def test_quotes_commas_and_backslashes(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'id,note,amt\nA,"He said ""hi, there""",5\nB,"C:\\dir\\",6\n')
    rows = {r["id"]: (r["note"], r["amt"]) for r in f.load_file(spark, path).collect()}
    assert rows == {"A": ('He said "hi, there"', "5"), "B": ("C:\\dir\\", "6")}


def test_line_breaks_in_quotes(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'id,note\nA,"two\nlines"\nB,x\n')
    rows = {r["id"]: r["note"] for r in f.load_file(spark, path, multiLine=True).collect()}
    assert rows == {"A": "two\nlines", "B": "x"}


def test_missing_texts_are_null(spark, tmp_path):
    path = put(tmp_path, "a.csv", "id,amt\nN/A,1\n#N/A,NA\nnone,2\n")
    assert [(r["id"], r["amt"]) for r in f.load_file(spark, path).orderBy("ordinal").collect()] \
        == [(None, "1"), (None, None), ("none", "2")]
    kept = f.load_file(spark, path, na=None).orderBy("ordinal").collect()
    assert [r["id"] for r in kept] == ["N/A", "#N/A", "none"]


def test_files_with_swapped_headers_are_refused(spark, tmp_path):
    put(tmp_path, "a.csv", "id,amt\nA,1\n")
    put(tmp_path, "b.csv", "amt,id\n2,B\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        f.load_file(spark, str(tmp_path), fmt="csv").collect()


def test_directories_globs_and_parquet(spark, tmp_path):
    put(tmp_path, "a.csv", "id,amt\nA,1\n")
    put(tmp_path, "b.csv", "id,amt\nB,2\n")
    for path, fmt in ((str(tmp_path), "csv"), (f"{tmp_path}/*.csv", None)):
        rows = f.load_file(spark, path, fmt=fmt)
        assert sorted((r["id"], r["amt"]) for r in rows.collect()) == [("A", "1"), ("B", "2")]
    rows.select("id", F.col("amt").cast("int").alias("amt")).write.parquet(f"{tmp_path}/t.parquet")
    table = f.load_file(spark, f"{tmp_path}/t.parquet")
    assert sorted((r["id"], r["amt"]) for r in table.collect()) == [("A", "1"), ("B", "2")]


def ledgers(spark):
    ours = spark.createDataFrame(
        [("1", "1", 5.0, 1, None), ("2", "2", 5.0, 2, None), ("3", "3", 7.0, 3, "X"),
         ("4", "4", 7.0, 4, None)],
        "id string, original string, amount double, ordinal long, bank string")
    bank = spark.createDataFrame(
        [("1", "1", 5.0, 1), ("2", "2", 6.0, 2), ("3", "3", 7.0, 3), ("9", "9", 1.0, 4)],
        "id string, original string, amount double, ordinal long")
    return ours, bank


def test_blank_banks_are_matched_but_never_chosen(spark):
    ours, bank = ledgers(spark)
    attributed = m.attribute(ours, bank)
    assert [r["bank"] for r in m.target_bank(attributed).collect()] == ["X"]
    assert {r["bank"]: r["n_ids"] for r in m.attribution_counts(attributed).collect()} \
        == {None: 2, "X": 1}
    got = {(r["bank"], r["id"], r["status"]) for r in m.reconcile_all_banks(ours, bank).collect()}
    assert got == {(None, "1", "matched"), (None, "2", "matched"), ("X", "3", "matched"),
                   (None, "4", "missing_in_bank"), (None, "9", "missing_in_our_file")}


def test_long_keywords_are_found(spark):
    word = "very long amount heading " * 6
    names = spark.createDataFrame([("f", 0, f"the {word.strip()} column")],
                                  "file string, position int, col string")
    table = kw.seed_keywords(spark).limit(1).withColumn("keyword", F.lit(word.strip()))
    assert len(word.strip()) > 100
    assert rl.keyword_matches(names, table).count() > 0


# --- bad rows, many headers, both encodings ---

BAD = ("id,amt,note\nA,1,x\nB,2,y,EXTRA\nC,3\nD,\"4,open\nE,\"5,0\",\"say \"\"hi, you\"\"\"\n\n"
       "F,6,5\" pipe\nG,7,,\n,,\nH,,,,,9\n")


def test_bad_rows_are_set_aside(spark, tmp_path):
    path = put(tmp_path, "a.csv", BAD)
    rows, bad = f.open_side(spark, path)
    assert [(r["id"], r["amt"], r["note"]) for r in rows.orderBy("ordinal").collect()] == [
        ("A", "1", "x"), ("C", "3", None), ("E", "5,0", 'say "hi, you"'), ("F", "6", '5" pipe'),
        (None, None, None)]
    assert [(r["problem"], r["n_fields"], r["n_cols"], r["line"].strip()) for r in
            bad.orderBy("ordinal").collect()] == [
        ("extra_fields", 4, 3, "B,2,y,EXTRA"), ("open_quote", 2, 3, 'D,"4,open'),
        ("extra_fields", 4, 3, "G,7,,"), ("extra_fields", 6, 3, "H,,,,,9")]
    assert bad.count() == 4 and rows.count() == 5
    with pytest.raises(Exception, match="Bad CSV row"):
        f.load_file(spark, path, bad="fail").collect()
    assert f.load_file(spark, path, bad="keep").count() == 9
    assert f.read_csv(spark, path).count() == 5
    with pytest.raises(ValueError):
        f.load_file(spark, path, bad="drop")


def test_good_files_are_read_without_checks(spark, tmp_path):
    files = f.CsvFiles.open(spark, put(tmp_path, "a.csv", 'id,amt\nA,"1,2"\nB\n'))
    assert not files.checks and files.rejected().count() == 0
    plan = files.table().select("amt")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<amt:string>" in plan


def test_bad_rows_over_several_lines(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'id,note\nA,"two\nlines, one"\nB,x,"EXTRA\nmore"\nC,z\n')
    rows, bad = f.open_side(spark, path, multiLine=True)
    assert {r["id"]: r["note"] for r in rows.collect()} == {"A": "two\nlines, one", "C": "z"}
    assert [(r["problem"], r["n_fields"]) for r in bad.collect()] == [("extra_fields", 3)]


@pytest.mark.parametrize("line,fields,opened", [
    ("", 1, False), ("a", 1, False), ("a,", 2, False), ('"a,b",c', 2, False),
    ('"a""b,",c', 2, False), ('"","",""', 3, False), ('""""', 1, False), ('a,"b,c', 2, True),
    ('5" pipe,6" rod', 2, False), ('a,b"c,d"', 3, False), (',"x', 2, True), ('"x', 1, True),
    ('"a,""b,""",c,"d,"', 3, False),
])
def test_fields_of_a_line(spark, line, fields, opened):
    row = spark.createDataFrame([(line,)], "v string").select(
        f.n_fields(F.col("v")).alias("n"), f.has_open_quote(F.col("v")).alias("o")).first()
    assert (row["n"], row["o"]) == (fields, opened)


def test_other_separators(spark, tmp_path):
    path = put(tmp_path, "a.csv", "id|a,b\nA|1,2\nB|3|4\n")
    rows, bad = f.open_side(spark, path, sep="|")
    assert [(r["id"], r["a,b"]) for r in rows.collect()] == [("A", "1,2")]
    assert [r["line"] for r in bad.collect()] == ["B|3|4"]


def test_a_directory_of_many_headers_is_two_scans(spark, tmp_path):
    want = set()
    for i in range(500):
        names = [f"c{i}_{j}" for j in range(1 + i % 5)]
        extra = ",EXTRA" if i == 77 else ""
        put(tmp_path, f"{i:03}.csv", ",".join(names) + "\n" + "\n".join(
            ",".join(f"{r}v{i}é{j}" for j in range(len(names))) for r in range(2))
            + f"\nlast{extra * len(names)}\n")
        want |= {(f"{i:03}.csv", j, len(names), n, f"{r}v{i}é{j}") for r in range(2)
                 for j, n in enumerate(names)}
        if i != 77:
            want.add((f"{i:03}.csv", 0, len(names), names[0], "last"))
    (tmp_path / "250.csv").write_bytes((tmp_path / "250.csv").read_bytes().decode().encode("latin-1"))
    files = f.CsvFiles.open(spark, str(tmp_path), "*.csv")
    long = files.cells()
    got = {
        (r["file"].rsplit("/", 1)[-1], r["position"], r["n_cols"], r["col"], r["val"])
        for r in long.where("val is not null").collect()}
    assert got == want
    assert [r["line"] for r in files.rejected().collect()] == ["last,EXTRA,EXTRA,EXTRA"]
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan
    # The headers alone list the columns: no cell is read.
    assert files.columns().count() == sum(1 + i % 5 for i in range(500))
    assert "FileScan" not in files.columns()._jdf.queryExecution().executedPlan().toString()


def test_header_scan_is_one_hash_aggregate(spark, tmp_path):
    put(tmp_path, "a.csv", "\n\ufeffid,amt\nA,1\n")
    found = f.file_headers(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ObjectHashAggregate" in plan and "Sort" not in plan
    row = found.first()
    assert (row["header"], row["n_lines"], row["most_fields"], row["n_open"]) == ("id,amt", 3, 2, 0)


def test_files_of_both_encodings_make_one_table(spark, tmp_path):
    put(tmp_path, "a.csv", "id,né\nA,ü\n")
    (tmp_path / "b.csv").write_bytes("id,né\nB,ö,\xa3\nC,ß\n".encode("latin-1"))
    rows, bad = f.open_side(spark, str(tmp_path))
    assert sorted((r["id"], r["né"]) for r in rows.collect()) == [("A", "ü"), ("C", "ß")]
    assert [r["line"] for r in bad.collect()] == ["B,ö,£"]
    greek = tmp_path / "g"
    greek.mkdir()
    (greek / "b.csv").write_bytes("id,x\nB,δ\n".encode("iso-8859-7"))
    put(greek, "a.csv", "id,x\nA,δ\n")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")    # Spark's own list is short
    try:
        got = f.load_file(spark, str(greek), "ISO-8859-7").collect()
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")
    assert sorted((r["id"], r["x"]) for r in got) == [("A", "δ"), ("B", "δ")]


def test_each_side_has_its_own_format(spark, tmp_path):
    from ledgerloom.plans import reconcile as rc
    from ledgerloom.sources.store import Store

    ours = tmp_path / "ours"
    ours.mkdir()
    put(ours, "a.csv", "Bank Trx ID;Paid Amt;Paying Bank Name\nT1;5;X\nT2;6;X\nT3;1;X;bad\n")
    (ours / "b.csv").write_bytes("Bank Trx ID;Paid Amt;Paying Bank Name\nT4;7;Né\n".encode("latin-1"))
    bank = spark.createDataFrame([("T1", 5.0), ("T2", 8.0), ("T9", 1.0)], "trx string, credit double")
    bank.write.parquet(str(tmp_path / "bank"))
    run = rc.reconcile_files(
        spark, str(ours), str(tmp_path / "bank"), Store(spark, str(tmp_path / "s")), job_name="j",
        our_reader={"sep": ";"},
        roles=rc.Roles("Bank Trx ID", "trx", "Paid Amt", "credit"))
    assert {(r["bank_trx_id"], r["status"]) for r in run.results.collect()} == {
        ("T1", "matched"), ("T2", "matched"), ("T9", "missing_in_our_file")}
    assert [(r["side"], r["line"]) for r in run.rejected.collect()] == [("our", "T3;1;X;bad")]
    with pytest.raises(ValueError, match="Unsupported"):
        f.load_file(spark, str(tmp_path))
