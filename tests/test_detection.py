from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import features as ft
from ledgerloom.operators import keywords as kw
from ledgerloom.operators import learning
from ledgerloom.operators import profile as pf
from ledgerloom.operators import roles as rl
from ledgerloom.plans import training

FEATURE_INPUT = {
    "Bank Trx ID": ["TBPM123", "No456", "TBPM789"],
    "Paid Amt": ["1500.0", "2500.5", "3000.75"],
    "Customer Name": ["John Doe", "Jane Smith", "Bob Johnson"],
    "Date": ["2024-01-01", "2024-01-02", "2024-01-03"],
}


def long_table(spark, columns: dict[str, list], file: str = "f.csv"):
    names = list(columns)
    rows = [(file, i, *r) for i, r in enumerate(zip(*columns.values()))]
    schema = "file string, ordinal bigint, " + ", ".join(f"`{n}` string" for n in names)
    return pf.to_long(spark.createDataFrame(rows, schema))


def scores(df):
    return {r["col"]: r["score"] for r in df.collect()}


def test_amount_scores(spark):
    ours = long_table(spark, {
        "Bank Trx ID": ["TBPM123", "No456"], "Paid Amt": ["1500.0", "2500.5"],
        "Customer Name": ["John Doe", "Jane Smith"],
    })
    table = kw.seed_keywords(spark)
    profile = pf.column_profile(ours)
    seeded = rl.amount_scores(profile, kw.detection_keywords(table, "our", spark))
    assert scores(seeded)["Paid Amt"] == 494.0
    assert rl.best_columns(seeded).first()["col"] == "Paid Amt"
    nothing = kw.detection_keywords(table.where("false"), "our", spark)
    assert scores(rl.amount_scores(profile, nothing))["Paid Amt"] == 445.0
    bank = long_table(spark, {
        "Transaction_ID": ["TXN123", "TXN456"], "Credit": ["1500.0", "2500.5"],
        "Description": ["Payment 1", "Payment 2"],
    })
    words = kw.detection_keywords(table, "bank", spark)
    best = rl.best_columns(rl.amount_scores(pf.column_profile(bank), words)).first()
    assert (best["col"], best["score"]) == ("Credit", 255.0)


def test_id_scores(spark):
    ours = long_table(spark, {
        "Bank Trx ID": ["TBPM001", "TBPM002", "TBPM003", "TBPM004"],
        "Paid Amt": ["1", "2", "3", "4"],
    })
    assert scores(rl.our_id_scores(pf.column_profile(ours)))["Bank Trx ID"] == 525.0
    bank = long_table(spark, {
        "Transaction_ID": ["TBPM001", "TBPM002", "TBPM003", "TBPM005"],
        "Credit": ["1000.0", "1500.6", "2000.0", "3000.0"],
        "Description": ["Payment A", "Payment B", "Payment C", "Payment E"],
    })
    got = scores(rl.statement_id_scores(pf.column_profile(bank)))
    assert got == {"Transaction_ID": 65.0, "Credit": 35.0, "Description": 55.0}


def test_ties_go_to_the_leftmost_column(spark):
    df = spark.createDataFrame(
        [("f", 1, "b", 5.0), ("f", 0, "a", 5.0), ("f", 2, "c", 4.0)],
        "file string, position int, col string, score double",
    )
    assert rl.best_columns(df).first()["col"] == "a"
    assert [r["col"] for r in rl.top_columns(df, 2).orderBy("rank").collect()] == ["a", "b"]


def test_keyword_scores_of_sample_headers(spark):
    names = ["Paid Amt", "Credit", "Credit دائن", "Amount", "Total Amount", "Customer Name",
             "Bank Trx ID", "Date", "Reference"]
    df = spark.createDataFrame([(n,) for n in names], "col string")
    words = kw.detection_keywords(kw.seed_keywords(spark), "bank", spark)
    got = {r["col"]: r for r in rl.keyword_scores(df, words).collect()}

    def expected(name: str) -> float:
        low = name.lower().strip()
        bare = low.replace(" ", "").replace("_", "").replace("-", "")
        total = 0
        for k, kind, _, p, exact, _ in kw.SEED:
            if kind == "our":
                continue
            kb = k.replace(" ", "").replace("_", "").replace("-", "")
            if exact and (kb == bare or k == low):
                total += 10 * p
            elif exact and k in low:
                total += 8 * p
            elif not exact and (kb in bare or k in low):
                total += 7 * p
        return total / 10

    assert {n: r["score"] for n, r in got.items()} == {n: expected(n) for n in names}
    assert got["Credit"]["matches"] == ["exact:credit:100.0"]
    assert got["Date"]["matches"] == []


def test_cascade_and_decisions(spark):
    schema = "file string, position int, col string, score double"
    learned = spark.createDataFrame([("a", 1, "L", 71.0), ("b", 1, "L", 70.0)], schema)
    rules = spark.createDataFrame([("a", 0, "R", 500.0), ("b", 0, "R", 15.0)], schema)
    best = rl.cascade(learned, rules)
    assert {r.file: (r.col, r.source) for r in best.collect()} == {
        "a": ("L", "learned"), "b": ("R", "rules"),
    }
    decided = {r.file: r.decision for r in rl.role_decisions(best, "statement_id").collect()}
    assert decided == {"a": "accept", "b": "reject"}
    assert {r.file: r.decision for r in rl.role_decisions(best, "our_id").collect()}["b"] == "warn"
    assert {r.file: r.decision for r in rl.role_decisions(best, "amount").collect()}["b"] == "skip"
    manual = {r.file: r for r in rl.role_decisions(best, "statement_id", {"b": "M"}).collect()}
    assert (manual["b"].col, manual["b"].score, manual["b"].decision) == ("M", 100.0, "accept")


def test_profile_counts_nulls_and_tokens(spark):
    long = long_table(spark, {"A": ["1", None, "nan", " "], "Empty": [None] * 4})
    got = {r["col"]: r for r in pf.column_profile(long).collect()}
    a, empty = got["A"], got["Empty"]
    assert (a.non_null, a.non_empty, a.n_distinct, a.n_numeric) == (3, 1, 3, 1)
    assert a.uniqueness == 3.0 and a.mean_length == pytest.approx(4 / 3)
    assert (empty.non_null, empty.n_distinct, empty.uniqueness) == (0, 0, None)


def test_sample_takes_the_first_values_per_file(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") < 4000, "big.csv").otherwise("small.csv").alias("file"),
        F.col("id").alias("ordinal"),
        F.when(F.col("id") % 2 == 1, F.col("id").cast("string")).alias("v"),
    )
    cells = pf.first_cells(pf.to_long(df.repartition(8)), 10).where("val is not null")
    got = {f: [r.val for r in cells.where(F.col("file") == f).orderBy("rn").collect()]
           for f in ("big.csv", "small.csv")}
    assert got["big.csv"] == [str(i) for i in range(1, 20, 2)]
    assert got["small.csv"] == [str(i) for i in range(4001, 4020, 2)]


def features_of(df, col):
    return df.where(F.col("col") == col).first().asDict()


def test_feature_vectors_have_61_entries(spark):
    long = long_table(spark, FEATURE_INPUT)
    for make in (ft.id_features, ft.amount_features):
        df = make(long)
        assert len(ft.feature_names(df)) == len(set(ft.feature_names(df))) == 61
        assert df.count() == 4


def test_id_feature_values(spark):
    f = features_of(ft.id_features(long_table(spark, FEATURE_INPUT)), "Bank Trx ID")
    assert [f[f"name_{w}"] for w in ft.TRX_WORDS] == [1, 1, 0, 1, 0, 0]
    assert (f["name_length"], f["name_blanks"], f["name_upper"], f["name_lower"]) == (11, 2, 0, 1)
    assert f["name_trx_near_id"] == f["name_starts_bank"] == f["name_ends_id"] == 1
    assert (f["value_count"], f["distinct_count"], f["distinct_ratio"]) == (3, 3, 1)
    assert f["length_mean"] == pytest.approx(19 / 3)
    assert f["prefix_TB"] == pytest.approx(2 / 3) and f["prefix_No"] == pytest.approx(1 / 3)
    assert f["mixed_case"] == pytest.approx(1 / 3) and f["sequence"] == 1
    assert f["shape_letters_digits"] == pytest.approx(2 / 3)
    assert (f["position"], f["is_first"], f["in_first_half"]) == (0, 1, 1)


def test_unicode_and_repeats(spark):
    long = long_table(spark, {"مبلغ": ["١٢٣", "aaa", None], "E": [None, None, None]})
    df = ft.id_features(long)
    f = features_of(df, "مبلغ")
    assert f["has_digits"] == 0.5 and f["repeated"] == 0.5 and f["name_lower"] == 0
    empty = features_of(df, "E")
    assert empty["value_count"] == empty["length_mean"] == empty["first_letter"] == 0


def test_amount_feature_values(spark):
    df = ft.amount_features(long_table(spark, FEATURE_INPUT))
    f = features_of(df, "Paid Amt")
    assert (f["name_paid"], f["name_amt"], f["name_paid_and_amt"]) == (1, 1, 1)
    assert f["number_sum"] == 7001.25 and f["number_median"] == 2500.5
    assert f["number_range"] == 1500.75 and f["medium_ratio"] == f["positive_ratio"] == 1
    assert (f["near_trx"], f["near_date"], f["near_bank"], f["near_name"]) == (1, 1, 1, 1)
    assert f["only_numeric"] == 1 and f["paid_in_first_half"] == 1
    date = features_of(df, "Date")
    assert date["near_amounts"] == 1 and date["only_numeric"] == 0


def test_similar_names_are_capped(spark):
    long = long_table(spark, {f"amount {i}": ["1"] for i in range(8)} | {"x": ["1"]})
    got = {r["col"]: r["similar_names"] for r in ft.neighbour_context(long).collect()}
    assert got["amount 0"] == 5 and got["x"] == 0


def test_amount_candidates(spark):
    long = long_table(spark, {
        "Paid Amt": ["1,500", None, "x", "3", "4", "5"], "Total": ["a", "b", "1", "2", "3", "4"],
        "Date": ["1"] * 6, "Balance": [None] * 6,
    })
    got = {r["col"]: (r.n_values, r.n_numeric) for r in pf.amount_candidates(long).collect()}
    assert got == {"Balance": (0, 0)}  # Paid Amt: 2 of the first 3; an empty column passes


def test_keyword_changes(spark):
    table = kw.seed_keywords(spark)
    assert table.count() == 30
    listed = kw.list_keywords(table, "our").collect()
    assert listed[0]["keyword"] == "paid amt" and all(r.file_type in ("our", "both") for r in listed)
    assert {r.keyword for r in kw.list_keywords(table, language="ar").collect()} == {
        "credit دائن", "دائن", "مدين",
    }
    assert [r.keyword for r in kw.search_keywords(table, "CREDIT").collect()][0] == "credit"
    new = spark.createDataFrame(
        [(31, "  Net PAY ", "our", 80), (1, "taken", "our", 5)],
        "id int, keyword string, file_type string, priority int",
    )
    added = kw.add_keywords(table, new)
    row = added.where("id = 31").first()
    assert (row.keyword, row.language, row.is_exact_match, row.created_by) == ("net pay", "en", False, "user")
    assert added.count() == 31
    changed = kw.update_keywords(added, spark.createDataFrame([(31, 10)], "id int, priority int"))
    assert changed.where("id = 31").first().priority == 10
    gone = kw.delete_keywords(changed, spark.createDataFrame([(31,)], "id int"))
    assert gone.where("id = 31").first().is_active is False
    assert kw.search_keywords(gone, "net pay").count() == 0
    assert {r.file_type: r.n for r in kw.keyword_counts(gone).collect()} == {
        "our": 5, "bank": 7, "both": 18,
    }
    bad = spark.createDataFrame(
        [(1, "", "our", 5), (2, "a", "x", 5), (3, "a", "our", 101), (4, "a", "our", None),
         (5, "a", None, 5), (6, None, "our", 5)],
        "id int, keyword string, file_type string, priority int",
    )
    good, rejected = kw.validate_keywords(bad)
    assert [r.id for r in good.collect()] == [4] and rejected.count() == 5


def labelled_files(spark, n=12):
    parts = []
    for i in range(n):
        values = {
            "No": [str(j) for j in range(6)],
            "Bank Trx ID": [f"TBPM{i:04d}{j:08d}" for j in range(6)],
            "Customer": ["Ann", "Bob", "Cid", "Dan", "Eve", "Fay"],
            "Paid Amt": [f"{i + j}.50" for j in range(6)],
        }
        parts.append(long_table(spark, values, f"/data/{i}.csv"))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    labels = spark.createDataFrame(
        [(f"{i}.csv", "Bank Trx ID") for i in range(n)], "file_name string, label_col string"
    )
    return long, labels


def test_split_is_exact_and_stable(spark):
    rows = [(f"f{i}", f"c{j}", float(j == 0)) for i in range(50) for j in range(5)]
    df = spark.createDataFrame(rows, "file string, col string, label double")
    got = learning.split(df)
    counts = {(r.label, r.test): r["count"] for r in got.groupBy("label", "test").count().collect()}
    assert counts == {(1.0, True): 10, (1.0, False): 40, (0.0, True): 40, (0.0, False): 160}
    again = learning.split(df.repartition(9))
    assert got.exceptAll(again).count() == 0
    tiny = learning.split(df.limit(3))
    assert all(r.train and r.test for r in tiny.collect())


def test_measures(spark):
    pairs = [(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "label double, predicted double")
    row = learning.evaluate(df).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.6, 0.5, 0.5, 0.5)
    none = learning.evaluate(df.withColumn("predicted", F.lit(0.0))).first()
    assert (none.precision, none.recall, none.f1) == (0, 0, 0)


def test_train_save_load_and_use(spark, tmp_path):
    long, labels = labelled_files(spark)
    trained = training.train(long, labels, "id", iterations=20)
    assert trained.metrics.first().recall == 1.0
    path = str(tmp_path / "model")
    learning.save(trained.model, path)
    model = learning.load(path)
    assert learning.load(str(tmp_path / "none")) is None
    best = rl.best_columns(learning.confidence(model, ft.id_features(long)))
    checked = learning.compare_with_labels(best, labels)
    assert checked.where("match").count() == 12 and checked.agg(F.min("confidence")).first()[0] > 70


def test_training_needs_positives(spark):
    long, labels = labelled_files(spark, 2)
    with pytest.raises(learning.NoTrainingData):
        training.train(long, labels.withColumn("label_col", F.lit("nope")), "amount")
    with pytest.raises(learning.NoTrainingData):
        training.train(long, labels.where("false"), "amount")


def test_label_validation(spark):
    long, labels = labelled_files(spark, 4)
    heads = pf.headers(long)
    assert tuple(learning.validate_labels(heads, labels).first()) == (4, 4, "ok")
    some = labels.withColumn("label_col", F.when(F.col("file_name") < "2", F.col("label_col")).otherwise(" "))
    assert tuple(learning.validate_labels(heads, some).first()) == (4, 2, "warn")
    assert learning.validate_labels(heads, labels.where("false")).first().verdict == "fail"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def uneven_rows(spark):
    """Files whose ordinals are consecutive, spread, bunched at the end, tied or few; columns that
    are dense, late, rare, empty."""
    rng = np.random.default_rng(5)
    rows = []
    for name, ordinals in {
        "even": range(3000), "spread": sorted(rng.choice(10**9, 3000, False).tolist()),
        "bunched": [0, *range(10**12, 10**12 + 2500)], "few": range(7, 30),
        "tied": [1] * 900 + list(range(2, 700)), "one": [5],
    }.items():
        for k, o in enumerate(ordinals):
            rows.append((name, int(o), ["d", "late", "rare", "none", "half"], [
                f"{k % 37}", f"{o}" if k > 2000 else None, "x" if k % 90 == 0 else None, None,
                f"{k}.5" if rng.random() < 0.5 else None]))
    return spark.createDataFrame(
        rows, "file string, ordinal long, names array<string>, vals array<string>").repartition(5)


def test_first_values_equal_those_of_all_cells(spark):
    rows = uneven_rows(spark)
    cells = pf.explode_rows(rows)
    for n in (100, 10, 3):
        got = pf.column_profile(pf.first_values(rows, n), n).where("file <> 'tied'").collect()
        want = pf.column_profile(cells, n).where("file <> 'tied'").collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 25
        tied = pf.first_values(rows, n).where("file = 'tied'").groupBy("col").agg(
            F.count("val").alias("k")).collect()
        assert {r["col"]: r["k"] for r in tied if r["col"] in ("d", "none")} == {"d": n, "none": 0}
    few = pf.first_values(rows, 100)
    assert few.groupBy("file", "col").count().agg(F.max("count")).first()[0] <= 200


def test_leading_rows_hold_the_first(spark):
    rows = uneven_rows(spark)
    near = pf.leading_rows(rows, 5)
    got = {(r["file"], r["ordinal"]) for r in near.collect()}
    for r in rows.where("file <> 'tied'").groupBy("file").agg(
            F.sort_array(F.collect_list("ordinal")).alias("o")).collect():
        assert {(r["file"], o) for o in r["o"][:5]} <= got
    assert near.where("file in ('even', 'spread')").count() < 80
    assert "Window" not in plan_of(near) and "Sort " not in plan_of(near)
    # Candidates go by the first five rows, blank cells among them.
    assert sorted(map(str, pf.amount_candidates(pf.explode_rows(near)).collect())) == sorted(
        map(str, pf.amount_candidates(pf.explode_rows(rows)).collect()))


def test_headers_need_no_cells(spark):
    rows = uneven_rows(spark)
    assert sorted(pf.headers(rows).collect()) == sorted(pf.headers(pf.explode_rows(rows)).collect())
    assert "vals" not in rows.select("file", "names").columns
    assert "Generate" in plan_of(pf.headers(rows)) and pf.header_listing(rows, 2).count() == 10


def test_first_values_of_a_directory(spark, tmp_path):
    """Several blocks and files: neither the scan's cells nor its rows are sorted."""
    from ledgerloom.sources.files import CsvFiles

    for k, size in enumerate((3000, 20, 2000)):
        text = "n,late,none\n" + "".join(
            f"{i},{i if i > 1500 else ''},\n" for i in range(size))
        (tmp_path / f"{k}.csv").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        files = CsvFiles.open(spark, str(tmp_path), "*.csv")
        got = pf.column_profile(files.first_values()).collect()
        want = pf.column_profile(files.cells()).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 9


def test_the_table_of_a_detector_scores_as_the_detector(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"f{i % 20}", i % 4, f"c{i}", float(rng.normal()), float(i % 2), 5.0, float(i % 3 == 0))
            for i in range(120)]
    data = spark.createDataFrame(rows, "file string, position int, col string, a double, `b c` double, "
                                       "same double, label double")
    data = data.withColumns({"train": F.lit(True), "test": F.lit(True)})
    model = learning.fit(data)
    learning.model_table(model).write.parquet(f"{tmp_path}/model")
    table = spark.read.parquet(f"{tmp_path}/model")
    assert {r["feature"] for r in table.collect()} == {"position", "a", "b c", "same", None}
    plain = {r["col"]: r["score"] for r in learning.confidence(model, data).collect()}
    got = {r["col"]: r["score"] for r in learning.table_confidence(table, data).collect()}
    assert got == pytest.approx(plain, abs=1e-9)
    plan = plan_of(learning.table_confidence(table, data))
    assert "Exchange" not in plan and "Python" not in plan
    with pytest.raises(ValueError):
        learning.model_table(learning.fit(data, "gbt", 2))


def test_keywords_in_a_very_long_header(spark):
    """Only substrings of the keywords' lengths are cut: 10,000 characters, not 50 million pairs."""
    words = spark.createDataFrame(
        [("amount", 90, False), ("paid_amt", 80, True), ("x" * 300, 70, False), ("", 5, False)],
        "keyword string, priority int, is_exact_match boolean")
    long = "z" * 5000 + "Paid Amt" + "é" * 4000 + "AMOUNT" + "x" * 986
    names = spark.createDataFrame([(long,), ("Amount",), ("",), ("am",)], "col string")
    matches = rl.keyword_matches(names, words)
    got = {(r["col"], r["keyword"]) for r in matches.collect()}
    assert {k for c, k in got if c == long} >= {"amount", "x" * 300}
    assert ("Amount", "amount") in got and not [k for c, k in got if c == "am" and k]
    text = "x" * 10_000
    cut = spark.createDataFrame([(text, [6, 300, 20_000, 0])], "c string, n array<int>").select(
        F.size(rl._parts(F.col("c"), F.col("n")))).first()[0]
    assert cut == 2


def test_whole_columns_are_sketched_and_merge(spark):
    rows = [("a", i, f"{i % 700}", "x" if i % 2 else None) for i in range(4000)] + [
        ("b", i, f"{i % 900}", None) for i in range(3000)]
    long = pf.to_long(spark.createDataFrame(rows, "file string, ordinal long, n string, t string"))
    exact = {(r["file"], r["col"]): r for r in pf.column_profile(
        long, None, approximate_distinct=False).collect()}
    for r in pf.column_profile(long, None).collect():
        want = exact[r["file"], r["col"]]
        assert abs(r["n_distinct"] - want["n_distinct"]) <= 0.02 * want["n_distinct"]
        assert [r[c] for c in ("non_null", "non_empty", "n_numeric", "mean_value")] == pytest.approx(
            [want[c] for c in ("non_null", "non_empty", "n_numeric", "mean_value")])
    parts = pf.profile_parts(long.where("file = 'a'")).unionByName(
        pf.profile_parts(long.where("file = 'b'")))
    both = {r["col"]: r for r in pf.profile_of(pf.merged_parts(parts, "position", "col")).collect()}
    assert both["n"]["non_null"] == 7000 and abs(both["n"]["n_distinct"] - 900) <= 18
    assert (both["t"]["n_distinct"], both["t"]["mean_value"]) == (1, None)
    assert "Expand" not in plan_of(pf.column_profile(long, None))


def test_values_are_measured_once_each(spark):
    cells = long_table(spark, {"A": ["1.5", "1.5", " nan ", None], "B": ["x", "x", "x", "x"],
                               "C": [None] * 4})
    counts = pf.value_counts(cells)
    assert {(r.col, r.val, r.n) for r in counts.collect()} == {
        ("A", "1.5", 2), ("A", " nan ", 1), ("A", None, 1), ("B", "x", 4), ("C", None, 4)}
    want = {"A": (3, 3, 2, 9, 2, 2, 1.5), "B": (4, 4, 1, 4, 0, 0, None), "C": (0, 0, 0, 0, 0, 0, None)}
    for profile in (pf.counted_profile(counts), pf.profile_of(pf.profile_parts(counts)),
                    pf.profile_of(pf.profile_parts(cells)),
                    pf.column_profile(cells, None, approximate_distinct=False)):
        assert {r.col: (r.non_null, r.non_empty, r.n_distinct, r.length_sum, r.n_numeric,
                        r.n_positive, r.mean_value) for r in profile.collect()} == want


def test_leading_rows_are_chosen_before_cells_are_made(spark):
    wide = spark.range(3000).selectExpr(
        "concat('f', id % 3) AS file", "id AS ordinal", "cast(id AS string) AS a",
        "cast(null AS string) AS b")
    rows = pf.to_rows(wide)
    near = pf.leading_rows(rows, 10)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("Project") < plan.index("Filter")
    assert 30 <= near.count() < 300
    first = pf.first_values(rows, 10).where("val is not null")
    assert {r.file: r.n for r in first.groupBy("file").agg(F.count("*").alias("n")).collect()} == {
        "f0": 10, "f1": 10, "f2": 10}
