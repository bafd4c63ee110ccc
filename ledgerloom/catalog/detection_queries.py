"""Registered queries for profiling, features, role detection and the keyword table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import features as ft
from ledgerloom.operators import keywords as kw
from ledgerloom.operators import profile as pf
from ledgerloom.operators import roles as rl

from . import tables
from .oracle import over_long

# Keyword rows derived from the parts table; SQL valid in both engines.
PART_KEYWORDS = """
SELECT CAST(p_partkey + 1 AS INT) AS id, p_name AS keyword,
  CASE WHEN p_size % 3 = 0 THEN 'our' WHEN p_size % 3 = 1 THEN 'bank' ELSE 'both' END AS file_type,
  CASE WHEN p_partkey % 7 = 0 THEN 'ar' WHEN p_partkey % 5 = 0 THEN 'both' ELSE 'en' END
    AS language,
  CAST(p_size * 2 AS INT) AS priority, p_partkey % 2 = 0 AS is_exact_match,
  p_partkey % 11 <> 0 AS is_active, p_brand AS description
FROM {part}
"""


def long_table(spark: SparkSession, sf: str, *layouts: str) -> DataFrame:
    parts = [pf.to_long(tables.wide(spark, sf, x)) for x in layouts or tables.LAYOUTS]
    return reduce(DataFrame.unionByName, parts)


def rows_table(spark: SparkSession, sf: str, *layouts: str) -> DataFrame:
    parts = [pf.to_rows(tables.wide(spark, sf, x)) for x in layouts or tables.LAYOUTS]
    return reduce(DataFrame.unionByName, parts)


def sample_table(spark: SparkSession, sf: str, *layouts: str) -> DataFrame:
    """First values of every column, in long form."""
    return pf.first_values(rows_table(spark, sf, *layouts))


def keyword_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(PART_KEYWORDS, part=tables.read(spark, sf, "part"))
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return rows.select(
        "id", "keyword", "file_type", "language", "priority", "is_exact_match", "is_active",
        stamp.alias("created_at"), stamp.alias("updated_at"), F.lit("part").alias("created_by"),
        "description",
    )


PROFILE_COLUMNS = [
    "file", "position", "n_cols", "col", "non_null", "non_empty", "n_distinct", "length_sum",
    "n_numeric", "n_positive", "uniqueness", "mean_length", "numeric_ratio", "positive_ratio",
]


def _profile_output(profile: DataFrame) -> DataFrame:
    mean = F.when(F.abs("mean_value") < 1e9, F.round("mean_value", 4))
    return profile.select(*PROFILE_COLUMNS, mean.alias("mean_value"))


def column_profile(spark, sf):
    return _profile_output(pf.column_profile(
        long_table(spark, sf), sample=None, approximate_distinct=False))


def column_profile_merged(spark, sf):
    """Whole columns over all files of a layout, from the parts of each file: counts as they are,
    distinct values within three percent of the exact number."""
    counts = pf.value_counts(long_table(spark, sf))
    parts = pf.merged_parts(pf.profile_parts(counts), "position", "n_cols", "col")
    exact = counts.groupBy("position", "n_cols", "col").agg(F.count_distinct("val").alias("exact"))
    out = pf.profile_of(parts).join(exact, ["position", "n_cols", "col"])
    mean = F.when(F.abs("mean_value") < 1e9, F.round("mean_value", 4))
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= F.col("exact") * 0.03
    return out.select(
        "position", "n_cols", "col", "n_parts", "non_null", "non_empty", "length_sum", "n_numeric",
        "n_positive", mean.alias("mean_value"), F.col("exact").alias("n_distinct"),
        near.alias("sketch_is_near"))


def column_profile_sample(spark, sf):
    return _profile_output(pf.column_profile(sample_table(spark, sf)))


def profile(spark, sf, *layouts):
    return pf.column_profile(sample_table(spark, sf, *layouts))


def id_role_ours(spark, sf):
    return rl.our_id_scores(profile(spark, sf, "ours"))


def id_role_bank(spark, sf):
    return rl.statement_id_scores(profile(spark, sf))


def _amount_scores(spark, sf):
    words = kw.detection_keywords(kw.seed_keywords(spark), "bank", spark)
    first = sample_table(spark, sf)
    return rl.amount_scores(pf.column_profile(first), words, pf.headers(first))


def amount_role(spark, sf):
    return _amount_scores(spark, sf)


def role_best(spark, sf):
    return rl.best_columns(_amount_scores(spark, sf))


def role_top3(spark, sf):
    return rl.top_columns(_amount_scores(spark, sf), 3)


def role_decision(spark, sf):
    ids = rl.best_columns(rl.statement_id_scores(profile(spark, sf)))
    return rl.role_decisions(ids, "statement_id", {"plain_0.csv": "Description"})


def keyword_scores(spark, sf):
    parts = tables.read(spark, sf, "part")
    names = parts.select(F.concat_ws("_", "p_type", "p_name", "p_brand").alias("col"))
    words = keyword_table(spark, sf).select("keyword", "priority", "is_exact_match").distinct()
    return rl.keyword_scores(names, words).withColumn("matches", F.concat_ws(",", "matches"))


def neighbour_context(spark, sf):
    return ft.neighbour_context(sample_table(spark, sf)).drop("n_cols")


def id_features(spark, sf):
    out = ft.id_features(long_table(spark, sf), sample_table(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ft.feature_names(out)})


BIG = [
    "number_mean", "number_median", "number_std", "number_min", "number_max", "number_sum",
    "number_range",
]


def amount_features(spark, sf):
    out = ft.amount_features(sample_table(spark, sf))
    return out.withColumns(
        {
            c: F.format_string("%.9e", F.col(c)) if c in BIG else F.round(c, 6)
            for c in ft.feature_names(out)
        }
    )


def amount_candidates(spark, sf):
    return pf.amount_candidates(pf.explode_rows(
        pf.leading_rows(rows_table(spark, sf), pf.CANDIDATE_ROWS)))


def header_listing(spark, sf):
    return pf.header_listing(rows_table(spark, sf))


def keywords_list(spark, sf):
    return kw.list_keywords(keyword_table(spark, sf), "our", "en")


def keywords_search(spark, sf):
    return kw.search_keywords(keyword_table(spark, sf), "Bolt")


def keyword_counts(spark, sf):
    return kw.keyword_counts(keyword_table(spark, sf))


CHANGES = """
SELECT CAST(p_partkey + 1 AS INT) AS id,
  CASE WHEN p_partkey % 9 = 0 THEN '  ' ELSE '  ' || upper(p_name) || ' NEW' END AS keyword,
  CASE WHEN p_partkey % 8 = 0 THEN 'none' ELSE 'bank' END AS file_type,
  CAST(p_size * 3 AS INT) AS priority
FROM {part}
"""


def keywords_validate(spark, sf):
    changes = spark.sql(CHANGES, part=tables.read(spark, sf, "part"))
    good, bad = kw.validate_keywords(changes)
    return good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))


def keywords_changed(spark, sf):
    """Add, update and delete, one after the other."""
    part = tables.read(spark, sf, "part")
    table = keyword_table(spark, sf)
    changes = spark.sql(CHANGES, part=part)
    top = part.agg(F.max("p_partkey")).scalar()
    fresh = changes.withColumn("id", (F.col("id") + top).cast("int"))
    added = kw.add_keywords(table, fresh)
    update = part.select(
        (F.col("p_partkey") + 1).cast("int").alias("id"),
        F.when(F.col("p_partkey") % 4 == 0, 99).alias("priority"),
        F.when(F.col("p_partkey") % 6 == 0, F.lit("changed")).alias("description"),
    )
    updated = kw.update_keywords(added, update)
    gone = part.where(F.col("p_size") > 40).select((F.col("p_partkey") + 1).cast("int").alias("id"))
    return kw.delete_keywords(updated, gone).drop("created_at", "updated_at")


QUERIES = {
    f.__name__: f
    for f in (
        column_profile, column_profile_merged, column_profile_sample, id_role_ours, id_role_bank,
        amount_role, role_best,
        role_top3, role_decision, keyword_scores, neighbour_context, id_features,
        amount_features, amount_candidates, header_listing, keywords_list, keywords_search,
        keyword_counts, keywords_validate, keywords_changed,
    )
}


# --- oracle SQL -----------------------------------------------------------------------

_NUMBER = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _number(x: str, chars: str = ",$€£") -> str:
    clean = f"trim(translate(trim({x}), '{chars}', ''))"
    return f"CASE WHEN regexp_matches({clean}, '{_NUMBER}') THEN try_cast({clean} AS DOUBLE) END"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} END"


_HEADERS = """,
headers AS (SELECT DISTINCT file, position, n_cols, col FROM long),
present AS (SELECT *, row_number() OVER (PARTITION BY file, position ORDER BY ordinal) AS rn
            FROM long WHERE val IS NOT NULL)"""


def _profile_ctes(sample: int | None) -> str:
    return _HEADERS + f""",
stats AS (
  SELECT file, position, count(*) AS non_null,
    count(*) FILTER (lower(val) NOT IN ('nan','none','null') AND trim(val) <> '') AS non_empty,
    count(DISTINCT val) AS n_distinct, CAST(sum(length(trim(val))) AS BIGINT) AS length_sum,
    count({_number('val')}) AS n_numeric,
    count(*) FILTER ({_number('val')} > 0) AS n_positive, avg({_number('val')}) AS mean_value
  FROM present {f'WHERE rn <= {sample}' if sample else ''} GROUP BY file, position),
counts AS (
  SELECT h.*, coalesce(non_null, 0) AS non_null, coalesce(non_empty, 0) AS non_empty,
    coalesce(n_distinct, 0) AS n_distinct, coalesce(length_sum, 0) AS length_sum,
    coalesce(n_numeric, 0) AS n_numeric, coalesce(n_positive, 0) AS n_positive, mean_value
  FROM headers h LEFT JOIN stats s ON h.file = s.file AND h.position = s.position),
profile AS (
  SELECT file, position, n_cols, col, non_null, non_empty, n_distinct, length_sum, n_numeric,
    n_positive, {_ratio('n_distinct', 'non_empty')} AS uniqueness,
    {_ratio('length_sum', 'non_null')} AS mean_length,
    {_ratio('n_numeric', 'non_null')} AS numeric_ratio,
    {_ratio('n_positive', 'n_numeric')} AS positive_ratio,
    CASE WHEN abs(mean_value) < 1e9 THEN round(mean_value, 4) END AS mean_value,
    mean_value AS raw_mean
  FROM counts)"""


_PROFILE_SELECT = f"SELECT {', '.join(PROFILE_COLUMNS)}, mean_value FROM profile"


def _pts(condition: str, points: float) -> str:
    return f"CASE WHEN {condition} THEN {points}::DOUBLE ELSE 0::DOUBLE END"


def _any(name: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({name}, '{w}')" for w in words) + ")"


def _clean(x: str) -> str:
    return f"replace(replace(replace(lower(trim({x})), ' ', ''), '_', ''), '-', '')"


_LIKELY = "non_empty > 0 AND mean_length BETWEEN 8 AND 30"


def _our_id_score() -> str:
    name, clean = "lower(trim(col))", _clean("col")
    parts = []
    for h in rl.OUR_ID_HEADERS:
        bare = h.replace(" ", "").replace("_", "")
        parts.append(
            f"CASE WHEN {clean} = '{bare}' THEN 100 WHEN contains({name}, '{h}') THEN 80"
            f" WHEN contains({clean}, '{bare}') THEN 60 ELSE 0 END"
        )
    parts += [
        _pts(_any(name, "bank", "trx", "transaction"), 40),
        _pts(_any(name, "id", "ref", "reference"), 20),
        _pts("uniqueness > 0.8", 25),
        _pts(_LIKELY, 15),
    ]
    return f"CAST({' + '.join(parts)} AS DOUBLE)"


_STATEMENT_ID_SCORE = " + ".join(
    [
        _pts(_any("lower(col)", "trx", "transaction", "ref", "reference", "id"), 30),
        _pts(_any("lower(col)", "bank", "payment", "txn"), 20),
        _pts("uniqueness > 0.7", 35),
        _pts(_LIKELY, 20),
    ]
)

_SEED_VALUES = ", ".join(
    f"('{k}', '{t}', '{lang}', {p}, {str(e).lower()})" for k, t, lang, p, e, _ in kw.SEED
)


def _match_ctes(names: str, words: str) -> str:
    """Keyword points per header by the plain definition, a theta join."""
    return f""",
words AS (SELECT keyword, priority, is_exact_match, {_clean('keyword')} AS kclean FROM {words}),
names AS (SELECT DISTINCT col, lower(trim(col)) AS low, {_clean('col')} AS bare FROM {names}),
matches AS (
  SELECT col, keyword, priority,
    CASE WHEN NOT is_exact_match THEN
      CASE WHEN contains(bare, kclean) OR contains(low, keyword) THEN 'flexible' END
    WHEN kclean = bare OR keyword = low THEN 'exact'
    WHEN contains(low, keyword) THEN 'partial' END AS kind
  FROM names, words),
points AS (
  SELECT *, priority * CASE kind WHEN 'exact' THEN 10 WHEN 'partial' THEN 8 ELSE 7 END AS tenths
  FROM matches WHERE kind IS NOT NULL)"""


_AMOUNT_CTES = _profile_ctes(100) + f""",
seed AS (SELECT * FROM (VALUES {_SEED_VALUES})
         t(keyword, file_type, language, priority, is_exact_match)
         WHERE file_type IN ('bank', 'both'))""" + _match_ctes("headers", "seed") + f""",
named AS (SELECT col, CAST(sum(tenths) AS DOUBLE) / 10.0 AS named FROM points GROUP BY col),
scores AS (
  SELECT p.file, p.position, p.col, coalesce(named, 0::DOUBLE)
    + CASE WHEN numeric_ratio > 0.8 THEN 100::DOUBLE WHEN numeric_ratio > 0.5 THEN 50::DOUBLE
           WHEN numeric_ratio > 0.3 THEN 25::DOUBLE ELSE 0::DOUBLE END
    + {_pts('positive_ratio > 0.7', 30)} + {_pts('raw_mean BETWEEN 1 AND 1000000', 25)} AS score
  FROM profile p LEFT JOIN named n ON p.col = n.col),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, position) AS rnk
  FROM scores)"""


def _flag(condition: str) -> str:
    return f"CAST(CASE WHEN {condition} THEN 1 ELSE 0 END AS DOUBLE)"


def _neighbour_ctes() -> str:
    name = "lower(o.col)"
    flags = ",\n    ".join(
        f"coalesce(max({_flag(_any(name, *words))}), 0) AS {k}"
        for k, words in ft.NEAR_WORDS.items()
    )
    similar = " OR ".join(
        f"(contains(lower(h.col), '{w}') AND contains(lower(o.col), '{w}'))"
        for w in ft.SIMILAR_WORDS
    )
    return f""",
numeric20 AS (
  SELECT file, position, count({_number('val', ',$')}) > count(*) * 0.5 AS numeric
  FROM present WHERE rn <= 20 GROUP BY file, position),
near AS (
  SELECT h.file, h.position, h.col, h.n_cols,
    {flags},
    CAST(least(count(*) FILTER ({_any(name, *ft.NEAR_AMOUNT_WORDS)}), 5) AS DOUBLE)
      AS near_amounts,
    1 - coalesce(max({_flag('n.numeric')}), 0) AS only_numeric
  FROM headers h
  LEFT JOIN headers o ON o.file = h.file AND abs(o.position - h.position) <= 2
    AND o.position <> h.position
  LEFT JOIN numeric20 n ON n.file = o.file AND n.position = o.position
  GROUP BY h.file, h.position, h.col, h.n_cols),
similar_to AS (
  SELECT h.file, h.position, CAST(least(count(o.col), 5) AS DOUBLE) AS similar_names
  FROM headers h LEFT JOIN headers o ON o.file = h.file AND o.position <> h.position
    AND ({similar})
  GROUP BY h.file, h.position),
context AS (
  SELECT near.*, s.similar_names FROM near
  JOIN similar_to s ON s.file = near.file AND s.position = near.position)"""


_CONTEXT_COLUMNS = [*ft.NEAR_WORDS, "near_amounts", "only_numeric", "similar_names"]

_POSITION = {
    "position": "CAST(h.position AS DOUBLE)",
    "relative_position": "CAST(h.position AS DOUBLE) / greatest(h.n_cols - 1, 1)",
    "is_first": _flag("h.position = 0"),
    "is_last": _flag("h.position = h.n_cols - 1"),
    "in_first_half": _flag("h.position < h.n_cols / 2"),
}


def _select(exprs: dict[str, str]) -> str:
    return ",\n  ".join(f"{sql} AS {name}" for name, sql in exprs.items())


def _id_features_sql() -> str:
    name = "lower(trim(h.col))"
    names = {f"name_{w}": _flag(_any(name, w)) for w in ft.TRX_WORDS + ft.RELATED_WORDS}
    names |= {
        "name_length": f"CAST(length({name}) AS DOUBLE)",
        "name_underscores": f"CAST(length({name}) - length(replace({name}, '_', '')) AS DOUBLE)",
        "name_blanks": f"CAST(length({name}) - length(replace({name}, ' ', '')) AS DOUBLE)",
        "name_upper": "0::DOUBLE",
        "name_lower": _flag(f"upper({name}) <> {name}"),
        "name_digit": _flag(f"regexp_matches({name}, '[0-9]')"),
        "name_trx_and_id": _flag(f"{_any(name, 'trx')} AND {_any(name, 'id')}"),
        "name_bank_and_trx": _flag(f"{_any(name, 'bank')} AND {_any(name, 'trx', 'id')}"),
        "name_starts_bank": _flag(f"starts_with({name}, 'bank')"),
        "name_ends_id": _flag(f"ends_with({name}, 'id')"),
        "name_ref_and_trx": _flag(f"{_any(name, 'ref')} AND {_any(name, 'trx', 'transaction')}"),
        "name_trx_near_id": _flag(f"regexp_matches({name}, 'trx.*id|id.*trx')"),
    }

    def rate(condition: str) -> str:
        return f"CAST(count(*) FILTER (rn <= 50 AND {condition}) AS DOUBLE) / least(count(*), 50)"

    def like(x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    t = "trim(val)"
    values = {
        "length_mean": f"avg(length({t}))",
        "length_std": f"stddev_pop(length({t}))",
        "length_min": f"CAST(min(length({t})) AS DOUBLE)",
        "length_max": f"CAST(max(length({t})) AS DOUBLE)",
        "has_letters": rate(like("val", "\\p{L}")),
        "has_digits": rate(like("val", "[0-9]")),
        "has_special": rate(like("val", "[-_/\\\\()\\[\\]{}]")),
        "has_long": rate(f"length({t}) > 10"),
    }
    values |= {f"shape_{k}": rate(like(t, p)) for k, p in ft.ID_SHAPES.items()}
    values |= {
        "first_letter": rate(like(t, "^\\p{L}")),
        "first_digit": rate(like(t, "^[0-9]")),
        "last_letter": rate(like(t, "\\p{L}$")),
        "last_digit": rate(like(t, "[0-9]$")),
    }
    values |= {f"prefix_{p}": rate(f"starts_with({t}, '{p}')") for p in ft.ID_PREFIXES}
    same = "substr(trim(val), i, 1) = substr(trim(val), i + 1, 1)"
    third = "substr(trim(val), i, 1) = substr(trim(val), i + 2, 1)"
    values |= {
        "digit_run": rate(like(t, "[0-9]{5,}")),
        "mixed_case": rate(f"{like('val', '[A-Z]')} AND {like('val', '[a-z]')}"),
        "sequence": rate(like(t, ft.SEQUENCE)),
        "repeated": rate(
            f"len(list_filter(range(1, length(trim(val)) - 1), lambda i: {same} AND {third})) > 0"
        ),
    }
    whole = {
        "value_count": "CAST(count(*) AS DOUBLE)",
        "distinct_count": "CAST(count(DISTINCT val) AS DOUBLE)",
        "distinct_ratio": "CAST(count(DISTINCT val) AS DOUBLE) / count(*)",
    }
    picked = {k: f"round(coalesce(w.{k}, 0), 6)" for k in whole}
    picked |= {k: f"round(coalesce(v.{k}, 0), 6)" for k in values}
    rounded = {k: f"round({e}, 6)" for k, e in {**names, **_POSITION}.items()}
    return over_long(
        _HEADERS + f""",
whole AS (SELECT file, position, {_select(whole)} FROM present GROUP BY file, position),
sampled AS (SELECT file, position, {_select(values)}
            FROM present WHERE rn <= 100 GROUP BY file, position)""",
        f"""SELECT h.file, h.col, {_select({**rounded, **picked})}
FROM headers h
LEFT JOIN whole w ON w.file = h.file AND w.position = h.position
LEFT JOIN sampled v ON v.file = h.file AND v.position = h.position""",
    )


def _amount_features_sql() -> str:
    name = "lower(trim(h.col))"
    names = {f"name_{w}": _flag(_any(name, w)) for w in ft.AMOUNT_WORDS + ft.FINANCE_WORDS}
    names |= {
        "name_paid_and_amt": _flag(f"{_any(name, 'paid')} AND {_any(name, 'amt')}"),
        "name_starts_amount": _flag(f"starts_with({name}, 'amount')"),
        "name_ends_amount": _flag(f"ends_with({name}, 'amount')"),
        "name_has_credit": _flag(_any(name, "credit")),
        "name_arabic": _flag(_any(name, *ft.ARABIC_AMOUNT_WORDS)),
        "name_combined": _flag(
            f"regexp_matches({name}, 'amount.*credit|credit.*amount|payment.*amount')"
        ),
    }

    def rate(condition: str) -> str:
        return f"CAST(count(*) FILTER ({condition}) AS DOUBLE) / count(*)"

    def of_numbers(condition: str) -> str:
        return f"CASE WHEN count(x) > 0 THEN CAST(count(*) FILTER ({condition}) AS DOUBLE) / count(x) END"

    values = {
        "numeric_ratio": "CAST(count(x) AS DOUBLE) / count(*)",
        "number_mean": "avg(x)",
        "number_median": "median(x)",
        "number_std": "stddev_pop(x)",
        "number_min": "min(x)",
        "number_max": "max(x)",
        "number_sum": "sum(x)",
        "positive_ratio": of_numbers("x > 0"),
        "zero_ratio": of_numbers("x = 0"),
        "negative_ratio": of_numbers("x < 0"),
        "has_decimal": rate("length(t) - length(replace(t, '.', '')) = 1"),
        "has_comma": rate("contains(t, ',')"),
        "has_currency": rate("regexp_matches(t, '[$€£¥₹]')"),
        "has_scientific": rate("regexp_matches(t, '[0-9]+[.]?[0-9]*[Ee][+-]?[0-9]+')"),
        "has_parentheses": rate("contains(t, '(') AND contains(t, ')')"),
        "has_minus": rate("starts_with(t, '-')"),
        "starts_digit": rate("regexp_matches(t, '^[0-9]')"),
        "short_text": rate("length(t) BETWEEN 1 AND 15"),
        "mostly_digits": rate("length(regexp_replace(t, '[^0-9]', '', 'g')) >= length(t) * 0.7"),
        "zero_text": rate("t IN ('0', '0.0', '0.00')"),
        "small_ratio": of_numbers("x > 0 AND x <= 100"),
        "medium_ratio": of_numbers("x > 100 AND x <= 10000"),
        "large_ratio": of_numbers("x > 10000"),
        "number_range": "max(x) - min(x)",
        "number_uniqueness":
            "CASE WHEN count(x) > 0 THEN CAST(count(DISTINCT x) AS DOUBLE) / count(x) END",
    }
    picked = {
        k: f"printf('%.9e', coalesce(v.{k}, 0::DOUBLE))"
        if k in BIG else f"round(coalesce(v.{k}, 0), 6)"
        for k in values
    }
    near = {k: f"h.{k}" for k in _CONTEXT_COLUMNS}
    more = {
        "paid_in_first_half": _flag(f"{_any(name, 'paid')} AND h.position < h.n_cols / 2"),
        "credit_in_second_half": _flag(f"{_any(name, 'credit')} AND h.position > h.n_cols / 2"),
        "summary_name": _flag(_any(name, "total", "sum", "net")),
    }
    rounded = {k: f"round({e}, 6)" for k, e in {**names, **_POSITION, **near, **more}.items()}
    text = "regexp_replace(translate(trim(val), ',$', ''), '\\s', '', 'g')"
    number = f"""CASE WHEN contains(lower(trim(val)), 'e')
      THEN CASE WHEN regexp_matches(trim(val), '{_NUMBER}') THEN try_cast(trim(val) AS DOUBLE) END
      WHEN regexp_matches({text}, '{_NUMBER}') THEN try_cast({text} AS DOUBLE) END"""
    return over_long(
        _HEADERS + _neighbour_ctes() + f""",
cells AS (SELECT file, position, trim(val) AS t, {number} AS x FROM present WHERE rn <= 100),
sampled AS (SELECT file, position, {_select(values)} FROM cells GROUP BY file, position)""",
        f"""SELECT h.file, h.col, {_select({**rounded, **picked})}
FROM context h LEFT JOIN sampled v ON v.file = h.file AND v.position = h.position""",
    )


_KEYWORDS = f"WITH keywords AS ({PART_KEYWORDS.replace('{part}', 'part')})\n"
_CHANGED = f"changes AS ({CHANGES.replace('{part}', 'part')})"
_LISTED = "keyword, file_type, language, priority, is_exact_match, description"
_CANDIDATE = _any("lower(col)", *pf.CANDIDATE_WORDS)
_GOOD = f"""length({_clean('keyword')}) > 0 AND length(keyword) <= 100
  AND file_type IN ('our', 'bank', 'both') AND priority BETWEEN 1 AND 100"""

ORACLES = {
    "column_profile": over_long(_profile_ctes(None), _PROFILE_SELECT),
    "column_profile_sample": over_long(_profile_ctes(100), _PROFILE_SELECT),
    "column_profile_merged": over_long("", f"""
SELECT position, n_cols, col, count(DISTINCT file) AS n_parts, count(val) AS non_null,
  count(*) FILTER (lower(val) NOT IN ('nan','none','null') AND trim(val) <> '') AS non_empty,
  CAST(coalesce(sum(length(trim(val))), 0) AS BIGINT) AS length_sum,
  count({_number('val')}) AS n_numeric, count(*) FILTER ({_number('val')} > 0) AS n_positive,
  CASE WHEN abs(avg({_number('val')})) < 1e9 THEN round(avg({_number('val')}), 4) END AS mean_value,
  count(DISTINCT val) AS n_distinct, true AS sketch_is_near
FROM long GROUP BY position, n_cols, col"""),
    "id_role_ours": over_long(
        _profile_ctes(100),
        f"SELECT file, position, col, {_our_id_score()} AS score FROM profile"
        " WHERE file LIKE 'ours%'",
    ),
    "id_role_bank": over_long(
        _profile_ctes(100),
        f"SELECT file, position, col, {_STATEMENT_ID_SCORE} AS score FROM profile",
    ),
    "amount_role": over_long(_AMOUNT_CTES, "SELECT file, position, col, score FROM scores"),
    "role_best": over_long(
        _AMOUNT_CTES, "SELECT file, position, col, score FROM ranked WHERE rnk = 1"
    ),
    "role_top3": over_long(
        _AMOUNT_CTES,
        "SELECT file, position, col, score, CAST(rnk AS INTEGER) AS rank FROM ranked WHERE rnk <= 3",
    ),
    "role_decision": over_long(
        _profile_ctes(100),
        f"""SELECT file, position,
  CASE WHEN file = 'plain_0.csv' THEN 'Description' ELSE col END AS col,
  CASE WHEN file = 'plain_0.csv' THEN 100 ELSE score END AS score, file = 'plain_0.csv' AS manual,
  CASE WHEN file <> 'plain_0.csv' AND score < 20 THEN 'reject' ELSE 'accept' END AS decision
FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, position) AS rnk
      FROM (SELECT *, {_STATEMENT_ID_SCORE} AS score FROM profile)) WHERE rnk = 1""",
    ),
    "keyword_scores": f"""WITH
part_names AS (SELECT concat_ws('_', p_type, p_name, p_brand) AS col FROM part),
table_words AS (SELECT DISTINCT keyword, priority, is_exact_match
                FROM ({PART_KEYWORDS.replace('{part}', 'part')}))
{_match_ctes('part_names', 'table_words')},
scored AS (
  SELECT col, CAST(sum(tenths) AS DOUBLE) / 10.0 AS score,
    string_agg(printf('%s:%s:%.1f', kind, keyword, tenths / 10.0), ','
      ORDER BY priority DESC, keyword DESC, kind DESC, tenths DESC) AS matches
  FROM points GROUP BY col)
SELECT DISTINCT p.col, coalesce(score, 0) AS score, coalesce(matches, '') AS matches
FROM part_names p LEFT JOIN scored s ON p.col = s.col""",
    "neighbour_context": over_long(
        _HEADERS + _neighbour_ctes(),
        f"SELECT file, position, col, {', '.join(_CONTEXT_COLUMNS)} FROM context",
    ),
    "id_features": _id_features_sql(),
    "amount_features": _amount_features_sql(),
    "amount_candidates": over_long(
        _HEADERS + f""",
head AS (SELECT *, row_number() OVER (PARTITION BY file, position ORDER BY ordinal) AS r
         FROM long WHERE {_CANDIDATE}),
head3 AS (SELECT *, row_number() OVER (PARTITION BY file, position ORDER BY ordinal) AS r3
          FROM head WHERE r <= 5 AND val IS NOT NULL),
stats AS (SELECT file, position, count(*) AS n_values, count({_number('val', ',$')}) AS n_numeric
          FROM head3 WHERE r3 <= 3 GROUP BY file, position)""",
        f"""SELECT h.file, h.position, h.col, coalesce(n_values, 0) AS n_values,
  coalesce(n_numeric, 0) AS n_numeric
FROM headers h LEFT JOIN stats s ON s.file = h.file AND s.position = h.position
WHERE {_CANDIDATE} AND coalesce(n_numeric, 0) >= coalesce(n_values, 0) * 0.7""",
    ),
    "header_listing": over_long(_HEADERS, "SELECT file, position, col FROM headers"),
    "keywords_list": _KEYWORDS + f"""SELECT {_LISTED} FROM keywords
WHERE file_type IN ('our', 'both') AND language IN ('en', 'both') AND is_active
ORDER BY priority DESC, keyword""",
    "keywords_search": _KEYWORDS + f"""SELECT id, {_LISTED} FROM keywords
WHERE is_active AND keyword ILIKE '%Bolt%' ORDER BY priority DESC, keyword""",
    "keyword_counts": _KEYWORDS + """SELECT file_type, count(*) AS n FROM keywords
WHERE is_active GROUP BY file_type""",
    "keywords_validate": f"""WITH {_CHANGED}
SELECT *, ({_GOOD}) AS ok FROM changes""",
    "keywords_changed": f"""{_KEYWORDS}, {_CHANGED}
SELECT k.id, k.keyword, k.file_type, k.language,
  CASE WHEN p.p_partkey % 4 = 0 THEN 99 ELSE k.priority END AS priority, k.is_exact_match,
  CASE WHEN p.p_size > 40 THEN false ELSE k.is_active END AS is_active, 'part' AS created_by,
  CASE WHEN p.p_partkey % 6 = 0 THEN 'changed' ELSE k.description END AS description
FROM keywords k JOIN part p ON k.id = p.p_partkey + 1
UNION ALL
SELECT CAST(id + (SELECT max(p_partkey) FROM part) AS INTEGER), lower(trim(keyword)), file_type,
  'en', priority, false, true, 'user', ''
FROM changes WHERE id > 1""",
}
