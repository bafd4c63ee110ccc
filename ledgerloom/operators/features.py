"""61 features per column for the learned detectors: names, values, position, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import lower_header, strip
from ledgerloom.functions.money import NUMBER, parse_number
from ledgerloom.operators.profile import HEADER, first_cells

# Header words of the ID features.
TRX_WORDS = ["bank", "trx", "transaction", "id", "ref", "reference"]
RELATED_WORDS = ["payment", "txn", "number", "no", "code", "key", "pay"]

# Shapes of ID values, matched from the start of the trimmed text.
ID_SHAPES = {
    "bank_code": r"^[A-Z]{2,5}\d{8,20}$",
    "no_prefix": r"^No\d{10,20}$",
    "ref_prefix": r"^Ref\w{8,20}$",
    "long_number": r"^\d{15,25}$",
    "scientific": r"^\d+\.?\d*[Ee][+-]?\d+$",
    "letters_digits": r"^[A-Z]+\d+[A-Z]*\d*$",
    "word": r"^\w{10,30}$",
    "upper_alnum": r"^[A-Z0-9]{8,25}$",
}
ID_PREFIXES = ["TB", "No", "Re", "PM"]
SEQUENCE = "012|123|234|345|456|567|678|789"

# Header words of the amount features.
AMOUNT_WORDS = ["amount", "amt", "paid", "payment", "credit", "debit", "value", "sum"]
FINANCE_WORDS = ["money", "cash", "total", "balance", "fee", "cost"]
ARABIC_AMOUNT_WORDS = ["دائن", "مدين"]
CURRENCY_SIGNS = "[$€£¥₹]"
NEAR_WORDS = {
    "near_trx": ["trx", "transaction", "id", "ref"],
    "near_date": ["date", "time", "created"],
    "near_bank": ["bank", "institution"],
    "near_name": ["name", "description", "memo"],
    "near_reference": ["ref", "reference", "number"],
}
NEAR_AMOUNT_WORDS = ["amount", "amt", "paid", "credit", "debit"]
SIMILAR_WORDS = ["amount", "amt", "paid", "credit", "total"]

# Python's \d and \w are Unicode-aware; Java's are with this flag.
_U = "(?U)"


def _has(c: Column, *words: str) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def _flag(condition: Column) -> Column:
    return condition.cast("double")


def _position_features() -> dict[str, Column]:
    pos, n = F.col("position"), F.col("n_cols")
    return {
        "position": pos.cast("double"),
        "relative_position": pos / F.greatest(n - 1, F.lit(1)),
        "is_first": _flag(pos == 0),
        "is_last": _flag(pos == n - 1),
        "in_first_half": _flag(pos < n / 2),
    }


def _id_name_features() -> dict[str, Column]:
    name = lower_header(F.col("col"))
    out = {f"name_{w}": _flag(_has(name, w)) for w in TRX_WORDS}
    out |= {f"name_{w}": _flag(_has(name, w)) for w in RELATED_WORDS}
    letters = name.rlike(r"\p{L}")
    return out | {
        "name_length": F.length(name).cast("double"),
        "name_underscores": (F.length(name) - F.length(F.translate(name, "_", ""))).cast("double"),
        "name_blanks": (F.length(name) - F.length(F.translate(name, " ", ""))).cast("double"),
        # The name is lower-cased, so "all upper case" never holds; kept for the layout.
        "name_upper": F.lit(0.0),
        # Lower case needs at least one cased letter: letters of caseless scripts do not count.
        "name_lower": _flag(letters & (F.upper(name) != name)),
        "name_digit": _flag(name.rlike(r"\p{Nd}")),
        "name_trx_and_id": _flag(_has(name, "trx") & _has(name, "id")),
        "name_bank_and_trx": _flag(_has(name, "bank") & _has(name, "trx", "id")),
        "name_starts_bank": _flag(name.startswith("bank")),
        "name_ends_id": _flag(name.endswith("id")),
        "name_ref_and_trx": _flag(_has(name, "ref") & _has(name, "trx", "transaction")),
        "name_trx_near_id": _flag(name.rlike("trx.*id|id.*trx")),
    }


def _rate(condition: Column, within: Column) -> Column:
    """Share of the sample rows `within` for which the condition holds."""
    return F.count_if(within & condition) / F.greatest(F.count_if(within), F.lit(1))


def _id_value_features() -> dict[str, Column]:
    v = F.col("val")
    t = F.col("text")
    length = F.length(t)
    sample = v.isNotNull() & (F.col("rn") <= 50)
    out = {
        "length_mean": F.avg(length),
        "length_std": F.stddev_pop(length),
        "length_min": F.min(length).cast("double"),
        "length_max": F.max(length).cast("double"),
        "has_letters": _rate(v.rlike(r"\p{L}"), sample),
        "has_digits": _rate(v.rlike(r"\p{Nd}"), sample),
        "has_special": _rate(v.rlike(r"[-_/\\()\[\]{}]"), sample),
        "has_long": _rate(length > 10, sample),
    }
    out |= {f"shape_{k}": _rate(t.rlike(_U + p), sample) for k, p in ID_SHAPES.items()}
    out |= {
        "first_letter": _rate(t.rlike(r"^\p{L}"), sample),
        "first_digit": _rate(t.rlike(r"^\p{Nd}"), sample),
        "last_letter": _rate(t.rlike(r"\p{L}$"), sample),
        "last_digit": _rate(t.rlike(r"\p{Nd}$"), sample),
    }
    out |= {f"prefix_{p}": _rate(t.startswith(p), sample) for p in ID_PREFIXES}
    return out | {
        "digit_run": _rate(t.rlike(_U + r"\d{5,}"), sample),
        "mixed_case": _rate(v.rlike(r"\p{Lu}") & v.rlike(r"\p{Ll}"), sample),
        "sequence": _rate(t.rlike(SEQUENCE), sample),
        "repeated": _rate(t.rlike(r"(.)\1{2,}"), sample),
    }


def id_features(long: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """61 ID-detection features per column; an empty column has zeros for its values.

    Count and distinct count cover the whole column, everything else its first values, which are
    those of `first` (profile.first_values) if it is given.
    """
    whole = (
        long.groupBy(*HEADER)
        .agg(
            F.count("val").cast("double").alias("value_count"),
            F.count_distinct("val").cast("double").alias("distinct_count"),
        )
        .withColumn("distinct_ratio", F.try_divide("distinct_count", "value_count"))
    )
    value = _id_value_features()
    sampled = (
        first_cells(long if first is None else first)
        .withColumn("text", strip(F.col("val")))
        .groupBy("file", "position")
        .agg(*[e.alias(n) for n, e in value.items()])
    )
    values = ["value_count", "distinct_count", "distinct_ratio", *value]
    base = whole.join(sampled, ["file", "position"]).fillna(0.0, values)
    return base.select(
        "file",
        "col",
        *[e.alias(n) for n, e in _id_name_features().items()],
        *values,
        *[e.alias(n) for n, e in _position_features().items()],
    )


def _numeric_neighbour() -> Column:
    """More than half of the first 20 values parse as numbers."""
    first = F.col("val").isNotNull() & (F.col("rn") <= 20)
    parsed = parse_number(F.col("val"), ",$").isNotNull()
    return F.count_if(first & parsed) > F.count_if(first) * 0.5


def _with_context(columns: DataFrame) -> DataFrame:
    """Add what surrounds each column to a table of columns with a `numeric` flag.

    Everything comes from windows over one file, as wide as its header: the two columns
    on either side from lag and lead, similarly named columns from the list of word masks.
    """
    name = F.lower("col")
    seen = F.struct(
        *[_has(name, *words).alias(k) for k, words in NEAR_WORDS.items()],
        _has(name, *NEAR_AMOUNT_WORDS).alias("near_amount"),
        F.coalesce("numeric", F.lit(False)).alias("numeric"),
    )
    mask = F.lit(0)
    for bit, word in enumerate(SIMILAR_WORDS):
        mask = mask.bitwiseOR(F.when(name.contains(word), 1 << bit).otherwise(0))
    by_position = W.partitionBy("file").orderBy("position")
    around = F.array(
        F.lag("seen", 2).over(by_position),
        F.lag("seen", 1).over(by_position),
        F.lead("seen", 1).over(by_position),
        F.lead("seen", 2).over(by_position),
    )
    placed = columns.withColumns({"seen": seen, "mask": mask}).withColumns(
        {
            "near": F.filter(around, lambda s: s.isNotNull()),
            "masks": F.collect_list("mask").over(W.partitionBy("file")),
        }
    )
    any_near = lambda field: F.exists("near", lambda s: s[field])
    amounts = F.size(F.filter("near", lambda s: s["near_amount"]))
    similar = F.size(F.filter("masks", lambda other: other.bitwiseAND(F.col("mask")) != 0))
    others = similar - F.when(F.col("mask") != 0, 1).otherwise(0)
    return placed.withColumns(
        {
            **{k: _flag(any_near(k)) for k in NEAR_WORDS},
            "near_amounts": F.least(amounts, F.lit(5)).cast("double"),
            "only_numeric": _flag(~any_near("numeric")),
            "similar_names": F.least(others, F.lit(5)).cast("double"),
        }
    ).drop("seen", "mask", "near", "masks", "numeric")


def neighbour_context(long: DataFrame) -> DataFrame:
    """What the two columns on either side of each column look like, and how many other
    columns of the file share a money word with it, up to 5."""
    columns = first_cells(long, 20).groupBy(*HEADER).agg(_numeric_neighbour().alias("numeric"))
    return _with_context(columns)


def _amount_name_features() -> dict[str, Column]:
    name = lower_header(F.col("col"))
    out = {f"name_{w}": _flag(_has(name, w)) for w in AMOUNT_WORDS + FINANCE_WORDS}
    return out | {
        "name_paid_and_amt": _flag(_has(name, "paid") & _has(name, "amt")),
        "name_starts_amount": _flag(name.startswith("amount")),
        "name_ends_amount": _flag(name.endswith("amount")),
        "name_has_credit": _flag(_has(name, "credit")),
        "name_arabic": _flag(_has(name, *ARABIC_AMOUNT_WORDS)),
        "name_combined": _flag(name.rlike("amount.*credit|credit.*amount|payment.*amount")),
    }


def _amount_number(text: Column) -> Column:
    """Value of an amount sample: only commas, dollar signs and blanks are dropped, and
    scientific notation is taken as it stands."""
    plain = F.regexp_replace(F.translate(text, ",$", ""), _U + r"\s", "")
    t = F.when(F.lower(text).contains("e"), text).otherwise(plain)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def _amount_value_features() -> dict[str, Column]:
    t, x = F.col("text"), F.col("number")
    n = F.greatest(F.count("val"), F.lit(1))
    rate = lambda condition: F.count_if(condition) / n
    of_numbers = lambda condition: F.try_divide(F.count_if(condition), F.count(x))
    digits = F.length(F.regexp_replace(t, _U + r"\D", ""))
    return {
        "numeric_ratio": F.count(x) / n,
        "number_mean": F.avg(x),
        "number_median": F.median(x),
        "number_std": F.stddev_pop(x),
        "number_min": F.min(x),
        "number_max": F.max(x),
        "number_sum": F.sum(x),
        "positive_ratio": of_numbers(x > 0),
        "zero_ratio": of_numbers(x == 0),
        "negative_ratio": of_numbers(x < 0),
        "has_decimal": rate(F.length(t) - F.length(F.translate(t, ".", "")) == 1),
        "has_comma": rate(t.contains(",")),
        "has_currency": rate(t.rlike(CURRENCY_SIGNS)),
        "has_scientific": rate(t.rlike(_U + r"\d+\.?\d*[Ee][+-]?\d+")),
        "has_parentheses": rate(t.contains("(") & t.contains(")")),
        "has_minus": rate(t.startswith("-")),
        "starts_digit": rate(t.rlike(r"^\p{Nd}")),
        "short_text": rate(F.length(t).between(1, 15)),
        "mostly_digits": rate(digits >= F.length(t) * 0.7),
        "zero_text": rate(t.isin("0", "0.0", "0.00")),
        "small_ratio": of_numbers((x > 0) & (x <= 100)),
        "medium_ratio": of_numbers((x > 100) & (x <= 10000)),
        "large_ratio": of_numbers(x > 10000),
        "number_range": F.max(x) - F.min(x),
        "number_uniqueness": F.try_divide(F.count_distinct(x), F.count(x)),
    }


def amount_features(long: DataFrame) -> DataFrame:
    """61 amount-detection features per column."""
    value = _amount_value_features()
    columns = (
        first_cells(long)
        .withColumn("text", strip(F.col("val")))
        .withColumn("number", _amount_number(F.col("text")))
        .groupBy(*HEADER)
        .agg(_numeric_neighbour().alias("numeric"), *[e.alias(n) for n, e in value.items()])
        .fillna(0.0, list(value))
    )
    name = lower_header(F.col("col"))
    pos, n = F.col("position"), F.col("n_cols")
    near = [*NEAR_WORDS, "near_amounts", "only_numeric", "similar_names"]
    more = {
        "paid_in_first_half": _flag(_has(name, "paid") & (pos < n / 2)),
        "credit_in_second_half": _flag(_has(name, "credit") & (pos > n / 2)),
        "summary_name": _flag(_has(name, "total", "sum", "net")),
    }
    return _with_context(columns).select(
        "file",
        "col",
        *[e.alias(k) for k, e in _amount_name_features().items()],
        *value,
        *[e.alias(k) for k, e in _position_features().items()],
        *near,
        *[e.alias(k) for k, e in more.items()],
    )


def feature_names(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in ("file", "col")]
