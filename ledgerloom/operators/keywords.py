"""The amount-keyword table: seed, lookups, change sets and validation.

Changes are batches: each operator takes the current table and a table of changes and
returns the next snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import clean_header, strip

SCHEMA = (
    "id int, keyword string, file_type string, language string, priority int, "
    "is_exact_match boolean, is_active boolean, created_at timestamp, updated_at timestamp, "
    "created_by string, description string"
)
UPDATABLE = [
    "keyword", "file_type", "language", "priority", "is_exact_match", "description", "is_active",
]
FILE_TYPES = ["our", "bank", "both"]
LISTED = ["keyword", "file_type", "language", "priority", "is_exact_match", "description"]
MAX_KEYWORD = 100

# Keyword, file type, language, priority, exact, description.
SEED = [
    ("paid amt", "our", "en", 100, True, "Primary amount column for internal files"),
    ("paidamt", "our", "en", 95, True, "Alternative format for paid amount"),
    ("paid_amt", "our", "en", 95, True, "Underscore format for paid amount"),
    ("payment amount", "our", "en", 90, False, "Common payment amount column"),
    ("amount paid", "our", "en", 85, False, "Alternative paid amount format"),
    ("credit", "bank", "en", 100, True, "Primary credit column for bank files"),
    ("credit دائن", "bank", "ar", 100, True, "Arabic credit column for bank files"),
    ("payment amount", "bank", "en", 90, False, "Payment amount in bank files"),
    ("credit amount", "bank", "en", 85, False, "Credit amount column"),
    ("amount_credited", "bank", "en", 80, False, "Amount credited column"),
    ("amount", "both", "en", 75, False, "General amount column"),
    ("amt", "both", "en", 70, False, "Abbreviated amount"),
    ("value", "both", "en", 65, False, "Value amount column"),
    ("sum", "both", "en", 60, False, "Sum amount column"),
    ("total", "both", "en", 60, False, "Total amount column"),
    ("money", "both", "en", 55, False, "Money amount column"),
    ("cash", "both", "en", 55, False, "Cash amount column"),
    ("balance", "both", "en", 50, False, "Balance amount column"),
    ("debit", "both", "en", 45, False, "Debit amount column"),
    ("debit amount", "both", "en", 40, False, "Debit amount column"),
    ("دائن", "bank", "ar", 90, False, "Arabic credit term"),
    ("مدين", "bank", "ar", 45, False, "Arabic debit term"),
    ("dollar amount", "both", "en", 55, False, "Dollar amount column"),
    ("euro amount", "both", "en", 55, False, "Euro amount column"),
    ("pound amount", "both", "en", 55, False, "Pound amount column"),
    ("transaction amount", "both", "en", 70, False, "Transaction amount"),
    ("txn amount", "both", "en", 65, False, "Transaction amount abbreviated"),
    ("trx amount", "both", "en", 65, False, "Transaction amount abbreviated"),
    ("net amount", "both", "en", 60, False, "Net amount column"),
    ("gross amount", "both", "en", 60, False, "Gross amount column"),
]

# Keywords used when the table offers none, per file type.
FALLBACK_OURS = [
    ("paid amt", 100, True),
    ("paidamt", 95, True),
    ("paid_amt", 95, True),
    ("payment amount", 90, False),
    ("amount paid", 85, False),
]
FALLBACK_BANK = [
    ("credit", 100, True),
    ("credit دائن", 100, True),
    ("payment amount", 90, False),
    ("credit amount", 85, False),
    ("amount", 75, False),
    ("value", 65, False),
    ("sum", 60, False),
    ("total", 60, False),
]


def seed_keywords(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(SEED, 1)]
    columns = (
        "id int, keyword string, file_type string, language string, priority int, "
        "is_exact_match boolean, description string"
    )
    now = F.current_timestamp()
    return spark.createDataFrame(rows, columns).select(
        "id", "keyword", "file_type", "language", "priority", "is_exact_match",
        F.lit(True).alias("is_active"), now.alias("created_at"), now.alias("updated_at"),
        F.lit("system_init").alias("created_by"), "description",
    )


def select_keywords(
    table: DataFrame,
    file_type: str | None = None,
    language: str | None = None,
    active_only: bool = True,
) -> DataFrame:
    """Rows of a file type and language, `both` included, without an order."""
    out = table
    if file_type:
        out = out.where(F.col("file_type").isin(file_type, "both"))
    if language:
        out = out.where(F.col("language").isin(language, "both"))
    return out.where("is_active") if active_only else out


def list_keywords(table: DataFrame, *args, **kwargs) -> DataFrame:
    """Selected keywords, highest priority first."""
    return select_keywords(table, *args, **kwargs).select(*LISTED).orderBy(
        F.desc("priority"), "keyword"
    )


def search_keywords(table: DataFrame, term: str) -> DataFrame:
    """Active keywords containing the term in any case; % and _ are wildcards."""
    return (
        table.where(F.col("is_active") & F.col("keyword").ilike(f"%{term}%"))
        .select("id", *LISTED)
        .orderBy(F.desc("priority"), "keyword")
    )


def valid_keyword() -> Column:
    return (
        F.coalesce(F.length(clean_header(F.col("keyword"))) > 0, F.lit(False))
        & (F.length("keyword") <= MAX_KEYWORD)
        & F.coalesce(F.col("file_type").isin(*FILE_TYPES), F.lit(False))
        & F.coalesce(F.col("priority").between(1, 100), F.lit(True))
    )


def validate_keywords(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Acceptable and rejected rows of a change set."""
    return changes.where(valid_keyword()), changes.where(~valid_keyword())


def add_keywords(table: DataFrame, added: DataFrame, created_by: str = "user") -> DataFrame:
    """Next snapshot with new keywords; rows whose id is taken are left out.

    Keywords are lower-cased and trimmed; missing language, priority and exact flag
    become en, 50 and false.
    """
    now = F.current_timestamp()
    has = set(added.columns)
    default = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in has else F.lit(v)
    fresh = added.join(table.select("id"), "id", "left_anti").select(
        F.col("id").cast("int").alias("id"),
        F.lower(strip(F.col("keyword"))).alias("keyword"),
        "file_type",
        default("language", "en").alias("language"),
        default("priority", 50).cast("int").alias("priority"),
        default("is_exact_match", False).alias("is_exact_match"),
        F.lit(True).alias("is_active"),
        now.alias("created_at"),
        now.alias("updated_at"),
        F.lit(created_by).alias("created_by"),
        default("description", "").alias("description"),
    )
    return table.unionByName(fresh)


def update_keywords(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Next snapshot with changed fields; a null or absent field keeps its value.

    `changes` has one row per id. Rows that change get a new `updated_at`.
    """
    fields = [c for c in UPDATABLE if c in changes.columns]
    new = changes.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in fields])
    merged = table.join(new, "id", "left")
    updated = merged.withColumns(
        {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields}
        | {"updated_at": F.when(F.col("_hit"), F.current_timestamp()).otherwise(F.col("updated_at"))}
    )
    return updated.select(*table.columns)


def delete_keywords(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Next snapshot with the given ids deactivated."""
    return update_keywords(table, ids.select("id", F.lit(False).alias("is_active")))


def keyword_counts(table: DataFrame) -> DataFrame:
    """Active keywords per file type."""
    return table.where("is_active").groupBy("file_type").agg(F.count(F.lit(1)).alias("n"))


def detection_keywords(table: DataFrame | None, file_type: str, spark: SparkSession) -> DataFrame:
    """(keyword, priority, is_exact_match) for scoring; the fallback list when empty."""
    rows = FALLBACK_OURS if file_type == "our" else FALLBACK_BANK
    fallback = spark.createDataFrame(
        rows, "keyword string, priority int, is_exact_match boolean"
    )
    if table is None:
        return fallback
    kind = None if file_type == "unknown" else file_type
    chosen = select_keywords(table, kind).select("keyword", "priority", "is_exact_match")
    return chosen.unionByName(fallback.where(~chosen.exists()))
