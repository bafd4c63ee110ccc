"""Keyword text files: one `keyword,type,language,priority,exact,description` per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import strip

EXPORT_HEADER = [
    "# Amount keyword export",
    "# Format: keyword,file_type,language,priority,is_exact,description",
    "#",
]


def parse_keyword_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keyword rows and rejected lines of a table with a `value` column.

    Blank and `#` lines are skipped, lines with fewer than two fields are ignored as in
    an import, and a priority that is not an integer rejects its line.
    """
    text = strip(F.col("value"))
    rows = lines.where((F.length(text) > 0) & ~text.startswith("#"))
    fields = F.transform(F.split(text, ","), strip)
    rows = rows.select("value", fields.alias("f")).where(F.size("f") >= 2)

    def part(i: int, default: str) -> Column:
        return F.coalesce(F.get("f", F.lit(i)), F.lit(default))

    given = rows.select(
        "value",
        part(0, "").alias("keyword"),
        part(1, "").alias("file_type"),
        part(2, "en").alias("language"),
        part(3, "50").try_cast("int").alias("priority"),
        F.lower(part(4, "")).isin("true", "1", "yes").alias("is_exact_match"),
        part(5, "").alias("description"),
    )
    good = given.where(F.col("priority").isNotNull()).drop("value")
    bad = given.where(F.col("priority").isNull()).select("value")
    return good, bad


def read_keywords(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_keyword_lines(spark.read.text(path))


def keyword_lines(table: DataFrame) -> DataFrame:
    """Export lines of the active keywords, highest priority first."""
    exact = F.initcap(F.col("is_exact_match").cast("string"))
    line = F.concat_ws(
        ",", "keyword", "file_type", "language", F.col("priority").cast("string"), exact,
        F.coalesce("description", F.lit("")),
    )
    ordered = table.where("is_active").orderBy(F.desc("priority"), "keyword")
    return ordered.select(line.alias("value"))


def write_keywords(table: DataFrame, path: str) -> None:
    """Write the export lines under a comment header, in order.

    The sorted lines are range-partitioned: part files follow one another in name order
    and no single task holds the table.
    """
    spark = table.sparkSession
    header = spark.createDataFrame([(h,) for h in EXPORT_HEADER], "value string").coalesce(1)
    header.write.mode("overwrite").text(path)
    keyword_lines(table).write.mode("append").text(path)
