"""Row snapshots: a row as a text map, as JSON, and back to columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def record_map(columns: Iterable[str]) -> Column:
    """Map of column name to text value, nulls kept."""
    pairs = [x for name in columns for x in (F.lit(name), F.col(quoted(name)).cast("string"))]
    return F.create_map(*pairs)


def record_json(columns: Iterable[str]) -> Column:
    return F.to_json(record_map(columns), {"ignoreNullFields": "false"})


def records_to_columns(df: DataFrame, json_column: str, columns: Iterable[str]) -> DataFrame:
    """Rebuild a text table from JSON snapshots; rows without a snapshot are dropped."""
    names = list(columns)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    record = F.from_json(F.col(json_column), schema)
    return (
        df.where(F.col(json_column).isNotNull())
        .select(record.alias("record"))
        .select(*[F.col("record").getField(n).alias(n) for n in names])
    )
