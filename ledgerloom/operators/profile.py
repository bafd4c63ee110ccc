"""Column profiling over a long table of values.

The long form holds one row per cell: (file, ordinal, position, n_cols, col, val). Every
operator groups by (file, position, col), so one job profiles a whole directory of
files; a single file is the one-group case.

Operators on first values need not see every cell. Before cells are exploded, a table has one row
per row with its cells in an array: (file, ordinal, names, vals). first_values takes from it the few
cells that the others go by; its result is a long table like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import strip
from ledgerloom.functions.ids import NULL_TOKENS
from ledgerloom.functions.money import parse_number
from ledgerloom.functions.records import quoted
from ledgerloom.operators.skew import first_per_group, sized
from ledgerloom.sources.store import checkpoint_dir

COLUMN = ["file", "position", "col"]
HEADER = [*COLUMN, "n_cols"]
SAMPLE_ROWS = 100
SKETCH = 14          # binary logarithm of a sketch's registers
SLACK = 4            # leading rows looked at for each value of a sample
FEW_BOUNDS = 32      # groups whose bounds are a condition instead of a join


def to_long(
    df: DataFrame,
    columns: list[str] | None = None,
    *,
    file: Column | None = None,
    order: Column | None = None,
    only: list[str] | None = None,
) -> DataFrame:
    """One row per cell, values as text; `file` and `ordinal` default to columns of that name.

    `only` leaves out the cells of other columns, which then are not read.
    """
    columns = columns or [c for c in df.columns if c not in ("file", "ordinal")]
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("col"),
                F.col(quoted(name)).cast("string").alias("val"),
            )
            for i, name in enumerate(columns)
            if only is None or name in only
        ]
    )
    return df.select(
        (F.col("file") if file is None else file).alias("file"),
        (F.col("ordinal") if order is None else order).alias("ordinal"),
        F.lit(len(columns)).alias("n_cols"),
        F.inline(cells),
    )


def to_rows(
    df: DataFrame, columns: list[str] | None = None, *, file: Column | None = None,
    order: Column | None = None,
) -> DataFrame:
    """One row per row with its cells as text in an array: (file, ordinal, names, vals)."""
    columns = columns or [c for c in df.columns if c not in ("file", "ordinal")]
    return df.select(
        (F.col("file") if file is None else file).alias("file"),
        (F.col("ordinal") if order is None else order).alias("ordinal"),
        F.array(*[F.lit(c) for c in columns]).alias("names"),
        F.array(*[F.col(quoted(c)).cast("string") for c in columns]).alias("vals"),
    )


def _cells() -> Column:
    """The cells of a row (names, vals), null ones too."""
    return F.transform("names", lambda name, i: F.struct(
        i.alias("position"), name.alias("col"), F.get("vals", i).alias("val")))


def explode_rows(rows: DataFrame) -> DataFrame:
    """The long form of rows (file, ordinal, names, vals)."""
    return rows.select("file", "ordinal", F.size("names").alias("n_cols"), F.inline(_cells()))


def headers(table: DataFrame) -> DataFrame:
    """(file, position, n_cols, col) of every column, also of empty ones: of cells in long form, or
    of rows (file, ordinal, names, vals), whose cells then are not looked at."""
    if "names" in table.columns:
        table = table.select("file", "names").distinct().select(
            "file", F.size("names").alias("n_cols"), F.posexplode("names").alias("position", "col"))
    return table.select("file", "position", "n_cols", "col").distinct()


def _bounds(df: DataFrame, keys: list[str], n: int, head: Column | None) -> DataFrame:
    """(keys, _upto, _part): an ordinal up to which each group has at least n rows, and whether
    there are others; a row for each group.

    Between the least and the greatest ordinal of a group its rows are taken to be spread evenly.
    Where they are not numbered without a gap that is checked by counting, and a group that has too
    few is taken whole. head marks rows that come before all others of their group.
    """
    checkpoint_dir(df.sparkSession)
    at, reach = F.col("ordinal"), SLACK * n
    inside = F.lit(True) if head is None else head
    found = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min(at).alias("low"), F.max(at).alias("high"),
        F.count_if(inside).alias("head_rows"), F.max(F.when(inside, at)).alias("head_high"))
    whole = (F.col("rows") <= reach) | (F.col("head_rows") < reach)
    span = F.col("head_high") - F.col("low")
    kind = df.schema["ordinal"].dataType
    upto = F.col("low") + F.ceil(
        span.cast("double") * reach / F.greatest("head_rows", F.lit(1))).cast(kind)
    found = found.select(
        *keys, "high", F.when(whole, F.col("high")).otherwise(upto.cast(kind)).alias("_upto"),
        (~whole).alias("_part"), (~whole & (span + 1 != F.col("head_rows"))).alias("uneven"),
    ).checkpoint()
    uneven = found.where("uneven").select(*keys, "_upto")
    if not uneven.isEmpty():
        seen = df.join(sized(uneven), keys).where("ordinal <= _upto").groupBy(*keys).agg(
            F.count(F.lit(1)).alias("seen"))
        few = F.col("uneven") & (F.coalesce("seen", F.lit(0)) < n)
        found = found.join(seen, keys, "left").select(
            *keys, F.when(few, F.col("high")).otherwise(F.col("_upto")).alias("_upto"),
            (F.col("_part") & ~few).alias("_part")).checkpoint()
    return found.select(*keys, "_upto", "_part")


def _up_to(df: DataFrame, keys: list[str], bounds: DataFrame) -> DataFrame:
    """Rows up to the bound of their group. Few bounds become a condition on the rows, which is
    tested before their cells are made; a join would come after that."""
    bounds = bounds.select(*keys, "_upto")
    few = bounds.limit(FEW_BOUNDS + 1).collect()
    if len(few) > FEW_BOUNDS or any(x is None for row in few for x in row):
        return df.join(sized(bounds), keys).where("ordinal <= _upto").drop("_upto")
    kind = bounds.schema["_upto"].dataType
    inside = F.lit(False)
    for row in few:
        here = F.col("ordinal") <= F.lit(row["_upto"]).cast(kind)
        for k in keys:
            here = here & (F.col(k) == F.lit(row[k]))
        inside = inside | here
    return df.where(inside)


def leading_rows(rows: DataFrame, n: int, head: Column | None = None) -> DataFrame:
    """Rows that come first in their file: at least the first n of each that has as many, and few
    more. Hash aggregates alone tell which."""
    return _up_to(rows, ["file"], _bounds(rows, ["file"], n, head))


def first_values(rows: DataFrame, n: int = SAMPLE_ROWS, head: Column | None = None) -> DataFrame:
    """Cells of rows (file, ordinal, names, vals) in long form, few of each column: its first n
    filled ones, and a null one if it has fewer.

    The leading rows of a file hold n values of every dense column. Only files that have columns
    still short are read through, and of those columns only filled cells. What is sorted is a few
    times n cells of a column, whatever the size of its file.
    """
    bounds = _bounds(rows, ["file"], n, head)
    cells = explode_rows(_up_to(rows, ["file"], bounds))
    top = first_cells(cells, n).drop("rn").checkpoint()
    short = top.groupBy("file", "position").agg(F.count("val").alias("n_values")).where(
        F.col("n_values") < n).join(sized(bounds.where("_part").select("file")), "file")
    short = short.groupBy("file").agg(F.collect_set("position").alias("_short")).checkpoint()
    if short.isEmpty():
        return top
    cells = F.transform("_short", lambda i: F.struct(
        i.alias("position"), F.get("names", i).alias("col"), F.get("vals", i).alias("val")))
    through = rows.join(sized(short), "file").select(
        "file", "ordinal", F.size("names").alias("n_cols"), F.inline(cells)).where(
        F.col("val").isNotNull())
    keys = ["file", "position"]
    ends = _bounds(through, keys, n, None)
    if ends.isEmpty():
        return top                       # no more values anywhere
    again = first_cells(_up_to(through, keys, ends), n).drop("rn")
    columns = sized(short.select("file", F.explode("_short").alias("position")))
    return top.join(columns, keys, "left_anti").unionByName(
        top.where(F.col("val").isNull()).join(columns, keys, "left_semi")).unionByName(again)


def first_cells(long: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """First `n` cells of every column, filled ones before nulls, ranked from 1 in `rn`.

    Nulls only fill up what a sparse column lacks, so every column is present and one
    pass gives both the headers and the first `n` non-null values. Consumers ignore nulls.
    """
    order = [F.col("val").isNull(), F.col("ordinal")]
    return first_per_group(long, ["position", "file"], order, n, rank="rn")


def value_counts(cells: DataFrame) -> DataFrame:
    """(file, position, col, n_cols, val, n): how often each value stands in each column, nulls
    too. What is told from a value is then told once, and the one shuffle, by column and value,
    carries a value's text and a count."""
    return cells.groupBy(*HEADER, "val").agg(F.count(F.lit(1)).alias("n"))


def _measures(distinct: Column) -> list[Column]:
    """Measures of measured cells (val, number, length), each of which stands `n` times."""
    v, n = F.col("val"), F.col("n")
    number = F.col("number")
    # A token with blanks around it counts as filled; a blank cell does not.
    token = (F.octet_length(v) <= 4) & F.lower(v).isin(*NULL_TOKENS)
    filled = (F.col("length") > 0) & ~token
    times = lambda condition: F.sum(F.when(condition, n).otherwise(0))
    return [
        times(v.isNotNull()).alias("non_null"),
        times(filled).alias("non_empty"),
        distinct,
        F.coalesce(F.sum(F.col("length") * n), F.lit(0)).alias("length_sum"),
        times(number.isNotNull()).alias("n_numeric"),
        times(number > 0).alias("n_positive"),
        F.coalesce(F.sum(number * n), F.lit(0.0)).alias("number_sum"),
    ]


def _rated(profile: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return profile.select(
        "*",
        ratio("n_distinct", "non_empty").alias("uniqueness"),
        ratio("length_sum", "non_null").alias("mean_length"),
        ratio("n_numeric", "non_null").alias("numeric_ratio"),
        ratio("n_positive", "n_numeric").alias("positive_ratio"),
    )


def column_profile(
    long: DataFrame, sample: int | None = SAMPLE_ROWS, *, approximate_distinct: bool | None = None
) -> DataFrame:
    """Profile of every column over its first `sample` values, or over all of them.

    Distinct values of a sample are counted. Those of whole columns are estimated by a sketch of
    fixed size for each column, about one percent off, unless `approximate_distinct` is False:
    counting them shuffles the columns once, by column and value, so that a large one is not one
    task's work.
    """
    if approximate_distinct is None:
        approximate_distinct = not sample
    cells = first_cells(long, sample) if sample else long
    if approximate_distinct:
        return profile_of(profile_parts(cells))
    return counted_profile(value_counts(cells))


def counted_profile(counts: DataFrame) -> DataFrame:
    """The profile of columns from their value_counts, distinct values counted."""
    distinct = F.count("val").alias("n_distinct")
    return _rated(_with_mean(_measured(counts).groupBy(*HEADER).agg(*_measures(distinct))))


def _measured(cells: DataFrame) -> DataFrame:
    v = F.col("val")
    return cells.withColumns({"number": parse_number(v), "length": F.length(strip(v))})


def _with_mean(profile: DataFrame) -> DataFrame:
    mean = F.when(F.col("n_numeric") > 0, F.col("number_sum") / F.col("n_numeric"))
    return profile.withColumn("mean_value", mean).drop("number_sum")


def profile_parts(cells: DataFrame) -> DataFrame:
    """A profile of every column in a form that can be merged: counts, sums and a sketch of its
    distinct values. It may be stored, so that new files of a directory are profiled alone. It
    takes cells in long form, or their value_counts, which hold a cell `n` times."""
    if "n" not in cells.columns:
        cells = cells.withColumn("n", F.lit(1))
    sketch = F.hll_sketch_agg("val", SKETCH).alias("sketch")
    return _measured(cells).groupBy(*HEADER).agg(*_measures(sketch))


def merged_parts(parts: DataFrame, *keys: str) -> DataFrame:
    """profile_parts of several files as one, by other columns than the file: those of a header
    over a whole directory, for example."""
    counts = ["non_null", "non_empty", "length_sum", "n_numeric", "n_positive", "number_sum"]
    return parts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_parts"), *[F.sum(c).alias(c) for c in counts],
        F.hll_union_agg("sketch").alias("sketch"))


def profile_of(parts: DataFrame) -> DataFrame:
    """The profile that parts, merged or not, make."""
    distinct = F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0))
    return _rated(_with_mean(parts.withColumn("n_distinct", distinct).drop("sketch")))


# Words that make a header an amount candidate.
CANDIDATE_WORDS = [
    "paid amt", "amount", "amt", "credit", "payment", "value",
    "money", "sum", "total", "balance", "debit", "دائن",
]
CANDIDATE_ROWS = 5
CANDIDATE_VALUES = 3


def amount_candidates(long: DataFrame) -> DataFrame:
    """Columns worth labelling as amount: money word in the header and at least 70% of
    the first 3 values of the first 5 rows numeric."""
    money = F.lit(False)
    for word in CANDIDATE_WORDS:
        money = money | F.lower("col").contains(word)
    # The first five rows count null cells too; the values are those left non-null.
    top = first_per_group(
        long.where(money), ["position", "file"], [F.col("ordinal")], CANDIDATE_ROWS, rank="row_rank"
    )
    by_column = W.partitionBy(*COLUMN).orderBy("row_rank")  # at most 5 rows
    counted = top.withColumn("nth", F.count("val").over(by_column))
    used = F.col("val").isNotNull() & (F.col("nth") <= CANDIDATE_VALUES)
    numeric = parse_number(F.col("val"), ",$").isNotNull()
    stats = counted.groupBy(*COLUMN).agg(
        F.count_if(used).alias("n_values"), F.count_if(used & numeric).alias("n_numeric")
    )
    return stats.where(F.col("n_numeric") >= F.col("n_values") * 0.7)


def header_listing(table: DataFrame, files: int | None = None) -> DataFrame:
    """Columns of every file, for labelling, or of the first `files` files by name; table is cells,
    rows or a list of headers such as CsvFiles.columns()."""
    listing = headers(table).select(*COLUMN)
    if files is None:
        return listing
    first = listing.select("file").distinct().orderBy("file").limit(files)
    return listing.join(F.broadcast(first), "file")  # at most `files` rows
