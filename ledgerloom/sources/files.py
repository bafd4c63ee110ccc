"""CSV ledgers and statements: encoding, headers, row order, bad rows and column types.

A path is read in two scans. The first takes its files as text and makes a row for each: its
header, how many of its lines are not valid UTF-8, and the most fields of any line. The second is
one CSV scan of all files, whatever their headers and encodings; rows find their header by path.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal
from functools import cached_property
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.money import DEFAULT_MONEY, Money, is_number, parse_amount, parse_number
from ledgerloom.functions.records import quoted
from ledgerloom.operators.profile import (
    COLUMN, SAMPLE_ROWS, explode_rows, first_cells, first_values,
)
from ledgerloom.sources.store import checkpoint_dir

FILE_GLOB = "*.csv"
FALLBACK_ENCODING = "ISO-8859-1"
BYTES = "ISO-8859-1"         # read so, a text has a character for each byte of the file
ORDINAL = "ordinal"
FILE = "file"
LINE = "_line"
BLOCK_ROWS = 10 ** 10        # an ordinal is (file, block, row), the row below this
FILE_ROWS = 10 ** 25         # and block and row below this
BROADCAST_FILES = 100_000    # files whose headers are broadcast; more meet their rows by a shuffle
BAD_ROWS = ("reject", "fail", "keep")

# Header texts that mark ID and amount columns.
ID_WORDS = [
    "trx", "transaction", "ref", "reference", "bank_trx_id", "transaction_id",
    "payment_ref", "bank_ref", "transaction_reference",
]
AMOUNT_WORDS = [
    "amount", "amt", "value", "sum", "total", "credit", "debit", "balance",
    "paid", "received", "payment", "fee", "charge", "cost", "price",
]

# Standard quoting of CSV: a quote inside quotes is doubled.
QUOTING = {"quote": '"', "escape": '"'}

# Texts that stand for a missing cell.
NA_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def file_path(encoded: Column | None = None) -> Column:
    """Path of the file a row comes from; the metadata column is percent-encoded."""
    encoded = F.col("_metadata.file_path") if encoded is None else encoded
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def scan_text(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Lines of text files with file path as the scan has it (percent-encoded: file_path decodes
    it), block start and a row number within the task."""
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("encoded"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )


def _unquoted(line: Column, sep: str) -> Column:
    """The line without doubled quotes and without its quoted fields."""
    s = f"\\Q{sep}\\E"
    closed = F.regexp_replace(
        F.replace(line, F.lit('""'), F.lit("")), f'(^|{s})"[^"]*"(?={s}|\\z)', "$1")
    return F.when(F.contains(line, F.lit('"')), closed).otherwise(line)


def has_open_quote(line: Column, sep: str = ",") -> Column:
    """Whether a field of a CSV line begins with a quote that is never closed."""
    opened = F.regexp_like(_unquoted(line, sep), F.lit(f'(^|\\Q{sep}\\E)"[^"]*\\z'))
    return F.contains(line, F.lit('"')) & opened


def n_fields(line: Column, sep: str = ",") -> Column:
    """Fields of a CSV line: one more than its separators outside of quoted fields."""
    plain = F.when(F.contains(line, F.lit('"')), F.regexp_replace(
        _unquoted(line, sep), f'(^|\\Q{sep}\\E)"[^"]*\\z', "$1")).otherwise(line)
    without = F.replace(plain, F.lit(sep), F.lit(""))
    return ((F.octet_length(plain) - F.octet_length(without)) / len(sep.encode()) + 1).cast("int")


def header_names(header: Column, sep: str = ",") -> Column:
    """Column names of a header line, made unique as safe_names does."""
    s = f"\\Q{sep}\\E"
    cut = F.regexp_extract_all(F.concat(F.lit(sep), header),
                               F.lit(f'{s}("(?:[^"]|"")*"|(?:(?!{s}).)*)'), F.lit(1))
    plain = F.transform(cut, lambda f: F.when(f.startswith('"'), F.replace(
        F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))
    named = F.transform(plain, lambda f, i: F.when(f == "", F.concat(
        F.lit("Unnamed: "), i.cast("string"))).otherwise(f))

    def unique(names: Column, f: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(names, F.lit(1), i), lambda x: x == f))
        return F.when(before > 0, F.concat(f, F.lit("."), before.cast("string"))).otherwise(f)

    return F.transform(named, lambda f, i: unique(named, f, i))


def file_headers(
    spark: SparkSession, path: str | list[str], glob: str | None = FILE_GLOB,
    fallback: str = FALLBACK_ENCODING, sep: str = ",",
) -> DataFrame:
    """(path, header, n_lines, n_invalid, most_fields, n_open, encoding, encoded) of every file, in
    one scan; encoded is the path as scans have it, and is decoded once a file.

    header is the first line that is not blank; most_fields and n_open, lines with an open quote,
    go by lines as they are, so quoted line breaks mislead them. The encoding is UTF-8 unless some line is not valid, then the fallback.
    Grouping by path keeps a line a file in each task; collecting the marks of invalid lines, of
    which there is one, keeps the aggregate hash-based.
    """
    line = F.col("value")
    bad = ~F.is_valid_utf8(line)
    filled = F.trim(line) != ""
    first = F.when(filled & (F.col("block") == 0), F.col("seq"))
    found = scan_text(spark, path, glob).groupBy("encoded").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(bad).alias("n_invalid"),
        F.max(F.when(filled, n_fields(line, sep))).alias("most_fields"),
        F.count_if(has_open_quote(line, sep)).alias("n_open"),
        F.min_by(line, first).alias("header"), F.collect_set(F.when(bad, F.lit(1))).alias("marks"))
    broken = F.size("marks") > 0
    header = F.when(broken, F.decode(F.col("header").cast("binary"), fallback)).otherwise(
        F.col("header"))
    return found.select(
        file_path(F.col("encoded")).alias("path"),
        F.regexp_replace(header, "^\ufeff", "").alias("header"), "n_lines", "n_invalid",
        "most_fields", "n_open", F.when(broken, fallback).otherwise("UTF-8").alias("encoding"),
        "encoded")


def encodings(
    spark: SparkSession, path: str | list[str], fallback: str = FALLBACK_ENCODING,
    glob: str | None = FILE_GLOB,
) -> DataFrame:
    """Encoding per file: UTF-8 unless some line is not valid UTF-8, then the fallback."""
    return file_headers(spark, path, glob, fallback).select(
        "path", "n_lines", "n_invalid", "encoding")


def header_lines(spark: SparkSession, path: str | list[str], glob: str | None = FILE_GLOB) -> DataFrame:
    """First line of every file found under a path that has one."""
    found = file_headers(spark, path, glob)
    return found.where(F.col("header").isNotNull()).select("path", "header")


def base_name(file: Column) -> Column:
    """File name of a path, which labels are keyed by."""
    return F.substring_index(file, "/", -1)


def safe_names(names: list[str | None]) -> list[str]:
    """Header names made unique: blanks become `Unnamed: n`, repeats get `.1`, `.2`."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, name in enumerate(names):
        name = name if name else f"Unnamed: {i}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def _place(rows: DataFrame) -> DataFrame:
    """rows of a file scan with encoded path, block and a row number within the task."""
    return rows.select(
        *[F.col(quoted(c)) for c in rows.columns], F.col("_metadata.file_path").alias("encoded"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("seq"))


def _ordinal(rank: Column) -> Column:
    """Order of rows by path, block and row, as one number of fixed width: aggregates by first and
    last row stay hash-based, over one file and over many. Within a block the row number of its
    task follows the file."""
    number = lambda c, digits: c.cast(f"decimal({digits},0)")
    at = number(F.col("block"), 15) * F.lit(Decimal(BLOCK_ROWS)) + number(F.col("seq"), 10)
    return (number(rank, 12) * F.lit(Decimal(FILE_ROWS)) + at).cast("decimal(38,0)")


def _by_path(rows: DataFrame, files: DataFrame, n_files: int, path: str = "path") -> DataFrame:
    """rows with the columns of their file; files has a row for each of n_files paths."""
    return rows.join(files.hint("broadcast" if n_files <= BROADCAST_FILES else "merge"), path)


def input_paths(df: DataFrame) -> list[str]:
    """Paths of a scan's files in order, as file_path gives them (an empty authority has no
    slashes there); the driver lists them anyway."""
    return sorted(unquote(re.sub(r"^([^:/]+):///", r"\1:/", p)) for p in df.inputFiles())


def _ranked(rows: DataFrame) -> DataFrame:
    """rows of a file scan with `file` and `ordinal`."""
    paths = input_paths(rows)
    placed = _place(rows).withColumn("path", file_path(F.col("encoded")))
    rank = F.lit(0)
    if len(paths) > 1:
        ranks = rows.sparkSession.createDataFrame(list(enumerate(paths)), "rank long, path string")
        placed, rank = _by_path(placed, ranks, len(paths)), F.col("rank")
    return placed.select(*[F.col(quoted(c)) for c in rows.columns], F.col("path").alias(FILE),
                         _ordinal(rank).alias(ORDINAL))


def _present(cell: Column, na: list[str] | None) -> Column:
    return F.when(~cell.isin(list(na)), cell) if na else cell


def _fields_read(cells: list[str], sep: str) -> Column:
    """Fields of a row: of its line, which is there if they are not as many as the cells. Spark
    refuses a scan of lines alone, and counting the cells one by one needs them too."""
    read = F.transform(F.array(*[quoted(c) for c in cells]), lambda c: c.isNotNull())
    return F.when(F.col(LINE).isNotNull(), n_fields(F.col(LINE), sep)).otherwise(F.size(read))


def _line(cells: list[str], sep: str) -> Column:
    """The line of a row with as many fields as cells, quoted where it has to be."""
    special = lambda c: F.contains(c, F.lit(sep)) | c.rlike('["\\r\\n]')
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.array_join(F.transform(F.array(*[quoted(c) for c in cells]), lambda c: F.when(
        special(c), quote(c)).otherwise(c)), sep, "")


def _problem(line: Column, fields: Column, width: Column, sep: str) -> Column:
    """Why a row is bad, null if it is not; line is null if the fields are as many as were asked
    for. Rows with fewer fields than the header are not bad, their last cells are null."""
    return F.when(fields > width, "extra_fields").when(
        line.isNotNull() & (fields < width) & has_open_quote(line, sep), "open_quote")


def _refused(problem: Column, line: Column, bad: str) -> Column:
    """Condition for the rows that stay."""
    if bad == "fail":
        message = F.concat(F.lit("Bad CSV row ("), problem, F.lit("): "), line)
        return F.when(problem.isNotNull(), F.raise_error(message).isNull()).otherwise(F.lit(True))
    return problem.isNull()


def _checked_option(bad: str) -> str:
    if bad not in BAD_ROWS:
        raise ValueError(f"bad must be one of {BAD_ROWS}")
    return bad


@dataclass(frozen=True)
class CsvFiles:
    """CSV files under one path, of any headers and of both encodings.

    Quotes are doubled inside quoted cells, and a backslash is an ordinary character. Cells whose
    whole text is in `na` are null; None keeps them. Nothing is inferred, so `5.45E+17` and
    leading zeros survive; blank cells are null, blank lines no rows. Rows with more fields than
    the header of their file, and rows with fewer whose last quote is never closed, are bad:
    `reject` leaves them to rejected(), `fail` raises an error when one is read, and `keep` takes
    their first fields. Fallback encodings beyond Spark's own list need
    `spark.sql.legacy.javaCharsets`. Further options, such as `sep` or `multiLine` for quoted line breaks, go
    to the reader.
    """

    spark: SparkSession
    path: str | list[str]
    files: DataFrame
    glob: str | None = None
    fallback: str = FALLBACK_ENCODING
    na: tuple[str, ...] | None = tuple(NA_TEXTS)
    bad: str = "reject"
    options: dict = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, path: str | list[str], glob: str | None = None,
             fallback: str = FALLBACK_ENCODING, na: list[str] | None = NA_TEXTS,
             bad: str = "reject", **options) -> CsvFiles:
        """Scan the files for their headers: a row for each, kept in the shared folder."""
        checkpoint_dir(spark)
        sep = options.get("sep", ",")
        found = file_headers(spark, path, glob, fallback, sep)
        found = found.withColumn("names", header_names(F.col("header"), sep))
        rank = F.row_number().over(W.orderBy("path")) - 1        # a row for each file
        return cls(spark, path, found.withColumn("rank", rank).checkpoint(), glob, fallback,
                   tuple(na) if na else None, _checked_option(bad), options)

    @property
    def sep(self) -> str:
        return self.options.get("sep", ",")

    @cached_property
    def about(self) -> dict:
        """Figures of all files together."""
        longer = F.col("most_fields") > F.size("names")
        return self.files.agg(
            F.count(F.lit(1)).alias("n_files"), F.max(F.size("names")).alias("width"),
            F.count_if(F.col("header").isNull()).alias("without_header"),
            F.count_if(F.col("encoding") != "UTF-8").alias("n_fallback"),
            F.count_if(longer | (F.col("n_open") > 0)).alias("n_doubtful"), F.min("header").alias("first"),
            F.max("header").alias("last"),
            F.min_by("names", "rank").alias("names"),
        ).first().asDict()

    @property
    def checks(self) -> bool:
        """Whether rows have to be looked at one by one: if the headers' scan saw a line with more
        fields than its header or with an open quote, or if rows may have several lines."""
        return self.bad != "keep" and (bool(self.about["n_doubtful"]) or self._multi_line)

    @property
    def _multi_line(self) -> bool:
        return str(self.options.get("multiLine", False)).lower() == "true"

    def _scan(self, names: list[str], with_line: bool) -> DataFrame:
        """One CSV scan of all files with these column names by position, decoded, with path,
        block, seq and the columns of the file's header."""
        about = self.about
        same = about["n_fallback"] in (0, about["n_files"])
        encoding = (self.fallback if about["n_fallback"] else "UTF-8") if same else BYTES
        fields = [T.StructField(n, T.StringType()) for n in names]
        if with_line:
            fields.append(T.StructField(LINE, T.StringType()))
        reader = self.spark.read.options(**{
            **QUOTING, **self.options, "header": True, "encoding": encoding,
            "enforceSchema": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": LINE,
            "recursiveFileLookup": True})
        if self.glob:
            reader = reader.option("pathGlobFilter", self.glob)
        rows = _by_path(_place(reader.schema(T.StructType(fields)).csv(self.path)),
                        self.files.select("encoded", "path", "rank", "names", "encoding"),
                        about["n_files"], "encoded")
        if same:
            return rows
        raw = lambda c: F.encode(c, BYTES)
        text = lambda c: F.when(
            F.col("encoding") == "UTF-8", F.decode(raw(c), "UTF-8")).otherwise(
            c if self.fallback == BYTES else F.decode(raw(c), self.fallback))
        return rows.withColumns({f.name: text(F.col(quoted(f.name))) for f in fields})

    def _records(self, with_line: bool) -> DataFrame:
        """(file, ordinal, names, vals, ...) of every row, bad ones too: vals are the cells."""
        cells = [f"c{i}" for i in range(self.about["width"] or 1)]
        # One cell more than any header has: a row with too many fields then has its line.
        rows = self._scan([*cells, "more"][:len(cells) + with_line], with_line)
        out = [F.col("path").alias(FILE), _ordinal(F.col("rank")).alias(ORDINAL), "names",
               F.array(*cells).alias("vals")]
        if not with_line:
            return rows.select(*out)
        rows = rows.select(*out, _fields_read([*cells, "more"], self.sep).alias("n_fields"),
                           F.coalesce(LINE, _line([*cells, "more"], self.sep)).alias(LINE))
        return rows.withColumn("problem", _problem(
            F.col(LINE), F.col("n_fields"), F.size("names"), self.sep))

    def rows(self) -> DataFrame:
        """(file, ordinal, names, vals): every row as an array of cells beside its header's."""
        rows = self._records(self.checks)
        if self.checks:
            rows = rows.where(_refused(F.col("problem"), F.col(LINE), self.bad))
        cells = F.slice("vals", F.lit(1), F.size("names"))
        return rows.select(FILE, ORDINAL, "names", F.transform(
            cells, lambda c: _present(c, self.na)).alias("vals"))

    def cells(self) -> DataFrame:
        """Every cell as a row: (file, ordinal, n_cols, position, col, val)."""
        return explode_rows(self.rows())

    def first_values(self, n: int = SAMPLE_ROWS) -> DataFrame:
        """The first n filled cells of every column, in long form."""
        return first_values(self.rows(), n, head=F.col(ORDINAL) % F.lit(
            Decimal(FILE_ROWS)) < F.lit(Decimal(BLOCK_ROWS)))

    def columns(self) -> DataFrame:
        """(file, position, n_cols, col) of every file, from the headers alone."""
        return self.files.where(F.col("header").isNotNull()).select(
            F.col("path").alias(FILE), F.size("names").alias("n_cols"),
            F.posexplode("names").alias("position", "col")).select(
            FILE, "position", "n_cols", "col")

    def table(self) -> DataFrame:
        """Text columns of files that share one header, with `file` and `ordinal`.

        Only the columns that are used are read, unless rows have to be checked.
        """
        about = self.about
        if not about["n_files"]:
            raise FileNotFoundError(f"no files under {self.path}")
        if about["first"] != about["last"] or about["without_header"] not in (0, about["n_files"]):
            raise ValueError(f"CSV header does not conform: files of {self.path} differ in header")
        names = about["names"] or []
        rows = self._scan(names, self.checks)
        if self.checks:
            problem = _problem(F.col(LINE), _fields_read(names, self.sep), F.lit(len(names)),
                               self.sep)
            rows = rows.withColumn("problem", problem).where(
                _refused(F.col("problem"), F.col(LINE), self.bad))
        return rows.select(
            *[_present(F.col(quoted(n)), self.na).alias(n) for n in names],
            F.col("path").alias(FILE), _ordinal(F.col("rank")).alias(ORDINAL))

    def rejected(self) -> DataFrame:
        """(file, ordinal, problem, n_fields, n_cols, line) of the bad rows; read again only if
        the headers' scan saw a line that may be one."""
        schema = (f"{FILE} string, {ORDINAL} decimal(38,0), problem string, n_fields int, "
                  "n_cols int, line string")
        if not self.checks:
            return self.spark.createDataFrame([], schema)
        return self._records(True).where(F.col("problem").isNotNull()).select(
            FILE, ORDINAL, "problem", "n_fields", F.size("names").alias("n_cols"),
            F.col(LINE).alias("line"))


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    encoding: str = "UTF-8",
    header: list[str] | None = None,
    na: list[str] | None = NA_TEXTS,
    bad: str = "reject",
    **options,
) -> DataFrame:
    """Text columns of CSV files of a known encoding that share one header, plus `file` and
    `ordinal`, in one scan.

    Names come from `header` or from the first file's header line; a file with other headers than
    its own is an error. Cells, bad rows and options are as with CsvFiles, but all rows are looked
    at, and bad ones that are left out are nowhere kept.
    """
    if header is None:
        plain = {**QUOTING, **options, "header": False, "encoding": encoding}
        first = spark.read.options(**plain).csv(path).first()
        header = list(first) if first else []
    names = safe_names(header)
    check = _checked_option(bad) != "keep"
    fields = [T.StructField(n, T.StringType()) for n in [*names, *[LINE][:check]]]
    rows = (
        spark.read.options(**{
            **QUOTING, **options, "header": True, "encoding": encoding,
            "mode": "PERMISSIVE", "columnNameOfCorruptRecord": LINE,
            "enforceSchema": names != header,  # else a file with other headers is an error
        })
        .schema(T.StructType(fields))
        .csv(path)
    )
    rows = _ranked(rows)
    if check:
        sep = options.get("sep", ",")
        problem = _problem(F.col(LINE), _fields_read(names, sep), F.lit(len(names)), sep)
        rows = rows.withColumn("problem", problem).where(
            _refused(F.col("problem"), F.col(LINE), bad))
    return rows.select(
        *[_present(F.col(quoted(n)), na).alias(n) for n in names], FILE, ORDINAL)


def read_directory(
    spark: SparkSession,
    path: str,
    *,
    glob: str = FILE_GLOB,
    fallback_encoding: str = FALLBACK_ENCODING,
    **options,
) -> DataFrame:
    """Every CSV file under a directory in long form, whatever its header and encoding."""
    files = CsvFiles.open(spark, path, glob, fallback_encoding, **options)
    if not files.about["n_files"]:
        raise FileNotFoundError(f"no files match {glob} under {path}")
    return files.cells()


def path_format(spark: SparkSession, path: str) -> str:
    """`csv` or `parquet`, by the ending of the path or else by those of all files under it."""
    ending = lambda p: p.lower().rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2]
    kinds = {ending(path)}
    if not kinds <= {"csv", "parquet"}:
        listed = spark.read.option("recursiveFileLookup", True)
        try:
            kinds = {ending(p) for p in input_paths(listed.text(path))}
        except Exception as e:  # no such path: its ending says what it was meant to be
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if len(kinds) != 1 or not kinds <= {"csv", "parquet"}:
        raise ValueError("Unsupported file format")
    return kinds.pop()


def open_side(
    spark: SparkSession,
    path: str,
    fallback_encoding: str = FALLBACK_ENCODING,
    fmt: str | None = None,
    **options,
) -> tuple[DataFrame, DataFrame | None]:
    """One side of a reconciliation, as text columns with `file` and `ordinal`, and its rejected
    rows, None for parquet.

    path is a file, a directory or a glob; the format is path_format's unless fmt says `csv` or
    `parquet`. CSV files of one path must share a header and may differ in encoding; options go to
    CsvFiles, and from there to the reader.
    """
    fmt = fmt or path_format(spark, path)
    if fmt == "parquet":
        rows = spark.read.parquet(path)
        rows = rows.select(*[F.col(quoted(n)).cast("string").alias(n) for n in rows.columns],
                           "_metadata")
        return _ranked(rows).drop("_metadata"), None
    if fmt != "csv":
        raise ValueError("Unsupported file format")
    files = CsvFiles.open(spark, path, None, fallback_encoding, **options)
    return files.table(), files.rejected()


def load_file(spark: SparkSession, path: str, *args, **options) -> DataFrame:
    """The rows of open_side."""
    return open_side(spark, path, *args, **options)[0]


def _contains(name: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | name.contains(w)
    return found


def column_policy(long: DataFrame) -> DataFrame:
    """How each column is typed: text (IDs), amount, numeric or text.

    ID words win over amount words, but `id` counts only as a word of its own or at the
    end of a name, so `Paid Amt` is an amount. Other columns are numeric when more than
    70% of their first 10 non-null values parse.
    """
    name = F.lower("col")
    id_word = name.rlike("(^|[^a-z])id([^a-z]|$)") | (
        name.endswith("id") & ~name.endswith("paid")
    )
    parsed = is_number(F.col("val")) & F.col("val").isNotNull()
    share = F.try_divide(F.count_if(parsed), F.count("val")).alias("numeric_share")
    policy = (
        F.when(id_word | _contains(name, ID_WORDS), "id")
        .when(_contains(name, AMOUNT_WORDS), "amount")
        .when(F.col("numeric_share") > 0.7, "numeric")
        .otherwise("text")
    )
    return first_cells(long, 10).groupBy(*COLUMN).agg(share).select(
        "file", "position", "col", "numeric_share", policy.alias("policy")
    )


def apply_policy(
    df: DataFrame, policies: dict[str, str], money: Money = DEFAULT_MONEY
) -> DataFrame:
    """Typed columns of one file by policy name; amounts keep separators out of the way."""
    convert = {
        "amount": lambda c: parse_amount(c, money),
        "numeric": parse_number,
    }
    columns = []
    for name in df.columns:
        make = convert.get(policies.get(name, "text"))
        c = F.col(quoted(name))
        columns.append(make(c).alias(name) if make else c)
    return df.select(*columns)


def preview(df: DataFrame, rows: int = 3, order: str = ORDINAL) -> DataFrame:
    """First rows of a file in row order."""
    return df.orderBy(order).limit(rows)
