"""Reconcile a ledger with a statement, store the outcome, report it and export it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import display_id, legacy_amount, records_to_columns
from ledgerloom.functions.money import DEFAULT_MONEY, Money
from ledgerloom.operators import comparison as cmp
from ledgerloom.operators import matching as m
from ledgerloom.operators import roles as rl
from ledgerloom.operators import stored
from ledgerloom.operators.keywords import detection_keywords
from ledgerloom.operators.profile import SAMPLE_ROWS, column_profile, first_cells, to_long
from ledgerloom.sources import store as st
from ledgerloom.sources.files import BLOCK_ROWS, FILE, ORDINAL, input_paths, open_side, preview

BANK_COLUMN = "Paying Bank Name"
LEGACY_AMOUNT_COLUMN = "Paid Amt"
STATUS_COLUMN = "Reconciliation Result"
LEADING = 10         # leading rows looked at for each value of a sample

Scorer = Callable[[DataFrame], DataFrame]


class ColumnNotFound(ValueError):
    """No column of the statement looks like a transaction ID."""

    def __init__(self, suggested: str | None, score: float, available: list[str]):
        super().__init__(
            f"Could not identify the transaction ID column with sufficient confidence. "
            f"Best guess: '{suggested}' (confidence: {score:.1f}); available: {available}"
        )
        self.suggested = suggested
        self.score = score
        self.available_columns = available


class NoMatchingIds(ValueError):
    """No statement ID occurs in the ledger."""


class JobNotFound(LookupError):
    """The store has no such job."""


@dataclass(frozen=True)
class Roles:
    our_trx: str
    bank_trx: str
    our_amount: str | None
    bank_amount: str | None
    our_trx_score: float = rl.MANUAL_SCORE
    bank_trx_score: float = rl.MANUAL_SCORE
    our_amount_score: float = rl.MANUAL_SCORE
    bank_amount_score: float = rl.MANUAL_SCORE

    @property
    def compare_amounts(self) -> bool:
        if not (self.our_amount and self.bank_amount):
            return False
        return cmp.comparison_gate(self.our_amount_score, self.bank_amount_score)[0]


@dataclass(frozen=True)
class Run:
    """Outcome of one reconciliation, all read back from the store."""

    job_id: int
    bank_name: str
    roles: Roles
    job: DataFrame
    results: DataFrame
    discrepancies: DataFrame
    bank_matches: DataFrame
    report: DataFrame
    rejected: DataFrame | None = None    # bad rows of the files, by side, if files were read


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (FILE, ORDINAL)]


def _leading_rows(df: DataFrame, n: int) -> tuple[list[Row], bool]:
    """First rows of a side in row order, at most `n`, and whether there are no others.

    No rows if their order cannot be told from where they come from, or if some are missing among
    them. Of several files the rows are those of the first block of the first path.
    """
    paths = input_paths(df)
    if not isinstance(df.schema[ORDINAL].dataType, T.DecimalType) or not paths:
        return [], False
    if len(paths) > 1:
        first = (F.col(FILE) == paths[0]) & (F.col(ORDINAL) < BLOCK_ROWS)
        return df.where(first).limit(n).collect(), False
    rows = df.limit(n).collect()
    at = [int(r[ORDINAL]) for r in rows]
    in_order = not at or at[0] == 0 and all(
        b == a + 1 or b > a and b % BLOCK_ROWS == 0 for a, b in zip(at, at[1:]))
    return (rows, len(rows) < n) if in_order else ([], False)


def sampled(df: DataFrame, name: str, n: int = SAMPLE_ROWS) -> DataFrame:
    """Cells of one side from which the first `n` filled ones of every column can be taken.

    The leading rows, read from one block, are enough for every column that is filled in `n`
    of them. Only the other columns are read through.
    """
    columns = data_columns(df)
    rows, whole = _leading_rows(df, LEADING * n)
    dense = [c for c in columns if whole or sum(r[c] is not None for r in rows) >= n]
    sparse = [c for c in columns if c not in dense]
    schema = T.StructType([T.StructField(ORDINAL, T.LongType()), *[df.schema[c] for c in columns]])

    def cells(values: list[tuple], only: list[str]) -> DataFrame:
        head = df.sparkSession.createDataFrame([(i, *v) for i, v in enumerate(values)], schema)
        return to_long(head, columns, file=F.lit(name), order=F.col(ORDINAL), only=only)

    if not sparse:
        return cells([tuple(r[c] for c in columns) for r in rows], dense)
    through = to_long(df, columns, file=F.lit(name), order=F.col(ORDINAL), only=sparse)
    filled = first_cells(through.where(F.col("val").isNotNull()), n)
    filled = filled.withColumn(ORDINAL, F.col("rn").cast("long")).drop("rn")
    # A null cell each, after all others, keeps columns without any value.
    out = filled.unionByName(cells([(None,) * len(columns)], sparse))
    return out.unionByName(cells([tuple(r[c] for c in columns) for r in rows], dense)) \
        if dense else out


def detect_roles(
    ledger: DataFrame,
    statement: DataFrame,
    *,
    keywords: DataFrame | None = None,
    id_scorer: Scorer | None = None,
    amount_scorer: Scorer | None = None,
    our_trx: str | None = None,
    bank_trx: str | None = None,
    our_amount: str | None = None,
    bank_amount: str | None = None,
) -> Roles:
    """ID and amount columns of both files; columns that are named are not looked for.

    Detection samples the first values of each column. Column names must be known before
    the main plan can be built, so the winners, four rows, come to the driver.
    """
    spark = ledger.sparkSession
    wanted = []
    ours = bank = ours_profile = bank_profile = None
    if not (our_trx and our_amount):
        ours = sampled(ledger, "our")
        ours_profile = column_profile(ours)
    if not (bank_trx and bank_amount):
        bank = sampled(statement, "bank")
        bank_profile = column_profile(bank)

    def header(df: DataFrame) -> DataFrame:
        return spark.createDataFrame([(c,) for c in data_columns(df)], "col string")

    def best(role: str, rules: DataFrame, scorer: Scorer | None, long: DataFrame) -> None:
        top = rl.cascade(scorer(long), rules) if scorer else rl.best_columns(rules)
        wanted.append(top.select(F.lit(role).alias("role"), "col", "score"))

    if not our_trx:
        best("our_trx", rl.our_id_scores(ours_profile), id_scorer, ours)
    if not bank_trx:
        best("bank_trx", rl.statement_id_scores(bank_profile), None, bank)
    if not our_amount:
        words = detection_keywords(keywords, "our", spark)
        scores = rl.amount_scores(ours_profile, words, header(ledger))
        best("our_amount", scores, amount_scorer, ours)
    if not bank_amount:
        words = detection_keywords(keywords, "bank", spark)
        scores = rl.amount_scores(bank_profile, words, header(statement))
        best("bank_amount", scores, amount_scorer, bank)

    found = {}
    if wanted:
        tops = wanted[0]
        for more in wanted[1:]:
            tops = tops.unionByName(more)
        found = {r["role"]: (r["col"], float(r["score"])) for r in tops.collect()}
    named = {
        "our_trx": our_trx, "bank_trx": bank_trx,
        "our_amount": our_amount, "bank_amount": bank_amount,
    }
    chosen = {
        role: (name, rl.MANUAL_SCORE) if name else found.get(role, (None, 0.0))
        for role, name in named.items()
    }
    bank_id, bank_score = chosen["bank_trx"]
    if bank_score < rl.STATEMENT_ID_MINIMUM:
        raise ColumnNotFound(bank_id, bank_score, data_columns(statement))
    return Roles(
        *[chosen[r][0] for r in named],
        *[chosen[r][1] for r in named],
    )


def analyze(ledger: DataFrame, statement: DataFrame, **detection) -> dict[str, dict]:
    """Columns, suggested ID column, its score and a three-row preview of both files."""
    rows = {
        "our_file": (ledger, rl.our_id_scores, detection.get("id_scorer")),
        "bank_file": (statement, rl.statement_id_scores, None),
    }
    out = {}
    for name, (df, rules, scorer) in rows.items():
        long = sampled(df, name)
        scores = rules(column_profile(long))
        top = rl.cascade(scorer(long), scores) if scorer else rl.best_columns(scores)
        row = top.first()
        out[name] = {
            "columns": data_columns(df),
            "suggested_trx_column": row["col"] if row else None,
            "confidence": row["score"] if row else 0.0,
            "preview": preview(df).select(*[F.col(f"`{c}`") for c in data_columns(df)]),
        }
    return out


def result_rows(
    reconciled: DataFrame, bank_name: str, created_at: datetime, compared: bool, money: Money
) -> DataFrame:
    """Stored result rows of a reconciliation with records."""
    status = F.col("status")
    legacy = F.from_json("our_record", f"`{LEGACY_AMOUNT_COLUMN}` string")[LEGACY_AMOUNT_COLUMN]
    display = F.when(status == m.MISSING_IN_BANK, F.col("id")).otherwise(
        display_id(F.col("bank_original"), F.col("id"))
    )
    amounts = ["our_amount", "bank_amount", "amount_difference", "amount_match"]
    rows = cmp.result_amounts(reconciled)
    kept = [F.col(c) if compared else F.lit(None).cast(rows.schema[c].dataType) for c in amounts]
    return rows.select(
        F.monotonically_increasing_id().alias("id"),
        F.col("id").alias("bank_trx_id"),
        display.alias("bank_trx_id_display"),
        "status",
        F.col("our_record").alias("our_record_data"),
        F.col("bank_record").alias("bank_record_data"),
        F.lit(bank_name).alias("paying_bank_name"),
        legacy_amount(F.coalesce(legacy, F.lit("")), money).alias("amount"),
        *[c.alias(n) for c, n in zip(kept, amounts)],
        F.lit(created_at).alias("created_at"),
    )


def discrepancy_rows(results: DataFrame) -> DataFrame:
    """Stored discrepancies of stored results."""
    found = results.where(F.col("status") == m.MATCHED).where(cmp.is_discrepancy())
    return found.select(
        "id", "bank_trx_id", "our_amount", "bank_amount",
        cmp.difference().alias("difference"), cmp.percentage().alias("percentage_diff"),
        "created_at",
    )


def job_rows(
    results: DataFrame, roles: Roles, created_at: datetime, names: dict[str, str], bank_name: str
) -> DataFrame:
    """Stored job row: one aggregation over the stored results."""
    one_side = lambda *s: F.when(F.col("status").isin(*s), 1)
    summary = cmp.run_summary(
        results.withColumns(
            {
                "our_rows": one_side(m.MATCHED, m.MISSING_IN_BANK),
                "bank_rows": one_side(m.MATCHED, m.MISSING_IN_OURS),
            }
        )
    )
    compared = roles.compare_amounts
    values = {
        **{k: F.lit(v) for k, v in names.items()},
        "bank_name": F.lit(bank_name),
        "created_at": F.lit(created_at),
        "status": F.lit("completed"),
        "unmatched_our_records": F.col("missing_in_bank_count"),
        "unmatched_bank_records": F.col("missing_in_our_file_count"),
        "our_trx_column": F.lit(roles.our_trx),
        "bank_trx_column": F.lit(roles.bank_trx),
        "our_amount_column": F.lit(roles.our_amount).cast("string"),
        "bank_amount_column": F.lit(roles.bank_amount).cast("string"),
        "our_amount_confidence": F.lit(float(roles.our_amount_score)),
        "bank_amount_confidence": F.lit(float(roles.bank_amount_score)),
        "amount_comparison_performed": F.lit(compared),
        "our_total_amount": F.col("our_total"),
        "bank_total_amount": F.col("bank_total"),
        "amounts_match": F.col("amounts_match") & F.lit(compared),
    }
    return summary.withColumns(values)


def reconcile(
    ledger: DataFrame,
    statement: DataFrame,
    store: st.Store,
    *,
    job_name: str,
    our_file_name: str = "",
    bank_file_name: str = "",
    roles: Roles | None = None,
    target_bank: str | None = None,
    bank_column: str = BANK_COLUMN,
    job_id: int | None = None,
    replace_job: bool = False,
    created_at: datetime | None = None,
    stage: bool = False,
    **detection,
) -> Run:
    """Match, compare and store one pair of files.

    Results are written once; totals, discrepancies and the report are then read from
    the stored table instead of repeating the join. The job is seen by others when it is finished;
    a finished job of the same job_id is an error unless `replace_job` is set. `stage` copies both
    sides to the shared folder once their roles are known, for sides that are costly to read:
    matching reads each several times.
    """
    roles = roles or detect_roles(ledger, statement, **detection)
    if stage:
        ledger, statement = st.staged(ledger), st.staged(statement)
    money = store.money
    created_at = created_at or datetime.now(timezone.utc).replace(tzinfo=None)
    ours = m.side(
        ledger, roles.our_trx, roles.our_amount, ORDINAL, bank_col=bank_column,
        record_cols=data_columns(ledger), money=money,
    )
    bank = m.side(
        statement, roles.bank_trx, roles.bank_amount, ORDINAL,
        record_cols=data_columns(statement), money=money,
    )
    st.checkpoint_dir(store.spark)
    matches = m.attribution_counts(m.attribute(ours, bank))
    if target_bank is None:
        matches = matches.checkpoint()  # a row per bank
        named = matches.where(F.col("bank").isNotNull())
        top = named.orderBy(F.desc("n_ids"), "bank").first()
        if top is None:
            raise NoMatchingIds("No matching transaction IDs found between the files")
        target_bank = top["bank"]
    attempt = store.begin(job_id, replace_job)
    job_id = attempt.job_id

    reconciled = m.reconcile_ids(m.of_bank(ours, target_bank), bank, with_records=True)
    rows = result_rows(reconciled, target_bank, created_at, roles.compare_amounts, money)
    attempt.write(st.RESULTS, rows)
    results = attempt.read(st.RESULTS)
    attempt.write(st.DISCREPANCIES, discrepancy_rows(results))
    names = {
        "job_name": job_name, "our_file_name": our_file_name, "bank_file_name": bank_file_name,
    }
    attempt.write(st.JOBS, job_rows(results, roles, created_at, names, target_bank))
    attempt.commit()
    job, discrepancies = attempt.read(st.JOBS), attempt.read(st.DISCREPANCIES)
    return Run(
        job_id, target_bank, roles, job, results, discrepancies, matches,
        stored.report_lines(job, results, discrepancies, live=True),
    )


def _discrepancies(store: st.Store, job_id: int) -> DataFrame:
    return store.discrepancies().where(F.col("job_id") == job_id)


def reconcile_files(
    spark: SparkSession, our_path: str, bank_path: str, store: st.Store, *, job_name: str,
    reader: dict | None = None, our_reader: dict | None = None, bank_reader: dict | None = None,
    **options
) -> Run:
    """Load two sides (CSV or parquet: a file, a directory or a glob) and reconcile them.

    `reader` holds options of open_side for both sides, the others for one; each side is read by
    its own format. Bad rows of either are in the run's `rejected`; `{"bad": "fail"}` makes them an
    error instead. Files are parsed once: what matching reads is a copy in the shared folder.
    """
    base = lambda p: p.rstrip("/").rsplit("/", 1)[-1]
    sides = {"our": (our_path, our_reader), "bank": (bank_path, bank_reader)}
    opened = {name: open_side(spark, path, **{**(reader or {}), **(own or {})})
              for name, (path, own) in sides.items()}
    run = reconcile(
        opened["our"][0], opened["bank"][0], store, job_name=job_name,
        our_file_name=base(our_path), bank_file_name=base(bank_path), stage=True, **options,
    )
    rejected = [bad.select(F.lit(name).alias("side"), "*")
                for name, (_, bad) in opened.items() if bad is not None]
    both = rejected[0].unionByName(rejected[-1]) if len(rejected) > 1 else next(iter(rejected), None)
    return replace(run, rejected=both)


def stored_job(store: st.Store, job_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Job, results and discrepancies of one stored job."""
    job, results = stored.job_with_results(store.jobs(), store.results(), job_id)
    if job.isEmpty():
        raise JobNotFound(f"Job not found: {job_id}")
    return job, results, _discrepancies(store, job_id)


def job_report(store: st.Store, job_id: int) -> DataFrame:
    """Report lines of a stored job."""
    return stored.report_lines(*stored_job(store, job_id))


def _record_names(results: DataFrame, column: str) -> list[str]:
    keys = results.where(F.col(column).isNotNull()).select(F.json_object_keys(column)).first()
    if keys is None:
        raise ValueError(f"job has no {column}")
    return list(keys[0])


def with_status(
    ledger: DataFrame,
    statement: DataFrame,
    roles: Roles,
    target_bank: str,
    *,
    bank_column: str = BANK_COLUMN,
    money: Money = DEFAULT_MONEY,
    compat: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Both files as they are, ours cut to one bank, each row with its status.

    `compat` parses amounts without dropping separators or currency signs.
    """
    ours = m.side(
        ledger, roles.our_trx, roles.our_amount, ORDINAL, bank_col=bank_column,
        row_cols=data_columns(ledger), money=money, strict=compat,
    )
    ours = m.of_bank(ours, target_bank)
    bank = m.side(
        statement, roles.bank_trx, roles.bank_amount, ORDINAL,
        row_cols=data_columns(statement), money=money, strict=compat,
    )
    shown = lambda df: df.select("row.*", F.col("status").alias(STATUS_COLUMN))
    narrow = lambda s: s.select("id", "original", "amount", "ordinal")
    return (
        shown(cmp.row_status(ours, narrow(bank))),
        shown(cmp.row_status(bank, narrow(ours))),
    )


def export_job(
    store: st.Store, job_id: int, path: str, fmt: str = "csv", **options
) -> tuple[str, str]:
    """Rebuild both sides of a stored job from its records and write them with a status.

    The ID and amount columns are those of the job row; nothing is detected again.
    """
    job, results, _ = stored_job(store, job_id)
    row = job.first()
    roles = Roles(row["our_trx_column"], row["bank_trx_column"], row["our_amount_column"],
                  row["bank_amount_column"])
    if not row["amount_comparison_performed"]:
        roles = replace(roles, our_amount=None, bank_amount=None)
    sides = [
        records_to_columns(results, c, _record_names(results, c)).withColumn(
            ORDINAL, F.monotonically_increasing_id()
        )
        for c in ("our_record_data", "bank_record_data")
    ]
    sides = with_status(*sides, roles, row["bank_name"], money=store.money, **options)
    return st.export_sides(*sides, path, fmt)
