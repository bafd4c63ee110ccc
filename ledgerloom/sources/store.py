"""Stored jobs, results and discrepancies: parquet tables with one directory per job and attempt.

A job takes its number first, by a file that only one job can create. Its rows are staged under an
attempt of their own and become visible together, by a commit marker that readers go by; the marker
too can be created once. So jobs that start together get different numbers, a job that fails or is
still running is not seen, and a finished one is replaced only if that is asked for. Creating a
file is exclusive on HDFS and local disks; on stores without that, give jobs numbers of your own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.money import DEFAULT_MONEY, Money

CSV_OUT = {"header": True, "quote": '"', "escape": '"'}
JOBS, RESULTS, DISCREPANCIES = "jobs", "results", "discrepancies"
NUMBERS, COMMITS = "numbers", "commits"      # folders of small files, one for each job

# Columns and types; MONEY stands for the decimal type of amounts, SUM for its totals.
SCHEMAS = {
    JOBS: """
        job_name string, our_file_name string, bank_file_name string, bank_name string,
        created_at timestamp_ntz, status string, total_our_records bigint,
        total_bank_records bigint, matched_records bigint, unmatched_our_records bigint,
        unmatched_bank_records bigint, our_trx_column string, bank_trx_column string,
        our_amount_column string, bank_amount_column string, our_amount_confidence double,
        bank_amount_confidence double, amount_comparison_performed boolean,
        our_total_amount SUM, bank_total_amount SUM, matched_total_our SUM,
        matched_total_bank SUM, total_difference_all SUM, total_difference_matched SUM,
        amounts_match boolean, total_discrepancies bigint""",
    RESULTS: """
        id bigint, bank_trx_id string, bank_trx_id_display string, status string,
        our_record_data string, bank_record_data string, paying_bank_name string, amount MONEY,
        our_amount MONEY, bank_amount MONEY, amount_difference MONEY, amount_match boolean,
        created_at timestamp_ntz""",
    DISCREPANCIES: """
        id bigint, bank_trx_id string, our_amount MONEY, bank_amount MONEY, difference MONEY,
        percentage_diff double, created_at timestamp_ntz""",
}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, as the cluster names it.

    Only a local session without one gets a temporary folder of its own.
    """
    current = spark.sparkContext.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if current or named:
        if not current:
            spark.sparkContext.setCheckpointDir(named)
        return current or named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir is not set")
    made = tempfile.mkdtemp(prefix="ledgerloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def staged(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: what is costly to read is read once, and
    later only the columns that are used. Names are given by place, so any are possible."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"staged-{uuid.uuid4().hex}")
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain.write.parquet(path)
    return spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)


class Store:
    """The three stored tables under one path."""

    def __init__(self, spark: SparkSession, path: str, money: Money = DEFAULT_MONEY):
        self.spark = spark
        self.path = path
        self.money = money

    def _table(self, name: str) -> str:
        return os.path.join(self.path, name)

    def schema(self, name: str) -> T.StructType:
        total = f"decimal(38,{self.money.scale})"
        ddl = SCHEMAS[name].replace("MONEY", self.money.sql_type).replace("SUM", total)
        return T.StructType.fromDDL(ddl)

    def _create(self, name: str, text: str) -> bool:
        """Create a small file, unless there is one."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, name))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        local = fs.getUri().getScheme() == "file"
        if local:                                # its create() looks first, and creates later
            taken = jvm.java.io.File(fs.makeQualified(path).toUri().getPath())
            taken.getParentFile().mkdirs()
            if not taken.createNewFile():
                return False
        try:
            out = fs.create(path, local)
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception):
                raise
            return False
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _marks(self, folder: str) -> list[tuple[str, str]]:
        """(name, text) of the small files of a folder; a row for each job."""
        try:
            found = self.spark.read.schema("value string").text(os.path.join(self.path, folder))
            return [(r["n"], r["value"]) for r in found.select(
                F.col("_metadata.file_name").alias("n"), "value").collect()]
        except Exception as e:  # nothing is stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []

    def committed(self) -> dict[int, tuple[int, str]]:
        """Version and attempt of every finished job by number."""
        found: dict[int, tuple[int, str]] = {}
        for name, attempt in self._marks(COMMITS):
            job, version = map(int, name.split("-"))
            if attempt:
                found[job] = max(found.get(job, (-1, "")), (version, attempt))
        return found

    def read(self, name: str) -> DataFrame:
        """Rows of the jobs that are finished now."""
        return self._attempts(name, {job: a for job, (_, a) in self.committed().items()})

    def _attempts(self, name: str, attempts: dict[int, str]) -> DataFrame:
        fields = [*self.schema(name), T.StructField("job_id", T.IntegerType())]
        if not attempts:
            return self.spark.createDataFrame([], T.StructType(fields))
        schema = T.StructType([*fields, T.StructField("attempt", T.StringType())])
        table = self._table(name)
        paths = [os.path.join(table, f"job_id={j}", f"attempt={a}") for j, a in attempts.items()]
        return self.spark.read.schema(schema).option("basePath", table).parquet(*paths).drop(
            "attempt")

    def jobs(self) -> DataFrame:
        return self.read(JOBS)

    def results(self) -> DataFrame:
        return self.read(RESULTS)

    def discrepancies(self) -> DataFrame:
        return self.read(DISCREPANCIES)

    def next_job_id(self) -> int:
        """One more than the highest number that a job has taken."""
        return 1 + max((int(name) for name, _ in self._marks(NUMBERS)), default=0)

    def begin(self, job_id: int | None = None, replace: bool = False) -> Attempt:
        """Start a job, under a number of its own or the one that is given. A finished job of that
        number is an error, unless it is to be replaced."""
        if job_id is None:
            job_id = self.next_job_id()
            while not self._create(f"{NUMBERS}/{job_id}", "taken"):
                job_id += 1
        else:
            self._create(f"{NUMBERS}/{job_id}", "taken")
        version, _ = self.committed().get(job_id, (-1, ""))
        if version >= 0 and not replace:
            raise JobExists(f"job {job_id} is finished")
        return Attempt(self, job_id, version + 1, uuid.uuid4().hex)


class JobExists(ValueError):
    """A finished job has that number."""


@dataclass(frozen=True)
class Attempt:
    """A job that is being written."""

    store: Store
    job_id: int
    version: int
    name: str

    def write(self, table: str, df: DataFrame) -> None:
        """Stage the job's rows of one table; columns are cast to the stored types."""
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.store.schema(table)]
        target = os.path.join(
            self.store._table(table), f"job_id={self.job_id}", f"attempt={self.name}")
        df.select(*columns).write.mode("overwrite").parquet(target)

    def read(self, table: str) -> DataFrame:
        """The staged rows of one table."""
        return self.store._attempts(table, {self.job_id: self.name})

    def commit(self) -> None:
        """Make the staged rows the job's; an error if another attempt was first."""
        if not self.store._create(f"{COMMITS}/{self.job_id}-{self.version}", self.name):
            raise JobExists(f"job {self.job_id} was finished by another attempt")


def export_sides(
    our_rows: DataFrame, bank_rows: DataFrame, path: str, fmt: str = "csv"
) -> tuple[str, str]:
    """Write both sides with their status column to two directories."""
    targets = (os.path.join(path, "cash_collection"), os.path.join(path, "bank"))
    for df, target in zip((our_rows, bank_rows), targets):
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.options(**CSV_OUT)
        writer.format(fmt).save(target)
    return targets


def dump(store: Store, path: str, fmt: str = "parquet") -> None:
    """Write stored jobs and results, newest first."""
    for name in (JOBS, RESULTS):
        last = [F.asc("id")] if name == RESULTS else []  # else one job's rows are one sort task
        ordered = store.read(name).orderBy(F.desc("created_at"), F.desc("job_id"), *last)
        writer = ordered.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.options(**CSV_OUT)
        writer.format(fmt).save(os.path.join(path, name))
