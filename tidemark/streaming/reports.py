"""Job reports that grow with a stream (K08, S21): created, added to batch by batch, finalised, and loaded; a batch that comes again adds nothing."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.layouts import batch_summary

#: The report's version and the columns of its jobs.
REPORT_VERSION = "1.0"
JOBS = "job_id long, name string, status string, issues int, error string"


class JobReport:
    """A folder: report.json, and a folder of jobs for each batch. A batch is written apart and renamed to its number, so its folder is the ledger's entry: it is there whole or not at all, and where it is there, the batch is done."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._system = self._hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def create(self, name: str, total_jobs: int, is_batch: bool = True, output: str = "") -> JobReport:
        """Begin a report; an existing one of this folder is gone on with."""
        if not self._there("report.json"):
            self._replace({"version": REPORT_VERSION, "created_at": self._now(), "finalized_at": None, "batch_name": name, "is_batch": is_batch, "output_directory": output, "total_jobs": total_jobs, "summary": {"successful": 0, "warnings": 0, "failed": 0, "total_issues": 0}})
        return self

    def add(self, batch: DataFrame, number: int) -> None:
        """Add a batch of jobs(job_id, status, issues, and name and error if there are any), as foreachBatch calls it."""
        entry = f"jobs/batch={number}"
        if self._there(entry):
            return
        wanted = [c.split() for c in JOBS.split(", ")]
        known = {"name": F.lit("Unknown"), "status": F.lit("Unknown"), "issues": F.lit(0)}
        rows = batch.select(*[F.coalesce(*[x for x in (F.col(c) if c in batch.columns else None, known.get(c)) if x is not None], F.lit(None)).cast(t).alias(c) for c, t in wanted])
        apart = f"_staging/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{apart}")
        self._system.mkdirs(self._hadoop(f"{self.path}/jobs"))
        if self._there(entry) or not self._system.rename(self._hadoop(f"{self.path}/{apart}"), self._hadoop(f"{self.path}/{entry}")):
            self._system.delete(self._hadoop(f"{self.path}/{apart}"), True)

    def jobs(self) -> DataFrame:
        """(job_id, name, status, issues, error, batch) of all batches so far."""
        if not self._there("jobs"):
            return self.spark.createDataFrame([], f"{JOBS}, batch long")
        return self.spark.read.schema(f"{JOBS}, batch long").parquet(f"{self.path}/jobs")

    def finalise(self) -> dict:
        """Count the jobs and write the report anew with their summary, which is returned."""
        found = batch_summary(self.jobs()).first().asDict()
        summary = {k: int(found[k] or 0) for k in ("successful", "warnings", "failed", "total_issues")}
        self._replace(self.header() | {"summary": summary, "finalized_at": self._now()})
        self._system.delete(self._hadoop(f"{self.path}/_staging"), True)
        return summary

    def header(self) -> dict:
        """report.json; an error that says what can't be read."""
        try:
            stream = self._system.open(self._hadoop(f"{self.path}/report.json"))
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
        except Exception as error:
            raise ValueError(f"failed to read report: {self.path}") from error
        try:
            return json.loads(text)
        except json.JSONDecodeError as error:
            raise ValueError(f"failed to parse report: {error}") from error

    def _there(self, name: str) -> bool:
        return self._system.exists(self._hadoop(f"{self.path}/{name}"))

    def _now(self) -> str:
        return datetime.now(UTC).isoformat()

    def _replace(self, header: dict) -> None:
        """Write report.json apart and put it in the old one's place."""
        apart, target = self._hadoop(f"{self.path}/_report-{uuid.uuid4().hex}.tmp"), self._hadoop(f"{self.path}/report.json")
        out = self._system.create(apart)
        out.write(bytearray(json.dumps(header, indent=2).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        option = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(apart, target, option)


def load_report(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """A report's header and its jobs."""
    report = JobReport(spark, path)
    return report.header(), report.jobs()
