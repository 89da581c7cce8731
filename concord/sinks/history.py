"""Run history: an append-only table of runs and one of their findings."""

from __future__ import annotations

import hashlib
import re
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.plans.run import FINDINGS, Run, summarize

RUNS = "runs"
FINDINGS_DIR = "findings"
RUN_FIELDS = (
    "comparison string, status string, passed bigint, warnings bigint, failed bigint, source_rows bigint, "
    "target_rows bigint, difference bigint, source_label string, target_label string, timestamp string, run_id string"
)


def run_id_for(name: str, timestamp: str, attempt: str = "") -> str:
    """A folder-safe id from the comparison's name, a digest of it, the time of the run and the attempt.

    The digest keeps names apart that read alike once they are made safe.
    """
    stem = re.sub(r"[^a-zA-Z0-9_-]+", "_", name).strip("_") or "run"
    digest = hashlib.md5(name.encode(), usedforsecurity=False).hexdigest()[:8]
    stamp = re.sub(r"[^0-9TZ]", "-", timestamp)
    return "-".join(filter(None, (stem, digest, stamp, attempt)))


def persist_run(run: Run, root: str, timestamp: str | None = None) -> str:
    """Record a run; its summary is written last and makes the run visible.

    Without a timestamp each call is a run of its own, even within one
    millisecond. With one, a call that broke off can be repeated: findings go
    to the run's own folder and replace what the broken attempt left there.
    """
    now = datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    attempt = "" if timestamp else uuid.uuid4().hex[:12]
    timestamp = timestamp or now
    run_id = run_id_for(run.name, timestamp, attempt)
    spark = run.findings.sparkSession
    if not list_runs(spark, root).where(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"run {run_id!r} is already recorded")
    run.findings.write.mode("overwrite").parquet(f"{root}/{FINDINGS_DIR}/run_id={run_id}")
    # The checks ran once for the write; the summary comes from what was written.
    stored = load_run(spark, root, run_id)
    summary = summarize(stored, run.name, run.labels) if run.readable else run.summary
    dated = summary.withColumn("timestamp", F.lit(timestamp))
    dated.write.mode("overwrite").parquet(f"{root}/{RUNS}/run_id={run_id}")
    return run_id


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """Recorded runs, newest first, without their findings; unreadable files are skipped."""
    runs = _read(spark, f"{root}/{RUNS}", RUN_FIELDS)
    return runs.orderBy(F.desc("timestamp"), F.desc("run_id"))


def load_run(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """The findings of one run; only its folder is read."""
    return _read(spark, f"{root}/{FINDINGS_DIR}", f"{FINDINGS}, run_id string").where(F.col("run_id") == run_id)


def latest_runs(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """The newest run of each comparison, or of the named one."""
    runs = _read(spark, f"{root}/{RUNS}", RUN_FIELDS)
    if name is not None:
        runs = runs.where(F.col("comparison") == name)
    newest = lambda c: F.max_by(c, F.struct("timestamp", "run_id")).alias(c)
    return runs.groupBy("comparison").agg(newest("run_id"), newest("status"), F.max("timestamp").alias("timestamp"))
