"""Append-only logs: verifier decisions, compute hours, finished calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERDICT_SCHEMA = (
    "timestamp timestamp, experiment string, prompt_id string, k int, utility double, raw_verdicts array<double>, "
    "a_is_candidate array<boolean>, judge string, L int, seed int"
)
COMPUTE_SCHEMA = "timestamp timestamp, experiment string, gpu_hours double, metadata map<string,string>"
HYPOTHESES = ("h1", "h2", "h3", "h4")


def latest_per_key(log: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last record of every key. Map tasks keep one record per key before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def read_verdict_log(
    log: DataFrame, experiment: str, match: str = "exact", verdicts: str = "raw_verdicts", keys: Sequence[str] = ("prompt_id", "k")
) -> DataFrame:
    """Final decisions of one experiment that carry verdicts, all with the commonest vote count.

    The experiment filter reaches the scan; re-runs are settled by the last record.
    """
    if match not in ("exact", "prefix"):
        raise ValueError(f"unknown match {match!r}")
    name = F.col("experiment")
    chosen = log.where(name == experiment if match == "exact" else name.startswith(experiment)).where(F.col(verdicts).isNotNull())
    sized = F.size(verdicts) if dict(log.dtypes)[verdicts].startswith("array") else F.length(verdicts)
    final = latest_per_key(chosen, keys, "ingest_seq").withColumn("n_votes", sized)
    modal = final.groupBy("n_votes").count().agg(F.max_by("n_votes", F.struct("count", -F.col("n_votes"))))
    return final.where(F.col("n_votes") == modal.scalar())


def append_verdict_log(records: DataFrame, path: str, partition: str = "dataset") -> None:
    records.hint("rebalance", partition).write.mode("append").partitionBy(partition).parquet(path)


def compute_budget(log: DataFrame) -> DataFrame:
    """GPU hours per hypothesis; the first record of each (experiment, seed) counts."""
    hyp = F.split_part("experiment", F.lit("_"), F.lit(1))
    known = log.withColumn("hyp", hyp).where(F.col("hyp").isin(*HYPOTHESES))
    first = known.groupBy("hyp", "experiment", "seed").agg(F.min_by("gpu_hours", "ingest_seq").alias("gpu_hours"))
    return first.groupBy("hyp").agg(F.sum("gpu_hours").alias("gpu_hours"))


def _json_lines(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """Readable lines with their place in the log: file name, then position in the file."""
    lines = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path, **options)
    place = F.struct(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return lines.select(place.alias("ingest_seq"), *lines.columns)


def verdict_files(spark: SparkSession, path: str) -> DataFrame:
    """Decision log files as an ordered log; absent fields are null."""
    return _json_lines(spark, path, VERDICT_SCHEMA)


def read_compute_log(spark: SparkSession, path: str) -> DataFrame:
    """Compute-log files of all servers as one ordered log."""
    log = _json_lines(spark, path, COMPUTE_SCHEMA, pathGlobFilter="compute_budget*.jsonl")
    return log.select("ingest_seq", "experiment", F.col("metadata")["seed"].alias("seed"), "gpu_hours")


def resume_ledger(lines: DataFrame, keys: Sequence[str] = ("i", "k")) -> DataFrame:
    """Finished calls from JSON lines (ingest_seq, value): torn lines are skipped, the last call wins."""
    fields = ", ".join(f"{k} bigint" for k in keys)
    parsed = lines.select(
        "ingest_seq",
        F.from_json("value", f"{fields}, text string, _torn string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"}).alias("r"),
    ).select("ingest_seq", "r.*")
    whole = parsed.where(F.col("_torn").isNull())
    for column in (*keys, "text"):
        whole = whole.where(F.col(column).isNotNull())
    return latest_per_key(whole.drop("_torn"), keys, "ingest_seq").drop("ingest_seq")
