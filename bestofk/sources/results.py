"""Result documents: one nested row per experiment cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bestofk.functions.joins import join_cells

CURVE_TYPE = "array<struct<k_prefix:int,u_circ:double,u_bar:double>>"
DOCUMENT_SCHEMA = (
    "hyp string, model string, dataset string, seed int, stage string, procedure string, tau double, sc_n int, "
    f"length int, reu double, aeu double, rvr double, ci_low double, ci_high double, sampling_seconds double, curve {CURVE_TYPE}, "
    "judge string, cache_key_fingerprint string, _corrupt string"
)
FILE_NAME = r"^(.+)_seed\d+(?:_f\d+)?(?:\.json)?\z"


def parse_cell_results(documents: DataFrame, seed: int | None = None) -> DataFrame:
    """Rows from (file_name, value) documents. Malformed ones are left out, a missing seed is 0.

    The dataset id, judge suffix included, comes from the file name where that starts with the model.
    """
    parsed = documents.select(
        "file_name",
        F.from_json("value", DOCUMENT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("d"),
    ).select("file_name", "d.*")
    base = F.nullif(F.regexp_extract("file_name", FILE_NAME, 1), F.lit(""))
    prefix = F.concat(F.coalesce("model", F.lit("")), F.lit("_"))
    named = F.when(base.startswith(prefix), F.substring(base, F.length(prefix) + 1, F.length(base)))
    rows = parsed.where(F.col("_corrupt").isNull()).drop("_corrupt").withColumns(
        {"seed": F.coalesce("seed", F.lit(0)), "dataset_id": F.coalesce(named, "dataset")}
    )
    return rows if seed is None else rows.where(F.col("seed") == seed)


def read_cell_results(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    """Result documents below ``path``, one JSON document per file."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True)
    return parse_cell_results(files.select(F.col("_metadata.file_name").alias("file_name"), "value"), seed)


def assemble_cells(gaps: DataFrame, curve: DataFrame, ci: DataFrame, cell: Sequence[str]) -> DataFrame:
    """One nested row per cell from its aggregates, curve and interval.

    The curve holds a dozen points at most. Per-prompt values stay in the per-prompt table: an
    array of all prompts of a cell would have to be built by one task.
    """
    points = curve.groupBy(*cell).agg(
        F.array_sort(F.collect_list(F.struct("k_prefix", "u_circ", "u_bar"))).alias("curve")
    )
    interval = ci.select(*cell, F.struct("mean", "ci_low", "ci_high", "confidence", "n_resamples").alias("bootstrap"))
    aggregates = gaps.select(*cell, F.struct("u_circ", "u_bar", "r_hat").alias("aggregates"), "m", "k_max")
    return join_cells(join_cells(aggregates, points, cell), interval, cell)


def write_cell_results(cells: DataFrame, path: str, partition: str = "hyp") -> None:
    """Append result rows; the judge is a column, so re-judged cells sit side by side."""
    cells.hint("rebalance", partition).write.mode("append").partitionBy(partition).parquet(path)


def write_tidy_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", True).csv(path)
