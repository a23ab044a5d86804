"""Sample store: one Parquet partition per sampling configuration, written once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bestofk.functions.hashing import CONFIG_FIELDS, config_fingerprint, config_json

SAMPLE_SCHEMA = (
    "prompt_id string, prompt string, ground_truth string, samples array<string>"
)
FORMAT_VERSION = 2
HEADER_MARK = '{"_cache_key"'


def stored_samples(spark: SparkSession, path: str) -> DataFrame | None:
    """The whole store, or None before the first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def write_samples(samples: DataFrame, path: str) -> None:
    """Add the configurations in ``samples`` (it has a ``fingerprint`` column) to the store.

    A configuration that is already stored fails the call before anything is written; two calls at a time for one configuration
    must be kept apart by the caller. Rebalancing
    gives small configurations one file each and splits a large one over several tasks.
    """
    stored = stored_samples(samples.sparkSession, path)
    if stored is not None:
        clash = samples.select("fingerprint").distinct().join(stored.select("fingerprint").distinct(), "fingerprint", "left_semi")
        if not clash.isEmpty():
            raise FileExistsError(f"{path} already holds samples for some of these configurations")
    samples.hint("rebalance", "fingerprint").write.mode("append").partitionBy("fingerprint").parquet(path)


def read_samples(spark: SparkSession, path: str, fingerprints: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Samples of the given configurations; only their partitions are listed and scanned.

    A DataFrame of requested fingerprints works too: Spark prunes partitions from it at run time.
    """
    stored = stored_samples(spark, path)
    if stored is None:
        raise FileNotFoundError(f"no sample store at {path}")
    if fingerprints is None:
        return stored
    if isinstance(fingerprints, DataFrame):
        return stored.join(fingerprints.select("fingerprint").distinct(), "fingerprint", "left_semi")
    return stored.where(F.col("fingerprint").isin(list(fingerprints)))


def partition_requests(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """Requested configurations with a ``hit`` flag. The stored side is reduced to its keys first."""
    keys = stored.select("fingerprint").distinct().withColumn("hit", F.lit(True))
    return requested.join(keys, "fingerprint", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_hits(requested: DataFrame, stored: DataFrame) -> DataFrame:
    return requested.join(stored, "fingerprint", "left_semi")


def cache_misses(requested: DataFrame, stored: DataFrame) -> DataFrame:
    return requested.join(stored, "fingerprint", "left_anti")


def import_sample_jsonl(spark: SparkSession, path: str, expected: dict | None = None) -> DataFrame:
    """Rows of JSON-lines sample files (plain or gzip), each checked against its file's header line.

    The header is the first line and names the configuration and the format version. A file without a readable header, with a second one, of
    another version or configuration than ``expected``, without samples, or with a line that is no whole record fails the job. A file of
    no bytes at all has no row that could fail; it holds nothing.
    """
    files = spark.read.text(path, wholetext=False).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.trim("value").alias("line"),
    ).where("line <> ''")
    lines = files.withColumn("is_header", F.col("line").startswith(HEADER_MARK))
    key_schema = "struct<_cache_key:struct<" + ",".join(f"{n}:{t}" for n, t in CONFIG_FIELDS.items()) + ">,_format_version:int>"
    # One row per file: its first line, and how many header lines it has.
    first = F.struct("block", "row")
    heads = lines.groupBy("file").agg(
        F.min_by("line", first).alias("line"), F.count_if("is_header").alias("n_headers"), F.count("*").alias("n_lines")
    ).select("file", "n_headers", "n_lines", F.from_json("line", key_schema).alias("h")).select(
        "file", "n_headers", "n_lines",
        F.col("h._format_version").alias("version"),
        config_fingerprint({n: F.col(f"h._cache_key.{n}") for n in CONFIG_FIELDS}).alias("fingerprint"),
        config_json({n: F.col(f"h._cache_key.{n}") for n in CONFIG_FIELDS}).alias("config"),
    )
    wrong = F.col("version").isNull() | (F.col("version") != FORMAT_VERSION) | (F.col("n_headers") != 1)
    if expected is not None:
        wanted = config_fingerprint({n: F.lit(expected.get(n)) for n in CONFIG_FIELDS})
        wrong = wrong | (F.col("fingerprint") != wanted)
    fail = lambda what: F.raise_error(F.concat(F.lit(what + ": "), F.col("file"))).cast("string")
    guard = F.when(wrong, fail("sample file without the expected header")).when(F.col("n_lines") < 2, fail("sample file without samples"))
    headers = heads.withColumn("fingerprint", F.coalesce(guard, F.col("fingerprint")))
    body = lines.join(headers, "file").where(~F.col("is_header") | (F.col("n_lines") < 2))
    record = F.from_json("line", SAMPLE_SCHEMA + ", _torn string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"})
    rows = body.select("file", "fingerprint", record.alias("r"))
    whole = F.when(F.col("r._torn").isNotNull() | F.col("r.samples").isNull(), fail("torn line in sample file")).otherwise(F.col("fingerprint"))
    return rows.select(whole.alias("fingerprint"), "r.*").drop("_torn")


def explode_samples(wide: DataFrame) -> DataFrame:
    """One row per sample with its index ``k``."""
    rest = [c for c in wide.columns if c != "samples"]
    return wide.select(*rest, F.posexplode("samples").alias("k", "text"))
