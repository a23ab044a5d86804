"""Structured Streaming jobs over the append-only logs.

Every micro-batch writes its own folder, ``batch_id=N``, replacing it when the batch is retried, so the
sinks are idempotent. Checkpoints and tables live in the shared folder of the session; a job that is started again on the same folder goes on
after its last batch.

A log ends with a closing marker (``close_log``): a row without sequence number, later than all others, that lets the watermark pass
everything, so what is still open is given out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from bestofk.operators.judge import with_votes
from bestofk.sources.logs import latest_per_key
from bestofk.streaming.state import BUCKET, BUCKET_STATE, DELTA, DELTA_COLUMNS, PROMPT_ID, prompt_delta, prompt_identity

#: Column that is null in closing markers only.
SEQUENCE = "ingest_seq"


def file_stream(spark: SparkSession, path: str, schema, file_glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def close_log(spark: SparkSession, path: str, schema: T.StructType, ts: str = "ts", after: str = "365 days") -> None:
    """Append the closing marker: one row with nothing but an event time, ``after`` the log's last one.

    The marker ends all state, so ``after`` must exceed the lateness of every job that reads the log.
    """
    last = spark.read.schema(schema).parquet(path).agg((F.max(ts) + F.expr(f"interval {after}")).alias(ts))
    empty = [F.col(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    last.select(*empty).write.mode("append").parquet(path)


def _records(ts: str, sequence: str) -> Column:
    """True for all rows but the markers. It names the event time, so that it is not moved below the watermark, which markers must advance."""
    return F.when(F.col(ts).isNotNull(), F.col(sequence).isNotNull()).otherwise(False)


def run_batches(
    stream: DataFrame, path: str, mode: str, shape: Callable[[DataFrame], DataFrame] | None = None,
    write: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Process what is available, one folder per micro-batch (or what ``write`` does with it)."""

    def to_folder(batch: DataFrame, batch_id: int) -> None:
        rows = shape(batch) if shape else batch
        rows.write.mode("overwrite").parquet(f"{path}/table/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .foreachBatch(write or to_folder)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/table")


def latest_records(
    stream: DataFrame, keys: Sequence[str], path: str, silence: str, lateness: str, order: str = SEQUENCE, ts: str = "ts", sequence: str = SEQUENCE
) -> StreamingQuery:
    """Give out the last record of every key once the key has been silent for ``silence``.

    A key's records without a gap of that length are one session, of which the state holds the last record by ``order``; the watermark, ``lateness`` behind the
    newest event, closes sessions and drops their state. Records of a closed session's time do not count. A key that returns
    later is given out again, so ``last_records`` reads the last of them.
    """
    timely = stream.withWatermark(ts, lateness).where(_records(ts, sequence))
    others = [c for c in timely.columns if c not in keys]
    last = timely.groupBy(*keys, F.session_window(ts, silence)).agg(F.max_by(F.struct(*others), F.col(order)).alias("last"))
    return run_batches(last.select(*keys, "last.*").select(*stream.columns), path, "append")


def last_records(spark: SparkSession, keys: Sequence[str], path: str, order: str = SEQUENCE) -> DataFrame:
    """What ``latest_records`` has given out, one record per key."""
    return latest_per_key(batches(spark, path).drop("batch_id"), keys, order)


def running_cell_gap(stream: DataFrame, cell: Sequence[str], path: str, sequence: str = SEQUENCE, utility: str = "utility") -> StreamingQuery:
    """Keep the gap per cell while decisions arrive.

    The state is three numbers per prompt, kept in buckets of prompts. A batch reads and writes the buckets of its own prompts only; each prompt gives out by
    how much the cell's sums change, and the cell table (one row per cell) of the batch is that of the batch before plus these differences.
    """
    rows = stream.where(F.col(sequence).isNotNull()).withColumns(prompt_identity([*cell, "prompt_id"])).select(
        BUCKET, *PROMPT_ID, *cell, F.col(utility).cast("double").alias(utility))
    out = T.StructType([*[rows.schema[k] for k in cell], *T.StructType.fromDDL(DELTA)])
    deltas = rows.groupBy(BUCKET).applyInPandasWithState(prompt_delta(cell, utility), out, BUCKET_STATE, "update", "NoTimeout")
    table = T.StructType([*[rows.schema[k] for k in cell], *T.StructType.fromDDL("s_circ double, s_bar double, m bigint, k_max bigint")])

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = session.read.schema(table).parquet(f"{path}/table/batch_id={batch_id - 1}") if batch_id else session.createDataFrame([], table)
        both = before.unionByName(batch.select(*cell, *[F.col(d).alias(c) for d, c in zip(DELTA_COLUMNS, table.fieldNames()[len(cell):])]))
        both.groupBy(*cell).agg(
            F.sum("s_circ").alias("s_circ"), F.sum("s_bar").alias("s_bar"), F.sum("m").alias("m"), F.max("k_max").alias("k_max")
        ).write.mode("overwrite").parquet(f"{path}/table/batch_id={batch_id}")

    return run_batches(deltas, path, "update", write=write)


def current_cell_gap(spark: SparkSession, cell: Sequence[str], path: str) -> DataFrame:
    """The gap per cell after the last batch; only that batch's table is read."""
    tables = batches(spark, path)
    last = tables.where(F.col("batch_id") == tables.agg(F.max("batch_id")).scalar())
    mean = lambda c: F.col(c) / F.col("m")
    return last.select(
        *cell, mean("s_circ").alias("u_circ"), mean("s_bar").alias("u_bar"), (mean("s_circ") - mean("s_bar")).alias("r_hat"), "m", "k_max")


def judge_health(stream: DataFrame, cell: Sequence[str], width: str, lateness: str, path: str, sequence: str = SEQUENCE) -> StreamingQuery:
    """Parse-failure rate and A-pick rate per tumbling window, written once, when the watermark has passed the window.

    State is the open windows only; records behind the watermark whose window is closed do not count.
    """
    voted = with_votes(stream.withWatermark("ts", lateness).where(_records("ts", sequence)))
    picked_a = F.when(F.col("a_is_candidate"), F.col("vote") == 1.0).otherwise(F.col("vote") == 0.0)
    rates = voted.groupBy(F.window("ts", width), *cell).agg(
        F.count("*").alias("n_calls"),
        F.avg(F.col("verdict").isNull().cast("double")).alias("parse_failure_rate"),
        F.avg(F.when(F.col("vote") != 0.5, picked_a.cast("double"))).alias("a_pick_rate"),
    )
    closed = rates.select(F.col("window.start").alias("window_start"), *cell, "n_calls", "parse_failure_rate", "a_pick_rate")
    return run_batches(closed, path, "append")


def closed_windows(spark: SparkSession, path: str) -> DataFrame:
    """What ``judge_health`` has written."""
    return batches(spark, path).drop("batch_id")
