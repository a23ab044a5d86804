"""Registered streaming queries: the events arrive as a log of several files, in two loads with a restart between them, and the log is closed."""

from __future__ import annotations

from pyspark.sql import functions as F

from bestofk.functions.hashing import coin
from bestofk.plans import inputs as I
from bestofk.plans import sqlparts as S
from bestofk.plans.metric_queries import rounded
from bestofk.plans.registry import query
from bestofk.session import shared_dir
from bestofk.streaming import jobs

LOG_PARTS = 4


def follow(spark, d, start):
    """Write the events in order as a growing log and let ``start(stream)`` drain it, a part per batch: after half of the parts, and again after the
    rest and the closing marker."""
    events = I.table(spark, d, "events")
    path = shared_dir(spark, "log")
    after_last = (events.agg(F.max("event_id")).first()[0] or 0) + 1

    def drain():
        n_files = len(spark.read.parquet(path).inputFiles())
        return start(jobs.file_stream(spark, path, events.schema, files_per_batch=max(1, n_files // LOG_PARTS)))

    for part in range(LOG_PARTS):
        low, high = after_last * part // LOG_PARTS, after_last * (part + 1) // LOG_PARTS
        events.where(F.col("event_id").between(low, high - 1)).write.mode("append").parquet(path)
        if part + 1 == LOG_PARTS // 2:
            drain()
    jobs.close_log(spark, path, events.schema)
    return drain()


@query("stream_verdict_dedup", S.with_(S.AUDIT) + """
select experiment, prompt_id, k, ingest_seq, verdicts, utility from audit where verdicts is not null
qualify row_number() over (partition by experiment, prompt_id, k order by ingest_seq desc) = 1""")
def stream_verdict_dedup(spark, d):
    """A record is given out when its key has been silent for ten days; of the keys that return the last one given out counts."""
    path, keys = shared_dir(spark, "stream"), ["experiment", "prompt_id", "k"]
    judged = F.col("verdicts").isNotNull() | F.col("ingest_seq").isNull()
    follow(spark, d, lambda events: jobs.latest_records(I.audit_records(events).where(judged), keys, path, "10 days", "1 day"))
    return jobs.last_records(spark, keys, path).drop("ts")


@query("stream_cell_gap", S.with_(S.AUDIT) + """
select experiment, round(avg(c), 12) as u_circ, round(avg(b), 12) as u_bar, round(avg(c - b), 12) as r_hat, count(*) as m, max(n) as k_max
from (select experiment, prompt_id, max(utility) as c, avg(utility) as b, count(*) as n from audit group by all) group by all""")
def stream_cell_gap(spark, d):
    path = shared_dir(spark, "stream")
    follow(spark, d, lambda events: jobs.running_cell_gap(I.audit_records(events), ["experiment"], path))
    return rounded(jobs.current_cell_gap(spark, ["experiment"], path), "u_circ", "u_bar", "r_hat")


@query("stream_judge_health", f"""
select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, 'm' || cast(user_id % 3 as varchar) as model, count(*) as n_calls,
       round(avg((event_type = 'signup')::double), 12) as parse_failure_rate,
       round(avg(case when event_type in ('click', 'purchase') then 1.0 when event_type = 'view' then 0.0 end), 12) as a_pick_rate
from events group by all""")
def stream_judge_health(spark, d):
    said = F.coalesce(*[F.when(F.col("event_type") == kind, text) for kind, text in I.VERDICT_TEXT.items()])
    path = shared_dir(spark, "stream")

    def start(events):
        calls = events.select(
            F.col("event_id").alias("ingest_seq"), F.col("ts").cast("timestamp").alias("ts"), I.model_name(F.col("user_id")).alias("model"),
            said.alias("verdict_text"), coin(F.lit(0), "event_id").alias("a_is_candidate"),
        )
        return jobs.judge_health(calls, ["model"], "1 day", "1 day", path)

    follow(spark, d, start)
    return rounded(
        jobs.closed_windows(spark, path).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "model", "n_calls", "parse_failure_rate", "a_pick_rate"),
        "parse_failure_rate", "a_pick_rate",
    )
