"""Streaming jobs over logs of many files: restarts, retried batches, late records, eviction and closing."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import types as T

from bestofk.operators.metrics import cell_gap, prompt_gap
from bestofk.sources import logs
from bestofk.streaming import jobs
from bestofk.streaming.state import PROMPT_BUCKETS


def schema(**kinds):
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


LONG, TIME, TEXT = T.LongType(), T.TimestampType(), T.StringType()
LOG = schema(ingest_seq=LONG, ts=TIME, experiment=TEXT, prompt_id=TEXT, k=T.IntegerType(), utility=T.DoubleType())
KEYS = ["experiment", "prompt_id", "k"]
START = 1_700_000_000


def append(spark, path, records):
    """One file per call; records are (seq, seconds, experiment, prompt, k, utility)."""
    rows = [(seq, dt.datetime.fromtimestamp(START + s, dt.timezone.utc).replace(tzinfo=None), *rest) for seq, s, *rest in records]
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(path)


def load(batch, per_batch=40):
    return [(batch * 100 + i, batch * 1000 + i, "e" if i % 3 else "f", f"p{i % 5}", i % 4, float((i + batch) % 7 == 0)) for i in range(per_batch)]


def stream(spark, path):
    return jobs.file_stream(spark, path, LOG, files_per_batch=1)


def values(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.fixture
def log(spark, tmp_path):
    path = str(tmp_path / "log")
    for batch in range(4):
        append(spark, path, load(batch))
    return path


def test_last_records_over_a_restart(spark, log, tmp_path):
    """Eight files in two runs on one checkpoint; the marker gives out what is still held."""
    out = str(tmp_path / "last")
    first = jobs.latest_records(stream(spark, log), KEYS, out, "30 minutes", "10 minutes")
    held = first.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert held > 0
    for batch in range(4, 8):
        append(spark, log, load(batch))
    jobs.latest_records(stream(spark, log), KEYS, out, "30 minutes", "10 minutes")
    assert len(list((tmp_path / "last" / "table").glob("batch_id=*"))) >= 8
    want = logs.latest_per_key(spark.read.schema(LOG).parquet(log), KEYS, "ingest_seq")
    jobs.close_log(spark, log, LOG)
    closing = jobs.latest_records(stream(spark, log), KEYS, out, "30 minutes", "10 minutes")
    assert values(jobs.last_records(spark, KEYS, out), *want.columns) == values(want, *want.columns)
    assert closing.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_state_is_bounded_by_the_watermark(spark, tmp_path):
    """Every batch has keys of its own: what a batch leaves behind is gone two batches later."""
    path, out = str(tmp_path / "log"), str(tmp_path / "last")
    for batch in range(8):
        append(spark, path, [(batch * 10 + i, batch * 10_000 + i, "e", f"p{batch}-{i}", 0, 1.0) for i in range(10)])
    query = jobs.latest_records(stream(spark, path), KEYS, out, "1 hour", "30 minutes")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) >= 8 and max(held) <= 20
    assert jobs.batches(spark, out).count() == 70  # the last batch's keys are still open


def test_last_record_is_by_sequence_and_late_ones_do_not_count(spark, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "last")
    append(spark, path, [(5, 50_000, "e", "p", 0, 0.5), (9, 49_000, "e", "p", 0, 0.9), (1, 50_000, "e", "q", 0, 0.1)])
    append(spark, path, [(10, 50_100, "e", "p", 0, 1.0), (8, 50_200, "e", "q", 0, 0.8)])
    append(spark, path, [(99, 100, "e", "p", 0, 0.0), (3, 50_300, "e", "q", 0, 0.3)])  # the first is a day behind the watermark
    jobs.close_log(spark, path, LOG)
    jobs.latest_records(stream(spark, path), KEYS, out, "1 hour", "30 minutes")
    assert values(jobs.last_records(spark, KEYS, out), "prompt_id", "ingest_seq", "utility") == [("p", 10, 1.0), ("q", 8, 0.8)]


def batch_gap(spark, path):
    rows = spark.read.schema(LOG).parquet(path).where("ingest_seq is not null").withColumnRenamed("utility", "u")
    return {r.experiment: r for r in cell_gap(prompt_gap(rows, ["experiment"]), ["experiment"]).collect()}


def check_gap(spark, path, out):
    want, got = batch_gap(spark, path), {r.experiment: r for r in jobs.current_cell_gap(spark, ["experiment"], out).collect()}
    assert set(got) == set(want)
    for cell, row in want.items():
        for column in ("u_circ", "u_bar", "r_hat", "m", "k_max"):
            assert got[cell][column] == pytest.approx(row[column]), (cell, column)


def test_running_gap_over_restarts(spark, log, tmp_path):
    out = str(tmp_path / "gap")
    jobs.running_cell_gap(stream(spark, log), ["experiment"], out)
    check_gap(spark, log, out)
    for batch in range(4, 8):
        append(spark, log, [*load(batch, 7), (9000 + batch, 1, None, "p0", 0, 0.25), (9100 + batch, 1, "e", "p1", 0, None)])
    jobs.running_cell_gap(stream(spark, log), ["experiment"], out)
    check_gap(spark, log, out)


def test_running_gap_with_a_failed_batch(spark, log, tmp_path, monkeypatch):
    """The third batch fails after its table is written; the restart repeats it without counting it twice."""
    out, run, failed = str(tmp_path / "gap"), jobs.run_batches, []

    def fails_once(deltas, path, mode, shape=None, write=None):
        def torn(batch, batch_id):
            write(batch, batch_id)
            if batch_id == 2 and not failed:
                failed.append(batch_id)
                raise RuntimeError("lost")

        return run(deltas, path, mode, shape, torn)

    monkeypatch.setattr(jobs, "run_batches", fails_once)
    with pytest.raises(Exception, match="lost"):
        jobs.running_cell_gap(stream(spark, log), ["experiment"], out)
    jobs.running_cell_gap(stream(spark, log), ["experiment"], out)
    assert failed == [2]
    check_gap(spark, log, out)


def test_a_batch_touches_its_own_prompts_only(spark, log, tmp_path):
    out = str(tmp_path / "gap")
    jobs.running_cell_gap(stream(spark, log), ["experiment"], out)
    append(spark, log, [(7000, 9000, "e", "p1", 0, 1.0)])
    query = jobs.running_cell_gap(stream(spark, log), ["experiment"], out)
    assert sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]) == 1
    check_gap(spark, log, out)


def test_prompts_share_states(spark, tmp_path):
    """Many prompts, ids and cells that are null among them: the state function is called per bucket, not per prompt."""
    path, out = str(tmp_path / "log"), str(tmp_path / "gap")
    for batch in range(2):
        append(spark, path, [
            (batch * 10_000 + i, i, [None, "e", "p3"][i % 3], None if i % 50 == 0 else f"p{i}", 0, ((i + batch) % 5) / 4) for i in range(10_000)])
    query = jobs.running_cell_gap(stream(spark, path), ["experiment"], out)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= PROMPT_BUCKETS
    check_gap(spark, path, out)


CALLS = schema(ingest_seq=LONG, ts=TIME, model=TEXT, verdict_text=TEXT, a_is_candidate=T.BooleanType())


def calls(spark, path, records):
    rows = [(seq, dt.datetime.fromtimestamp(START - START % 3600 + s, dt.timezone.utc).replace(tzinfo=None), "m", text, True) for seq, s, text in records]
    spark.createDataFrame(rows, CALLS).coalesce(1).write.mode("append").parquet(path)


def test_windows_close_once(spark, tmp_path):
    """A record behind the watermark whose window is closed is dropped, one inside counts; the marker closes the rest."""
    path, out = str(tmp_path / "log"), str(tmp_path / "health")
    health = lambda: jobs.judge_health(jobs.file_stream(spark, path, CALLS, files_per_batch=1), ["model"], "1 hour", "30 minutes", out)
    calls(spark, path, [(1, 100, "A"), (2, 200, "??")])
    calls(spark, path, [(3, 3700, "A"), (4, 3000, "B")])  # hour 0 is still open
    calls(spark, path, [(5, 9000, "A")])  # the watermark closes hour 0 (and not hour 1, up to 7200 < 9000 - 1800: closed as well)
    health()
    calls(spark, path, [(6, 150, "A"), (7, 8000, "T")])  # the first is late, the second inside the open hour 2
    health()
    hours = {r.window_start: r for r in jobs.closed_windows(spark, out).collect()}
    assert len(hours) == 2
    jobs.close_log(spark, path, CALLS)
    last = health()
    got = sorted((r.window_start, r.n_calls, r.parse_failure_rate, r.a_pick_rate) for r in jobs.closed_windows(spark, out).collect())
    assert [g[1:] for g in got] == [(3, pytest.approx(1 / 3), 0.5), (1, 0.0, 1.0), (2, 0.0, 1.0)]
    assert last.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
