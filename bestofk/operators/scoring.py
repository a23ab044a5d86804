"""Scoring jobs over a samples table (prompt_id, k, text, ground_truth)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bestofk.functions import text as T
from bestofk.functions.joins import join_cells

# Reason codes in report order, and the limits of a test run in seconds.
BOXED_REASONS = ("no_boxed", "empty_gt", "incorrect", "correct")
NUMBER_TAGS = ("hashed", "boxed", "answer_is", "bare", "none")
TEST_SECONDS = 10.0
TOTAL_SECONDS = 60.0


def score_numeric(samples: DataFrame) -> DataFrame:
    """Add ``answer``, ``pattern``, ``utility`` and a ``reason`` code."""
    found = T.with_number(samples, "text", "answer", "pattern").withColumn("target", T.number_in(F.col("ground_truth")))
    hit = F.coalesce(T.is_close(F.col("answer"), F.col("target")), F.lit(False))
    reason = (
        F.when(F.col("target").isNull(), "gt_unparseable")
        .when(F.col("answer").isNull(), "none")
        .when(hit, F.col("pattern"))
        .otherwise("incorrect")
    )
    return found.withColumns({"utility": hit.cast("double"), "reason": reason})


def score_boxed(samples: DataFrame) -> DataFrame:
    """Add the boxed ``answer``, a ``reason`` code and ``utility``."""
    found = samples.withColumns(
        {"answer": T.last_boxed(F.col("text")), "target": T.boxed_truth(F.col("ground_truth"))}
    )
    return found.withColumn("reason", T.boxed_reason(F.col("answer"), F.col("target"))).withColumn(
        "utility", (F.col("reason") == "correct").cast("double")
    )


def score_shape(samples: DataFrame) -> DataFrame:
    """Add the committed ``span`` and ``utility`` by the shape of the target."""
    spans = samples.withColumns({"span": T.final_span(F.col("text")), "target": T.strip(F.col("ground_truth"))})
    return spans.withColumn("utility", T.shape_match(F.col("span"), F.col("text"), F.col("target")))


def all_tests_pass(
    samples: DataFrame, outcomes: DataFrame, keys: Sequence[str] = ("prompt_id", "k"), utility: str = "utility"
) -> DataFrame:
    """1 when every recorded test of a sample passes within the limits, 0 otherwise or without tests.

    Seconds never fall below zero, so the time spent before some test first exceeds the limit when
    the time before the last one does: total minus the last test, a plain aggregate, not a window.
    """
    ok = (
        F.when(F.col("testtype") == "stdin", T.stdout_match(F.col("returncode"), F.col("stdout"), F.col("expected")))
        .when(F.col("testtype") == "functional", T.json_match(F.col("returncode"), F.col("stdout"), F.col("expected")))
        .otherwise(False)
    )
    # A test without a recorded time counts as one over the limit.
    run = outcomes.withColumn("ok", F.coalesce(ok & (F.col("seconds") <= TEST_SECONDS), F.lit(False)))
    verdict = run.groupBy(*keys).agg(
        F.bool_and("ok").alias("passed"),
        (F.sum("seconds") - F.max_by("seconds", "test_idx")).alias("before_last"),
    )
    passed = F.col("passed") & (F.col("before_last") <= TOTAL_SECONDS)
    return join_cells(samples, verdict, keys, "left").select(
        *samples.columns, F.coalesce(passed, F.lit(False)).cast("double").alias(utility)
    )


def failure_mode_rates(scored: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Percentage of samples per reason code, one column each."""
    return scored.groupBy(*cell).agg(
        *[(F.count_if(F.col("reason") == r) * 100.0 / F.count("*")).alias(r) for r in BOXED_REASONS],
        F.count("*").alias("total"),
    )


def pattern_rates(scored: DataFrame, cell: Sequence[str]) -> DataFrame:
    """How often each extraction rule fires and how often it is right when it does."""
    counted = scored.groupBy(*cell, "pattern").agg(F.count("*").alias("n"), F.sum("utility").alias("right"))
    total = F.sum("n").over(Window.partitionBy(*cell))
    return counted.withColumn("total", total).select(
        *cell,
        "pattern",
        (F.col("n") * 100.0 / F.col("total")).alias("fires_pct"),
        F.when(F.col("pattern") != "none", F.col("right") * 100.0 / F.col("n")).alias("accuracy_pct"),
        "total",
    )
