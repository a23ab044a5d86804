"""Preference judging around the model call: worklist, prompt text, votes, agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bestofk.functions.hashing import coin
from bestofk.functions.text import render, strip

# The judge's instructions and the layout of its question.
JUDGE_SYSTEM = (
    "You are evaluating two responses to a user's question. Pick the better one. "
    "Answer with exactly one character: A if Response A is better, B if Response B is better, "
    "T if they are equally good."
)
JUDGE_QUESTION = (
    "User question:\n{question}\n\n--- Response A ---\n{a}\n\n--- Response B ---\n{b}\n\n"
    "Which is better? Answer with one letter (A, B, or T):"
)
CALL_SEED_STEP = 100003
VOTE_VALUES = (0.0, 0.5, 1.0)


def judge_worklist(candidates: DataFrame, n_votes: int, k_max: int, seed: int, done: DataFrame | None = None) -> DataFrame:
    """One row per judge call still to make: (ordinal, k, l), a position coin and a call seed.

    ``candidates`` holds (ordinal, prompt_id, k, ...). Each row expands to its own L votes; finished
    calls leave through an anti join on the ledger's key.
    """
    if n_votes < 1:
        raise ValueError(f"L must be >= 1, got {n_votes}")
    calls = (
        candidates.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(n_votes - 1))))
        .withColumn("a_is_candidate", coin(F.lit(seed), "ordinal", "k", "l"))
        .withColumn(
            "call_seed",
            F.lit(seed * CALL_SEED_STEP).cast("bigint") + (F.col("ordinal") * k_max + F.col("k")) * n_votes + F.col("l"),
        )
    )
    return calls if done is None else calls.join(done.select("ordinal", "k", "l"), ["ordinal", "k", "l"], "left_anti")


def judge_prompt(question: Column, candidate: Column, reference: Column, a_is_candidate: Column) -> Column:
    """Question text with the two responses ordered by the coin."""
    first = F.when(a_is_candidate, candidate).otherwise(reference)
    second = F.when(a_is_candidate, reference).otherwise(candidate)
    return render(JUDGE_QUESTION, {"question": question, "a": first, "b": second})


def parse_verdict(text: Column, a_is_candidate: Column) -> Column:
    """1 when the candidate was picked, 0 when the reference was, 0.5 for a tie, else null."""
    letter = F.upper(F.substring(strip(text), 1, 1))
    return (
        F.when(letter == "A", a_is_candidate.cast("double"))
        .when(letter == "B", (~a_is_candidate).cast("double"))
        .when(letter == "T", F.lit(0.5))
    )


def with_votes(calls: DataFrame) -> DataFrame:
    """Add the parsed verdict and the vote; what does not parse votes one half."""
    verdict = parse_verdict(F.col("verdict_text"), F.col("a_is_candidate"))
    return calls.withColumn("verdict", verdict).withColumn("vote", F.coalesce("verdict", F.lit(0.5)))


def majority(wins: Column, losses: Column, n_votes: int | Column) -> Column:
    """Half of the votes, rounded up, decides; an even split of wins and losses is a win."""
    needed = F.lit((n_votes + 1) // 2) if isinstance(n_votes, int) else F.floor((n_votes + 1) / 2)
    return F.when(wins >= needed, 1.0).when(losses >= needed, 0.0).otherwise(0.5)


def majority_vote(votes: DataFrame, item: Sequence[str] = ("prompt_id", "k")) -> DataFrame:
    """Utility per sample from its votes."""
    counted = vote_counts(votes, item)
    return counted.withColumn("u", majority(F.col("n_win"), F.col("n_lose"), F.col("n_votes")))


def vote_counts(votes: DataFrame, item: Sequence[str]) -> DataFrame:
    return votes.groupBy(*item).agg(
        F.count_if(F.col("vote") == 1.0).alias("n_win"),
        F.count_if(F.col("vote") == 0.0).alias("n_lose"),
        F.count_if(F.col("vote") == 0.5).alias("n_tie"),
        F.count("*").alias("n_votes"),
    )


def judge_stats(calls: DataFrame, cell: Sequence[str] = ()) -> DataFrame:
    return with_votes(calls).groupBy(*cell).agg(
        F.avg(F.col("verdict").isNull().cast("double")).alias("parse_failure_rate"),
        F.count("*").alias("n_judge_calls"),
    )


def position_bias(votes: DataFrame, cell: Sequence[str] = ()) -> DataFrame:
    """Among decided votes, the share that went to the response in slot A."""
    picked_a = F.when(F.col("a_is_candidate"), F.col("vote") == 1.0).otherwise(F.col("vote") == 0.0)
    return votes.where(F.col("vote") != 0.5).groupBy(*cell).agg(
        F.avg(picked_a.cast("double")).alias("a_pick_rate"), F.count("*").alias("n_decided")
    )


def vote_margin(votes: DataFrame, item: Sequence[str], cell: Sequence[str] = ()) -> DataFrame:
    counted = vote_counts(votes, [*cell, *item])
    return counted.groupBy(*cell).agg(F.avg(F.abs(F.col("n_win") - F.col("n_lose"))).alias("mean_margin"))


def krippendorff_alpha(votes: DataFrame, item: Sequence[str], cell: Sequence[str] = ()) -> DataFrame:
    """Agreement of the votes over {0, 1/2, 1} with squared differences.

    Disagreement is a quadratic form in the per-item category counts, so three sums of products
    and three totals per cell are the whole state; no pair of votes is ever formed. Undefined (null) with fewer than two votes or
    categories, or where items have different numbers of votes.
    """
    counts = vote_counts(votes, [*cell, *item])
    lose, tie, win = F.col("n_lose"), F.col("n_tie"), F.col("n_win")
    sums = counts.groupBy(*cell).agg(
        F.sum(lose).cast("double").alias("t_lose"),
        F.sum(tie).cast("double").alias("t_tie"),
        F.sum(win).cast("double").alias("t_win"),
        F.sum(lose * tie).cast("double").alias("lose_tie"),
        F.sum(tie * win).cast("double").alias("tie_win"),
        F.sum(lose * win).cast("double").alias("lose_win"),
        F.when(F.min("n_votes") == F.max("n_votes"), F.max("n_votes")).cast("double").alias("l_votes"),
        F.count("*").alias("n_items"),
    )
    # Neighbouring categories differ by 1/2, the outer two by 1; equal ones drop out.
    total = F.col("t_lose") + F.col("t_tie") + F.col("t_win")
    observed = 2 * (0.25 * (F.col("lose_tie") + F.col("tie_win")) + F.col("lose_win")) / (F.col("l_votes") - 1)
    expected = (
        2 * (0.25 * (F.col("t_lose") * F.col("t_tie") + F.col("t_tie") * F.col("t_win")) + F.col("t_lose") * F.col("t_win"))
        / (total - 1)
    )
    seen = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in ("t_lose", "t_tie", "t_win")), F.lit(0))
    alpha = F.when(F.col("l_votes").isNull() | (F.col("l_votes") < 2) | (seen < 2), F.lit(None).cast("double")).when(expected == 0, 1.0).otherwise(
        1.0 - observed / expected
    )
    return sums.select(*cell, alpha.alias("alpha"), "n_items")
