"""Whole studies as one job: scored samples or judge calls in, result rows of all cells out.

A cell (model, dataset, seed, procedure, ...) is a grouping key, so one job serves every cell. Scored
utilities are written once to the shared folder: the texts are the wide part of the data and are read
by a single pass, while gap, curve, interval and votes come from the narrow table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bestofk.functions import scorers
from bestofk.operators import judge as J
from bestofk.operators import metrics as M
from bestofk.operators import resample as R
from bestofk.operators import scoring
from bestofk.session import compiled_by_operator, materialise
from bestofk.sources.results import assemble_cells


#: Column of the normalised dataset name.
NAME = "__dataset_key"


def score_samples(
    samples: DataFrame, cell: Sequence[str], with_keys: bool = False, outcomes: DataFrame | None = None
) -> DataFrame:
    """Utility table (cell..., prompt_id, k, u[, vote_key]) of samples with a ``dataset`` column.

    Names of datasets count without outer white space and case. The rows are routed by name: those with a column-expression rule are
    scored where they are, those of each Python scorer go through Python alone, and programs (humaneval, livecodebench) get the verdict on their recorded
    test runs, so only their keys are joined with ``outcomes``, on the columns of (cell..., dataset, prompt_id, k) that it has. Texts are never shuffled.
    """
    rows = samples.withColumn(NAME, scorers.dataset_key(F.col("dataset")))
    text, truth, name = F.col("text"), F.col("ground_truth"), F.col(NAME)
    python = scorers.python_scorers()
    programs = [n for n in scorers.CODE_DATASETS if n not in scorers.registered()] if outcomes is not None else []
    keys = [*cell, "prompt_id", "k"]
    vote_key = [scorers.named_key(name, text).alias("vote_key")] if with_keys else []
    apart = [*python, *programs]
    here = rows.where(~name.isin(apart) | name.isNull()) if apart else rows
    scored = scorers.native_scores(here, NAME, "text", "ground_truth", "u").select(*keys, "u", *vote_key)
    for python_name, scorer in python.items():
        own = rows.where(name == python_name)
        scored = scored.unionByName(own.select(*keys, scorer(text, truth).alias("u"), *vote_key))
    if programs:
        runs = outcomes.withColumn(NAME, scorers.dataset_key(F.col("dataset"))) if "dataset" in outcomes.columns else outcomes
        on = [c for c in dict.fromkeys([*(c for c in cell if c != "dataset"), NAME, "prompt_id", "k"]) if c in runs.columns]
        own = rows.where(name.isin(programs)).select(*dict.fromkeys([*keys, NAME]), *vote_key)
        scored = scored.unionByName(scoring.all_tests_pass(own, runs, on, "u").drop(NAME))
    with compiled_by_operator(samples.sparkSession):
        return materialise(scored, "utility")


def judged_utility(calls: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Utility table of judge calls (cell..., prompt_id, k, l, verdict_text, a_is_candidate)."""
    voted = J.majority_vote(J.with_votes(calls), [*cell, "prompt_id", "k"])
    return materialise(voted.select(*cell, "prompt_id", "k", "u"), "utility")


def evaluate(
    utility: DataFrame, cell: Sequence[str], k_max: int, n_resamples: int = 1000, confidence: float = 0.95, seed: int = 0,
    weights: str = "counts",
) -> DataFrame:
    """Nested result rows: aggregates, saturation curve and bootstrap interval per cell.

    ``weights`` names the bootstrap: "counts" draws one weight per distinct value, "hash" one per prompt, which other engines can repeat.
    """
    interval = {"counts": R.bootstrap_ci_scaled, "hash": R.bootstrap_ci}[weights]
    per_prompt = M.prompt_gap(utility, cell)
    return assemble_cells(
        M.cell_gap(per_prompt, cell),
        M.saturation_curve(utility, k_max, cell),
        interval(per_prompt, cell, n_resamples=n_resamples, confidence=confidence, seed=seed),
        cell,
    )


def self_consistency(
    keyed: DataFrame, cell: Sequence[str], sizes: Sequence[int], n_draws: int, k_max: int, n_resamples: int = 1000, seed: int = 0
) -> DataFrame:
    """Result rows of self-consistency at several sample sizes, ``sc_n`` being part of the cell."""
    runs = R.sc_votes(keyed, sizes, n_draws, k_max, cell, seed)
    return evaluate(materialise(runs, "votes"), [*cell, "sc_n"], n_draws, n_resamples, seed=seed)
