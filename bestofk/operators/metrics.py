"""Gap metrics over the long utility table (cell keys..., prompt_id, k, u).

``u_circ`` is the best of the first K samples of a prompt, ``u_bar`` their mean, ``r_hat`` the
difference; a cell's value is the mean over its prompts. All are two-level aggregates with
map-side partials: per prompt, then per cell, so neither a prompt nor a cell with very many rows
lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prefix sizes of a saturation curve (doubling).
DOUBLING_LIMIT = 512


def saturation_grid(k_max: int) -> list[int]:
    """1, 2, 4, ... up to the doubling limit or K, and K itself."""
    if k_max < 1:
        raise ValueError(f"K must be >= 1, got {k_max}")
    grid, size = set(), 1
    while size <= min(k_max, DOUBLING_LIMIT):
        grid.add(size)
        size *= 2
    return sorted(grid | {k_max})


def check_prefix(k: int, k_max: int) -> None:
    if not 1 <= k <= k_max:
        raise ValueError(f"K={k} outside [1, {k_max}]")


def prompt_gap(utility: DataFrame, cell: Sequence[str] = ()) -> DataFrame:
    """Per prompt: best, mean, gap and the number of samples."""
    return (
        utility.groupBy(*cell, "prompt_id")
        .agg(F.max("u").alias("u_circ"), F.avg("u").alias("u_bar"), F.count("u").alias("n_samples"))
        .withColumn("r_hat", F.col("u_circ") - F.col("u_bar"))
    )


def cell_gap(per_prompt: DataFrame, cell: Sequence[str] = ()) -> DataFrame:
    """Per cell: mean best (REU), mean mean (AEU), mean gap (RVR), M prompts, K samples."""
    return per_prompt.groupBy(*cell).agg(
        F.avg("u_circ").alias("u_circ"),
        F.avg("u_bar").alias("u_bar"),
        F.avg("r_hat").alias("r_hat"),
        F.count("*").alias("m"),
        F.max("n_samples").alias("k_max"),
    )


def prefix_gap(utility: DataFrame, k: int, k_max: int, cell: Sequence[str] = ()) -> DataFrame:
    """Cell gap from the first ``k`` samples; the predicate reaches the scan."""
    check_prefix(k, k_max)
    gaps = cell_gap(prompt_gap(utility.where(F.col("k") < k), cell), cell)
    return gaps.withColumn("k_prefix", F.lit(k)).drop("k_max")


def saturation_curve(utility: DataFrame, k_max: int, cell: Sequence[str] = ()) -> DataFrame:
    """The triple at every prefix size, in one pass over the samples.

    Each prompt keeps one running maximum and one mean (of the samples it has) per grid point instead of one self-join
    per prefix; the curve becomes rows only after the cell aggregate.
    """
    grid = saturation_grid(k_max)
    inside = {g: F.when(F.col("k") < g, F.col("u")) for g in grid}
    per_prompt = utility.groupBy(*cell, "prompt_id").agg(
        *[F.max(inside[g]).alias(f"best_{g}") for g in grid],
        *[F.avg(inside[g]).alias(f"mean_{g}") for g in grid],
    )
    per_cell = per_prompt.groupBy(*cell).agg(
        *[F.avg(f"best_{g}").alias(f"best_{g}") for g in grid],
        *[F.avg(f"mean_{g}").alias(f"mean_{g}") for g in grid],
    )
    points = F.array(*[
        F.struct(F.lit(g).alias("k_prefix"), F.col(f"best_{g}").alias("u_circ"), F.col(f"mean_{g}").alias("u_bar"))
        for g in grid
    ])
    return per_cell.select(*cell, F.inline(points)).withColumn("r_hat", F.col("u_circ") - F.col("u_bar"))


def p_hat(utility: DataFrame, k: int, k_max: int, cell: Sequence[str] = ()) -> DataFrame:
    """Per prompt success rate over the first ``k`` samples."""
    check_prefix(k, k_max)
    return utility.where(F.col("k") < k).groupBy(*cell, "prompt_id").agg(F.avg("u").alias("p_hat"))


def a_k(utility: DataFrame, k: int, k_max: int, cell: Sequence[str] = ()) -> DataFrame:
    """Unreachable mass at budget ``k``: one minus the mean best."""
    return prefix_gap(utility, k, k_max, cell).select(*cell, "k_prefix", (F.lit(1.0) - F.col("u_circ")).alias("a_k"))


def a_k_extrapolated(success: DataFrame, k_targets: Sequence[int], cell: Sequence[str] = ()) -> DataFrame:
    """Mean of (1 - p)^K at budgets beyond the sampled one, all targets in one aggregate."""
    if not k_targets or min(k_targets) < 1:
        raise ValueError("every K_target must be >= 1")
    miss = F.lit(1.0) - F.col("p_hat")
    wide = success.groupBy(*cell).agg(*[F.avg(F.pow(miss, F.lit(float(k)))).alias(f"a_{k}") for k in k_targets])
    points = F.array(*[F.struct(F.lit(k).alias("k_target"), F.col(f"a_{k}").alias("a_k")) for k in k_targets])
    return wide.select(*cell, F.inline(points))


def cross_seed(seed_means: DataFrame, keys: Sequence[str], value: str = "mean") -> DataFrame:
    """Mean and sample standard deviation over seeds of a per-seed estimate."""
    return seed_means.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n_seeds")
    )


def spike_candidates(per_prompt: DataFrame, cell: Sequence[str] = (), ceiling: float = 0.1) -> DataFrame:
    """Prompts that are solvable but rarely solved."""
    return per_prompt.where(is_spike(ceiling)).select(*cell, "prompt_id", "u_circ", "u_bar")


def is_spike(ceiling: float = 0.1) -> Column:
    return (F.col("u_circ") == 1.0) & (F.col("u_bar") <= ceiling)


def spike_counts(per_prompt: DataFrame, cell: Sequence[str], ceiling: float = 0.1) -> DataFrame:
    return per_prompt.groupBy(*cell).agg(
        F.count_if(is_spike(ceiling)).alias("n_candidates"), F.count("*").alias("n_prompts")
    )


def rectangular_violations(samples: DataFrame, cell: Sequence[str], k_max: int) -> DataFrame:
    """Prompts whose sample indices are not exactly 0..K-1, with what was found instead."""
    if k_max < 1:
        raise ValueError(f"K must be >= 1, got {k_max}")
    found = samples.groupBy(*cell, "prompt_id").agg(
        F.count("*").alias("n_rows"),
        F.count_if((F.col("k") < 0) | (F.col("k") >= k_max) | F.col("k").isNull()).alias("n_outside"),
        F.countDistinct("k").alias("n_distinct"),
    )
    return found.where((F.col("n_rows") != k_max) | (F.col("n_outside") > 0) | (F.col("n_distinct") != k_max))
