"""Order statistics and comparisons of prompt sets behind the report tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from bestofk.plans import reports as R

SHARES = (0.0, 1 / 3, 0.5, 2 / 3, 1.0)


def plain(df, column):
    return df.agg(F.percentile(column, F.array(*map(F.lit, SHARES)))).first()[0]


@pytest.mark.parametrize("values", [
    [5.0], [3.0] * 40, [1.0, 1.0, 2.0, 2.0, 2.0, 9.0], [float(i) for i in range(1000)], [-5.0, 1e300, 0.0, -1e300, 2.5],
    [2.0**i for i in range(-60, 60)], [1.0 + i * 2.0**-52 for i in range(50)], [-0.0, 0.0, 1e-320, 2e-320],
])
def test_exact_quantiles_equal_percentile(rows, values):
    shuffled = random.Random(1).sample(values, len(values))
    df = rows([(v,) for v in [*shuffled, None]], "v double")
    assert R.exact_quantiles(df, "v", SHARES) == pytest.approx(plain(df, "v"), rel=1e-15)


def test_exact_quantiles_of_a_million_values(spark, monkeypatch):
    """All different: each pass brings back a bounded number of rows."""
    df = spark.range(1_000_000).select(((F.col("id") * 7_919 % 1_000_003) ** 2 / 3).alias("v"))
    collected, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: collected.append(collect(self)) or collected[-1])
    got = R.exact_quantiles(df, "v", (1 / 3, 2 / 3))
    assert sum(map(len, collected)) <= 4 * R.QUANTILE_BINS * len(collected) and len(collected) <= 5
    monkeypatch.undo()
    assert got == pytest.approx(df.agg(F.percentile("v", F.array(F.lit(1 / 3), F.lit(2 / 3)))).first()[0], rel=1e-15)


def test_no_values(rows):
    df = rows([(None,)], "v double")
    assert R.exact_quantiles(df, "v", (0.5,)) == [None]
    assert R.length_terciles(df, "v").first().bucket == "long"


def test_a_swapped_prompt_is_seen(rows):
    """As many prompts as planned, but one of them is another: not comparable."""
    labels = rows([(1, "a"), (2, "a"), (3, "b"), (4, None)], "prompt_id int, bucket string")
    per_prompt = rows([("same", p, p / 10) for p in (1, 2, 3, 4)] + [("swapped", p, 0.5) for p in (1, 2, 3, 9)] + [("short", p, 0.5) for p in (1, 2, 3)],
                      "model string, prompt_id int, r_hat double")
    models = ["same", "swapped", "short", "absent"]
    got = {r.bucket: r for r in R.gap_by_bucket(per_prompt, labels, models).collect()}
    assert {b: (r.n, r.same) for b, r in got.items()} == {"a": (2, pytest.approx(0.15)), "b": (1, 0.3), None: (1, 0.4)}
    assert all(r.swapped is None and r.short is None and r.absent is None for r in got.values())
    planned = per_prompt.select("model", "prompt_id")
    got = {r.bucket: r for r in R.gap_by_bucket(per_prompt, labels, models, planned=planned).collect()}
    assert got["b"].short == 0.5 and got[None].short is None and got["a"].swapped == 0.5
