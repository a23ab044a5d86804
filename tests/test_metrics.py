"""Metrics, resampling and voting on hand-made tables and by their invariants."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from bestofk.operators import judge as J
from bestofk.operators import metrics as M
from bestofk.operators import resample as R
from bestofk.plans import experiments as E

UTILITY = "prompt_id int, k int, u double"


def matrix(rows, values):
    return rows([(i, k, float(u)) for i, row in enumerate(values) for k, u in enumerate(row)], UTILITY)


def one(df):
    return df.collect()[0].asDict()


def test_binary_matrix(rows):
    gaps = M.prompt_gap(matrix(rows, ["10010", "00000", "00001", "11111", "01110"]))
    assert [r.r_hat for r in gaps.orderBy("prompt_id").collect()] == pytest.approx([0.6, 0.0, 0.8, 0.0, 0.4])
    cell = one(M.cell_gap(gaps))
    assert (cell["u_circ"], cell["m"], cell["k_max"]) == (0.8, 5, 5)
    assert cell["u_bar"] == pytest.approx(0.44) and cell["r_hat"] == pytest.approx(0.36)


def test_continuous_and_degenerate(rows):
    gaps = M.prompt_gap(matrix(rows, [(0.31, 0.05, 0.6, 0.44), (0.12, 0.83, 0.25, 0.2)])).orderBy("prompt_id").collect()
    assert [r.u_circ for r in gaps] == [0.6, 0.83] and gaps[0].u_bar == pytest.approx(0.35)
    for values in (["000", "000"], ["11", "11"], ["1", "0"]):
        assert one(M.cell_gap(M.prompt_gap(matrix(rows, values))))["r_hat"] == 0.0


def test_unreachable_mass(rows):
    u = matrix(rows, ["000001", "000000", "010000", "000000", "001000"])
    assert one(M.a_k(u, 6, 6))["a_k"] == pytest.approx(0.4) and one(M.a_k(u, 2, 6))["a_k"] == pytest.approx(0.8)
    p = rows([(0, 0.0), (1, 0.25), (2, 0.75), (3, 1.0)], "prompt_id int, p_hat double")
    a = {r.k_target: r.a_k for r in M.a_k_extrapolated(p, [2, 5000]).collect()}
    assert a[2] == pytest.approx((1 + 0.5625 + 0.0625) / 4) and a[5000] == pytest.approx(0.25)


def test_curve_matches_prefixes_and_is_monotone(rows):
    rng = random.Random(1)
    u = matrix(rows, [[rng.randint(0, 1) for _ in range(12)] for _ in range(30)])
    curve = {r.k_prefix: r for r in M.saturation_curve(u, 12).collect()}
    assert sorted(curve) == [1, 2, 4, 8, 12] == M.saturation_grid(12)
    for k, point in curve.items():
        want = one(M.prefix_gap(u, k, 12))
        assert point.u_circ == pytest.approx(want["u_circ"]) and point.u_bar == pytest.approx(want["u_bar"])
    best = [curve[k].u_circ for k in sorted(curve)]
    assert best == sorted(best) and curve[1].r_hat == 0.0


def test_bad_arguments(rows):
    u = matrix(rows, ["01"])
    for k in (0, 3):
        with pytest.raises(ValueError):
            M.prefix_gap(u, k, 2)
    with pytest.raises(ValueError):
        M.a_k_extrapolated(u, [0])
    gaps = M.prompt_gap(u)
    for bad in ({"n_resamples": 0}, {"confidence": 1.0}):
        with pytest.raises(ValueError):
            R.bootstrap_ci(gaps, **bad)
    for bad in ({"n": 0, "n_draws": 1}, {"n": 1, "n_draws": 0}):
        with pytest.raises(ValueError):
            R.sc_vote(u, k_max=2, **bad)
    with pytest.raises(ValueError):
        J.judge_worklist(u, 0, 2, 0)


def test_rectangular(rows):
    bad = M.rectangular_violations(rows([(0, 0, 0.0), (0, 1, 0.0), (1, 0, 0.0), (2, 0, 0.0), (2, 0, 0.0), (3, 1, 0.0), (3, 2, 0.0)], UTILITY), [], 2)
    assert sorted(r.prompt_id for r in bad.collect()) == [1, 2, 3]


def test_bootstrap_brackets_and_repeats(rows):
    rng = random.Random(2)
    gaps = M.prompt_gap(matrix(rows, [[rng.randint(0, 1) for _ in range(8)] for _ in range(60)]))
    mean = one(M.cell_gap(gaps))["r_hat"]
    exact, again = one(R.bootstrap_ci(gaps)), one(R.bootstrap_ci(gaps))
    assert exact == again
    assert exact["ci_low"] < mean < exact["ci_high"] and exact["mean"] == pytest.approx(mean, abs=0.01)
    other = one(R.bootstrap_ci(gaps, seed=1))
    assert other != exact
    scaled = one(R.bootstrap_ci_scaled(gaps))
    assert scaled == one(R.bootstrap_ci_scaled(gaps))
    for part in ("mean", "ci_low", "ci_high"):
        assert scaled[part] == pytest.approx(exact[part], abs=0.02)


@pytest.mark.parametrize("means", [R.bootstrap_means, R.bootstrap_means_scaled])
@pytest.mark.parametrize("m", [1, 2, 7, 60, 1500])
def test_every_resample_draws_exactly_m_prompts(spark, means, m):
    gaps = spark.range(m).select(F.when(F.col("id") >= 0, "c").alias("cell"), F.col("id").alias("prompt_id"), (F.col("id") % 97 / 97).alias("r_hat"))
    got = means(gaps.unionByName(gaps.limit(1).withColumns({"prompt_id": F.lit(-1).cast("bigint"), "r_hat": F.lit(None).cast("double")})), ["cell"], n_resamples=40)
    rows = sorted(map(tuple, got.select("b", "n_drawn").collect()))
    assert rows == [(b, m) for b in range(40)]


def test_resamples_are_multinomial(spark):
    """Over many resamples of five prompts, each is drawn as often as any other and their counts spread as a multinomial's."""
    gaps = spark.range(5).select(F.col("id").alias("prompt_id"), (F.col("id") == 0).cast("double").alias("r_hat"))
    for means in (R.bootstrap_means, R.bootstrap_means_scaled):
        shares = [r.resample_mean for r in means(gaps, n_resamples=4000).collect()]
        centre = sum(shares) / len(shares)
        spread = sum((x - centre) ** 2 for x in shares) / len(shares)
        assert centre == pytest.approx(0.2, abs=0.012) and spread == pytest.approx(0.2 * 0.8 / 5, rel=0.12)
        counts = Counter(round(x * 5) for x in shares)
        for k in range(4):
            want = 4000 * math.comb(5, k) * 0.2**k * 0.8 ** (5 - k)
            assert abs(counts[k] - want) < 5 * want**0.5 + 5


def test_scaled_bootstrap_splits_over_several_nodes(spark, monkeypatch):
    monkeypatch.setattr(R, "VALUES_PER_NODE", 16)
    gaps = spark.range(3000).select(F.col("id").alias("prompt_id"), (F.col("id") / 3000).alias("r_hat"))
    means = R.bootstrap_means_scaled(gaps, n_resamples=300).collect()
    assert {r.n_drawn for r in means} == {3000} and len(means) == 300
    spread = sum((r.resample_mean - 0.49983) ** 2 for r in means) / 300
    assert spread == pytest.approx(1 / 12 / 3000, rel=0.35)


def test_clock_bounds_are_poisson():
    bounds = R.mass_bounds(0.7)
    mass = [math.exp(-0.7) * 0.7**i / math.factorial(i) for i in range(len(bounds))]
    assert all(b / 2**32 == pytest.approx(sum(mass[: i + 1]), abs=1e-9) for i, b in enumerate(bounds)) and bounds[-1] < 2**32
    assert R.window(1)[0] == 0.0 and R.window(10_000) == (0.97, pytest.approx(1.0305))


@pytest.mark.parametrize("study", [R.bootstrap_ci, R.bootstrap_ci_scaled])
def test_bootstrap_of_all_different_values(spark, study):
    """As many values as prompts: the interval is that of the normal approximation."""
    n, b = 5000, 200
    cell = spark.range(n).select(F.lit("c").alias("cell"), F.col("id").alias("prompt_id"), (F.col("id") / n).alias("r_hat"))
    found = study(cell, ["cell"], n_resamples=b)
    got, half = one(found), 1.96 * (1 / 12 / n) ** 0.5
    assert got["mean"] == pytest.approx(0.4999, abs=0.001)
    assert got["ci_low"] == pytest.approx(0.4999 - half, abs=half / 3) and got["ci_high"] == pytest.approx(0.4999 + half, abs=half / 3)


def test_null_cell_keys_stay(rows):
    u = rows([(None, p, k, float(p == k)) for p in range(3) for k in range(2)] + [("sft", p, k, 1.0) for p in range(3) for k in range(2)],
             "stage string, prompt_id int, k int, u double")
    for weights in ("counts", "hash"):
        got = {r.stage: r for r in E.evaluate(u, ["stage"], 2, n_resamples=8, weights=weights).collect()}
        assert set(got) == {None, "sft"} and got["sft"].aggregates.r_hat == 0.0 and len(got[None].curve) == 2


def keyed(rows, keys, us):
    return rows([(i, k, key, float(us[i][k])) for i, row in enumerate(keys) for k, key in enumerate(row)],
                "prompt_id int, k int, vote_key string, u double")


def test_sc_vote(rows):
    df = keyed(rows, [list("aaaa"), [None] * 4, list("bbba")], ["1111", "1111", "0001"])
    got = {}
    for r in R.sc_vote(df, n=16, n_draws=6, k_max=4).collect():
        got.setdefault(r.prompt_id, []).append(r.u)
    assert got[0] == [1.0] * 6 and got[1] == [0.0] * 6
    assert len(got[2]) == 6 and sum(got[2]) / 6 < 0.5


def test_sc_vote_ties_go_to_the_first_key(rows):
    """Against a direct count over the same draws."""
    rng = random.Random(3)
    keys = [[rng.choice(["a", "b", "c", None]) for _ in range(6)] for _ in range(20)]
    us = [[rng.randint(0, 1) for _ in range(6)] for _ in range(20)]
    df = keyed(rows, keys, us)
    word = lambda p, d, i: hashlib.md5(f"0|{p}|{d}|{i // 4}".encode()).hexdigest()[8 * (i % 4) : 8 * (i % 4) + 8]
    picks = {(p, d): [int(word(p, d, i), 16) % 6 for i in range(9)] for p in range(20) for d in range(5)}
    for r in R.sc_votes(df, sizes=[4, 1, 9], n_draws=5, k_max=6).collect():
        drawn = picks[(r.prompt_id, r.k)][: r.sc_n]
        counts = Counter(keys[r.prompt_id][i] for i in drawn if keys[r.prompt_id][i] is not None)
        want = 0.0
        if counts:
            mode = counts.most_common(1)[0][0]
            want = float(us[r.prompt_id][next(i for i in drawn if keys[r.prompt_id][i] == mode)])
        assert r.u == want
    plan = R.sc_votes(df, sizes=[2], n_draws=2, k_max=6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


VERDICTS = [("A", True, 1.0), ("A", False, 0.0), ("B", True, 0.0), (" b", False, 1.0), ("T", True, 0.5), ("\n a.", True, 1.0), ("", True, None), ("?", False, None)]


def test_parse_verdict(rows):
    df = rows([(i, t, c) for i, (t, c, _) in enumerate(VERDICTS)], "id int, verdict_text string, a_is_candidate boolean")
    voted = J.with_votes(df).orderBy("id").collect()
    assert [r.verdict for r in voted] == [v for *_, v in VERDICTS]
    assert [r.vote for r in voted] == [0.5 if v is None else v for *_, v in VERDICTS]
    stats = one(J.judge_stats(df))
    assert stats == {"parse_failure_rate": 0.25, "n_judge_calls": 8}


@pytest.mark.parametrize("votes,want", [
    ((1, 1, 1, 0, 0), 1.0), ((0, 0, 0, 1, 1), 0.0), ((1, 1, 0, 0, 0.5), 0.5), ((0.5,) * 5, 0.5), ((1,), 1.0), ((0.5,), 0.5),
    ((1, 1, 0, 0), 1.0), ((1, 0, 0.5, 0.5), 0.5), ((1, 0, 0.5), 0.5), ((0, 0, 1, 0.5), 0.0), ((1,) * 4 + (0,) * 3, 1.0),
])
def test_majority(rows, votes, want):
    df = rows([(0, 0, float(v)) for v in votes], "prompt_id int, k int, vote double")
    assert J.majority_vote(df).first().u == want


def items(rows, table):
    return rows([(i, 0, float(v)) for i, votes in enumerate(table) for v in votes], "prompt_id int, k int, vote double")


def test_alpha(rows):
    alpha = lambda t: J.krippendorff_alpha(items(rows, t), ["prompt_id", "k"]).first().alpha
    assert alpha([(1, 1, 1), (0, 0, 0), (0.5, 0.5, 0.5)]) == pytest.approx(1.0)
    assert alpha([(1, 0), (0, 1)]) < 0
    assert alpha([(1,)]) is None and alpha([(1, 1), (1, 1)]) is None
    assert alpha([(1, 0, 1), (0, 1)]) is None


def test_position_bias_and_margin(rows):
    df = rows([(0, 0, True, 1.0), (0, 0, True, 0.0), (0, 0, False, 1.0), (0, 0, False, 0.0), (0, 0, False, 0.0), (0, 0, True, 0.5)],
              "prompt_id int, k int, a_is_candidate boolean, vote double")
    bias = J.position_bias(df).first()
    assert (bias.a_pick_rate, bias.n_decided) == (0.6, 5)
    assert J.vote_margin(df, ["prompt_id", "k"]).first().mean_margin == 1.0


def tallies(rows, table):
    """(prompt, k, "votes") with 1, 0 and t for a tie."""
    data = [(p, k, v.count("1"), v.count("0"), len(v)) for p, k, v in table]
    return rows(data, "prompt_id int, k int, n_win bigint, n_lose bigint, n_votes bigint")


def test_l_sensitivity_at_the_recorded_votes(rows):
    """All votes used: no spread, and the gap of the plain majority."""
    df = tallies(rows, [(0, 0, "11100"), (0, 1, "00011"), (1, 0, "00000"), (1, 1, "11111")])
    out = {r.l_votes: r for r in R.l_sensitivity(df, n_resamples=10).collect()}
    assert (out[5].r_hat, out[5].r_hat_std) == (0.5, 0.0)
    assert out[1].r_hat_std > 0 and set(out) == {1, 3, 5, 7, 9}


def test_l_sensitivity_of_ragged_panels_and_prompts(rows):
    """Samples with other numbers of votes and prompts with fewer samples are no holes; a missing sample, a repeated one or one without votes is."""
    whole = [(0, 0, "111"), (0, 1, "00011"), (0, 2, "0"), (1, 0, "1t1")]
    known = lambda table, **more: all(r.r_hat is not None for r in R.l_sensitivity(tallies(rows, table), n_resamples=4, **more).collect())
    assert known(whole)
    assert not known([*whole, (2, 1, "111")]) and not known([*whole, (1, 0, "111")]) and not known([*whole, (1, 1, "")])
    expected = lambda n: R.l_sensitivity(tallies(rows, whole).withColumn("planned", F.when(F.col("prompt_id") == 0, 3).otherwise(n)), n_resamples=2, expected="planned")
    assert all(r.r_hat is not None for r in expected(1).collect()) and all(r.r_hat is None for r in expected(2).collect())


def test_l_sensitivity_of_thirty_votes(rows):
    """Fifteen of thirty votes, and sixty: gaps near those of votes drawn one by one."""
    rng = random.Random(8)
    table = [(p, k, "".join(rng.choice("11000t"[(p + k) % 3 :]) for _ in range(30))) for p in range(12) for k in range(4)]
    out = {r.l_votes: r for r in R.l_sensitivity(tallies(rows, table), (15, 16, 60), n_resamples=150).collect()}
    for size in (15, 16, 60):
        trials = []
        for _ in range(150):
            gaps = []
            for p in range(12):
                us = []
                for _, _, votes in table[4 * p : 4 * p + 4]:
                    drawn = rng.sample(votes, size) if size <= 30 else rng.choices(votes, k=size)
                    needed = (size + 1) // 2
                    us.append(1.0 if drawn.count("1") >= needed else 0.0 if drawn.count("0") >= needed else 0.5)
                gaps.append(max(us) - sum(us) / 4)
            trials.append(sum(gaps) / 12)
        mean = sum(trials) / 150
        assert out[size].r_hat == pytest.approx(mean, abs=0.03)
        assert out[size].r_hat_std == pytest.approx((sum((t - mean) ** 2 for t in trials) / 150) ** 0.5, rel=0.5, abs=0.01)


@pytest.mark.parametrize("votes,size", [("11100", 1), ("11100", 3), ("11tt0", 4), ("1100", 2), ("10t", 3)])
def test_outcome_chances_by_enumeration(votes, size):
    subsets = list(itertools.combinations(votes, size))
    needed = (size + 1) // 2
    wins = sum(s.count("1") >= needed for s in subsets)
    losses = sum(s.count("0") >= needed and s.count("1") < needed for s in subsets)
    assert R.outcome_chances(votes.count("1"), votes.count("0"), len(votes), size) == (Fraction(wins, len(subsets)), Fraction(losses, len(subsets)))
    more = list(itertools.product(votes, repeat=len(votes) + 1))
    needed = (len(votes) + 2) // 2
    wins = sum(s.count("1") >= needed for s in more)
    losses = sum(s.count("0") >= needed and s.count("1") < needed for s in more)
    assert R.outcome_chances(votes.count("1"), votes.count("0"), len(votes), len(votes) + 1) == (Fraction(wins, len(more)), Fraction(losses, len(more)))


def test_m_convergence_shrinks(spark):
    rng = random.Random(4)
    gaps = spark.createDataFrame([("c", i, rng.randint(0, 8) / 8) for i in range(300)], "cell string, prompt_id int, r_hat double")
    out = {r.m_sub: r for r in R.m_convergence(gaps, ["cell"], m_grid=(20, 80, 1000), n_resamples=300).collect()}
    assert set(out) == {20, 80, 300} and out[20].half_width > out[80].half_width > out[300].half_width


def test_whole_study(rows):
    """Samples of two datasets in, nested result rows out; votes of the same samples at two sizes."""
    texts = [("gsm8k", p, k, f"#### {v}", "4") for p, vs in enumerate(["4444", "4445", "5555"]) for k, v in enumerate(vs)]
    texts += [("math", p, k, f"\\boxed{{{v}}}", "4") for p, vs in enumerate(["5544", "4555"]) for k, v in enumerate(vs)]
    df = rows(texts, "dataset string, prompt_id int, k int, text string, ground_truth string")
    keyed = E.score_samples(df, ["dataset"], with_keys=True)
    cells = {r.dataset: r for r in E.evaluate(keyed, ["dataset"], 4, n_resamples=50).collect()}
    assert cells["gsm8k"].m == 3 and cells["gsm8k"].aggregates.u_circ == pytest.approx(2 / 3)
    assert [p.k_prefix for p in cells["math"].curve] == [1, 2, 4] and cells["math"].curve[0].u_circ == 0.5
    assert cells["math"].bootstrap.ci_low <= cells["math"].aggregates.r_hat <= cells["math"].bootstrap.ci_high
    votes = {(r.dataset, r.sc_n): r.aggregates.u_bar for r in E.self_consistency(keyed, ["dataset"], [1, 9], 16, 4, 20).collect()}
    assert set(votes) == {(d, n) for d in ("gsm8k", "math") for n in (1, 9)}
    assert votes["gsm8k", 9] >= votes["gsm8k", 1] - 0.1 and votes["gsm8k", 9] == pytest.approx(2 / 3, abs=0.1)


def test_judged_study(rows):
    calls = rows([("c", p, k, l, text, True) for p, k, texts in [(0, 0, "AAB"), (0, 1, "BBA"), (1, 0, "TTT"), (1, 1, "A?T")] for l, text in enumerate(texts)],
                 "cell string, prompt_id int, k int, l int, verdict_text string, a_is_candidate boolean")
    got = {(r.prompt_id, r.k): r.u for r in E.judged_utility(calls, ["cell"]).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 0.0, (1, 0): 0.5, (1, 1): 0.5}
