"""Registered metric and resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bestofk.functions.joins import join_cells
from bestofk.functions.registry import VOTE_SIZES
from bestofk.operators import metrics as M
from bestofk.operators import resample as R
from bestofk.plans import inputs as I
from bestofk.plans import sqlparts as S
from bestofk.plans.registry import query
from bestofk.session import materialise

CELL = ["model", "dataset"]
K = I.K_SAMPLES


def rounded(df, *columns, digits=12):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def gaps(spark, d, column="u"):
    return M.prompt_gap(I.cell_utility(spark, d, column), CELL)


@query("prompt_gap", S.with_(S.UTILITY, S.PROMPT_GAP) + "select prompt_id, u_circ, u_bar, r_hat, n_samples from prompt_gap")
def prompt_gap(spark, d):
    return M.prompt_gap(I.utility(spark, d))


@query("cell_gap", S.with_(S.UTILITY, S.PROMPT_GAP) + """
select model, dataset, round(avg(u_circ), 12) as u_circ, round(avg(u_bar), 12) as u_bar, round(avg(r_hat), 12) as r_hat,
       count(*) as m, max(n_samples) as k_max from prompt_gap group by all""")
def cell_gap(spark, d):
    return rounded(M.cell_gap(gaps(spark, d), CELL), "u_circ", "u_bar", "r_hat")


@query("prefix_gap", S.with_(S.UTILITY) + """
select model, dataset, round(avg(c), 12) as u_circ, round(avg(b), 12) as u_bar, round(avg(c - b), 12) as r_hat, count(*) as m, 12 as k_prefix
from (select model, dataset, prompt_id, max(u3) as c, avg(u3) as b from utility where k < 12 group by all) group by all""")
def prefix_gap(spark, d):
    return rounded(M.prefix_gap(I.cell_utility(spark, d, "u3"), 12, K, CELL), "u_circ", "u_bar", "r_hat")


@query("saturation_curve", S.with_(S.UTILITY) + """
select model, dataset, k_prefix, round(avg(c), 12) as u_circ, round(avg(b), 12) as u_bar, round(avg(c) - avg(b), 12) as r_hat
from (select model, dataset, prompt_id, g.k as k_prefix, max(u) as c, avg(u) as b
      from utility u join (values (1), (2), (4), (8), (16), (32), (64)) g(k) on u.k < g.k group by all) group by all""")
def saturation_curve(spark, d):
    return rounded(M.saturation_curve(I.cell_utility(spark, d), K, CELL), "u_circ", "u_bar", "r_hat")


@query("p_hat", S.with_(S.UTILITY) + "select prompt_id, avg(u) as p_hat from utility where k < 32 group by all")
def p_hat(spark, d):
    return M.p_hat(I.utility(spark, d), 32, K)


@query("a_k", S.with_(S.UTILITY) + """
select model, dataset, 16 as k_prefix, round(1 - avg(c), 12) as a_k
from (select model, dataset, prompt_id, max(u) as c from utility where k < 16 group by all) group by all""")
def a_k(spark, d):
    return rounded(M.a_k(I.cell_utility(spark, d), 16, K, CELL), "a_k")


@query("a_k_extrapolated", S.with_(S.UTILITY) + """
select model, dataset, t.k as k_target, round(avg(pow(1 - p, t.k)), 12) as a_k
from (select model, dataset, prompt_id, avg(u) as p from utility group by all), (values (1), (64), (256), (1024)) t(k) group by all""")
def a_k_extrapolated(spark, d):
    success = M.p_hat(I.cell_utility(spark, d), K, K, CELL)
    return rounded(M.a_k_extrapolated(success, [1, 64, 256, 1024], CELL), "a_k")


CI_COLUMNS = ("mean", "ci_low", "ci_high")


@query("bootstrap_ci", S.with_(S.UTILITY, S.PROMPT_GAP, S.bootstrap("prompt_gap", "model, dataset")) + """
select model, dataset, round(mean, 12) as mean, round(ci_low, 12) as ci_low, round(ci_high, 12) as ci_high,
       0.95::double as confidence, 1000 as n_resamples from boot_ci""")
def bootstrap_ci(spark, d):
    return rounded(R.bootstrap_ci(gaps(spark, d), CELL), *CI_COLUMNS)


@query("bootstrap_ci_scaled", S.with_(S.UTILITY, S.PROMPT_GAP) + """
select dataset, count(*) as m, true as mean_fits, true as low_fits, true as high_fits from prompt_gap group by all""")
def bootstrap_ci_scaled(spark, d):
    """Drawn otherwise than SQL can repeat, so it is held against the normal interval of the mean: the mean of 1000 resamples
    within 5 of its standard errors, the ends within a half of the interval's half-width."""
    per_prompt = gaps(spark, d)
    exact = per_prompt.groupBy("dataset").agg(
        F.count("*").alias("m"), F.avg("r_hat").alias("centre"), (F.stddev_pop("r_hat") / F.sqrt(F.count("*"))).alias("error"))
    half = 1.959964 * F.col("error")
    near = lambda value, target, bound: F.abs(F.col(value) - target) <= bound + 1e-9
    return R.bootstrap_ci_scaled(per_prompt, ["dataset"]).join(exact, "dataset").select(
        "dataset", "m", near("mean", F.col("centre"), 5 * F.col("error") / F.sqrt(F.lit(1000.0)) + F.col("error") / F.col("m")).alias("mean_fits"),
        near("ci_low", F.col("centre") - half, half / 2).alias("low_fits"), near("ci_high", F.col("centre") + half, half / 2).alias("high_fits"),
    )


def numeric_keyed(spark, d):
    """Scored samples with their vote key: each text is read once for both."""
    from bestofk.functions import text as T

    s = I.samples(spark, d).withColumn("answer", T.number_in(F.col("text")))
    u = T.both_close(F.col("answer"), T.number_in(F.col("ground_truth"))).cast("double")
    return s.select("prompt_id", "k", F.col("answer").alias("vote_key"), u.alias("u"))


KEYED_SQL = """keyed as (
  select prompt_id, k, cast(case when f < 5 then q end as double) as vote_key,
         cast(coalesce(f < 5 and q = g, false) as double) as u from forms)"""


def sc_sql(n: int, draws: int) -> str:
    return f"""sc as (
  select prompt_id, draw as k, coalesce(max_by(u_first, case when vote_key is not null then votes * {n + 1} - first_pos end), 0.0) as u
  from (select d.prompt_id, d.draw, x.vote_key, count(*) as votes, min(d.pos) as first_pos, arg_min(x.u, d.pos) as u_first
        from (select p.prompt_id, cast(a.range as integer) as draw, b.range as pos,
                     cast('0x' || substr(md5(concat_ws('|', 0, p.prompt_id, a.range, b.range // 4)), 1 + 8 * (b.range % 4)::int, 8) as bigint) % p.n as pick
              from (select prompt_id, count(*) as n from keyed group by all) p, range({draws}) a, range({n}) b) d
        join keyed x on x.prompt_id = d.prompt_id and x.k = d.pick group by all)
  group by all)"""


@query("sc_vote", S.with_(S.FORMS, KEYED_SQL, sc_sql(5, 64)) + "select prompt_id, k, u from sc")
def sc_vote(spark, d):
    return R.sc_vote(numeric_keyed(spark, d), n=5, n_draws=64, k_max=I.K_TEXTS)


SWEEP_CELL = ["procedure", "tau", "sc_n", "length", "stage"]
SWEEP_LENGTHS = (16, 32, 64)
_GAP_SQL = "prompt_id, max(u) as u_circ, avg(u) as u_bar, max(u) - avg(u) as r_hat"


def sweep_sql(sizes, draws) -> str:
    votes = ",\n".join(sc_sql(n, draws).replace("sc as (", f"sc{n} as (", 1) for n in sizes)
    return S.with_(S.FORMS, KEYED_SQL, votes, f"""runs as (
  select 'direct' as procedure, t.tau::double as tau, null::int as sc_n, null::int as length, null::varchar as stage, prompt_id, u
  from keyed join (values (0.0, 64), (0.7, 2), (1.0, 1)) t(tau, step) on k % t.step = 0
  union all select 'budget', null, null, t.l, null, prompt_id, case when k < t.l then u else 0.0 end from keyed, (values (16), (32), (64)) t(l)
  union all select 'stage', null, null, null, case k % 3 when 0 then 'sft' when 1 then 'dpo' else 'rlvr' end, prompt_id, u from keyed
  {" ".join(f"union all select 'sc', null, {n}, null, null, prompt_id, u from sc{n}" for n in sizes)}),
swept as (select procedure, tau, sc_n, length, stage, {_GAP_SQL} from runs group by all)""",
    S.bootstrap("swept", "procedure, tau, sc_n, length, stage")) + """
select s.*, round(ci.ci_low, 12) as ci_low, round(ci.ci_high, 12) as ci_high
from (select procedure, tau, sc_n, length, stage, round(avg(u_circ), 12) as u_circ, round(avg(u_bar), 12) as u_bar, round(avg(r_hat), 12) as r_hat,
             count(*) as m from swept group by all) s
join boot_ci ci on ci.procedure = s.procedure and ci.tau is not distinct from s.tau and ci.sc_n is not distinct from s.sc_n
  and ci.length is not distinct from s.length and ci.stage is not distinct from s.stage"""


@query("procedure_sweep_full", sweep_sql(VOTE_SIZES, I.K_TEXTS))
@query("procedure_sweep", sweep_sql(VOTE_SIZES, I.K_TEXTS))
def procedure_sweep(spark, d, sizes=VOTE_SIZES, draws=I.K_TEXTS):
    """Direct sampling at three temperatures (greedy is one sample, so without a gap), reasoning budgets, training stages and
    self-consistency at every size of the study with as many draws per prompt as direct samples, in one job; the settings that a procedure
    does not have are null."""
    keyed = materialise(numeric_keyed(spark, d), "keyed")
    kinds = {"tau": "double", "sc_n": "int", "length": "int", "stage": "string"}
    gap = ("u_circ", "u_bar", "n_samples")

    def cell(procedure, **setting):
        return [F.lit(procedure).alias("procedure"), *[F.lit(setting.get(c)).cast(kind).alias(c) for c, kind in kinds.items()]]

    k, u = F.col("k"), F.col("u")
    cells = [(cell("direct", tau=tau), F.when(k % step == 0, u)) for tau, step in ((0.0, I.K_TEXTS), (0.7, 2), (1.0, 1))]
    cells += [(cell("budget", length=length), F.when(k < length, u).otherwise(0.0)) for length in SWEEP_LENGTHS]
    cells += [(cell("stage", stage=stage), F.when(k % 3 == i, u)) for i, stage in enumerate(I.STAGES)]
    # One row per prompt with the gap of every setting; a setting without samples has no row.
    wide = keyed.groupBy("prompt_id").agg(*[
        F.struct(*[f(x).alias(c) for f, c in zip((F.max, F.avg, F.count), gap)]).alias(f"gap_{i}") for i, (_, x) in enumerate(cells)])
    points = [F.when(F.col(f"gap_{i}.n_samples") > 0, F.struct(*name, *[F.col(f"gap_{i}.{c}").alias(c) for c in gap])) for i, (name, _) in enumerate(cells)]
    runs = wide.select("prompt_id", F.inline(F.array_compact(F.array(*points)))).withColumn("r_hat", F.col("u_circ") - F.col("u_bar"))
    votes = R.sc_gaps(keyed, sizes, n_draws=draws, k_max=I.K_TEXTS)
    votes = votes.withColumns({"procedure": F.lit("sc"), **{c: F.lit(None).cast(kind) for c, kind in kinds.items() if c != "sc_n"}})
    per_prompt = materialise(runs.unionByName(votes), "sweep")
    ci = R.bootstrap_ci(per_prompt, SWEEP_CELL).select(*SWEEP_CELL, "ci_low", "ci_high")
    wide = join_cells(M.cell_gap(per_prompt, SWEEP_CELL).drop("k_max"), ci, SWEEP_CELL)
    return rounded(wide, "u_circ", "u_bar", "r_hat", "ci_low", "ci_high")


@query("cross_seed", S.with_(S.UTILITY, S.PROMPT_GAP, "seeded as (select *, prompt_id // 6 % 3 as seed from prompt_gap)",
                             S.bootstrap("seeded", "model, seed")) + """
select model, round(avg(mean), 12) as mean, round(stddev_samp(mean), 12) as std, count(*) as n_seeds from boot_ci group by all""")
def cross_seed(spark, d):
    """Mean and spread over seeds of each seed's bootstrap mean."""
    seeded = gaps(spark, d).withColumn("seed", F.floor(F.col("prompt_id") / 6) % 3)
    means = R.bootstrap_ci(seeded, ["model", "seed"]).select("model", "seed", "mean")
    return rounded(M.cross_seed(means, ["model"], "mean"), "mean", "std")


@query("m_convergence", S.with_(S.UTILITY, S.PROMPT_GAP, f"""sized as (
  select g.*, cast(t.m as bigint) as m_sub, {S.hex32("0, t.m, prompt_id")} as o, count(*) over (partition by model, t.m) as m_full
  from prompt_gap g, (values (50), (100), (200), (500), (1000)) t(m)),
subset as (
  select model, m_sub, prompt_id, r_hat from (
    select *, row_number() over (partition by model, m_sub order by o, prompt_id) as rn from sized) where rn <= m_sub and m_sub < m_full
  union all select model, count(*) over (partition by model), prompt_id, r_hat from prompt_gap)""",
    S.bootstrap("subset", "model, m_sub")) + """
select model, m_sub, round((ci_high - ci_low) / 2, 14) as half_width,
       round((ci_high - ci_low) / 2 * sqrt(m_sub), 12) as scaled_half_width from boot_ci""")
def m_convergence(spark, d):
    out = R.m_convergence(gaps(spark, d), ["model"])
    return rounded(rounded(out, "half_width", digits=14), "scaled_half_width")


@query("spike_candidates", S.with_(S.UTILITY, S.PROMPT_GAP) + """
select model, dataset, count(*) filter (u_circ = 1 and u_bar <= 0.1) as n_candidates, count(*) as n_prompts
from prompt_gap group by all""")
def spike_candidates(spark, d):
    return M.spike_counts(gaps(spark, d), CELL)


@query("validate_rectangular", S.with_(S.AUDIT) + """
select prompt_id, n_rows, n_outside, n_distinct from (
  select prompt_id, count(*) as n_rows, count(*) filter (k < 0 or k >= 16) as n_outside, count(distinct k) as n_distinct
  from audit group by all) where n_rows <> 16 or n_outside > 0 or n_distinct <> 16""")
def validate_rectangular(spark, d):
    """The raw log has re-runs, so most of its prompts are reported."""
    return M.rectangular_violations(I.audit_log(spark, d), [], 16)
