"""Registered report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bestofk.operators import metrics as M
from bestofk.plans import inputs as I
from bestofk.plans import reports as R
from bestofk.plans import sqlparts as S
from bestofk.plans.metric_queries import KEYED_SQL, numeric_keyed, rounded
from bestofk.plans.registry import query
from bestofk.session import materialise
from bestofk.sources import logs

SEED = 0
MODELS = ["m0", "m1", "m9", "m3"]
MODEL_ALIASES = {"m9": ["m8", "m4"]}
DATASET_ALIASES = {("m1", "d7"): "d2", ("m9", "d7"): "d1_judge-x"}
BANDS = [("Conversation", "d0_judge-x"), ("Conversation", "d1_judge-x"), ("Math", "d0"), ("Math", "d1"), ("Coding", "d2"), ("Coding", "d7")]
LEVELS = {"d0": "Easy", "d1": "Medium", "d2": "Hard"}


def of(spark, d, *hyps):
    """Result rows of some hypotheses and the reported seed, with the interval half-width."""
    return R.metric_cell(I.results(spark, d).where(F.col("hyp").isin(*hyps) & (F.col("seed") == SEED)))


def looked_up(spark, d, *hyps):
    order = ("hyp", "file_name")
    index = R.index_cells(of(spark, d, *hyps), ["model", "dataset_id"], order).select("model", "dataset_id", "reu", "aeu", "rvr", "ci_half")
    slots = R.slot_grid(spark, model=MODELS, band__dataset_id=BANDS)
    return R.lookup_cell(slots, index, MODEL_ALIASES, DATASET_ALIASES)


OF = "coalesce((ci_high - ci_low) / 2, 0.0) as ci_half"


def sql_of(hyps: str) -> str:
    return f"cells as (select *, {OF} from results where hyp in ({hyps}) and seed = 0)"


def sql_index(keys: str) -> str:
    return f"""idx as (select {keys}, max_by(reu, (hyp, file_name)) as reu, max_by(aeu, (hyp, file_name)) as aeu, max_by(rvr, (hyp, file_name)) as rvr,
  max_by(ci_half, (hyp, file_name)) as ci_half from cells where {' and '.join(k.strip() + ' is not null' for k in keys.split(','))} group by all)"""


SLOTS = """slots as (select m.m as model, b.band, b.d as dataset_id
  from (values ('m0'), ('m1'), ('m9'), ('m3')) m(m),
       (values ('Conversation', 'd0_judge-x'), ('Conversation', 'd1_judge-x'), ('Math', 'd0'), ('Math', 'd1'), ('Coding', 'd2'), ('Coding', 'd7')) b(band, d))"""
FOUND = """found as (select s.model, s.band, s.dataset_id, i.reu, i.aeu, i.rvr, i.ci_half from (
    select s.*, case when i.model is not null then s.model else case s.model when 'm9' then 'm4' else s.model end end as m,
           case when s.dataset_id = 'd7' and s.model = 'm1' then 'd2' when s.dataset_id = 'd7' and s.model = 'm9' then 'd1_judge-x' else s.dataset_id end as d
    from slots s left join idx i on i.model = s.model and i.dataset_id = s.dataset_id) s
  left join idx i on i.model = s.m and i.dataset_id = s.d)"""


def sql_found(hyps: str = "'h1'") -> str:
    return S.with_(S.RESULTS, sql_of(hyps), sql_index("model, dataset_id"), SLOTS, FOUND)


def sql_pivot(column: str, values, metrics, quote="'") -> str:
    return ", ".join(
        f"max(case when {column} = {quote}{v}{quote} then {m} end) as \"{v}_{m}\"" for v in values for m in metrics
    )


ALL_VALUES = ("reu", "aeu", "rvr", "ci_half")


@query("index_cells", S.with_(S.RESULTS, "cells as (select *, 0.0 as ci_half from results)") + """
select hyp, model, dataset_id, max_by(reu, file_name) as reu, max_by(rvr, file_name) as rvr, max(file_name) as file_name
from cells group by all""")
def index_cells(spark, d):
    return R.index_cells(I.results(spark, d), ["hyp", "model", "dataset_id"]).select("hyp", "model", "dataset_id", "reu", "rvr", "file_name")


@query("lookup_cell", sql_found() + "select * from found")
def lookup_cell(spark, d):
    return looked_up(spark, d, "h1")


@query("metric_cell", S.with_(S.RESULTS) + f"select hyp, file_name, reu, aeu, rvr, {OF} from results")
def metric_cell(spark, d):
    return R.metric_cell(I.results(spark, d)).select("hyp", "file_name", "reu", "aeu", "rvr", "ci_half")


@query("mark_extreme", S.with_(S.RESULTS) + """
select hyp, dataset_id, file_name, rvr, abs(rvr - min(rvr) over (partition by hyp, dataset_id)) < 1e-9 as is_min,
       abs(rvr - max(rvr) over (partition by hyp, dataset_id)) < 1e-9 as is_max from results""")
def mark_extreme(spark, d):
    rows = I.results(spark, d).select("hyp", "dataset_id", "file_name", "rvr")
    return R.mark_extreme(rows, ["hyp", "dataset_id"], "rvr", is_min="min", is_max="max")


@query("pivot_models", sql_found() + "select band, dataset_id, " + sql_pivot("model", MODELS, (*ALL_VALUES, "best")) + """
from (select *, coalesce(abs(rvr - min(rvr) over (partition by band, dataset_id)) < 1e-9, false) as best from found) group by all""")
def pivot_models(spark, d):
    marked = R.mark_extreme(looked_up(spark, d, "h1"), ["band", "dataset_id"], "rvr", best="min")
    return R.pivot_models(marked, ["band", "dataset_id"], MODELS, [*ALL_VALUES, "best"])


@query("pivot_stages", S.with_(S.RESULTS, sql_of("'h2'"), sql_index("stage, dataset_id"),
       "tall as (unpivot (select stage, dataset_id, reu, aeu, rvr from idx) on reu, aeu, rvr into name metric value value)") + """
select dataset_id, metric, max(case when stage = 'sft' then value end) as sft, max(case when stage = 'dpo' then value end) as dpo,
       max(case when stage = 'rlvr' then value end) as rlvr from tall group by all""")
def pivot_stages(spark, d):
    index = R.index_cells(of(spark, d, "h2"), ["stage", "dataset_id"])
    return R.pivot_metrics(index, ["dataset_id"], "stage", I.STAGES)


@query("pivot_temperature", S.with_(S.RESULTS, sql_of("'h3'"), "rounded as (select * replace (round(tau, 3) as tau) from cells)",
       sql_index("model, dataset, tau").replace("from cells", "from rounded"),
       """marked as (select *, coalesce(rvr > 0 and row_number() over (partition by dataset, model order by case when rvr > 0 then rvr end nulls last, tau) = 1, false)::integer::double as best from idx)""",
       "tall as (unpivot (select model, dataset, tau, reu, aeu, rvr, best from marked) on reu, aeu, rvr, best into name metric value value)") + """
select dataset, model, metric, max(case when tau = 0 then value end) as "0.0", max(case when tau = 0.7 then value end) as "0.7",
       max(case when tau = 1 then value end) as "1.0" from tall group by all""")
def pivot_temperature(spark, d):
    direct = of(spark, d, "h3").withColumn("tau", F.round("tau", 3))
    index = R.index_cells(direct, ["model", "dataset", "tau"])
    marked = R.mark_smallest_positive(index, ["dataset", "model"], "rvr", "tau").withColumn("best", F.col("best").cast("double"))
    return R.pivot_metrics(marked, ["dataset", "model"], "tau", I.TAUS, (*R.METRICS, "best"))


LENGTH_MODELS = ["m0", "m1", "m2"]


@query("pivot_length", S.with_(S.RESULTS, sql_of("'h4'"), sql_index("model, dataset, length"),
       "marked as (select *, abs(rvr - max(rvr) over (partition by dataset, model)) < 1e-9 as peak from idx)") + f"""
select dataset, length, {sql_pivot("model", LENGTH_MODELS, ("reu", "aeu", "rvr", "peak"))} from marked
where model in ('m0', 'm1', 'm2') group by all""")
def pivot_length(spark, d):
    index = R.index_cells(of(spark, d, "h4").where(F.col("model").isin(LENGTH_MODELS)), ["model", "dataset", "length"])
    marked = R.mark_extreme(index, ["dataset", "model"], "rvr", peak="max")
    return R.pivot_models(marked, ["dataset", "length"], LENGTH_MODELS, ["reu", "aeu", "rvr", "peak"])


API_MODELS, API_DATASETS = ["m2", "m7"], ["d0", "d2", "d9"]


@query("api_table", S.with_(S.RESULTS, sql_of("'h1'"), sql_index("model, dataset")) + """
select s.dataset, s.model, i.reu, i.aeu, i.rvr, i.ci_half,
       coalesce(abs(i.rvr - min(i.rvr) over (partition by s.dataset)) < 1e-9, false) as best
from (select d.d as dataset, m.m as model from (values ('d0'), ('d2'), ('d9')) d(d), (values ('m2'), ('m7')) m(m)) s
left join idx i on i.model = s.model and i.dataset = s.dataset""")
def api_table(spark, d):
    """Keyed by the bare dataset: of a plain and a judge-tagged file the later name counts."""
    index = R.index_cells(of(spark, d, "h1"), ["model", "dataset"]).select("model", "dataset", *ALL_VALUES)
    slots = R.slot_grid(spark, dataset=API_DATASETS, model=API_MODELS)
    return R.mark_extreme(slots.join(index, ["model", "dataset"], "left"), ["dataset"], "rvr", best="min")


@query("ak_rvr", sql_found() + """
select band, dataset_id, case split_part(dataset_id, '_judge-', 1) when 'd0' then 'Easy' when 'd1' then 'Medium' when 'd2' then 'Hard' else '' end as challenge, """
       + sql_pivot("model", MODELS, ("a_k", "rvr")) + " from (select *, 1.0 - reu as a_k from found) group by all")
def ak_rvr(spark, d):
    cells = R.with_challenge(looked_up(spark, d, "h1").withColumn("a_k", F.lit(1.0) - F.col("reu")), LEVELS)
    return R.pivot_models(cells, ["band", "dataset_id", "challenge"], MODELS, ["a_k", "rvr"])


@query("pct_rvr", sql_found("'h1', 'h2'") + """
select band, dataset_id, model, 1.0 - reu as a_k, rvr, case when (1.0 - reu) + rvr > 0 then rvr / ((1.0 - reu) + rvr) when reu is not null then 0.0 end as pct_rvr
from found""")
def pct_rvr(spark, d):
    return R.with_pct_rvr(looked_up(spark, d, "h1", "h2")).select("band", "dataset_id", "model", "a_k", "rvr", "pct_rvr")


@query("heat_intensity", S.with_(S.RESULTS) + """
select hyp, file_name, cast(round_even(least(greatest(reu, 0), 1) * 60, 0) as integer) as reu_shade,
       cast(round_even(least(greatest(rvr - 0.5, 0), 1) * 60, 0) as integer) as rvr_shade from results""")
def heat_intensity(spark, d):
    return I.results(spark, d).select(
        "hyp", "file_name", R.heat_intensity(F.col("reu")).alias("reu_shade"), R.heat_intensity(F.col("rvr") - 0.5).alias("rvr_shade")
    )


@query("saturation_series", S.with_(S.RESULTS, S.CURVE) + """
select hyp, model, file_name, case when dataset in ('d0', 'd1') then 'development' when dataset = 'd2' then 'deployment' end as scope,
       k_prefix, u_circ, u_bar, u_circ - u_bar as r_hat, 8 as k_max, case when k_prefix = 8 then ci_low end as ci_low,
       case when k_prefix = 8 then ci_high end as ci_high from curve where dataset in ('d0', 'd1', 'd2')""")
def saturation_series(spark, d):
    from bestofk.operators.prompts import scope_split
    from bestofk.plans.source_queries import QUERY_SCOPES

    known, _ = scope_split(I.results(spark, d), QUERY_SCOPES)
    return R.saturation_series(known, ["hyp", "model", "file_name", "scope"])


@query("saturation_pivot", S.with_(S.RESULTS, S.CURVE, """last as (
  select c.* from curve c join (select model, dataset_id, max(file_name) as f from results where hyp = 'h1' and seed = 0 group by all) l
    on c.hyp = 'h1' and c.file_name = l.f)""", """tall as (
  select model, dataset_id, 'u_circ' as metric, null as ci_half, k_prefix, u_circ as value from last
  union all select model, dataset_id, 'u_bar', null, k_prefix, u_bar from last
  union all select model, dataset_id, 'r_hat', (ci_high - ci_low) / 2, k_prefix, u_circ - u_bar from last)""") + """
select model, dataset_id, metric, ci_half, max(case when k_prefix = 1 then value end) as "1", max(case when k_prefix = 2 then value end) as "2",
       max(case when k_prefix = 4 then value end) as "4", max(case when k_prefix = 8 then value end) as "8" from tall group by all""")
def saturation_pivot(spark, d):
    index = R.index_cells(of(spark, d, "h1"), ["model", "dataset_id"])
    return R.saturation_pivot(index, ["model", "dataset_id"], I.CURVE_GRID)


@query("sc_series", S.with_(S.RESULTS, sql_of("'h3'"), sql_index("model, dataset, sc_n")) + "select model, dataset, sc_n, reu, aeu, rvr, ci_half from idx")
def sc_series(spark, d):
    runs = of(spark, d, "h3").where(F.col("procedure") == "sc")
    return R.index_cells(runs, ["model", "dataset", "sc_n"]).select("model", "dataset", "sc_n", *ALL_VALUES).orderBy("model", "dataset", "sc_n")


@query("gpu_hours", S.with_(S.RESULTS, S.COMPUTE, """budget as (
  select split_part(experiment, '_', 1) as hyp, sum(gpu_hours) as logged from (
    select experiment, seed, arg_min(gpu_hours, ingest_seq) as gpu_hours from compute group by all) group by all)""", """tally as (
  select h.h as hyp, count(r.hyp) as n, count(r.sampling_seconds) as t, coalesce(sum(r.sampling_seconds), 0) / 3600.0 as own
  from (values ('h1'), ('h2'), ('h3'), ('h4')) h(h) left join results r on r.hyp = h.h and r.seed = 0 group by all)""", """hours as (
  select t.hyp, n as n_cells, t as n_timed,
         case when t = n and n > 0 then own when t = 0 then logged else greatest(own, coalesce(logged, 0.0)) end as hours,
         case when t = n and n > 0 then 'per-cell' when t = 0 and logged is not null then 'compute_budget' when t = 0 then 'no record'
              else 'per-cell + budget' end as source
  from tally t left join budget b on b.hyp = t.hyp)""") + """
select hyp, n_cells, n_timed, round(hours, 6) as hours, source from hours
union all select 'total', cast(sum(n_cells) as bigint), cast(sum(n_timed) as bigint), round(sum(hours), 6), null from hours""")
def gpu_hours(spark, d):
    out = R.gpu_hours(of(spark, d, *R.HYPOTHESES), logs.compute_budget(I.compute_log(spark, d)))
    return rounded(out, "hours", digits=6)


@query("epsilon_budget", S.with_(S.RESULTS, S.CURVE) + """
select hyp, file_name, 8 as k_max, round(abs(g8 - coalesce(g4, g8)), 12) as truncation, round(hw, 12) as half_width,
       round(greatest(abs(g8 - coalesce(g4, g8)), hw), 12) as epsilon
from (select hyp, file_name, max(case when k_prefix = 8 then u_circ - u_bar end) as g8, max(case when k_prefix = 4 then u_circ - u_bar end) as g4,
             max((ci_high - ci_low) / 2) as hw from curve group by all)""")
def epsilon_budget(spark, d):
    return rounded(R.epsilon_budget(I.results(spark, d), ["hyp", "file_name"]), "truncation", "half_width", "epsilon")


@query("difficulty_bucket", """
select d.doc_id, case when n_chars <= q.q1 then 'short' when n_chars <= q.q2 then 'medium' else 'long' end as bucket, cast(l.quality as integer) as level
from documents d left join labels l on l.doc_id = d.doc_id,
     (select quantile_cont(n_chars, 1 / 3.0::double) as q1, quantile_cont(n_chars, 2 / 3.0::double) as q2 from documents) q""")
def difficulty_bucket(spark, d):
    docs = R.length_terciles(I.table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars")
    labels = I.table(spark, d, "labels").select("doc_id", F.concat(F.lit("Level "), F.col("quality")).alias("label"))
    return docs.join(labels, "doc_id", "left").select("doc_id", "bucket", R.level_digit(F.col("label")).alias("level"))


def part_cells(spark, d):
    """Two models over all prompts (first and second half of the samples), and one with the right answers only,
    which therefore lacks the prompts that have none."""
    keyed = numeric_keyed(spark, d).select("prompt_id", "k", "u")
    half = F.when(F.col("k") < 32, "m0").otherwise("m1")
    fewer = F.when(F.col("u") == 1.0, "m2")
    return keyed.select(F.explode(F.array_compact(F.array(half, fewer))).alias("model"), "prompt_id", "k", "u")


def part_levels(spark, d):
    firsts = I.table(spark, d, "orders").where(F.col("o_orderkey") % I.K_TEXTS == 0)
    return firsts.select(F.floor(F.col("o_orderkey") / I.K_TEXTS).alias("prompt_id"), R.level_digit(F.col("o_custkey")).cast("string").alias("bucket"))


PART_CELLS = """cells as (
  select case when k < 32 then 'm0' else 'm1' end as model, prompt_id, k, u from keyed
  union all select 'm2', prompt_id, k, u from keyed where u = 1)"""
LEVELS_SQL = "levels as (select o_orderkey // 64 as prompt_id, left(cast(o_custkey as varchar), 1) as bucket from orders where o_orderkey % 64 = 0)"


@query("gap_by_bucket", S.with_(S.FORMS, KEYED_SQL, PART_CELLS, LEVELS_SQL,
       "per_prompt as (select model, prompt_id, max(u) - avg(u) as r from cells group by all)",
       """planned as (select 'm0' as model, prompt_id from forms group by all union all select 'm1', prompt_id from forms where k >= 32 group by all
                     union all select 'm2', prompt_id from forms group by all)""",
       """misfits as (select model from ((select model, prompt_id from per_prompt except select * from planned)
                      union all (select * from planned except select model, prompt_id from per_prompt)))""") + """
select l.bucket, count(distinct l.prompt_id) as n, round(avg(case when p.model = 'm0' then r end), 12) as m0,
       round(avg(case when p.model = 'm1' then r end), 12) as m1, round(avg(case when p.model = 'm2' then r end), 12) as m2
from levels l left join (select * from per_prompt where model not in (select model from misfits)) p on p.prompt_id = l.prompt_id group by all""")
def gap_by_bucket(spark, d):
    """The last prompt may have no sample from 32 on, so that it is not planned for m1; m2 truly lacks prompts and gets nulls."""
    per_prompt = materialise(M.prompt_gap(part_cells(spark, d), ["model"]), "gaps")
    drawn = I.sample_forms(spark, d).groupBy("prompt_id").agg(F.max("k").alias("last"))
    all_of_it = F.array_compact(F.array(F.lit("m0"), F.when(F.col("last") >= 32, "m1"), F.lit("m2")))
    planned = drawn.select("prompt_id", F.explode(all_of_it).alias("model"))
    return rounded(R.gap_by_bucket(per_prompt, part_levels(spark, d), ["m0", "m1", "m2"], planned=planned), "m0", "m1", "m2")


@query("spike_by_bucket", S.with_(S.FORMS, KEYED_SQL, PART_CELLS, LEVELS_SQL,
       "per_prompt as (select c.model, c.prompt_id, l.bucket, avg(u) as p from cells c left join levels l on l.prompt_id = c.prompt_id group by all)",
       """fits as (select model from per_prompt group by model having count(*) = (select count(*) from levels) and count(*) = count(bucket))""") + """
select model, '__all__' as bucket, count(*) as n, round(avg((p = 0)::double), 12) as zero_share from per_prompt group by model
union all select model, bucket, count(*), round(avg((p = 0)::double), 12) from per_prompt where model in (select model from fits) group by model, bucket""")
def spike_by_bucket(spark, d):
    success = materialise(M.p_hat(part_cells(spark, d), I.K_TEXTS, I.K_TEXTS, ["model"]), "success")
    return rounded(R.spike_by_bucket(success, part_levels(spark, d), ["model"]), "zero_share")


@query("compute_approx_report", S.with_(S.RESULTS, S.CURVE) + """
select h.h as hypothesis, concat_ws(' | ', model, dataset, 'trajectory_stage=' || stage, 'tau=' || tau, 'sc_n=' || sc_n, 'L=' || length) as cell,
       file_name as stem, k_prefix, round(u_circ, 6) as u_circ, round(1 - u_circ, 6) as a_k, '__all__' as bucket, k_prefix = 8 as is_floor
from curve c join (values ('h1', 'h1'), ('h2', 'h2'), ('h3', 'h3'), ('h4', 'h4'), ('h5', 'h1')) h(h, s) on h.s = c.hyp where seed = 0""")
def compute_approx_report(spark, d):
    return R.compute_approx_report(of(spark, d, *R.HYPOTHESES), ["h1", "h2", "h3", "h4", "h5"])
