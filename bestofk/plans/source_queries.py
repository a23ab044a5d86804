"""Registered source, sink, prompt-set and worklist queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bestofk.functions import registry as REG
from bestofk.functions import scorers
from bestofk.functions import text as T
from bestofk.functions.joins import join_cells
from bestofk.functions.hashing import config_fingerprint
from bestofk.operators import metrics as M
from bestofk.operators import prompts as P
from bestofk.operators import resample as R
from bestofk.plans import inputs as I
from bestofk.plans import sqlparts as S
from bestofk.plans.metric_queries import CELL, rounded
from bestofk.plans.registry import query
from bestofk.sources import logs, results as RS, samples as SS
from bestofk.session import materialise, shared_dir


def _sample_config(model):
    lit = F.lit
    return {
        "K": lit(64), "dataset": lit("gsm8k"), "max_reasoning_length": lit(None), "max_tokens": lit(1024), "model": model,
        "num_prompts": lit(100), "prompt_template_version": lit("v1"), "seed": lit(0), "temperature": lit(1.0),
        "top_k": lit(-1), "top_p": lit(1.0),
    }


def _wide_samples(spark, d):
    """Sample records with all K texts of a prompt in one array, under their configuration."""
    rows = I.samples(spark, d)
    wide = rows.groupBy("prompt_id", "ground_truth").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("t"))
    return wide.select(
        F.col("prompt_id").cast("string").alias("prompt_id"), F.lit("").alias("prompt"), "ground_truth",
        F.col("t.text").alias("samples"), config_fingerprint(_sample_config(I.model_name(F.col("prompt_id")))).alias("fingerprint"),
    )


SAMPLE_FP = """substr(sha256('{"K":64,"dataset":"gsm8k","max_tokens":1024,"model":"m' || cast(prompt_id % 3 as varchar)
  || '","num_prompts":100,"prompt_template_version":"v1","seed":0,"temperature":1.0,"top_k":-1,"top_p":1.0}'), 1, 16)"""


@query("read_samples", S.with_(S.FORMS, S.SAMPLES) + f"""
select {SAMPLE_FP} as fingerprint, cast(prompt_id as varchar) as prompt_id, k, text from samples
where 'm' || cast(prompt_id % 3 as varchar) in (select 'm' || cast(s_suppkey % 5 as varchar) from supplier)""")
def read_samples(spark, d):
    """Written once per configuration; the requested ones (stored or not) are read back by partition."""
    path = shared_dir(spark, "samples")
    SS.write_samples(_wide_samples(spark, d), path)
    model = F.concat(F.lit("m"), (F.col("s_suppkey") % 5).cast("string"))
    requested = I.table(spark, d, "supplier").select(config_fingerprint(_sample_config(model)).alias("fingerprint"))
    return SS.explode_samples(SS.read_samples(spark, path, requested)).select("fingerprint", "prompt_id", "k", "text")


@query("write_samples", S.with_(S.FORMS, S.SAMPLES) + f"""
select {SAMPLE_FP} as fingerprint, count(distinct prompt_id) as n_prompts, count(*) as n_samples from samples group by all""")
def write_samples(spark, d):
    path = shared_dir(spark, "samples")
    SS.write_samples(_wide_samples(spark, d), path)
    return SS.read_samples(spark, path).groupBy("fingerprint").agg(
        F.count("*").alias("n_prompts"), F.sum(F.size("samples").cast("bigint")).alias("n_samples")
    )


@query("config_fingerprint", f"select o_orderkey, {S.fingerprint('o_custkey')} as fingerprint from orders")
def config_fingerprint_query(spark, d):
    return I.configs(spark, d).select("o_orderkey", config_fingerprint().alias("fingerprint"))


@query("cache_partition", f"""
select c_custkey, {S.fingerprint('c_custkey')} as fingerprint, c_custkey in (select o_custkey from orders) as hit from customer""")
def cache_partition(spark, d):
    stored = I.configs(spark, d).select(config_fingerprint().alias("fingerprint"))
    requested = I.configs(spark, d, "customer").select("c_custkey", config_fingerprint().alias("fingerprint"))
    return SS.partition_requests(requested, stored).select("c_custkey", "fingerprint", "hit")


def result_documents(spark, d):
    """Result rows as JSON documents: some cut off, some without a seed or a telling file name."""
    rows = I.results(spark, d)
    value = F.to_json(F.struct(*[c for c in rows.columns if c not in ("file_name", "dataset_id", "seed")],
                               F.when(F.col("seed") != 0, F.col("seed")).alias("seed")))
    torn = F.col("file_name").endswith("_f4")
    return rows.select(
        F.when(F.col("hyp") == "h2", F.concat(F.lit("run-"), "file_name")).otherwise(F.col("file_name")).alias("file_name"),
        F.when(torn, F.substring(value, F.lit(1), F.length(value) - 5)).otherwise(value).alias("value"),
    )


@query("read_cell_results", S.with_(S.RESULTS) + """
select hyp, model, case when hyp = 'h2' then dataset else dataset_id end as dataset_id, dataset, seed, stage, procedure, tau,
       sc_n, length, reu, aeu, rvr, ci_low, ci_high from results where n <> 4 and seed = 0""")
def read_cell_results(spark, d):
    return RS.parse_cell_results(result_documents(spark, d), seed=0).select(
        "hyp", "model", "dataset_id", "dataset", "seed", "stage", "procedure", "tau", "sc_n", "length",
        "reu", "aeu", "rvr", "ci_low", "ci_high",
    )


@query("write_cell_results", S.with_(S.UTILITY, S.PROMPT_GAP, S.bootstrap("prompt_gap", "model, dataset"),
                                     """curve as (select model, dataset, k_prefix, round(avg(c), 12) as u_circ, round(avg(b), 12) as u_bar
from (select model, dataset, prompt_id, g.k as k_prefix, max(u) as c, avg(u) as b
      from utility u join (values (1), (2), (4), (8), (16), (32), (64)) g(k) on u.k < g.k group by all) group by all)""") + """
select 'h1' as hyp, c.model, c.dataset, c.k_prefix, c.u_circ, c.u_bar, round(b.ci_low, 12) as ci_low, round(b.ci_high, 12) as ci_high
from curve c join boot_ci b on b.model = c.model and b.dataset = c.dataset""")
def write_cell_results(spark, d):
    """Nested result rows out to the store and back, the curve unrolled again."""
    u = I.cell_utility(spark, d)
    per_prompt = M.prompt_gap(u, CELL)
    cells = RS.assemble_cells(
        M.cell_gap(per_prompt, CELL), M.saturation_curve(u, I.K_SAMPLES, CELL), R.bootstrap_ci(per_prompt, CELL), CELL
    )
    path = shared_dir(spark, "cells")
    RS.write_cell_results(cells.withColumns({"hyp": F.lit("h1"), "judge": F.lit(None).cast("string")}), path)
    back = spark.read.parquet(path)
    rows = back.select("hyp", *CELL, F.inline("curve"), "bootstrap.ci_low", "bootstrap.ci_high")
    return rounded(rows, "u_circ", "u_bar", "ci_low", "ci_high")


@query("read_verdict_log", S.with_(S.AUDIT, """last as (
  select * from audit where starts_with(experiment, 'h1_m1') and verdicts is not null
  qualify row_number() over (partition by prompt_id, k order by ingest_seq desc) = 1)""",
    "modal as (select length(verdicts) as l from last group by 1 order by count(*) desc, 1 limit 1)") + """
select prompt_id, k, verdicts, utility, ingest_seq, cast(length(verdicts) as integer) as n_votes
from last where length(verdicts) = (select l from modal)""")
def read_verdict_log(spark, d):
    return logs.read_verdict_log(I.audit_log(spark, d), "h1_m1", "prefix", "verdicts").select(
        "prompt_id", "k", "verdicts", "utility", "ingest_seq", "n_votes"
    )


@query("append_verdict_log", S.with_(S.AUDIT) + "select 'uf' as dataset, ingest_seq, experiment, prompt_id, k, verdicts, utility from audit")
def append_verdict_log(spark, d):
    """Two appends (records with and without verdicts) read back as one log."""
    log = I.audit_log(spark, d).withColumn("dataset", F.lit("uf")).drop("ts")
    path = shared_dir(spark, "verdicts")
    logs.append_verdict_log(log.where(F.col("verdicts").isNotNull()), path)
    logs.append_verdict_log(log.where(F.col("verdicts").isNull()), path)
    return spark.read.parquet(path)


@query("compute_budget", S.with_(S.COMPUTE) + """
select split_part(experiment, '_', 1) as hyp, sum(gpu_hours) as gpu_hours from (
  select experiment, seed, arg_min(gpu_hours, ingest_seq) as gpu_hours from compute group by all)
where split_part(experiment, '_', 1) in ('h1', 'h2', 'h3', 'h4') group by all""")
def compute_budget(spark, d):
    return logs.compute_budget(I.compute_log(spark, d))


@query("resume_ledger", """
select user_id as i, event_id % 8 as k, arg_max(event_type, event_id) as text
from events where event_type <> 'error' group by all""")
def resume_ledger(spark, d):
    line = F.to_json(F.struct(F.col("user_id").alias("i"), (F.col("event_id") % 8).alias("k"), F.col("event_type").alias("text")))
    torn = F.substring(line, F.lit(1), F.length(line) - 4)
    lines = I.table(spark, d, "events").select(
        F.col("event_id").alias("ingest_seq"), F.when(F.col("event_type") == "error", torn).otherwise(line).alias("value")
    )
    return logs.resume_ledger(lines)


@query("tidy_csv_sink", S.with_(S.RESULTS, S.CURVE) + "select hyp, file_name, k_prefix, round(u_circ, 6) as u_circ, round(1 - u_circ, 6) as a_k from curve")
def tidy_csv_sink(spark, d):
    rows = I.results(spark, d).select("hyp", "file_name", F.inline("curve")).select(
        "hyp", "file_name", "k_prefix", F.round("u_circ", 6).alias("u_circ"), F.round(1 - F.col("u_circ"), 6).alias("a_k")
    )
    path = shared_dir(spark, "tidy")
    RS.write_tidy_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


# --- prompt sets -----------------------------------------------------------

SUBSETS = sorted((f"src{i}" for i in range(20)), reverse=True)


@query("union_subsets", """
select dense_rank() over (order by subset desc) as subset_no, subset, ordinal, row_no, md5(question) as question_md5, ground_truth from (
  select source as subset, doc_id as ordinal, text as question, cast(n_chars as varchar) as ground_truth,
         cast(row_number() over (partition by source order by doc_id) as integer) as row_no from documents) where row_no <= 25""")
def union_subsets(spark, d):
    docs = I.table(spark, d, "documents")
    out = P.union_subsets(docs, SUBSETS, 25, "source", "text", "n_chars", "doc_id")
    return out.select("subset_no", "subset", "ordinal", "row_no", F.md5("question").alias("question_md5"), "ground_truth")


@query("date_cutoff", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as contest_date from orders where o_orderdate >= timestamp '1997-06-01'")
def date_cutoff(spark, d):
    return P.date_cutoff(I.table(spark, d, "orders"), "o_orderdate", "1997-06-01").select(
        "o_orderkey", F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("contest_date")
    )


@query("head_prompts", "select doc_id, lang, n_chars from documents order by doc_id limit 100")
def head_prompts(spark, d):
    return P.head_prompts(I.table(spark, d, "documents").select("doc_id", "lang", "n_chars"), 100, "doc_id")


@query("decode_bytes", "select page_id, md5(html) as text_md5, length(html) as n_chars from pages")
def decode_bytes(spark, d):
    raw = I.table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("raw"))
    decoded = raw.select("page_id", P.decode_bytes(F.col("raw")).alias("text"))
    return decoded.select("page_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


@query("render_prompt", """
select doc_id, md5(user_text) as user_md5, md5('Q: 1+1' || chr(10) || 'A: 2' || chr(10) || chr(10) || user_text) as few_shot_md5
from (select doc_id, 'Question (' || lang || '):' || chr(10) || text || chr(10) || 'Answer:' as user_text from documents)""")
def render_prompt(spark, d):
    user = T.render("Question ({lang}):\n{text}\nAnswer:", {"text": F.col("text"), "lang": F.col("lang")})
    return I.table(spark, d, "documents").select("doc_id", user.alias("u")).select(
        "doc_id", F.md5("u").alias("user_md5"), F.md5(P.few_shot("Q: 1+1\nA: 2\n \n", F.col("u"))).alias("few_shot_md5")
    )


@query("chat_messages", """
select conv_id, turn, 0 as pos, 'system' as role, md5(role) as content_md5 from conversations where role <> 'user'
union all select conv_id, turn, case when role <> 'user' then 1 else 0 end, 'user', md5(text) from conversations""")
def chat_messages(spark, d):
    system = F.when(F.col("role") == "user", "").otherwise(F.col("role"))
    turns = I.table(spark, d, "conversations").select("conv_id", "turn", P.chat_messages(system, F.col("text")).alias("m"))
    return turns.select("conv_id", "turn", F.posexplode("m").alias("pos", "msg")).select(
        "conv_id", "turn", "pos", "msg.role", F.md5("msg.content").alias("content_md5")
    )


@query("ground_truth_code", "select doc_id, md5(text || chr(10) || 'check(' || source || ')' || chr(10)) as program_md5 from documents")
def ground_truth_code(spark, d):
    program = P.ground_truth_code(F.col("text"), F.col("source"))
    return I.table(spark, d, "documents").select("doc_id", F.md5(program).alias("program_md5"))


@query("ground_truth_bundle", """
select o_orderkey, case when o_orderkey % 5 = 0 then 0 else 3 end as n_tests,
       case when o_orderkey % 5 = 0 then '' else o_custkey || '>' || o_orderstatus || ',' || o_custkey || '>x,' || o_orderkey || '>y' end as tests,
       'def f(self, x):' as starter_code from orders""")
def ground_truth_bundle(spark, d):
    test = lambda i, o: F.struct(i.cast("string").alias("input"), o.alias("output"), F.lit("stdin").alias("testtype"))
    public = F.to_json(F.array(test(F.col("o_custkey"), F.col("o_orderstatus")), test(F.col("o_custkey"), F.lit("x"))))
    private = F.to_json(F.array(test(F.col("o_orderkey"), F.lit("y"))))
    torn = F.when(F.col("o_orderkey") % 5 == 0, F.substring(private, F.lit(1), F.length(private) - 2)).otherwise(private)
    bundle = I.table(spark, d, "orders").select("o_orderkey", P.ground_truth_bundle(public, torn, F.lit("def f(self, x):")).alias("b"))
    return bundle.select(
        "o_orderkey", F.size("b.tests").alias("n_tests"),
        F.array_join(F.transform("b.tests", lambda t: F.concat(t["input"], F.lit(">"), t["output"])), ",").alias("tests"),
        "b.starter_code",
    )


@query("ground_truth_preference", """
select conv_id, md5(coalesce(arg_min(text, turn) filter (role = 'assistant'), '')) as ground_truth_md5 from conversations group by all""")
def ground_truth_preference(spark, d):
    first = P.preference_from_turns(I.table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return first.select("conv_id", F.md5("ground_truth").alias("ground_truth_md5"))


@query("prompt_ids", """
select doc_id, source || '_' || doc_id as prompt_id, source || '_L' || (n_chars % 7 * 64) || '_' || doc_id as budget_prompt_id from documents""")
def prompt_ids(spark, d):
    return I.table(spark, d, "documents").select(
        "doc_id", P.prompt_ids(F.col("source"), F.col("doc_id")).alias("prompt_id"),
        P.prompt_ids(F.col("source"), F.col("doc_id"), F.col("n_chars") % 7 * 64).alias("budget_prompt_id"),
    )


GRID_SETTINGS = (
    REG.settings("direct", REG.TEMPERATURES) + REG.settings("sc", REG.VOTE_SIZES, REG.VOTE_DATASETS) + REG.settings("budget", (0, 512))
)


@query("cell_grid", """
select s_name as model, d.dataset, d.m, d.max_tokens, z.seed, p.procedure, p.value::double as value,
       case when p.procedure = 'direct' and p.value = 0 then 1 else d.k end as k
from supplier, (values ('gsm8k', 64, 500, 1024), ('math', 64, 500, 1024), ('humaneval', 64, 164, 1024), ('matharena', 64, 60, 1024),
                       ('livecodebench', 64, 75, 1024), ('ultrafeedback', 32, 500, 512), ('alpaca_eval', 32, 300, 512)) d(dataset, k, m, max_tokens),
  (values (0), (1)) z(seed),
  (values ('direct', 0.0), ('direct', 0.7), ('direct', 1.0), ('sc', 2.0), ('sc', 4.0), ('sc', 8.0), ('sc', 16.0), ('sc', 32.0),
          ('budget', 0.0), ('budget', 512.0)) p(procedure, value)
where p.procedure <> 'sc' or d.dataset in ('gsm8k', 'math', 'matharena')""")
def cell_grid(spark, d):
    models = I.table(spark, d, "supplier").select(F.col("s_name").alias("model"))
    return P.cell_grid(models, REG.INFERENCE_PANEL, [0, 1], GRID_SETTINGS)


@query("sample_worklist", """
select c_custkey as ordinal, cast(r.range as integer) as k, 2 * 100003 + r.range as call_seed from customer, range(8) r
where not exists (select 1 from orders where o_custkey = c_custkey and o_orderkey % 8 = r.range)""")
def sample_worklist(spark, d):
    prompts = I.table(spark, d, "customer").select(F.col("c_custkey").alias("ordinal"))
    done = I.table(spark, d, "orders").select(F.col("o_custkey").alias("ordinal"), (F.col("o_orderkey") % 8).cast("int").alias("k"))
    return P.sample_worklist(prompts, 8, 2, done.distinct())


@query("budget_stage2_worklist", S.with_(S.FORMS, S.SAMPLES) + """
select prompt_id, k, md5(ground_truth || text || chr(10) || chr(10) || 'Final answer:') as prompt_md5, 1 as stage1_max_tokens,
       64 as stage2_max_tokens, 6 as stage2_seed from samples""")
def budget_stage2_worklist(spark, d):
    stage1 = I.samples(spark, d).select("prompt_id", "k", F.col("ground_truth").alias("prompt"), F.col("text").alias("stage1_text"))
    return P.budget_stage2_worklist(stage1, 0, 5).select(
        "prompt_id", "k", F.md5("stage2_prompt").alias("prompt_md5"), "stage1_max_tokens", "stage2_max_tokens", "stage2_seed"
    )


@query("budget_stitch", S.with_(S.FORMS, S.SAMPLES, S.BOXED) + """
select s.prompt_id, s.k, s.text || chr(10) || chr(10) || 'Final answer:' || b.text as text
from samples s join boxed b on b.prompt_id = s.prompt_id and b.k = s.k""")
def budget_stitch(spark, d):
    stage1 = I.samples(spark, d).withColumnRenamed("text", "stage1_text")
    return P.budget_stitch(stage1, I.boxed_samples(spark, d).withColumnRenamed("text", "stage2_text"))


@query("explode_samples", S.with_(S.FORMS, S.SAMPLES) + "select cast(prompt_id as varchar) as prompt_id, k, text from samples")
def explode_samples(spark, d):
    return SS.explode_samples(_wide_samples(spark, d)).select("prompt_id", "k", "text")


QUERY_SCOPES = {"development": ["d0", "d1"], "deployment": ["d2"]}


@query("scope_split", S.with_(S.RESULTS) + """
select model, dataset, file_name, hyp, case when dataset in ('d0', 'd1') then 'development' when dataset = 'd2' then 'deployment' end as scope
from results where dataset in ('d0', 'd1', 'd2')
union all select distinct null, dataset, null, null, 'unclassified' from results where dataset not in ('d0', 'd1', 'd2')""")
def scope_split(spark, d):
    """Classified cells, and below them one row per dataset without a scope."""
    known, unknown = P.scope_split(I.results(spark, d).select("model", "dataset", "file_name", "hyp"), QUERY_SCOPES)
    return known.unionByName(unknown.withColumn("scope", F.lit("unclassified")), allowMissingColumns=True)


@query("reverify", S.with_(S.FORMS, "keyed as (select prompt_id, k, coalesce(f < 5 and q = g, false)::double as u from forms)",
                           "prompt_gap as (select 'm' || cast(prompt_id % 3 as varchar) as model, prompt_id, max(u) as u_circ, avg(u) as u_bar, max(u) - avg(u) as r_hat from keyed group by all)",
                           S.bootstrap("prompt_gap", "model"), S.RESULTS,
                           "old as (select model, sum(sampling_seconds) as sampling_seconds from results where hyp = 'h1' group by all)") + """
select g.model, g.u_circ, g.u_bar, g.r_hat, g.m, round(b.ci_low, 12) as ci_low, round(b.ci_high, 12) as ci_high, o.sampling_seconds
from (select model, round(avg(u_circ), 12) as u_circ, round(avg(u_bar), 12) as u_bar, round(avg(r_hat), 12) as r_hat, count(*) as m
      from prompt_gap group by all) g join boot_ci b on b.model = g.model left join old o on o.model = g.model""")
def reverify(spark, d):
    """Stored samples scored again; the cell's other facts come from its old result row."""
    path = shared_dir(spark, "samples")
    SS.write_samples(_wide_samples(spark, d).withColumn("model", I.model_name(F.col("prompt_id").cast("bigint"))), path)
    stored = SS.explode_samples(SS.read_samples(spark, path))
    scored = stored.select(
        "model", "prompt_id", "k", scorers.score_dispatch(F.lit("gsm8k"), F.col("text"), F.col("ground_truth")).alias("u")
    )
    per_prompt = materialise(M.prompt_gap(scored, ["model"]), "reverified")
    old = I.results(spark, d).where(F.col("hyp") == "h1").groupBy("model").agg(F.sum("sampling_seconds").alias("sampling_seconds"))
    ci = R.bootstrap_ci(per_prompt, ["model"]).select("model", "ci_low", "ci_high")
    fresh = join_cells(M.cell_gap(per_prompt, ["model"]).drop("k_max"), ci, ["model"])
    return rounded(join_cells(fresh, old, ["model"], "left"), "u_circ", "u_bar", "r_hat", "ci_low", "ci_high")
