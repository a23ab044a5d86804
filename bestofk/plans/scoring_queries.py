"""Registered answer-extraction, scoring and judging queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from bestofk.functions import scorers
from bestofk.functions import text as T
from bestofk.operators import judge as J
from bestofk.operators import scoring
from bestofk.plans import experiments as E
from bestofk.plans import inputs as I
from bestofk.plans import sqlparts as S
from bestofk.plans.metric_queries import CELL, rounded
from bestofk.plans.registry import query

# The extraction rules again, in the oracle's regular-expression dialect.
SQL_NUMBER = r"-?\$?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\$?\d+(?:\.\d+)?%?"


def sql_value(token: str) -> str:
    return rf"try_cast(regexp_replace(replace(trim({token}), ',', ''), '^\$+|%+$', '', 'g') as double)"


def sql_number(column: str) -> str:
    """CTE body: value and rule name of the number in ``column`` of relation ``src``."""
    return rf"""
  select *, coalesce(h, b, a, n) as value,
         case when h is not null then 'hashed' when b is not null then 'boxed' when a is not null then 'answer_is'
              when n is not null then 'bare' else 'none' end as pattern
  from (select *,
    {sql_value(rf"regexp_extract_all({column}, '####\s*({SQL_NUMBER})', 1)[-1]")} as h,
    {sql_value(rf"regexp_extract_all({column}, '\\boxed\s*\{{\s*({SQL_NUMBER})\s*\}}', 1)[-1]")} as b,
    {sql_value(rf"regexp_extract_all({column}, '(?i)(?:the\s+)?answer\s+is[\s:=]*({SQL_NUMBER})', 1)[-1]")} as a,
    list_filter(list_transform(regexp_extract_all({column}, '{SQL_NUMBER}'),
                lambda t: {sql_value("t")}), lambda v: v is not null)[-1] as n
    from src)"""


def sql_close(a: str, b: str) -> str:
    return f"coalesce(abs({a} - {b}) <= greatest(1e-9 * greatest(abs({a}), abs({b})), 1e-9), false)"


@query("num_extract", "with src as (select page_id, html from pages)\n"
       + "select page_id, value, pattern from (" + sql_number("html") + ")")
def num_extract(spark, d):
    """Numbers in whole web pages."""
    return T.with_number(I.table(spark, d, "pages").select("page_id", "html"), "html", "value", "pattern").drop("html")


TOKENS_SQL = r"""tokens as (
  select o_orderkey, case o_orderkey % 5
           when 0 then ' $' || cast(floor(o_totalprice) as bigint) when 1 then '-$' || cast(floor(o_totalprice) as bigint)
           when 2 then cast(floor(o_totalprice / 1000) as bigint) || ',' || lpad(cast(cast(floor(o_totalprice) as bigint) % 1000 as varchar), 3, '0') || '.25'
           when 3 then o_custkey || '% ' else '-' || o_custkey || '.5' end as token from orders)"""


@query("num_normalise", S.with_(TOKENS_SQL) + f"select o_orderkey, {sql_value('token')} as value from tokens")
def num_normalise(spark, d):
    key, price = F.col("o_orderkey") % 5, F.floor("o_totalprice")
    text_of = lambda c: c.cast("string")
    token = (
        F.when(key == 0, F.concat(F.lit(" $"), text_of(price)))
        .when(key == 1, F.concat(F.lit("-$"), text_of(price)))
        .when(key == 2, F.concat(text_of(F.floor(F.col("o_totalprice") / 1000)), F.lit(","),
                                 F.lpad(text_of(price % 1000), 3, "0"), F.lit(".25")))
        .when(key == 3, F.concat(text_of(F.col("o_custkey")), F.lit("% ")))
        .otherwise(F.concat(F.lit("-"), text_of(F.col("o_custkey")), F.lit(".5")))
    )
    return I.table(spark, d, "orders").select("o_orderkey", T.number_value(token).alias("value"))


@query("is_close", "with src as (select l_orderkey, l_extendedprice as a, l_extendedprice + case when l_linenumber % 3 = 0 then 1e-12 "
       "when l_linenumber % 3 = 1 then l_extendedprice * 5e-10 else 1e-3 end as b from lineitem) "
       f"select l_orderkey, count(*) filter ({sql_close('a', 'b')}) as n_close, count(*) as n from src group by all")
def is_close(spark, d):
    a, third = F.col("l_extendedprice"), F.col("l_linenumber") % 3
    b = a + F.when(third == 0, 1e-12).when(third == 1, a * 5e-10).otherwise(1e-3)
    lines = I.table(spark, d, "lineitem")
    return lines.groupBy("l_orderkey").agg(F.count_if(T.is_close(a, b)).alias("n_close"), F.count("*").alias("n"))


# What the rules must find in each form; the rules themselves run against the oracle in ``num_extract``.
SCORED_NUMBERS = S.with_(S.LINE_FORMS, """scored as (
  select *, case when not (f < 5) then 'none' when hit then pattern else 'incorrect' end as reason
  from (select prompt_id, k, f, f < 5 and q = g as hit,
               case f when 0 then 'hashed' when 1 then 'boxed' when 2 then 'answer_is' when 5 then 'none' else 'bare' end as pattern from forms))""")


@query("score_numeric", SCORED_NUMBERS + "select prompt_id, k, hit::double as utility, reason from scored")
def score_numeric(spark, d):
    return scoring.score_numeric(I.line_samples(spark, d)).select("prompt_id", "k", "utility", "reason")


@query("pattern_rates", SCORED_NUMBERS + """
select 'm' || cast(prompt_id % 3 as varchar) as model, pattern,
       round(100.0::double * count(*) / sum(count(*)) over (partition by prompt_id % 3), 12) as fires_pct,
       case when pattern <> 'none' then round(100.0::double * count(*) filter (hit) / count(*), 12) end as accuracy_pct,
       cast(sum(count(*)) over (partition by prompt_id % 3) as bigint) as total
from scored group by prompt_id % 3, pattern""")
def pattern_rates(spark, d):
    scored = scoring.score_numeric(I.line_samples(spark, d)).withColumn("model", I.model_name(F.col("prompt_id")))
    return rounded(scoring.pattern_rates(scored, ["model"]), "fires_pct", "accuracy_pct")


BOX_BODY = r"(?:[^{}\\]|\\.|\{(?:[^{}\\]|\\.|\{(?:[^{}\\]|\\.)*\})*\})*"


def sql_box(column: str) -> str:
    return rf"regexp_extract_all({column}, '\\boxed\s*\{{({BOX_BODY})\}}', 1)[-1]"


def sql_ratio(column: str) -> str:
    return rf"""case when regexp_full_match({column}, '[+-]?(\d+\.?\d*|\.\d+)') then try_cast({column} as double)
     when regexp_full_match({column}, '\\frac\{{-?\d+\}}\{{-?\d+\}}')
     then regexp_extract({column}, '\{{(-?\d+)\}}\{{(-?\d+)\}}', 1)::double / regexp_extract({column}, '\{{(-?\d+)\}}\{{(-?\d+)\}}', 2)::double end"""


BOXED_SCORED = S.with_(S.LINE_FORMS, S.BOXED, f"found as (select *, {sql_box('text')} as answer from boxed)",
                       r"squashed as (select *, regexp_replace(answer, '\s', '', 'g') as l, regexp_replace(ground_truth, '\s', '', 'g') as r from found)",
                       f"""scored as (select prompt_id, k, answer, case when answer is null then 'no_boxed' when ground_truth = '' then 'empty_gt'
  when l = r or {sql_close(sql_ratio('l'), sql_ratio('r'))} then 'correct' else 'incorrect' end as reason from squashed)""")


@query("last_boxed", BOXED_SCORED + "select prompt_id, k, answer from scored")
def last_boxed(spark, d):
    return I.line_boxed_samples(spark, d).select("prompt_id", "k", T.last_boxed(F.col("text")).alias("answer"))


@query("score_boxed", BOXED_SCORED + "select prompt_id, k, (reason = 'correct')::double as utility, reason from scored")
def score_boxed(spark, d):
    return scoring.score_boxed(I.line_boxed_samples(spark, d)).select("prompt_id", "k", "utility", "reason")


@query("failure_mode_rates", BOXED_SCORED + """
select 'm' || cast(prompt_id % 3 as varchar) as model,
       round(100.0::double * count(*) filter (reason = 'no_boxed') / count(*), 12) as no_boxed,
       round(100.0::double * count(*) filter (reason = 'empty_gt') / count(*), 12) as empty_gt,
       round(100.0::double * count(*) filter (reason = 'incorrect') / count(*), 12) as incorrect,
       round(100.0::double * count(*) filter (reason = 'correct') / count(*), 12) as correct,
       count(*) as total from scored group by all""")
def failure_mode_rates(spark, d):
    scored = scoring.score_boxed(I.line_boxed_samples(spark, d)).withColumn("model", I.model_name(F.col("prompt_id")))
    return rounded(scoring.failure_mode_rates(scored, ["model"]), *scoring.BOXED_REASONS)


SQL_BREAK = "chr(13) || chr(10) || '|[' || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(133) || chr(8232) || chr(8233) || ']'"
SQL_TRIGGER = r"(?is)(?:final\s+answer|the\s+answer\s+is|answer)\s*[:\-]?\s*"


def sql_span(column: str) -> str:
    pieces = f"regexp_split_to_array({column}, '{SQL_TRIGGER}')"
    lines = rf"list_filter(regexp_split_to_array({column}, {SQL_BREAK}), lambda x: regexp_matches(x, '\S'))"
    return f"substr(case when len({pieces}) > 1 then {pieces}[-1] else coalesce({lines}[-1], {column}) end, 1, 160)"


EDGES = "().,:;!?\"''*` "


def sql_token(column: str) -> str:
    return f"lower(trim(regexp_replace({column}, '^\\s+|\\s+$', '', 'g'), '{EDGES}'))"


@query("final_span", f"select doc_id, {sql_span('text')} as span from documents")
def final_span(spark, d):
    return I.table(spark, d, "documents").select("doc_id", T.final_span(F.col("text")).alias("span"))


@query("token_norm", f"select conv_id, turn, {sql_token('text')} as token from conversations")
def token_norm(spark, d):
    return I.table(spark, d, "conversations").select("conv_id", "turn", T.token_norm(F.col("text")).alias("token"))


def sql_letter(span: str, full: str) -> str:
    return rf"""coalesce(nullif(lower(regexp_extract({span}, '\(\s*([A-Ra-r])\s*\)', 1)), ''),
  nullif(lower(regexp_extract({full}, '\(\s*([A-Ra-r])\s*\)', 1)), ''),
  nullif(lower(regexp_extract({span}, '(?:^|[^A-Za-z])([A-Ra-r])(?:[^A-Za-z]|$)', 1)), ''))"""


SPANS = S.with_(S.LINE_FORMS, S.SHAPES, f"spans as (select *, {sql_span('text')} as span from shapes)")


@query("choice_letter", SPANS + f"select prompt_id, k, {sql_letter('span', 'text')} as letter from spans")
def choice_letter(spark, d):
    s = I.shape_samples(spark, d).withColumn("span", T.final_span(F.col("text")))
    return s.select("prompt_id", "k", T.choice_letter(F.col("span"), F.col("text")).alias("letter"))


@query("score_shape", SPANS + rf"""
select prompt_id, k, coalesce(case
  when regexp_full_match(ground_truth, '\(\s*([A-Ra-r])\s*\)')
    then {sql_letter('span', 'text')} = lower(regexp_extract(ground_truth, '[A-Ra-r]'))
  when regexp_full_match(ground_truth, '-?\d+')
    then try_cast(coalesce(regexp_extract_all(span, '-?\d+')[-1], regexp_extract_all(text, '-?\d+')[-1]) as bigint) = try_cast(ground_truth as bigint)
  else {sql_token('span')} = {sql_token('ground_truth')}
    or regexp_matches(lower(span), '(?:^|[^a-z])' || regexp_escape({sql_token('ground_truth')}) || '(?:[^a-z]|$)') end, false)::double as utility
from spans""")
def score_shape(spark, d):
    return scoring.score_shape(I.shape_samples(spark, d)).select("prompt_id", "k", "utility")


FENCED_SQL = r"""fenced as (
  select doc_id, case doc_id % 3 when 0 then 'Code:' || chr(10) || '```python' || chr(10) || text || '```' || chr(10) || 'done'
                     when 1 then '```' || chr(10) || text || chr(10) || '``` ```py' || chr(10) || 'x```' else text end as answer from documents)"""


@query("strip_fence", S.with_(FENCED_SQL) + r"""
select doc_id, md5(code) as code_md5, length(code) as n_chars from (select doc_id,
  case when regexp_matches(answer, '(?s)```(?:python|py)?\s*\n(.*?)```') then regexp_extract(answer, '(?s)```(?:python|py)?\s*\n(.*?)```', 1)
       else answer end as code from fenced)""")
def strip_fence(spark, d):
    third = F.col("doc_id") % 3
    answer = (
        F.when(third == 0, F.concat(F.lit("Code:\n```python\n"), F.col("text"), F.lit("```\ndone")))
        .when(third == 1, F.concat(F.lit("```\n"), F.col("text"), F.lit("\n``` ```py\nx```")))
        .otherwise(F.col("text"))
    )
    docs = I.table(spark, d, "documents").select("doc_id", answer.alias("answer"))
    code = docs.select("doc_id", T.strip_fence(F.col("answer")).alias("code"))
    return code.select("doc_id", F.md5("code").alias("code_md5"), F.length("code").cast("bigint").alias("n_chars"))


@query("starter_method", r"""
select p_partkey, case when p_size % 4 = 0 then null else replace(p_name, ' ', '_') end as method from part""")
def starter_method(spark, d):
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    starter = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("def "), name, F.lit("(x):\n    pass"))).otherwise(
        F.concat(F.lit("class Solution:\n    def  "), name, F.lit(" ( self, x: int) -> int:\n        pass"))
    )
    return I.table(spark, d, "part").select("p_partkey", T.starter_method(starter).alias("method"))


SQL_STDOUT = r"(returncode = 0 and regexp_replace(stdout, '\s+$', '') = regexp_replace(expected, '\s+$', ''))"
SQL_JSON = r"(returncode = 0 and regexp_replace(stdout, '\s', '', 'g') = regexp_replace(expected, '\s', '', 'g'))"


@query("stdout_match", S.with_(S.OUTCOMES) + f"select prompt_id, count(*) filter ({SQL_STDOUT}) as n_match, count(*) as n_tests from outcomes group by all")
def stdout_match(spark, d):
    hit = T.stdout_match(F.col("returncode"), F.col("stdout"), F.col("expected"))
    return I.outcomes(spark, d).groupBy("prompt_id").agg(F.count_if(hit).alias("n_match"), F.count("*").alias("n_tests"))


@query("json_match", S.with_(S.OUTCOMES) + f"select prompt_id, count(*) filter ({SQL_JSON}) as n_match, count(*) as n_tests from outcomes group by all")
def json_match(spark, d):
    hit = T.json_match(F.col("returncode"), F.col("stdout"), F.col("expected"))
    return I.outcomes(spark, d).groupBy("prompt_id").agg(F.count_if(hit).alias("n_match"), F.count("*").alias("n_tests"))


PROGRAMS_SQL = f"""
select o.o_orderkey as prompt_id, 0 as k, coalesce(t.u, 0.0)::double as utility
from orders o left join (
  select prompt_id, min(case when testtype = 'exotic' or not ok or seconds > 10 or before > 60 then 0.0 else 1.0 end) as u
  from (select *, case when testtype = 'stdin' then {SQL_STDOUT} else {SQL_JSON} end as ok,
               coalesce(sum(seconds) over (partition by prompt_id order by test_idx rows between unbounded preceding and 1 preceding), 0) as before
        from outcomes) group by prompt_id) t on t.prompt_id = o.o_orderkey"""


@query("all_tests_pass", S.with_(S.OUTCOMES) + PROGRAMS_SQL)
def all_tests_pass(spark, d):
    samples = I.table(spark, d, "orders").select(F.col("o_orderkey").alias("prompt_id"), F.lit(0).alias("k"))
    return scoring.all_tests_pass(samples, I.outcomes(spark, d))


@query("answer_key", S.with_(S.LINE_FORMS, S.BOXED, f"found as (select *, {sql_box('text')} as answer from boxed)") + r"""
select prompt_id, k, 'gsm8k' as dataset, cast(case when f < 5 then q end as double) as number_key, null as box_key from forms
union all select prompt_id, k, 'math', null, regexp_replace(answer, '\s', '', 'g') from found""")
def answer_key(spark, d):
    both = I.mixed_samples(spark, d, {"gsm8k": I.numeric_case(), "math": I.boxed_case()})
    keyed = both.withColumn("key", scorers.key_dispatch(F.col("dataset"), F.col("text")))
    numeric = F.col("dataset") == "gsm8k"
    return keyed.select(
        "prompt_id", "k", "dataset",
        F.when(numeric, F.col("key").try_cast("double")).alias("number_key"),
        F.when(~numeric, F.col("key")).alias("box_key"),
    )




@query("score_dispatch", S.with_(S.LINE_FORMS, S.BOXED, S.SHAPES,
    f"found as (select *, {sql_box('text')} as answer from boxed)",
    r"squashed as (select *, regexp_replace(answer, '\s', '', 'g') as l, regexp_replace(ground_truth, '\s', '', 'g') as r from found)",
    f"spans as (select *, {sql_span('text')} as span from shapes)", S.OUTCOMES, f"programs as ({PROGRAMS_SQL})") + rf"""
select 'gsm8k' as dataset, prompt_id, k, coalesce(f < 5 and q = g, false)::double as utility from forms
union all select 'math', prompt_id, k, coalesce(l = r or {sql_close(sql_ratio('l'), sql_ratio('r'))}, false)::double from squashed
union all select 'matharena', prompt_id, k, coalesce(l = r or {sql_close(sql_ratio('l'), sql_ratio('r'))}, false)::double from squashed
union all select case when prompt_id % 2 = 0 then 'humaneval' else 'livecodebench' end, prompt_id, k, utility from programs
union all select 'bbh', prompt_id, k, coalesce(case
  when regexp_full_match(ground_truth, '\(\s*([A-Ra-r])\s*\)')
    then {sql_letter('span', 'text')} = lower(regexp_extract(ground_truth, '[A-Ra-r]'))
  when regexp_full_match(ground_truth, '-?\d+')
    then try_cast(coalesce(regexp_extract_all(span, '-?\d+')[-1], regexp_extract_all(text, '-?\d+')[-1]) as bigint) = try_cast(ground_truth as bigint)
  else {sql_token('span')} = {sql_token('ground_truth')}
    or regexp_matches(lower(span), '(?:^|[^a-z])' || regexp_escape({sql_token('ground_truth')}) || '(?:[^a-z]|$)') end, false)::double
from spans""")
def score_dispatch(spark, d):
    """Six datasets in one job; programs are judged by their recorded test runs."""
    cases = {" GSM8K": I.numeric_case(), "Math ": I.boxed_case(), "bbh": I.shape_case(), "matharena": I.boxed_case()}
    language = lambda key: F.when(F.col(key) % 2 == 0, " HumanEval").otherwise("livecodebench\n").alias("dataset")
    texts = I.mixed_samples(spark, d, cases)
    programs = I.table(spark, d, "orders").select(language("o_orderkey"), F.col("o_orderkey").alias("prompt_id"), F.lit(0).alias("k"))
    outcomes = I.outcomes(spark, d).select("*", language("prompt_id"))
    scored = E.score_samples(texts.unionByName(programs, allowMissingColumns=True), ["dataset"], outcomes=outcomes)
    return scored.select(scorers.dataset_key(F.col("dataset")).alias("dataset"), "prompt_id", "k", F.col("u").alias("utility"))


@query("register_scorer", S.with_(S.FORMS, S.SAMPLES, S.SHAPES) + r"""
select 'gsm8k' as dataset, prompt_id, k, coalesce(f < 5 and q = g, false)::double as utility from forms
union all select 'last line', prompt_id, k, (trim(string_split(text, chr(10))[-1]) = trim(ground_truth))::double from shapes""")
def register_scorer(spark, d):
    """A scorer in Python beside a built-in one: only the rows of its own dataset go through Python."""

    @F.pandas_udf("double")
    def last_line(text: pd.Series, truth: pd.Series) -> pd.Series:
        return (text.str.split("\n").str[-1].str.strip(" ") == truth.str.strip(" ")).astype(float)

    scorers.register_scorer("Last Line", last_line)
    try:
        cases = {"gsm8k": I.numeric_case(), " last line": I.shape_case()}
        texts = I.mixed_samples(spark, d, cases, I.sample_forms(spark, d))
        scored = E.score_samples(texts, ["dataset"])
    finally:
        scorers.unregister_scorer("Last Line")
    return scored.select(scorers.dataset_key(F.col("dataset")).alias("dataset"), "prompt_id", "k", F.col("u").alias("utility"))


# --- judging ---------------------------------------------------------------

@query("judge_worklist", f"""
select c.conv_id as ordinal, c.turn as k, cast(l.range as integer) as l,
       {S.hex32("7, conv_id, turn, l.range")} % 2 = 1 as a_is_candidate,
       7 * 100003 + (conv_id * 64 + turn) * 5 + l.range as call_seed
from conversations c, range(5) l where not (c.role = 'user' and l.range = 2)""")
def judge_worklist(spark, d):
    turns = I.table(spark, d, "conversations").select(F.col("conv_id").alias("ordinal"), F.col("turn").alias("k"), "role")
    done = turns.where(F.col("role") == "user").select("ordinal", "k", F.lit(2).alias("l"))
    return J.judge_worklist(turns.drop("role"), n_votes=5, k_max=64, seed=7, done=done)


@query("judge_prompt", f"""
select doc_id, md5('User question:' || chr(10) || source || chr(10) || chr(10) || '--- Response A ---' || chr(10)
  || case when c then text else lang end || chr(10) || chr(10) || '--- Response B ---' || chr(10)
  || case when c then lang else text end || chr(10) || chr(10) || 'Which is better? Answer with one letter (A, B, or T):') as prompt_md5
from (select *, {S.hex32("3, doc_id")} % 2 = 1 as c from documents)""")
def judge_prompt(spark, d):
    from bestofk.functions.hashing import coin

    prompt = J.judge_prompt(F.col("source"), F.col("text"), F.col("lang"), coin(F.lit(3), "doc_id"))
    return I.table(spark, d, "documents").select("doc_id", F.md5(prompt).alias("prompt_md5"))


@query("parse_verdict", S.with_(S.CALLS, S.VOTES) + "select prompt_id, k, l, a_is_candidate, verdict, vote from votes")
def parse_verdict(spark, d):
    return J.with_votes(I.judge_calls(spark, d)).select("prompt_id", "k", "l", "a_is_candidate", "verdict", "vote")


@query("majority_vote", S.with_(S.CALLS, S.VOTES, S.COUNTS) + """
select prompt_id, k, n_win, n_lose, n_votes,
       cast(case when n_win >= (n_votes + 1) // 2 then 1 when n_lose >= (n_votes + 1) // 2 then 0 else 0.5 end as double) as u from counts""")
def majority_vote(spark, d):
    return J.majority_vote(I.votes(spark, d)).select("prompt_id", "k", "n_win", "n_lose", "n_votes", "u")


@query("judge_stats", S.with_(S.CALLS, S.VOTES) + """
select model, dataset, round(avg((verdict is null)::double), 12) as parse_failure_rate, count(*) as n_judge_calls from votes group by all""")
def judge_stats(spark, d):
    return rounded(J.judge_stats(I.with_cell(I.judge_calls(spark, d)), CELL), "parse_failure_rate")


@query("position_bias", S.with_(S.CALLS, S.VOTES) + """
select model, dataset, round(avg(case when a_is_candidate then vote else 1 - vote end), 12) as a_pick_rate, count(*) as n_decided
from votes where vote <> 0.5 group by all""")
def position_bias(spark, d):
    return rounded(J.position_bias(I.votes(spark, d), CELL), "a_pick_rate")


@query("vote_margin", S.with_(S.CALLS, S.VOTES, S.COUNTS) + """
select model, dataset, round(avg(abs(n_win - n_lose)), 12) as mean_margin from counts group by all""")
def vote_margin(spark, d):
    return rounded(J.vote_margin(I.votes(spark, d), ["prompt_id", "k"], CELL), "mean_margin")


@query("krippendorff_alpha", S.with_(S.CALLS, S.VOTES, """pairs as (
  select a.model, a.dataset, sum((a.vote - b.vote) * (a.vote - b.vote)) / 4 as d_o
  from votes a join votes b on a.prompt_id = b.prompt_id and a.k = b.k and a.l <> b.l group by all)""",
    """marginal as (select model, dataset, vote, count(*)::double as n from votes group by all)""",
    """expected as (select a.model, a.dataset, sum(a.n * b.n * (a.vote - b.vote) * (a.vote - b.vote)) as s
  from marginal a join marginal b on a.model = b.model and a.dataset = b.dataset group by all)""",
    """total as (select model, dataset, count(*)::double as n, count(distinct (prompt_id, k)) as n_items from votes group by all)""") + """
select p.model, p.dataset, round(1 - p.d_o / (e.s / (t.n - 1)), 12) as alpha, t.n_items
from pairs p join expected e on e.model = p.model and e.dataset = p.dataset join total t on t.model = p.model and t.dataset = p.dataset""")
def krippendorff_alpha(spark, d):
    return rounded(J.krippendorff_alpha(I.votes(spark, d), ["prompt_id", "k"], CELL), "alpha")


def _l_trials() -> str:
    """Chances of the three outcomes per tally and L', summed over every possible composition of the drawn votes, and one draw per trial."""
    choose = lambda n, k: f"case when {k} > {n} then 0 else gamma({n} + 1) / gamma({k} + 1) / gamma({n} - {k} + 1) end"
    part = lambda i: f"cast('0x' || substr(md5(concat_ws('|', 0, {i // 5}, prompt_id, k, b)), {1 + 6 * (i % 5)}, 6) as bigint)"
    draw = " ".join(f"when {n} then {part(i)}" for i, n in enumerate((1, 3, 5, 7, 9)))
    return f"""tallies as (select model, prompt_id, k, n_win, n_lose, n_tie, n_votes from counts),
drawn as (
  select t.*, s.l_votes, w.i as w, l.i as l, s.l_votes - w.i - l.i as e
  from (select distinct n_win, n_lose, n_tie, n_votes from tallies) t, (values (1), (3), (5), (7), (9)) s(l_votes), range(10) w(i), range(10) l(i)
  where w.i + l.i <= s.l_votes),
weighed as (
  select *, case when l_votes <= n_votes
      then ({choose("n_win", "w")}) * ({choose("n_lose", "l")}) * ({choose("n_tie", "e")}) / ({choose("n_votes", "l_votes")})
      else gamma(l_votes + 1) / gamma(w + 1) / gamma(l + 1) / gamma(e + 1)
        * pow(n_win / n_votes, w) * pow(n_lose / n_votes, l) * pow(n_tie / n_votes, e) end as p
  from drawn),
chances as (
  select n_win, n_lose, n_tie, l_votes, round(sum(case when w >= (l_votes + 1) // 2 then p else 0 end) * 16777216) as win,
         round(sum(case when w >= (l_votes + 1) // 2 or l >= (l_votes + 1) // 2 then p else 0 end) * 16777216) as decided
  from weighed group by all),
trials as (
  select model, prompt_id, b, l_votes, case when draw < win then 1.0 when draw < decided then 0.0 else 0.5 end as u
  from (select t.*, c.l_votes, c.win, c.decided, r.range as b, case c.l_votes {draw.replace(", b))", ", r.range))")} end as draw
        from tallies t join chances c using (n_win, n_lose, n_tie), range(200) r)),
holes as (
  select model from (select model, prompt_id, count(distinct k) as n, max(k) + 1 as m from votes group by all) group by model having bool_or(n <> m))"""


@query("l_sensitivity", S.with_(S.CALLS, S.VOTES, S.COUNTS, _l_trials()) + """
select model, l_votes, case when model not in (select model from holes) then round(avg(r), 12) end as r_hat,
       case when model not in (select model from holes) then round(stddev_pop(r), 12) end as r_hat_std from (
  select model, l_votes, b, avg(r) as r from (
    select model, l_votes, b, prompt_id, max(u) - avg(u) as r from trials group by all) group by all) group by model, l_votes""")
def l_sensitivity(spark, d):
    from bestofk.operators.resample import l_sensitivity as study

    tallies = J.vote_counts(I.votes(spark, d), ["model", "prompt_id", "k"])
    return rounded(study(tallies, n_resamples=200, cell=["model"]), "r_hat", "r_hat_std")
