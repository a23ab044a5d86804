"""The package's tables derived from the given ones: a projection each, one row out for one row in.

Dense keys give dense matrices without a window, a shuffle or an overwritten row: row number n is sample n % K of prompt
n div K. The last prompt of a table may have fewer samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K_SAMPLES = 64
K_TEXTS = 64
K_JUDGED, L_VOTES = 9, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_name(key: Column) -> Column:
    return F.concat(F.lit("m"), (key % 3).cast("string"))


def dataset_name(key: Column) -> Column:
    return F.concat(F.lit("d"), (F.floor(key / 3) % 2).cast("string"))


def with_cell(df: DataFrame, key: str = "prompt_id") -> DataFrame:
    return df.withColumns({"model": model_name(F.col(key)), "dataset": dataset_name(F.col(key))})


def utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, k, u, u3): binary and ternary utility of every event, K=64 samples per prompt."""
    high = F.col("value") > 60
    full, half = (F.col("event_type") == "purchase") & high, (F.col("event_type") == "signup") & high
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / K_SAMPLES).alias("prompt_id"),
        (F.col("event_id") % K_SAMPLES).cast("int").alias("k"),
        F.when(full, 1.0).otherwise(0.0).alias("u"),
        F.when(full, 1.0).when(half, 0.5).otherwise(0.0).alias("u3"),
    )


def cell_utility(spark: SparkSession, sf_dir: str, column: str = "u") -> DataFrame:
    return with_cell(utility(spark, sf_dir).select("prompt_id", "k", F.col(column).alias("u")))


def sample_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, k, q, f, g): answer value and surface form of every order, K=64 samples per prompt; ``g`` is the prompt's
    reference answer."""
    return table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / K_TEXTS).alias("prompt_id"),
        (F.col("o_orderkey") % K_TEXTS).cast("int").alias("k"),
        (F.floor("o_totalprice") % 5).cast("int").alias("q"),
        (F.col("o_custkey") % 6).cast("int").alias("f"),
        (F.floor(F.col("o_orderkey") / K_TEXTS) % 5).cast("int").alias("g"),
    )


def line_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns for every line item, for rules that look at one answer at a time."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("prompt_id"),
        F.col("l_linenumber").cast("int").alias("k"),
        (F.col("l_quantity").cast("int") % 5).alias("q"),
        (F.col("l_partkey") % 6).cast("int").alias("f"),
        (F.col("l_orderkey") % 5).cast("int").alias("g"),
    )


def _say(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _by_form(choices: list[Column]) -> Column:
    chain = F
    for form, text in enumerate(choices):
        chain = chain.when(F.col("f") == form, text)
    return chain


def numeric_case() -> tuple[Column, Column]:
    """Numeric answers in six surface forms, and the reference."""
    q = F.col("q")
    text = _by_form([
        _say("Work 1,200 then\n#### ", q),
        _say("so \\boxed{", q, ".0}"),
        _say("The answer is $", q, " of 99"),
        _say("we had 7 and get ", q, "."),
        _say("paid ", q, " then lost -$50"),
        F.lit("no idea"),
    ])
    return text, _say("explained\n#### ", F.col("g"))


def boxed_case() -> tuple[Column, Column]:
    """Boxed answers: plain, nested braces, several boxes, unbalanced ones, a box in a box, none."""
    q, g = F.col("q"), F.col("g")
    text = _by_form([
        _say("x \\boxed{", q, "}"),
        _say("\\boxed{\\frac{", q, "}{2}}"),
        _say("\\boxed{9} then \\boxed { ", q, " }"),
        _say("\\boxed{", q, "} then \\boxed{open"),
        _say("\\boxed{open \\boxed{", q, "}"),
        F.lit("nothing"),
    ])
    return text, F.when(g == 3, _say("\\frac{", g, "}{2}")).otherwise(g.cast("string"))


def shape_case() -> tuple[Column, Column]:
    """Answers for letter, token and count targets."""
    q, g = F.col("q"), F.col("g")
    letter = lambda n: F.substring(F.lit("ABCDE"), n + 1, F.lit(1))
    text = _by_form([
        _say("maybe (E)? Final answer: (", letter(q), ")"),
        _say("Final answer: ", letter(q)),
        F.lit("Final answer: invalid"),
        F.lit("thus the answer is: valid."),
        _say("So far 3. Answer - ", q),
        F.lit("reasoning\nNo"),
    ])
    truth = (
        F.when(F.col("prompt_id") % 3 == 0, _say("(", letter(g), ")"))
        .when((F.col("prompt_id") % 3 == 1) & (g < 2), "valid")
        .when(F.col("prompt_id") % 3 == 1, "No")
        .otherwise(g.cast("string"))
    )
    return text, truth


def _answers(forms: DataFrame, case: tuple[Column, Column]) -> DataFrame:
    return forms.select("prompt_id", "k", case[0].alias("text"), case[1].alias("ground_truth"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, k, text, ground_truth), K=64 per prompt."""
    return _answers(sample_forms(spark, sf_dir), numeric_case())


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(line_forms(spark, sf_dir), numeric_case())


def boxed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(sample_forms(spark, sf_dir), boxed_case())


def line_boxed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(line_forms(spark, sf_dir), boxed_case())


def shape_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(line_forms(spark, sf_dir), shape_case())


def mixed_samples(spark: SparkSession, sf_dir: str, cases: dict[str, tuple[Column, Column]], forms: DataFrame | None = None) -> DataFrame:
    """Answers of several datasets in one table, from one scan: each form gives a row per dataset."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("dataset"), text.alias("text"), truth.alias("ground_truth")) for name, (text, truth) in cases.items()
    ])
    return (line_forms(spark, sf_dir) if forms is None else forms).select("prompt_id", "k", F.inline(rows))


VERDICT_TEXT = {"click": "A", "view": " b", "error": "T", "signup": "????", "purchase": "A."}


def judge_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, k, l, verdict_text, a_is_candidate): a call per event, K=9 samples with L=5 votes per prompt."""
    from bestofk.functions.hashing import coin

    slot = F.col("event_id") % (K_JUDGED * L_VOTES)
    text = F
    for kind, said in VERDICT_TEXT.items():
        text = text.when(F.col("event_type") == kind, said)
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / (K_JUDGED * L_VOTES)).alias("prompt_id"),
        F.floor(slot / L_VOTES).cast("int").alias("k"),
        (slot % L_VOTES).cast("int").alias("l"),
        text.alias("verdict_text"),
    ).withColumn("a_is_candidate", coin(F.lit(0), "prompt_id", "k", "l"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bestofk.operators.judge import with_votes

    return with_cell(with_votes(judge_calls(spark, sf_dir)))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only decision log with re-runs: several records per (experiment, prompt_id, k)."""
    return audit_records(table(spark, sf_dir, "events"))


def audit_records(events: DataFrame) -> DataFrame:
    """Log records from events, stored or streamed."""
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("ingest_seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(
            F.lit("h1_m"), (F.col("user_id") % 3).cast("string"), F.lit("_uf_seed"), (F.col("event_id") % 2).cast("string")
        ).alias("experiment"),
        F.col("user_id").alias("prompt_id"),
        (F.col("event_id") % 16).cast("int").alias("k"),
        F.when(kind == "error", F.lit(None).cast("string")).when(kind == "view", "ABT").otherwise("ABTAA").alias("verdicts"),
        (F.col("value") > 60).cast("double").alias("utility"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded test runs: (prompt_id, k, test_idx, testtype, returncode, stdout, expected, seconds)."""
    functional = F.col("l_returnflag") == "N"
    bit = (F.col("l_quantity").cast("int") % 7 == 0).cast("int").cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("prompt_id"),
        F.lit(0).alias("k"),
        (F.col("l_linenumber").cast("bigint") * 1000000000 + F.col("l_partkey")).alias("test_idx"),
        F.when(functional, "functional").when(F.col("l_discount") > 0.099, "exotic").otherwise("stdin").alias("testtype"),
        (F.col("l_tax") > 0.079).cast("int").alias("returncode"),
        F.when(functional, _say("[", bit, ", 1]")).otherwise(_say(bit, " \n")).alias("stdout"),
        F.when(functional, F.lit("[0,1]")).otherwise(F.lit("0\n")).alias("expected"),
        (F.col("l_quantity") / 4).alias("seconds"),
    )


CURVE_GRID = (1, 2, 4, 8)
STAGES = ("sft", "dpo", "rlvr")
TAUS = (0.0, 0.7, 1.0)
LENGTHS = (0, 64, 128, 256, 512, 1024, 2048)
SC_SIZES = (2, 4, 8)


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested result row per experiment file; several files for some keys.

    Sums are over whole cents, so the one division per value is the only rounding.
    """
    lines = table(spark, sf_dir, "lineitem")
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint"))
    grouped = lines.groupBy(
        (F.col("l_suppkey") % 20).alias("s"), (F.col("l_partkey") % 6).alias("d"), F.col("l_linenumber").alias("n")
    ).agg(
        cents("l_discount").alias("disc"),
        cents("l_tax").alias("tax"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
        F.count("*").alias("cnt"),
    )
    s, d, n = F.col("s"), F.col("d"), F.col("n")
    hyp = F.concat(F.lit("h"), (s % 4 + 1).cast("string"))
    base = grouped.select(
        hyp.alias("hyp"),
        F.concat(F.lit("m"), (s % 5).cast("string")).alias("model"),
        F.concat(F.lit("d"), (d % 4).cast("string"), F.when(d >= 4, "_judge-x").otherwise("")).alias("dataset_id"),
        F.concat(F.lit("d"), (d % 4).cast("string")).alias("dataset"),
        F.floor(n / 6).cast("int").alias("seed"),
        F.when(hyp == "h2", _pick(STAGES, n % 3)).alias("stage"),
        F.when(hyp == "h3", F.when(n % 2 == 0, "sc").otherwise("direct")).alias("procedure"),
        F.when((hyp == "h3") & (n % 2 == 1), _pick(TAUS, F.floor(n / 2) % 3)).alias("tau"),
        F.when((hyp == "h3") & (n % 2 == 0), _pick(SC_SIZES, F.floor(n / 2) % 3)).alias("sc_n"),
        F.when(hyp == "h4", _pick(LENGTHS, n % 7)).alias("length"),
        (F.lit(0.5) + F.col("disc") / F.col("cnt") / 20).alias("reu"),
        (F.col("tax") / F.col("cnt") / 20).alias("aeu"),
        F.when(n % 5 != 0, F.lit(0.01)).alias("ci_down"),
        F.when((hyp != "h3") & ((hyp != "h4") | (n % 2 == 0)), F.col("qty").cast("double")).alias("sampling_seconds"),
        n.alias("n"),
    ).withColumns({
        "rvr": F.col("reu") - F.col("aeu"),
        "file_name": F.format_string("%s_%s_seed%d_f%d", "model", "dataset_id", "seed", "n"),
    })
    point = lambda k: F.struct(
        F.lit(k).alias("k_prefix"),
        (F.col("reu") - F.lit((CURVE_GRID[-1] - k) / 64)).alias("u_circ"),
        F.col("aeu").alias("u_bar"),
    )
    whole = F.array(*[point(k) for k in CURVE_GRID])
    no_half = F.array(*[point(k) for k in CURVE_GRID if k != 4])
    return base.select(
        "hyp", "model", "dataset_id", "dataset", "seed", "file_name", "stage", "procedure", "tau", "sc_n", "length",
        "reu", "aeu", "rvr",
        (F.col("rvr") - F.col("ci_down")).alias("ci_low"),
        (F.col("rvr") + F.col("ci_down") * 2).alias("ci_high"),
        "sampling_seconds",
        F.when(F.col("n") % 2 == 0, no_half).otherwise(whole).alias("curve"),
    )


def compute_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPU-hour log with repeated (experiment, seed) records."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ingest_seq"),
        F.concat(
            F.lit("h"), (F.col("o_custkey") % 6 + 1).cast("string"), F.lit("_m"), (F.col("o_custkey") % 4).cast("string"),
            F.lit("_"), F.col("o_orderpriority"),
        ).alias("experiment"),
        (F.col("o_orderkey") % 3).alias("seed"),
        (F.floor(F.col("o_totalprice")) / 1024).alias("gpu_hours"),
    )


def configs(spark: SparkSession, sf_dir: str, source: str = "orders") -> DataFrame:
    """Sampling configurations read off the orders (stored) or the customers (requested)."""
    if source == "orders":
        key, rows = F.col("o_custkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    else:
        key, rows = F.col("c_custkey"), table(spark, sf_dir, "customer").select("c_custkey")
    return rows.select(
        *rows.columns,
        F.lit(K_SAMPLES).alias("K"),
        F.concat(F.lit("d"), (key % 7).cast("string")).alias("dataset"),
        F.when(key % 2 == 0, key % 3 * 64).cast("int").alias("max_reasoning_length"),
        F.lit(1024).alias("max_tokens"),
        F.concat(F.lit("org/m"), key.cast("string")).alias("model"),
        (key % 100 + 1).cast("int").alias("num_prompts"),
        F.lit("v1").alias("prompt_template_version"),
        (key % 5).cast("int").alias("seed"),
        (key % 4 / 4).alias("temperature"),
        F.lit(-1).alias("top_k"),
        F.lit(1).alias("top_p"),
    )
