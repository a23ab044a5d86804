"""Prompt sets and worklists: selection, rendering, reference answers, grids of work still to do.

Parameter lists (datasets, seeds, budgets) expand inside a row with ``explode``; rows never meet in a
cross join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bestofk.functions.text import rstrip, strict_json

# What stage two of a length-budgeted answer adds, its token cap, the seed step.
ANSWER_PROMPT = "\n\nFinal answer:"
ANSWER_TOKENS = 64
CALL_SEED_STEP = 100003


def union_subsets(rows: DataFrame, subsets: Sequence[str], per_subset: int, subset: str, prompt: str, answer: str, ordinal: str) -> DataFrame:
    """The first ``per_subset`` rows of each subset, subsets in list order.

    The rank has a constant limit, so every map task already drops the rest of a large subset.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in subsets]), F.col(subset))
    kept = rows.where(F.col(subset).isin(*subsets)).select(
        place.alias("subset_no"),
        F.col(subset).alias("subset"),
        F.col(ordinal).alias("ordinal"),
        F.col(prompt).cast("string").alias("question"),
        F.col(answer).cast("string").alias("ground_truth"),
    )
    rank = F.row_number().over(Window.partitionBy("subset_no", "subset").orderBy("ordinal"))
    return kept.withColumn("row_no", rank).where(F.col("row_no") <= per_subset)


def date_cutoff(rows: DataFrame, column: str, cutoff: str) -> DataFrame:
    """Rows dated at or after the cutoff; undated rows drop out. The predicate reaches the scan."""
    return rows.where(F.col(column) >= F.lit(cutoff).cast("timestamp_ntz"))


def head_prompts(rows: DataFrame, num_prompts: int, ordinal: str = "ordinal") -> DataFrame:
    return rows.orderBy(ordinal).limit(num_prompts)


def decode_bytes(column: Column) -> Column:
    return F.decode(column, "UTF-8")


def few_shot(examples: str | Column, user: Column) -> Column:
    examples = F.lit(examples) if isinstance(examples, str) else examples
    return F.concat(rstrip(examples), F.lit("\n\n"), user)


def chat_messages(system: Column, user: Column) -> Column:
    """Ordered role/content list; an empty system turn is left out."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    both = F.array(turn("system", system), turn("user", user))
    return F.when(F.coalesce(system, F.lit("")) == "", F.slice(both, 2, 1)).otherwise(both)


def ground_truth_code(test: Column, entry_point: Column) -> Column:
    return F.concat(test, F.lit("\ncheck("), entry_point, F.lit(")\n"))


TESTS_TYPE = "array<struct<input:string,output:string,testtype:string>>"


def ground_truth_bundle(public: Column, private: Column, starter: Column) -> Column:
    """Both test lists joined, with the starter code; either list unreadable means no tests."""
    def readable(source: Column) -> Column:
        listed = F.coalesce(source, F.lit("[]"))
        return F.when(strict_json(listed).isNotNull(), F.from_json(listed, TESTS_TYPE))

    tests = F.coalesce(F.concat(readable(public), readable(private)), F.array().cast(TESTS_TYPE))
    return F.struct(tests.alias("tests"), F.coalesce(starter, F.lit("")).alias("starter_code"))


def ground_truth_preference(chosen: Column) -> Column:
    """First assistant turn of a role/content array, empty when there is none."""
    first = F.try_element_at(F.filter(chosen, lambda m: m["role"] == "assistant"), F.lit(1))
    return F.coalesce(first["content"], F.lit(""))


def preference_from_turns(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """The same for a long table of turns: an aggregate, so a huge conversation is never one array."""
    own = F.when(F.col(role) == "assistant", F.col(turn))
    return turns.groupBy(conversation).agg(F.coalesce(F.min_by(text, own), F.lit("")).alias("ground_truth"))


def prompt_ids(dataset: Column, ordinal: Column, length: Column | None = None) -> Column:
    parts = [dataset] + ([F.concat(F.lit("L"), length.cast("string"))] if length is not None else []) + [ordinal.cast("string")]
    return F.concat_ws("_", *parts)


def _literal_rows(rows: Sequence[Mapping]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows])


def cell_grid(models: DataFrame, datasets: Sequence[Mapping], seeds: Sequence[int], settings: Sequence[Mapping]) -> DataFrame:
    """Every (model, dataset, seed, setting) with the dataset's K, M and token cap.

    ``settings`` are rows (procedure, value); direct sampling at temperature 0 needs one sample only. A row may
    also name the ``datasets`` it is for: self-consistency needs datasets with an answer key.
    """
    limits = [F.array(*map(F.lit, s["datasets"])) if "datasets" in s else F.lit(None).cast("array<string>") for s in settings]
    procedures = F.array(*[
        F.struct(F.lit(s["procedure"]).alias("procedure"), F.lit(float(s["value"])).alias("value"), limit.alias("only"))
        for s, limit in zip(settings, limits)
    ])
    grid = (
        models.select("model")
        .select("model", F.inline(_literal_rows(datasets)))
        .select("*", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
        .select("*", F.inline(procedures)).where(F.col("only").isNull() | F.array_contains("only", F.col("dataset"))).drop("only")
    )
    greedy = (F.col("procedure") == "direct") & (F.col("value") == 0)
    return grid.withColumn("k", F.when(greedy, 1).otherwise(F.col("k")))


def sample_worklist(prompts: DataFrame, k_max: int, seed: int, done: DataFrame) -> DataFrame:
    """(ordinal, k) calls not in the ledger, each with its seed."""
    calls = prompts.select("*", F.explode(F.sequence(F.lit(0), F.lit(k_max - 1))).alias("k"))
    return calls.join(done.select("ordinal", "k"), ["ordinal", "k"], "left_anti").withColumn(
        "call_seed", F.lit(seed * CALL_SEED_STEP).cast("bigint") + F.col("k")
    )


def budget_stage2_worklist(stage1: DataFrame, length: int, seed: int) -> DataFrame:
    """Stage-two prompts for answers whose reasoning was cut at ``length`` tokens."""
    if length < 0:
        raise ValueError(f"max_reasoning_length must be >= 0, got {length}")
    return stage1.withColumns({
        "stage2_prompt": F.concat("prompt", "stage1_text", F.lit(ANSWER_PROMPT)),
        "stage1_max_tokens": F.lit(max(1, length)),
        "stage2_max_tokens": F.lit(ANSWER_TOKENS),
        "stage2_seed": F.lit(seed + 1),
    })


def budget_stitch(stage1: DataFrame, stage2: DataFrame, keys: Sequence[str] = ("prompt_id", "k")) -> DataFrame:
    joined = stage1.select(*keys, "stage1_text").join(stage2.select(*keys, "stage2_text"), list(keys))
    return joined.select(*keys, F.concat("stage1_text", F.lit(ANSWER_PROMPT), "stage2_text").alias("text"))


# Which study scope a dataset belongs to.
SCOPES = {
    "development": ["gsm8k", "math", "humaneval", "bbh"],
    "deployment": ["matharena", "livecodebench"],
    "preference": ["ultrafeedback", "alpaca_eval"],
}


def scope_of(dataset: Column, scopes: Mapping[str, Sequence[str]] = SCOPES) -> Column:
    return F.coalesce(*[F.when(dataset.isin(*members), F.lit(scope)) for scope, members in scopes.items()])


def scope_split(cells: DataFrame, scopes: Mapping[str, Sequence[str]] = SCOPES) -> tuple[DataFrame, DataFrame]:
    """Cells with their scope, and the datasets that belong to none."""
    tagged = cells.withColumn("scope", scope_of(F.col("dataset"), scopes))
    return tagged.where(F.col("scope").isNotNull()), tagged.where(F.col("scope").isNull()).select("dataset").distinct()
