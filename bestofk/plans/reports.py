"""Report tables over the result rows: last file per cell, alias lookup, pivots, flags, accounting.

Result rows are one per experiment; pivot columns are parameters, so no extra job looks them up.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bestofk.functions.joins import join_cells

# Fixed values.
TIE = 1e-9
SHADE_MAX = 60
METRICS = ("reu", "aeu", "rvr")
CHALLENGE = {
    "ultrafeedback": "Open", "alpaca_eval": "Open",
    "gsm8k": "Easy", "math": "Medium", "humaneval": "Easy",
    "matharena": "Expert", "livecodebench": "Hard",
}
HYPOTHESES = ("h1", "h2", "h3", "h4")


def index_cells(results: DataFrame, keys: Sequence[str], order: Sequence[str] = ("file_name",)) -> DataFrame:
    """One row per key: the last file in name order. Rows with a null key do not count."""
    rest = [c for c in results.columns if c not in keys]
    keyed = results
    for key in keys:
        keyed = keyed.where(F.col(key).isNotNull())
    return keyed.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def ci_half() -> Column:
    return F.coalesce((F.col("ci_high") - F.col("ci_low")) / 2, F.lit(0.0))


def metric_cell(results: DataFrame) -> DataFrame:
    """Add the interval's half-width, 0 when there is no interval."""
    return results.withColumn("ci_half", ci_half())


def slot_grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """The slots of a report from its parameter lists."""
    rows = [[x for part in row for x in (part if isinstance(part, tuple) else (part,))] for row in product(*axes.values())]
    names = [n for axis in axes for n in axis.split("__")]
    return spark.createDataFrame(rows, names)


def lookup_cell(
    slots: DataFrame,
    index: DataFrame,
    model_aliases: Mapping[str, Sequence[str]] | None = None,
    dataset_aliases: Mapping[tuple[str, str], str] | None = None,
) -> DataFrame:
    """The result row of each (model, dataset_id) slot; a slot without one keeps nulls.

    A slot names its own cell first, then the model's aliases, then the dataset's alias for that model,
    then both. The candidates of a slot are rows; the first one that exists wins.
    """
    pair = lambda m, d: F.struct(m.alias("m"), d.alias("d"))
    model, dataset = F.col("model"), F.col("dataset_id")
    swap = F.lit(None).cast("string")
    for (m, d), other in (dataset_aliases or {}).items():
        swap = F.when((model == m) & (dataset == d), F.lit(other)).otherwise(swap)
    candidates = []
    for target in (dataset, swap):
        candidates.append(pair(model, target))
        for name, aliases in (model_aliases or {}).items():
            candidates += [pair(F.when(model == name, F.lit(a)), target) for a in aliases]
    values = [c for c in index.columns if c not in ("model", "dataset_id")]
    tried = slots.select("*", F.posexplode(F.array(*candidates)).alias("turn", "c"))
    found = tried.join(
        index.withColumnRenamed("model", "m").withColumnRenamed("dataset_id", "d").select("m", "d", F.struct(*values).alias("cell")),
        (F.col("c.m") == F.col("m")) & (F.col("c.d") == F.col("d")),
        "left",
    )
    hit = F.when(F.col("m").isNotNull(), F.col("turn"))
    return found.groupBy(*slots.columns).agg(F.min_by("cell", hit).alias("cell")).select(*slots.columns, "cell.*")


def _beside(rows: DataFrame, row: Sequence[str], **facts: Column) -> DataFrame:
    """Put aggregates of a report row beside its members: partial sums and a join, no window over the row."""
    found = rows.groupBy(*row).agg(*[fact.alias(name) for name, fact in facts.items()])
    return join_cells(rows, found, row)


def mark_extreme(rows: DataFrame, row: Sequence[str], value: str, **flags: str) -> DataFrame:
    """Flag every value within a tie of the row's minimum or maximum: ``best="min"``."""
    refs = {f"__{flag}": F.min(value) if mode == "min" else F.max(value) for flag, mode in flags.items()}
    near = lambda ref: F.coalesce(F.abs(F.col(value) - F.col(ref)) < TIE, F.lit(False))
    return _beside(rows, row, **refs).withColumns({flag: near(f"__{flag}") for flag in flags}).drop(*refs)


def mark_smallest_positive(rows: DataFrame, row: Sequence[str], value: str, order: str, flag: str = "best") -> DataFrame:
    """Flag the single smallest positive value of the row, the first one on ties."""
    mine = F.when(F.col(value) > 0, F.struct(F.col(value), F.col(order)))
    return _beside(rows, row, __ref=F.min(mine)).withColumn(flag, F.coalesce(mine == F.col("__ref"), F.lit(False))).drop("__ref")


def pivot_models(cells: DataFrame, row: Sequence[str], models: Sequence[str], values: Sequence[str], column: str = "model") -> DataFrame:
    """One row per ``row`` key, columns <model>_<value>."""
    return cells.groupBy(*row).pivot(column, list(models)).agg(*[F.first(v, ignorenulls=True).alias(v) for v in values])


def long_metrics(cells: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Unpivot the metric columns: (keys..., metric, value)."""
    return cells.unpivot(list(keys), list(metrics), "metric", "value")


def pivot_metrics(cells: DataFrame, row: Sequence[str], column: str, columns: Sequence, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Rows (row..., metric), one column per value of ``column``."""
    tall = long_metrics(cells, [*row, column], metrics)
    return tall.groupBy(*row, "metric").pivot(column, list(columns)).agg(F.first("value", ignorenulls=True))


def with_challenge(cells: DataFrame, levels: Mapping[str, str] = CHALLENGE) -> DataFrame:
    """Difficulty label of the base dataset, the text before a judge suffix."""
    base = F.split_part("dataset_id", F.lit("_judge-"), F.lit(1))
    label = F.coalesce(*[F.when(base == d, F.lit(v)) for d, v in levels.items()], F.lit(""))
    return cells.withColumn("challenge", label)


def with_pct_rvr(cells: DataFrame) -> DataFrame:
    """Unreachable mass and the recoverable share of the whole shortfall."""
    a_k = F.lit(1.0) - F.col("reu")
    total = a_k + F.col("rvr")
    return cells.withColumns({"a_k": a_k, "pct_rvr": F.when(total > 0, F.col("rvr") / total).when(total.isNotNull(), 0.0)})


def heat_intensity(value: Column, top: int = SHADE_MAX) -> Column:
    """Cell shade in percent: clamped to [0, 1], scaled, rounded half to even."""
    return F.bround(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * top, 0).cast("int")


def curve_points(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored curves as rows; the gap is always recomputed as best minus mean."""
    rows = results.select(*keys, F.inline("curve"))
    return rows.withColumn("r_hat", F.col("u_circ") - F.col("u_bar"))


def saturation_series(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Curve points, the interval at the last one."""
    last = F.array_max(F.transform("curve", lambda p: p["k_prefix"]))
    rows = results.select(*keys, "ci_low", "ci_high", last.alias("k_max"), F.inline("curve"))
    at_end = F.col("k_prefix") == F.col("k_max")
    return rows.withColumns({
        "r_hat": F.col("u_circ") - F.col("u_bar"),
        "ci_low": F.when(at_end, F.col("ci_low")),
        "ci_high": F.when(at_end, F.col("ci_high")),
    })


def saturation_pivot(results: DataFrame, keys: Sequence[str], grid: Sequence[int]) -> DataFrame:
    """(keys..., metric) x K, with the interval half-width beside the gap."""
    points = curve_points(results.withColumn("ci_half", (F.col("ci_high") - F.col("ci_low")) / 2), [*keys, "ci_half"])
    tall = points.unpivot([*keys, "ci_half", "k_prefix"], ["u_circ", "u_bar", "r_hat"], "metric", "value")
    wide = tall.groupBy(*keys, "metric", F.when(F.col("metric") == "r_hat", F.col("ci_half")).alias("ci_half"))
    return wide.pivot("k_prefix", list(grid)).agg(F.first("value"))


def epsilon_budget(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Truncation residual, interval half-width and their maximum; a missing part does not count."""
    k_max = F.array_max(F.transform("curve", lambda p: p["k_prefix"]))
    gap_at = lambda k: F.try_element_at(F.filter("curve", lambda p: p["k_prefix"] == k), F.lit(1))
    gap = lambda p: p["u_circ"] - p["u_bar"]
    full = gap(gap_at(k_max))
    half = F.coalesce(gap(gap_at(F.floor(k_max / 2).cast("int"))), full)
    return results.select(
        *keys, k_max.alias("k_max"), F.abs(full - half).alias("truncation"), ((F.col("ci_high") - F.col("ci_low")) / 2).alias("half_width")
    ).withColumn("epsilon", F.greatest("truncation", "half_width"))


def gpu_hours(results: DataFrame, budget: DataFrame) -> DataFrame:
    """Cells, timed cells, hours and their source per hypothesis, with a total row.

    All cells timed: their own seconds. None timed: the compute log, if it knows the hypothesis.
    Some timed: the larger of the two. Hypotheses without cells still get a row.
    """
    tally = results.where(F.col("hyp").isin(*HYPOTHESES)).groupBy("hyp").agg(
        F.count("*").alias("n"), F.count("sampling_seconds").alias("n_timed"), (F.sum("sampling_seconds") / 3600.0).alias("own")
    )
    frame = results.sparkSession.createDataFrame([(h,) for h in HYPOTHESES], "hyp string")
    rows = frame.join(tally, "hyp", "left").join(budget.withColumnRenamed("gpu_hours", "logged"), "hyp", "left")
    n, timed = F.coalesce("n", F.lit(0)), F.coalesce("n_timed", F.lit(0))
    own, logged = F.coalesce("own", F.lit(0.0)), F.col("logged")
    complete = (timed == n) & (n > 0)
    rows = rows.select(
        "hyp", n.alias("n_cells"), timed.alias("n_timed"),
        F.when(complete, own).when(timed == 0, logged).otherwise(F.greatest(own, F.coalesce(logged, F.lit(0.0)))).alias("hours"),
        F.when(complete, "per-cell").when((timed == 0) & logged.isNotNull(), "compute_budget").when(timed == 0, "no record")
        .otherwise("per-cell + budget").alias("source"),
    )
    total = rows.agg(F.sum("n_cells").alias("n_cells"), F.sum("n_timed").alias("n_timed"), F.sum("hours").alias("hours"))
    return rows.unionByName(total.withColumns({"hyp": F.lit("total"), "source": F.lit(None).cast("string")}))


#: Bins a pass divides each open range into, so the rows that come back to the driver: this many per wanted value.
QUANTILE_BINS = 1024


def order_values(rows: DataFrame, column: str, ranks: Sequence[int]) -> list[float]:
    """Values at the given ranks (from 0) of the sorted non-null values, exactly, without sorting.

    Each pass counts the rows of every range that still holds a wanted rank in equal bins and goes on with the bin of the rank, from its least to
    its greatest value; a range of one value is the answer. A pass collects at most QUANTILE_BINS rows per rank, however many distinct values there are.
    """
    value = F.col(column).cast("double")
    low, high = rows.agg(F.min(value), F.max(value)).first()
    open_ranges = {rank: (low, high, rank) for rank in ranks}  # rank: least and greatest value of its range, place in it
    found: dict[int, float] = {}
    while open_ranges:
        for rank, (least, most, _) in list(open_ranges.items()):
            if least == most:
                found[rank] = least
                del open_ranges[rank]
        ranges = sorted({(least, most) for least, most, _ in open_ranges.values()})
        if not ranges:
            break
        # Steps that would overflow or vanish are halved first; the ends always fall into different bins.
        place = F
        for i, (least, most) in enumerate(ranges):
            share = (value / 2 - least / 2) / (most / 2 - least / 2)
            inside = F.least(F.floor(share * QUANTILE_BINS), F.lit(QUANTILE_BINS - 1)) + i * QUANTILE_BINS
            place = place.when(value.between(least, most), inside)
        counted = rows.select(value.alias("v"), place.alias("bin")).where("bin is not null").groupBy("bin").agg(
            F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).orderBy("bin").collect()
        for rank, (least, most, at) in list(open_ranges.items()):
            first = ranges.index((least, most)) * QUANTILE_BINS
            for row in counted:
                if first <= row["bin"] < first + QUANTILE_BINS:
                    if at < row["n"]:
                        open_ranges[rank] = (row["least"], row["most"], at)
                        break
                    at -= row["n"]
    return [found[rank] for rank in ranks]


def exact_quantiles(rows: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Quantiles with linear interpolation between the two neighbouring values, equal to those of the whole sorted column; None without values."""
    n = rows.agg(F.count(column)).first()[0]
    if not n:
        return [None] * len(shares)
    at = [share * (n - 1) for share in shares]
    ranks = sorted({rank for a in at for rank in (math.floor(a), math.ceil(a))})
    value = dict(zip(ranks, order_values(rows, column, ranks)))
    return [value[math.floor(a)] + (value[math.ceil(a)] - value[math.floor(a)]) * (a - math.floor(a)) for a in at]


def length_terciles(rows: DataFrame, length: str) -> DataFrame:
    """Add short / medium / long by the terciles of the whole column."""
    q1, q2 = exact_quantiles(rows, length, (1 / 3, 2 / 3))
    return rows.withColumn("bucket", F.when(F.col(length) <= q1, "short").when(F.col(length) <= q2, "medium").otherwise("long"))


def level_digit(label: Column) -> Column:
    """First digit of a difficulty label."""
    return F.nullif(F.regexp_extract(label.cast("string"), r"(\d)", 1), F.lit("")).try_cast("int")


def key_print(key: str) -> list[Column]:
    """Aggregates that two equal sets of keys share and others do not: number, sum and exclusive or of hashes. They merge, so no set is built."""
    h = F.xxhash64(key)
    return [F.count("*").alias("n_keys"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("hash_sum"), F.bit_xor(h).alias("hash_xor")]


def gap_by_bucket(
    per_prompt: DataFrame, labels: DataFrame, models: Sequence[str], model: str = "model", planned: DataFrame | None = None
) -> DataFrame:
    """Bucket size and mean gap per bucket and model.

    ``labels`` is (prompt_id, bucket). ``planned`` holds the (model, prompt_id) that were to be sampled, without it every labelled prompt of
    every model. A model is comparable if its prompts are exactly its planned ones, not just as many; others get nulls.
    """
    if planned is None:
        planned = labels.select("prompt_id", F.explode(F.array(*map(F.lit, models))).alias(model))
    prints = ("n_keys", "hash_sum", "hash_xor")
    wanted = planned.groupBy(model).agg(*key_print("prompt_id"))
    found = per_prompt.groupBy(model).agg(*key_print("prompt_id")).withColumnsRenamed({c: f"own_{c}" for c in prints})
    fits = join_cells(found, wanted, [model]).where(" and ".join(f"{c} = own_{c}" for c in prints)).select(model)
    sizes = labels.groupBy("bucket").agg(F.count("*").alias("n"))
    means = (
        join_cells(per_prompt, fits, [model], "left_semi").join(labels, "prompt_id")
        .groupBy("bucket", model).agg(F.avg("r_hat").alias("r_hat"))
    )
    wide = means.groupBy("bucket").pivot(model, list(models)).agg(F.first("r_hat"))
    return join_cells(sizes, wide, ["bucket"], "left")


def cell_label(extra: Sequence[str] = ("stage", "tau", "sc_n", "length"), names: Mapping[str, str] | None = None) -> Column:
    """'model | dataset | tau=...' with the parts a cell has."""
    names = names or {"stage": "trajectory_stage", "tau": "tau", "sc_n": "sc_n", "length": "L"}
    parts = [F.concat(F.lit(f"{names[c]}="), F.col(c).cast("string")) for c in extra]
    return F.concat_ws(" | ", F.coalesce("model", F.lit("?")), F.coalesce("dataset", F.lit("?")), *parts)


def compute_approx_report(results: DataFrame, hyps: Sequence[str]) -> DataFrame:
    """Tidy rows of the unreachable mass over K, and the floor at the cell's last K.

    h5 reports on the hosted models, whose cells lie with those of h1.
    """
    wanted = F.array(*[F.struct(F.lit(h).alias("hypothesis"), F.lit("h1" if h == "h5" else h).alias("source")) for h in hyps])
    k_max = F.array_max(F.transform("curve", lambda p: p["k_prefix"]))
    rows = (
        results.select("*", F.inline(wanted))
        .where(F.col("hyp") == F.col("source"))
        .select("hypothesis", cell_label().alias("cell"), F.col("file_name").alias("stem"), k_max.alias("k_max"), F.inline("curve"))
    )
    a_k = F.lit(1.0) - F.col("u_circ")
    return rows.select(
        "hypothesis", "cell", "stem", "k_prefix", F.round("u_circ", 6).alias("u_circ"), F.round(a_k, 6).alias("a_k"),
        F.lit("__all__").alias("bucket"), (F.col("k_prefix") == F.col("k_max")).alias("is_floor"),
    )


def spike_by_bucket(success: DataFrame, labels: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Number of prompts and share without any success, overall and per bucket.

    ``success`` is (cell..., prompt_id, p_hat), ``labels`` (prompt_id, bucket). A cell whose prompts do not
    match the labels one to one keeps its overall row only.
    """
    n_labels = labels.agg(F.count("*")).scalar()
    tagged = success.join(labels, "prompt_id", "left")
    per_bucket = tagged.groupBy(*cell, "bucket").agg(F.count("*").alias("n"), F.sum((F.col("p_hat") == 0).cast("bigint")).alias("zeros"))
    overall = per_bucket.groupBy(*cell).agg(F.sum("n").alias("n"), F.sum("zeros").alias("zeros"), F.sum(F.when(F.col("bucket").isNotNull(), F.col("n"))).alias("n_labelled"))
    fits = overall.where((F.col("n") == n_labels) & (F.col("n_labelled") == F.col("n"))).select(*cell)
    rows = overall.select(*cell, F.lit("__all__").alias("bucket"), "n", "zeros").unionByName(join_cells(per_bucket, fits, cell, "left_semi"))
    return rows.select(*cell, "bucket", "n", (F.col("zeros") / F.col("n")).alias("zero_share"))
