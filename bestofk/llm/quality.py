"""Quality rules: text statistics and an ordered list of threshold rules learned by sequential covering.

The learner works on counts only. Each labelled row becomes one bin number per statistic; a grow step is one aggregate
over (statistic, bin, label), from which the driver picks the threshold with the highest information gain; a prune step
is one aggregate over the rows kept apart. Rules that hold go into the list, the rows they cover leave, and the next
rule is grown. The list is emitted as one conditional Spark expression. Native functions only.

Defined cases: a null text has no words, all statistics 0, and fails the base rule; without labels of both classes the list is
empty and keeps everything; rows with null labels are not learned from; repeated rows are judged each for itself; of an
id with several labels each counts. Extra columns are ignored, or kept by ``keep_good``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bestofk.llm.common import fresh, words
from bestofk.session import materialise

WINDOW = 8
#: The statistics that rules may test, as expressions over the columns of ``text_stats``.
MEASURES = {
    "n_words": "cast(n_words as double)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "exclamations_per_word": "n_exclamations / greatest(n_words, 1)",
}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclamations")


def _repeats(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside windows that occur twice or more in their text.

    Window hashes are compared as a set first; only texts with a repeat sort them. Sorted by hash, equal windows are
    neighbours; their starts, sorted again, are merged into covered words. All of it stays in the row.
    """
    windows = F.transform(F.sequence(F.lit(1), F.col("n_words") - WINDOW + 1), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))
    docs = docs.withColumn("windows", F.when(F.col("n_words") > WINDOW, windows))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    by_hash = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn("by_hash", F.when(repeated, by_hash))
    twin = lambda x, k: (F.get("by_hash", k - 1)["h"] == x["h"]) | F.coalesce(F.get("by_hash", k + 1)["h"] == x["h"], F.lit(False))
    starts = F.transform(F.filter("by_hash", lambda x, k: F.coalesce(twin(x, k), F.lit(False)) | F.coalesce(F.get("by_hash", k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])
    covered = F.aggregate(
        F.array_sort(starts), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n")),
    )["n"]
    return docs.withColumn("n_repeat_words", F.when(F.col("by_hash").isNotNull(), covered).otherwise(0).cast("long"))


def text_stats(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id and the columns of STATS (long); the i-th column named in ``carry`` is kept as carry_i."""
    text = F.col("t")
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    kept = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry or [])]
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), *kept).withColumn("w", words(text)).withColumn("n_words", F.size("w"))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    base = base.withColumn("lines", F.when(F.contains(text, F.lit("\n")), lines))
    base = _repeats(base)
    return base.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), left(r"[\x20\x09-\x0D]+").alias("word_chars"),
        left(r"[^#*$%&|<>]+").alias("n_symbols"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        "n_repeat_words", left("[^A-Z]+").alias("n_capitals"), left("[^!]+").alias("n_exclamations"),
        *[f"carry_{i}" for i in range(len(kept))],
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def expression(self) -> Column:
        value = F.expr(MEASURES[self.measure])
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.expression()
    return out


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def _grow(rows: DataFrame, cuts: dict[str, list[float]], max_conditions: int) -> Rule:
    """Conditions added one by one, each the threshold of highest gain over the rows that still match."""
    names, rule = list(cuts), ()
    while len(rule) < max_conditions:
        table = (
            rows.where(_holds(rule)).select("bad", F.posexplode("bins").alias("measure", "bin"))
            .groupBy("measure", "bin", "bad").agg(F.count("*").alias("n")).collect()
        )
        counts = {(r["measure"], r["bin"], r["bad"]): r["n"] for r in table}
        best = (0.0, None)
        for m, name in enumerate(names):
            of = lambda bad, bins: sum(counts.get((m, b, bad), 0) for b in bins)  # noqa: B023, E731
            everything = range(len(cuts[name]) + 1)
            p0, n0 = of(1, everything), of(0, everything)
            for b, cut in enumerate(cuts[name], 1):
                for above in (True, False):
                    side = range(b, len(cuts[name]) + 1) if above else range(b)
                    gain = _gain(p0, n0, of(1, side), of(0, side))
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(name, above, cut))
        if not best[1]:
            break
        rule = (*rule, best[1])
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The beginning of ``rule`` that is worth most on rows not grown on, with the bad and good rows it covers there."""
    sums = []
    for k in range(1, len(rule) + 1):
        inside = _holds(rule[:k])
        sums += [F.count_if(inside & (F.col("bad") == 1)).alias(f"p{k}"), F.count_if(inside & (F.col("bad") == 0)).alias(f"n{k}")]
    row = rows.agg(*sums).first()
    worth = lambda k: ((row[f"p{k}"] - row[f"n{k}"]) / max(1, row[f"p{k}"] + row[f"n{k}"]), -k)
    k = max(range(1, len(rule) + 1), key=worth)
    return rule[:k], row[f"p{k}"], row[f"n{k}"]


def learn(
    stats: DataFrame, labels: DataFrame, *, n_cuts: int = 40, max_rules: int = 8, max_conditions: int = 3,
    min_precision: float = 0.97, min_cover: int = 3,
) -> list[Rule]:
    """Rules for bad texts (quality 0) from all labelled rows of ``stats``; two thirds grow rules, one third prunes.

    A rule enters the list if the pruning rows show at least ``min_precision``. What is collected: cut points and counts per bin.
    """
    marked = labels.where(F.col("quality").isNotNull()).select("doc_id", (F.col("quality") == 0).cast("int").alias("bad"))
    rows = stats.select("doc_id", *STATS).join(marked, "doc_id").where(~base_failed())
    rows = materialise(rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(3))), "labelled")
    steps = [i / n_cuts for i in range(1, n_cuts)]
    quantiles = lambda only: [F.percentile_approx(F.when(only, F.expr(e)), F.array(*map(F.lit, steps))).alias(m) for m, e in MEASURES.items()]
    found = rows.agg(*quantiles(F.lit(True))).first(), rows.agg(*quantiles(F.col("bad") == 1)).first()
    cuts = {m: sorted({v for row in found for v in row[m] or ()}) for m in MEASURES}
    bins = [sum(((F.expr(MEASURES[m]) >= c).cast("int") for c in cuts[m]), F.lit(0)) for m in MEASURES]
    rows = materialise(rows.withColumn("bins", F.array(*bins)), "binned")
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = rows.where(~verdict_rejects(rules))
        rule = _grow(left.where("part < 2"), cuts, max_conditions)
        if not rule:
            break
        rule, p, n = _prune(left.where("part = 2"), rule)
        if p < min_cover or p < min_precision * (p + n):
            break
        rules.append(rule)
    return rules


def verdict_rejects(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: true where a rule fires, false at its end."""
    out = None
    for rule in rules:
        out = F.when(_holds(rule), True) if out is None else out.when(_holds(rule), True)
    return F.lit(False) if out is None else out.otherwise(False)


def describe(rules: list[Rule]) -> list[str]:
    return ["if " + " and ".join(map(str, r)) + " then drop" for r in rules] + ["else keep"]


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Statistics, base_failed and kept per document. Texts are read once for the statistics of all rows."""
    stats = materialise(text_stats(docs), "stats")
    rules = learn(stats, labels, **options)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~verdict_rejects(rules))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass the base rule and the learned list, all their columns unchanged.

    Every row is measured in place, and the rules are learned from the statistics of labelled rows: texts are never shuffled. Then every row is measured
    again and judged in one scan.
    """
    rules = learn(materialise(text_stats(docs), "stats"), labels, **options)
    names = docs.columns
    # The verdict goes through a generator: Catalyst would push a filter on it below the projections and work out the statistics once
    # more for every place that uses them.
    verdict = F.explode_outer(F.array(~base_failed() & ~verdict_rejects(rules)))
    judged = text_stats(docs, carry=names).withColumn("keep", verdict).where("keep")
    return judged.select(*[F.col(f"carry_{i}").alias(c) for i, c in enumerate(names)])
