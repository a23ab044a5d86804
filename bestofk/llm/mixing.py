"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Every source is one line of words, its documents laid end to end in a seeded order and cut into blocks of equal
length. Blocks are the seats: they go to the sources by highest quotients target / (2 * seats + 1), so that each
output shard gets an integer quota of blocks per source. A source's blocks are visited in a seeded order, over
and over if its seats are more than its blocks; every shard selects its own quota, the visits that follow those of the shard before.

Defined cases: a null or empty text has size 0 and takes nothing; null is a source of its own, the last; a table
without words has targets 0; repeated rows and repeated ids count as separate documents. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bestofk.functions.text import let
from bestofk.llm.common import running_start, words

#: Two primes; a step that shares no factor with the number of blocks visits every block.
STEPS = (1_000_003, 1_000_033)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """``sizes`` (key, source_size), one row per source, with ``target`` and ``place``.

    The sources together share the sum of all sizes by weight; a target stops at ``cap`` times its source's size and what is
    above goes to the others by weight. Sorted by the level at which a source fills up, the full ones are a prefix,
    so one running sum settles who is full. The windows hold one row per source, never documents.
    """
    everything = Window.partitionBy()
    by_key, by_level = Window.orderBy("key"), Window.orderBy("level", "key")
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    later = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight_list = F.array(*[F.lit(w) for w in weights])
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_key) - 1)
        .withColumn("weight", F.get(weight_list, F.col("place") % len(weights)).cast("double"))
        .withColumn("full", F.col("source_size") * F.lit(float(cap)))
        .withColumn("level", F.col("full") / F.col("weight"))
        .withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(earlier), F.lit(0.0)))
        .withColumn("share", F.col("rest") / F.sum("weight").over(later))
        .withColumn("is_full", F.col("share") > F.col("level"))
    )
    open_share = F.max(F.when(~F.col("is_full"), F.struct(-F.col("level"), -F.col("place"), F.col("share"))))
    return ranked.withColumn("open", open_share.over(everything)["share"]).select(
        "key", "source_size", "place",
        F.when(F.col("is_full"), F.col("full")).otherwise(F.col("weight") * F.col("open")).alias("target"),
    )


def apportion(parties: DataFrame, house: str, seats: str) -> DataFrame:
    """Sainte-Lague seats for ``parties`` (house, key, place, target, seats): adds ``won``.

    ``seats`` is the size of the house, the same on all its rows. The rounded share is within one seat per party of the
    answer; the few seats that are missing or too many go by highest (or lowest) quotient, ties to the
    smaller place, among as many quotients per party as can matter: O(parties) rows in all.
    """
    within = Window.partitionBy(house)
    total, n = F.sum("target").over(within), F.count("*").over(within)
    first = (
        parties.withColumn("votes", total).withColumn("n_parties", n)
        .withColumn("base", F.when(F.col("votes") > 0, F.floor(F.col("target") / F.col("votes") * F.col(seats) + 0.5)).otherwise(0).cast("long"))
        .withColumn("missing", F.when(F.col("votes") > 0, F.col(seats) - F.sum("base").over(within)).otherwise(0).cast("long"))
        .withColumn("tries", F.ceil((F.abs("missing") + F.col("n_parties")) * F.coalesce(F.col("target") / F.nullif("votes", F.lit(0.0)), F.lit(0.0))).cast("long") + 1)
        .withColumn("tries", F.when(F.col("missing") < 0, F.least("tries", "base")).when(F.col("missing") == 0, F.lit(0)).otherwise(F.col("tries")))
    )
    step = F.explode(F.sequence(F.lit(1), F.col("tries"))).alias("step")
    quotient = F.col("target") / (2 * F.col("base") + F.when(F.col("missing") > 0, 2 * F.col("step") - 1).otherwise(1 - 2 * F.col("step")))
    by_quotient = Window.partitionBy(house).orderBy(F.when(F.col("missing") > 0, -quotient).otherwise(quotient), F.when(F.col("missing") > 0, F.col("place")).otherwise(-F.col("place")), "step")
    changed = (
        first.where("tries > 0").select("*", step)
        .withColumn("rank", F.row_number().over(by_quotient)).where("rank <= abs(missing)")
        .groupBy(house, "key").agg((F.count("*") * F.first(F.signum("missing")).cast("long")).alias("delta"))
    )
    return first.join(changed, [house, "key"], "left").select(
        *parties.columns, (F.col("base") + F.coalesce("delta", F.lit(0))).alias("won")
    )


def shard_quotas(targets: DataFrame, block_words: int, cap: int, n_shards: int) -> DataFrame:
    """Blocks per (source, shard): key, source_size, target, place, n_blocks, shard, quota, and ``won``, the quotas up to this shard.

    Shard i takes the seats that Sainte-Lague adds between the houses of i and i + 1 shards; the rule never takes a seat
    back when the house grows, so quotas are not negative and add up to the whole. A source gives at most ``cap`` times its blocks.
    """
    everything = Window.partitionBy()
    houses = (
        targets.withColumn("n_blocks", F.greatest(F.lit(1), F.floor(F.col("source_size") / block_words)).cast("long"))
        .withColumn("all_seats", F.round(F.sum("target").over(everything) / block_words).cast("long"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
        .withColumn("seats", F.floor(F.col("all_seats") * (F.col("shard") + 1) / n_shards).cast("long"))
    )
    along = Window.partitionBy("key").orderBy("shard")
    capped = apportion(houses, "shard", "seats").withColumn("won", F.least("won", cap * F.col("n_blocks")))
    return capped.select(
        "key", "source_size", "target", "place", "n_blocks", "shard", "won",
        (F.col("won") - F.coalesce(F.lag("won").over(along), F.lit(0))).alias("quota"),
    )


def source_key(source: Column) -> Column:
    """Sorts as the source by code point, null last, and is never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def mix(
    docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block_words: int = 16, n_shards: int = 8,
    seed: int = 0, bucket_digits: int = 3, carry: list[str] | None = None,
) -> DataFrame:
    """doc_id, size, source_size, target, n_blocks, quota, ``by_shard`` (words that each shard takes, repeats counted) and ``taken``, their sum, per document.

    The place of a document in its source comes from md5(seed, doc_id); the hex prefix is the bucket of a two-level
    running sum, so a source that holds a third of all rows is never one task. The i-th column named in ``carry`` is kept
    as carry_i.
    """
    kept = carry or []
    base = docs.select(
        "doc_id", *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(kept)],
        source_key(F.col("source")).alias("key"), F.size(words(F.col("text"))).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("mark"),
    ).withColumn("bucket", F.substring("mark", 1, bucket_digits))
    sizes = base.groupBy("key").agg(F.sum("size").alias("source_size"))
    quotas = shard_quotas(source_targets(sizes, weights, cap), block_words, cap, n_shards)
    sources = quotas.groupBy("key", "source_size", "target", "n_blocks").agg(
        F.sum("quota").alias("quota"), F.transform(F.array_sort(F.collect_list(F.struct("shard", "won"))), lambda x: x["won"]).alias("ends"))
    laid = running_start(base, ["key"], "bucket", [F.col("mark"), F.col("size")], "size", "start")
    step = F.when(F.col("n_blocks") % STEPS[0] != 0, STEPS[0]).otherwise(STEPS[1]).cast("long")
    shift = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("key"))), 1, 7), 16, 10).cast("long")
    placed = (
        laid.join(sources, "key").withColumn("finish", F.col("start") + F.col("size"))
        .withColumn("step", step).withColumn("shift", shift)
    )
    block_of = lambda word: F.least(F.floor(word / block_words).cast("long"), F.col("n_blocks") - 1)
    block_end = lambda j: F.when(j == F.col("n_blocks") - 1, F.col("source_size")).otherwise((j + 1) * block_words)
    overlap = lambda j: F.least("finish", block_end(j)) - F.greatest(F.col("start"), j * block_words)
    # A document's blocks: their first visit and the words they share with it. Visits of a block come every n_blocks seats.
    first_visit = lambda j: (j * F.col("step") + F.col("shift")) % F.col("n_blocks")
    blocks = F.transform(
        F.sequence(block_of(F.col("start")), block_of(F.col("finish") - 1)), lambda j: F.struct(first_visit(j).alias("visit"), overlap(j).alias("words")))
    visits = lambda end, block: F.greatest(F.lit(0).cast("long"), F.ceil((end - block["visit"]) / F.col("n_blocks")).cast("long"))
    up_to = lambda parts, end: F.aggregate(parts, F.lit(0).cast("long"), lambda sum_, block: sum_ + visits(end, block) * block["words"])
    ends = let(blocks, lambda parts: F.transform("ends", lambda end: up_to(parts, end)))
    each = let(ends, lambda sums: F.transform(sums, lambda x, i: x - F.when(i > 0, F.get(sums, i - 1)).otherwise(0)))
    nothing = F.transform("ends", lambda end: F.lit(0).cast("long"))
    placed = placed.withColumn("by_shard", F.when(F.col("size") > 0, each).otherwise(nothing))
    taken = F.aggregate("by_shard", F.lit(0).cast("long"), lambda sum_, x: sum_ + x)
    return placed.select(
        "doc_id", "size", "source_size", "target", "n_blocks", "quota", "by_shard", taken.alias("taken"),
        *[f"carry_{i}" for i in range(len(kept))],
    )


def mixed_documents(docs: DataFrame, *, seed: int = 0, **options) -> DataFrame:
    """``docs`` as the mix holds them: each document 0 to ``cap`` times.

    A document comes taken / size times; the fraction is rounded up with that probability by a hash of its id, so the sum
    per source stays near its target. Documents without words have no say in the mix and stay as they are.
    """
    names = docs.columns
    mixed = mix(docs, seed=seed, carry=names, **options)
    coin = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 20)) / (1 << 20)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + coin)).cast("int")
    return (
        mixed.withColumn("times", copies).where("times > 0")
        .withColumn("one_of", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .select(*[F.col(f"carry_{i}").alias(c) for i, c in enumerate(names)])
    )
