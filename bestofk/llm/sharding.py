"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Documents with an equal link value (by default the text) are linked. All documents of one link in one shard have the same
neighbours, so the state of the propagation is a count per (link, shard): at most one row per shard and link, however many
documents share the link. Every round joins the state with each link's strongest shard, and a flow from shard i to j may
use as much as flows back plus its part of the free room in j. The last step places documents by exact ranks: a
shard keeps its linked documents up to its quota, all others fill what is left, link by link.

Law ``rows``: shard sizes in documents differ by one at most.

Defined cases: a null text is the empty text (size 16, crc32 0); repeated rows and ids count as separate documents;
an empty table gives an empty result. Extra columns are ignored, or carried on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bestofk.llm.common import running_start, text_key
from bestofk.session import materialise

#: Documents per task in ranking steps.
BUCKET_ROWS = 20_000


def _unit(*columns: Column | str) -> Column:
    """A hash in [0, 1)."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / (1 << 30)


def _flows(state: DataFrame, quotas: list[int]) -> list[list[float]]:
    """Accepted fraction of every proposed flow from shard i to j; collects at most shards x shards sums."""
    n = len(quotas)
    wish, load = [[0] * n for _ in quotas], [0] * n
    for row in state.groupBy("shard", "best").agg(F.sum("n").alias("n")).collect():
        load[row["shard"]] += row["n"]
        if row["shard"] != row["best"]:
            wish[row["shard"]][row["best"]] = row["n"]
    accepted = [[0.0] * n for _ in quotas]
    for j in range(n):
        room = max(0, quotas[j] - load[j])
        swaps = [min(wish[i][j], wish[j][i]) for i in range(n)]
        more = sum(wish[i][j] - swaps[i] for i in range(n))
        part = min(1.0, room / more) if more else 0.0
        for i in range(n):
            if wish[i][j]:
                accepted[i][j] = (swaps[i] + (wish[i][j] - swaps[i]) * part) / wish[i][j]
    return accepted


def propagate(state: DataFrame, quotas: list[int], rounds: int, seed: int) -> DataFrame:
    """``state`` (link, shard, n) after at most ``rounds`` rounds of moves.

    A link wants the shard that holds most of it; ties go by a hash, so tied links do not all pick the same shard.
    """
    for turn in range(rounds):
        rank = F.struct("n", F.xxhash64(F.lit(seed), "link", "shard"))
        best = state.groupBy("link").agg(F.max_by("shard", rank).alias("best"))
        wishes = materialise(state.join(best, "link"), "wishes")
        accepted = _flows(wishes, quotas)
        if not any(any(row) for row in accepted):
            break
        table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in accepted])
        fraction = F.get(F.get(table, F.col("shard")), F.col("best"))
        moved = F.floor(F.col("n") * fraction + _unit(F.lit(seed + turn), F.col("link"), F.col("shard"))).cast("long")
        parts = F.array(
            F.struct(F.col("shard").alias("shard"), (F.col("n") - F.col("moved")).alias("n")),
            F.struct(F.col("best").alias("shard"), F.col("moved").alias("n")),
        )
        state = (
            wishes.withColumn("moved", F.when(F.col("shard") == F.col("best"), 0).otherwise(F.least("n", moved)))
            .select("link", F.inline(parts)).where("n > 0").groupBy("link", "shard").agg(F.sum("n").alias("n"))
        )
    return state


def shard_documents(
    docs: DataFrame, *, n_shards: int = 40, rounds: int = 6, seed: int = 0, link: Column | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot per document; the i-th column named in ``carry`` comes as carry_i."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = carry or []
    base = materialise(
        docs.select(
            "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            (text_key(F.col("text")) if link is None else link).alias("link"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(kept)],
        ).withColumn("dice", F.xxhash64(F.lit(seed), "doc_id", "link")),
        "shard-rows",
    )
    state = base.select("link", F.pmod("dice", F.lit(n_shards)).cast("int").alias("shard")).groupBy("link", "shard").agg(F.count("*").alias("n"))
    grouped = state.groupBy("link").agg(F.sum("n").alias("of_link"))
    state = materialise(state.join(grouped, "link").where("of_link > 1"), "links")
    total = base.count()
    quotas = [total // n_shards + (i < total % n_shards) for i in range(n_shards)]
    final = propagate(state.select("link", "shard", "n"), quotas, rounds, seed)
    # One row per link with two or more documents: how many of it each shard gets, n_shards entries at most.
    packed = materialise(
        final.groupBy("link").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("parts"), F.sum("n").alias("of_link")), "plan"
    )
    spread = F.pmod("dice", F.ceil(F.col("of_link") / BUCKET_ROWS).cast("long"))
    rows = base.join(packed, "link", "left").withColumn("salt", F.coalesce(spread, F.lit(0))).withColumn("one", F.lit(1).cast("long"))
    linked = running_start(
        rows.where("of_link is not null"), ["link"], "salt", [F.col("dice"), F.col("doc_id"), F.col("size")], "one", "nth"
    )
    # Its place in the link says which part of the plan a document belongs to.
    found = F.aggregate(
        "parts", F.struct(F.lit(-1).alias("shard"), F.col("nth").alias("left")),
        lambda acc, p: F.when((acc["shard"] < 0) & (acc["left"] < p["n"]), F.struct(p["shard"].alias("shard"), acc["left"].alias("left")))
        .otherwise(F.struct(acc["shard"].alias("shard"), (acc["left"] - p["n"]).alias("left"))),
    )
    n_buckets = max(1, total // BUCKET_ROWS)
    bucket = F.struct(F.pmod(F.xxhash64(F.lit(seed), "link"), F.lit(n_buckets)).alias("b"), F.col("salt").alias("s"))
    order = [F.col("link"), F.col("dice"), F.col("doc_id"), F.col("size")]
    columns = ["doc_id", "size", "text_crc32", "link", "dice", "salt", "one", *[f"carry_{i}" for i in range(len(kept))]]
    homed = linked.withColumn("shard", found["shard"]).withColumn("bucket", bucket).select(*columns, "shard", "bucket")
    homed = materialise(running_start(homed, ["shard"], "bucket", order, "one", "slot"), "homed")
    quota = F.get(F.array(*[F.lit(q) for q in quotas]), F.col("shard"))
    stay = homed.where(F.col("slot") < quota)
    held = dict.fromkeys(range(n_shards), 0) | {r["shard"]: r["count"] for r in stay.groupBy("shard").count().collect()}
    singles = rows.where("of_link is null").withColumn("bucket", bucket).select(*columns, "bucket")
    pool = homed.where(F.col("slot") >= quota).select(*columns, "bucket").unionByName(singles)
    queued = running_start(pool.withColumn("all", F.lit(0)), ["all"], "bucket", order, "one", "nth")
    # Free places in shard order: shard j takes those of the queue whose number lies in its stretch.
    stretches, begin = [], 0
    for j in range(n_shards):
        free = quotas[j] - held[j]
        if free:
            stretches.append((j, begin, held[j]))
            begin += free
    place = F.lit(None).cast("struct<shard:int,slot:bigint>")
    for j, start, first in stretches:
        place = F.when(F.col("nth") >= start, F.struct(F.lit(j).alias("shard"), (F.col("nth") - start + first).alias("slot"))).otherwise(place)
    filled = queued.withColumn("place", place).withColumn("shard", F.col("place.shard")).withColumn("slot", F.col("place.slot"))
    out = ["doc_id", "size", "text_crc32", "shard", "slot", *[f"carry_{i}" for i in range(len(kept))]]
    return stay.select(*out).unionByName(filled.select(*out))
