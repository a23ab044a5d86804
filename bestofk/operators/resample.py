"""Resampling estimators: bootstrap intervals, self-consistency votes, subsample studies."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction
from hashlib import md5
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bestofk.functions.hashing import hash32
from bestofk.functions.joins import join_cells
from bestofk.functions.text import let
from bestofk.session import materialise, spread


def check_bootstrap(n_resamples: int, confidence: float) -> None:
    if n_resamples < 1:
        raise ValueError(f"n_resamples must be >= 1, got {n_resamples}")
    if not 0.0 < confidence < 1.0:
        raise ValueError(f"confidence must be in (0, 1), got {confidence}")


#: Standard deviations on either side of 1 between which the clock of a resample should stop; some three in a thousand do not and are replaced.
CLOCK_WIDTH = 3.0


def n_attempts(n_resamples: int) -> int:
    """Resamples to start so that, beyond any doubt, enough stop in time: 3 % more, and 16."""
    return n_resamples + n_resamples // 32 + 16


#: Distinct values of a cell that one task splits a resample over.
VALUES_PER_NODE = 1024


def _interval(means: DataFrame, cell: Sequence[str], n_resamples: int, confidence: float) -> DataFrame:
    alpha = (1.0 - confidence) / 2.0
    return means.groupBy(*cell).agg(
        F.avg("resample_mean").alias("mean"),
        F.percentile("resample_mean", F.lit(alpha)).alias("ci_low"),
        F.percentile("resample_mean", F.lit(1.0 - alpha)).alias("ci_high"),
    ).withColumns({"confidence": F.lit(confidence), "n_resamples": F.lit(n_resamples)})


def mass_bounds(rate: float) -> np.ndarray:
    """Cumulative masses of Poisson(rate) times 2 ** 32, as far as a 32-bit draw tells them apart: a draw counts the bounds it reaches."""
    bounds, term, mass = [], math.exp(-rate), math.exp(-rate)
    while (bound := math.ceil(mass * 2.0**32 - 0.5)) < 2**32 and len(bounds) < 200:
        bounds.append(bound)
        term *= rate / len(bounds)
        mass += term
    return np.array(bounds, np.int64)


def window(m: int) -> tuple[float, float]:
    """Where the clocks of a cell of ``m`` prompts are counted up to, and where they end."""
    return max(0.0, 1 - CLOCK_WIDTH / math.sqrt(m)), (m + CLOCK_WIDTH * math.sqrt(m) + 5) / m


#: Prompts whose draws are worked out at once, and cells whose counts a task adds up before it gives them out.
PROMPTS_AT_ONCE, CELLS_HELD = 64, 256


def _clocks(names: Sequence[str], m: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Of prompts in cells of ``m``: strokes counted per (prompt, resample); where each prompt's strokes of the window begin; their resample, time and number."""
    start, end = window(m)
    digests = b"".join([md5(f"{seed}|{h}|{name}".encode()).digest() for name in names for h in range(-(-n // 2))])
    draws = np.frombuffer(digests, ">u4").reshape(len(names), -1, 2)[:, :n]
    before = np.searchsorted(mass_bounds(start), draws[:, :, 0], "right")
    after = np.searchsorted(mass_bounds(end - start), draws[:, :, 1], "right")
    prompt, b = np.nonzero(after)
    times = after[prompt, b]
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + 1
    prompt, b = np.repeat(prompt, times), np.repeat(b, times)
    hashes = b"".join([md5(f"{seed}|{r}|{names[i]}|{j}".encode()).digest()[:4] for i, r, j in zip(prompt.tolist(), b.tolist(), nth.tolist())])
    return before, np.searchsorted(prompt, np.arange(len(names) + 1)), (b, np.frombuffer(hashes, ">u4").astype(np.int64), nth)


def _strokes(keys: Sequence[str], n: int, seed: int):
    """Per batch of prompts: every stroke of the window; and per task the counted strokes of each (cell, resample), added up.

    The clocks of a prompt are the same in all cells of one size, so its hashes are taken once for all of them."""
    shown = [*keys, "prompt_id", "m"]

    def counted(held: dict) -> Iterator[pd.DataFrame]:
        for row, counts, sums in held.values():
            yield row.iloc[np.zeros(n, np.int64)].assign(b=np.arange(n), at=-1, nth=0, w=counts.astype(np.int64), total=sums)
        held.clear()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in batches:
            for m, rows in batch.groupby("m", sort=False):
                prompt, names = pd.factorize(rows["name"].astype(str))
                rows, prompt = rows.iloc[np.argsort(prompt, kind="stable")], np.sort(prompt)
                cell, cells = pd.factorize(rows["cell_hash"])
                v, counts, sums, single = rows["v"].to_numpy(), np.zeros((len(cells), n)), np.zeros((len(cells), n)), []
                for low in range(0, len(names), PROMPTS_AT_ONCE):
                    some = names[low : low + PROMPTS_AT_ONCE].tolist()
                    before, begin, strokes = _clocks(some, int(m), n, seed)
                    at = np.arange(*np.searchsorted(prompt, [low, low + len(some)]))
                    own, weight, value = prompt[at] - low, np.zeros((len(cells), len(some))), np.zeros((len(cells), len(some)))
                    np.add.at(weight, (cell[at], own), 1.0)
                    np.add.at(value, (cell[at], own), v[at])
                    counts += weight @ before
                    sums += value @ before
                    size = begin[own + 1] - begin[own]
                    taken = np.arange(size.sum()) + np.repeat(begin[own] - np.cumsum(size) + size, size)
                    single.append((np.repeat(at, size), *(s[taken] for s in strokes)))
                place, b, at, nth = (np.concatenate(parts) for parts in zip(*single))
                yield rows.iloc[place][shown].assign(b=b, at=at, nth=nth, w=1, total=v[place])
                _, first = np.unique(cell, return_index=True)
                for c, name in enumerate(cells):
                    if name in held:
                        held[name][1] += counts[c]
                        held[name][2] += sums[c]
                    else:
                        held[name] = [rows.iloc[first[c] : first[c] + 1][shown], counts[c], sums[c]]
            if len(held) > CELLS_HELD:
                yield from counted(held)
        yield from counted(held)

    return run


def resample_draws(per_prompt: DataFrame, cell: Sequence[str], value: str, n_resamples: int, seed: int) -> DataFrame:
    """(cell..., prompt_id, m, b, at, nth, w, total): how often prompts were drawn, and the sum of their values, by time.

    Every prompt of a cell has a Poisson clock per resample; of clocks at one rate each stroke is a uniform draw of a prompt, so the first M
    strokes of the cell are a resample of exactly M draws with replacement. Strokes before 1 - 3 / sqrt(M) are only
    counted, at time -1, a row per task; the few in the window up to the end come one by one, with their time.
    The clocks are hashes of (seed, resample, prompt), taken once for all cells of one size that hold the prompt: the work is local to a prompt and what is shuffled per resample is the counts of the tasks and some
    6 sqrt(M) strokes.
    """
    keys = list(cell)
    known = per_prompt.select(*keys, "prompt_id", F.col(value).cast("double").alias("v")).where("v is not null")
    timed = join_cells(known, known.groupBy(*keys).agg(F.count("*").alias("m")), keys).withColumns(
        {"cell_hash": F.xxhash64(F.lit(0), *keys), "name": F.col("prompt_id").cast("string")})
    out = T.StructType([timed.schema[c] for c in (*keys, "prompt_id", "m")] + list(T.StructType.fromDDL("b bigint, at bigint, nth bigint, w bigint, total double")))
    together = spread(timed, "name").sortWithinPartitions("name")
    return together.mapInPandas(_strokes(keys, n_attempts(n_resamples), seed), out)


def bootstrap_means(
    per_prompt: DataFrame, cell: Sequence[str] = (), value: str = "r_hat", n_resamples: int = 1000, seed: int = 0
) -> DataFrame:
    """Means of B resamples of a cell's prompts, one row per resample with its weight sum ``n_drawn``, for values of any kind.

    A resample has exactly M draws with replacement (see ``resample_draws``). What is drawn does not depend on when, so a resample whose clock
    stops outside the window is replaced by the next one. Rows with a null value do not count.
    """
    if n_resamples < 1:
        raise ValueError(f"n_resamples must be >= 1, got {n_resamples}")
    keys = [*cell, "b"]
    strokes = resample_draws(per_prompt, cell, value, n_resamples, seed)
    so_far = Window.partitionBy(*keys).orderBy("at", "prompt_id", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timed = strokes.withColumn("so_far", F.sum("w").over(so_far))
    within = F.col("so_far") <= F.col("m")
    means = timed.groupBy(*keys).agg(
        F.sum(F.when(within, F.col("w"))).alias("n_drawn"), F.max("m").alias("m"), F.sum(F.when(within, F.col("total"))).alias("total"),
        F.sum(F.when(F.col("at") < 0, F.col("w"))).alias("counted"),
    ).where("n_drawn = m and counted <= m")
    nth = F.row_number().over(Window.partitionBy(*cell).orderBy("b")) - 1
    return means.select(*cell, nth.alias("b"), "n_drawn", (F.col("total") / F.col("m")).alias("resample_mean")).where(F.col("b") < n_resamples)


def bootstrap_ci(
    per_prompt: DataFrame,
    cell: Sequence[str] = (),
    value: str = "r_hat",
    n_resamples: int = 1000,
    confidence: float = 0.95,
    seed: int = 0,
) -> DataFrame:
    """Bootstrap interval of a cell mean: mean of resample means and linear percentiles."""
    check_bootstrap(n_resamples, confidence)
    means = bootstrap_means(per_prompt, cell, value, n_resamples, seed)
    return _interval(means, cell, n_resamples, confidence)


def _generator(seed: int, cell_hash: int, node: int) -> np.random.Generator:
    return np.random.default_rng([seed, cell_hash, node])


def _split(drawn: np.ndarray, sizes: Sequence[int], rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Deals each resample's draws to parts in turn, by the binomial that remains: together a multinomial."""
    rest, left = sum(sizes), drawn
    for size in sizes:
        taken = rng.binomial(left, size / rest) if size < rest else left
        yield taken
        left, rest = left - taken, rest - size


def bootstrap_means_scaled(
    per_prompt: DataFrame, cell: Sequence[str] = (), value: str = "r_hat", n_resamples: int = 1000, seed: int = 0
) -> DataFrame:
    """Means of B resamples of exactly M draws, one row per resample with its weight sum ``n_drawn``, by the distinct values of a cell.

    A cell's distinct values are the leaves of a tree of hashed nodes. A cell splits the M draws of each resample between its nodes and a node
    between its values, in proportion to the prompts they hold, each from a generator of its own, so a retried task repeats its draws.
    """
    keys = list(cell)
    counts = per_prompt.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")).where("v is not null")
    distinct = counts.groupBy(*keys).agg(F.ceil(F.count("*") / VALUES_PER_NODE).alias("nodes"))
    counts = join_cells(counts, distinct, keys).withColumns({
        "cell_hash": F.xxhash64(F.lit(0), *keys).bitwiseAND(F.lit((1 << 62) - 1)),
        "node": F.pmod(F.xxhash64("v"), F.col("nodes")),
    })
    key_fields = [counts.schema[k] for k in keys]
    dealt = T.StructType([*key_fields, T.StructField("cell_hash", T.LongType()), T.StructField("node", T.LongType()), T.StructField("drawn", T.BinaryType())])
    means = T.StructType([
        *key_fields, T.StructField("b", T.IntegerType()), T.StructField("n_drawn", T.LongType()), T.StructField("total", T.DoubleType())])

    def to_nodes(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        rng = _generator(seed, int(rows["cell_hash"].iat[0]), 0)
        whole = np.full(n_resamples, rows["n"].sum(), np.int64)
        return rows[[*keys, "cell_hash", "node"]].assign(drawn=[d.tobytes() for d in _split(whole, rows["n"].tolist(), rng)])

    def to_values(rows: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("v")
        rng = _generator(seed, int(rows["cell_hash"].iat[0]), 1 + int(rows["node"].iat[0]))
        drawn = np.frombuffer(nodes["drawn"].iat[0], np.int64)
        total = np.zeros(n_resamples)
        for v, taken in zip(rows["v"], _split(drawn, rows["n"].tolist(), rng)):
            total += v * taken
        out = rows.iloc[[0] * n_resamples][keys].reset_index(drop=True)
        return out.assign(b=np.arange(n_resamples, dtype=np.int32), n_drawn=drawn, total=total)

    per_node = counts.groupBy(*keys, "cell_hash", "node").agg(F.sum("n").alias("n"))
    nodes = per_node.groupBy("cell_hash").applyInPandas(to_nodes, dealt)
    sums = counts.groupBy("cell_hash", "node").cogroup(nodes.groupBy("cell_hash", "node")).applyInPandas(to_values, means)
    return sums.groupBy(*keys, "b").agg(
        F.sum("n_drawn").alias("n_drawn"), (F.sum("total") / F.sum("n_drawn")).alias("resample_mean"))


def bootstrap_ci_scaled(
    per_prompt: DataFrame,
    cell: Sequence[str] = (),
    value: str = "r_hat",
    n_resamples: int = 1000,
    confidence: float = 0.95,
    seed: int = 0,
) -> DataFrame:
    """The same interval with work that follows the distinct values of a cell, not its prompts."""
    check_bootstrap(n_resamples, confidence)
    means = bootstrap_means_scaled(per_prompt, cell, value, n_resamples, seed)
    return _interval(means, list(cell), n_resamples, confidence)


def sc_votes(keyed: DataFrame, sizes: Sequence[int], n_draws: int, k_max: int, cell: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Utility of self-consistency over each of ``sizes`` samples, ``n_draws`` draws per prompt: (cell..., prompt_id, k, sc_n, u), k being the draw.

    ``keyed`` holds (cell..., prompt_id, k, vote_key, u). A draw takes n of the prompt's samples (``k_max`` at most, else
    the job fails) with replacement; the most frequent key wins, ties go to the key drawn first, and the utility is
    that of its first drawn sample; a draw without any key scores 0. A smaller size uses the first samples of the same draw.

    A prompt's K samples (K is bounded by design) are gathered once, in one row, and their keys get small numbers there. Everything else
    happens inside that row: no exchange follows.
    """
    coded, fields = _coded_pools(keyed, sizes, n_draws, k_max, cell)
    out = T.StructType([*fields, *T.StructType.fromDDL("k int, sc_n int, u double")])
    return coded.mapInPandas(_voted_draws([*cell, "prompt_id"], sorted(set(sizes)), n_draws, seed), out)


def sc_gaps(keyed: DataFrame, sizes: Sequence[int], n_draws: int, k_max: int, cell: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """``prompt_gap`` of ``sc_votes`` by ``sc_n``: (cell..., prompt_id, sc_n, u_circ, u_bar, n_samples, r_hat), without a row per draw."""
    coded, fields = _coded_pools(keyed, sizes, n_draws, k_max, cell)
    out = T.StructType([*fields, *T.StructType.fromDDL("sc_n int, u_circ double, u_bar double, n_samples bigint, r_hat double")])
    return coded.mapInPandas(_gaps_of_draws([*cell, "prompt_id"], sorted(set(sizes)), n_draws, seed), out)


def _coded_pools(keyed: DataFrame, sizes: Sequence[int], n_draws: int, k_max: int, cell: Sequence[str]) -> tuple[DataFrame, list[T.StructField]]:
    """A row per prompt with the key numbers and utilities of its samples, and the fields that name it."""
    if min(sizes, default=0) < 1:
        raise ValueError(f"sizes must be >= 1, got {list(sizes)}")
    if n_draws < 1:
        raise ValueError(f"the number of draws must be >= 1, got {n_draws}")
    by_prompt = [*cell, "prompt_id"]
    pool = keyed.groupBy(*by_prompt).agg(F.array_sort(F.collect_list(F.struct("k", "vote_key", "u"))).alias("pool"))
    too_many = F.raise_error(F.lit(f"a prompt has more than {k_max} samples")).cast(pool.schema["pool"].dataType)
    checked = F.when(F.size("pool") > k_max, too_many).otherwise(F.col("pool"))
    key_numbers = let(F.transform(F.col("pool"), lambda x: x["vote_key"]), lambda names: F.transform(
        names, lambda name: F.when(name.isNotNull(), F.array_position(names, name)).otherwise(0)))
    coded = pool.withColumn("pool", checked).select(
        *by_prompt, F.col("prompt_id").cast("string").alias("__name"), key_numbers.alias("__codes"),
        F.transform("pool", lambda x: x["u"].cast("double")).alias("__us"))
    return coded, [pool.schema[c] for c in by_prompt]


def sc_vote(keyed: DataFrame, n: int, n_draws: int, k_max: int, cell: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """``sc_votes`` at one size."""
    return sc_votes(keyed, [n], n_draws, k_max, cell, seed).drop("sc_n")


def _values(frame: pd.DataFrame, sizes: Sequence[int], n_draws: int, seed: int) -> np.ndarray:
    """Utilities by (prompt, size, draw): the winner of every draw by counts over key numbers, the draws of several prompts at once."""
    longest, parts = max(sizes), []
    for low in range(0, len(frame), PROMPTS_AT_ONCE):
        some = frame.iloc[low : low + PROMPTS_AT_ONCE]
        hashes = b"".join([
            md5(f"{seed}|{name}|{d}|{h}".encode()).digest() for name in some["__name"] for d in range(n_draws) for h in range(-(-longest // 4))])
        size = some["__codes"].map(len).to_numpy()
        picks = np.frombuffer(hashes, ">u4").reshape(len(some), n_draws, -1)[:, :, :longest].astype(np.int64) % size[:, None, None]
        picks = (picks + (np.cumsum(size) - size)[:, None, None]).reshape(-1, longest)
        codes, us = np.concatenate([np.asarray(c, np.int64) for c in some["__codes"]]), np.concatenate([np.asarray(u, float) for u in some["__us"]])
        won = np.array(_winners(codes[picks], us[picks], sizes))
        parts.append(won.reshape(len(sizes), len(some), n_draws).transpose(1, 0, 2))
    return np.concatenate(parts)


def _voted_draws(by_prompt: Sequence[str], sizes: Sequence[int], n_draws: int, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (f for f in frames if len(f)):
            values = _values(frame, sizes, n_draws, seed)
            each = frame[list(by_prompt)].iloc[np.repeat(np.arange(len(frame)), len(sizes) * n_draws)].reset_index(drop=True)
            yield each.assign(
                k=np.tile(np.arange(n_draws, dtype=np.int32), len(frame) * len(sizes)),
                sc_n=np.tile(np.repeat(np.array(sizes, np.int32), n_draws), len(frame)), u=values.reshape(-1))

    return run


def _gaps_of_draws(by_prompt: Sequence[str], sizes: Sequence[int], n_draws: int, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (f for f in frames if len(f)):
            values = _values(frame, sizes, n_draws, seed).reshape(-1, n_draws)
            n = (~np.isnan(values)).sum(1)
            best = np.fmax.reduce(values, axis=1)
            mean = np.where(n > 0, np.nansum(values, axis=1) / np.maximum(n, 1), np.nan)
            each = frame[list(by_prompt)].iloc[np.repeat(np.arange(len(frame)), len(sizes))].reset_index(drop=True)
            yield each.assign(sc_n=np.tile(np.array(sizes, np.int32), len(frame)), u_circ=best, u_bar=mean, n_samples=n, r_hat=best - mean)

    return run


def _winners(drawn: np.ndarray, gains: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
    """Utility of the winning key of each row's first n draws; 0 is no key. Counts grow with the positions, so every size reads them on the way."""
    n_draws = len(drawn)
    rows = np.arange(n_draws)
    counts = np.zeros((n_draws, int(drawn.max(initial=0)) + 1), np.int64)
    first = np.full(counts.shape, drawn.shape[1], np.int64)
    out = []
    for at in range(max(sizes)):
        key = drawn[:, at]
        counts[rows, key] += 1
        first[rows, key] = np.minimum(first[rows, key], at)
        if at + 1 in sizes:
            rank = counts * (drawn.shape[1] + 1) - first
            rank[:, 0] = -1
            rank[counts == 0] = -1
            best = rank.argmax(1)
            some = rank[rows, best] >= 0
            out.append(np.where(some, gains[rows, np.where(some, first[rows, best], 0)], 0.0))
    return out


def m_convergence(
    per_prompt: DataFrame,
    cell: Sequence[str],
    m_grid: Sequence[int] = (50, 100, 200, 500, 1000),
    value: str = "r_hat",
    n_resamples: int = 1000,
    confidence: float = 0.95,
    seed: int = 0,
) -> DataFrame:
    """Interval half-width for random subsets of M' prompts, and its product with sqrt(M').

    A subset is the M' prompts with the smallest hash. The rank has a constant upper limit, which
    Spark applies in every map task before the shuffle; the full set needs no rank at all.
    """
    keys = list(cell)
    gaps = materialise(per_prompt.select(*keys, "prompt_id", value), "per-prompt")
    sizes = gaps.groupBy(*keys).agg(F.count("*").alias("m_full"))
    sized = join_cells(gaps, sizes, keys)
    tagged = sized.withColumn("m_sub", F.explode(F.array(*[F.lit(int(m)).cast("bigint") for m in m_grid]))).where(
        F.col("m_sub") < F.col("m_full")
    ).withColumn("order", hash32(F.lit(seed), "m_sub", "prompt_id"))
    ranked = tagged.withColumn(
        "rn", F.row_number().over(Window.partitionBy(*keys, "m_sub").orderBy("order", "prompt_id"))
    ).where(F.col("rn") <= max(m_grid)).where(F.col("rn") <= F.col("m_sub"))
    # The whole set is one more size, without a rank.
    columns = [*keys, "m_sub", "prompt_id", value]
    subsets = ranked.select(*columns).unionByName(sized.withColumnRenamed("m_full", "m_sub").select(*columns))
    ci = bootstrap_ci(subsets, [*keys, "m_sub"], value, n_resamples, confidence, seed)
    half = (F.col("ci_high") - F.col("ci_low")) / 2
    return ci.select(*keys, "m_sub", half.alias("half_width"), (half * F.sqrt(F.col("m_sub"))).alias("scaled_half_width"))


def outcome_chances(n_win: int, n_lose: int, n_votes: int, size: int) -> tuple[Fraction, Fraction]:
    """Chances that ``size`` votes drawn from n_win, n_lose and other votes make a win, and a loss.

    Without replacement up to the recorded number, with replacement beyond. An even split of wins
    and losses reaches both thresholds and is a win, so its chance is taken out of the losses.
    """
    needed = (size + 1) // 2
    if size <= n_votes:
        ways = lambda n: sum(comb(n, i) * comb(n_votes - n, size - i) for i in range(needed, size + 1))
        split, all_ways = comb(n_win, needed) * comb(n_lose, needed), comb(n_votes, size)
    else:
        ways = lambda n: sum(comb(size, i) * n**i * (n_votes - n) ** (size - i) for i in range(needed, size + 1))
        split, all_ways = comb(size, needed) * (n_win * n_lose) ** needed, n_votes**size
    return Fraction(ways(n_win), all_ways), Fraction(ways(n_lose) - (0 if size % 2 else split), all_ways)


def _limit(chance: Fraction) -> str:
    """Six hexadecimal digits, which compare like the number they are; a certain outcome is beyond all of them."""
    reach = round(chance * 2**24)
    return "g" if reach >= 2**24 else f"{reach:06x}"


def l_sensitivity(
    tallies: DataFrame,
    l_grid: Sequence[int] = (1, 3, 5, 7, 9),
    n_resamples: int = 200,
    cell: Sequence[str] = (),
    seed: int = 0,
    expected: str | None = None,
) -> DataFrame:
    """Gap and its spread when each sample's utility is voted from L' of its judge calls.

    ``tallies`` has one row per (cell..., prompt_id, k) with n_win, n_lose and n_votes; samples may have different numbers of votes.
    The majority depends on the tallies alone, so each (tally, L') gets the chances of its three outcomes once, and a trial is 24 bits of a hash of
    (seed, sample, resample) against them, five sizes per hash.

    A cell is complete if every prompt has the samples 0 to n - 1, each once and with votes; n is the prompt's own number, ``expected`` where that column
    is given, else its highest k + 1. Prompts may differ in n. A cell with a hole gets nulls.
    """
    if not l_grid or min(l_grid) < 1:
        raise ValueError(f"numbers of votes must be >= 1, got {list(l_grid)}")
    sizes = [int(n) for n in l_grid]
    kinds = tallies.where("n_votes > 0").select(*(F.col(c).cast("bigint").alias(c) for c in ("n_win", "n_lose", "n_votes"))).distinct()
    limits = [f"{kind}_{n}" for n in sizes for kind in ("win", "decided")]

    def with_limits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for tally in frame.itertuples(index=False):
                chances = [outcome_chances(*tally, n) for n in sizes]
                rows.append((*tally, *[_limit(c) for win, lose in chances for c in (win, win + lose)]))
            yield pd.DataFrame(rows, columns=[*frame.columns, *limits])

    kinds = kinds.mapInPandas(with_limits, T.StructType([*kinds.schema.fields, *[T.StructField(c, T.StringType()) for c in limits]]))
    voted = tallies.select(*cell, "prompt_id", "k", "n_win", "n_lose", "n_votes").join(kinds, ["n_win", "n_lose", "n_votes"], "left")
    trials = spread(voted, *cell, "prompt_id").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))))
    trials = trials.withColumns({
        f"md5_{i}": F.md5(F.concat_ws("|", F.lit(seed), F.lit(i), *[F.col(c).cast("string") for c in ("prompt_id", "k", "b")]))
        for i in range(-(-len(sizes) // 5))
    })
    drawn = {n: F.substring(f"md5_{place // 5}", 1 + 6 * (place % 5), 6) for place, n in enumerate(sizes)}
    scored = trials.select(*cell, "prompt_id", "b", *[
        F.when(draw < F.col(f"win_{n}"), 1.0).when(draw < F.col(f"decided_{n}"), 0.0).when(F.col(f"win_{n}").isNotNull(), 0.5).alias(f"u_{n}")
        for n, draw in drawn.items()
    ])
    per_prompt = scored.groupBy(*cell, "prompt_id", "b").agg(*[(F.max(f"u_{n}") - F.avg(f"u_{n}")).alias(f"u_{n}") for n in sizes])
    per_trial = per_prompt.groupBy(*cell, "b").agg(*[F.avg(f"u_{n}").alias(f"u_{n}") for n in sizes])
    own = F.max(expected) if expected else F.max("k") + 1
    whole = (F.count("*") == own) & (F.count_distinct("k") == own) & (F.min("k") == 0) & (F.max("k") == own - 1) & F.bool_and(F.col("n_votes") > 0)
    complete = tallies.groupBy(*cell, "prompt_id").agg(F.coalesce(whole, F.lit(False)).alias("whole")).groupBy(*cell).agg(F.bool_and("whole").alias("whole"))
    wide = per_trial.groupBy(*cell).agg(
        *[F.avg(f"u_{n}").alias(f"mean_{n}") for n in sizes],
        *[F.stddev_pop(f"u_{n}").alias(f"std_{n}") for n in sizes],
    )
    known = lambda name: F.when(F.col("whole"), F.col(name))
    points = F.array(*[
        F.struct(F.lit(n).alias("l_votes"), known(f"mean_{n}").alias("r_hat"), known(f"std_{n}").alias("r_hat_std")) for n in sizes
    ])
    return join_cells(wide, complete, cell).select(*cell, F.inline(points))
