"""Hard negatives by rotated one-bit codes: popcount estimates with a deterministic interval, integer scores for what the interval keeps.

A vector is rotated (seeded signs and Walsh-Hadamard transforms) and coded by the signs of its components and the alignment of the vector with
that sign vector; the residual is coded in the same way, ``n_codes`` times in all. The inner product with an anchor is then the sum of alignments times
popcount estimates, and what is left is at most the product of the norms of two residuals (Cauchy-Schwarz), so every row has an interval that its
score cannot leave. Rows whose interval cannot reach the wanted ranks are dropped, all others get the exact integer product: the result is exact.

Rows and anchors meet in blocks: an equi-join on (row block, anchor block), each of bounded size, so no task holds all of either and
no group depends on a key of the data. Only each block's best few per anchor go to the final ranks.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bestofk.llm.common import stored

#: Squared norms stay below this, so that every inner product fits a long.
MOST_NORM2 = 2.0**62


class Settings(NamedTuple):
    n_positives: int = 5
    n_negatives: int = 5
    #: A negative's score lies between low / 100 and high / 100 of the positive's.
    low: int = 80
    high: int = 100
    n_codes: int = 6
    query_bits: int = 8
    rows_per_block: int = 65_536
    anchors_per_block: int = 4_096
    seed: int = 0


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows turned by two rounds of seeded signs and an orthonormal Walsh-Hadamard transform; the width is a power of two."""
    n, d = x.shape
    signs = np.random.default_rng(seed).integers(0, 2, (2, d)) * 2.0 - 1.0
    x = x.astype(np.float64)
    for s in signs:
        x = x * s
        h = 1
        while h < d:
            x = x.reshape(n, d // (2 * h), 2, h)
            x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], 2).reshape(n, d)
            h *= 2
        x = x / math.sqrt(d)
    return x


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    n, d = bits.shape
    padded = np.zeros((n, -(-d // 64) * 64), np.uint8)
    padded[:, :d] = bits
    return np.packbits(padded, axis=1).view(np.uint64)


class Codes(NamedTuple):
    words: np.ndarray  # (codes, rows, words): signs
    alignment: np.ndarray  # (codes, rows): inner product of what is left of the row with the unit sign vector
    left: np.ndarray  # (rows): norm of the last residual
    norm: np.ndarray  # (rows)


def one_bit_codes(x: np.ndarray, n_codes: int, seed: int) -> Codes:
    r = rotate(x, seed)
    norm = np.sqrt((r * r).sum(1))
    unit = 1 / math.sqrt(r.shape[1])
    words, alignment = [], []
    for _ in range(n_codes):
        signs = r >= 0
        words.append(_pack(signs))
        alignment.append(np.abs(r).sum(1) * unit)
        r = r - np.where(signs, 1.0, -1.0) * (alignment[-1] * unit)[:, None]
    return Codes(np.array(words), np.array(alignment), np.sqrt((r * r).sum(1)), norm)


class Query(NamedTuple):
    """A rotated anchor rounded to a grid: bit planes of the whole numbers, the step, and the norm of the rounding error."""

    planes: np.ndarray
    offset: int
    step: float
    error: float
    norm: float
    width: int


def quantise(rotated: np.ndarray, bits: int) -> Query:
    most = float(np.abs(rotated).max(initial=0.0))
    offset = 1 << (bits - 1)
    step = most / (offset - 1) or 1.0
    whole = np.rint(rotated / step).astype(np.int64) + offset
    planes = np.stack([_pack(((whole >> b) & 1).astype(np.uint8)[None])[0] for b in range(bits)])
    gap = rotated - (whole - offset) * step
    return Query(planes, offset, step, float(np.sqrt(gap @ gap)), float(np.sqrt(rotated @ rotated)), len(rotated))


def interval(codes: Codes, rows: np.ndarray | slice, q: Query) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that a row can have with the anchor."""
    unit = 1 / math.sqrt(q.width)
    total = 0
    for plane_at, plane in enumerate(q.planes):  # sum of whole numbers over the positions whose sign is plus
        total = total + (np.bitwise_count(codes.words[:, rows] & plane).sum(2, dtype=np.int64) << plane_at)
    plus = np.bitwise_count(codes.words[:, rows]).sum(2, dtype=np.int64)
    all_whole = sum(int(np.bitwise_count(p).sum()) << i for i, p in enumerate(q.planes))
    # The sum over plus signs less the sum over minus signs, with the offset taken out of both.
    signed = 2 * total - all_whole - q.offset * (2 * plus - q.width)
    projection = signed * (q.step * unit)
    estimate = (codes.alignment[:, rows] * projection).sum(0)
    across = np.sqrt(np.maximum(0.0, q.norm**2 - np.maximum(0.0, np.abs(projection[-1]) - q.error) ** 2))
    reach = across * codes.left[rows] + q.error * (codes.norm[rows] + codes.left[rows])
    reach = reach * (1 + 1e-9) + 1e-9 * q.norm * codes.norm[rows] + 1e-6
    return estimate - reach, estimate + reach


def _nth(values: np.ndarray, n: int) -> float:
    """The n-th greatest value, or minus infinity."""
    return float(np.partition(values, len(values) - n)[len(values) - n]) if len(values) >= n else -math.inf


class _Block(NamedTuple):
    ids: np.ndarray  # null ids as the greatest number
    null_id: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    codes: Codes

    def exact(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.vectors[rows].astype(np.int64) @ anchor.astype(np.int64)

    def best(self, rows: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[rows], -scores))[:n]
        return rows[order], scores[order]


def _vectors(table: pa.Table) -> np.ndarray:
    packed = table.column("vector").to_pylist()
    return np.frombuffer(b"".join(packed), "<i4").reshape(len(packed), -1)


def _block(table: pa.Table, s: Settings) -> _Block:
    order = np.argsort(np.asarray(table.column("label")), kind="stable")
    table = table.take(order)
    ids = table.column("vec_id")
    vectors = _vectors(table)
    return _Block(
        np.asarray(ids.fill_null(np.iinfo(np.int64).max)), np.asarray(ids.is_null()), np.asarray(table.column("label")), vectors,
        one_bit_codes(vectors, s.n_codes, s.seed),
    )


POSITIVE = "anchor bigint, anchor_id bigint, label bigint, positive_id bigint, positive_score bigint"
NEGATIVE = "anchor bigint, anchor_id bigint, positive_id bigint, positive_score bigint, place int, negative_id bigint, negative_score bigint"


def _collect(columns: list[str], rows: list[tuple]) -> pa.Table:
    kinds = {"place": pa.int32()}
    values = list(zip(*rows)) or [[] for _ in columns]
    return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in zip(columns, values)})


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(",")]


def _positives(s: Settings):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _collect(_names(POSITIVE), [])
        block, out = _block(rows, s), []
        turned = rotate(wanted := _vectors(anchors), s.seed)
        for i, (anchor, anchor_id, label) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("anchor", "vec_id", "label")))):
            start, end = np.searchsorted(block.labels, label), np.searchsorted(block.labels, label, "right")
            low, high = interval(block.codes, slice(start, end), quantise(turned[i], s.query_bits))
            other = block.ids[start:end] != anchor_id
            reach = _nth(low[other], s.n_positives)
            kept = start + np.flatnonzero(other & (high >= reach))
            for j, score in zip(*block.best(kept, block.exact(kept, wanted[i]), s.n_positives)):
                out.append((anchor, anchor_id, label, None if block.null_id[j] else int(block.ids[j]), int(score)))
        return _collect(_names(POSITIVE), out)

    return run


def _negatives(s: Settings):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _collect(_names(NEGATIVE), [])
        block, out = _block(rows, s), []
        turned = rotate(wanted := _vectors(anchors), s.seed)
        names = ("anchor", "vec_id", "label", "positives")
        for i, (anchor, anchor_id, label, positives) in enumerate(zip(*(anchors.column(c).to_pylist() for c in names))):
            different = block.labels != label
            low, high = interval(block.codes, slice(None), quantise(turned[i], s.query_bits))
            ranges = []
            for p in positives:
                least, most = -(-s.low * p["positive_score"] // 100), s.high * p["positive_score"] // 100
                sure = low[different & (low >= least) & (high <= most)]
                ranges.append((p, least, most, max(least, _nth(sure, s.n_negatives))))
            kept = np.zeros(len(different), bool)
            for _, _, most, reach in ranges:
                kept |= different & (high >= reach) & (low <= most)
            kept = np.flatnonzero(kept)
            scores = block.exact(kept, wanted[i])
            for p, least, most, _ in ranges:
                fits = (scores >= least) & (scores <= most)
                for j, score in zip(*block.best(kept[fits], scores[fits], s.n_negatives)):
                    found = None if block.null_id[j] else int(block.ids[j])
                    out.append((anchor, anchor_id, p["positive_id"], p["positive_score"], p["place"], found, int(score)))
        return _collect(_names(NEGATIVE), out)

    return run


def _pack_rows(df: DataFrame, width: int) -> DataFrame:
    """Whole numbers as little-endian 32-bit integers, padded with zeros to ``width``."""
    schema = "vec_id bigint, label bigint, is_anchor boolean, place bigint, vector binary"

    def run(batches):
        for batch in batches:
            whole = batch.column("whole")
            lengths = np.asarray(pc.list_value_length(whole))
            flat = np.zeros((batch.num_rows, width), "<i4")
            flat[np.arange(width) < lengths[:, None]] = np.asarray(whole.flatten())
            packed = pa.array([row.tobytes() for row in flat], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "is_anchor", "place")), packed],
                                             ["vec_id", "label", "is_anchor", "place", "vector"])

    return df.mapInArrow(run, schema)


def hard_negatives(
    df: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
    settings: Settings = Settings(),
) -> DataFrame:
    """Per anchor and positive the best rows of other labels in the score range: anchor_id, positive_id, rank, negative_id, both scores.

    Components count as floor(scale * x). Rows with a null label or vector, or a null or non-finite component, take no part, nor do rows
    whose squared integer norm reaches 2 ** 62 (their scores would not fit a long). Vectors of different lengths are compared as if padded with zeros. An anchor's
    positives are its first ``n_positives`` rows of the same label with another id. Every row of the table counts, also repeated ones and those with a null id
    (last among ties); anchors that repeat in id, label and vector count once. No anchors or no rows give an empty table.
    """
    s = settings
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    sound = F.col(vector).isNotNull() & F.col(label).isNotNull() & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    norm2 = F.aggregate(F.transform(F.col(vector), lambda x: F.pow(F.floor(x.cast("double") * scale).cast("double"), 2)), F.lit(0.0), lambda a, x: a + x)
    rows = df.where(sound).where(norm2 < MOST_NORM2).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), F.monotonically_increasing_id().alias("place"),
        F.transform(whole, lambda x: x.cast("int")).alias("whole"),
    )
    widest = rows.agg(F.max(F.size("whole")).alias("w")).first()["w"] or 1
    rows = stored(_pack_rows(rows, 1 << (widest - 1).bit_length()), "vectors")
    anchors = rows.where("is_anchor").groupBy("vec_id", "label", "vector").agg(F.min("place").alias("anchor"))
    counted = rows.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("a")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    n_rows = max(-(-counted["n"] // s.rows_per_block), min(cores, -(-counted["n"] // 1024)), 1)
    n_anchors = max(1, -(-counted["a"] // s.anchors_per_block))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = rows.select("vec_id", "label", "vector", F.pmod(F.xxhash64("place"), F.lit(n_rows)).cast("int").alias("r"), each(n_anchors).alias("a"))

    def meet(some: DataFrame, run, schema: str) -> DataFrame:
        asked = some.withColumns({"a": F.pmod(F.xxhash64("anchor"), F.lit(n_anchors)).cast("int"), "r": each(n_rows)})
        asked = asked.toDF(*asked.columns)  # columns of its own: both sides come from one table
        return blocks.groupBy("r", "a").cogroup(asked.groupBy("r", "a")).applyInArrow(run, schema)

    first = lambda keys, n, score, other: F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.desc(score), F.asc_nulls_last(other))).alias(n)
    positives = meet(anchors, _positives(s), POSITIVE)
    positives = positives.select("*", first(["anchor"], "place", "positive_score", "positive_id")).where(F.col("place") <= s.n_positives)
    by_anchor = positives.groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    negatives = meet(anchors.join(by_anchor, "anchor"), _negatives(s), NEGATIVE)
    ranked = negatives.select("*", first(["anchor", "place"], "rank", "negative_score", "negative_id")).where(F.col("rank") <= s.n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
