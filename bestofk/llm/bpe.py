"""Byte-level BPE over a rank file: encoding in length-bucketed padded matrices, and decoding.

A text is split by the pattern, and every piece is merged on its own. Pieces of similar length are the rows of one padded matrix of ids;
each round looks up the ranks of all changed pairs in a hash table, merges the leftmost pair of minimum rank of every row and closes the
gap, and rows without a mergeable pair leave the matrix. Rows are independent, so the step is narrow: no shuffle, any number of executors.

Null texts count as empty: no ids, no bytes. Repeated rows are encoded each on its own, other columns are passed through. Pieces beyond the
widest bucket (runs without a break) go by a heap over the same pairs, so that a long piece costs n log n.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_PAIR = np.int32(2**31 - 1)
#: Widths of the matrices in bytes; longer pieces go by the heap.
BUCKETS = (4, 6, 8, 12, 16, 24, 32, 64, 128)
#: Cells of one matrix, pieces of one stretch of text, pieces a worker remembers: bounds of a task's memory.
MATRIX_CELLS, STRETCH, REMEMBERED = 1 << 20, 1 << 18, 1 << 19


class PairTable:
    """Open-addressing hash table from (left id, right id) to the rank of their concatenation, read by whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(rank) + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_PAIR, np.int32)
        key = left.astype(np.int64) << 32 | right
        slot, waiting = self._home(key), np.arange(len(key))
        while len(waiting):
            free = self.keys[slot[waiting]] == -1
            first = waiting[free]
            self.keys[slot[first]] = key[first]  # of several pairs on one slot the last written stays
            placed = self.keys[slot[waiting]] == key[waiting]
            self.ranks[slot[waiting[placed]]] = rank[waiting[placed]]
            waiting = waiting[~placed]
            slot[waiting] = (slot[waiting] + 1) & (len(self.keys) - 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        slot = self._home(key)
        found = np.full(len(key), NO_PAIR, np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            at = self.keys[slot[open_]]
            hit = at == key[open_]
            found[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (at != -1)]
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
        return found


class Vocabulary(NamedTuple):
    rank_of: dict[bytes, int]
    token: dict[int, bytes]
    byte_ids: np.ndarray
    pairs: PairTable


@lru_cache(maxsize=4)
def vocabulary(content: bytes) -> Vocabulary:
    """From the content of a rank file: a base64 token and its rank per line. All 256 single bytes must be there."""
    rank_of = {base64.b64decode(t): int(r) for t, r in (line.split() for line in content.splitlines() if line)}
    missing = [b for b in range(256) if bytes([b]) not in rank_of]
    if missing:
        raise ValueError(f"the rank file lacks {len(missing)} single bytes")
    splits = [
        (a, b, r) for t, r in rank_of.items() for i in range(1, len(t))
        if (a := rank_of.get(t[:i])) is not None and (b := rank_of.get(t[i:])) is not None
    ]
    left, right, rank = np.array(splits, np.int64).reshape(-1, 3).T
    byte_ids = np.array([rank_of[bytes([b])] for b in range(256)], np.int32)
    return Vocabulary(rank_of, {r: t for t, r in rank_of.items()}, byte_ids, PairTable(left, right, rank.astype(np.int32)))


def _merge_matrix(ids: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> list[np.ndarray]:
    """Final ids of each row of a padded matrix."""
    n, width = ids.shape
    done: list = [None] * n
    row = np.arange(n)
    ranks = np.full((n, width), NO_PAIR, np.int32)  # ranks[:, j] belongs to the pair (j, j + 1)
    inside = np.arange(width - 1) < (lengths - 1)[:, None]
    ranks[:, :-1][inside] = pairs(ids[:, :-1][inside], ids[:, 1:][inside])
    columns = np.arange(width)
    while len(row):
        at = ranks.argmin(1)  # argmin takes the leftmost of equal ranks
        best = ranks[np.arange(len(row)), at]
        over = best == NO_PAIR
        for i in np.flatnonzero(over):
            done[row[i]] = ids[i, : lengths[i]].copy()
        row, ids, ranks, lengths, at, best = (x[~over] for x in (row, ids, ranks, lengths, at, best))
        if not len(row):
            break
        here = np.arange(len(row))
        source = np.minimum(columns + (columns > at[:, None]), width - 1)
        ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
        ranks[:, -1] = NO_PAIR
        ids[here, at] = best
        lengths = lengths - 1
        left, right = at > 0, at < lengths - 1
        ranks[here[left], at[left] - 1] = pairs(ids[here[left], at[left] - 1], best[left])
        ranks[here, at] = NO_PAIR
        ranks[here[right], at[right]] = pairs(best[right], ids[here[right], at[right] + 1])
        widest = int(lengths.max())
        if widest <= width // 2:
            width = max(2, widest)
            ids, ranks, columns = ids[:, :width], ranks[:, :width], np.arange(width)
    return done


def _merge_long(ids: list[int], v: Vocabulary) -> np.ndarray:
    """The same merges of one long piece by a heap of (rank, place) over a linked list."""
    n, token, rank_of = len(ids), v.token, v.rank_of
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    pair = lambda i: rank_of.get(token[ids[i]] + token[ids[after[i]]]) if after[i] < n else None
    ranks = [pair(i) for i in range(n)]
    heap = [(r, i) for i, r in enumerate(ranks) if r is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if ranks[i] != r:
            continue
        gone = after[i]
        ids[i], after[i], ranks[gone] = r, after[gone], None
        if after[i] < n:
            before[after[i]] = i
        ids[gone] = -1
        for j in (before[i], i):
            if j >= 0:
                ranks[j] = pair(j)
                if ranks[j] is not None:
                    heapq.heappush(heap, (ranks[j], j))
    return np.array([t for t in ids if t >= 0], np.int32)


def merge_pieces(pieces: list[bytes], v: Vocabulary) -> list[np.ndarray]:
    """Ids of each piece. A piece that is a token is that token, as in the public library."""
    out: list = [None] * len(pieces)
    waiting: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        rank = v.rank_of.get(piece)
        if rank is not None:
            out[i] = np.array([rank], np.int32)
        else:
            width = next((w for w in BUCKETS if len(piece) <= w), 0)
            waiting.setdefault(width, []).append(i)
    for i in waiting.pop(0, []):
        out[i] = _merge_long(v.byte_ids[np.frombuffer(pieces[i], np.uint8)].tolist(), v)
    for width, members in waiting.items():
        step = max(1, MATRIX_CELLS // width)
        for some in (members[i : i + step] for i in range(0, len(members), step)):
            lengths = np.array([len(pieces[i]) for i in some])
            flat = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in some), np.uint8).reshape(-1, width)
            for i, ids in zip(some, _merge_matrix(v.byte_ids[flat], lengths, v.pairs)):
                out[i] = ids
    return out


class Encoder:
    """Encodes texts; remembers the packed ids of a bounded number of pieces, forgetting all when the bound is reached."""

    def __init__(self, content: bytes, pattern: str) -> None:
        self.vocabulary = vocabulary(content)
        self.split = regex.compile(pattern)
        self.packed: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        new = list(pieces)
        merged = merge_pieces([p.encode("utf-8") for p in new], self.vocabulary)
        learned = dict(zip(new, (m.astype("<u4").tobytes() for m in merged)))
        if len(self.packed) + len(new) > REMEMBERED or self.held > 32 * REMEMBERED:
            self.packed.clear()
            self.held = 0
        self.packed.update(learned)
        self.held += sum(map(len, merged))
        return learned

    def _join(self, groups: list[list[str]]) -> list[bytes]:
        """Packed ids per list of pieces; the pieces not remembered are merged together."""
        found = [list(map(self.packed.get, pieces)) for pieces in groups]
        gaps = [(got, pieces) for got, pieces in zip(found, groups) if None in got]
        if gaps:
            learned = self._learn({p for got, pieces in gaps for g, p in zip(got, pieces) if g is None})
            for got, pieces in gaps:
                got[:] = [learned[p] if g is None else g for g, p in zip(got, pieces)]
        return [b"".join(got) for got in found]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids per text. New pieces of many short texts are merged together, a long text goes in stretches of pieces."""
        out: list[bytes] = []
        waiting: list[list[str]] = []
        held = 0
        for text in texts:
            text = text or ""
            if len(text) > STRETCH:
                out += self._join(waiting)
                waiting, held = [], 0
                matches = (m.group() for m in self.split.finditer(text))
                parts = []
                while pieces := list(islice(matches, STRETCH)):
                    parts += self._join([pieces])
                out.append(b"".join(parts))
            else:
                waiting.append(self.split.findall(text))
                held += len(waiting[-1])
                if held >= STRETCH:
                    out += self._join(waiting)
                    waiting, held = [], 0
        return out + self._join(waiting)


def _slices(batch: pa.RecordBatch, column: str, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose ``column`` holds few bytes, one row at least."""
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``: the ids of ``text`` as little-endian unsigned 32-bit integers in one binary value.

    ``ranks`` is the path of a rank file that the driver reads; its content (about 1 MB, a fixed vocabulary) goes to the tasks.
    A column of ``df`` that is called like ``out`` is replaced. Fails where a single byte has no rank.
    """
    with open(ranks, "rb") as file:
        content = df.sparkSession.sparkContext.broadcast(file.read())
    rows = df.drop(out) if out in df.columns else df
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(content.value, pattern)
        for batch in batches:
            for part in _slices(batch, text):
                packed = pa.array(encoder.encode(part.column(text).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, packed], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the bytes that packed ids stand for; null ids give none. An id without a token fails."""
    with open(ranks, "rb") as file:
        content = df.sparkSession.sparkContext.broadcast(file.read())
    rows = df.drop(out) if out in df.columns else df
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary(content.value).token.__getitem__
        for batch in batches:
            for part in _slices(batch, ids):
                decoded = [b"".join(map(token, np.frombuffer(v or b"", "<u4").tolist())) for v in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of decoded bytes per row of ``docs``."""
    rows = docs.select("doc_id", "text")
    encoded = encode(rows, ranks, pattern).drop("text")
    return decode(encoded, ranks).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
