"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

Texts and items are compared as sequences of normalised words (letters and digits, lower case). A passage matches an item if
its edit distance in words is at most ``max_share`` of the item's length.

Windows as long as the item are taken wherever an intact piece of it stands: cut into one piece more than edits are allowed, at least one
piece of an item survives them, so no match lies elsewhere. Each window is embedded by the CGK random walk, which turns few edits into a
small Hamming distance; tables of sampled coordinates decide which windows are candidates for their item. The number of tables is set on
edited copies of the items so that the target recall is reached. Candidates are verified exactly.

Items are a query set against all rows: they go to the tasks in blocks of ``BLOCK_ITEMS``, so what is broadcast has a fixed bound. Documents are read
once per block in narrow steps without a shuffle.

Defined cases: null and empty texts match nothing; null or wordless items and items without an id are skipped; repeated items report
each of their ids, repeated documents report each row. Extra columns are ignored, or kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ITEMS = 400
WORD = re.compile(r"\w+")
FOUND = "item_id bigint, first_word bigint, n_words bigint, distance int"


def normalise(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower().replace("_", " "))


def _bits(step: int, symbols: np.ndarray) -> np.ndarray:
    """A random bit per (step, symbol, table), the table being the last axis: 32-bit multiply-and-shift mixing."""
    tables = np.arange(symbols.shape[-1], dtype=np.uint64) * np.uint64(9176263) + np.uint64(step * 40503 + 12345)
    x = (symbols * np.uint64(2654435761) + tables) & np.uint64(0xFFFFFFFF)
    x = ((x ^ (x >> np.uint64(15))) * np.uint64(2246822519)) & np.uint64(0xFFFFFFFF)
    return (x >> np.uint64(20)) & np.uint64(1)


def cgk(rows: np.ndarray, tables: int, pad: int) -> np.ndarray:
    """``tables`` independent walks over each row of ``rows`` (n x w): n x tables x 3w symbols.

    In every step a walk writes the symbol it stands on, and a random bit of (step, symbol) says whether it goes on.
    """
    n, w = rows.shape
    padded = np.concatenate([rows, np.full((n, 1), pad)], axis=1).astype(np.uint64)
    at, each = np.zeros((n, tables), np.intp), np.arange(n)[:, None]
    out = np.empty((n, tables, 3 * w), np.uint64)
    for step in range(3 * w):
        out[:, :, step] = here = padded[each, at]
        at = np.minimum(at + _bits(step, here).astype(np.intp), w)
    return out


def sampled_keys(rows: np.ndarray, tables: int, samples: int, pad: int) -> np.ndarray:
    """n x tables LSH keys; each table has its own walk and its own sampled coordinates of the embedding."""
    walks = cgk(rows, tables, pad)
    keys = np.zeros((len(rows), tables), np.uint64)
    for row in np.random.default_rng(7).random((samples, 1024))[:, :tables]:
        where = (row * walks.shape[2]).astype(np.intp)
        keys = keys * np.uint64(1_000_003) + walks[:, np.arange(tables), where] + np.uint64(1)
    return keys


def edit_distances(item: np.ndarray, region: np.ndarray, anchored: bool) -> np.ndarray:
    """Distance of ``item`` to the best passage of ``region`` that ends at each place (anchored: that starts at its beginning)."""
    places = np.arange(len(region) + 1)
    row = places.copy() if anchored else np.zeros(len(region) + 1, np.int64)
    for i, word in enumerate(item, 1):
        step = np.empty_like(row)
        step[0] = i
        step[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != word))
        row = np.minimum.accumulate(step - places) + places
    return row


def best_passage(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the closest passage, the first of equals, the shortest from its end."""
    ends = edit_distances(item, region, False)
    end = int(ends.argmin())
    back = edit_distances(item[::-1], region[:end][::-1], True)
    length = int(back.argmin())
    return int(ends[end]), end - length, end


@dataclass
class Items:
    """One block of benchmark items, ready for the tasks."""

    ids: list[int]
    words: list[np.ndarray]
    edits: list[int]
    vocabulary: dict[str, int]
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: sorted codes, item, offset
    keys: list[np.ndarray]
    tables: int
    samples: int

    @property
    def pad(self) -> int:
        return len(self.vocabulary) + 1


def _code(ids: np.ndarray, length: int, base: int) -> np.ndarray:
    """One number per run of ``length`` words, exact while base ** length fits in 63 bits; longer runs are looked up by their beginning."""
    n = len(ids) - length + 1
    code = np.zeros(max(0, n), np.int64)
    for j in range(length):
        code = code * base + ids[j : j + n] if n > 0 else code
    return code


def prepare(rows: list[tuple[int, str]], *, max_share: float = 0.2, target_recall: float = 0.99, samples: int = 3, most_tables: int = 96) -> Items | None:
    """Items of one block: words, allowed edits, pieces, and as many LSH tables as the target recall takes."""
    texts = [(i, normalise(t)) for i, t in rows if i is not None]
    texts = [(i, w) for i, w in texts if w]
    if not texts:
        return None
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in texts for w in ws}), 1)}
    base = len(vocabulary) + 2
    longest = max(1, int(62 / np.log2(base)))
    words = [np.array([vocabulary[w] for w in ws], np.int64) for _, ws in texts]
    edits = [int(max_share * len(w)) for w in words]
    found: dict[int, list[tuple[int, int, int]]] = {}
    for k, w in enumerate(words):
        whole = len(w) // (edits[k] + 1)
        length = min(whole, longest)
        for piece in range(edits[k] + 1):
            at = piece * whole
            found.setdefault(length, []).append((int(_code(w[at : at + length], length, base)[0]), k, at))
    pieces = {n: tuple(np.array(c, np.int64) for c in zip(*sorted(v))) for n, v in found.items()}
    items = Items([i for i, _ in texts], words, edits, vocabulary, pieces, [], 0, samples)
    # Edited copies with as many edits as allowed: which tables find them, and how many are enough.
    rng = np.random.default_rng(5)
    hits = []
    for k in rng.permutation(len(words))[:60]:
        w, e = words[k], edits[k]
        copy = list(w)
        for _ in range(e):
            at, kind = int(rng.integers(0, max(1, len(copy)))), int(rng.integers(0, 3))
            if kind == 0 and len(copy) > 1:
                del copy[at]
            elif kind == 1:
                copy.insert(at, 0)
            else:
                copy[at] = 0
        window = np.array((copy + [0] * len(w))[: len(w)], np.int64)
        hits.append((sampled_keys(window[None], most_tables, samples, items.pad) == sampled_keys(w[None], most_tables, samples, items.pad))[0])
    first = np.where(np.any(hits, axis=1), np.argmax(hits, axis=1) + 1, most_tables)
    items.tables = int(min(most_tables, max(8, np.quantile(first, target_recall))))
    items.keys = [sampled_keys(w[None], items.tables, samples, items.pad)[0] for w in words]
    return items


def _windows(ids: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(item, start) of windows whose text has an intact piece of the item where it must be; starts may lie before the text."""
    owners, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for length, (codes, item, offset) in items.pieces.items():
        if len(ids) < length:
            continue
        known = np.flatnonzero((ids[: len(ids) - length + 1] > 0) & (ids[length - 1 :] > 0))
        code = np.zeros(len(ids), np.int64)
        code[known] = _code(ids, length, len(items.vocabulary) + 2)[known]
        lo = np.searchsorted(codes, code[known], "left")
        hit = (lo < len(codes)) & (codes[np.minimum(lo, len(codes) - 1)] == code[known])
        known, lo = known[hit], lo[hit]
        n = np.searchsorted(codes, code[known], "right") - lo
        which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owners.append(item[which])
        starts.append(np.repeat(known, n) - offset[which])
    return np.concatenate(owners), np.concatenate(starts)


def find_in_text(text: str | None, items: Items) -> list[tuple[int, int, int, int]]:
    """(item number, first word, words, distance) of the closest passage for each item that the text holds."""
    words = normalise(text)
    ids = np.fromiter(map(items.vocabulary.get, words, repeat(0)), np.int64, len(words))
    if not ids.any():
        return []
    owner, start = _windows(ids, items)
    best: dict[int, tuple[int, int, int]] = {}
    for k in np.unique(owner):
        w, e = len(items.words[k]), items.edits[k]
        begins = np.unique(start[owner == k])
        cells = begins[:, None] + np.arange(w)
        rows = np.where((cells >= 0) & (cells < len(ids)), ids[np.clip(cells, 0, len(ids) - 1)], 0)
        near = np.concatenate([
            (sampled_keys(rows[i : i + 1024], items.tables, items.samples, items.pad) == items.keys[k]).any(axis=1) for i in range(0, len(rows), 1024)
        ])
        for s in begins[near]:
            low, high = max(0, int(s) - e), min(len(ids), int(s) + w + e)
            distance, a, b = best_passage(items.words[k], ids[low:high])
            if distance <= e:
                best[int(k)] = min(best.get(int(k), (distance, low + a, b - a)), (distance, low + a, b - a))
    return [(k, a, n, d) for k, (d, a, n) in sorted(best.items())]


def blocks(benchmark: DataFrame, **options) -> Iterator[Items]:
    """The items in blocks of BLOCK_ITEMS: one block at a time is on the driver and in the tasks."""
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    after, full = None, True
    while full:
        rest = rows if after is None else rows.where((F.col("item_id") > after[0]) | ((F.col("item_id") == after[0]) & (F.col("text") > after[1])))
        part = [tuple(r) for r in rest.orderBy("item_id", "text").limit(BLOCK_ITEMS).collect()]
        full = len(part) == BLOCK_ITEMS
        after = part[-1] if part else None
        items = prepare(part, **options)
        if items:
            yield items


def matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, first_word, n_words, distance: the closest passage per document and item."""
    rows = docs.select("doc_id", "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FOUND}"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in blocks(benchmark, **options):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(i, *m) for i, text in enumerate(batch.column("text")) for m in find_in_text(text.as_py(), items)]
                at = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), pa.array([items.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()),
                     pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int32())],
                    ["doc_id", "item_id", "first_word", "n_words", "distance"],
                )

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns unchanged; a narrow filter per block of items."""
    at = docs.columns.index("text")
    for items in blocks(benchmark, **options):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not find_in_text(t.as_py(), items) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
