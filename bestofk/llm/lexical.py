"""Ranked lexical search by NRA over document shards.

Two narrow passes read every whole text: the first counts documents, terms and document frequencies, the second keeps a bounded number of
documents at a time as a shard with one impact-sorted list per term and runs NRA for every item: the lists are read in step from the front, each document
has a lower bound (what was read) and an upper bound (what the lists not yet met can still give), documents whose upper bound falls
below the k-th lower bound leave, and reading ends when the rest have equal bounds, so that membership, ties and scores are final. The best of
the shards are ranked per item; the best k of all documents are among them. Only these rows are shuffled.

Items come in blocks of bounded size (``items_per_block``, with their terms sent to the tasks); each block is one pass of either kind.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Term bytes stay (A-Z lower-cased), all others separate.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split at once, and documents and postings of a shard: bounds of a task's memory.
STRETCH, SHARD_DOCS, SHARD_POSTINGS = 4 << 20, 1 << 16, 1 << 22
FIRST_READ = 64
LAST = np.iinfo(np.int64).max


class Items(NamedTuple):
    """A block of items: their ids, and distinct term numbers with repeats for each."""

    ids: list
    place: dict[bytes, int]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, a stretch at a time."""
    data = (text or "").encode("utf-8").translate(BYTES)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + STRETCH)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def read_items(rows: list[tuple]) -> Items:
    place: dict[bytes, int] = {}
    terms, repeats = [], []
    for _, text in rows:
        counted = Counter(t for some in terms_of(text) for t in some)
        terms.append(np.array([place.setdefault(t, len(place)) for t in counted], np.int64))
        repeats.append(np.array(list(counted.values()), np.int64))
    return Items([item_id for item_id, _ in rows], place, terms, repeats)


def count_terms(text: str | None, place: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of terms of a text, and the item terms in it with how often each occurs."""
    n, found = 0, []
    for words in terms_of(text):
        n += len(words)
        ids = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
        found.append(ids[ids >= 0])
    if not found:
        return 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    terms, times = np.unique(np.concatenate(found), return_counts=True)
    return n, terms, times


class Lists(NamedTuple):
    """Postings of a shard, each term's by falling impact."""

    docs: np.ndarray
    impacts: np.ndarray
    starts: np.ndarray  # by term, one more at the end


def build_lists(docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int) -> Lists:
    order = np.lexsort((docs, -impacts, terms))
    return Lists(docs[order], impacts[order], np.searchsorted(terms[order], np.arange(n_terms + 1)))


def nra(lists: Lists, terms: np.ndarray, repeats: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the shard and scores of the best k with a score above 0, by score and id."""
    starts, ends = lists.starts[terms], lists.starts[terms + 1]
    here = ends > starts
    starts, ends, repeats = starts[here], ends[here], repeats[here]
    lower, possible = np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
    met = np.zeros(len(ids), bool)
    read, step = starts.copy(), FIRST_READ
    reads: list[list[np.ndarray]] = [[] for _ in starts]
    closed = False  # no document that was not met yet can enter
    while True:
        for i in np.flatnonzero(read < ends):
            at = slice(read[i], min(read[i] + step, ends[i]))
            docs, gains = lists.docs[at], lists.impacts[at] * repeats[i]
            if closed:
                wanted = possible[docs]
                docs, gains = docs[wanted], gains[wanted]
            lower[docs] += gains  # a document is in a list once
            met[docs] = True
            reads[i].append(docs)
            read[i] = at.stop
        step *= 2
        # What the next posting of each list can give at most; nothing where the list has ended.
        frontier = np.where(read < ends, lists.impacts[np.minimum(read, len(lists.impacts) - 1)] * repeats, 0) if len(starts) else np.zeros(0, np.int64)
        rest = int(frontier.sum())
        alive = np.flatnonzero(met & possible)
        upper = np.full(len(ids), rest, np.int64)
        for i in np.flatnonzero(frontier):
            for docs in reads[i]:
                upper[docs] -= frontier[i]
        upper += lower
        reach = np.partition(lower[alive], len(alive) - k)[len(alive) - k] if len(alive) >= k else 0
        possible[alive[upper[alive] < reach]] = False
        closed = closed or rest < reach or rest == 0
        alive = alive[possible[alive]]
        if closed and (upper[alive] == lower[alive]).all():
            break
    alive = alive[lower[alive] > 0]
    best = alive[np.lexsort((ids[alive], -lower[alive]))[:k]]
    return best, lower[best]


class _Shard:
    """Documents gathered until the shard is full."""

    def __init__(self) -> None:
        self.ids: list = []
        self.sizes: list[int] = []
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.postings = 0

    def add(self, doc_id, n: int, terms: np.ndarray, times: np.ndarray) -> bool:
        self.ids.append(doc_id)
        self.sizes.append(n)
        self.found.append((terms, times))
        self.postings += len(terms)
        return len(self.ids) >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def best(self, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> pa.RecordBatch:
        docs = np.repeat(np.arange(len(self.ids)), [len(t) for t, _ in self.found])
        terms = np.concatenate([t for t, _ in self.found])
        times = np.concatenate([c for _, c in self.found])
        m = 75 + 25 * np.array(self.sizes, np.int64) * n_docs // n_terms
        impacts = weights[terms] * (1_000_000_000 * times // (1000 * times + 12 * m[docs]))
        lists = build_lists(docs, terms, impacts, len(weights))
        ids = np.array([LAST if i is None else i for i in self.ids], np.int64)
        out: tuple[list, list, list] = ([], [], [])
        for item in range(len(items.ids)):
            found, scores = nra(lists, items.terms[item], items.repeats[item], ids, k)
            out[0].extend([item] * len(found))
            out[1].extend(self.ids[d] for d in found)
            out[2].extend(scores.tolist())
        kinds = (pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out, kinds)], ["item", "doc_id", "score"])


def _statistics(rows: DataFrame, shared) -> dict[int, int]:
    """Documents with each item term; under -1 the documents with any term, under -2 all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.place
        df, n_docs, n_terms = np.zeros(len(place), np.int64), 0, 0
        for batch in batches:
            for text in batch.column("text"):
                n, terms, _ = count_terms(text.as_py(), place)
                df[terms] += 1
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
        some = np.flatnonzero(df)
        keys, values = np.concatenate([some, [-1, -2]]), np.concatenate([df[some], [n_docs, n_terms]])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.int64())], ["term", "n"])

    counts = rows.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counts.collect()}


def _ranked(rows: DataFrame, items: Items, k: int) -> DataFrame | None:
    """Best k rows per item of a block."""
    shared = rows.sparkSession.sparkContext.broadcast(items)
    counted = _statistics(rows, shared)
    n_docs, n_terms = counted.get(-1, 0), counted.get(-2, 0)
    if not n_terms:
        return None
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counted.get(t, 0) + 1))) for t in range(len(items.place))], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, shard = shared.value, _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                n, terms, times = count_terms(text.as_py(), block.place)
                if len(terms) and shard.add(doc_id.as_py(), n, terms, times):
                    yield shard.best(block, weights, n_docs, n_terms, k)
                    shard = _Shard()
        if shard.ids:
            yield shard.best(block, weights, n_docs, n_terms, k)

    found = rows.mapInArrow(run, "item int, doc_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    names = rows.sparkSession.createDataFrame([(i, v) for i, v in enumerate(items.ids)], "item int, item_id bigint")
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, items_per_block: int = 10_000) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest score above 0 for each row of ``items``, fewer where there are fewer.

    Ids are longs. Equal scores go by ascending doc_id, null ids last. Rows count each on its own: a repeated document is ranked as often as it
    stands there, a repeated item (or null item_id) has its own ranks. Null and empty texts have no term: such documents are never
    found, such items find nothing. Empty tables give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    asked = ((r[0], r[1]) for r in items.select(F.col("item_id").cast("bigint"), "text").toLocalIterator())
    blocks = []
    while some := list(islice(asked, items_per_block)):
        if (ranked := _ranked(rows, read_items(some), k)) is not None:
            blocks.append(ranked)
    if not blocks:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, blocks)
