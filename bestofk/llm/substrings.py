"""Substring dedup: an FM-index per shard tells which windows of words start earlier elsewhere.

A word goes if a window of 20 words that covers it also starts earlier: in a document with a smaller id, or earlier in the same one.

1.  Documents with the same words are one: all but the first of them lose every word.
2.  Every window is named by the smallest hash of its five-word grams. Consecutive windows with the same name are one
    segment. Equal windows have equal names, so segments whose name stands at one place only hold nothing that repeats and stop here.
3.  Repeated segments are cut out of the texts, equal ones are merged on their earliest place, and the name picks the shard. A name with more than
    ``HOT_NAME`` places is dealt out window by window, by the content of the window, so no shard depends on one name.
4.  Each shard holds a compressed FM-index (Burrows-Wheeler transform in a wavelet matrix of packed bits with block counts). Its segments are
    streamed through backward search, all in step from their last words: the interval grows to the left, and as soon as the
    matching statistic exceeds the window it is widened again to the suffixes that share the window. The interval says where the window starts first.
5.  Windows that start first stay, all other windows of repeated segments go.

Documents never meet in pairs, and nothing but names travels for text that does not repeat.

Defined cases: a null or empty text has no words, nothing to remove and the hash of the empty text; texts shorter than a window stay; a
null id counts as larger than any other; repeated rows give the same answer each; different texts with the same id are put in the order
of a hash. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bestofk.llm.common import stored
from bestofk.llm.neardup import _mix, _parts, _POWER, word_hashes

WINDOW, GRAM = 20, 5
#: Segments have at most this many windows.
LONGEST = 64
#: Names with more places than this are dealt out by window.
HOT_NAME = 20_000
#: Words per shard, about.
SHARD_WORDS = 400_000
LAST_ID = (1 << 63) - 1


def _grams(w: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(max(0, len(w) - n + 1), np.uint64)
    for j in range(n):
        h = h * _POWER + w[j : j + len(h)]
    return _mix(h)


def segments(w: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one name over all texts of a part: text number, name, first and last window start in its text, and at
    how many places the name stands. Equal windows have the name at the same distance, so with one place none repeats within the run.
    """
    span = WINDOW - GRAM + 1
    low = _grams(w, GRAM)
    low = np.concatenate([low, np.full(len(w) - len(low), ~np.uint64(0))])
    where, done = np.arange(len(w), dtype=np.int32), 1
    while done < span:  # sliding minimum and its first place, by doubling
        step = min(done, span - done)
        later = np.concatenate([low[step:], np.full(min(step, len(low)), ~np.uint64(0))])
        where = np.where(later < low, np.concatenate([where[step:], where[len(where) - min(step, len(where)) :]]), where)
        low = np.minimum(low, later)
        done += step
    length = np.diff(begin)
    text = np.repeat(np.arange(len(length)), length)
    at = np.arange(len(w)) - begin[:-1][text]
    good = np.flatnonzero(at + WINDOW <= length[text])
    if not len(good):
        return (np.zeros(0, np.int64),) * 5
    text, at, low, where = text[good], at[good], low[good], where[good]
    new = np.ones(len(good), bool)
    new[1:] = (text[1:] != text[:-1]) | (low[1:] != low[:-1])
    start = np.flatnonzero(new)
    inside = np.arange(len(good)) - start[np.cumsum(new) - 1]
    cut = np.flatnonzero(inside % LONGEST == 0)
    last = np.concatenate([cut[1:], [len(good)]]) - 1
    moves = np.concatenate([[0], np.cumsum(where[1:] != where[:-1])])
    return text[cut], low[cut].view(np.int64), at[cut], at[last], 1 + moves[last] - moves[cut]


def _key(w: np.ndarray, salt: int) -> int:
    """A hash of a word sequence: of its words with their places."""
    place = np.arange(1, len(w) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(salt)
    return int(_mix(w ^ _mix(place)).sum(dtype=np.uint64).view(np.int64)) if len(w) else salt


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _survey(docs: DataFrame) -> DataFrame:
    """Per row: did, n_words, key_a, key_b, sha (of all words) and its segments as parallel arrays."""
    schema = ("did bigint, doc_id bigint, n_words bigint, key_a bigint, key_b bigint, sha string, "
              "name array<bigint>, first array<int>, last array<int>, times array<int>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                texts = [_bytes(t) for t in part.column("text").to_pylist()]
                w, begin = word_hashes(texts)
                text, name, first, last, times = segments(w, begin)
                offsets = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((name, pa.int64()), (first, pa.int32()), (last, pa.int32()), (times, pa.int32()))]
                ids = part.column("doc_id")
                own = [w[a:b] for a, b in zip(begin[:-1], begin[1:])]
                columns = [
                    ids.fill_null(LAST_ID), ids, pa.array(np.diff(begin), pa.int64()), pa.array([_key(x, 1) for x in own], pa.int64()),
                    pa.array([_key(x, 2) for x in own], pa.int64()), pa.array([hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]), *lists,
                ]
                yield pa.RecordBatch.from_arrays(columns, ["did", "doc_id", "n_words", "key_a", "key_b", "sha", "name", "first", "last", "times"])

    return rows.mapInArrow(run, schema)


def _with_texts(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """did, key_a, hits and the text of each document of ``hits``; texts that merely share an id are left out."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("did"), "text")
    rows = hits.join(texts, "did").select("did", "key_a", "hits", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                w, begin = word_hashes([_bytes(t) for t in part.column("text").to_pylist()])
                right = [k == _key(w[a:b], 1) for k, a, b in zip(part.column("key_a").to_pylist(), begin[:-1], begin[1:])]
                yield part.filter(pa.array(right, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def _cut_out(found: DataFrame) -> DataFrame:
    """route, segment (its words), did, key_a, first: the places of all repeated segments."""
    schema = "route bigint, segment string, did bigint, key_a bigint, first int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 500_000):
                out: list[tuple] = []
                for did, key, hits, text in zip(*(part.column(c).to_pylist() for c in ("did", "key_a", "hits", "text"))):
                    words = _bytes(text).split()
                    for hit in hits:
                        a, b = hit["first"], hit["last"]
                        if not hit["hot"]:
                            out.append((hit["name"], b" ".join(words[a : b + WINDOW]), did, key, a))
                            continue
                        for at in range(a, b + 1):
                            segment = b" ".join(words[at : at + WINDOW])
                            route = int.from_bytes(hashlib.blake2b(segment, digest_size=8).digest(), "big", signed=True)
                            out.append((route, segment, did, key, at))
                names = ["route", "segment", "did", "key_a", "first"]
                types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
                columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 5, types)]
                columns[1] = columns[1].cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

    return found.mapInArrow(run, schema)


class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bit row per bit of a symbol, with counts at every 64 bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n, self.rows = bits, len(symbols), []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32)
            zeros = len(bit) - int(bit.sum())
            self.rows.append((packed, before, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` stands before place ``at``."""
        low = np.zeros(len(at), np.int64)
        for depth, (packed, before, zeros) in enumerate(self.rows):
            up = (symbol >> (self.bits - 1 - depth) & 1).astype(bool)
            both = []
            for place in (low, at):
                word = place >> 6
                ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)))
                both.append(np.where(up, zeros + ones, place - ones))
            low, at = both
        return at - low


class FMIndex:
    """Backward search over segments of word numbers (1 and up), 0 ends a segment.

    Suffixes are sorted by their first 32 words, enough for patterns of ``WINDOW`` + 1 words. ``same`` numbers the runs of suffixes that share
    their first ``WINDOW`` words.
    """

    def __init__(self, text: np.ndarray, n_symbols: int):
        n = len(text)
        _, rank = np.unique(text, return_inverse=True)
        ranks, reach = {1: rank.astype(np.int64)}, 1
        shifted = lambda r, k: np.concatenate([r[k:] + 1, np.zeros(min(k, n), np.int64)])
        while reach < 32:
            both = ranks[reach] * (n + 1) + shifted(ranks[reach], reach)
            if reach == 16:
                self.order = np.argsort(both, kind="stable")
            else:
                _, r = np.unique(both, return_inverse=True)
                ranks[2 * reach] = r.astype(np.int64)
            reach *= 2
        window = (ranks[16] * (n + 1) + shifted(ranks[4], 16))[self.order]
        change = np.concatenate([[True], window[1:] != window[:-1]])
        self.same = np.cumsum(change) - 1
        self.bounds = np.concatenate([np.flatnonzero(change), [n]])
        last = text[self.order - 1]
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))])
        self.bwt = WaveletMatrix(last, max(1, int(n_symbols).bit_length()))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``symbol`` put in front."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + self.smaller[np.concatenate([symbol, symbol])]
        return both[: len(low)], both[len(low) :]

    def earliest(self, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, place: np.ndarray) -> np.ndarray:
        """For each position of ``text``: the smallest ``place`` of a suffix with the same first ``WINDOW`` words, or -1 where none can begin.

        The segments [starts, ends) are streamed from their last words to their first, all in step.
        """
        least = np.minimum.reduceat(place[self.order], self.bounds[:-1])
        out = np.full(len(text), -1, np.int64)
        by_length = np.argsort(starts - ends, kind="stable")
        at, stop = ends[by_length] - 1, starts[by_length]
        low, high, depth = np.zeros(len(at), np.int64), np.full(len(at), len(text), np.int64), 0
        while len(at):
            low, high = self.extend(text[at], low, high)
            depth += 1
            if depth >= WINDOW:
                run = self.same[low]
                out[at] = least[run]
                low, high = self.bounds[run], self.bounds[run + 1]
            at = at - 1
            live = int(np.searchsorted(-(at - stop), 1))  # longest first: those that go on stand in front
            at, stop, low, high = at[:live], stop[:live], low[:live], high[:live]
        return out


def first_windows(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: segment, did, key_a, first to the windows that start nowhere earlier, as ranges did, key_a, first, last."""
    rows = rows.sort_values(["did", "key_a", "first"], ignore_index=True)
    split = [s.encode("utf-8", "surrogatepass").split() for s in rows["segment"]]
    length = np.array([len(s) for s in split])
    codes, names = pd.factorize(np.array([w for s in split for w in s], object))
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    text = np.zeros(int(length.sum()) + len(rows), np.int64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = codes + 1
    new = (rows["did"].diff() != 0) | (rows["key_a"].diff() != 0)
    document = np.cumsum(new.to_numpy()).astype(np.int64)
    offset = np.arange(len(text)) - np.repeat(starts, length + 1)
    own = (np.repeat(document, length + 1) << 32) + np.repeat(rows["first"].to_numpy().astype(np.int64), length + 1) + offset
    index = FMIndex(text, len(names))
    stays = index.earliest(starts, ends, text, own) == own
    edge = np.flatnonzero(np.diff(np.concatenate(([0], stays.astype(np.int8), [0]))))
    begin, finish = edge[::2], edge[1::2] - 1
    of = np.searchsorted(ends, begin)
    first = rows["first"].to_numpy()[of] + begin - starts[of]
    return pd.DataFrame({
        "did": rows["did"].to_numpy()[of], "key_a": rows["key_a"].to_numpy()[of], "first": first, "last": first + finish - begin,
    })


def _removed(found: DataFrame) -> DataFrame:
    """did, key_a, n_removed and the hash of what is kept, from the windows of repeated segments less those that stay."""
    schema = "did bigint, key_a bigint, n_removed bigint, kept_sha string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas = [], []
            for hits, stay, text in zip(*(batch.column(c).to_pylist() for c in ("hits", "stay", "text"))):
                words = _bytes(text).split()
                step = np.zeros(len(words) + 1, np.int64)
                for ranges, sign in ((hits, 1), (stay or (), -1)):
                    for r in ranges:
                        step[r["first"]] += sign
                        step[r["last"] + 1] -= sign
                goes = np.flatnonzero(np.cumsum(step) > 0)
                cover = np.zeros(len(words) + WINDOW + 1, np.int64)
                np.add.at(cover, goes, 1)
                np.add.at(cover, goes + WINDOW, -1)
                gone = np.cumsum(cover)[: len(words)] > 0
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("did"), batch.column("key_a"), pa.array(removed, pa.int64()), pa.array(shas, pa.string())],
                ["did", "key_a", "n_removed", "kept_sha"])

    return found.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row of ``docs``."""
    survey = stored(_survey(docs).withColumn("rid", F.monotonically_increasing_id()), "survey")
    firsts = stored(survey.groupBy("key_a", "key_b").agg(F.min(F.struct("did", "rid")).alias("p")), "first-copies")
    firsts = firsts.select("key_a", "key_b", F.col("p.did").alias("first_did"), F.col("p.rid").alias("first_rid"))
    plain = survey.select("did", "doc_id", "n_words", "key_a", "key_b", "sha").join(firsts, ["key_a", "key_b"])
    owners = survey.join(firsts, ["key_a", "key_b"]).where("rid = first_rid and size(name) > 0")
    # A segment in one number: its place and its length; the document in another.
    place = lambda x: F.struct(x["name"].alias("name"), (x["first"] * 64 + x["last"] - x["first"]).alias("at"), x["times"].alias("times"))
    parts = owners.select("rid", F.inline(F.transform(F.arrays_zip("name", "first", "last", "times"), place)))
    names = parts.groupBy("name").agg(F.sum("times").alias("n")).where("n > 1")
    names = stored(names.select("name", (F.col("n") > HOT_NAME).alias("hot")), "names")
    hit = F.struct("name", F.floor(F.col("at") / 64).cast("int").alias("first"), (F.floor(F.col("at") / 64) + F.col("at") % 64).cast("int").alias("last"), "hot")
    hits = stored(parts.select("rid", "name", "at").join(names, "name").groupBy("rid").agg(F.collect_list(hit).alias("hits")), "hits")
    hits = survey.select("rid", "did", "key_a").join(hits, "rid").drop("rid")
    found = stored(_with_texts(docs, hits), "texts")
    earliest = F.min(F.struct("did", "key_a", "first")).alias("p")
    distinct = stored(_cut_out(found).groupBy("route", "segment").agg(earliest).select("route", "segment", "p.*"), "segments")
    words = distinct.agg(F.sum(F.length("segment"))).first()[0] or 0
    shards = max(1, int(words / 6 / SHARD_WORDS))
    stay = distinct.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards))).groupBy("shard").applyInPandas(
        first_windows, "did bigint, key_a bigint, first int, last int"
    )
    stay = stored(stay.groupBy("did", "key_a").agg(F.collect_list(F.struct("first", "last")).alias("stay")), "first-windows")
    removed = _removed(found.join(stay, ["did", "key_a"], "left").select("did", "key_a", "hits", "stay", "text"))
    # Repeated rows of a document were worked out once each, with the same result.
    removed = stored(removed.dropDuplicates(["did", "key_a"]), "removed")
    is_copy, long = F.col("did") > F.col("first_did"), F.col("n_words") >= WINDOW
    nothing = hashlib.sha256(b"").hexdigest()
    return plain.join(removed, ["did", "key_a"], "left").select(
        "doc_id", "n_words",
        F.when(is_copy & long, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(is_copy & long, F.lit(nothing)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )
