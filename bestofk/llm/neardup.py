"""N-gram Jaccard join: MinHash with Bayesian pruning, then exact verification.

Texts are sets of five-word shingles (64-bit hashes); texts with equal sets are one class and go on as one row. Banded
MinHash values put classes with a common band into one candidate group (connected over bands); with 30 bands of 5 a pair of
similarity 0.8 is missed with a chance below 1e-5, and a more similar one far less. Within a candidate group every pair is compared value block by
value block: given m equal values of n, the posterior chance that the similarity reaches the threshold is a binomial tail (uniform
prior); a pair leaves as soon as it falls below ``tolerance``. The rest is verified on the shingle sets.

A candidate group of any size is cut into blocks of classes; a task sees two blocks at a time and gives back the number of links per class
and a spanning forest of its links, never the pairs. Classes carry their number of documents, so copies count without being compared.

Defined cases: null and wordless texts have no shingles, are linked to nothing and stay; a text of fewer than five words is one shingle; repeated
rows are copies like any others (``distinct_documents`` keeps one); ids may be null or repeat, since a row is known by its id and 128 bits of its text. Extra
columns are ignored, or kept by ``distinct_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bestofk.functions.joins import join_cells
from bestofk.llm.common import fresh, sieved, stored, text_key
from bestofk.llm.components import connected_components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 30, 5
#: MinHash values looked at per step of the comparison.
STEP = 15
TOLERANCE = 1e-7
BLOCK = 256
_RANDOM = np.random.default_rng(11)
_A, _B = (_RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint64).astype(np.uint32) | np.uint32(1) for _ in range(2))
_POWER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_POWER), -1, 1 << 64))
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2 ** 64, up to ``n``."""
    if len(_tables[0]) < n:
        for i, base in enumerate((_POWER, _INVERSE)):
            row = np.full(2 * n, base, np.uint64)
            row[0] = 1
            _tables[i] = np.multiply.accumulate(row)
    return _tables


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of UTF-8 ``texts``, and where the words of each text begin (one entry more than texts)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * power[: len(data)], dtype=np.uint64)))
    h = (total[ends] - total[starts]) * inverse[starts]
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return _mix(h + (ends - starts).astype(np.uint64)), np.searchsorted(starts, begin)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w, begin = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    runs = np.zeros(max(0, len(w) - WORDS + 1), np.uint64)
    for j in range(WORDS):
        runs = runs * _POWER + w[j : j + len(runs)]
    runs = _mix(runs + np.uint64(WORDS))
    out = []
    for a, b in zip(begin[:-1], begin[1:]):
        if b - a >= WORDS:
            out.append(np.unique(runs[a : b - WORDS + 1]))
        elif b > a:  # fewer words: one shingle of them all
            h = np.zeros(1, np.uint64)
            for j in range(a, b):
                h = h * _POWER + w[j]
            out.append(_mix(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhash(s: np.ndarray) -> np.ndarray:
    """BANDS * ROWS values of 32 bits: least values of a x + b over the upper halves of the hashes."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        out = np.minimum(out, (_A * x[i : i + 1024] + _B).min(axis=1))
    return out


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest equal values of ``n`` with which a pair stays: P(similarity >= threshold | m of n) is a binomial tail."""
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def _parts(batch: pa.RecordBatch, most_chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most_chars`` characters of text, one row at least."""
    start, size = 0, 0
    for i, n in enumerate(pa.compute.utf8_length(batch.column("text")).to_pylist()):
        if size and size + (n or 0) > most_chars:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _set_hash(s: np.ndarray, salt: int) -> int:
    return int(_mix(s * _POWER + np.uint64(salt)).sum(dtype=np.uint64).view(np.int64))


#: What tells rows of a table apart, but for exact repeats.
KEY = ["doc_id", "text_a", "text_b"]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the two halves of the text's key."""
    key = text_key(F.col("text"))
    return docs.select("doc_id", "text", key["a"].alias("text_a"), key["b"].alias("text_b"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_a, text_b, n (shingles), set_a and set_b (128 bits that stand for the shingle set) and the band values of every row."""
    rows = _keyed(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_a bigint, text_b bigint, n int, set_a bigint, set_b bigint, bands array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                sets = shingle_sets(part.column("text").to_pylist())
                of_band = np.zeros((len(sets), BANDS), np.uint64)
                signatures = np.stack([minhash(s) for s in sets]).reshape(len(sets), BANDS, ROWS)
                for r in range(ROWS):
                    of_band = _mix(of_band * _POWER + signatures[:, :, r])
                bands = pa.FixedSizeListArray.from_arrays(pa.array(of_band.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
                columns = [
                    pa.array([len(s) for s in sets], pa.int32()), pa.array([_set_hash(s, 1) for s in sets], pa.int64()),
                    pa.array([_set_hash(s, 2) for s in sets], pa.int64()), bands,
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in KEY), *columns], [*KEY, "n", "set_a", "set_b", "bands"])

    return rows.mapInArrow(run, schema)


def _contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, copies, root, block, blocks with signature and shingles: the texts of ``wanted`` (one row of ``docs`` per class) are read again."""
    maybe = sieved(_keyed(docs), wanted, KEY, "maybe").where("maybe").drop("maybe")
    rows = join_cells(maybe, wanted, KEY)
    schema = "cls bigint, copies bigint, root bigint, block int, blocks int, signature binary, shingles binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                sets = shingle_sets(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("cls", "copies", "root", "block", "blocks")),
                     pa.array([minhash(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["cls", "copies", "root", "block", "blocks", "signature", "shingles"],
                )

    return rows.mapInArrow(run, schema).dropDuplicates(["cls"])


def _links_of_blocks(threshold: float, tolerance: float):
    """For one pair of blocks: links per class and a spanning forest, as rows (a, b, links): b a class linked with a, or null."""
    floors = [(n, least_matches(n, threshold, tolerance)) for n in range(STEP, BANDS * ROWS + 1, STEP)]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        rows = rows.sort_values(["block", "cls"], ignore_index=True)
        left, right = (np.flatnonzero(rows["block"].to_numpy() == k) for k in (i, j))
        sig = np.stack([np.frombuffer(x, np.uint32) for x in rows["signature"]])
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        size, copies = np.array([len(s) for s in sets]), rows["copies"].to_numpy()
        _, compact = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.concatenate(([0], np.cumsum(size)))
        mark = np.zeros(int(compact.max()) + 1, np.int64)
        links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x in left:
            others = right[right > x] if i == j else right
            smaller, larger = np.minimum(size[others], size[x]), np.maximum(size[others], size[x])
            others = others[smaller >= threshold * larger - 1e-9]
            equal = np.zeros(len(others), np.int64)
            for n, floor in floors:
                equal += (sig[others, n - STEP : n] == sig[x, n - STEP : n]).sum(axis=1)
                stay = equal >= floor
                others, equal = others[stay], equal[stay]
                if not len(others):
                    break
            if not len(others):
                continue
            own = compact[first[x] : first[x + 1]]
            mark[own] = 1
            cells = np.concatenate([compact[first[y] : first[y + 1]] for y in others])
            common = np.add.reduceat(mark[cells], np.concatenate(([0], np.cumsum(size[others])[:-1])))
            mark[own] = 0
            linked = others[common >= threshold * (size[others] + size[x] - common) - 1e-9]
            links[x] += copies[linked].sum()
            links[linked] += copies[x]
            for y in linked:
                root[max(top(x), top(y))] = min(top(x), top(y))
        cls = rows["cls"].to_numpy()
        some = np.flatnonzero(links)
        return pd.DataFrame({"a": cls[some], "b": cls[[top(x) for x in some]], "links": links[some]})

    return run


def _first(name: str = "first") -> Column:
    """The row that stands for a class or group: smallest id, ids before nulls, then by text."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), *KEY)).alias(name)


def classes(docs: DataFrame, *, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and per class of equal shingle sets: set_a, set_b, copies, links, ``first`` of the class and ``group_first`` of all classes
    linked with it (rows no_id, doc_id, text_a, text_b)."""
    rows = stored(sketches(docs), "sketches")
    some = rows.where("n > 0")
    per_class = stored(
        some.groupBy("set_a", "set_b").agg(F.count("*").alias("copies"), _first(), F.first("bands").alias("bands"))
        .withColumn("cls", F.monotonically_increasing_id()), "classes")
    # Only the buckets that several classes share go on; a class's bands are unpacked in place, never written out one by one.
    bands = per_class.select("cls", F.posexplode("bands").alias("band", "value"))
    shared = bands.groupBy("band", "value").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least < most")
    near = bands.join(stored(shared.select("band", "value", "least"), "buckets"), ["band", "value"])
    near = stored(near.where("cls <> least").select(F.col("cls").alias("a"), F.col("least").alias("b")).distinct(), "near")
    candidates = stored(connected_components(near), "groups")
    sizes = candidates.groupBy("root").agg(F.count("*").alias("members"))
    placed = candidates.join(stored(sizes, "sizes"), "root").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    wanted = placed.withColumnRenamed("node", "cls").join(per_class.select("cls", "copies", "first.*"), "cls").select(
        *KEY, "cls", "copies", "root", "block", "blocks")
    content = stored(_contents(docs, stored(wanted, "wanted")), "candidates")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j"))
    )
    dealt = content.withColumn("pair", F.explode(pairs))
    found = dealt.select("root", "pair.i", "pair.j", "block", "cls", "copies", "signature", "shingles").groupBy("root", "i", "j").applyInPandas(
        _links_of_blocks(threshold, tolerance), "a bigint, b bigint, links bigint"
    )
    found = stored(found, "found")
    groups = connected_components(found.select("a", "b"))
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    out = (
        per_class.drop("bands").join(links.withColumnRenamed("a", "cls"), "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
        .select("set_a", "set_b", "copies", "first", F.coalesce("root", "cls").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    firsts = out.groupBy("group").agg(F.min("first").alias("group_first"))
    return rows, stored(out.join(firsts, "group"), "linked")


def _members(docs: DataFrame, **options) -> DataFrame:
    """Every row's key and n with what is known of its class, null for wordless texts."""
    rows, found = classes(docs, **options)
    return rows.select(*KEY, "n", "set_a", "set_b").join(found, ["set_a", "set_b"], "left")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (smallest doc_id of all texts linked with it, over any number of steps), copy_of (smallest doc_id with the
    same shingle set), n_links (documents of similarity at the threshold or above, copies included). Where no text has an id, class_id and copy_of are null."""
    return _members(docs, **options).select(
        "doc_id",
        F.when(F.col("n") > 0, F.col("group_first.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("copy_of"),
        F.when(F.col("n") > 0, F.col("links") + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
    )


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` per class, that with the smallest id (without ids, that with the smallest text key), all columns unchanged; wordless texts all stay.

    Only rows that may leave or repeat are joined; of the rows of one id and text that stay, one is kept.
    """
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), *KEY)
    linked = _members(docs, **options).where("links + copies > 1")
    known = linked.groupBy(*KEY).agg(F.min((key != F.col("group_first")).cast("int")).alias("leaves"), F.count("*").alias("rows"))
    known = stored(known.where("leaves = 1 or rows > 1"), "leaving")
    flag, times = fresh(docs, "leaves"), fresh(docs, "times")
    halves = [fresh(docs, c) for c in ("text_a", "text_b")]
    whole = text_key(F.col("text"))
    keyed = docs.withColumns({halves[0]: whole["a"], halves[1]: whole["b"]})
    known = known.withColumnsRenamed({"text_a": halves[0], "text_b": halves[1], "leaves": flag, "rows": times})
    maybe = fresh(docs, "maybe")
    sifted = sieved(keyed, known, ["doc_id", *halves], maybe)
    marked = join_cells(sifted.where(maybe), known, ["doc_id", *halves], "left")
    staying = marked.where(F.coalesce(F.col(flag), F.lit(0)) == 0)
    alone = staying.where(F.coalesce(F.col(times), F.lit(1)) == 1)
    repeated = staying.where(F.col(times) > 1).dropDuplicates(["doc_id", *halves])
    untouched = sifted.where(~F.col(maybe))
    return untouched.select(*docs.columns).unionByName(alone.select(*docs.columns)).unionByName(repeated.select(*docs.columns))
