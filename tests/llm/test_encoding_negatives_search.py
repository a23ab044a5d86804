"""Byte-level BPE against the public library, hard negatives and lexical search against brute force, and odd inputs of all three."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bestofk.llm import bpe, hardneg, lexical

SF_DIR = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# --- encoding --------------------------------------------------------------

@pytest.fixture(scope="module")
def content():
    with open(RANKS, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def public(content):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def encoder(content):
    return bpe.Encoder(content, public_tokenizers.PATTERN)


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_every_code_point_splits_alike(encoder, public):
    texts = [f"a{chr(c)}1 {chr(c)}b" for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x3000 or c % 37 == 0)]
    assert [t for t, got in zip(texts, encoder.encode(texts)) if ids(got) != public(t)] == []


def test_random_texts(encoder, public):
    rng = random.Random(5)
    letters = "ab AZ\n\t\x0b\x1c\x1f\x85\xa0'stdle1290.,<|　é☃𝄞"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(3000)]
    assert [t for t, got in zip(texts, encoder.encode(texts)) if ids(got) != public(t)] == []


@pytest.mark.parametrize("text", [
    "", " ", "\n" * 3000, " " * 5000 + "a", "a" * 70_000, "ab" * 40_000, "x" * 300 + "y", "<|endoftext|>",
    "".join(random.Random(2).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)),
    "".join(random.Random(3).choice("ñéüß☃") for _ in range(40)), " ".join(f"word{i}" for i in range(200_000)),
], ids=lambda t: f"{t[:8]!r}x{len(t)}")
def test_long_and_odd_texts(encoder, public, text):
    assert ids(encoder.encode([text])[0]) == public(text)


@pytest.mark.parametrize("width", bpe.BUCKETS)
def test_matrices_and_heap_merge_alike(content, width):
    """Pieces of every length around a bucket's edge, by both ways and one merge at a time."""
    rng, v = random.Random(width), bpe.vocabulary(content)
    pieces = [bytes(rng.choice(b"aeinorst\xc3\xa9") for _ in range(n)) for n in (max(1, width - 1), width, width + 1) for _ in range(8)]
    for piece, got in zip(pieces, bpe.merge_pieces(pieces, v)):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while piece not in v.rank_of and (ranked := [(r, i) for i in range(len(parts) - 1) if (r := v.rank_of.get(parts[i] + parts[i + 1])) is not None]):
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        want = [v.rank_of[piece]] if piece in v.rank_of else [v.rank_of[p] for p in parts]
        assert got.tolist() == want
        assert piece in v.rank_of or bpe._merge_long(v.byte_ids[np.frombuffer(piece, np.uint8)].tolist(), v).tolist() == want


def test_pieces_are_forgotten_without_harm(content, public, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    encoder = bpe.Encoder(content, public_tokenizers.PATTERN)
    texts = [f"item{i} blorpt{i % 7} zzqx" for i in range(60)] * 2
    assert [ids(p) for t in texts for p in encoder.encode([t])] == [public(t) for t in texts]


def test_a_rank_file_needs_all_bytes():
    with pytest.raises(ValueError, match="255 single bytes"):
        bpe.vocabulary(base64.b64encode(b"a") + b" 0\n")


def test_op11_on_whole_table(spark, public):
    got = {r.doc_id: r for r in entry.queries()["op11_byte_bpe"](spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert len(docs) == len(got)
    for r in docs:
        want, g = public(r.text or ""), got[r.doc_id]
        packed = struct.pack(f"<{len(want)}I", *want)
        assert (g.n_tokens, g.ids_sha256) == (len(want), hashlib.sha256(packed).hexdigest())
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_encoding_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "ab cd", "x", 1), (1, "ab cd", "x", 1), (None, None, None, None), (2, "", "y", 2)], "doc_id int, text string, ids string, n_tokens int")
    out = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS)
    rows = sorted(map(tuple, out.select("doc_id", "n_tokens", F.decode("decoded", "UTF-8")).collect()), key=repr)
    assert rows == sorted([(1, 1, "ab cd"), (1, 1, "ab cd"), (None, None, ""), (2, 2, "")], key=repr)
    assert bpe.round_trip_digests(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# --- hard negatives --------------------------------------------------------

def negatives_by_brute_force(rows, s=hardneg.Settings()):
    """All pairs in Python; rows are (vec_id, vector, label)."""
    sound = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if label is not None and sound(v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    key = lambda pair: (-pair[0], math.inf if pair[1] is None else pair[1])
    out = []
    for anchor in {(i, tuple(v), label) for i, v, label in kept if i is not None and i % 100 == 0}:
        scored = [(score(anchor[1], v), i, label) for i, v, label in kept if i != anchor[0]]
        for p, (ps, positive, _) in enumerate(sorted((x for x in scored if x[2] == anchor[2]), key=key)[: s.n_positives]):
            fits = [x for x in scored if x[2] != anchor[2] and s.low * ps <= 100 * x[0] <= s.high * ps]
            for rank, (ns, negative, _) in enumerate(sorted(fits, key=key)[: s.n_negatives], 1):
                out.append((anchor[0], positive, rank, negative, ps, ns))
    return sorted(out, key=repr)


def vectors(n, dim, seed, labels=4, step=0.0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) / math.sqrt(dim)
    v = np.round(v / step) * step if step else v
    return [(i * 10, [float(x) for x in row], int(rng.integers(labels))) for i, row in enumerate(v)]


ODD = [
    (None, [0.5] * 8, 1), (100_000, [float("nan")] * 8, 1), (100_100, [float("inf")] * 8, 1), (100_200, None, 1), (100_300, [0.1] * 8, None), (100_400, [None] * 8, 2),
    (100_500, [0.0] * 8, 1), (7, [0.3] * 3, 2), (100_600, [], 3), (9, [1e30] * 8, 0), (11, [0.25] * 8, 2), (11, [0.25] * 8, 2), (100_700, [0.25] * 8, 2), (100_700, [0.25] * 8, 2),
]


@pytest.mark.parametrize("rows,settings", [
    (vectors(300, 8, 1) + ODD, {}), (vectors(400, 64, 2), {}), (vectors(300, 5, 3, step=0.25), {}), (vectors(200, 100, 4, labels=2), {"n_codes": 1}),
    (vectors(300, 16, 5), {"n_codes": 3, "query_bits": 4, "rows_per_block": 50, "anchors_per_block": 7}), (vectors(200, 16, 6), {"low": 50, "n_positives": 3, "n_negatives": 9}),
    (vectors(60, 8, 7, labels=1), {}), (vectors(12, 8, 8), {}),
])
def test_negatives_are_those_of_all_pairs(spark, rows, settings):
    s = hardneg.Settings(**settings)
    df = spark.createDataFrame([(*r, 5, 5) for r in rows], "vec_id bigint, embedding array<double>, label int, anchor int, place int")
    got = hardneg.hard_negatives(df, F.col("vec_id") % 100 == 0, settings=s).collect()
    want = negatives_by_brute_force([r for r in rows if r[1] is None or not any(x is not None and 1e20 < x < math.inf for x in r[1])], s)
    assert sorted(map(tuple, got), key=repr) == want


def test_no_vectors_or_no_anchors(spark):
    df = spark.createDataFrame(vectors(5, 4, 1), "vec_id bigint, embedding array<double>, label int")
    assert hardneg.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert hardneg.hard_negatives(df, F.lit(None).cast("boolean")).collect() == []


def test_no_score_leaves_its_interval():
    rng = np.random.default_rng(3)
    for dim, n_codes, bits in ((4, 1, 2), (64, 1, 8), (64, 4, 8), (128, 5, 3), (256, 2, 6)):
        x = rng.integers(-300, 300, (500, dim))
        x[0] = 0
        codes, q = hardneg.one_bit_codes(x, n_codes, 0), rng.integers(-300, 300, dim)
        for query in (q, x[1], x[0]):
            low, high = hardneg.interval(codes, slice(None), hardneg.quantise(hardneg.rotate(query[None], 0)[0], bits))
            exact = x @ query
            assert (low <= exact).all() and (exact <= high).all()


def test_rotation_keeps_products():
    x = np.random.default_rng(1).integers(-99, 99, (20, 32))
    turned = hardneg.rotate(x, 4)
    assert np.allclose(turned @ turned.T, x @ x.T) and not np.allclose(turned, x)


def test_more_codes_leave_fewer_candidates():
    """The interval decides what is scored: its width falls with the number of codes."""
    x = np.random.default_rng(2).normal(size=(2000, 64)) * 256 / 8
    query = hardneg.quantise(hardneg.rotate(x[:1], 0)[0], 8)
    kept = []
    for n_codes in (1, 6):
        low, high = hardneg.interval(hardneg.one_bit_codes(x, n_codes, 0), slice(1, None), query)
        kept.append(int((high >= hardneg._nth(low, 5)).sum()))
    assert kept[0] > 1900 and kept[1] < 0.2 * kept[0]


# --- ranked search ---------------------------------------------------------

def ranks_by_brute_force(docs, items, k=20):
    """Every score of every document; rows are (id, text)."""
    terms = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in counted:
            m = 75 + (25 * c.total() * n_docs) // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, math.inf if doc_id is None else doc_id))
        out += [(item_id, rank, None if doc_id == math.inf else doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def corpus(n, seed, vocabulary=40):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(5000)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(n)]


SEARCH_CASES = [
    (corpus(400, 1), [(i, t) for i, t in corpus(12, 2)], 20), (corpus(300, 3, 6), [(1, "w1 w2 w2 W3"), (1, "w1"), (None, "w4 w4"), (5, None), (6, ""), (7, "unheard of")], 7),
    ([(1, "one two"), (1, "one two"), (None, "One, TWO!"), (2, None), (3, ""), (4, "...")], [(1, "two")], 2), ([(i, "same words here") for i in range(60)], [(1, "same here")], 20),
    ([(1, "Café ☃ naïve"), (2, "CAFÉ café")], [(1, "café"), (2, "☃ naïve")], 20), ([], [(1, "a")], 20), (corpus(20, 4), [], 20), ([(1, None), (2, "  ")], [(1, "a")], 20),
]


@pytest.mark.parametrize("docs,items,k", SEARCH_CASES)
def test_search_ranks_every_document(spark, docs, items, k):
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id bigint, text string, score int, item_id int").repartition(3)
    i = spark.createDataFrame([(*r, 3) for r in items], "item_id bigint, text string, doc_id int")
    got = lexical.search(d, i, k, items_per_block=5).collect()
    assert sorted(map(tuple, got), key=repr) == ranks_by_brute_force(docs, items, k)


def test_small_shards_and_stretches(monkeypatch):
    """Full shards give their best and start anew; a text is split anywhere between words. In one process, so that the bounds can be small."""
    docs, items = corpus(300, 6), [(i, t) for i, t in corpus(6, 7)]
    monkeypatch.setattr(lexical, "STRETCH", 7)
    monkeypatch.setattr(lexical, "SHARD_DOCS", 16)
    monkeypatch.setattr(lexical, "FIRST_READ", 2)
    block = lexical.read_items(items)
    found = [lexical.count_terms(t, block.place) for _, t in docs]
    n_docs, n_terms = sum(n > 0 for n, _, _ in found), sum(n for n, _, _ in found)
    df = Counter(t for _, terms, _ in found for t in terms.tolist())
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in range(len(block.place))])
    shard, parts = lexical._Shard(), []
    for (doc_id, _), (n, terms, times) in zip(docs, found):
        if len(terms) and shard.add(doc_id, n, terms, times):
            parts.append(shard.best(block, weights, n_docs, n_terms, 5))
            shard = lexical._Shard()
    parts.append(shard.best(block, weights, n_docs, n_terms, 5))
    assert len(parts) > 10
    rows = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    got = []
    for item in range(len(items)):
        best = sorted((-score, doc_id) for i, doc_id, score in rows if i == item)[:5]
        got += [(items[item][0], rank, doc_id, -score) for rank, (score, doc_id) in enumerate(best, 1)]
    assert sorted(got, key=repr) == ranks_by_brute_force(docs, items, 5)


def test_nra_reads_no_further_than_needed():
    """One document far ahead in the only list: the rest of the list stays unread; with ties reading goes on."""
    class Read(np.ndarray):
        last = 0

        def __getitem__(self, at):
            if isinstance(at, slice) and at.stop is not None:
                Read.last = max(Read.last, int(at.stop))
            return super().__getitem__(at)

    n = 5000
    for impacts, bound in ((np.array([9000, *range(n - 1, 0, -1)]), 100), (np.full(n, 7), n)):
        Read.last = 0
        lists = lexical.Lists(np.arange(n).view(Read), impacts, np.array([0, n]))
        docs, scores = lexical.nra(lists, np.array([0]), np.array([1]), np.arange(n), 1)
        assert docs.tolist() == [0] and scores.tolist() == [int(impacts[0])] and Read.last <= bound
        assert bound < n or Read.last == n
