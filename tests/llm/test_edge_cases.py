"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and extra columns with clashing names."""

from __future__ import annotations

import hashlib
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline as P
from bestofk.llm import decontamination, html, licenses, mixing, neardup, quality, sharding, substrings, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns named like what operators make themselves.
CLASHES = "size int, key string, shard int, cls int, leaves int, times int, n int, hits int, bucket int, carry_0 int, kept int, w int, score int"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
PROSE = " ".join(f"alpha{i} beta{i * 7 % 31}" for i in range(60))
ROWS = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \t\n", "en", "a", 3), (4, PROSE, "en", "a", 9), (4, PROSE, "en", "a", 9), (5, PROSE, None, None, 9),
    (6, LONG, "en", "b", 9), (None, "one two three", "en", "b", 1), (7, "one two three", "en", "b", 1), (8, "the café ☃ All rights reserved 𝄞", "fr", "c", 1),
]


def documents(spark, rows=ROWS, clash=True):
    if not clash:
        return spark.createDataFrame(rows, DOCS)
    n = len(CLASHES.split(","))
    return spark.createDataFrame([(*r, *("x" if " string" in c else 1 for c in CLASHES.split(","))) for r in rows], f"{DOCS}, {CLASHES}")


def labels(spark, rows=((4, 1, 0), (6, 0, 1), (9, None, None), (None, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def benchmark(spark, rows=((1, "one two three"), (2, None), (3, ""), (None, "x y"))):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, labels(s))),
    "neardup": lambda s, d: neardup.near_duplicates(d),
    "quality": lambda s, d: quality.judge(d, labels(s)),
    "licenses": lambda s, d: licenses.scan(d),
    "sharding": lambda s, d: sharding.shard_documents(d, n_shards=4),
    "substrings": lambda s, d: substrings.remove_repeats(d),
    "mixing": lambda s, d: mixing.mix(d),
}


@pytest.fixture(scope="module")
def results(spark):
    """Each operator's rows over the odd documents, made once."""
    return {name: operator(spark, documents(spark)).collect() for name, operator in OPERATORS.items()}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(spark, results, name):
    got = results[name]
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert OPERATORS[name](spark, documents(spark, [])).collect() == []


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_defined_values(results):
    near = by_id(results["neardup"])
    assert (near[4].n_links, near[5].n_links, near[5].class_id, near[1].n_links, near[2].class_id) == (2, 2, 4, 0, 2)
    assert near[7].n_links == 1 and near[7].class_id == 7
    stats = by_id(results["quality"])
    assert stats[1].n_words == 0 and stats[1].base_failed and not stats[1].kept and stats[6].n_words == 30_000 and stats[6].kept
    scan = by_id(results["licenses"])
    assert (scan[8].base_labels, scan[8].n_base, scan[8].first_word, scan[1].labels, scan[1].first_word, scan[1].score) == ("reserved", 1, 3, "", None, 0.0)
    cut = results["substrings"]
    fours, nothing = [r for r in cut if r.doc_id == 4], hashlib.sha256(b"").hexdigest()
    assert [r.n_removed for r in fours] == [0, 0] and by_id(cut)[5].n_removed == 120 and by_id(cut)[1].kept_sha256 == nothing == by_id(cut)[5].kept_sha256
    placed = results["sharding"]
    counts = [sum(r.shard == s for r in placed) for s in range(4)]
    assert max(counts) - min(counts) <= 1 and by_id(placed)[1]["size"] == 16 and by_id(placed)[1].text_crc32 == 0
    taken = results["mixing"]
    assert all(r.taken <= 3 * r["size"] for r in taken) and by_id(taken)[1].taken == 0
    scores = results["toxicity"]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scores)


def test_decontamination(spark):
    docs = documents(spark)
    found = decontamination.matches(docs, benchmark(spark)).collect()
    assert sorted((str(r.doc_id), r.item_id, r.distance) for r in found) == [("7", 1, 0), ("None", 1, 0)]
    kept = decontamination.clean(docs, benchmark(spark))
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2
    assert decontamination.matches(docs, benchmark(spark, [])).count() == 0
    assert decontamination.matches(documents(spark, []), benchmark(spark)).count() == 0


def test_pages(spark, tmp_path):
    rows = [(1, None, None, 1), (2, "http://x/a b\n", "", 1), (3, "u", "<p>" + "long text " * 20_000, 1), (4, None, "x" * 120, 1), (5, None, "x" * 120, 1), (5, None, "x" * 120, 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, kind int")
    text = {r.page_id: r for r in html.extract(pages).collect()}
    assert text[1].text == "" and text[1].n_chars == 0 and set(text) == {1, 2, 3, 4, 5}
    for name, table, n in (("some", pages, 6), ("none", pages.limit(0), 0)):
        path = str(tmp_path / name)
        warc.write_archives(table, path)
        got = warc.with_full_payload(warc.assemble(warc.read_records(spark, path))).collect()
        assert len(got) == n
        if n:
            found = {r.page_id: (r.kind, r.full_bytes, r.refers_page) for r in got}
            assert found[4] == ("response", 120, None) and found[5] == ("revisit", 120, 4) and found[1] == ("response", 0, None)
            assert found[3][1] == len(rows[2][2]) and all(r.request and r.metadata for r in got)


def test_pipeline_stages(spark, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (ROWS, []):
        docs = documents(spark, rows)
        for name, stage in P.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if stage is not P.STAGES[-1][1]:
                assert out.columns == docs.columns, name
            n = out.count()
            assert bool(n) == bool(rows), name
            docs = spark.createDataFrame(out.collect(), out.schema)
