"""Held-out accuracy of the toxicity query on the given tables; the language is used by the report only."""

from __future__ import annotations

from collections import defaultdict

import __spark_entry__ as entry
from bestofk.llm import toxicity

SF_DIR = "/root/testdata/sf0.1"


def test_op1_held_out_by_language(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").where("toxic is not null").collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang").collect()}
    scored = [r for r in entry.queries()["op1_compression_toxicity"](spark, SF_DIR).collect() if r.held_out and r.doc_id in labels]
    toxic, ordinary = ([r for r in scored if labels[r.doc_id] == y] for y in (1, 0))
    above = sum((t.score > o.score) + 0.5 * (t.score == o.score) for t in toxic for o in ordinary)
    assert above / len(toxic) / len(ordinary) >= 0.93
    caught = defaultdict(list)
    for r in toxic:
        caught[langs[r.doc_id]].append(r.predicted)
    assert sum(map(sum, caught.values())) / len(toxic) >= 0.7
    assert all(sum(c) / len(c) >= 0.35 for c in caught.values()) and len(caught) == 4
    assert sum(r.predicted for r in ordinary) / len(ordinary) <= 0.03


def test_parts_of_a_rare_language_are_found():
    """A part that 5 % of the toxic texts have, and no ordinary one, is kept; one that both have is not, nor is a longer one around it."""
    ordinary = [[b"plain", b"word%d" % i] for i in range(600)]
    toxic = [[b"plain", b"word%d" % i, *([b"zzgrumblex"] if i % 20 == 0 else [])] for i in range(300)]
    marks = toxicity._marks(toxic, ordinary, toxicity.Settings())
    assert marks and all(m in b" zzgrumblex " for m in marks) and {len(m) for m in marks} == {5}


def test_commonest_parts_stand_last():
    assert toxicity._commonest([b" aaaa", b" bbbb", b" bbbb", b"aaaa"], 100) == b" aaaa bbbb"
    assert toxicity._commonest([b" aaaa", b" bbbb", b" bbbb"], 6) == b" bbbb"
