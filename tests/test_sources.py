"""Stores, logs, result documents, prompt sets, reports and streams on small tables."""

from __future__ import annotations

import gzip
import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from bestofk.functions import text as T
from bestofk.functions.hashing import CONFIG_FIELDS, config_fingerprint
from bestofk.operators import prompts as P
from bestofk.plans import reports as R
from bestofk.sources import logs, results, samples

CONFIG = {
    "model": "org/m-1", "dataset": "gsm8k", "K": 4, "temperature": 1.0, "top_p": 0.95, "top_k": -1, "max_tokens": 64, "seed": 0,
    "prompt_template_version": "v1", "num_prompts": 10, "max_reasoning_length": None,
}


def python_fingerprint(config):
    known = {k: v for k, v in config.items() if v is not None}
    return hashlib.sha256(json.dumps(known, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def spark_fingerprint(spark, config):
    return spark.range(1).select(config_fingerprint({k: F.lit(config[k]) for k in CONFIG_FIELDS}).alias("f")).first().f


def test_fingerprint(spark):
    assert spark_fingerprint(spark, CONFIG) == python_fingerprint(CONFIG)
    assert spark_fingerprint(spark, {**CONFIG, "temperature": 1}) == python_fingerprint(CONFIG)
    seen = {python_fingerprint(CONFIG)}
    for field, value in {"model": "x", "K": 5, "temperature": 0.7, "seed": 1, "max_reasoning_length": 0, "num_prompts": 11}.items():
        other = spark_fingerprint(spark, {**CONFIG, field: value})
        assert other == python_fingerprint({**CONFIG, field: value})
        assert other not in seen
        seen.add(other)


def wide(rows, fingerprint):
    return rows([("p0", "q", "t", ["a", "b"]), ("p1", "q", "t", ["c", "d"])], samples.SAMPLE_SCHEMA).withColumn("fingerprint", F.lit(fingerprint))


def test_store_is_written_once_and_pruned(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        samples.read_samples(spark, path)
    samples.write_samples(wide(rows, "f1"), path)
    samples.write_samples(wide(rows, "f2"), path)
    with pytest.raises(FileExistsError):
        samples.write_samples(wide(rows, "f1"), path)
    assert samples.read_samples(spark, path).count() == 4
    one = samples.read_samples(spark, path, ["f1"])
    assert one.count() == 2 and re.search(r"PartitionFilters: \[[^\]]*fingerprint", plan(one))
    assert samples.explode_samples(one).count() == 4
    asked = rows([("f2",), ("f9",)], "fingerprint string")
    assert samples.cache_hits(asked, one.select("fingerprint").union(asked.limit(0))).count() == 0
    assert samples.cache_misses(asked, samples.read_samples(spark, path)).first().fingerprint == "f9"


def write_jsonl(path, header, records):
    with gzip.open(path, "wt") as out:
        out.write("".join(json.dumps(r, sort_keys=True) + "\n" for r in ([header] if header else []) + records) + "\n")


def test_import_jsonl(spark, tmp_path):
    key = {k: v for k, v in CONFIG.items() if v is not None}
    record = {"prompt_id": "p", "prompt": "q", "ground_truth": "4", "samples": ["#### 4", "no"]}
    good, old, bare = tmp_path / "good.jsonl.gz", tmp_path / "old.jsonl.gz", tmp_path / "bare.jsonl.gz"
    write_jsonl(good, {"_cache_key": key, "_format_version": 2}, [record, record])
    write_jsonl(old, {"_cache_key": key, "_format_version": 1}, [record])
    write_jsonl(bare, None, [record])
    got = samples.import_sample_jsonl(spark, str(good), CONFIG).collect()
    assert len(got) == 2 and got[0].fingerprint == python_fingerprint(CONFIG) and got[0].samples == ["#### 4", "no"]
    for path, expected in ((old, CONFIG), (bare, None), (good, {**CONFIG, "seed": 9})):
        with pytest.raises(Exception, match="without the expected header"):
            samples.import_sample_jsonl(spark, str(path), expected).collect()
    twice, torn, none = tmp_path / "twice.jsonl", tmp_path / "torn.jsonl", tmp_path / "none.jsonl"
    header = {"_cache_key": key, "_format_version": 2}
    twice.write_text("\n".join(json.dumps(x) for x in (header, record, header, record)))
    torn.write_text(json.dumps(header) + "\n" + json.dumps(record) + "\n" + json.dumps(record)[:-9])
    none.write_text(json.dumps(header) + "\n")
    for path, message in ((twice, "without the expected header"), (torn, "torn line"), (none, "without samples")):
        with pytest.raises(Exception, match=message):
            samples.import_sample_jsonl(spark, str(path), CONFIG).collect()


def test_verdict_log(rows):
    log = rows([
        (1, "h1_m", "p", 0, [1.0, 0.0]), (2, "h1_m", "p", 0, [1.0, 1.0]), (3, "h1_m", "q", 0, [0.0, 0.0]), (4, "h1_m", "r", 0, [0.0]),
        (5, "h1_m", "p", 1, None), (6, "h2_m", "p", 0, [0.5, 0.5]),
    ], "ingest_seq int, experiment string, prompt_id string, k int, raw_verdicts array<double>")
    got = logs.read_verdict_log(log, "h1", "prefix").orderBy("prompt_id").collect()
    assert [(r.prompt_id, r.raw_verdicts) for r in got] == [("p", [1.0, 1.0]), ("q", [0.0, 0.0])]
    assert logs.read_verdict_log(log, "h1").count() == 0
    with pytest.raises(ValueError):
        logs.read_verdict_log(log, "h1", "like")


def test_compute_budget_and_log_files(spark, rows, tmp_path):
    log = rows([(1, "h1_a", 0, 1.0), (2, "h1_a", 0, 9.0), (3, "h1_a", 1, 2.0), (4, "h9_a", 0, 5.0)], "ingest_seq int, experiment string, seed int, gpu_hours double")
    assert [tuple(r) for r in logs.compute_budget(log).collect()] == [("h1", 3.0)]
    line = lambda t, e, h, s: json.dumps({"timestamp": t, "experiment": e, "gpu_hours": h, "metadata": {"seed": s}})
    (tmp_path / "compute_budget.jsonl").write_text(line("2026-01-01T00:00:00", "h1_a", 1.5, 0) + "\n{torn\n")
    (tmp_path / "compute_budget_b.jsonl").write_text(line("2026-01-01T00:00:00", "h1_a", 7.0, 0) + "\n" + line("2026-01-02T00:00:00", "h2_b", 2.0, 0) + "\n")
    read = logs.read_compute_log(spark, str(tmp_path))
    assert {r.hyp: r.gpu_hours for r in logs.compute_budget(read).collect()} == {"h1": 1.5, "h2": 2.0}


def test_verdict_files_keep_the_last_record(spark, tmp_path):
    line = lambda u, votes: json.dumps({"timestamp": "2026-01-01T00:00:00", "experiment": "h1_m", "prompt_id": "p", "k": 0, "utility": u, "raw_verdicts": votes})
    (tmp_path / "uf_log.jsonl").write_text(line(0.0, [0.0]) + "\n\n{torn\n" + line(1.0, [1.0]) + "\n" + line(0.5, None) + "\n")
    log = logs.verdict_files(spark, str(tmp_path / "uf_log.jsonl"))
    got = logs.read_verdict_log(log, "h1_m").collect()
    assert [(r.prompt_id, r.k, r.utility, r.raw_verdicts) for r in got] == [("p", 0, 1.0, [1.0])]


def test_resume_ledger(rows):
    lines = rows([(1, '{"i":0,"k":1,"text":"old"}'), (2, '{"i":0,"k":1,"text":"new"}'), (3, '{"i":0,"k":2,"te'), (4, '{"i":1,"k":0}'), (5, "")], "ingest_seq int, value string")
    assert [tuple(r) for r in logs.resume_ledger(lines).collect()] == [(0, 1, "new")]


def test_result_documents(spark, tmp_path):
    doc = {"hyp": "h1", "model": "m", "dataset": "d", "reu": 0.5, "curve": [{"k_prefix": 1, "u_circ": 0.5, "u_bar": 0.25}]}
    (tmp_path / "m_d_judge-x_seed0.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "other.json").write_text(json.dumps({**doc, "seed": 0}))
    (tmp_path / "m_d_seed1.json").write_text(json.dumps({**doc, "seed": 1}))
    (tmp_path / "torn.json").write_text('{"model": "m", ')
    got = results.read_cell_results(spark, str(tmp_path), seed=0).orderBy("file_name").collect()
    assert [(r.file_name, r.dataset_id, r.seed) for r in got] == [("m_d_judge-x_seed0.json", "d_judge-x", 0), ("other.json", "d", 0)]
    assert results.read_cell_results(spark, str(tmp_path)).count() == 3


def test_ground_truths(rows):
    df = rows([(0, '[{"input":"1","output":"2","testtype":"stdin"}]', '[{"input":"3","output":"4","testtype":"stdin"}]'),
               (1, '[{"input":"1"}]', "[{"), (2, '[{"input":"1"}] junk', "[]"), (3, None, None)], "id int, a string, b string")
    n = df.select("id", F.size(P.ground_truth_bundle(F.col("a"), F.col("b"), F.lit("s"))["tests"]).alias("n"))
    assert [r.n for r in n.orderBy("id").collect()] == [2, 0, 0, 0]
    chat = rows([(0, [("user", "u"), ("assistant", "x"), ("assistant", "y")]), (1, [("user", "u")])], "id int, chosen array<struct<role:string,content:string>>")
    got = chat.select("id", P.ground_truth_preference(F.col("chosen")).alias("t")).orderBy("id").collect()
    assert [r.t for r in got] == ["x", ""]


def test_render_does_not_reread_fields(rows):
    df = rows([("{b}", "B")], "a string, b string")
    assert df.select(T.render("<{a}|{b}|{a}>", {"a": F.col("a"), "b": F.col("b")}).alias("t")).first().t == "<{b}|B|{b}>"
    assert df.select(T.render("\\boxed{{{b}}}", {"b": F.col("b")}).alias("t")).first().t == "\\boxed{B}"
    assert df.select(P.few_shot("ex \n\n", F.col("b")).alias("t")).first().t == "ex\n\nB"


def test_worklists(rows):
    with pytest.raises(ValueError):
        P.budget_stage2_worklist(rows([("p", 0, "t")], "prompt string, k int, stage1_text string"), -1, 0)
    calls = P.sample_worklist(rows([(0,), (1,)], "ordinal int"), 2, 1, rows([(0, 1)], "ordinal int, k int"))
    assert sorted(tuple(r) for r in calls.collect()) == [(0, 0, 100003), (1, 0, 100003), (1, 1, 100004)]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_limits_and_filters_reach_the_map_side(spark):
    """A rank limit is applied before the shuffle, a date filter in the scan."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert plan(P.union_subsets(docs, ["src1", "src2"], 5, "source", "text", "n_chars", "doc_id")).count("WindowGroupLimit") >= 2
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert "GreaterThanOrEqual(o_orderdate" in plan(P.date_cutoff(orders, "o_orderdate", "1997-06-01"))


def test_flags(rows):
    df = rows([("r", 1, 0.5), ("r", 2, 0.5 + 1e-12), ("r", 3, 0.9), ("r", 4, None)], "row string, c int, v double")
    got = R.mark_extreme(df, ["row"], "v", best="min").orderBy("c").collect()
    assert [r.best for r in got] == [True, True, False, False]
    df = rows([("r", 1, 0.0), ("r", 2, 0.3), ("r", 3, 0.3), ("s", 1, 0.0)], "row string, c int, v double")
    got = R.mark_smallest_positive(df, ["row"], "v", "c").orderBy("row", "c").collect()
    assert [r.best for r in got] == [False, True, False, False]


def test_lookup_order(rows):
    index = rows([("b", "d", 1.0), ("a", "e", 2.0), ("b", "f", 3.0)], "model string, dataset_id string, reu double")
    slots = rows([("a", "d"), ("a", "x"), ("a", "y"), ("z", "d")], "model string, dataset_id string")
    got = R.lookup_cell(slots, index, {"a": ["b"]}, {("a", "x"): "e", ("a", "y"): "f"})
    assert {(r.model, r.dataset_id): r.reu for r in got.collect()} == {("a", "d"): 1.0, ("a", "x"): 2.0, ("a", "y"): 3.0, ("z", "d"): None}


def test_gpu_hours(rows):
    cells = rows([("h1", 3600.0), ("h1", 3600.0), ("h2", None), ("h4", 3600.0), ("h4", None)], "hyp string, sampling_seconds double")
    budget = rows([("h2", 5.0), ("h4", 7.0)], "hyp string, gpu_hours double")
    got = {r.hyp: (r.n_cells, r.n_timed, r.hours, r.source) for r in R.gpu_hours(cells, budget).collect()}
    assert got == {"h1": (2, 2, 2.0, "per-cell"), "h2": (1, 0, 5.0, "compute_budget"), "h3": (0, 0, None, "no record"),
                   "h4": (2, 1, 7.0, "per-cell + budget"), "total": (5, 3, 14.0, None)}


def test_heat_rounds_half_to_even(rows):
    df = rows([(0.5 / 60,), (1.5 / 60,), (2.0,), (-1.0,)], "v double")
    assert [r.s for r in df.select(R.heat_intensity(F.col("v")).alias("s")).collect()] == [0, 2, 60, 0]
