"""Queries against plain Python over the whole smallest tables, and WARC and mixing against SQL in tests/test_queries.py."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))

from bestofk.llm import components, decontamination, html, mixing, neardup, quality, queries, substrings, toxicity

SF_DIR = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF_DIR}/documents.parquet'").fetchall())


def run(spark, prefix):
    name = next(n for n in queries.QUERIES if n.startswith(prefix + "_"))
    return queries.QUERIES[name](spark, SF_DIR).collect()


def test_op3_links_and_classes(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = WORDS.findall(t or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links, root = collections.Counter(), {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                    links[a] += 1
                    links[b] += 1
                    root[max(top(a), top(b))] = min(top(a), top(b))
    assert {r.doc_id: (r.n_links, r.class_id) for r in run(spark, "op3")} == {i: (links[i], top(i)) for i in ids}


def test_op4_statistics(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op4")}
    for i, t in texts.items():
        w = WORDS.findall(t or "")
        seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeat = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeat))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def test_op4_learns_a_planted_rule(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        w = [f"w{rng.randrange(10**6)}" + ("#" if bad and k % 2 else "") for k in range(60)]
        rows.append((i, " ".join(w), int(not bad)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    got = {r.doc_id: r.kept for r in quality.judge(df.select("doc_id", "text"), df.select("doc_id", "quality")).collect()}
    assert got == {i: bool(q) for i, _, q in rows}


def test_op5_phrases(spark, texts):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = {r.doc_id: r for r in run(spark, "op5")}
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in at]
        base = sorted({label for _, label in at})
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(base))
        assert set(base) <= set(filter(None, r.labels.split(",")))


def test_op6_law_and_groups(spark, texts):
    got = run(spark, "op6")
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == len(texts) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    groups = collections.defaultdict(list)
    for r in got:
        groups[texts[r.doc_id]].append(r.shard)
    small = [set(g) for g in groups.values() if 1 < len(g) <= min(counts.values())]
    assert sum(len(g) == 1 for g in small) >= 0.9 * len(small)


def test_op7_first_occurrences(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, "op7")}
    seen: set = set()
    for i in sorted(texts):
        w = WORDS.findall(texts[i] or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        assert got[i] == (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())


def test_fm_index_counts_like_a_scan():
    rng = np.random.default_rng(3)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (50, 3, 80, 20)])
    index = substrings.FMIndex(text, 3)
    for length in (1, 2, 5, 20):
        for at in rng.integers(0, 50 - length, 12):
            low, high = np.array([0]), np.array([len(text)])
            for c in text[at : at + length][::-1]:
                low, high = index.extend(np.array([c]), low, high)
            count = sum(np.array_equal(text[k : k + length], text[at : at + length]) for k in range(len(text) - length + 1))
            assert high[0] - low[0] == count


def test_op9_edited_items_and_clean_texts():
    rng = random.Random(2)
    items = duckdb.sql(f"select item_id, text from '{SF_DIR}/benchmark.parquet'").fetchall()
    prepared = decontamination.prepare(items)
    filler = " ".join(f"f{rng.randrange(10**6)}" for _ in range(80))
    missed = 0
    for item_id, t in items:
        w = decontamination.normalise(t)
        for _ in range(int(0.2 * len(w))):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["odd"], [w[at], "odd"]])
        found = decontamination.find_in_text(f"{filler} {' '.join(w)} {filler}", prepared)
        missed += item_id not in {prepared.ids[k] for k, *_ in found}
        assert item_id in {prepared.ids[k] for k, *_ in decontamination.find_in_text(f"{filler} {t} {filler}", prepared)}
    assert missed <= 0.1 * len(items)
    assert decontamination.find_in_text(filler * 3, prepared) == []


def test_op9_whole_passages(spark, texts):
    items = [(i, " ".join(decontamination.normalise(t))) for i, t in duckdb.sql(f"select item_id, text from '{SF_DIR}/benchmark.parquet'").fetchall()]
    exact = {(d, i) for d, t in texts.items() for i, item in items if f" {item} " in f" {' '.join(decontamination.normalise(t))} "}
    got = {(r.doc_id, r.item_id): r.distance for r in run(spark, "op9")}
    assert exact <= set(got) and all(got[x] == 0 for x in exact)


def test_op1_held_out_accuracy():
    rng = random.Random(4)
    common = [f"w{rng.randrange(3000)}" for _ in range(3000)]
    bad = ["blasted", "wretched", "miserable", "rotten"]

    def text(toxic):
        w = [rng.choice(common) for _ in range(120)]
        for _ in range(4 * toxic):
            w[rng.randrange(120)] = rng.choice(bad)
        return " ".join(w)

    model = toxicity.fit([text(1) for _ in range(200)], [text(0) for _ in range(400)], 1 / 3)
    save = toxicity._saver(model.ordinary, model.toxic, model.settings.level)
    centre, scale, b = (np.array(v) for v in (model.centre, model.scale, model.coefficients))
    score = lambda t: b[0] + ((np.array(toxicity._features(t, save, model.settings)) - centre) / scale) @ b[1:]
    right = [(score(text(y)) >= 0) == bool(y) for y in [0, 1] * 150]
    assert np.mean(right) > 0.9


def test_op8_rules():
    prose = "The house stood on the hill and it was not far from the river that ran to the sea. "
    page = f"""<html><head><title>t</title><script>var a = "<p>x</p>";</script></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>
      <!-- <p>hidden</p> --><article><header><h1>A&nbsp;title &amp; more</h1></header><p>{prose * 3}<br>next <b>line</b><p>Short.</p>
      <div class="ad banner">Buy</div><ul><li><a href=y>other page</a></ul><form><input>Name</form></article>
      <section class="comments"><article><p>{prose * 4}</p></article></section><aside>{prose * 4}</aside><footer>{prose}</footer></body></html>"""
    assert html.main_text(page) == "A title & more\n\n" + " ".join((prose * 3).split()) + " next line\n\nShort."
    plain = f"<div><a href=a>one</a> <a href=b>two</a></div><div>{prose * 4}</div><div>Short one.</div><div>{prose * 4}</div>"
    assert html.main_text(plain).count("Short one.") == 1 and "one two" not in html.main_text(plain)
    assert html.main_text("<p>a <b>cut off") in ("", "a cut off")


def test_op10_targets_and_hot_source(spark):
    rows = [(i, "w " * 50, "hot" if i % 3 else f"s{i % 7}") for i in range(600)] + [(1000, "w " * 7, None), (1001, None, "s1")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), carry=["source"]).collect()
    by_source = collections.defaultdict(lambda: [0, 0.0])
    for r in got:
        by_source[r.carry_0][0] += r.taken
        by_source[r.carry_0][1] = r.target
        assert 0 <= r.taken <= 3 * r["size"] and r.target <= 3 * r.source_size + 1e-6
    assert all(abs(taken - target) <= 48 for taken, target in by_source.values())
    assert sum(t for _, t in by_source.values()) == pytest.approx(sum(r["size"] for r in got))


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 1200, dtype=np.uint64)
    a, b = np.unique(base[:1000]), np.unique(base[200:])
    same = (neardup.minhash(a) == neardup.minhash(b)).mean()
    assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.15


def test_op3_classes_without_ids(spark):
    """Links of texts whose rows all lack an id count, for them and for those linked with them; one of each group stays."""
    words = [f"word{i}" for i in range(60)]
    near = [" ".join([*words[:i], "other", *words[i:]]) for i in (2, 57)]
    rows = [(None, near[0]), (None, near[1]), (5, " ".join(words)), (None, "alone here with a few words of its own"), (None, near[0]), (5, "a second text of the same id, without a twin")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r.doc_id, r.class_id, r.n_links) for r in neardup.near_duplicates(docs).collect()]
    assert collections.Counter(got) == collections.Counter([(None, 5, 3)] * 3 + [(5, 5, 3), (5, 5, 0), (None, None, 0)])
    kept = sorted(r.text for r in neardup.distinct_documents(docs).collect())
    assert kept == sorted([rows[2][1], rows[3][1], rows[5][1]])
    nameless = docs.where("doc_id is null")
    kept = [r.text for r in neardup.distinct_documents(nameless).collect()]
    assert len(kept) == 2 and rows[3][1] in kept


def test_op10_every_shard_takes_its_own_quota(spark):
    """Per source and shard the words taken are its quota of whole blocks; laid out again here, block by block and seat by seat."""
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{i}" for _ in range(16 * rng.randrange(0, 7))), rng.choice(["a", "b", "c", None])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sizes = docs.groupBy(mixing.source_key(F.col("source")).alias("key")).agg(F.sum(F.size(mixing.words(F.col("text")))).alias("source_size"))
    quotas = {(r.key, r.shard): r.quota for r in mixing.shard_quotas(mixing.source_targets(sizes, (1, 2, 3), 3), 16, 3, 8).collect()}
    source = {i: "1" if s is None else "0" + s for i, _, s in rows}
    found = collections.Counter()
    for r in mixing.mix(docs).collect():
        assert len(r.by_shard) == 8 and sum(r.by_shard) == r.taken <= 3 * r.size
        for shard, taken in enumerate(r.by_shard):
            found[source[r.doc_id], shard] += taken
    assert {k: 16 * q for k, q in quotas.items()} == {k: found[k] for k in quotas} and len({q for q in quotas.values()}) > 2
