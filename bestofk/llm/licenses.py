"""License scans: a positional index of rare licence words.

One scan keeps, per text, the word count and the hits: words of the licence vocabulary with their positions. How many texts
hold a word gives its IDF. Each text looks up its rarest licence words in the index of the templates; a posting says
where the word stands in which template, so every hit votes for (template, start), and starts that several rare words agree on are
candidates. A candidate counts if the template's key phrase stands where it must and enough of its words do. Native functions only; a text with any number of hits is
spread over tasks by (text, template, start).

Fixed phrases are found in the hits alone, as consecutive positions.

Defined cases: a null text is empty: no words, no labels, score 0; repeated rows are scanned each for itself; an empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bestofk.session import materialise

#: Runs of characters that separate words; capital letters A-Z belong to words and are folded later.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Fixed wording of public licence notices: label, notice, key phrase.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("gpl", "licensed under the gnu general public license version", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license version", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license version", "gnu affero general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc0", "released under cc0 1 0 universal public domain dedication", "public domain dedication"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("eupl", "licensed under the european union public licence", "european union public licence"),
)
VOCABULARY = sorted({w for phrase in PHRASES for w in phrase.split()} | {w for _, notice, _ in TEMPLATES for w in notice.split()})
WORD_ID = {w: i for i, w in enumerate(VOCABULARY)}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def find_hits(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, hits: array of (w, at), w the number of a licence word, at its position; in the order of positions."""
    words = F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), GAP), "")
    ids = F.create_map(*[x for w, i in WORD_ID.items() for x in (F.lit(w), F.lit(i))])
    base = docs.select("doc_id", words.alias("words")).withColumn("n_words", F.size("words").cast("long"))
    placed = F.filter(
        F.transform("words", lambda w, i: F.when(w.isin(VOCABULARY), F.struct(w.alias("word"), i.alias("at")))), lambda x: x.isNotNull()
    )
    hits = F.transform(placed, lambda x: F.struct(F.element_at(ids, x["word"]).alias("w"), x["at"].alias("at")))
    return base.select("doc_id", "n_words", hits.alias("hits"))


def phrase_starts(phrase: str) -> Column:
    """Positions in ``hits`` where the words of ``phrase`` stand one after the other."""
    ids = [WORD_ID[w] for w in phrase.split()]

    def stands(x: Column, k: Column) -> Column:
        ok = x["w"] == ids[0]
        for step, w in enumerate(ids[1:], 1):
            other = F.get("hits", k + step)
            ok = ok & F.coalesce((other["w"] == w) & (other["at"] == x["at"] + step), F.lit(False))
        return ok

    return F.transform(F.filter("hits", stands), lambda x: x["at"])


def _idf(hits: DataFrame) -> list[float]:
    """IDF of every licence word over all texts; one number per word of the fixed vocabulary."""
    found = hits.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    counts = {r["w"]: r["n"] for r in found.collect()}
    total = hits.count()
    return [math.log((1 + total) / (1 + counts.get(i, 0))) for i in range(len(VOCABULARY))]


def match_templates(hits: DataFrame, *, rare_words: int = 2, min_cover: float = 0.6) -> DataFrame:
    """rid, label, cover for each template found in a text; ``hits`` has a row number rid.

    cover is the IDF share of the template's words that stand where they should, 1 for the whole notice.
    """
    spark = hits.sparkSession
    idf = _idf(hits)
    keys = {t: (notice.split(), key.split()) for t, (_, notice, key) in enumerate(TEMPLATES)}
    postings = []  # the rarest places of every key phrase: a notice cannot be found without them
    for t, (notice, key) in keys.items():
        first = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
        rarest = sorted(range(first, first + len(key)), key=lambda p: (-idf[WORD_ID[notice[p]]], p))[:rare_words]
        postings += [(WORD_ID[notice[p]], t, p, len(rarest)) for p in rarest]
    index = spark.createDataFrame(postings, "w int, template int, place int, needed int")
    weight = F.get(F.array(*[F.lit(x) for x in idf]), F.col("w"))
    rare = sorted({w for w, *_ in postings})
    looked_up = (
        hits.where(F.size("hits") > 1)
        .select("rid", F.explode(F.filter("hits", lambda h: h["w"].isin(rare))).alias("h")).select("rid", "h.w", "h.at")
    )
    candidates = (
        looked_up.join(F.broadcast(index), "w").withColumn("start", F.col("at") - F.col("place"))
        .groupBy("rid", "template", "start", "needed").agg(F.count("*").alias("votes")).where("votes = needed").drop("votes", "needed")
    )
    wanted = []
    for t, (notice, key) in keys.items():
        first = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
        wanted += [(t, WORD_ID[w], p, first <= p < first + len(key)) for p, w in enumerate(notice)]
    wanted = spark.createDataFrame(wanted, "template int, w int, place int, must boolean").withColumn("weight", weight)
    total = wanted.groupBy("template").agg(F.sum("weight").alias("all_weight"), F.count_if("must").alias("all_must"))
    expected = candidates.join(F.broadcast(wanted), "template").select("rid", "template", "start", "w", (F.col("start") + F.col("place")).alias("at"), "must", "weight")
    there = hits.where(F.size("hits") > 1).select("rid", F.explode("hits").alias("h")).select("rid", "h.w", "h.at")
    verified = (
        expected.join(there, ["rid", "w", "at"]).groupBy("rid", "template", "start")
        .agg(F.sum("weight").alias("found_weight"), F.count_if("must").alias("found_must"))
        .join(F.broadcast(total), "template").withColumn("cover", F.least(F.lit(1.0), F.col("found_weight") / F.greatest("all_weight", F.lit(1e-9))))
        .where((F.col("found_must") == F.col("all_must")) & (F.col("cover") >= min_cover))
    )
    labels = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    return verified.select("rid", F.get(labels, F.col("template")).alias("label"), "cover")


def scan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per text."""
    hits = materialise(find_hits(docs).withColumn("rid", F.monotonically_increasing_id()), "hits")
    found = match_templates(hits, **options).groupBy("rid").agg(F.collect_set("label").alias("own"), F.max("cover").alias("cover"))
    starts = {label: phrase_starts(phrase) for phrase, label in PHRASES.items()}
    base = hits.withColumns({f"at_{i}": s for i, s in enumerate(starts.values())})
    every = F.concat(*[F.col(f"at_{i}") for i in range(len(starts))])
    present = F.array_compact(F.array(*[F.when(F.size(f"at_{i}") > 0, F.lit(label)) for i, label in enumerate(starts)]))
    base = base.withColumn("every", every).withColumn("base", present).select("rid", "doc_id", "n_words", "every", "base")
    join = lambda labels: F.array_join(F.array_sort(labels), ",")
    return base.join(found, "rid", "left").select(
        "doc_id", "n_words", F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"),
        join(F.col("base")).alias("base_labels"), join(F.array_union("base", F.coalesce("own", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(F.size("base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )
