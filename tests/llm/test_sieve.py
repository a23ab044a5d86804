"""Rows that a join would drop are told apart before it."""

from __future__ import annotations

from pyspark.sql import functions as F

from bestofk.llm.common import sieved, stored
from bestofk.llm.neardup import distinct_documents


def test_sieve_keeps_every_wanted_row_and_few_others(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 101 != 0, F.col("id")).alias("doc_id"), F.xxhash64("id").alias("text_a"), F.lit(1).alias("bitmap"))
    wanted = stored(rows.where("text_a % 10 = 0"), "wanted").drop("bitmap")
    got = sieved(rows, wanted, ["doc_id", "text_a"], "maybe")
    assert got.columns == ["doc_id", "text_a", "bitmap", "maybe"] and got.count() == 20_000
    kept = got.where("maybe")
    assert kept.where("text_a % 10 = 0").count() == wanted.count() > 0
    assert kept.where("text_a % 10 <> 0").count() < 2_000
    assert sieved(rows, wanted.limit(0), ["doc_id", "text_a"], "maybe").where("maybe").count() == 0


def test_untouched_texts_are_not_joined(spark):
    """Copies leave, the other rows come through beside the join; rows without ids stay."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        docs = spark.range(3_000).select(
            F.when(F.col("id") < 2_990, F.col("id")).alias("doc_id"),
            F.concat_ws(" ", *[F.md5(F.concat_ws("-", F.when(F.col("id") >= 100, F.col("id")).otherwise(F.floor(F.col("id") / 2)), F.lit(i))) for i in range(12)]).alias("text"))
        docs = stored(docs, "docs")
        kept = distinct_documents(docs)
        assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [*range(0, 100, 2), *range(100, 2_990)]
        assert kept.where("doc_id is null").count() == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
