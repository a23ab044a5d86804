"""Helpers the operators share: words, exact ranks without one large window, table access."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bestofk.session import shared_dir

#: What separates words, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Writes ``df``, well packed, to the shared folder and reads it back; then lets go of the shuffle files of finished steps.

    Spark deletes them once nothing refers to them, which it notices when the driver collects its garbage.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null counts as the empty text."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text, F.octet_length(text)).alias("b"))


#: Bits of a sieve per row (at least), and of a sieve at most: it stays small enough to be broadcast.
SIEVE_BITS_PER_ROW, SIEVE_BITS = 16, 1 << 26
#: Bits of one of Spark's bitmaps.
BITMAP = 1 << 15


def sieved(df: DataFrame, wanted: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Adds ``out``: false for rows whose ``keys`` surely are not in ``wanted``, a stored table; true for all others, some of which are not in it either.

    ``wanted`` becomes a bitmap over hashes, so that what a join would drop need not be shuffled for it. Nulls are values like any other.
    """
    bits = BITMAP
    while bits < min(SIEVE_BITS, SIEVE_BITS_PER_ROW * wanted.count()):
        bits *= 2
    place = F.pmod(F.xxhash64(*keys), F.lit(bits).cast("bigint"))
    number, bitmap = fresh(df, "bitmap_number"), fresh(df, "bitmap")
    at = wanted.select(F.floor(place / BITMAP).alias(number), (place % BITMAP).alias("bit"))
    bitmaps = stored(at.groupBy(number).agg(F.bitmap_construct_agg("bit").alias(bitmap)), "sieve")
    tested = df.withColumn(number, F.floor(place / BITMAP)).join(bitmaps, number, "left")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), ((place % BITMAP) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return tested.withColumn(out, F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop(number, bitmap)


def running_start(
    df: DataFrame, keys: list[str], bucket: str, order: list[Column], weight: str, out: str
) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over the rows before this one within ``keys``.

    The order is (``bucket``, ``order``). Only the rows of one (keys, bucket) meet in a task, so the caller
    sizes the buckets; what crosses buckets is one sum per bucket. Keys and bucket must not be null.
    Rows that tie in the whole order must be interchangeable.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offset = fresh(df, "bucket_start")
    starts = (
        df.groupBy(*keys, bucket).agg(F.sum(weight).alias(offset))
        .withColumn(offset, F.coalesce(F.sum(offset).over(before), F.lit(0)))
    )
    ranked = df.withColumn(out, F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return ranked.join(starts, [*keys, bucket]).withColumn(out, F.col(out) + F.col(offset)).drop(offset)
