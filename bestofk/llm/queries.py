"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bestofk.llm import bpe, decontamination, hardneg, html, lexical, licenses, mixing, neardup, quality, sharding, substrings, toxicity, warc
from bestofk.llm.common import stored, table
from bestofk.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


@query("op1_compression_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


OP2_SQL = """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes from pages),
first as (select html, min(page_id) as first_id from p where payload_bytes >= 100 group by html)
select page_id, payload_bytes, sha256(p.html) as payload_digest,
       case when first_id < page_id then 'revisit' else 'response' end as record_type,
       case when first_id < page_id then first_id end as refers_to
from p left join first on p.html = first.html and payload_bytes >= 100
"""


@query("op2_warc_transactions", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = stored(warc.read_records(spark, path, payloads=False), "records")  # read once; digests are those of the bytes read
    captures = warc.with_full_payload(warc.assemble(records))
    return captures.select(
        "page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_sha256").alias("payload_digest"),
        F.col("kind").alias("record_type"), F.col("refers_page").alias("refers_to"),
    )


@query("op3_bayes_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_decision_list")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_capitals", "n_exclamations"
    )


@query("op5_rare_token_licenses")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op7_fm_index_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


@query("op8_block_rules_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query("op6_label_propagation_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


SQL_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

# The seats by brute force: every quotient of every source, sorted.
OP10_SQL = rf"""
with d as (
  select doc_id, len({SQL_WORDS})::bigint as size, md5('0|' || coalesce(doc_id::varchar, '')) as mark,
         case when source is null then '1' else '0' || source end as key
  from documents),
s0 as (select key, sum(size)::bigint as source_size from d group by key),
s1 as (select *, row_number() over (order by key) - 1 as place from s0),
s2 as (select *, (place % 3 + 1)::double as weight, source_size * 3.0::double as full_size from s1),
s3 as (select *, full_size / weight as level from s2),
s4 as (select *, sum(source_size) over () - coalesce(sum(full_size) over (order by level, key rows between unbounded preceding and 1 preceding), 0.0) as rest,
              sum(weight) over (order by level, key rows between current row and unbounded following) as open_weight from s3),
s5 as (select *, rest / open_weight as share, rest / open_weight > level as is_full from s4),
s6 as (select key, source_size, place, greatest(1, source_size // 16) as n_blocks,
              case when is_full then full_size else weight * (select arg_min(share, (level, place)) from s5 where not is_full) end as target from s5),
house as (select round(sum(target) / 16)::bigint as seats from s6),
quotients as (select key, place, step, target / (2 * step - 1) as quotient from s6, unnest(range(1, (target / 16)::bigint + 40)) as u(step)),
seated as (select key, count(*) as won from
  (select key, row_number() over (order by quotient desc, place, step) as rank from quotients) where rank <= (select seats from house) group by key),
q as (select s6.*, least(coalesce(won, 0), 3 * n_blocks) as quota,
             case when n_blocks % 1000003 <> 0 then 1000003 else 1000033 end as step,
             ('0x' || substr(md5('0|' || key), 1, 7))::bigint as shift
      from s6 left join seated using (key)),
laid as (select d.*, q.* exclude (key), coalesce(sum(size) over (partition by key order by mark, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
         from d join q using (key)),
cut as (select doc_id, mark, size, start, quota, n_blocks, source_size, unnest(range(least(start // 16, n_blocks - 1), least((start + size - 1) // 16, n_blocks - 1) + 1)) as j, step, shift
        from laid where size > 0),
partial as (select mark, start, sum(least(start + size, case when j = n_blocks - 1 then source_size else (j + 1) * 16 end) - greatest(start, j * 16)) as extra_words
         from cut where (j * step + shift) % n_blocks < quota % n_blocks group by mark, start)
select l.doc_id, l.size, l.source_size, l.target, (l.quota // l.n_blocks * l.size + coalesce(case when l.size > 0 then extra_words end, 0))::bigint as taken
from laid l left join partial using (mark, start)
"""


@query("op9_cgk_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_source_mix", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op11_byte_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


# All pairs of anchors and rows.
OP12_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as vec, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label
  from embeddings
  where label is not null and embedding is not null and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)),
pairs as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
         list_sum(list_transform(list_zip(a.vec, b.vec), lambda x: x[1] * x[2]))::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (select * from pairs where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, p.other_id as positive_id, row_number() over (partition by p.anchor_id, p.other_id order by n.score desc, n.other_id)::int as rank,
       n.other_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same and 80 * p.score <= 100 * n.score and n.score <= p.score
qualify rank <= 5
"""


@query("op12_one_bit_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(vectors.withColumn("label", changed), F.col("vec_id") % 100 == 0)


SQL_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

# Every posting of every item term.
OP13_SQL = f"""
with d as (select doc_id, {SQL_TERMS} as terms from documents where text is not null),
sized as (select doc_id, terms, len(terms)::bigint as n from d where len(terms) > 0),
whole as (select count(*)::bigint as docs, sum(n)::bigint as terms from sized),
asked as (select item_id, term, count(*)::bigint as times from (select item_id, unnest({SQL_TERMS}) as term from benchmark) group by all),
postings as (select doc_id, n, term, count(*)::bigint as tf from (select doc_id, n, unnest(terms) as term from sized)
             where term in (select term from asked) group by all),
weights as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from postings, whole group by term, docs),
gains as (select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))) as gain
          from postings join weights using (term), whole),
scored as (select item_id, doc_id, sum(times * gain)::bigint as score from asked join gains using (term) group by all)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 20
"""


@query("op13_nra_search", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
