"""The operators of this subpackage as queries on the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import (
    alignment, decontaminate, html_text, mixing, nearest, pieces, prefix_trie, quality, secrets_scan, sharding,
    simhash, suffixes, tokens,
)
from tidepanel.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_secret_scan")
def op1_secret_scan(spark, folder):
    found = secrets_scan.secret_spans(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets_scan.BASE))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in secrets_scan.BASE],
        F.sha2(secrets_scan.digest(base).cast("binary"), 256).alias("base_sha256"),
        secrets_scan.digest(F.col("spans")).alias("spans"))


@query("op2_benchmark_decontamination")
def op2_benchmark_decontamination(spark, folder):
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_quality_classifier")
def op3_quality_classifier(spark, folder):
    docs = table(spark, folder, "documents")
    model = quality.train(docs, table(spark, folder, "labels"))
    return quality.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark, folder):
    return simhash.simhash_components(table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_html_extraction")
def op5_html_extraction(spark, folder):
    return html_text.extracted(table(spark, folder, "pages")).select("page_id", "text")


@query("op6_sharding")
def op6_sharding(spark, folder):
    written = sharding.write_shards(table(spark, folder, "documents").select("doc_id", "text"))
    return written.select(
        "record.doc_id", sharding.record_size(F.col("record.text")).alias("size"),
        F.crc32(F.coalesce("record.text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


NEAREST_SQL = """with usable as (
  select vec_id, [x::double for x in embedding] as v from embeddings
  where vec_id is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
    and len([x for x in embedding if x <> 0]) > 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v) as score
  from usable q join usable c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank,
       vec_id, score
from pairs qualify rank <= 20"""


@query("op7_nearest_neighbours", NEAREST_SQL)
def op7_nearest_neighbours(spark, folder):
    return nearest.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % nearest.EVERY == 0)


@query("op8_token_output")
def op8_token_output(spark, folder):
    index = tokens.write_training_order(table(spark, folder, "documents"))
    return tokens.read_back(index).select("doc_id", "slot", "shard", "start", "n_tokens", "read_crc32")


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark, folder):
    return suffixes.removals(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


SIZE = "coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)"


@query("op9_source_mixing", f"""with sized as (
  select doc_id, source, {SIZE} as size,
         cast('0x' || substr(md5(concat_ws(':', cast(doc_id as varchar), md5(coalesce(text, '')))), 1, 12)
              as bigint) as hash
  from documents),
sizes as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
weighed as (
  select *, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3) + 1]::double as weight
  from sizes),
levels as (
  select *, (1.5::double * sum(source_size) over ()
             - 2.0::double * coalesce(sum(source_size) over poorest, 0))
            / (sum(weight) over () - coalesce(sum(weight) over poorest, 0.0)) as level
  from weighed
  window poorest as (order by source_size / weight, source nulls last
                     rows between unbounded preceding and 1 preceding)),
final as (
  select source, source_size,
         least(coalesce(arg_min(level, source_size / weight) filter (
                 where level * weight <= 2.0::double * source_size) over () * weight, 'inf'::double),
               2.0::double * source_size) as target
  from levels),
goals as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as copies
  from final),
sums as (
  select source, hash, sum(size) as held,
         sum(sum(size)) over (partition by source order by hash) as upto
  from sized where size > 0 group by source, hash),
cut as (
  select s.source, s.hash, upto <= target - copies * source_size
         or (upto - held <= target - copies * source_size
             and upto - (target - copies * source_size) < (target - copies * source_size) - (upto - held)) as more
  from sums s join goals g on s.source is not distinct from g.source)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(case when size > 0 then size * (copies + case when more then 1 else 0 end) else 0 end as bigint) as taken
from sized join goals on sized.source is not distinct from goals.source
left join cut on cut.source is not distinct from sized.source and cut.hash = sized.hash""")
def op9_source_mixing(spark, folder):
    return mixing.mix_sources(table(spark, folder, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"))


@query("op11_sentencepiece")
def op11_sentencepiece(spark, folder):
    return pieces.encoded(table(spark, folder, "documents")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op12_token_alignment")
def op12_token_alignment(spark, folder):
    found = alignment.aligned(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
        .alias("groups_sha256"))


@query("op13_prefix_trie")
def op13_prefix_trie(spark, folder):
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))
