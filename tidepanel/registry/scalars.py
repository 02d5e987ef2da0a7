"""Column expressions on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel import functions as fn
from tidepanel.plans import spread
from tidepanel.registry.base import query, rnd, rounded
from tidepanel.sources.star_panels import epoch_millis, table


@query("c1_pct_change", f"""select c_custkey,
  {rnd('(c_acctbal - c_custkey % 5) / abs(nullif(c_custkey % 5, 0))', 9)} as change,
  {rnd('(c_custkey % 5 - c_acctbal) / abs(nullif(c_acctbal, 0))', 9)} as reverse
from customer""")
def c1_pct_change(spark, folder):
    start = (F.col("c_custkey") % 5).cast("double")
    rows = table(spark, folder, "customer").select(
        "c_custkey",
        fn.pct_change(start, F.col("c_acctbal")).alias("change"),
        fn.pct_change(F.col("c_acctbal"), start).alias("reverse"),
    )
    return rounded(rows, "change", "reverse", digits=9)


@query("c2_cagr", f"""select c_custkey,
  {rnd('''case when c_acctbal > 0 and c_custkey > 0 and c_custkey % 7 > 0
         then power(c_acctbal / c_custkey, 1.0 / (c_custkey % 7)) - 1 end''', 9)} as growth
from customer""")
def c2_cagr(spark, folder):
    key = F.col("c_custkey").cast("double")
    rows = table(spark, folder, "customer").select(
        "c_custkey", fn.cagr(key, F.col("c_acctbal"), F.col("c_custkey") % 7).alias("growth")
    )
    return rounded(rows, "growth", digits=9)


@query("c3_clean_dash", """select o_orderkey,
  nullif(case o_orderpriority when '4-NOT SPECIFIED' then '-' when '5-LOW' then ' - '
         else o_orderpriority end, '-') as cleaned
from orders""")
def c3_clean_dash(spark, folder):
    priority = F.col("o_orderpriority")
    raw = F.when(priority == "4-NOT SPECIFIED", "-").when(priority == "5-LOW", " - ").otherwise(priority)
    return table(spark, folder, "orders").select("o_orderkey", fn.clean_dash(raw).alias("cleaned"))


@query("c4_as_int", """select o_orderkey,
  cast(trunc(case when o_orderstatus = 'P' then null else o_totalprice end) as integer) as whole,
  cast(trunc(-o_totalprice) as integer) as negative
from orders""")
def c4_as_int(spark, folder):
    price = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        fn.as_int(F.when(F.col("o_orderstatus") != "P", price)).alias("whole"),
        fn.as_int(-price).alias("negative"),
    )


@query("c5_dotnet_dates", """select o_orderkey,
  case when o_orderstatus = 'P' then 0 else epoch_ms(o_orderdate) end as millis,
  case when o_orderstatus = 'P' then null
       else strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as stamp
from orders""")
def c5_dotnet_dates(spark, folder):
    millis = epoch_millis("o_orderdate").cast("string")
    raw = F.when(F.col("o_orderstatus") == "P", F.lit("no date")).otherwise(
        F.concat(F.lit("/Date("), millis, F.lit(")/"))
    )
    return table(spark, folder, "orders").select(
        "o_orderkey",
        fn.dotnet_millis(raw).alias("millis"),
        F.date_format(
            F.to_utc_timestamp(fn.dotnet_timestamp(raw), F.current_timezone()), "yyyy-MM-dd HH:mm:ss"
        ).alias("stamp"),
    )


@query("c7_text_match", """select doc_id, contains(lower(text), 'tion') as has_fragment,
  starts_with(lower(text), 'the') as has_prefix, lang in ('en', 'fr') as in_list,
  contains(lower(source), 'src1') or contains(lower(lang), 'e') as in_any
from documents""")
def c7_text_match(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        fn.contains_text(F.col("text"), "TION").alias("has_fragment"),
        fn.starts_with_text(F.col("text"), "The").alias("has_prefix"),
        fn.equals_any(F.col("lang"), ["en", "fr"]).alias("in_list"),
        (fn.contains_text(F.col("source"), "src1") | fn.contains_any([F.col("lang")], "E")).alias("in_any"),
    )


DIRTY = "'  Çé-' || c_name || chr(160) || '_' || lower(c_mktsegment) || ' & Åland/ñ,Østfold. '"
FOLDED = (
    "upper('Ce-' || c_name || ' ' || '_' || lower(c_mktsegment) || ' & Aland/n,Østfold.')"
)


@query("n1_lookup_keys", f"""select c_custkey,
  trim(regexp_replace({FOLDED}, '\\s+', ' ', 'g')) as alias,
  trim(regexp_replace({FOLDED}, '[\\s\\-_]+', ' ', 'g')) as label,
  trim(regexp_replace({FOLDED}, '[\\s\\-_/&,.]+', ' ', 'g')) as curated,
  strip_accents(c_mktsegment || 'áÀñÇü') as folded
from customer""")
def n1_lookup_keys(spark, folder):
    dirty = F.concat(
        F.lit("  Çé-"), "c_name", F.lit("\u00a0_"), F.lower("c_mktsegment"),
        F.lit(" & Åland/ñ,Østfold. "),
    )
    return spread(table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")).select(
        "c_custkey",
        fn.alias_key(dirty).alias("alias"),
        fn.group_key(dirty).alias("label"),
        fn.label_key(dirty).alias("curated"),
        fn.fold_marks(F.concat("c_mktsegment", F.lit("áÀñÇü"))).alias("folded"),
    )
