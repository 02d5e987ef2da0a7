"""Selections, star joins, latest and as-of values, extracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.model import Selection
from tidepanel.operators import select as ops
from tidepanel.operators.summarize import data_availability, fill_requested
from tidepanel.registry.base import (
    CUSTOMER,
    CUSTOMER_ENTITIES,
    CUSTOMER_MEMBERS,
    DATA,
    EVENTS,
    LATEST,
    NATION,
    NOTES,
    PARTS,
    PARTS_BOOK,
    STAR,
    query,
    rnd,
    rounded,
)
from tidepanel.sources import star_panels as star

MONEY = Selection(region="Americas", income="LMIC", start=1996, end=2000)
BOOK_COLUMNS = (
    "indicator_code, indicator_name, long_code, category_1, category_2, unit, currency, "
    "measurement_method"
)


@query("f1_select_observations", f"""{PARTS}
select entity_code, period, indicator_code, value from obs join ent using (entity_code)
where region = 'EUR' and income in ('Lower-middle', 'Upper-middle') and period >= 1998""")
def f1_select_observations(spark, folder):
    panel = star.parts_panel(spark, folder)
    sel = Selection(region="european region", income="middle income", start=1998)
    return ops.select_observations(panel, None, sel).select(
        "entity_code", "period", "indicator_code", "value"
    )


@query("f2_indicator_data", f"""{CUSTOMER}
select {DATA} from {STAR}
where indicator_code = 'rev' and region = 'AMR' and income <> 'High' and period between 1996 and 2000""")
def f2_indicator_data(spark, folder):
    return ops.indicator_data(star.customer_panel(spark, folder, ["rev"]), "rev", MONEY)


@query("w1_latest_per_entity", f"""{CUSTOMER}
select {DATA} from {STAR} qualify {LATEST}""")
def w1_latest_per_entity(spark, folder):
    return ops.latest_per_entity(star.customer_panel(spark, folder))


@query("w1_latest_many_indicators", f"""{PARTS}
select indicator_code, entity_code, period, value from obs
where entity_code in (select entity_code from ent) and period <= 2000
qualify {LATEST}""")
def w1_latest_many_indicators(spark, folder):
    return ops.latest_observations(star.parts_panel(spark, folder), None, Selection(end=2000))


@query("j1_join_entities", f"""{CUSTOMER}
select entity_code, period, indicator_code, value, entity_name, region, income
from obs join ent using (entity_code) where region <> 'EUR'""")
def j1_join_entities(spark, folder):
    panel = star.customer_panel(spark, folder)
    return ops.join_entities(panel.observations, panel.entities.where("region <> 'EUR'"))


@query("j2_join_codebook", f"""{PARTS}
select {BOOK_COLUMNS}, entity_code, period, value from obs left join book using (indicator_code)""")
def j2_join_codebook(spark, folder):
    panel = star.parts_panel(spark, folder)
    return ops.join_codebook(panel.observations, panel.indicators)


@query("j3_members_only", f"""{CUSTOMER}, {CUSTOMER_MEMBERS}
select entity_code, period, indicator_code, value from obs
where entity_code in (select entity_code from members where group_code = 'OECD')""")
def j3_members_only(spark, folder):
    panel = star.customer_panel(spark, folder)
    members = panel.group_members.where("group_code = 'OECD'")
    return ops.members_only(panel.observations, members)


@query("j4_fill_requested", """with wanted(event_type) as (
  values ('click'), ('view'), ('purchase'), ('refund'), ('share')),
found as (
  select event_type, count(*) as n, count(distinct user_id) as users, max(value) as top
  from events group by event_type)
select event_type, coalesce(n, 0) as n, coalesce(users, 0) as users, top
from wanted left join found using (event_type)""")
def j4_fill_requested(spark, folder):
    per_user = star.table(spark, folder, "events").groupBy("event_type", "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("top")
    )
    found = per_user.groupBy("event_type").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("users"), F.max("top").alias("top")
    )
    codes = ["click", "view", "purchase", "refund", "share"]
    return fill_requested(spark, codes, found, "event_type", ["n", "users"])


@query("j7_as_of_values", f"""{CUSTOMER}
select indicator_code, entity_code, period, value from obs
where period <= 1999 and indicator_code in ('rev', 'rev_r', 'n_items') qualify {LATEST}""")
def j7_as_of_values(spark, folder):
    codes = ["rev", "rev_r", "n_items"]
    return ops.as_of_values(star.customer_panel(spark, folder, codes), codes, 1999)


@query("j7_as_of_requests", f"""{CUSTOMER},
asked as (
  select o_orderkey, cast(o_custkey as varchar) as entity_code, year(o_orderdate)::int - o_orderkey % 3 as period,
    case o_orderkey % 4 when 0 then 'rev' when 1 then 'n_items' when 2 then 'rev_r_rev' else 'rev_x' end as indicator_code
  from orders)
select a.o_orderkey, a.entity_code, a.indicator_code, cast(a.period as integer) as period, o.period as found_period,
  {rnd('o.value')} as value
from asked a asof left join obs o
  on a.indicator_code = o.indicator_code and a.entity_code = o.entity_code and a.period >= o.period""")
def j7_as_of_requests(spark, folder):
    key = F.col("o_orderkey")
    code = (F.when(key % 4 == 0, "rev").when(key % 4 == 1, "n_items").when(key % 4 == 2, "rev_r_rev")
            .otherwise("rev_x"))
    asked = star.table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("entity_code"),
        (F.year("o_orderdate") - key % 3).cast("int").alias("period"), code.alias("indicator_code"))
    return rounded(ops.as_of_requests(star.customer_panel(spark, folder), asked), "value")


@query("w2_entity_profile", f"""{CUSTOMER},
wanted(indicator_code, position) as (values ('rev', 0), ('rev_x', 1), ('rev_r_rev', 2), ('n_items', 3)),
past as (select * from obs where period <= 1997 qualify {LATEST})
select {DATA}, position
from ent cross join wanted left join past using (entity_code, indicator_code)
left join book using (indicator_code)""")
def w2_entity_profile(spark, folder):
    codes = ["rev", "rev_x", "rev_r_rev", "n_items"]
    panel = star.customer_panel(spark, folder, ["rev", "rev_r_rev", "n_items"])
    return ops.entity_profile(panel, codes, 1997)


@query("p1_compare_entities", f"""{NATION}
select {DATA} from {STAR}
where indicator_code = 'rev' and period >= 1997
  and entity_code in ('COL', 'PER', 'BRA', 'HTI', 'VNM', 'USA', 'GBR', 'TUR')""")
def p1_compare_entities(spark, folder):
    named = Selection(entities=["Viet Nam", "US", "gbr", "Türkiye"], group="Latin America", start=1997)
    return ops.compare_entities(star.nation_panel(spark, folder, ["rev"]), "rev", named)


@query("p2_research_panel", f"""{CUSTOMER}
select {DATA} from {STAR} where indicator_code in ('rev', 'rev_r_rev') and period >= 1999""")
def p2_research_panel(spark, folder):
    codes = ["rev", "rev_r_rev"]
    panel = star.customer_panel(spark, folder, codes)
    return ops.research_panel(panel, codes, Selection(start=1999))


@query("p3_compare_group", f"""{CUSTOMER}, {CUSTOMER_MEMBERS}
select {DATA} from {STAR}
where indicator_code = 'rev' and income = 'High'
  and entity_code in (select entity_code from members where group_code = 'SSA')
qualify {LATEST}""")
def p3_compare_group(spark, folder):
    panel = star.customer_panel(spark, folder, ["rev"])
    return ops.compare_group(panel, "rev", Selection(group="Sub-Saharan Africa", income="HIC"))


PIVOTED = [code for code, _ in star.NATIONS]


@query("p4_pivot_panel", f"""{NATION}
select period, {', '.join(f"max(value) filter (where entity_code = '{c}') as {c}" for c in PIVOTED)}
from obs where indicator_code = 'rev' group by period""")
def p4_pivot_panel(spark, folder):
    panel = star.nation_panel(spark, folder, ["rev"])
    return ops.pivot_panel(panel.observations.where("indicator_code = 'rev'"), PIVOTED)


@query("o1_ordered_page", """select c_custkey, c_name, c_acctbal from customer
order by c_acctbal desc, c_custkey limit 25 offset 10""")
def o1_ordered_page(spark, folder):
    rows = star.table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    return ops.ordered_page(rows, [F.desc("c_acctbal"), F.asc("c_custkey")], 25, 10)


@query("u1_combine_keys", f"""with {CUSTOMER_ENTITIES}, {CUSTOMER_MEMBERS},
named as (
  select entity_code from ent where region = 'AMR'
  union select entity_code from members where group_code = 'LDC')
select 'union' as how, entity_code from named
union all
select 'intersect', entity_code from ent
where income = 'Low' and entity_code in (select entity_code from members where group_code = 'LDC')
union all
select 'union_all', entity_code from ent where region = 'AMR'
union all
select 'union_all', entity_code from members where group_code = 'LDC'""")
def u1_combine_keys(spark, folder):
    entities = star.customer_entities(spark, folder)
    members = star.customer_memberships(spark, folder).where("group_code = 'LDC'")
    americas, low = entities.where("region = 'AMR'"), entities.where("income = 'Low'")
    parts = [
        ops.combine_keys([americas, members], "union").withColumn("how", F.lit("union")),
        ops.combine_keys([low, members], "intersect").withColumn("how", F.lit("intersect")),
        ops.combine_keys([americas, members], "union_all").withColumn("how", F.lit("union_all")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- codebook and notes ----------------------------------------------------------------------------------


@query("f3_list_indicators", f"""with {PARTS_BOOK}
select {BOOK_COLUMNS} from book where category_1 = 'ECONOMY'
order by indicator_code limit 40 offset 5""")
def f3_list_indicators(spark, folder):
    return ops.list_indicators(star.parts_panel(spark, folder), "ECONOMY", skip=5, top=40)


@query("f3_list_indicators_rest", f"""with {PARTS_BOOK}
select {BOOK_COLUMNS} from book order by indicator_code offset 7""")
def f3_list_indicators_rest(spark, folder):
    return ops.list_indicators(star.parts_panel(spark, folder), skip=7)


ORDERED_FACTS = f"{CUSTOMER} select indicator_code, entity_code, period, {rnd('value')} as value from obs " \
    "order by period desc, entity_code, indicator_code"


def _page(spark, folder, top, skip):
    facts = star.customer_panel(spark, folder).observations
    order = [F.desc("period"), F.col("entity_code"), F.col("indicator_code")]
    page = ops.ordered_page(facts, order, top, skip)
    return rounded(page.select("indicator_code", "entity_code", "period", "value"), "value")


@query("o1_deep_page", f"{ORDERED_FACTS} limit 300 offset 9900")
def o1_deep_page(spark, folder):
    return _page(spark, folder, 300, 9900)


@query("o1_rest_of_rows", f"{ORDERED_FACTS} offset 500")
def o1_rest_of_rows(spark, folder):
    return _page(spark, folder, None, 500)


@query("f3_count_indicators", f"""with {PARTS_BOOK}
select count(*) as total from book where category_1 = 'ECONOMY'""")
def f3_count_indicators(spark, folder):
    return ops.count_indicators(star.parts_panel(spark, folder), "ECONOMY")


@query("f4_lookup_indicators", f"""with {PARTS_BOOK},
wanted as (select 'p' || l_partkey as indicator_code, count(*) as n_lines from lineitem group by 1)
select {BOOK_COLUMNS}, n_lines, b.indicator_code is not null as found
from wanted left join (select *, indicator_code as known from book) b using (indicator_code)"""
       .replace("b.indicator_code is not null", "b.known is not null"))
def f4_lookup_indicators(spark, folder):
    wanted = star.table(spark, folder, "lineitem").groupBy(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("indicator_code")
    ).agg(F.count(F.lit(1)).alias("n_lines"))
    return ops.lookup_indicators(star.parts_panel(spark, folder), wanted)


SEARCHED = (
    "concat_ws(chr(1), lower(indicator_code), lower(indicator_name), lower(long_code), "
    "lower(category_1), lower(category_2), lower(unit), lower(currency))"
)


@query("f5_search_indicators", f"""with {PARTS_BOOK}
select {BOOK_COLUMNS} from book where contains({SEARCHED}, 'hot')""")
def f5_search_indicators(spark, folder):
    return ops.search_indicators(star.parts_panel(spark, folder), "  HOT ")


@query("f5_search_indicators_batch", f"""with {PARTS_BOOK},
queries as (
  select distinct p_name || ' ' || left(cast(p_partkey as varchar), 2) as query from part
  union select distinct 'BRAND#' || p_size from part)
select query, indicator_code from queries, book where contains({SEARCHED}, lower(query))""")
def f5_search_indicators_batch(spark, folder):
    return searched_parts(spark, folder, star.parts_panel(spark, folder))


def searched_parts(spark, folder, panel):
    part = star.table(spark, folder, "part")
    key = F.substring(F.col("p_partkey").cast("string"), 1, 2)
    size = F.col("p_size").cast("string")
    queries = (
        part.select(F.concat_ws(" ", "p_name", key).alias("query"))
        .union(part.select(F.concat(F.lit("BRAND#"), size)))
        .distinct()
    )
    return ops.search_indicators_batch(panel, queries, "query")


@query("f6_select_notes", f"""with {NOTES}
select * from notes where indicator_code = 'rev'""")
def f6_select_notes(spark, folder):
    return ops.select_notes(star.customer_panel(spark, folder), code="rev")


@query("f9_select_by_topic", f"""{PARTS}
select entity_code, period, indicator_code, value from obs
where indicator_code in (select 'p' || p_partkey from part where p_type = 'ECONOMY')""")
def f9_select_by_topic(spark, folder):
    topics = star.table(spark, folder, "part").select(
        F.col("p_type").alias("topic_id"),
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("indicator_code"),
    )
    panel = star.parts_panel(spark, folder)
    return ops.select_by_topic(panel, "ECONOMY", topics).select(
        "entity_code", "period", "indicator_code", "value"
    )


@query("f10_indicator_cards", f"""with {PARTS_BOOK}
select indicator_code,
  '# ' || indicator_code || chr(10) || chr(10) || coalesce(indicator_name, '') || chr(10) || chr(10)
  || '- Long code: `' || coalesce(long_code, '') || '`' || chr(10)
  || '- Category: ' || coalesce(category_1, '') || ' / ' || coalesce(category_2, '') || chr(10)
  || '- Unit: ' || coalesce(unit, '') || chr(10) || '- Currency: ' || coalesce(currency, '')
  || case when measurement_method <> '' then
       chr(10) || chr(10) || '## Method of measurement' || chr(10) || measurement_method
     else '' end as card
from book""")
def f10_indicator_cards(spark, folder):
    return ops.indicator_cards(star.parts_panel(spark, folder))


@query("a1_data_availability", f"""{CUSTOMER},
wanted(indicator_code) as (values ('rev'), ('rev_r'), ('n_items'), ('rev_x')),
found as (
  select indicator_code, count(*) as observation_count, count(distinct entity_code) as entity_count,
         min(period) as first_period, max(period) as latest_period
  from obs join ent using (entity_code)
  where region = 'AMR' and income <> 'High' and period between 1996 and 2000
  group by indicator_code)
select indicator_code, coalesce(observation_count, 0) as observation_count,
       coalesce(entity_count, 0) as entity_count, first_period, latest_period
from wanted left join found using (indicator_code)""")
def a1_data_availability(spark, folder):
    panel = star.customer_panel(spark, folder, ["rev", "rev_r", "n_items"])
    return data_availability(panel, ["rev", "rev_r", "n_items", "rev_x"], MONEY)


@query("a1_availability_events", f"""{EVENTS}
select indicator_code, count(*) as observation_count, count(distinct entity_code) as entity_count,
       min(period) as first_period, max(period) as latest_period
from obs group by indicator_code""")
def a1_availability_events(spark, folder):
    return data_availability(star.events_panel(spark, folder))


@query("a1_availability_many_indicators", f"""{PARTS}
select indicator_code, count(*) as observation_count, count(distinct entity_code) as entity_count,
       min(period) as first_period, max(period) as latest_period
from obs where entity_code in (select entity_code from ent) group by indicator_code""")
def a1_availability_many_indicators(spark, folder):
    return data_availability(star.parts_panel(spark, folder))
