"""Entity, group and label resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.dims import fixed
from tidepanel.model import Selection
from tidepanel.operators import resolve as ops
from tidepanel.operators import select as select_ops
from tidepanel.registry.base import (
    CUSTOMER_ENTITIES,
    CUSTOMER_MEMBERS,
    NATION_ENTITIES,
    NATIONS,
    query,
    values_cte,
)
from tidepanel.sources import star_panels as star


def _pick(key: str, spellings) -> F.Column:
    """One of several spellings per row, by key."""
    listed = F.array(*[F.lit(text) for text in spellings])
    return F.element_at(listed, (F.col(key) % len(spellings) + 1).cast("int"))


def _pick_sql(key: str, spellings) -> str:
    whens = " ".join(f"when {i} then '{text}'" for i, text in enumerate(spellings))
    return f"case {key} % {len(spellings)} {whens} end"


def _customers(spark, folder):
    return star.table(spark, folder, "customer")


@query("a5_distinct_values", f"""with {CUSTOMER_ENTITIES}
select distinct region from ent where region is not null""")
def a5_distinct_values(spark, folder):
    return ops.distinct_values(star.customer_panel(spark, folder), "region")


@query("f7_list_entities", f"""with {CUSTOMER_ENTITIES}, {CUSTOMER_MEMBERS}
select entity_code, entity_name, region, income from ent
where region = 'AMR' and income in ('Low', 'Lower-middle', 'Upper-middle')
  and entity_code in (select entity_code from members where group_code = 'LAC')""")
def f7_list_entities(spark, folder):
    panel = star.customer_panel(spark, folder)
    return select_ops.list_entities(panel, "PAHO", "lmic", "latin america/caribbean")


@query("f8_list_groups", f"""with {CUSTOMER_MEMBERS},
{values_cte('grp', 'group_code, group_name, kind, wb_code, source',
            [(c, n, k, w, s) for c, n, k, w, _, s in fixed.CURATED_GROUPS])}
select g.*, '{fixed.GROUPS_VERIFIED_ON}' as last_verified, count(entity_code) as member_count
from grp g left join members using (group_code) group by all""")
def f8_list_groups(spark, folder):
    return select_ops.list_groups(star.customer_panel(spark, folder))


GROUP_SPELLINGS = ("Latin America & Caribbean", "sub-saharan_africa", "OECD countries", "lcn",
                   "MENA, excl. ISR/MLT", "Atlantis", "least developed country")
GROUP_ANSWERS = [
    (GROUP_SPELLINGS[0], "LAC"), (GROUP_SPELLINGS[1], "SSA"), (GROUP_SPELLINGS[2], "OECD"),
    (GROUP_SPELLINGS[3], "LAC_TERRITORIES"), (GROUP_SPELLINGS[4], "MENA_EXCL_ISR_MLT"),
    (GROUP_SPELLINGS[6], "LDC"),
]


@query("f8_resolve_groups", f"""with {values_cte('answers', 'spelling, group_code', GROUP_ANSWERS)},
asked as (select c_custkey, {_pick_sql('c_custkey', GROUP_SPELLINGS)} as spelling from customer)
select c_custkey, spelling, group_code from asked left join answers using (spelling)""")
def f8_resolve_groups(spark, folder):
    asked = _customers(spark, folder).select("c_custkey", _pick("c_custkey", GROUP_SPELLINGS).alias("spelling"))
    return ops.resolve_groups(asked, "spelling", star.customer_panel(spark, folder))


@query("f8_group_members", f"""with {CUSTOMER_MEMBERS}
select group_code, entity_code from members where group_code = 'EAP'""")
def f8_group_members(spark, folder):
    return select_ops.group_members(star.customer_panel(spark, folder), "East Asia & Pacific")


REGION_SPELLINGS = ("americas", "EURO", "African-region", "south_east asia", "Atlantis", " wpr ")
REGION_ANSWERS = [("americas", "AMR"), ("EURO", "EUR"), ("African-region", "AFR"), (" wpr ", "WPR")]


@query("n2_normalize_region", f"""with {values_cte('answers', 'spelling, region_resolved', REGION_ANSWERS)},
asked as (select c_custkey, {_pick_sql('c_custkey', REGION_SPELLINGS)} as spelling from customer)
select c_custkey, spelling, region_resolved from asked left join answers using (spelling)""")
def n2_normalize_region(spark, folder):
    asked = _customers(spark, folder).select("c_custkey", _pick("c_custkey", REGION_SPELLINGS).alias("spelling"))
    return ops.normalize_region(asked, "spelling", star.customer_panel(spark, folder))


INCOME_SPELLINGS = ("LMIC", "middle-income", "umic", "High income", "upper_middle", "middle class")
INCOME_ANSWERS = [
    ("LMIC", 0, "Low"), ("LMIC", 1, "Lower-middle"), ("LMIC", 2, "Upper-middle"),
    ("middle-income", 0, "Lower-middle"), ("middle-income", 1, "Upper-middle"),
    ("umic", 0, "Upper-middle"), ("High income", 0, "High"), ("upper_middle", 0, "Upper-middle"),
]


@query("n3_expand_income", f"""with
{values_cte('answers', 'spelling, income_position, income_resolved', INCOME_ANSWERS)},
asked as (select c_custkey, {_pick_sql('c_custkey', INCOME_SPELLINGS)} as spelling from customer)
select c_custkey, spelling, income_position, income_resolved
from asked left join answers using (spelling)""")
def n3_expand_income(spark, folder):
    asked = _customers(spark, folder).select("c_custkey", _pick("c_custkey", INCOME_SPELLINGS).alias("spelling"))
    return ops.expand_income(asked, "spelling", star.customer_panel(spark, folder))


@query("n4_find_entities", f"""with {CUSTOMER_ENTITIES},
queries as (select distinct ' ' || right(c_name, 3) as query from customer union all select chr(9) || chr(160))
select query, entity_code, entity_name, region, income from queries join ent
  on contains(entity_code, trim(query)) or contains(lower(entity_name), trim(query))
    or query = chr(9) || chr(160)""")
def n4_find_entities(spark, folder):
    return found_customers(spark, folder, star.customer_panel(spark, folder))


def found_customers(spark, folder, panel):
    queries = _customers(spark, folder).select(
        F.concat(F.lit(" "), F.substring("c_name", -3, 3)).alias("query")
    ).union(_customers(spark, folder).limit(1).select(F.lit("\t\u00a0")))
    return ops.find_entities(panel, queries, "query")


@query("j5_match_names", f"""with {CUSTOMER_ENTITIES},
needles as (select distinct substr(c_name, 10) as needle from customer
            union select distinct right(c_name, 2) from customer)
select needle, entity_code, entity_name from needles join ent on contains(lower(entity_name), needle)""")
def j5_match_names(spark, folder):
    return matched_customers(spark, folder, star.customer_panel(spark, folder))


def matched_customers(spark, folder, panel):
    names = _customers(spark, folder)
    needles = names.select(F.expr("substring(c_name, 10)").alias("needle")).union(
        names.select(F.substring("c_name", -2, 2))
    )
    return ops.match_names(panel, needles)


NATION_ENTITIES_OF = f"""{NATIONS}, {NATION_ENTITIES.replace('ent as (', 'nation_ent as (')},
ent as (select entity_code, entity_name from nation_ent union all select 'NER', 'Niger')"""
NATION_SPELLINGS = {
    0: "kenya", 1: "Col", 2: "INDIA", 3: "franc", 4: "EGY", 5: "gha", 6: "peru ", 7: "Japan",
    8: "GER", 9: "jordan", 10: "ETH", 11: "U.S.A.", 12: "vietnam", 13: "poland", 14: "moroc",
    15: "nigeria", 16: "an", 17: "Cambodia", 18: "türkiye", 19: " ", 20: "Zambia", 21: "united",
    22: "china", 23: "Great  Britain", 24: "Atlantis",
}
NATION_ANSWERS = [
    (0, "KEN", "name", 1), (1, "COL", "code", 1), (2, "IND", "name", 1), (3, "FRA", "name", 1),
    (4, "EGY", "code", 1), (5, "GHA", "code", 1), (6, "PER", "name", 1), (7, "JPN", "name", 1),
    (8, None, "ambiguous", 2), (9, "JOR", "name", 1), (10, "ETH", "code", 1), (11, "USA", "alias", 1),
    (12, "VNM", "alias", 1), (13, "POL", "name", 1), (14, "MAR", "name", 1), (15, "NGA", "name", 1),
    (16, None, "ambiguous", 7), (17, "KHM", "name", 1), (18, "TUR", "alias", 1),
    (19, None, "empty", 0), (20, "ZMB", "name", 1), (21, None, "ambiguous", 2),
    (22, "CHN", "name", 1), (23, "GBR", "alias", 1), (24, None, "unknown", 0),
]


@query("n5_resolve_nations", f"""with
{values_cte('spelled', 'k, spelling', NATION_SPELLINGS.items())},
{values_cte('answers', 'k, entity_code, status, n_matches', NATION_ANSWERS)}
select c_custkey, spelling, entity_code, status, n_matches,
  case c_nationkey when 8 then 'Germany|Nigeria'
    when 16 then 'France|Germany|Ghana|Iran|Japan'
    when 21 then 'United Kingdom|United States of America' end as candidates
from customer join spelled on c_nationkey = spelled.k join answers on c_nationkey = answers.k""")
def n5_resolve_nations(spark, folder):
    spelling = _pick("c_nationkey", NATION_SPELLINGS.values())
    asked = _customers(spark, folder).select("c_custkey", spelling.alias("spelling"))
    panel = star.nation_panel(spark, folder)
    rows = ops.resolve_entities(asked, "spelling", panel)
    return rows.withColumn("candidates", F.array_join("candidates", "|"))


@query("n5_resolve_customers", f"""with {CUSTOMER_ENTITIES},
asked as (
  select c_custkey, case c_custkey % 4 when 0 then upper(c_name) when 1 then right(c_name, 4)
    when 2 then ' ' || c_custkey || ' ' else c_name || '?' end as spelling from customer),
needles as (select distinct spelling, lower(trim(spelling)) as needle from asked),
by_code as (select spelling, entity_code from needles join ent on upper(needle) = entity_code),
by_name as (
  select spelling, count(*) as n, min(entity_code) as only_code,
         list(entity_name order by entity_name, entity_code) as names
  from needles join ent on contains(lower(entity_name), needle)
  where spelling not in (select spelling from by_code) group by spelling)
select c_custkey, spelling,
  coalesce(c.entity_code, case when n = 1 then only_code end) as entity_code,
  case when c.entity_code is not null then 'code' when n = 1 then 'name'
       when n > 1 then 'ambiguous' else 'unknown' end as status,
  cast(case when c.entity_code is not null then 1 else coalesce(n, 0) end as integer) as n_matches,
  case when n > 1 then array_to_string(names[1:5], '|') end as candidates
from asked left join by_code c using (spelling) left join by_name using (spelling)""")
def n5_resolve_customers(spark, folder):
    return resolved_customers(spark, folder, star.customer_panel(spark, folder))


def resolved_customers(spark, folder, panel):
    name, key = F.col("c_name"), F.col("c_custkey").cast("string")
    spelling = (
        F.when(F.col("c_custkey") % 4 == 0, F.upper(name))
        .when(F.col("c_custkey") % 4 == 1, F.substring(name, -4, 4))
        .when(F.col("c_custkey") % 4 == 2, F.concat(F.lit(" "), key, F.lit(" ")))
        .otherwise(F.concat(name, F.lit("?")))
    )
    asked = _customers(spark, folder).select("c_custkey", spelling.alias("spelling"))
    rows = ops.resolve_entities(asked, "spelling", panel)
    return rows.withColumn("candidates", F.array_join("candidates", "|"))


EXACT_SPELLINGS = ("Niger", "nigeria", "Guinea", "united", "Kenya ")


@query("n5_exact_first", f"""with {NATION_ENTITIES_OF},
asked as (select c_custkey, {_pick_sql('c_custkey', EXACT_SPELLINGS)} as spelling from customer),
needles as (select distinct spelling, lower(trim(spelling)) as needle from asked),
hits as (
  select spelling, count(*) as n, min(entity_code) as code,
    count(*) filter (where lower(entity_name) = needle) as n_full,
    min(entity_code) filter (where lower(entity_name) = needle) as full_code
  from needles join ent on contains(lower(entity_name), needle) group by spelling)
select c_custkey, spelling, case when n_full = 1 then full_code when n = 1 then code end as entity_code,
  case when n_full = 1 or n = 1 then 'name' when n > 1 then 'ambiguous' else 'unknown' end as status
from asked left join hits using (spelling)""")
def n5_exact_first(spark, folder):
    asked = _customers(spark, folder).select("c_custkey", _pick("c_custkey", EXACT_SPELLINGS).alias("spelling"))
    panel = star.nation_panel(spark, folder)
    # A second country whose name holds that of another.
    more = panel.entities.where("entity_code = 'NGA'").selectExpr(
        "'NER' as entity_code", "'Niger' as entity_name", "region", "income")
    panel = panel.replace(entities=panel.entities.unionByName(more))
    rows = ops.resolve_entities(asked, "spelling", panel, exact_first=True)
    return rows.select("c_custkey", "spelling", "entity_code", "status")


@query("n6_selection_entities", f"""with {CUSTOMER_ENTITIES}, {CUSTOMER_MEMBERS},
picked as (
  select '17' as entity_code, 0 as source union all select '42', 0
  union all select entity_code, 1 from members where group_code = 'SSA'
    and entity_code in (select entity_code from ent))
select entity_code, min(source) as source from picked group by entity_code""")
def n6_selection_entities(spark, folder):
    panel = star.customer_panel(spark, folder)
    return ops.selection_entities(panel, ["17", "customer#000000042", "17"], "Sub-Saharan Africa")


@query("n6_empty_group", f"""with {NATIONS}, {NATION_ENTITIES}
select entity_code, entity_name, region, income from ent where entity_code = 'IND'""")
def n6_empty_group(spark, folder):
    # Nobody in North America but the United States: without it that group selects nothing, others as before.
    panel = star.nation_panel(spark, folder)
    others = panel.replace(entities=panel.entities.where("entity_code <> 'USA'"))
    return select_ops.list_entities(others, group="NAR").unionByName(
        select_ops.list_entities(others, group="South Asia"))


@query("p1_resolved_inputs", f"""with {CUSTOMER_ENTITIES},
needles as (
  select distinct spelling, lower(trim(spelling)) as needle
  from (select case c_custkey % 3 when 0 then lower(c_name) when 1 then c_name || ' ' else c_custkey || '0' end as spelling
        from customer)),
hits as (
  select spelling, count(*) as n, min(entity_code) as code
  from needles join ent on contains(lower(entity_name), needle) group by spelling)
select spelling, coalesce(e.entity_code, case when n = 1 then code end) as entity_code
from needles left join ent e on upper(needle) = e.entity_code left join hits using (spelling)""")
def p1_resolved_inputs(spark, folder):
    name, key = F.col("c_name"), F.col("c_custkey")
    spelling = (F.when(key % 3 == 0, F.lower(name)).when(key % 3 == 1, F.concat(name, F.lit(" ")))
                .otherwise(F.concat(key.cast("string"), F.lit("0"))))
    asked = _customers(spark, folder).select(spelling.alias("spelling"))
    return select_ops.resolved_inputs(star.customer_panel(spark, folder), asked)


@query("p3_group_member_list", f"""with {CUSTOMER_ENTITIES}, {CUSTOMER_MEMBERS}
select entity_code, entity_name, region, income from ent
where income = 'High' and entity_code in (select entity_code from members where group_code = 'OECD')""")
def p3_group_member_list(spark, folder):
    panel = star.customer_panel(spark, folder)
    return select_ops.selected_entities(panel, Selection(group="OECD members", income="HIC"))
