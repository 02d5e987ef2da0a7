"""Counts, group statistics, trends, rankings, quality and warnings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.model import Selection
from tidepanel.operators import select as select_ops
from tidepanel.operators import summarize as ops
from tidepanel.registry.base import (
    CURATED_MEMBERS,
    CUSTOMER,
    CUSTOMER_ENTITIES,
    CUSTOMER_MEMBERS,
    EVENTS,
    LATEST,
    NATION,
    NOTES,
    NOTES_ONLY,
    PARTS,
    PARTS_BOOK,
    query,
    rnd,
    rounded,
)
from tidepanel.sources import star_panels as star

# ---- trends --------------------------------------------------------------------------------------------

ENDS = """ends as (
  select indicator_code, entity_code, min(period) as first_period,
         arg_min(value, period) as first_value, max(period) as latest_period,
         arg_max(value, period) as latest_value, count(*) as period_count
  from {source} group by 1, 2),
trends as (
  select *, latest_period - first_period as period_span,
         latest_value - first_value as absolute_change,
         (latest_value - first_value) / abs(nullif(first_value, 0)) as percent_change,
         case when first_value > 0 and latest_value > 0 and latest_period > first_period
              then power(latest_value / first_value, 1.0 / (latest_period - first_period)) - 1
         end as cagr
  from ends)"""
TREND_SQL = f"""indicator_code, entity_code, entity_name, region, income, first_period, first_value,
  latest_period, latest_value, period_count, period_span,
  {rnd('absolute_change')} as absolute_change, {rnd('percent_change', 9)} as percent_change,
  {rnd('cagr', 9)} as cagr"""


def _rounded_trends(rows):
    return rounded(rounded(rows, "absolute_change"), "percent_change", "cagr", digits=9)


@query("a6_indicator_trends", f"""{CUSTOMER}, {ENDS.format(source='obs')}
select {TREND_SQL} from trends join ent using (entity_code)
where period_count >= 2 and period_span >= 2""")
def a6_indicator_trends(spark, folder):
    panel = star.customer_panel(spark, folder)
    return _rounded_trends(ops.indicator_trends(panel, min_count=2, min_span=2))


@query("a6_trends_top_per_indicator", f"""{PARTS},
{ENDS.format(source='(select * from obs where period between 1996 and 2001)')}
select {TREND_SQL} from trends join ent using (entity_code)
where income in ('Low', 'Lower-middle', 'Upper-middle')
qualify row_number() over (
  partition by indicator_code order by trends.absolute_change desc, entity_code) <= 3""")
def a6_trends_top_per_indicator(spark, folder):
    panel = star.parts_panel(spark, folder)
    sel = Selection(income="LMIC", start=1996, end=2001)
    return _rounded_trends(ops.indicator_trends(panel, None, sel, top=3))


@query("a6_trends_events", f"""{EVENTS}, {ENDS.format(source='obs')}
select {TREND_SQL.replace('entity_name, region, income, ', '')} from trends""")
def a6_trends_events(spark, folder):
    rows = ops.indicator_trends(star.events_panel(spark, folder))
    return _rounded_trends(rows).drop("entity_name", "region", "income")


@query("w3_rank_changes", f"""{CUSTOMER}, {ENDS.format(source='obs')}
select {TREND_SQL}, row_number() over (
    partition by indicator_code
    order by trends.cagr, trends.absolute_change desc, entity_code) as rank
from trends join ent using (entity_code) where trends.cagr is not null and region = 'AMR'
qualify rank <= 20""")
def w3_rank_changes(spark, folder):
    panel = star.customer_panel(spark, folder)
    sel = Selection(region="AMR")
    rows = ops.rank_changes(panel, None, "cagr", descending=False, sel=sel)
    return _rounded_trends(rows).withColumn("rank", F.col("rank").cast("bigint"))


@query("w3_rank_changes_all", f"""{CUSTOMER}, {ENDS.format(source="(select * from obs where indicator_code = 'n_items')")}
select {TREND_SQL} from trends join ent using (entity_code) where percent_change is not null""")
def w3_rank_changes_all(spark, folder):
    panel = star.customer_panel(spark, folder, ["n_items"])
    return _rounded_trends(ops.rank_changes(panel, ["n_items"], "percent_change", top=None)).drop("rank")


@query("w3_rank_changes_complete", f"""{CUSTOMER}, {ENDS.format(source='obs')}
select {TREND_SQL}, row_number() over (
    partition by indicator_code
    order by trends.absolute_change desc, entity_code) as rank
from trends join ent using (entity_code) where trends.absolute_change is not null""")
def w3_rank_changes_complete(spark, folder):
    return _rounded_trends(ops.rank_changes(star.customer_panel(spark, folder), top=None))


# ---- counts ------------------------------------------------------------------------------------------------


@query("a2_category_counts", f"""with {PARTS_BOOK}
select 1 as level, category_1, null as category_2, count(*) as n from book group by category_1
union all
select 2, category_1, category_2, count(*) from book group by category_1, category_2""")
def a2_category_counts(spark, folder):
    return ops.category_counts(star.parts_panel(spark, folder))


@query("a3_group_counts", f"""with {CUSTOMER_ENTITIES}
select 'region' as grouping, region, null as income, count(*) as entity_count
from ent where region is not null group by region
union all
select 'income', null, income, count(*) from ent where income is not null group by income
union all
select 'region_income', region, income, count(*)
from ent where region is not null and income is not null group by region, income""")
def a3_group_counts(spark, folder):
    return ops.group_counts(star.customer_panel(spark, folder))


# ---- group statistics -----------------------------------------------------------------------------------------

STATS = f"""indicator_code, group_code, count(value) as n, {rnd('avg(value)')} as mean,
  {rnd('median(value)')} as median, min(value) as min, max(value) as max,
  count(distinct entity_code) as entities_with_data,
  string_agg(distinct cast(period as varchar), ',' order by cast(period as varchar)) as periods"""
STAT_COLUMNS = f"""n, mean, median, min, max, entity_count, entities_with_data,
  {rnd('entities_with_data / nullif(entity_count, 0)')} as coverage_ratio, periods"""


def _flat_stats(rows):
    listed = F.array_join(F.transform("periods", lambda p: p.cast("string")), ",")
    rows = rows.withColumn("periods", F.nullif(listed, F.lit("")))
    return rounded(rows, "mean", "median", "coverage_ratio")


@query("a4_summarize_groups", f"""{CUSTOMER}, {CUSTOMER_MEMBERS},
latest as (select * from obs qualify {LATEST}),
sizes as (select group_code, count(*) as entity_count from members group by 1),
stats as (select {STATS} from latest join members using (entity_code) group by 1, 2)
select indicator_code, group_code, {STAT_COLUMNS} from stats join sizes using (group_code)""")
def a4_summarize_groups(spark, folder):
    return _flat_stats(ops.summarize_groups(star.customer_panel(spark, folder), "group"))


@query("a4_summarize_regions_all_rows", f"""{CUSTOMER},
wanted(indicator_code) as (values ('rev'), ('rev_x')),
sizes as (select region as group_code, count(*) as entity_count from ent
          where income <> 'High' and region is not null group by 1),
stats as (
  select {STATS} from (select obs.*, region as group_code from obs join ent using (entity_code)
                       where income <> 'High' and region is not null and period >= 1997)
  group by 1, 2)
select indicator_code, group_code, coalesce(n, 0) as n, mean, median, min, max, entity_count,
  coalesce(entities_with_data, 0) as entities_with_data,
  {rnd('coalesce(entities_with_data, 0) / nullif(entity_count, 0)')} as coverage_ratio, periods
from wanted cross join sizes left join stats using (indicator_code, group_code)""")
def a4_summarize_regions_all_rows(spark, folder):
    panel = star.customer_panel(spark, folder, ["rev"])
    sel = Selection(income="non-HIC", start=1997)
    rows = ops.summarize_groups(panel, "region", ["rev", "rev_x"], latest_only=False, sel=sel)
    return _flat_stats(rows)


@query("a4_summarize_income_one_period", f"""{CUSTOMER},
sizes as (select income as group_code, count(*) as entity_count from ent group by 1),
stats as (select {STATS} from (select obs.*, income as group_code from obs
          join ent using (entity_code) where period = 1999) group by 1, 2)
select indicator_code, group_code, {STAT_COLUMNS} from stats join sizes using (group_code)""")
def a4_summarize_income_one_period(spark, folder):
    panel = star.customer_panel(spark, folder)
    return _flat_stats(ops.summarize_groups(panel, "income", period=1999))


@query("a4_summarize_nation_groups", f"""{NATION}, {CURATED_MEMBERS},
members as (select group_code, member as entity_code from curated join ent on member = entity_code),
latest as (select * from obs qualify {LATEST}),
sizes as (select group_code, count(*) as entity_count from members group by 1),
stats as (select {STATS} from latest join members using (entity_code) group by 1, 2)
select indicator_code, group_code, {STAT_COLUMNS} from stats join sizes using (group_code)""")
def a4_summarize_nation_groups(spark, folder):
    panel = star.nation_panel(spark, folder)
    return _flat_stats(ops.summarize_groups(panel, "group"))


@query("a4_summarize_selection", f"""{NATION},
latest as (select *, 'selection' as group_code from obs where entity_code in ('USA', 'PER', 'KEN', 'GBR')
           qualify {LATEST}),
stats as (select {STATS} from latest group by 1, 2)
select indicator_code, group_code, {STAT_COLUMNS.replace('entity_count', '4').replace(' 4,', ' cast(4 as bigint) as entity_count,', 1)}
from stats""")
def a4_summarize_selection(spark, folder):
    sel = Selection(entities=["US", "peru", "KEN", "great britain"])
    return _flat_stats(ops.summarize_groups(star.nation_panel(spark, folder), None, sel=sel))


ENDS_OF_GROUP = """ranked as (
  select indicator_code, group_code, entity_code, period, value,
    row_number() over (partition by indicator_code, group_code
                       order by value, entity_code, period desc) as up,
    row_number() over (partition by indicator_code, group_code
                       order by value desc, entity_code desc, period) as down
  from grouped)
select indicator_code, group_code, 'bottom' as side, up as rank, entity_code, period, value
from ranked where up <= {n}
union all
select indicator_code, group_code, 'top', down, entity_code, period, value
from ranked where down <= {n}"""


@query("w4_top_bottom", f"""{CUSTOMER}, {CUSTOMER_MEMBERS},
latest as (select * from obs qualify {LATEST}),
grouped as (select * from latest join members using (entity_code)),
{ENDS_OF_GROUP.format(n=5)}""")
def w4_top_bottom(spark, folder):
    rows = ops.top_bottom(star.customer_panel(spark, folder), "group")
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


@query("w4_top_bottom_ties", f"""{CUSTOMER},
grouped as (select obs.*, region as group_code from obs join ent using (entity_code)
            where indicator_code = 'n_items' and region is not null),
{ENDS_OF_GROUP.format(n=7)}""")
def w4_top_bottom_ties(spark, folder):
    panel = star.customer_panel(spark, folder, ["n_items"])
    rows = ops.top_bottom(panel, "region", ["n_items"], 7, latest_only=False)
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


# ---- quality -----------------------------------------------------------------------------------------------------

NOTE_PROFILE = """typed as (
  select indicator_code, coalesce(nullif(data_type, ''), 'Unspecified') as data_type,
         count(*) as note_count,
         count(*) filter (where sources <> '') as with_sources,
         count(*) filter (where methods_of_estimation <> '') as with_methods,
         count(*) filter (where footnote <> '') as with_footnotes,
         count(*) filter (where comments <> '') as with_comments
  from {source} group by 1, 2)"""


@query("a7_assess_quality", f"""{CUSTOMER},
{NOTES_ONLY},
{NOTE_PROFILE.format(source="(select * from notes where region = 'AMR')")},
profile as (
  select indicator_code, cast(sum(note_count) as bigint) as note_rows,
    cast(sum(with_sources) as bigint) as with_sources,
    cast(sum(with_methods) as bigint) as with_methods,
    cast(sum(with_footnotes) as bigint) as with_footnotes,
    cast(sum(with_comments) as bigint) as with_comments,
    bool_or(contains(lower(data_type), 'estimated')) as estimated
  from typed group by 1),
found as (
  select indicator_code, count(*) as observation_count, count(distinct entity_code) as entity_count,
         min(period) as first_period, max(period) as latest_period
  from obs join ent using (entity_code) where region = 'AMR' and period >= 1997 group by 1)
select indicator_code, coalesce(observation_count, 0) as observation_count,
  coalesce(entity_count, 0) as entity_count, first_period, latest_period,
  coalesce(note_rows, 0) as note_rows, coalesce(with_sources, 0) as with_sources,
  coalesce(with_methods, 0) as with_methods, coalesce(with_footnotes, 0) as with_footnotes,
  coalesce(with_comments, 0) as with_comments,
  coalesce(observation_count, 0) = 0 as no_observations,
  coalesce(estimated, false) as estimated_data_present,
  coalesce(with_footnotes, 0) + coalesce(with_comments, 0) > 0 as entity_notes_present
from book left join found using (indicator_code) left join profile using (indicator_code)""")
def a7_assess_quality(spark, folder):
    panel = star.customer_panel(spark, folder)
    return ops.assess_quality(panel, None, Selection(region="AMR", start=1997)).drop("data_types")


@query("a7_data_type_histogram", f"""with {NOTES}, {NOTE_PROFILE.format(source='notes')}
select indicator_code, data_type, note_count from typed""")
def a7_data_type_histogram(spark, folder):
    rows = ops.assess_quality(star.customer_panel(spark, folder, ["rev"]), ["rev"])
    return rows.select("indicator_code", F.explode("data_types").alias("data_type", "note_count"))


@query("a7_sample_notes", f"""with {NOTES}
select * from notes where income = 'Low' order by entity_code limit 20""")
def a7_sample_notes(spark, folder):
    panel = star.customer_panel(spark, folder, ["rev"])
    return ops.sample_notes(panel, ["rev"], Selection(income="LIC"), 20)


# ---- warnings -------------------------------------------------------------------------------------------------------


@query("a9_result_warnings", f"""{CUSTOMER},
latest as (select * from obs join ent using (entity_code) where region = 'AMR' qualify {LATEST}),
{ENDS.format(source="(select * from obs where indicator_code in ('rev', 'rev_a'))")}
select 'mixed_latest_years' as type, indicator_code as key, cast(min(period) as bigint) as min_value,
  cast(max(period) as bigint) as max_value,
  string_agg(distinct cast(period as varchar), ',' order by cast(period as varchar)) as values
from latest group by indicator_code having count(distinct period) > 1
union all
select 'mixed_periods', indicator_code, cast(min(period_span) as bigint),
  cast(max(period_span) as bigint), null
from trends join ent using (entity_code) group by indicator_code
having count(*) >= 2 and max(period_span) - min(period_span) >= 5
union all
select 'top_limit_reached', 'result', 50, 50, null from latest having count(*) >= 50""")
def a9_result_warnings(spark, folder):
    panel = star.customer_panel(spark, folder)
    latest = select_ops.latest_per_entity(panel, None, Selection(region="AMR"))
    trends = ops.indicator_trends(panel, ["rev", "rev_a"])
    rows = ops.result_warnings(
        ops.mixed_period_warnings(latest, "indicator_code"),
        ops.mixed_span_warnings(trends, "indicator_code"),
        ops.limit_warnings(latest, 50),
    )
    listed = F.array_join(F.transform("values", lambda p: p.cast("string")), ",")
    return rows.withColumn("values", listed)


@query("a9_mixed_reference_years", f"""{CUSTOMER},
latest as (select * from obs join ent using (entity_code) where income = 'Low' qualify {LATEST})
select 'mixed_reference_years' as type, entity_code as key, cast(min(period) as bigint) as min_value,
  cast(max(period) as bigint) as max_value,
  string_agg(distinct cast(period as varchar), ',' order by cast(period as varchar)) as values
from latest group by entity_code having count(distinct period) > 1""")
def a9_mixed_reference_years(spark, folder):
    panel = star.customer_panel(spark, folder)
    latest = select_ops.latest_per_entity(panel, None, Selection(income="LIC"))
    rows = ops.mixed_period_warnings(latest, "entity_code", "mixed_reference_years")
    return rows.withColumn("values", F.array_join(F.transform("values", lambda p: p.cast("string")), ","))
