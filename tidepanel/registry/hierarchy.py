"""Additive edges, roles and breakdowns."""

from __future__ import annotations

from tidepanel.operators import hierarchy as ops
from tidepanel.registry.base import (
    BOOK,
    CUSTOMER,
    CUSTOMER_EDGES,
    PARTS,
    PARTS_BOOK,
    query,
    rnd,
    rounded,
)
from tidepanel.sources import star_panels as star

AMOUNT = "{0}.unit = 'Millions' and {0}.currency = 'NCU'"
PART_EDGES = f"""part_edges as (
  select p.indicator_code as parent_code, c.indicator_code as child_code,
         c.long_code as child_long_code
  from book p join book c
    on p.long_code = regexp_extract(c.long_code, '^(.*)\\.([^._]*)$', 1)
  where {AMOUNT.format('p')} and {AMOUNT.format('c')} and starts_with(p.long_code, 'sha11.'))"""
PART_PARENTS = f"""part_parents as (
  select c.indicator_code as child_code, p.indicator_code as parent_code,
         p.indicator_name as parent_name
  from book p join book c
    on p.long_code = regexp_extract(c.long_code, '^(.*)\\.([^.]*)$', 1)
  where {AMOUNT.format('p')} and {AMOUNT.format('c')} and starts_with(c.long_code, 'sha11.'))"""


@query("j6_hierarchy_edges", f"""with {PARTS_BOOK}, {PART_EDGES}
select parent_code, 'sha_direct_children' as relationship_id, 0 as priority,
  cast(null as integer) as position, child_code, child_long_code,
  'inferred_from_sha11_long_codes' as source
from part_edges""")
def j6_hierarchy_edges(spark, folder):
    return ops.hierarchy_edges(star.parts_panel(spark, folder))


@query("j6_known_parents", f"""with {PARTS_BOOK}, {PART_PARENTS}
select child_code, parent_code, parent_name, 'sha_direct_children' as relationship_id,
  'inferred_from_sha11_long_codes' as source
from part_parents""")
def j6_known_parents(spark, folder):
    return ops.known_parents(star.parts_panel(spark, folder))


@query("c6_classify_indicators", f"""with {PARTS_BOOK}, {PART_EDGES}, {PART_PARENTS},
flags as (
  select indicator_code, coalesce({AMOUNT.format('book')}, false) as is_amount,
    coalesce(unit, '') = 'Percentage' or contains(coalesce(long_code, ''), '%')
      or contains(coalesce(measurement_method, ''), '/')
      or contains(lower(coalesce(unit, '')), 'per') as is_share,
    indicator_code in (select parent_code from part_edges) as has_children,
    indicator_code in (select child_code from part_parents) as has_parent
  from book)
select *, case when has_children then 'additive_parent' when has_parent then 'component'
    when is_share then 'derived_ratio_or_share' when is_amount then 'amount_series'
    else 'context_or_conversion_series' end as role,
  is_share as caution_do_not_sum, is_amount as caution_units_must_match,
  has_children as caution_validate_breakdown,
  not has_children and not has_parent and not is_share as caution_no_known_hierarchy
from flags""")
def c6_classify_indicators(spark, folder):
    return ops.classify_indicators(star.parts_panel(spark, folder))


@query("a8_additive_breakdown", f"""{CUSTOMER}, {CUSTOMER_EDGES},
known as (select * from obs where entity_code in (select entity_code from ent)),
sides as (
  select parent_code, relationship_id, entity_code, period, null as parent_value, value as child_value
  from known join edges on indicator_code = child_code
  union all
  select parent_code, relationship_id, entity_code, period, value, null
  from known join (select distinct parent_code, relationship_id from edges)
    on indicator_code = parent_code),
totals as (
  select parent_code, relationship_id, entity_code, period, max(parent_value) as parent_value,
         coalesce(sum(child_value), 0) as child_sum
  from sides group by all)
select parent_code, relationship_id, entity_code, period, priority, position, child_code,
  indicator_name as child_name, indicator_name is not null as child_known, value as child_value,
  {rnd('value / nullif(parent_value, 0)', 9)} as share, parent_value,
  {rnd('child_sum')} as child_sum, {rnd('child_sum - parent_value')} as difference,
  {rnd('(child_sum - parent_value) / nullif(parent_value, 0)', 9)} as relative_difference,
  coalesce(abs((child_sum - parent_value) / nullif(parent_value, 0)) < 1e-6, false) as balanced
from totals join edges using (parent_code, relationship_id)
left join (select indicator_code as child_code, entity_code, period, value from known)
  using (child_code, entity_code, period)
left join (select indicator_code as child_code, indicator_name from book) using (child_code)""")
def a8_additive_breakdown(spark, folder):
    rows = ops.additive_breakdown(star.customer_panel(spark, folder))
    rows = rounded(rows, "child_sum", "difference")
    return rounded(rows, "share", "relative_difference", digits=9)


@query("a8_breakdown_totals_many_children", f"""{PARTS}, {PART_EDGES.replace(' as (', ' as materialized (', 1)},
known as materialized (select * from obs join ent using (entity_code)),
children as (
  select parent_code, entity_code, period, sum(value) as child_sum, count(*) as child_count
  from known join part_edges on indicator_code = child_code group by all),
parents as (
  select indicator_code as parent_code, entity_code, period, value as parent_value
  from known where indicator_code in (select parent_code from part_edges))
select parent_code, 'sha_direct_children' as relationship_id, entity_code, period, parent_value,
  coalesce(child_sum, 0) as child_sum, coalesce(child_count, 0) as child_count,
  coalesce(child_sum, 0) - parent_value as difference,
  {rnd('(coalesce(child_sum, 0) - parent_value) / nullif(parent_value, 0)', 9)} as relative_difference,
  coalesce(abs((coalesce(child_sum, 0) - parent_value) / nullif(parent_value, 0)) < 1e-6, false)
    as balanced
from children full join parents using (parent_code, entity_code, period)""")
def a8_breakdown_totals_many_children(spark, folder):
    rows = ops.breakdown_totals(star.parts_panel(spark, folder))
    return rounded(rows, "relative_difference", digits=9)


@query("a8_named_edges", f"""with {BOOK}, {CUSTOMER_EDGES}
select parent_code, relationship_id, priority, position, child_code, long_code as child_long_code, source
from edges left join book on indicator_code = child_code
where parent_code = 'rev' and priority = 0
union all
select parent_code, relationship_id, priority, position, child_code, long_code, source
from edges left join book on indicator_code = child_code where relationship_id = 'sha_direct_children'""")
def a8_named_edges(spark, folder):
    panel = star.customer_panel(spark, folder)
    first = ops.named_edges(panel, "rev")
    return first.unionByName(ops.named_edges(panel, "rev", "sha_direct_children"))
