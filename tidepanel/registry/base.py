"""The query register and the SQL building blocks of the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.dims import fixed
from tidepanel.sources import star_panels as star

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL it must agree with."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round ratios and means, whose last bits depend on the order of additions; no negative zero."""
    return df.withColumns({name: F.round(name, digits) + 0.0 for name in columns})


def rnd(expression: str, digits: int = 6) -> str:
    """The SQL counterpart of ``rounded``."""
    return f"round({expression}, {digits}) + 0.0"


# ---- SQL building blocks: each names one or more common table expressions -------------------------------


def _literal(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values_cte(name: str, columns: str, rows) -> str:
    listed = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) as (values {listed})"


REGION_CASE = (
    "case r_name " + " ".join(f"when '{k}' then '{v}'" for k, v in star.REGIONS.items()) + " end"
)


def income_case(key: str) -> str:
    return (
        f"case {key} % 4 when 0 then 'Low' when 1 then 'Lower-middle' when 2 then 'Upper-middle' "
        "else 'High' end"
    )


LINES = """lines as (
  select o_custkey, c_nationkey, cast(year(o_orderdate) as integer) as period,
         cast(l_extendedprice as decimal(18,2)) as price, l_returnflag, l_linestatus
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)"""

NATIONS = values_cte(
    "nations", "nkey, code, name", [(i, code, name) for i, (code, name) in enumerate(star.NATIONS)]
)


def _observations(entity: str, source: str) -> str:
    return f"""sums as (
  select {entity} as entity_code, period,
         cast(sum(price) as double) as rev,
         cast(sum(price) filter (where l_returnflag = 'A') as double) as rev_a,
         cast(sum(price) filter (where l_returnflag = 'N') as double) as rev_n,
         cast(sum(price) filter (where l_returnflag = 'R') as double) as rev_r,
         cast(sum(price) filter (where l_linestatus = 'O') as double) as rev_o,
         cast(sum(price) filter (where l_linestatus = 'F') as double) as rev_f,
         cast(count(*) as double) as n_items
  from {source} group by 1, 2),
wide as (select *, 100 * rev_r / nullif(rev, 0) as rev_r_rev from sums),
obs as (
  select entity_code, period, indicator_code, value from wide
  unpivot (value for indicator_code in (rev, rev_a, rev_n, rev_r, rev_o, rev_f, rev_r_rev, n_items)))"""


CUSTOMER_ENTITIES = f"""ent as (
  select cast(c_custkey as varchar) as entity_code, c_name as entity_name,
         {REGION_CASE} as region, {income_case('c_custkey')} as income, c_nationkey
  from customer left join nation on c_nationkey = n_nationkey
  left join region on n_regionkey = r_regionkey)"""

NATION_ENTITIES = f"""ent as (
  select code as entity_code, name as entity_name, {REGION_CASE} as region,
         {income_case('n_nationkey')} as income
  from nation join region on n_regionkey = r_regionkey join nations on n_nationkey = nkey)"""

BOOK = values_cte(
    "book",
    "indicator_code, indicator_name, long_code, category_1, category_2, unit, currency, "
    "measurement_method",
    star.CUSTOMER_CODEBOOK,
)

CUSTOMER_OBS = LINES + ",\n" + _observations("cast(o_custkey as varchar)", "lines")
NATION_OBS = (
    LINES + ",\n" + NATIONS + ",\n"
    + _observations("code", "lines join nations on c_nationkey = nkey")
)
CUSTOMER = f"with {CUSTOMER_OBS},\n{CUSTOMER_ENTITIES},\n{BOOK}"
NATION = f"with {NATION_OBS},\n{NATION_ENTITIES},\n{BOOK}"

CURATED_MEMBERS = values_cte(
    "curated", "group_code, member",
    [(code, member) for code, _, _, _, members, _ in fixed.CURATED_GROUPS for member in members],
)
# Customers in the groups of their nation; needs ``nations``.
CUSTOMER_MEMBERS = f"""{NATIONS},
{CURATED_MEMBERS},
members as (
  select group_code, cast(c_custkey as varchar) as entity_code
  from customer join nations on c_nationkey = nkey join curated on code = member)"""

RELATIONS = values_cte(
    "relations", "parent_code, relationship_id, priority, position, child_code",
    [
        (parent, relation, priority, position, child)
        for priority, (parent, relation, children) in enumerate(star.CUSTOMER_RELATIONS)
        for position, child in enumerate(children)
    ],
)
# Curated relations of the customer codebook plus the tree below sha11.REV.
CUSTOMER_EDGES = f"""{RELATIONS},
edges as (
  select *, 'curated_codebook_formula' as source from relations
  union all
  select 'rev', 'sha_direct_children', 2, null, indicator_code, 'inferred_from_sha11_long_codes'
  from book where indicator_code in ('rev_a', 'rev_n', 'rev_r'))"""

RAW_PARTS = """raw_parts as (
  select case when p_size % 22 = 0 then null when p_size % 11 = 0 then 'region'
              else 'p' || p_partkey end as variable_code,
         p_name || ' ' || p_partkey as variable_name,
         'sha11.' || regexp_extract(p_brand, '(\\d+)$', 1) || '.' || p_partkey
           || case when p_size % 10 = 0 then '_x' else '' end as long_code,
         p_type as category_1, p_brand as category_2,
         case when p_size % 5 = 0 then 'Percentage' else 'Millions' end as unit,
         case when p_size % 5 = 0 then '-' else 'NCU' end as currency,
         case when p_size % 7 = 0 then 'QTY / ALL' else '-' end as method
  from part
  union all
  select 'b' || regexp_extract(p_brand, '(\\d+)$', 1), p_brand,
         'sha11.' || regexp_extract(p_brand, '(\\d+)$', 1), 'INDICATORS', '-', 'Millions', 'NCU', '-'
  from (select distinct p_brand from part))"""

PARTS_BOOK = f"""{RAW_PARTS},
book as (
  select variable_code as indicator_code, nullif(variable_name, '-') as indicator_name,
         nullif(long_code, '-') as long_code, nullif(category_1, '-') as category_1,
         nullif(category_2, '-') as category_2, nullif(unit, '-') as unit,
         nullif(currency, '-') as currency, nullif(method, '-') as measurement_method
  from raw_parts
  where variable_code <> '' and variable_code not in ('location', 'code', 'region', 'income', 'year'))"""

PARTS_OBS = """part_sums as (
  select l_partkey, cast(l_suppkey as varchar) as entity_code,
         cast(year(l_shipdate) as integer) as period, sum(cast(l_quantity as decimal(18,2))) as quantity
  from lineitem group by all),
obs as (
  select 'p' || l_partkey as indicator_code, entity_code, period, cast(quantity as double) as value
  from part_sums
  union all
  select 'b' || regexp_extract(p_brand, '(\\d+)$', 1), entity_code, period,
         cast(sum(quantity) as double)
  from part_sums join part on l_partkey = p_partkey group by 1, 2, 3)"""

SUPPLIER_ENTITIES = f"""ent as (
  select cast(s_suppkey as varchar) as entity_code, s_name as entity_name,
         {REGION_CASE} as region, {income_case('s_suppkey')} as income
  from supplier left join nation on s_nationkey = n_nationkey
  left join region on n_regionkey = r_regionkey)"""

PARTS = f"with {PARTS_BOOK},\n{PARTS_OBS},\n{SUPPLIER_ENTITIES}"

EVENTS = """with obs as (
  select cast(user_id as varchar) as entity_code, event_type as indicator_code,
         cast(date_diff('day', date '2024-01-01', cast(ts as date)) as integer) as period,
         cast(sum(cast(value as decimal(18,2))) as double) as value
  from events group by all having sum(value) is not null)"""

# Needs ``ent``.
NOTES_ONLY = """notes as (
  select entity_code, 'rev' as indicator_code, entity_name, region, income,
         'sha11.REV' as long_code, 'Revenue' as indicator_name,
         nullif(o_orderpriority, '4-NOT SPECIFIED') as sources, cast(null as varchar) as comments,
         case o_orderstatus when 'F' then 'Documented' when 'P' then 'Estimated' end as data_type,
         cast(null as varchar) as methods_of_estimation,
         case when o_orderpriority = '1-URGENT' then 'urgent' end as footnote
  from orders join ent on cast(o_custkey as varchar) = entity_code
  qualify row_number() over (
    partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)"""
NOTES = f"{CUSTOMER_ENTITIES},\n{NOTES_ONLY}"

DATA = (
    "indicator_code, indicator_name, entity_code, entity_name, region, income, period, value, unit, "
    "currency, category_1, category_2"
)
STAR = "obs join ent using (entity_code) left join book using (indicator_code)"
LATEST = "row_number() over (partition by indicator_code, entity_code order by period desc) = 1"
