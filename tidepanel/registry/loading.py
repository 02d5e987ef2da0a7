"""Loaders, key checks, snapshots, catalogs and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.model import EXTRACT_COLUMNS, INDICATOR_COLUMNS, Selection
from tidepanel.operators.select import research_panel
from tidepanel.registry import entities, facts
from tidepanel.registry.base import CUSTOMER, NOTES, ORACLES, PARTS_BOOK, STAR, query, rnd, rounded
from tidepanel.sources import catalog as catalogs
from tidepanel.sources import export, load, snapshot
from tidepanel.sources import star_panels as star
from tidepanel.sources.storage import scratch_dir


@query("s1_load_codebook", f"with {PARTS_BOOK} select * from book")
def s1_load_codebook(spark, folder):
    return load.load_codebook(star.parts_codebook_raw(spark, folder))


@query("s2_wide_to_observations", f"""{CUSTOMER}
select entity_code, period, indicator_code, value from obs where entity_code in (select entity_code from ent)""")
def s2_wide_to_observations(spark, folder):
    return load.wide_to_observations(star.customer_sheet(spark, folder), star.customer_codebook(spark))


@query("s3_derive_entities", f"""{CUSTOMER}
select entity_code,
  case when entity_code in (select entity_code from obs) then entity_name
       else 'Formerly ' || entity_name end as entity_name,
  case when entity_code in (select entity_code from obs) then region else '?' end as region,
  case when entity_code in (select entity_code from obs) then income else '?' end as income
from ent""")
def s3_derive_entities(spark, folder):
    return load.derive_entities(star.customer_sheet(spark, folder))


@query("s4_load_notes", f"with {NOTES} select * from notes")
def s4_load_notes(spark, folder):
    return load.load_notes(star.customer_notes_raw(spark, folder))


@query("s5_check_keys", """select 'lineitem' as "table", 'duplicate_key' as problem,
  l_orderkey || '|' || l_linenumber as key, count(*) as n
from lineitem group by l_orderkey, l_linenumber having count(*) > 1
union all
select 'lineitem', 'null_value', 'l_returnflag', count(*) from lineitem
where l_returnflag = 'R' having count(*) > 0""")
def s5_check_keys(spark, folder):
    lines = star.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif(F.col("l_returnflag"), F.lit("R")).alias("l_returnflag")
    )
    return load.key_violations(
        lines, "lineitem", ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_returnflag"]
    )


@query("s5_check_panel", f"""{CUSTOMER}
select 'observations' as "table", 'duplicate_key' as problem,
  indicator_code || '|' || entity_code || '|' || period as key, cast(2 as bigint) as n
from obs where indicator_code = 'n_items' and period = 1997
union all
select 'entities', 'null_value', 'entity_name', count(*) from ent where region = 'EUR' having count(*) > 0""")
def s5_check_panel(spark, folder):
    # A panel with repeated facts and unnamed entities.
    panel = star.customer_panel(spark, folder)
    twice = panel.observations.where("indicator_code = 'n_items' and period = 1997")
    unnamed = panel.entities.withColumn(
        "entity_name", F.when(F.col("region") == "EUR", F.lit(None)).otherwise(F.col("entity_name"))
    )
    return load.check_keys(panel.replace(observations=panel.observations.unionByName(twice), entities=unnamed))


# ---- snapshots -----------------------------------------------------------------------------------------


SOURCES = ("lineitem", "orders", "customer", "nation", "region")


def _built_snapshot(spark, folder) -> tuple[str, str]:
    path = scratch_dir(spark, "snapshot")
    signature = snapshot.source_signature(spark, *[f"{folder}/{name}.parquet" for name in SOURCES])
    lines = star.table(spark, folder, "region").select(
        (F.col("r_regionkey") + 1).cast("int").alias("line_no"), F.concat(F.lit("Covers "), "r_name").alias("text")
    )
    panel = star.customer_panel(spark, folder).replace(version_lines=lines)
    snapshot.build_snapshot(panel, path, signature)
    return path, signature


@query("s6_build_snapshot", f"""{CUSTOMER}
select entity_code, period, indicator_code, value from obs""")
def s6_build_snapshot(spark, folder):
    path, _ = _built_snapshot(spark, folder)
    return snapshot.read_snapshot(spark, path).observations


@query("s6_refresh_changed_ranges", f"""{CUSTOMER}
select entity_code, period, indicator_code, value + case when entity_code = '7' then 1 else 0 end as value
from obs where entity_code <> '11'""")
def s6_refresh_changed_ranges(spark, folder):
    """A build after which one customer's values change and another's rows go; read back after the second build."""
    path, _ = _built_snapshot(spark, folder)
    changed = F.col("value") + F.when(F.col("entity_code") == "7", 1).otherwise(0)
    panel = star.customer_panel(spark, folder)
    rows = panel.observations.where("entity_code <> '11'").withColumn("value", changed)
    snapshot.build_snapshot(panel.replace(observations=rows), path, "changed")
    return snapshot.read_snapshot(spark, path).observations


@query("s7_version_lines", """select cast(r_regionkey + 1 as integer) as line_no, 'Covers ' || r_name as text
from region""")
def s7_version_lines(spark, folder):
    path, _ = _built_snapshot(spark, folder)
    return snapshot.version_lines(spark, path)


@query("s7_snapshot_status", f"""{CUSTOMER}
select 'observations' as item, cast(count(*) as varchar) as value from obs
union all select 'entities', cast(count(*) as varchar) from ent
union all select 'indicators', cast(count(*) as varchar) from book
union all select 'notes', cast(count(distinct o_custkey) as varchar) from orders
  join customer on o_custkey = c_custkey
union all select 'is_current', 'true'""")
def s7_snapshot_status(spark, folder):
    path, signature = _built_snapshot(spark, folder)
    status = snapshot.snapshot_status(spark, path, signature)
    return status.where("item in ('observations', 'entities', 'indicators', 'notes', 'is_current')")


# ---- searches by the stored grams of a build -------------------------------------------------------------


def _stored(panel, spark, name):
    path = scratch_dir(spark, name)
    snapshot.build_snapshot(panel, path, name)
    return snapshot.read_snapshot(spark, path)


@query("n4_find_entities_stored", ORACLES["n4_find_entities"])
def n4_find_entities_stored(spark, folder):
    path, _ = _built_snapshot(spark, folder)
    return entities.found_customers(spark, folder, snapshot.read_snapshot(spark, path))


@query("j5_match_names_stored", ORACLES["j5_match_names"])
def j5_match_names_stored(spark, folder):
    path, _ = _built_snapshot(spark, folder)
    return entities.matched_customers(spark, folder, snapshot.read_snapshot(spark, path))


@query("n5_resolve_customers_stored", ORACLES["n5_resolve_customers"])
def n5_resolve_customers_stored(spark, folder):
    path, _ = _built_snapshot(spark, folder)
    return entities.resolved_customers(spark, folder, snapshot.read_snapshot(spark, path))


@query("f5_search_indicators_stored", ORACLES["f5_search_indicators_batch"])
def f5_search_indicators_stored(spark, folder):
    return facts.searched_parts(spark, folder, _stored(star.parts_panel(spark, folder), spark, "parts"))


# ---- catalogs -------------------------------------------------------------------------------------------


def _file(identifier, name, kind, size, modified) -> F.Column:
    return F.struct(
        F.lit(False).alias("IsFolder"), identifier.alias("Identifier"), name.alias("Name"),
        kind.alias("FileType"), size.alias("FileSize"), modified.alias("DateModified"),
    )


def order_trees(spark, folder):
    """One document tree per order, as JSON text: a list below nine to one folders, an equally new copy and a note.

    The list is deeper than the copy and stands before it.
    """
    key = F.col("o_orderkey")
    size = F.floor("o_totalprice").cast("bigint")
    millis = star.epoch_millis("o_orderdate").cast("string")
    modified = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(
        F.concat(F.lit("/Date("), millis, F.lit(")/"))
    )
    kind = F.when(F.col("o_orderpriority") == "5-LOW", ".pdf").otherwise(".XLSX")
    listing = _file(key * 3, F.concat(F.lit("Order Data "), key.cast("string")), kind, size, modified)
    copy = _file(key * 3 + 1, F.concat(F.lit("order data [copy] "), key.cast("string")), kind, size, modified)
    note = _file(key * 3 + 2, F.concat(F.lit("Note "), key.cast("string")), F.lit(".txt"), size % 100, modified)
    folders = (key % 9 + 1).cast("int")
    # Nodes of different types: the JSON text is put together from its parts.
    tree = F.concat(
        F.lit('{"IsFolder":true,"Name":"root","Children":['),
        F.repeat(F.lit('{"IsFolder":true,"Name":"lists","Children":['), folders), F.to_json(listing),
        F.repeat(F.lit("]}"), folders), F.lit(","), F.to_json(copy), F.lit(","), F.to_json(note), F.lit("]}"),
    )
    return star.table(spark, folder, "orders").select(F.col("o_custkey").alias("series"), tree.alias("tree"))


CATALOG = """files as (
  select o_custkey as series, o_orderkey * 3 + i as doc_id,
    case i when 0 then 'Order Data ' when 1 then 'order data [copy] ' else 'Note ' end || o_orderkey as name,
    case when i = 2 then '.txt' when o_orderpriority = '5-LOW' then '.pdf' else '.XLSX' end as file_type,
    case when i = 2 then cast(floor(o_totalprice) as bigint) % 100
         else cast(floor(o_totalprice) as bigint) end as size,
    cast(i as integer) as position, o_orderstatus, o_orderdate
  from orders, range(3) as t(i)),
cat as (
  select series, position, doc_id, name, file_type, size,
    case when o_orderstatus = 'P' then 'unknown'
         else '/Date(' || epoch_ms(o_orderdate) || ')/' end as modified_raw,
    case when o_orderstatus = 'P' then 0 else epoch_ms(o_orderdate) end as modified_ms
  from files)"""


def _catalog(spark, folder):
    return catalogs.flatten_catalog(order_trees(spark, folder), keep=["series"])


@query("s8_flatten_catalog", f"with {CATALOG} select * from cat")
def s8_flatten_catalog(spark, folder):
    return _catalog(spark, folder).drop("description", "file_name")


def supplier_trees(spark, folder):
    """One chain of folders per supplier, 901 to 1,000 deep, with a file at its end and a note beside its top."""
    key = F.col("s_suppkey").cast("bigint")
    kind, none = F.lit(".txt"), F.lit(None).cast("bigint")
    deep = _file(key * 2, F.concat(F.lit("Deep [list] {"), key.cast("string")), kind, key, F.concat(F.lit("["), F.col("s_name")))
    note = _file(key * 2 + 1, F.lit('Note "]}"'), kind, none, F.col("s_name"))
    folders = (1000 - key % 100).cast("int")
    tree = F.concat(
        F.lit('{"IsFolder":true,"Children":['),
        F.repeat(F.lit('{"Name":"f","IsFolder":true,"Owner":{"Children":[{}]},"Children":['), folders),
        F.to_json(deep), F.repeat(F.lit("]}"), folders), F.lit(","), F.to_json(note), F.lit("]}"),
    )
    return star.table(spark, folder, "supplier").select(key.alias("series"), tree.alias("tree"))


@query("s8_flatten_deep_catalog", """
select cast(s_suppkey as bigint) as series, cast(i as integer) as position, cast(s_suppkey * 2 + i as bigint) as doc_id,
  case i when 0 then 'Deep [list] {' || s_suppkey else 'Note "]}"' end as name,
  case i when 0 then cast(s_suppkey as bigint) end as size,
  case i when 0 then '[' else '' end || s_name as modified_raw
from supplier, range(2) as t(i)""")
def s8_flatten_deep_catalog(spark, folder):
    files = catalogs.flatten_catalog(supplier_trees(spark, folder), keep=["series"])
    return files.select("series", "position", "doc_id", "name", "size", "modified_raw")


NEWEST = """newest as (
  select * from {source} where starts_with(lower(name), 'order data') and lower(file_type) = '.xlsx'
    and doc_id <> 0
  qualify row_number() over (
    partition by series order by modified_ms desc, position, doc_id) = 1)"""


@query("s9_latest_document", f"with {CATALOG}, {NEWEST.format(source='cat')} select * from newest")
def s9_latest_document(spark, folder):
    newest = catalogs.latest_document(_catalog(spark, folder), "order data", ".xlsx", ["series"])
    return newest.drop("description", "file_name")


CUTOFF_MS = 946684800000  # 2000-01-01


@query("s10_catalog_changes", f"""with {CATALOG}, {NEWEST.format(source='cat')},
older as (select * from cat where modified_ms < {CUTOFF_MS}),
{NEWEST.format(source='older').replace('newest as', 'oldest as')}
select series, o.doc_id as old_doc_id, o.size as old_size, o.modified_raw as old_modified_raw,
  o.name as old_name, n.doc_id as new_doc_id, n.size as new_size, n.modified_raw as new_modified_raw,
  n.name as new_name,
  o.doc_id is null or n.doc_id is null or o.doc_id is distinct from n.doc_id
    or o.size is distinct from n.size or o.modified_raw is distinct from n.modified_raw
    or o.name is distinct from n.name as changed
from oldest o full join newest n using (series)""")
def s10_catalog_changes(spark, folder):
    catalog = _catalog(spark, folder)
    new = catalogs.latest_document(catalog, "Order Data", ".xlsx", ["series"])
    before = catalog.where(F.col("modified_ms") < CUTOFF_MS)
    old = catalogs.latest_document(before, "Order Data", ".xlsx", ["series"])
    return catalogs.catalog_changes(old, new, ["series"])


# ---- exports -----------------------------------------------------------------------------------------------


EXTRACT_SCHEMA = (
    "indicator_code string, indicator_name string, entity_code string, entity_name string, "
    "region string, income string, period int, value double, unit string, currency string"
)


@query("s11_export_csv", f"""{CUSTOMER}
select {', '.join(EXTRACT_COLUMNS)} from {STAR} where indicator_code in ('rev', 'rev_r_rev') and period >= 1999""")
def s11_export_csv(spark, folder):
    codes = ["rev", "rev_r_rev"]
    path = scratch_dir(spark, "extract")
    rows = research_panel(star.customer_panel(spark, folder, codes), codes, Selection(start=1999))
    export.export_csv(rows, path)
    return spark.read.schema(EXTRACT_SCHEMA).option("header", True).csv(path)


@query("s12_export_package", f"""{CUSTOMER},
picked as (select * from {STAR} where indicator_code in ('rev', 'n_items') and region = 'AMR'),
asked as (select * from book where indicator_code in ('rev', 'n_items', 'rev_x'))
select 'data' as part, indicator_code, entity_code, period, {rnd('value')} as value, unit as detail from picked
union all
select 'codebook', indicator_code, null, null, null,
  concat_ws('|', indicator_name, long_code, category_1, category_2, unit, currency, measurement_method) from asked
union all
select 'availability', indicator_code, null, null, null,
  coalesce(n, 0) || '|' || coalesce(e, 0) || coalesce('|' || low || '|' || high, '')
from asked left join (select indicator_code, count(*) as n, count(distinct entity_code) as e,
                        min(period) as low, max(period) as high from picked group by 1) using (indicator_code)
union all
select 'readme', 'rows', null, null, null, cast(count(*) as varchar) from picked""")
def s12_export_package(spark, folder):
    codes = ["rev", "n_items", "rev_x"]
    path = scratch_dir(spark, "package")
    panel = star.customer_panel(spark, folder, ["rev", "n_items"])
    export.export_package(panel, codes, path, Selection(region="AMR"))
    read = spark.read.option("header", True)
    data = read.schema(EXTRACT_SCHEMA).csv(f"{path}/data")
    book = read.schema(", ".join(f"{name} string" for name in INDICATOR_COLUMNS)).csv(f"{path}/codebook")
    found = read.schema(
        "indicator_code string, observation_count bigint, entity_count bigint, first_period int, "
        "latest_period int"
    ).csv(f"{path}/availability")
    line = spark.read.text(f"{path}/readme").where(F.startswith("value", F.lit("rows = ")))

    def part(rows, name, detail, code="indicator_code", entity=None, period=None, value=None):
        return rows.select(
            F.lit(name).alias("part"), code, F.lit(entity).cast("string").alias("entity_code"),
            F.lit(period).cast("int").alias("period"), F.lit(value).cast("double").alias("value"),
            detail.alias("detail"),
        )

    parts = [
        part(rounded(data, "value"), "data", F.col("unit"), "indicator_code", F.col("entity_code"),
             F.col("period"), F.col("value")),
        part(book, "codebook", F.concat_ws("|", *INDICATOR_COLUMNS[1:])),
        part(found, "availability", F.concat_ws(
            "|", "observation_count", "entity_count", "first_period", "latest_period")),
        part(line, "readme", F.substring_index("value", " ", -1), F.lit("rows").alias("indicator_code")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
