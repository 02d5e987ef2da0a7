"""Panels derived from a star schema of orders, customers, parts, suppliers and events.

``customer_panel`` and ``nation_panel`` measure revenue by customer or nation and order year;
``events_panel`` measures daily activity of users; ``parts_panel`` has one indicator per part, which is
the shape of a codebook with very many indicators. Only the columns and aggregates that the wanted
indicators need are computed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.dims import tables
from tidepanel.model import INDICATOR_COLUMNS, Panel
from tidepanel.plans.spread import tasks_for
from tidepanel.sources.load import load_codebook, load_notes

# ISO3 codes and names given to the nation keys 0-24, so that curated groups apply.
NATIONS = (
    ("KEN", "Kenya"), ("COL", "Colombia"), ("IND", "India"), ("FRA", "France"), ("EGY", "Egypt"),
    ("GHA", "Ghana"), ("PER", "Peru"), ("JPN", "Japan"), ("DEU", "Germany"), ("JOR", "Jordan"),
    ("ETH", "Ethiopia"), ("USA", "United States of America"), ("VNM", "Viet Nam"),
    ("POL", "Poland"), ("MAR", "Morocco"), ("NGA", "Nigeria"), ("BRA", "Brazil"),
    ("KHM", "Cambodia"), ("TUR", "Türkiye"), ("YEM", "Yemen"), ("ZMB", "Zambia"),
    ("HTI", "Haiti"), ("CHN", "China"), ("GBR", "United Kingdom"), ("IRN", "Iran"),
)
REGIONS = {
    "AFRICA": "AFR", "AMERICA": "AMR", "ASIA": "WPR", "EUROPE": "EUR", "MIDDLE EAST": "EMR",
}
INCOMES = ("Low", "Lower-middle", "Upper-middle", "High")

AMOUNTS = ("rev", "rev_a", "rev_n", "rev_r", "rev_o", "rev_f")
CUSTOMER_INDICATORS = (*AMOUNTS, "rev_r_rev", "n_items")
DETAIL = "HEALTH EXPENDITURE DATA"
CUSTOMER_CODEBOOK = (
    ("rev", "Revenue", "sha11.REV", "INDICATORS", "AGGREGATES", "Millions", "NCU", "REV_O + REV_F"),
    ("rev_a", "Revenue, flag A", "sha11.REV.A", DETAIL, "FLAGS", "Millions", "NCU", None),
    ("rev_n", "Revenue, flag N", "sha11.REV.N", DETAIL, "FLAGS", "Millions", "NCU", None),
    ("rev_r", "Revenue, flag R", "sha11.REV.R", DETAIL, "FLAGS", "Millions", "NCU", None),
    ("rev_o", "Revenue, status O", "REV_O", DETAIL, "STATUS", "Millions", "NCU", None),
    ("rev_f", "Revenue, status F", "REV_F", DETAIL, "STATUS", "Millions", "NCU", None),
    ("rev_r_rev", "Share of flag R", "REV_R%REV", "INDICATORS", "FLAGS", "Percentage", None,
     "REV_R / REV"),
    ("n_items", "Number of lines", "N_ITEMS", "MACRO DATA", "MACRO", "Count", None, None),
    ("rev_x", "Revenue, other", "sha11.REV.X.1", DETAIL, "FLAGS", "Millions", "NCU", None),
)
CUSTOMER_RELATIONS = (
    ("rev", "rev_by_status", ("rev_o", "rev_f")),
    ("rev", "rev_partial", ("rev_a", "rev_n")),
)


# Known schemas spare the job that would read them from a file footer.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
              "props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def epoch_millis(column: str) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def _money(column: str) -> Column:
    """Exact decimal money: its sums do not depend on the order of rows."""
    return F.col(column).cast("decimal(18,2)")


def _region_label() -> Column:
    label = F.lit(None).cast("string")
    for name, code in REGIONS.items():
        label = F.when(F.col("r_name") == name, code).otherwise(label)
    return label


def _income_label(key: str) -> Column:
    return F.element_at(
        F.array(*[F.lit(label) for label in INCOMES]), (F.col(key) % 4 + 1).cast("int")
    )


def nation_regions(spark: SparkSession, folder: str) -> DataFrame:
    """``(n_nationkey, region)``."""
    return (
        table(spark, folder, "nation")
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", _region_label().alias("region"))
    )


# ---- revenue by customer or nation ----------------------------------------------------------------------


def _measures(indicators: Sequence[str]) -> dict[str, Column]:
    """The exact sums the wanted indicators need, before any cast to double."""
    price, flag, status = F.col("price"), F.col("l_returnflag"), F.col("l_linestatus")
    sums = {
        "rev": F.sum(price),
        "rev_a": F.sum(F.when(flag == "A", price)),
        "rev_n": F.sum(F.when(flag == "N", price)),
        "rev_r": F.sum(F.when(flag == "R", price)),
        "rev_o": F.sum(F.when(status == "O", price)),
        "rev_f": F.sum(F.when(status == "F", price)),
        "n_items": F.count(F.lit(1)),
    }
    needed = set(indicators) | ({"rev", "rev_r"} if "rev_r_rev" in indicators else set())
    return {name: measure for name, measure in sums.items() if name in needed}


def revenue_wide(
    spark: SparkSession,
    folder: str,
    by: str = "customer",
    indicators: Sequence[str] = CUSTOMER_INDICATORS,
) -> DataFrame:
    """``(entity_code, period, *indicators)``: revenue measures by customer or nation and order year."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", _money("l_extendedprice").alias("price"), "l_returnflag", "l_linestatus"
    )
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("period")
    )
    measures = _measures(indicators)
    wide = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("customer"), "period")
        .agg(*[measure.alias(name) for name, measure in measures.items()])
    )
    if by == "customer":
        wide = wide.withColumn("entity_code", F.col("customer").cast("string"))
    else:
        # The nation join and its aggregation only see the sums per customer and year.
        customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
        wide = (
            wide.join(customers, F.col("customer") == F.col("c_custkey"))
            .join(nation_codes(spark), F.col("c_nationkey") == F.col("key"))
            .groupBy(F.col("code").alias("entity_code"), "period")
            .agg(*[F.sum(name).alias(name) for name in measures])
        )
    wide = wide.withColumns({name: F.col(name).cast("double") for name in measures})
    if "rev_r_rev" in indicators:
        wide = wide.withColumn("rev_r_rev", 100 * F.col("rev_r") / F.nullif(F.col("rev"), F.lit(0.0)))
    return wide.select("entity_code", "period", *indicators)


def _long(wide: DataFrame, indicators: Sequence[str]) -> DataFrame:
    long = wide.unpivot(["entity_code", "period"], list(indicators), "indicator_code", "value")
    return long.where("value is not null").select("entity_code", "period", "indicator_code", "value")


def customer_entities(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "customer")
        .join(nation_regions(spark, folder), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").cast("string").alias("entity_code"),
            F.col("c_name").alias("entity_name"),
            "region",
            _income_label("c_custkey").alias("income"),
        )
    )


def customer_notes_raw(spark: SparkSession, folder: str) -> DataFrame:
    """One raw note row per order, for indicator ``rev`` if the order has a price.

    ``row_no`` orders the rows by date and key.
    """
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    missing = F.lit(None).cast("string")
    customers = customer_entities(spark, folder)
    orders = table(spark, folder, "orders").withColumn("code", F.col("o_custkey").cast("string"))
    return orders.join(customers, F.col("code") == F.col("entity_code")).select(
        "entity_name",
        F.col("code").alias("entity_code"),
        "region",
        "income",
        F.when(F.col("o_totalprice").isNotNull(), "rev").alias("indicator_code"),
        F.lit("sha11.REV").alias("long_code"),
        F.lit("Revenue").alias("indicator_name"),
        F.when(priority != "4-NOT SPECIFIED", priority).alias("sources"),
        missing.alias("comments"),
        F.when(status == "F", "Documented").when(status == "P", "Estimated").alias("data_type"),
        missing.alias("methods_of_estimation"),
        F.when(priority == "1-URGENT", "urgent").alias("footnote"),
        F.struct("o_orderdate", "o_orderkey").alias("row_no"),
    )


def customer_codebook(spark: SparkSession) -> DataFrame:
    return tables.literal_table(
        spark, {name: tables.TEXT for name in INDICATOR_COLUMNS}, CUSTOMER_CODEBOOK
    )


def customer_memberships(spark: SparkSession, folder: str) -> DataFrame:
    """Customers in the curated groups of their nation: a membership table that grows with the data."""
    members = tables.memberships(spark).select("group_code", F.col("entity_code").alias("code"))
    return (
        table(spark, folder, "customer")
        .join(nation_codes(spark), F.col("c_nationkey") == F.col("key"))
        .join(members, "code")
        .select("group_code", F.col("c_custkey").cast("string").alias("entity_code"))
    )


def customer_panel(
    spark: SparkSession, folder: str, indicators: Sequence[str] = CUSTOMER_INDICATORS
) -> Panel:
    return Panel(
        observations=lambda: _long(revenue_wide(spark, folder, "customer", indicators), indicators),
        entities=lambda: customer_entities(spark, folder),
        indicators=lambda: customer_codebook(spark),
        notes=lambda: load_notes(customer_notes_raw(spark, folder)),
        memberships=lambda: customer_memberships(spark, folder),
        relations=lambda: tables.relations(spark, CUSTOMER_RELATIONS),
    )


def customer_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """The wide sheet of the customer panel as a raw input, with an order and dirty rows.

    Every customer has one row without a period, under a second name that must not win; an indicator
    column the codebook does not know is added.
    """
    customers = customer_entities(spark, folder)
    wide = revenue_wide(spark, folder)
    cells = wide.withColumn("not_in_codebook", F.col("rev"))
    measures = cells.columns[2:]
    rows = cells.join(customers, "entity_code").select(
        F.col("entity_name").alias("location"),
        F.col("entity_code").alias("code"),
        "region",
        "income",
        F.col("period").alias("year"),
        *measures,
        F.col("period").cast("bigint").alias("row_no"),
    )
    renamed_rows = customers.select(
        F.concat(F.lit("Formerly "), F.col("entity_name")).alias("location"),
        F.col("entity_code").alias("code"),
        F.lit("?").alias("region"),
        F.lit("?").alias("income"),
        F.lit(None).cast("int").alias("year"),
        *[F.lit(1.0).alias(name) for name in measures],
        F.lit(9999).cast("bigint").alias("row_no"),
    )
    return rows.unionByName(renamed_rows)


# ---- nations ----------------------------------------------------------------------------------------------


def nation_codes(spark: SparkSession) -> DataFrame:
    rows = [(key, code, name) for key, (code, name) in enumerate(NATIONS)]
    return tables.literal_table(spark, {"key": tables.INT, "code": tables.TEXT, "name": tables.TEXT}, rows)


def nation_entities(spark: SparkSession, folder: str) -> DataFrame:
    return (
        nation_regions(spark, folder)
        .join(nation_codes(spark), F.col("n_nationkey") == F.col("key"))
        .select(
            F.col("code").alias("entity_code"),
            F.col("name").alias("entity_name"),
            "region",
            _income_label("n_nationkey").alias("income"),
        )
    )


def nation_panel(
    spark: SparkSession, folder: str, indicators: Sequence[str] = CUSTOMER_INDICATORS
) -> Panel:
    return Panel(
        observations=lambda: _long(revenue_wide(spark, folder, "nation", indicators), indicators),
        entities=lambda: nation_entities(spark, folder),
        indicators=lambda: customer_codebook(spark),
        relations=lambda: tables.relations(spark, CUSTOMER_RELATIONS),
    )


# ---- events -----------------------------------------------------------------------------------------------


def events_panel(spark: SparkSession, folder: str) -> Panel:
    """Users by day since 2024-01-01 by event type; the codebook is the set of event types."""
    events = table(spark, folder, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    facts = events.groupBy(
        F.col("user_id").cast("string").alias("entity_code"),
        day.alias("period"),
        F.col("event_type").alias("indicator_code"),
    ).agg(F.sum(_money("value")).cast("double").alias("value"))
    users = events.select(F.col("user_id").cast("string").alias("entity_code")).distinct()
    missing = F.lit(None).cast("string")
    kinds = events.select(F.col("event_type").alias("indicator_code")).distinct()
    return Panel(
        observations=facts.where("value is not null"),
        entities=users.select(
            "entity_code",
            F.concat(F.lit("User "), F.col("entity_code")).alias("entity_name"),
            missing.alias("region"),
            missing.alias("income"),
        ),
        indicators=kinds.select(
            "indicator_code",
            F.initcap("indicator_code").alias("indicator_name"),
            *[missing.alias(name) for name in INDICATOR_COLUMNS[2:]],
        ),
    )


# ---- parts as indicators --------------------------------------------------------------------------------------


def parts_codebook_raw(spark: SparkSession, folder: str) -> DataFrame:
    """A raw codebook with a row per part and per brand, plus rows that the loader must skip.

    Parts hang below their brand in the long-code tree; every tenth size carries an underscore, every
    fifth is a percentage, every seventh a ratio, every eleventh has no usable code.
    """
    part = table(spark, folder, "part")
    size = F.col("p_size")
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1)
    key = F.col("p_partkey").cast("string")
    share = size % 5 == 0
    code = (
        F.when(size % 22 == 0, F.lit(None).cast("string"))
        .when(size % 11 == 0, F.lit("region"))
        .otherwise(F.concat(F.lit("p"), key))
    )
    parts = part.select(
        code.alias("variable_code"),
        F.concat_ws(" ", "p_name", key).alias("variable_name"),
        F.concat(
            F.lit("sha11."), brand, F.lit("."), key, F.when(size % 10 == 0, "_x").otherwise("")
        ).alias("long_code"),
        F.col("p_type").alias("category_1"),
        F.col("p_brand").alias("category_2"),
        F.when(share, "Percentage").otherwise("Millions").alias("unit"),
        F.when(share, "-").otherwise("NCU").alias("currency"),
        F.when(size % 7 == 0, "QTY / ALL").otherwise("-").alias("method"),
    )
    brands = part.select("p_brand", brand.alias("brand")).distinct().select(
        F.concat(F.lit("b"), F.col("brand")).alias("variable_code"),
        F.col("p_brand").alias("variable_name"),
        F.concat(F.lit("sha11."), F.col("brand")).alias("long_code"),
        F.lit("INDICATORS").alias("category_1"),
        F.lit("-").alias("category_2"),
        F.lit("Millions").alias("unit"),
        F.lit("NCU").alias("currency"),
        F.lit("-").alias("method"),
    )
    return parts.unionByName(brands)


#: Lines whose sums one task holds at once, at most on average, and at least if a shuffle has the tasks.
TASK_LINES, LEAST_LINES = 250_000, 20_000


def parts_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity by part and by brand (indicators), supplier and ship year.

    Few lines share a key, so they are dealt before they are summed, to a number of tasks that grows with them: sums
    begun where lines are read would hold as many groups as a file split has lines.
    """
    tasks = tasks_for(spark, table(spark, folder, "lineitem").count(), TASK_LINES, LEAST_LINES)
    lines = table(spark, folder, "lineitem").select(
        "l_partkey",
        F.col("l_suppkey").cast("string").alias("entity_code"),
        F.year("l_shipdate").alias("period"),
        _money("l_quantity").alias("quantity"),
    )
    per_part = (
        lines.repartition(tasks, "l_partkey", "entity_code", "period")
        .groupBy("l_partkey", "entity_code", "period")
        .agg(F.sum("quantity").alias("quantity"))
    )
    brands = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat(F.lit("b"), F.regexp_extract("p_brand", r"(\d+)$", 1)).alias("indicator_code"),
    )
    per_brand = (
        per_part.join(brands, "l_partkey")
        .repartition(tasks, "indicator_code", "entity_code", "period")
        .groupBy("indicator_code", "entity_code", "period")
        .agg(F.sum("quantity").alias("quantity"))
    )
    facts = per_part.select(
        "entity_code", "period",
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("indicator_code"), "quantity",
    ).unionByName(per_brand)
    return facts.select(
        "entity_code", "period", "indicator_code", F.col("quantity").cast("double").alias("value")
    )


def supplier_entities(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "supplier")
        .join(nation_regions(spark, folder), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("s_suppkey").cast("string").alias("entity_code"),
            F.col("s_name").alias("entity_name"),
            "region",
            _income_label("s_suppkey").alias("income"),
        )
    )


def parts_panel(spark: SparkSession, folder: str) -> Panel:
    """Parts and brands as indicators, suppliers as entities, ship years as periods."""
    return Panel(
        observations=lambda: parts_facts(spark, folder),
        entities=lambda: supplier_entities(spark, folder),
        indicators=lambda: load_codebook(parts_codebook_raw(spark, folder)),
    )
