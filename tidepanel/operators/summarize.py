"""Availability, counts, group statistics, trends, rankings, quality and result warnings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.dims import tables
from tidepanel.functions import cagr, is_blank, pct_change
from tidepanel.model import ALL, ENTITY_COLUMNS, Panel, Selection
from tidepanel.operators.select import (
    SERIES_KEY,
    _filtered_facts,
    latest_of_series,
    members_only,
    ordered_page,
    require_indicators,
    select_observations,
    selected_entities,
)
from tidepanel.plans import ROWS, count_table, table_medians, top_per_group, with_rank

CHANGE_METRICS = ("absolute_change", "percent_change", "cagr")
GROUPINGS = ("region", "income", "group")
SELECTION = "selection"
TREND_COLUMNS = (
    "indicator_code", "entity_code", "entity_name", "region", "income", "first_period",
    "first_value", "latest_period", "latest_value", "period_count", "period_span",
    "absolute_change", "percent_change", "cagr",
)
UNSPECIFIED = "Unspecified"
MIXED_SPAN = 5


# ---- A1, J4: availability ------------------------------------------------------------------------------


def fill_requested(
    spark, codes: Sequence[str], found: DataFrame, key: str, counts: Sequence[str]
) -> DataFrame:
    """Every requested key once: keys without facts get zero counts and null measures."""
    wanted = tables.literal_table(spark, {key: tables.TEXT}, [(code,) for code in dict.fromkeys(codes)])
    return wanted.join(found, key, "left").fillna(0, list(counts))


def data_availability(
    panel: Panel, codes: Sequence[str] | None = None, sel: Selection = ALL
) -> DataFrame:
    """Observations, distinct entities and period range per indicator, by code.

    Rows are first combined per (indicator, entity), which spreads a hot indicator over all tasks; the
    second aggregation then only sees one row per entity and map task.
    """
    facts = select_observations(panel, codes, sel)
    per_entity = facts.groupBy(*SERIES_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min("period").alias("low"), F.max("period").alias("high")
    )
    found = per_entity.groupBy("indicator_code").agg(
        F.sum("n").alias("observation_count"),
        F.count(F.lit(1)).alias("entity_count"),
        F.min("low").alias("first_period"),
        F.max("high").alias("latest_period"),
    )
    if codes is not None:
        found = fill_requested(
            panel.spark, codes, found, "indicator_code", ["observation_count", "entity_count"]
        )
    return found.orderBy("indicator_code")


# ---- A2, A3: counts --------------------------------------------------------------------------------------


def category_counts(panel: Panel) -> DataFrame:
    """Codebook rows by category_1 (``level`` 1) and by both categories (``level`` 2)."""
    counted = panel.indicators.groupingSets(
        [["category_1"], ["category_1", "category_2"]], "category_1", "category_2"
    ).agg(F.grouping_id().alias("__set"), F.count(F.lit(1)).alias("n"))
    level = F.when(F.col("__set") == 0, 2).otherwise(1)
    return counted.select(level.alias("level"), "category_1", "category_2", "n").orderBy(
        "level", F.desc("n"), "category_1", "category_2"
    )


def group_counts(panel: Panel) -> DataFrame:
    """Entities by region, by income and by both (``grouping``); null labels are left out per set."""
    counted = panel.entities.groupingSets(
        [["region"], ["income"], ["region", "income"]], "region", "income"
    ).agg(F.grouping_id().alias("__set"), F.count(F.lit(1)).alias("entity_count"))
    # grouping_id has a bit for every column that is not part of the set: income 1, region 2.
    by_region = (F.col("__set") == 1) & F.col("region").isNotNull()
    by_income = (F.col("__set") == 2) & F.col("income").isNotNull()
    by_both = (F.col("__set") == 0) & F.col("region").isNotNull() & F.col("income").isNotNull()
    grouping = F.when(by_region, "region").when(by_income, "income").otherwise("region_income")
    return (
        counted.where(by_region | by_income | by_both)
        .select(grouping.alias("grouping"), "region", "income", "entity_count")
        .orderBy("grouping", "region", "income")
    )


# ---- A4, W4: group statistics -----------------------------------------------------------------------------


def group_assignment(panel: Panel, by: str | None, entities: DataFrame) -> DataFrame:
    """``(entity_code, group_code)`` by region, income or curated group; an entity may be in many.

    ``by=None`` makes all entities one group, named ``selection``.
    """
    if by is None:
        # Computed per row: joins on a constant would be planned as cross joins.
        name = F.concat(F.substring("entity_code", 1, 0), F.lit(SELECTION))
        return entities.select("entity_code", name.alias("group_code"))
    if by not in GROUPINGS:
        raise ValueError(f"by must be one of {', '.join(GROUPINGS)}")
    if by == "group":
        return members_only(panel.group_members, entities)
    label = F.col(by)
    return entities.where(label.isNotNull()).select("entity_code", label.alias("group_code"))


def _group_facts(
    panel: Panel,
    by: str | None,
    codes: Sequence[str] | None,
    period: int | None,
    latest_only: bool,
    sel: Selection,
    firsts: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The facts with their groups, and the groups' members; ``firsts`` marks one row of every series."""
    assignment = group_assignment(panel, by, selected_entities(panel, sel))
    if period is not None:
        sel = sel.between(period, period)
    facts = _filtered_facts(panel, codes, sel)
    if latest_only and period is None:
        facts = latest_of_series(facts)
    if firsts:
        in_series = Window.partitionBy(*SERIES_KEY).orderBy("period")
        facts = facts.where("period is not null").withColumn("first", F.row_number().over(in_series) == 1)
    return facts.where("period is not null").join(assignment, "entity_code"), assignment


def summarize_groups(
    panel: Panel,
    by: str | None,
    codes: Sequence[str] | None = None,
    period: int | None = None,
    latest_only: bool = True,
    sel: Selection = ALL,
) -> DataFrame:
    """Statistics of every (indicator, group): n, mean, exact median, min, max, coverage, periods.

    ``by=None`` summarises the selection as one group. ``period`` selects that period only. Otherwise the latest row
    of each entity counts, or with ``latest_only=False`` every row. Statistics are unweighted. With requested ``codes``
    every pair of code and group appears, also without data. ``periods`` is the sorted set of periods seen.

    The facts are read once: everything is taken from one written table of counts by group, value and period.
    """
    one_row_per_entity = latest_only or period is not None
    facts, assignment = _group_facts(panel, by, codes, period, latest_only, sel, firsts=not one_row_per_entity)
    keys = ["indicator_code", "group_code"]
    covered = F.count(F.lit(1)) if one_row_per_entity else F.count_if("first")
    table = count_table(facts, keys, "value", ["period"], {"covered": covered})
    n = F.sum(F.when(F.col("value").isNotNull(), F.col(ROWS)).otherwise(0))
    stats = table.groupBy(*keys).agg(
        n.alias("n"),
        (F.sum(F.col("value") * F.col(ROWS)) / F.nullif(n, F.lit(0))).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.array_sort(F.collect_set("period")).alias("periods"),
        F.sum("covered").alias("entities_with_data"),
    ).join(table_medians(table, keys, "value"), keys, "left")
    sizes = assignment.groupBy("group_code").agg(F.count(F.lit(1)).alias("entity_count"))
    if codes is not None:
        wanted = F.explode(F.array(*[F.lit(code) for code in dict.fromkeys(codes)]))
        grid = sizes.select("group_code", "entity_count", wanted.alias("indicator_code"))
        rows = grid.join(stats, keys, "left").fillna(0, ["n", "entities_with_data"])
    else:
        rows = stats.join(sizes, "group_code")
    coverage = F.col("entities_with_data") / F.nullif(F.col("entity_count"), F.lit(0))
    no_periods = F.array().cast("array<int>")
    return rows.select(
        *keys, "n", "mean", "median", "min", "max", "entity_count", "entities_with_data",
        coverage.alias("coverage_ratio"), F.coalesce("periods", no_periods).alias("periods"),
    ).orderBy(*keys)


def top_bottom(
    panel: Panel,
    by: str | None,
    codes: Sequence[str] | None = None,
    n: int = 5,
    period: int | None = None,
    latest_only: bool = True,
    sel: Selection = ALL,
) -> DataFrame:
    """First and last ``n`` entities of every (indicator, group) by value.

    Bottom: value, then entity ascending, then newest period; top is the exact reverse of that order.
    Every row stands for both ends, so that one pass cuts both to n rows before the shuffle.
    """
    facts, _ = _group_facts(panel, by, codes, period, latest_only, sel)
    keys = ["indicator_code", "group_code"]
    sides = facts.withColumn("side", F.explode(F.array(F.lit("bottom"), F.lit("top"))))

    def at(side: str, name: str):
        return F.when(F.col("side") == side, F.col(name))

    # Within one side the other side's expressions are all null and decide nothing.
    order = [
        at("bottom", "value").asc(), at("bottom", "entity_code").asc(), at("bottom", "period").desc(),
        at("top", "value").desc(), at("top", "entity_code").desc(), at("top", "period").asc(),
    ]
    rows = top_per_group(sides, [*keys, "side"], order, n, ["entity_code", "period"], rank="rank")
    return rows.select(*keys, "side", "rank", "entity_code", "period", "value").orderBy(
        *keys, "side", "rank"
    )


# ---- A6, W3: trends -----------------------------------------------------------------------------------------


def _trend_rows(
    panel: Panel,
    codes: Sequence[str] | None,
    sel: Selection,
    min_count: int | None,
    min_span: int | None,
) -> DataFrame:
    """First and latest point of every series, one combined pass over the facts."""
    ends = _filtered_facts(panel, codes, sel).groupBy(*SERIES_KEY).agg(
        F.min("period").alias("first_period"),
        F.min_by("value", "period").alias("first_value"),
        F.max("period").alias("latest_period"),
        F.max_by("value", "period").alias("latest_value"),
        F.count(F.lit(1)).alias("period_count"),
    )
    first, last = F.col("first_value"), F.col("latest_value")
    span = F.col("latest_period") - F.col("first_period")
    rows = ends.withColumns({
        "period_span": span,
        "absolute_change": last - first,
        "percent_change": pct_change(first, last),
        "cagr": cagr(first, last, span),
    })
    if min_count is not None:
        rows = rows.where(F.col("period_count") >= min_count)
    if min_span is not None:
        rows = rows.where(F.col("period_span") >= min_span)
    return rows.join(panel.entities.select(*ENTITY_COLUMNS), "entity_code").select(*TREND_COLUMNS)


def indicator_trends(
    panel: Panel,
    codes: Sequence[str] | None = None,
    sel: Selection = ALL,
    min_count: int | None = None,
    min_span: int | None = None,
    top: int | None = None,
) -> DataFrame:
    """Change of every series from its first to its latest period.

    Ordered by indicator, then absolute change descending, then entity; ``top`` is per indicator.
    """
    rows = _trend_rows(panel, codes, sel, min_count, min_span)
    largest_first = [F.desc("absolute_change"), F.asc("entity_code")]
    if top is not None:
        rows = top_per_group(rows, ["indicator_code"], largest_first, top, ["entity_code"])
    return rows.orderBy("indicator_code", *largest_first)


def rank_changes(
    panel: Panel,
    codes: Sequence[str] | None = None,
    metric: str = "absolute_change",
    descending: bool = True,
    sel: Selection = ALL,
    min_count: int | None = None,
    min_span: int | None = None,
    top: int | None = 20,
) -> DataFrame:
    """Series ranked within their indicator by a change metric; series without it are left out.

    Ties go to the larger absolute change, then the entity code, in both directions. ``top=None``
    ranks all rows, by sorted range partitions and their counts.
    """
    if metric not in CHANGE_METRICS:
        raise ValueError(f"metric must be one of {', '.join(CHANGE_METRICS)}")
    rows = _trend_rows(panel, codes, sel, min_count, min_span).where(F.col(metric).isNotNull())
    lead = F.desc(metric) if descending else F.asc(metric)
    order = [lead, F.desc("absolute_change"), F.asc("entity_code")]
    if top is None:
        return with_rank(rows, ["indicator_code"], order).orderBy("indicator_code", "rank")
    ranked = top_per_group(rows, ["indicator_code"], order, top, ["entity_code"], rank="rank")
    return ranked.orderBy("indicator_code", "rank")


# ---- A7: quality -------------------------------------------------------------------------------------------


def _selected_notes(panel: Panel, codes: Sequence[str] | None, sel: Selection) -> DataFrame:
    notes = panel.source_notes
    if codes is not None:
        notes = notes.where(F.col("indicator_code").isin(list(codes)))
    return members_only(notes, selected_entities(panel, sel)) if sel.filters_entities else notes


def data_type_counts(
    panel: Panel, codes: Sequence[str] | None = None, sel: Selection = ALL
) -> DataFrame:
    """Notes per (indicator, data type); a missing type counts as ``Unspecified``."""
    notes = _selected_notes(panel, codes, sel)
    named = F.when(is_blank(F.col("data_type")), UNSPECIFIED).otherwise(F.col("data_type"))
    return notes.groupBy("indicator_code", named.alias("data_type")).agg(
        F.count(F.lit(1)).alias("note_count"),
        F.count_if(~is_blank(F.col("sources"))).alias("with_sources"),
        F.count_if(~is_blank(F.col("methods_of_estimation"))).alias("with_methods"),
        F.count_if(~is_blank(F.col("footnote"))).alias("with_footnotes"),
        F.count_if(~is_blank(F.col("comments"))).alias("with_comments"),
    )


def assess_quality(
    panel: Panel, codes: Sequence[str] | None = None, sel: Selection = ALL
) -> DataFrame:
    """Availability plus a profile of the source notes and caution flags per indicator.

    ``data_types`` maps each data type to its number of notes. All filters apply to facts and notes
    alike. With ``codes=None`` every codebook indicator is assessed.
    """
    if codes is None:
        facts = data_availability(panel, None, sel)
        available = (
            panel.indicators.select("indicator_code")
            .join(facts, "indicator_code", "left")
            .fillna(0, ["observation_count", "entity_count"])
        )
    else:
        available = data_availability(panel, require_indicators(panel, codes), sel)
    by_type = data_type_counts(panel, codes, sel)
    counts = ["note_rows", "with_sources", "with_methods", "with_footnotes", "with_comments"]
    notes = by_type.groupBy("indicator_code").agg(
        F.sum("note_count").alias("note_rows"),
        *[F.sum(name).alias(name) for name in counts[1:]],
        F.map_from_entries(F.collect_list(F.struct("data_type", "note_count"))).alias("data_types"),
        F.bool_or(F.contains(F.lower("data_type"), F.lit("estimated"))).alias("estimated"),
    )
    no_types = F.create_map().cast("map<string,bigint>")
    return (
        available.join(notes, "indicator_code", "left")
        .fillna(0, counts)
        .select(
            "indicator_code", "observation_count", "entity_count", "first_period", "latest_period",
            *counts,
            F.coalesce("data_types", no_types).alias("data_types"),
            (F.col("observation_count") == 0).alias("no_observations"),
            F.coalesce("estimated", F.lit(False)).alias("estimated_data_present"),
            (F.col("with_footnotes") + F.col("with_comments") > 0).alias("entity_notes_present"),
        )
        .orderBy("indicator_code")
    )


def sample_notes(
    panel: Panel, codes: Sequence[str] | None = None, sel: Selection = ALL, top: int = 20
) -> DataFrame:
    """The first notes of each indicator by entity: the rows shown next to a quality assessment."""
    notes = _selected_notes(panel, codes, sel)
    first = top_per_group(notes, ["indicator_code"], [F.col("entity_code")], top, ["entity_code"])
    return first.orderBy("indicator_code", "entity_code")


# ---- A9: warnings --------------------------------------------------------------------------------------------


WARNING_COLUMNS = ("type", "key", "min_value", "max_value", "values")


def mixed_period_warnings(rows: DataFrame, key: str, kind: str = "mixed_latest_years") -> DataFrame:
    """Keys of a latest-only result whose rows come from more than one period.

    The set of periods per key is as small as the number of distinct periods, and it is built from the
    already distinct (key, period) pairs.
    """
    seen = rows.where("period is not null").select(F.col(key).alias("key"), "period").distinct()
    return (
        seen.groupBy("key")
        .agg(
            F.min("period").cast("bigint").alias("min_value"),
            F.max("period").cast("bigint").alias("max_value"),
            F.array_sort(F.collect_list("period")).alias("values"),
        )
        .where(F.size("values") > 1)
        .withColumn("type", F.lit(kind))
        .select(*WARNING_COLUMNS)
    )


def mixed_span_warnings(trends: DataFrame, key: str) -> DataFrame:
    """Keys of a trend result whose spans differ by five periods or more."""
    spans = trends.groupBy(F.col(key).alias("key")).agg(
        F.min("period_span").cast("bigint").alias("min_value"),
        F.max("period_span").cast("bigint").alias("max_value"),
        F.count("period_span").alias("__rows"),
    )
    mixed = (F.col("__rows") >= 2) & (F.col("max_value") - F.col("min_value") >= MIXED_SPAN)
    return (
        spans.where(mixed)
        .withColumns({"type": F.lit("mixed_periods"), "values": F.lit(None).cast("array<int>")})
        .select(*WARNING_COLUMNS)
    )


def limit_warnings(rows: DataFrame, top: int, key: str = "result") -> DataFrame:
    """A row when a limited result has as many rows as its limit, so more may exist."""
    counted = rows.limit(top).agg(F.count(F.lit(1)).alias("max_value"))
    return (
        counted.where(F.col("max_value") >= top)
        .withColumns({
            "type": F.lit("top_limit_reached"),
            "key": F.lit(key),
            "min_value": F.lit(top).cast("bigint"),
            "values": F.lit(None).cast("array<int>"),
        })
        .select(*WARNING_COLUMNS)
    )


def result_warnings(*parts: DataFrame) -> DataFrame:
    """All warnings of a result as one table."""
    return reduce(DataFrame.unionByName, parts).orderBy("type", "key")
