"""Selections, lookups, star joins, latest and as-of values, and panel extracts.

Latest and as-of values use ``max_by``/``max`` aggregates rather than a window: they combine on the map
side without a sort, and the observation key makes the latest row of a series unique.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.dims import fixed, tables
from tidepanel.functions import contains_any, equals_any, stripped
from tidepanel.model import (
    ALL,
    DATA_COLUMNS,
    ENTITY_COLUMNS,
    INDICATOR_COLUMNS,
    NOTE_COLUMNS,
    SEARCHED_COLUMNS,
    Panel,
    Selection,
)
from tidepanel.operators import resolve
from tidepanel.plans import as_of_join, substring_pairs, top_per_group, with_rank

SERIES_KEY = ["indicator_code", "entity_code"]
HEADLINE = "INDICATORS"
#: Pages that end within the first so many rows are cut by a top-k, which every task holds in memory.
TOP_ROWS = 10_000


# ---- F1: selection ----------------------------------------------------------------------------------


def _in_codes(df: DataFrame, column: str, codes: Sequence[str]) -> DataFrame:
    """Rows of the codes a caller listed; a filter the scan can evaluate, however long the list is."""
    return df.where(F.col(column).isin(list(dict.fromkeys(codes))))


def require_indicators(panel: Panel, codes: Sequence[str]) -> list[str]:
    """Distinct codes in order; codes the codebook does not have are an error."""
    codes = list(dict.fromkeys(codes))
    if not codes:
        raise ValueError("indicator codes must be a non-empty list")
    known = {
        row[0]
        for row in _in_codes(panel.indicators.select("indicator_code"), "indicator_code", codes).collect()
    }
    missing = [code for code in codes if code not in known]
    if missing:
        raise ValueError(f"Unknown indicator(s): {', '.join(missing)}")
    return codes


def selected_entities(panel: Panel, sel: Selection = ALL) -> DataFrame:
    """Entities that satisfy every entity filter of the selection."""
    entities = panel.entities
    regions = resolve.region_label(panel, sel.region)
    incomes = resolve.income_labels(panel, sel.income)
    if regions:
        entities = entities.where(resolve.label_filter("region", regions))
    if incomes:
        entities = entities.where(resolve.label_filter("income", incomes))
    if sel.entities and not sel.group:
        entities = _in_codes(entities, "entity_code", resolve.entity_codes(panel, sel.entities))
    elif sel.group:
        wanted = resolve.selection_entities(panel, sel.entities, sel.group)
        entities = entities.join(wanted, "entity_code", "left_semi")
    return entities


def _facts(panel: Panel, codes: Sequence[str] | None, sel: Selection) -> DataFrame:
    """Facts cut by everything the scan can evaluate: indicator and period."""
    facts = panel.observations
    if codes is not None:
        facts = _in_codes(facts, "indicator_code", require_indicators(panel, codes))
    if sel.start is not None:
        facts = facts.where(F.col("period") >= sel.start)
    if sel.end is not None:
        facts = facts.where(F.col("period") <= sel.end)
    return facts


def _filtered_facts(panel: Panel, codes: Sequence[str] | None, sel: Selection) -> DataFrame:
    """Facts cut by the whole selection before anything is aggregated; unfiltered entities cost no join."""
    facts = _facts(panel, codes, sel)
    return members_only(facts, selected_entities(panel, sel)) if sel.filters_entities else facts


def select_observations(
    panel: Panel, codes: Sequence[str] | None = None, sel: Selection = ALL
) -> DataFrame:
    """Facts of known entities that satisfy the whole selection (``codes=None`` is all indicators)."""
    entities = selected_entities(panel, sel)
    return _facts(panel, codes, sel).join(entities.select("entity_code"), "entity_code", "left_semi")


def ordered_page(
    df: DataFrame, order: Sequence[Column], top: int | None = None, skip: int = 0
) -> DataFrame:
    """Total order, then offset and limit.

    A page near the start is planned as a distributed top-k. A later one, or all rows behind an offset, is cut by the
    rows' places in sorted range partitions, so that no task sees the rows that are skipped.
    """
    if skip and (top is None or skip + top > TOP_ROWS):
        place = F.col("__rank")
        page = with_rank(df, [], order, "__rank").where(place > skip)
        page = page if top is None else page.where(place <= skip + top)
        return page.orderBy(place).drop("__rank")
    page = df.orderBy(*order)
    if skip:
        page = page.offset(skip)
    return page if top is None else page.limit(top)


# ---- J1-J3: star joins -------------------------------------------------------------------------------


def join_entities(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Inner join: facts of unknown entities are dropped."""
    return facts.join(entities.select(*ENTITY_COLUMNS), "entity_code")


def join_codebook(facts: DataFrame, indicators: DataFrame) -> DataFrame:
    """Left join: facts of unknown indicators keep null attributes."""
    return facts.join(indicators.select(*INDICATOR_COLUMNS), "indicator_code", "left")


def members_only(df: DataFrame, members: DataFrame) -> DataFrame:
    """Rows whose entity is in a membership table."""
    return df.join(members.select("entity_code"), "entity_code", "left_semi")


def tidy(panel: Panel, facts: DataFrame, entities: DataFrame) -> DataFrame:
    """The twelve-column star join."""
    joined = join_codebook(join_entities(facts, entities), panel.indicators)
    return joined.select(*DATA_COLUMNS)


# ---- W1, J7: latest and as-of ---------------------------------------------------------------------------


def latest_of_series(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*SERIES_KEY).agg(
        F.max("period").alias("period"), F.max_by("value", "period").alias("value")
    )


def latest_observations(
    panel: Panel, codes: Sequence[str] | None = None, sel: Selection = ALL
) -> DataFrame:
    """Last observation of every (indicator, entity) after all filters, as narrow facts of known entities."""
    latest = latest_of_series(_filtered_facts(panel, codes, sel))
    return latest if sel.filters_entities else members_only(latest, panel.entities)


def latest_per_entity(
    panel: Panel, codes: Sequence[str] | None = None, sel: Selection = ALL
) -> DataFrame:
    """Tidy rows of the last observation of every (indicator, entity)."""
    latest = latest_of_series(_filtered_facts(panel, codes, sel))
    return tidy(panel, latest, panel.entities)


def as_of_values(
    panel: Panel, codes: Sequence[str] | None, period: int | None, sel: Selection = ALL
) -> DataFrame:
    """Last value at or before ``period`` per (indicator, entity) of the selection's entities."""
    return latest_of_series(_filtered_facts(panel, codes, sel.between(None, period)))


def as_of_requests(panel: Panel, requests: DataFrame, sel: Selection = ALL) -> DataFrame:
    """A table of ``(indicator_code, entity_code, period)``, each with the last value at or before its period.

    Columns of the table are kept, ``found_period`` and ``value`` added; they are null where the selection has no such
    observation. All requests are answered by one sorted merge, whatever their number per series.
    """
    return as_of_join(requests, _filtered_facts(panel, None, sel), SERIES_KEY, "period", ["value"], "found_period")


# ---- F2, P1-P4: data queries -----------------------------------------------------------------------------


def indicator_data(
    panel: Panel,
    code: str,
    sel: Selection = ALL,
    latest_only: bool = False,
    top: int | None = None,
) -> DataFrame:
    """Tidy rows of one indicator, by entity, newest first."""
    rows = (
        latest_per_entity(panel, [code], sel)
        if latest_only
        else tidy(panel, _facts(panel, [code], sel), selected_entities(panel, sel))
    )
    return ordered_page(rows, [F.col("entity_code"), F.desc("period")], top)


def compare_entities(
    panel: Panel,
    code: str,
    sel: Selection,
    latest_only: bool = False,
    top: int | None = None,
) -> DataFrame:
    """One indicator across named entities and/or a curated group."""
    if not (sel.entities or sel.group):
        raise ValueError("Pass at least one of 'entities' or 'group'.")
    return indicator_data(panel, code, sel, latest_only, top)


def resolved_inputs(panel: Panel, entities: Sequence[str] | DataFrame) -> DataFrame:
    """The ``(spelling, entity_code)`` mapping of a comparison: of a list, or of a table's column ``spelling``."""
    table = entities.select("spelling").distinct() if isinstance(entities, DataFrame) else tables.literal_table(
        panel.spark, {"spelling": tables.TEXT}, [(name,) for name in dict.fromkeys(entities)]
    )
    return resolve.resolve_entities(table, "spelling", panel).select("spelling", "entity_code")


def compare_group(
    panel: Panel,
    code: str,
    sel: Selection,
    latest_only: bool = True,
    top: int | None = None,
) -> DataFrame:
    """One indicator across a curated group, region and/or income class (intersected).

    ``selected_entities(panel, sel)`` is the member list that goes with it.
    """
    if not (sel.group or sel.region or sel.income):
        raise ValueError("Pass at least one of 'group', 'region' or 'income'.")
    return indicator_data(panel, code, sel, latest_only, top)


def research_panel(
    panel: Panel, codes: Sequence[str], sel: Selection = ALL, top: int | None = None
) -> DataFrame:
    """Tidy long rows of several indicators by entity, period, indicator."""
    rows = tidy(panel, _facts(panel, codes, sel), selected_entities(panel, sel))
    order = [F.col("entity_code"), F.col("period"), F.col("indicator_code")]
    return ordered_page(rows, order, top)


def pivot_panel(df: DataFrame, columns: Sequence[str], by: str = "entity_code") -> DataFrame:
    """Long to wide: one row per period, one column per listed entity.

    The explicit list saves Spark the pass that would discover it and fixes the schema.
    """
    return df.groupBy("period").pivot(by, list(columns)).agg(F.first("value"))


# ---- F3-F6, F10: codebook and notes -------------------------------------------------------------------------


def _in_categories(df: DataFrame, category_1: str | None, category_2: str | None) -> DataFrame:
    if category_1:
        df = df.where(F.col("category_1") == category_1)
    if category_2:
        df = df.where(F.col("category_2") == category_2)
    return df


def list_indicators(
    panel: Panel,
    category_1: str | None = None,
    category_2: str | None = None,
    skip: int = 0,
    top: int | None = None,
) -> DataFrame:
    """Codebook rows of a category, by code, paged; without a limit everything behind the offset."""
    rows = _in_categories(panel.indicators.select(*INDICATOR_COLUMNS), category_1, category_2)
    return ordered_page(rows, [F.col("indicator_code")], top, skip)


def count_indicators(
    panel: Panel, category_1: str | None = None, category_2: str | None = None
) -> DataFrame:
    """One row: how many codebook rows a listing has before paging."""
    rows = _in_categories(panel.indicators, category_1, category_2)
    return rows.agg(F.count(F.lit(1)).alias("total"))


def lookup_indicators(panel: Panel, wanted: DataFrame) -> DataFrame:
    """Codebook attributes for a table of codes, with a ``found`` flag; input columns are kept."""
    book = panel.indicators.select(*INDICATOR_COLUMNS).withColumn("__known", F.lit(True))
    joined = wanted.join(book, "indicator_code", "left")
    return joined.withColumn("found", F.col("__known").isNotNull()).drop("__known")


def lookup_codes(panel: Panel, codes: Sequence[str]) -> DataFrame:
    """Lookup of a list of codes in requested order."""
    wanted = tables.literal_table(
        panel.spark, {"position": tables.INT, "indicator_code": tables.TEXT},
        enumerate(dict.fromkeys(codes)),
    )
    return lookup_indicators(panel, wanted).orderBy("position")


def search_indicators(
    panel: Panel,
    query: str,
    category_1: str | None = None,
    category_2: str | None = None,
    top: int | None = None,
) -> DataFrame:
    """Codebook rows with the query text in any attribute but the method, by code."""
    needle = query.strip()
    rows = _in_categories(panel.indicators.select(*INDICATOR_COLUMNS), category_1, category_2)
    hit = contains_any([F.col(name) for name in SEARCHED_COLUMNS], needle) if needle else F.lit(False)
    return ordered_page(rows.where(hit), [F.col("indicator_code")], top)


def search_indicators_batch(panel: Panel, queries: DataFrame, column: str) -> DataFrame:
    """``(query, indicator_code)`` for a table of query texts, as an equi-join on character grams; blank ones match none.

    One text per codebook row is matched; see ``Panel.searched_texts``.
    """
    wanted = queries.select(F.lower(stripped(F.col(column))).alias("needle")).where("needle != ''").distinct()
    pairs = substring_pairs(
        panel.searched_texts("codebook"), "text", ["code"], wanted, index=panel.gram_index("codebook")
    ).select("needle", F.col("code").alias("indicator_code"))
    asked = queries.select(column, F.lower(stripped(F.col(column))).alias("needle"))
    return asked.join(pairs, "needle").select(column, "indicator_code")


def select_notes(
    panel: Panel, entity: str | None = None, code: str | None = None, top: int | None = None
) -> DataFrame:
    """Source notes, optionally of one entity or indicator, by entity and indicator."""
    notes = panel.source_notes.select(*NOTE_COLUMNS)
    if entity:
        notes = notes.where(F.col("entity_code") == resolve.entity_codes(panel, [entity])[0])
    if code:
        notes = notes.where(F.col("indicator_code") == code)
    return ordered_page(notes, [F.col("entity_code"), F.col("indicator_code")], top)


def indicator_cards(panel: Panel) -> DataFrame:
    """A Markdown card per codebook row."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    method = F.when(
        F.coalesce(F.col("measurement_method"), F.lit("")) != "",
        F.concat(F.lit("\n\n## Method of measurement\n"), F.col("measurement_method")),
    ).otherwise("")
    card = F.concat(
        F.concat_ws(
            "\n",
            F.concat(F.lit("# "), F.col("indicator_code")),
            F.lit(""),
            shown("indicator_name"),
            F.lit(""),
            F.concat(F.lit("- Long code: `"), shown("long_code"), F.lit("`")),
            F.concat(F.lit("- Category: "), shown("category_1"), F.lit(" / "), shown("category_2")),
            F.concat(F.lit("- Unit: "), shown("unit")),
            F.concat(F.lit("- Currency: "), shown("currency")),
        ),
        method,
    )
    return panel.indicators.select("indicator_code", card.alias("card"))


# ---- F7-F9: entities, groups, topics ----------------------------------------------------------------------


def list_entities(
    panel: Panel,
    region: str | None = None,
    income: str | None = None,
    group: str | None = None,
    top: int | None = None,
) -> DataFrame:
    """Entities of a region, income class and curated group (intersected), by name."""
    rows = selected_entities(panel, Selection(region=region, income=income, group=group))
    return ordered_page(rows, [F.col("entity_name"), F.col("entity_code")], top)


def list_groups(panel: Panel) -> DataFrame:
    """Curated groups with their number of members."""
    sizes = panel.group_members.groupBy("group_code").agg(F.count(F.lit(1)).alias("member_count"))
    return (
        tables.groups(panel.spark)
        .join(sizes, "group_code", "left")
        .fillna(0, ["member_count"])
        .orderBy("group_code")
    )


def group_members(panel: Panel, name: str) -> DataFrame:
    """Member codes of one curated group."""
    code = resolve.group_code(panel, name)
    return panel.group_members.where(F.col("group_code") == code).orderBy("entity_code")


def topic_indicators(panel: Panel, topic: str) -> list[str]:
    if topic not in fixed.TOPICS:
        raise ValueError(f"Unknown topic '{topic}'. Available: {', '.join(sorted(fixed.TOPICS))}.")
    return list(fixed.TOPICS[topic][1])


def select_by_topic(panel: Panel, topic: str, topics: DataFrame | None = None) -> DataFrame:
    """Facts of a topic's indicators; ``topics`` replaces the curated topic table."""
    if topics is None:
        return panel.observations.where(equals_any(F.col("indicator_code"), topic_indicators(panel, topic)))
    of_topic = topics.where(F.col("topic_id") == topic).select("indicator_code")
    if of_topic.isEmpty():
        names = topics.select("topic_id").distinct().orderBy("topic_id").limit(resolve.SHOWN_LABELS + 1)
        known = resolve.shown_list([row[0] for row in names.collect()])
        raise ValueError(f"Unknown topic '{topic}'. Available: {known}.")
    return panel.observations.join(of_topic, "indicator_code", "left_semi")


# ---- W2: profiles ------------------------------------------------------------------------------------------


def entity_profile(
    panel: Panel,
    codes: Sequence[str] = fixed.PROFILE_CODES,
    period: int | None = None,
    sel: Selection = ALL,
) -> DataFrame:
    """As-of value of each requested indicator for every selected entity, in requested order.

    A requested indicator without a value keeps a row with null period and value. The grid is an
    explode of the short code list on the entity row, not a join.
    """
    codes = require_indicators(panel, codes)
    wanted = F.posexplode(F.array(*[F.lit(code) for code in codes]))
    grid = selected_entities(panel, sel).select(*ENTITY_COLUMNS, wanted.alias("position", "indicator_code"))
    values = as_of_values(panel, codes, period, sel)
    attributes = ["indicator_code", "indicator_name", "unit", "currency", "category_1", "category_2"]
    rows = grid.join(values, ["indicator_code", "entity_code"], "left").join(
        panel.indicators.select(*attributes), "indicator_code", "left"
    )
    return rows.select(*DATA_COLUMNS, "position").orderBy("entity_code", "position")


# ---- U1: key sets ---------------------------------------------------------------------------------------------


def combine_keys(parts: Sequence[DataFrame], how: str = "union", key: str = "entity_code") -> DataFrame:
    """Union (distinct), union_all or intersection of key columns."""
    keys = [part.select(key) for part in parts]
    if how == "intersect":
        return reduce(lambda left, right: left.join(right, key, "left_semi"), keys).distinct()
    if how not in ("union", "union_all"):
        raise ValueError("how must be union, union_all or intersect")
    combined = reduce(DataFrame.unionByName, keys)
    return combined if how == "union_all" else combined.distinct()
