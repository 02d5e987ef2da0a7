"""Additive hierarchies: edges, indicator roles and breakdown checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.model import ALL, Panel, Selection
from tidepanel.operators.select import select_observations

# ---- Fixed values: what makes a series additive, and the names used in results -----------------------
AMOUNT_UNIT = "Millions"
AMOUNT_CURRENCY = "NCU"
TREE_PREFIX = "sha11."
INFERRED_RELATION = "sha_direct_children"
CURATED_SOURCE = "curated_codebook_formula"
INFERRED_SOURCE = "inferred_from_sha11_long_codes"
TOLERANCE = 1e-6

# The parent of a direct child: everything before the last dot, if no underscore follows it.
DIRECT_PARENT = r"^(.*)\.([^._]*)$"
# The parent an amount series names for itself: everything before the last dot.
NAMED_PARENT = r"^(.*)\.([^.]*)$"


def is_amount() -> Column:
    return F.coalesce(
        (F.col("unit") == AMOUNT_UNIT) & (F.col("currency") == AMOUNT_CURRENCY), F.lit(False)
    )


def is_share() -> Column:
    unit, code, method = (
        F.coalesce(F.col(name), F.lit("")) for name in ("unit", "long_code", "measurement_method")
    )
    return (
        (unit == "Percentage")
        | F.contains(code, F.lit("%"))
        | F.contains(method, F.lit("/"))
        | F.contains(F.lower(unit), F.lit("per"))
    )


def _amounts(panel: Panel) -> DataFrame:
    return panel.indicators.where(is_amount())


def _tree_edges(panel: Panel, parent_pattern: str, parent_prefix: str) -> DataFrame:
    """Parent/child pairs of amount series: an equi-join on the parent code cut out of the child's."""
    amounts = _amounts(panel)
    children = amounts.where(F.startswith("long_code", F.lit(TREE_PREFIX))).select(
        F.col("indicator_code").alias("child_code"),
        F.col("long_code").alias("child_long_code"),
        F.regexp_extract("long_code", parent_pattern, 1).alias("parent_long_code"),
    )
    parents = amounts.where(F.startswith("long_code", F.lit(parent_prefix))).select(
        F.col("indicator_code").alias("parent_code"),
        F.col("long_code").alias("parent_long_code"),
    )
    return children.join(parents, "parent_long_code").drop("parent_long_code")


def hierarchy_edges(panel: Panel) -> DataFrame:
    """Every known additive edge of the codebook.

    ``(parent_code, relationship_id, priority, position, child_code, child_long_code, source)``.
    Curated relations come first (``priority`` 0 is the one used when none is named) with their
    ``position``; inferred children have a null position and follow the order of their long codes.
    """
    codes = panel.indicators.select(F.col("indicator_code").alias("parent_code"))
    curated = panel.additive_relations.join(codes, "parent_code", "left_semi")
    book = panel.indicators.select(
        F.col("indicator_code").alias("child_code"), F.col("long_code").alias("child_long_code")
    )
    columns = [
        "parent_code", "relationship_id", "priority", "position", "child_code", "child_long_code",
        "source",
    ]
    named = (
        curated.join(book, "child_code", "left")
        .withColumn("source", F.lit(CURATED_SOURCE))
        .select(*columns)
    )
    curated_count = curated.groupBy("parent_code").agg(
        (F.max("priority") + 1).alias("priority")
    )
    inferred = (
        _tree_edges(panel, DIRECT_PARENT, TREE_PREFIX)
        .join(curated_count, "parent_code", "left")
        .fillna(0, ["priority"])
        .withColumns({
            "relationship_id": F.lit(INFERRED_RELATION),
            "position": F.lit(None).cast("int"),
            "source": F.lit(INFERRED_SOURCE),
        })
        .select(*columns)
    )
    return named.unionByName(inferred)


def known_parents(panel: Panel) -> DataFrame:
    """Every parent of every indicator of the codebook: ``(child, parent, relationship, source)``.

    An inferred parent is looked up by the child's long code without its last segment; unlike the
    edges, the segment may contain an underscore here.
    """
    codes = panel.indicators.select(F.col("indicator_code").alias("child_code"))
    curated = panel.additive_relations.join(codes, "child_code", "left_semi").select(
        "child_code", "parent_code", "relationship_id", F.lit(CURATED_SOURCE).alias("source")
    ).distinct()
    inferred = _tree_edges(panel, NAMED_PARENT, TREE_PREFIX.rstrip(".")).select(
        "child_code", "parent_code", F.lit(INFERRED_RELATION).alias("relationship_id"),
        F.lit(INFERRED_SOURCE).alias("source"),
    )
    names = panel.indicators.select(
        F.col("indicator_code").alias("parent_code"), F.col("indicator_name").alias("parent_name")
    )
    return (
        curated.unionByName(inferred)
        .join(names, "parent_code", "left")
        .select("child_code", "parent_code", "parent_name", "relationship_id", "source")
    )


def classify_indicators(panel: Panel) -> DataFrame:
    """Role of every indicator in additive accounting, with caution flags."""
    has_children = hierarchy_edges(panel).select(
        F.col("parent_code").alias("indicator_code"), F.lit(True).alias("has_children")
    ).distinct()
    has_parent = known_parents(panel).select(
        F.col("child_code").alias("indicator_code"), F.lit(True).alias("has_parent")
    ).distinct()
    flagged = (
        panel.indicators.select(
            "indicator_code", is_amount().alias("is_amount"), is_share().alias("is_share")
        )
        .join(has_children, "indicator_code", "left")
        .join(has_parent, "indicator_code", "left")
        .fillna(False, ["has_children", "has_parent"])
    )
    role = (
        F.when(F.col("has_children"), "additive_parent")
        .when(F.col("has_parent"), "component")
        .when(F.col("is_share"), "derived_ratio_or_share")
        .when(F.col("is_amount"), "amount_series")
        .otherwise("context_or_conversion_series")
    )
    unrelated = ~F.col("has_children") & ~F.col("has_parent") & ~F.col("is_share")
    return flagged.select(
        "indicator_code", role.alias("role"), "is_amount", "is_share", "has_children", "has_parent",
        F.col("is_share").alias("caution_do_not_sum"),
        F.col("is_amount").alias("caution_units_must_match"),
        F.col("has_children").alias("caution_validate_breakdown"),
        unrelated.alias("caution_no_known_hierarchy"),
    ).orderBy("indicator_code")


# ---- A8: breakdowns ------------------------------------------------------------------------------------


BREAKDOWN_KEY = ["parent_code", "relationship_id", "entity_code", "period"]


def named_edges(
    panel: Panel, parent: str, relationship_id: str | None = None
) -> DataFrame:
    """Edges of one relation of one parent: the named one, or the first when none is named."""
    edges = hierarchy_edges(panel).where(F.col("parent_code") == parent)
    if relationship_id:
        edges = edges.where(F.col("relationship_id") == relationship_id)
    else:
        edges = edges.where(F.col("priority") == 0)
    if edges.isEmpty():
        named = f" '{relationship_id}'" if relationship_id else ""
        raise ValueError(f"No relationship{named} known for '{parent}'.")
    return edges


def _sums(panel: Panel, edges: DataFrame, sel: Selection, *extra: Column) -> DataFrame:
    """Parent value, child sum and child count per key, in one pass over the facts.

    Each fact is tagged with the relations in which it is the parent or a child; one aggregation combines both.
    """
    relation = ["parent_code", "relationship_id"]
    as_child = edges.select(*relation, F.col("child_code").alias("indicator_code"), F.lit(True).alias("is_child"))
    as_parent = edges.select(*relation, F.col("parent_code").alias("indicator_code"), F.lit(False).alias("is_child"))
    roles = as_child.unionByName(as_parent.distinct())
    tagged = select_observations(panel, None, sel).join(roles, "indicator_code")
    child = F.when(F.col("is_child"), F.col("value"))
    parent = F.when(~F.col("is_child"), F.col("value"))
    totals = tagged.groupBy(*BREAKDOWN_KEY).agg(
        F.max(parent).alias("parent_value"),
        F.coalesce(F.sum(child), F.lit(0.0)).alias("child_sum"),
        F.count(child).alias("child_count"),
        *extra,
    )
    difference = F.col("child_sum") - F.col("parent_value")
    relative = F.try_divide(F.col("difference"), F.col("parent_value"))
    return (
        totals.withColumn("difference", difference)
        .withColumn("relative_difference", relative)
        .withColumn(
            "balanced",
            F.coalesce(F.abs("relative_difference") < TOLERANCE, F.lit(False)),
        )
    )


def breakdown_totals(
    panel: Panel, edges: DataFrame | None = None, sel: Selection = ALL
) -> DataFrame:
    """Parent against the sum of its children for every (parent, relationship, entity, period).

    A missing child counts as 0. A difference needs a parent value, a relative difference one that is not 0, and
    only a defined relative difference can be balanced.
    """
    return _sums(panel, hierarchy_edges(panel) if edges is None else edges, sel)


def additive_breakdown(
    panel: Panel,
    edges: DataFrame | None = None,
    sel: Selection = ALL,
) -> DataFrame:
    """One row per child of every breakdown, missing children included, with its share of the parent.

    The aggregation that sums the children also lists them, so the facts are read once; a list is as long as a
    relation has children. Children of the relation that the list lacks are added with a null value.
    """
    edges = hierarchy_edges(panel) if edges is None else edges
    relation = ["parent_code", "relationship_id"]
    present = F.collect_list(F.when(F.col("is_child"), F.struct(
        F.col("indicator_code").alias("child_code"), F.col("value").alias("child_value"))))
    totals = _sums(panel, edges, sel, present.alias("__present")).drop("child_count")
    listed = edges.groupBy(*relation).agg(F.collect_set("child_code").alias("__all"))
    codes = F.transform("__present", lambda child: child["child_code"])
    missing = F.transform(
        F.array_except("__all", codes),
        lambda code: F.struct(code.alias("child_code"), F.lit(None).cast("double").alias("child_value")),
    )
    children = totals.join(listed, relation).withColumn("__child", F.explode(F.concat("__present", missing)))
    known = panel.indicators.select(
        F.col("indicator_code").alias("child_code"), F.col("indicator_name").alias("child_name"),
        F.lit(True).alias("__known"),
    )
    named = edges.select(*relation, "priority", "position", "child_code").join(known, "child_code", "left")
    rows = children.withColumns({
        "child_code": F.col("__child.child_code"), "child_value": F.col("__child.child_value"),
    }).join(named, [*relation, "child_code"])
    return rows.withColumns({
        "child_known": F.col("__known").isNotNull(),
        "share": F.try_divide("child_value", "parent_value"),
    }).select(
        *BREAKDOWN_KEY, "priority", "position", "child_code", "child_name", "child_known",
        "child_value", "share", "parent_value", "child_sum", "difference", "relative_difference",
        "balanced",
    )


def explain_indicator(panel: Panel, code: str) -> DataFrame:
    """The classification row of one indicator."""
    return classify_indicators(panel).where(F.col("indicator_code") == code)


def relations_of(panel: Panel, codes: Sequence[str]) -> DataFrame:
    """Edges of the given parents in reading order."""
    return (
        hierarchy_edges(panel)
        .where(F.col("parent_code").isin(list(codes)))
        .orderBy("parent_code", "priority", "position", "child_long_code", "child_code")
    )
