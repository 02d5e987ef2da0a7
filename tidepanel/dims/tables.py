"""The fixed values as DataFrames.

Each table is built from an Arrow table, so Spark sees a local relation with exact statistics: joins
against it are planned as broadcasts by size, and no Python worker is involved.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidepanel.dims import fixed

TEXT = pa.string()
INT = pa.int32()


def literal_table(
    spark: SparkSession, columns: Mapping[str, pa.DataType], rows: Iterable[Sequence]
) -> DataFrame:
    """A small driver-side table as a DataFrame with a fixed schema (also when empty)."""
    rows = list(rows)
    arrays = [
        pa.array([row[i] for row in rows], type=dtype) for i, dtype in enumerate(columns.values())
    ]
    return spark.createDataFrame(pa.table(arrays, names=list(columns)))


def groups(spark: SparkSession) -> DataFrame:
    columns = {
        "group_code": TEXT, "group_name": TEXT, "kind": TEXT, "wb_code": TEXT, "source": TEXT,
        "last_verified": TEXT,
    }
    rows = [
        (code, name, kind, wb_code, source, fixed.GROUPS_VERIFIED_ON)
        for code, name, kind, wb_code, _, source in fixed.CURATED_GROUPS
    ]
    return literal_table(spark, columns, rows)


def memberships(spark: SparkSession) -> DataFrame:
    rows = [
        (code, position, member)
        for code, _, _, _, members, _ in fixed.CURATED_GROUPS
        for position, member in enumerate(members)
    ]
    return literal_table(spark, {"group_code": TEXT, "position": INT, "entity_code": TEXT}, rows)


def _spellings(spark: SparkSession, table: Mapping[str, str], name: str) -> DataFrame:
    return literal_table(spark, {"alias_key": TEXT, name: TEXT}, table.items())


def entity_aliases(spark: SparkSession) -> DataFrame:
    return _spellings(spark, fixed.ENTITY_SPELLINGS, "alias_code")


def group_aliases(spark: SparkSession) -> DataFrame:
    return _spellings(spark, fixed.GROUP_SPELLINGS, "group_code")


def region_aliases(spark: SparkSession) -> DataFrame:
    return _spellings(spark, fixed.REGION_SPELLINGS, "region")


def income_aliases(spark: SparkSession) -> DataFrame:
    """Spelling -> label rows; ``tier`` 0 marks the collective spellings, which map to many labels."""
    rows = [
        (key, 0, position, label)
        for key, labels in fixed.COLLECTIVE_INCOME_SPELLINGS.items()
        for position, label in enumerate(labels)
    ]
    rows += [(key, 1, 0, label) for key, label in fixed.INCOME_SPELLINGS.items()]
    columns = {"alias_key": TEXT, "tier": INT, "position": INT, "income": TEXT}
    return literal_table(spark, columns, rows)


def topics(spark: SparkSession) -> DataFrame:
    rows = [
        (topic, description, position, code)
        for topic, (description, codes) in fixed.TOPICS.items()
        for position, code in enumerate(codes)
    ]
    columns = {"topic_id": TEXT, "description": TEXT, "position": INT, "indicator_code": TEXT}
    return literal_table(spark, columns, rows)


def tag_codes(spark: SparkSession) -> DataFrame:
    """Tag -> recommended codes; a tag with no codes keeps one row with a null code.

    A topic is recommended under its own name unless a use case has the same name.
    """
    tags = {**fixed.TOPICS, **fixed.USE_CASES}
    rows = [
        (tag, description, position, code)
        for tag, (description, codes) in tags.items()
        for position, code in (enumerate(codes) if codes else [(0, None)])
    ]
    columns = {"tag": TEXT, "description": TEXT, "position": INT, "indicator_code": TEXT}
    return literal_table(spark, columns, rows)


def tag_categories(spark: SparkSession) -> DataFrame:
    rows = [
        (tag, position, category)
        for tag, categories in fixed.USE_CASE_CATEGORIES.items()
        for position, category in enumerate(categories)
    ]
    return literal_table(spark, {"tag": TEXT, "position": INT, "category_2": TEXT}, rows)


def relations(
    spark: SparkSession,
    curated: Iterable[tuple[str, str, Sequence[str]]] = fixed.CURATED_RELATIONS,
) -> DataFrame:
    """Curated additive edges; ``priority`` 0 is the relation used when none is named."""
    seen: dict[str, int] = {}
    rows = []
    for parent, relationship, children in curated:
        priority = seen.get(parent, 0)
        seen[parent] = priority + 1
        rows += [
            (parent, relationship, position, child, priority)
            for position, child in enumerate(children)
        ]
    columns = {
        "parent_code": TEXT, "relationship_id": TEXT, "position": INT, "child_code": TEXT,
        "priority": INT,
    }
    return literal_table(spark, columns, rows)
