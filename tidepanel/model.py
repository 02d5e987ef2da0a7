"""The panel: the DataFrames every operator works on, and the filters every operator accepts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.dims import tables
from tidepanel.plans.substring import GramIndex

OBSERVATION_COLUMNS = ("entity_code", "period", "indicator_code", "value")
OBSERVATION_KEY = ("indicator_code", "entity_code", "period")
ENTITY_COLUMNS = ("entity_code", "entity_name", "region", "income")
INDICATOR_COLUMNS = (
    "indicator_code", "indicator_name", "long_code", "category_1", "category_2", "unit", "currency",
    "measurement_method",
)
NOTE_COLUMNS = (
    "entity_code", "indicator_code", "entity_name", "region", "income", "long_code",
    "indicator_name", "sources", "comments", "data_type", "methods_of_estimation", "footnote",
)
# Where a codebook search looks: all but the method.
SEARCHED_COLUMNS = INDICATOR_COLUMNS[:-1]
UNUSED = "\x00"
# The tidy row of every data query, in order.
DATA_COLUMNS = (
    "indicator_code", "indicator_name", "entity_code", "entity_name", "region", "income", "period",
    "value", "unit", "currency", "category_1", "category_2",
)
# The tidy row of a CSV extract, in order.
EXTRACT_COLUMNS = DATA_COLUMNS[:10]


Table = DataFrame | Callable[[], DataFrame]


class Panel:
    """Long facts with their dimensions.

    ``observations`` holds one row per (indicator, entity, period), none of them null; ``check_keys``
    enforces that at load, and the operators rely on it. ``memberships`` and ``relations`` default to
    the curated groups and relations. A table can be given as a function, which is called when an
    operator first needs that table; tables a query does not touch are then never planned.
    """

    def __init__(
        self,
        observations: Table,
        entities: Table,
        indicators: Table,
        notes: Table | None = None,
        memberships: Table | None = None,
        relations: Table | None = None,
        version_lines: Table | None = None,
        gram_lists: Table | None = None,
        gram_counts: Table | None = None,
    ) -> None:
        self._tables = {
            "observations": observations, "entities": entities, "indicators": indicators,
            "notes": notes, "memberships": memberships, "relations": relations,
            "version_lines": version_lines, "gram_lists": gram_lists, "gram_counts": gram_counts,
        }

    def _table(self, name: str) -> DataFrame | None:
        table = self._tables[name]
        if callable(table):
            table = self._tables[name] = table()
        return table

    def replace(self, **tables: Table) -> Panel:
        """The same panel with some tables exchanged; an index of names does not outlive the names."""
        kept = dict(self._tables)
        if not tables.keys().isdisjoint(("entities", "indicators")):
            kept.update(gram_lists=None, gram_counts=None)
        return Panel(**{**kept, **tables})

    @property
    def observations(self) -> DataFrame:
        return self._table("observations")

    @property
    def entities(self) -> DataFrame:
        return self._table("entities")

    @property
    def indicators(self) -> DataFrame:
        return self._table("indicators")

    @property
    def notes(self) -> DataFrame | None:
        return self._table("notes")

    @property
    def memberships(self) -> DataFrame | None:
        return self._table("memberships")

    @property
    def relations(self) -> DataFrame | None:
        return self._table("relations")

    @property
    def version_lines(self) -> DataFrame | None:
        return self._table("version_lines")

    def gram_index(self, source: str) -> GramIndex | None:
        """The stored grams of one kind of text (see ``searched_texts``), if the panel has been read with them."""
        lists, counts = self._table("gram_lists"), self._table("gram_counts")
        if lists is None or counts is None:
            return None
        if source == "name" and "name_at" in lists.columns:
            # A name ends the text of its entity: its grams are among those of the text.
            text = F.col("text").substr(F.col("name_at"), F.length("text")).alias("text")
            named = lists.where((F.col("source") == "entity") & F.col("name_at").isNotNull())
            counted = counts.where((F.col("source") == "entity") & (F.col("__names") > 0))
            return GramIndex(named.select("__gram", "code", text),
                             counted.select("__gram", F.col("__names").alias("__texts")))
        return GramIndex(lists.where(F.col("source") == source).select("__gram", "code", "text"),
                         counts.where(F.col("source") == source).select("__gram", "__texts"))

    def searched_texts(self, source: str) -> DataFrame:
        """``(code, text)``: what searches look at, in lower case, joined by a character that no query can contain.

        ``name``: names of entities; ``entity``: their codes and names, with a third column of the ``name`` that ends
        the text; ``codebook``: the searched attributes.
        """
        if source == "codebook":
            parts, rows, code = SEARCHED_COLUMNS, self.indicators, "indicator_code"
        else:
            parts = ("entity_name",) if source == "name" else ("entity_code", "entity_name")
            rows, code = self.entities, "entity_code"
        lowered = [F.lower(F.col(name)) for name in parts]
        text = lowered[0] if source == "name" else F.concat_ws(UNUSED, *lowered)
        name = [lowered[1].alias("name")] if source == "entity" else []
        return rows.select(F.col(code).alias("code"), text.alias("text"), *name)

    @property
    def spark(self) -> SparkSession:
        return self.entities.sparkSession

    @property
    def group_members(self) -> DataFrame:
        members = self.memberships
        if members is None:
            members = tables.memberships(self.spark)
        return members.select("group_code", "entity_code")

    @property
    def additive_relations(self) -> DataFrame:
        relations = self.relations
        return tables.relations(self.spark) if relations is None else relations

    @property
    def source_notes(self) -> DataFrame:
        notes = self.notes
        if notes is None:
            return tables.literal_table(self.spark, {name: tables.TEXT for name in NOTE_COLUMNS}, [])
        return notes


@dataclass(frozen=True)
class Selection:
    """Filters, combined with AND; ``None`` or an empty list is no filter.

    ``entities`` are codes, names or aliases and must all resolve. ``group`` is a curated group name or
    alias; members the panel does not have are ignored. Entities and group together mean their union.
    ``region`` and ``income`` accept aliases; ``start`` and ``end`` are inclusive periods.
    """

    entities: Sequence[str] | None = None
    group: str | None = None
    region: str | None = None
    income: str | None = None
    start: int | None = None
    end: int | None = None

    @property
    def filters_entities(self) -> bool:
        return bool(self.entities or self.group or _text(self.region) or _text(self.income))

    def between(self, start: int | None, end: int | None) -> Selection:
        return Selection(self.entities, self.group, self.region, self.income, start, end)


ALL = Selection()


def _text(value: str | None) -> str:
    return (value or "").strip()
