"""Tidy extracts: CSV directories and export packages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidepanel.dims import tables
from tidepanel.model import ALL, EXTRACT_COLUMNS, Panel, Selection
from tidepanel.operators.select import lookup_codes, research_panel
from tidepanel.operators.summarize import data_availability, limit_warnings
from tidepanel.sources.storage import delete, exists, publish

NOTES = (
    "latest values may come from different periods",
    "units and methods are in the codebook; compare like with like",
    "only amounts in one currency and price base can be added up",
)


def _write_csv(df: DataFrame, path: str, fields: Sequence[str] | None) -> int:
    """Write the files and return how many rows they hold, counted as they are written."""
    chosen = df.select(*fields) if fields else df
    written = Observation()
    chosen.observe(written, F.count(F.lit(1)).alias("rows")).write.option("header", True).csv(path)
    return written.get["rows"]


@contextmanager
def staged(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder to write to that becomes ``path`` when all is written, and goes if anything fails."""
    if exists(spark, path):
        raise FileExistsError(f"{path} exists already.")
    folder = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    try:
        yield folder
        publish(spark, folder, path)
    except BaseException:
        delete(spark, folder)
        raise


def export_csv(df: DataFrame, path: str, fields: Sequence[str] | None = EXTRACT_COLUMNS) -> int:
    """Write a directory of CSV files with a header and return the number of rows; null becomes an empty cell.

    ``fields`` selects and orders the columns (the ten of a data extract by default); ``None`` writes
    all of them. The directory appears when it is complete; there must be none before.
    """
    with staged(df.sparkSession, path) as folder:
        return _write_csv(df, folder, fields)


def package_summary(
    codes: Sequence[str], sel: Selection, rows: int, top: int | None = None
) -> list[str]:
    """``name = value`` lines of the text that goes with a package: the request, the row count, notes."""
    asked = {
        "indicators": ", ".join(codes),
        "entities": ", ".join(sel.entities or ()),
        "group": sel.group,
        "region": sel.region,
        "income": sel.income,
        "from": sel.start,
        "until": sel.end,
        "rows": rows,
        "limit": top,
    }
    lines = [f"{name} = {value}" for name, value in asked.items() if value not in (None, "")]
    if top is not None and rows >= top:
        lines.append("complete = unknown, the limit was reached")
    return [*lines, *(f"note = {note}" for note in NOTES)]


def export_package(
    panel: Panel,
    codes: Sequence[str],
    path: str,
    sel: Selection = ALL,
    top: int | None = None,
) -> None:
    """Write ``data``, ``codebook`` and ``availability`` as CSV directories and ``readme`` as text.

    The row count of the summary is taken while the data is written. The package appears when all of it is there.
    """
    spark = panel.spark
    codes = list(dict.fromkeys(codes))
    with staged(spark, path) as folder:
        rows = _write_csv(research_panel(panel, codes, sel, top), f"{folder}/data", EXTRACT_COLUMNS)
        _write_csv(lookup_codes(panel, codes).drop("position", "found"), f"{folder}/codebook", None)
        _write_csv(data_availability(panel, codes, sel), f"{folder}/availability", None)
        lines = package_summary(codes, sel, rows, top)
        text = tables.literal_table(spark, {"value": tables.TEXT}, [(line,) for line in lines])
        text.coalesce(1).write.text(f"{folder}/readme")


def package_warnings(
    panel: Panel, codes: Sequence[str], top: int, sel: Selection = ALL
) -> DataFrame:
    """A warning row when the extract reaches its limit."""
    return limit_warnings(research_panel(panel, codes, sel).select(F.lit(1)), top)
