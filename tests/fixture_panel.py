"""The small health-spending workbook of the unit tests, as raw sheets."""

from __future__ import annotations

from tidepanel.sources.load import load_panel

INDICATORS = ("che_gdp", "oops_che", "che", "gghed", "fs1", "fs3", "hc", "hc1", "hc2")
DATA = [
    ("Colombia", "COL", "AMR", "Upper-middle", 2022, 8.1, 14.0, 100, 70, 60, 10, 100, 55, 45),
    ("Colombia", "COL", "AMR", "Upper-middle", 2023, 8.3, 13.8, 110, 80, 65, 15, 110, 60, 50),
    ("Peru", "PER", "AMR", "Upper-middle", 2022, 5.5, 28.0, 90, 50, 45, 5, 90, 40, 50),
    ("United States of America", "USA", "AMR", "High", 2023, 16.5, 10.0, 1000, 500, 400, 100, 1000,
     650, 350),
]
DETAIL = "HEALTH EXPENDITURE DATA"
FUNCTIONS = "HEALTH CARE FUNCTIONS"
CODEBOOK = [
    ("location", "Country", "-", "-", "-", "-", "-", "-"),
    ("che_gdp", "Health spending as share of GDP", "CHE%GDP_SHA2011", "INDICATORS", "AGGREGATES",
     "Percentage", "-", "CHE / GDP"),
    ("oops_che", "Out-of-pocket spending as share of health spending", "OOPS%CHE_SHA2011",
     "INDICATORS", "FINANCING", "Percentage", "-", "OOPS / CHE"),
    ("hc11", "Inpatient care", "sha11.HC.1.1", DETAIL, FUNCTIONS,
     "National Currency Unit (NCU) millions", "-", "-"),
    ("che", "Health spending", "CHE", "INDICATORS", "AGGREGATES", "Millions", "NCU",
     "HF.1 + HF.2 + HF.3 + HF.4 + HF.nec"),
    ("gghed", "Domestic government spending", "GGHE-D", "INDICATORS", "AGGREGATES", "Millions", "NCU",
     "FS.1 + FS.3"),
    ("fs1", "Transfers from government", "sha11.FS.1", DETAIL, "REVENUES", "Millions", "NCU", "-"),
    ("fs3", "Social insurance contributions", "sha11.FS.3", DETAIL, "REVENUES", "Millions", "NCU", "-"),
    ("hc", "All functions", "sha11.HC", DETAIL, FUNCTIONS, "Millions", "NCU", "-"),
    ("hc1", "Curative care", "sha11.HC.1", DETAIL, FUNCTIONS, "Millions", "NCU", "-"),
    ("hc2", "Rehabilitative care", "sha11.HC.2", DETAIL, FUNCTIONS, "Millions", "NCU", "-"),
]
NOTES = [
    ("Colombia", "COL", "AMR", "Upper-middle", "che_gdp", "CHE%GDP_SHA2011", "Share of GDP",
     "Official health accounts", None, "Documented", None, "Calendar year", 1),
]
VERSION = [(1, "Release of March"), (2, None), (3, "Second line")]

DATA_SCHEMA = (
    "location string, code string, region string, income string, year int, "
    + ", ".join(f"{name} double" for name in INDICATORS) + ", row_no bigint"
)
CODEBOOK_SCHEMA = (
    "`variable code` string, `variable name` string, `long code` string, `category 1` string, "
    "`category 2` string, unit string, currency string, `method` string"
)
NOTES_SCHEMA = (
    "location string, code string, region string, income string, `variable code` string, "
    "`long code` string, `variable name` string, sources string, comments string, "
    "`data type` string, `methods of estimation` string, footnote string, row_no bigint"
)


def wide_sheet(spark, rows=DATA):
    floats = [(*row[:5], *[None if v is None else float(v) for v in row[5:]]) for row in rows]
    numbered = [(*row, i) for i, row in enumerate(floats)]
    return spark.createDataFrame(numbered, DATA_SCHEMA)


def codebook_sheet(spark, rows=CODEBOOK):
    return spark.createDataFrame(rows, CODEBOOK_SCHEMA)


def notes_sheet(spark, rows=NOTES):
    return spark.createDataFrame(rows, NOTES_SCHEMA)


def make_panel(spark, data=DATA, codebook=CODEBOOK, notes=NOTES, **dimensions):
    return load_panel(
        wide_sheet(spark, data),
        codebook_sheet(spark, codebook),
        notes_sheet(spark, notes),
        spark.createDataFrame(VERSION, "line_no int, text string"),
        **dimensions,
    )


def cached(panel):
    """The panel with its tables collected once, so that many small tests do not reload it."""
    spark = panel.spark
    names = ("observations", "entities", "indicators", "notes", "version_lines")
    frames = {name: getattr(panel, name) for name in names}
    return panel.replace(
        **{name: spark.createDataFrame(frame.toArrow()) for name, frame in frames.items()}
    )
