"""From raw sheets to a checked panel.

The raw sheets are DataFrames (CSV or Parquet, any reader). Where the order of rows decides which one
wins, the order is an explicit ``row_no`` column of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.dims import fixed, tables
from tidepanel.functions import as_int, clean_dash
from tidepanel.model import (
    ENTITY_COLUMNS,
    INDICATOR_COLUMNS,
    NOTE_COLUMNS,
    OBSERVATION_COLUMNS,
    OBSERVATION_KEY,
    Panel,
)

# The sheet order of the note columns.
NOTE_SHEET_COLUMNS = (
    "entity_name", "entity_code", "region", "income", "indicator_code", "long_code",
    "indicator_name", "sources", "comments", "data_type", "methods_of_estimation", "footnote",
)
ENTITY_SHEET_COLUMNS = ("entity_name", "entity_code", "region", "income", "period")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def leading(df: DataFrame, names: Sequence[str], *extra: str) -> DataFrame:
    """The leading columns of a sheet, which are identified by position, under our names."""
    columns = [f"{_quoted(old)} as {new}" for old, new in zip(df.columns, names)]
    return df.selectExpr(*columns, *extra)


def _present(value: Column) -> Column:
    return value.isNotNull() & (value.cast("string") != "")


# ---- S1: codebook ----------------------------------------------------------------------------------


def load_codebook(raw: DataFrame) -> DataFrame:
    """Codebook from its eight positional columns.

    Rows without a code and the identifying columns of the data sheet are skipped; an exact ``-`` in an
    attribute is null. Duplicate codes are left for ``check_keys`` to report.
    """
    book = leading(raw, INDICATOR_COLUMNS)
    code = F.col("indicator_code")
    attributes = [
        clean_dash(F.col(name).cast("string")).alias(name) for name in INDICATOR_COLUMNS[1:]
    ]
    return book.where(_present(code) & ~code.isin(*fixed.CORE_COLUMNS)).select(
        code.cast("string").alias("indicator_code"), *attributes
    )


# ---- S2, S3: data sheet ------------------------------------------------------------------------------


def wide_to_observations(
    wide: DataFrame, codes: Sequence[str] | DataFrame, ignore: Sequence[str] = ("row_no",)
) -> DataFrame:
    """Long facts from the wide sheet: five identifying columns by position, then one per indicator.

    Columns the codebook does not know are dropped before the scan; codebook entries without a column
    are fine. Null cells, rows without an entity and rows without a period are skipped; a cell that is
    not a number fails the load. The codebook is only needed for its codes, at most one per column.
    """
    columns = [name for name in wide.columns[len(ENTITY_SHEET_COLUMNS):] if name not in ignore]
    if isinstance(codes, DataFrame):
        header = tables.literal_table(
            wide.sparkSession, {"indicator_code": tables.TEXT}, [(name,) for name in columns]
        )
        codes = [
            row[0]
            for row in header.join(
                codes.select("indicator_code"), "indicator_code", "left_semi"
            ).collect()
        ]
    known = set(codes)
    indicators = [name for name in columns if name in known]
    # A sheet has thousands of columns: the cells of a row become one array that is exploded, because an
    # unpivot would plan one projection per column.
    cells = ", ".join(f"cast({_quoted(name)} as double)" for name in indicators)
    array = f"array({cells})" if indicators else "cast(array() as array<double>)"
    rows = leading(wide, ENTITY_SHEET_COLUMNS, f"{array} as cells").where(
        _present(F.col("entity_code")) & F.col("period").isNotNull()
    )
    long = rows.select(
        F.col("entity_code").cast("string").alias("entity_code"),
        as_int(F.col("period")).alias("period"),
        F.posexplode("cells").alias("position", "value"),
    ).where("value is not null")
    # Column names are text without control characters; the split folds to one array constant.
    names = F.split(F.lit("\x01".join(indicators)), "\x01")
    code = F.get(names, F.col("position")).alias("indicator_code")
    return long.select("entity_code", "period", code, "value")


def derive_entities(wide: DataFrame) -> DataFrame:
    """Entities of the wide sheet: the first row of a code (by ``row_no``) names it.

    Rows without a period still register their entity.
    """
    sheet = leading(wide, ENTITY_SHEET_COLUMNS, "row_no")
    first = F.min_by(F.struct("entity_name", "region", "income"), "row_no")
    return (
        sheet.where(_present(F.col("entity_code")))
        .groupBy(F.col("entity_code").cast("string").alias("entity_code"))
        .agg(first.alias("first"))
        .select("entity_code", "first.*")
    )


# ---- S4: notes -----------------------------------------------------------------------------------------


def load_notes(raw: DataFrame) -> DataFrame:
    """Source notes: rows lacking entity or indicator are skipped, the last row of a key wins.

    Unlike in the codebook, a ``-`` stays as it is.
    """
    sheet = leading(raw, NOTE_SHEET_COLUMNS, "row_no")
    keys = list(NOTE_COLUMNS[:2])
    last = F.max_by(F.struct(*NOTE_COLUMNS[2:]), "row_no")
    return (
        sheet.where(_present(F.col("entity_code")) & _present(F.col("indicator_code")))
        .groupBy(*keys)
        .agg(last.alias("last"))
        .select(*keys, "last.*")
    )


def load_version_lines(raw: DataFrame, text: str = "text") -> DataFrame:
    """Numbered version lines; blank lines are skipped but keep their number."""
    return raw.where(_present(F.col(text))).select(
        F.col("line_no").cast("int").alias("line_no"), F.col(text).cast("string").alias("text")
    )


# ---- S5: keys --------------------------------------------------------------------------------------------


def key_violations(df: DataFrame, table: str, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    """``(table, problem, key, n)``: repeated keys and null required columns of one table."""
    key = F.concat_ws("|", *[F.col(name).cast("string") for name in keys])
    repeated = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(
            F.lit(table).alias("table"), F.lit("duplicate_key").alias("problem"), key.alias("key"), "n"
        )
    )
    nulls = df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in required])
    missing = (
        nulls.unpivot([], list(required), "key", "n")
        .where("n > 0")
        .select(F.lit(table).alias("table"), F.lit("null_value").alias("problem"), "key", "n")
    )
    return repeated.unionByName(missing)


def check_keys(panel: Panel) -> DataFrame:
    """Key and null violations of a panel; empty when the panel is sound."""
    parts = [
        key_violations(panel.observations, "observations", OBSERVATION_KEY, OBSERVATION_COLUMNS),
        key_violations(panel.entities, "entities", ["entity_code"], ENTITY_COLUMNS[:2]),
        key_violations(panel.indicators, "indicators", ["indicator_code"], ["indicator_code"]),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def require_keys(panel: Panel) -> Panel:
    """The panel itself, or an error that names the first violations."""
    bad = check_keys(panel).limit(5).collect()
    if bad:
        shown = "; ".join(f"{row['table']} {row['problem']} {row['key']} ({row['n']})" for row in bad)
        raise ValueError(f"The panel violates its keys: {shown}")
    return panel


def load_panel(
    data: DataFrame,
    codebook: DataFrame,
    notes: DataFrame | None = None,
    version_lines: DataFrame | None = None,
    check: bool = True,
    **dimensions: DataFrame,
) -> Panel:
    """Raw sheets to a checked panel; ``dimensions`` passes own memberships or relations.

    A panel that goes into a snapshot needs no check here: the build checks the written tables.
    """
    indicators = load_codebook(codebook)
    panel = Panel(
        observations=wide_to_observations(data, indicators),
        entities=derive_entities(data),
        indicators=indicators,
        notes=load_notes(notes) if notes is not None else None,
        version_lines=load_version_lines(version_lines) if version_lines is not None else None,
        **dimensions,
    )
    return require_keys(panel) if check else panel
