"""Exact medians of groups of any size.

``median`` keeps every distinct value of a group in one buffer, which a group of billions of rows does not survive.
Here equal values are counted first, and the counts are range-partitioned and sorted once (see ``ranks``). How many
rows of a group earlier partitions hold tells which partition has a middle rank, and only there the counts are added
up. Every rank is found exactly, and what is shuffled are counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.plans.ranks import BEFORE, HELD, PART, PLACE, join_spans, sorted_table, spans

#: How many rows an entry of a count table stands for.
ROWS = "__rows"


def count_table(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    also: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``(*keys, value, *also, __rows, *sums)``, sorted by group and value: how often each group has each value.

    ``also`` are further columns to count by, ``sums`` further aggregates. Null values come last.
    """
    counted = df.groupBy(*keys, value, *also).agg(
        F.count(F.lit(1)).alias(ROWS), *[column.alias(name) for name, column in (sums or {}).items()])
    return sorted_table(counted, keys, [F.col(value).asc_nulls_last(), *[F.col(name).asc() for name in also]])


def table_medians(table: DataFrame, keys: Sequence[str], value: str, median: str = "median") -> DataFrame:
    """``(*keys, median)`` of the non-null values of a count table; groups without any have no row."""
    known = table.where(F.col(value).isNotNull())
    found = spans(known, keys, F.sum(ROWS))
    n = found.groupBy(*keys).agg(F.sum(HELD).alias("__n"))
    middles = F.array(F.floor((F.col("__n") + 1) / 2), F.floor(F.col("__n") / 2) + 1)
    wanted = (
        found.join(n, list(keys)).select("*", F.posexplode(middles).alias("__side", "__rank"))
        .where((F.col(BEFORE) < F.col("__rank")) & (F.col("__rank") <= F.col(BEFORE) + F.col(HELD)))
        .select(*keys, PART, "__side", (F.col("__rank") - F.col(BEFORE)).alias("__rank"))
    )
    running = Window.partitionBy(*keys, PART, "__side").orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    inside = join_spans(known.select(*keys, value, ROWS, PART, PLACE), wanted, keys).withColumn(
        "__upto", F.sum(ROWS).over(running))
    middle = inside.where(
        (F.col("__upto") - F.col(ROWS) < F.col("__rank")) & (F.col("__rank") <= F.col("__upto")))
    return middle.groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias(median))


def grouped_order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    extra: Sequence[Column],
    median: str = "median",
) -> DataFrame:
    """``keys``, the ``extra`` aggregates and the exact median of the non-null ``value`` per group.

    Keys must not be null. A group that has only null values keeps its row, with a null median.
    """
    medians = table_medians(count_table(df, keys, value), keys, value, median)
    return df.groupBy(*keys).agg(*extra).join(medians, list(keys), "left")
