"""Places of rows in groups of any size.

A window ranks a group in one task. Here rows are range-partitioned and sorted by group and order, written once to the
shared scratch folder, and numbered within their partition. A group of billions of rows then covers many partitions;
how many of its rows earlier partitions hold is a running sum over one row per partition and group, and a row's rank
is that sum plus its place behind the group's first row in its own partition. What is joined back is keyed by
partition and group, so a hot group is spread over all partitions there too.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.sources.storage import scratch_dir

#: Spark's row numbers hold the partition above and the place within it below this bit.
SHIFT = 33
PLACE, PART, FIRST, HELD, BEFORE = "__place", "__part", "__first", "__held", "__before"


def sorted_table(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``by`` and ``order``, written and read again.

    ``__part`` numbers the partitions in their order, ``__place`` the rows of all partitions in theirs, with gaps
    between partitions.
    """
    spark = df.sparkSession
    keys = [*[F.col(name).asc() for name in by], *order]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = ordered.withColumn(PLACE, F.monotonically_increasing_id()).withColumn(
        PART, F.shiftright(PLACE, SHIFT).cast("int"))
    path = scratch_dir(spark, "sorted")
    numbered.write.parquet(path)
    return spark.read.schema(numbered.schema).parquet(path)


def spans(table: DataFrame, by: Sequence[str], held: Column | None = None) -> DataFrame:
    """``(*by, __part, __first, __held, __before)``: each group's part of each partition.

    ``__first`` is its first place there, ``__held`` its rows (or the aggregate ``held``), and ``__before`` what the
    group holds in earlier partitions. A group has at most one row per partition.
    """
    counted = table.groupBy(*by, PART).agg(
        F.min(PLACE).alias(FIRST), (F.count(F.lit(1)) if held is None else held).alias(HELD))
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn(BEFORE, F.coalesce(F.sum(HELD).over(earlier), F.lit(0)))


def join_spans(table: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """The table's rows with the span they belong to; null groups are groups."""
    renamed = found.select(
        *[F.col(name).alias(f"__{i}") for i, name in enumerate(by)], F.col(PART).alias("__span_part"),
        *[name for name in found.columns if name not in (*by, PART)])
    same = [F.col(name).eqNullSafe(F.col(f"__{i}")) for i, name in enumerate(by)]
    joined = table.join(renamed, reduce(operator.and_, same, F.col(PART) == F.col("__span_part")))
    return joined.drop("__span_part", *[f"__{i}" for i in range(len(by))])


def with_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """``df`` with each row's place in its group, from 1; ``order`` must be total within a group.

    Without ``by`` all rows are one group; the driver then gets one count per partition, and nothing is joined.
    """
    table = sorted_table(df, by, order)
    if not by:
        counts = dict(table.groupBy(PART).count().collect())
        before, total = [], 0
        for part in range(max(counts, default=-1) + 1):
            before.append(total)
            total += counts.get(part, 0)
        offset = F.element_at(F.lit(before or [0]), F.col(PART) + 1)
        local = F.col(PLACE) - F.shiftleft(F.col(PART).cast("long"), SHIFT)
        return table.withColumn(rank, (local + offset + 1).cast("long")).drop(PLACE, PART)
    joined = join_spans(table, spans(table, by).drop(HELD), by)
    return joined.withColumn(rank, F.col(PLACE) - F.col(FIRST) + F.col(BEFORE) + 1).drop(PLACE, PART, FIRST, BEFORE)
