"""First k rows of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread: Sequence[str],
    rank: str | None = None,
) -> DataFrame:
    """Keep the first ``k`` rows of every group in the given total order.

    A group is first cut to k rows within hash slices of the ``spread`` columns, so that no task sorts a whole hot
    group; the survivors are then ranked. Where k is within Spark's group limit
    (spark.sql.optimizer.windowGroupLimitThreshold), both cuts already happen before their shuffles. ``rank`` names
    a rank column.
    """
    position = rank or "__position"
    slices = Window.partitionBy(*keys, "__slice").orderBy(*order)
    cut = (
        df.withColumn("__slice", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
        .withColumn("__in_slice", F.row_number().over(slices))
        .where(F.col("__in_slice") <= k)
        .drop("__slice", "__in_slice")
    )
    ranked = cut.withColumn(position, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(position) <= k)
    return kept if rank else kept.drop(position)
