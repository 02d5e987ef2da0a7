"""Rows dealt to many tasks before work that each row makes much of."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"


def spread(df: DataFrame, *keys: str, share: int = 1) -> DataFrame:
    """The same rows in ``share`` times the session's shuffle partitions, by ``keys`` if there are any.

    A few megabytes of compressed rows are one split of a scan, and one task, however much is made of each row. The number
    is given, as adaptive execution would merge partitions by their size before that work.
    """
    number = share * int(df.sparkSession.conf.get(SHUFFLE_PARTITIONS))
    return df.repartition(number, *keys)


def tasks_for(spark: SparkSession, amount: int, most: int, least: int) -> int:
    """How many tasks share an amount of work: as many as a shuffle has, unless these had under ``least`` or over
    ``most`` each. The number grows with the amount, so that what a task holds does not."""
    wide = min(int(spark.conf.get(SHUFFLE_PARTITIONS)), math.ceil(amount / least))
    return max(1, wide, math.ceil(amount / most))
