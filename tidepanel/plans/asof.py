"""The last fact at or before each request, for tables of requests.

Facts and requests are sorted together (see ``ranks``), and a request takes the last fact before it in its series. A
hot series covers several range partitions: what the last fact of a partition is, is carried to the later ones by one
row per partition and series, so no task reads a whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.plans.ranks import PART, PLACE, join_spans, sorted_table

ASKED, FACT, KIND, AT = "__asked", "__fact", "__kind", "__at"


def as_of_join(
    requests: DataFrame, facts: DataFrame, by: Sequence[str], at: str, values: Sequence[str], found: str
) -> DataFrame:
    """``requests`` with ``found``, the ``at`` of the last fact of the same ``by`` that is not after the request's,
    and that fact's ``values``; null where there is none, or where the request has a null.

    Facts have one row per ``by`` and ``at``; requests may repeat.
    """
    wanted = facts.join(requests.select(*by).distinct(), list(by), "left_semi")
    fact = F.struct(F.col(at).alias(found), *values)
    marks = wanted.where(F.col(at).isNotNull()).select(*by, F.col(at).alias(AT), F.lit(0).alias(KIND), fact.alias(FACT))
    asks = requests.select(*by, F.col(at).alias(AT), F.lit(1).alias(KIND), F.struct("*").alias(ASKED))
    # A request without a time stands before all facts and finds none.
    table = sorted_table(
        marks.unionByName(asks, allowMissingColumns=True), by, [F.col(AT).asc_nulls_first(), F.col(KIND).asc()])
    inside = Window.partitionBy(*by, PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    local = table.withColumn("__local", F.last(FACT, ignorenulls=True).over(inside)).where(F.col(ASKED).isNotNull())
    last = table.groupBy(*by, PART).agg(
        F.max_by(FACT, F.when(F.col(FACT).isNotNull(), F.col(PLACE))).alias("__last"))
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*by, PART, F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
    answer = F.coalesce("__local", "__carried")
    return join_spans(local, carried, by).withColumn("__answer", answer).select(
        f"{ASKED}.*", *[F.col("__answer")[name].alias(name) for name in (found, *values)])
