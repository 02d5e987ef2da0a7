"""Which texts contain which needles, as an equi-join.

A substring test between two tables is a theta join, and a nested loop over both sides dies as soon as
both grow. Every needle is therefore represented by one of its own character grams, the one that the
fewest texts contain, and every text by its distinct grams; gram equality gives the candidates, and
``contains`` verifies them. The result is exact, and only texts that share a needle's rarest gram are
compared with it. It is meant for short texts (names, codes, codebook rows): a text is repeated for each
of its grams.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.plans.spread import spread

#: A needle is represented by one of its grams of the largest of these sizes that it has.
SIZES = (1, 2, 4, 8)
#: Hashes by which stored rows of unwanted grams are left out where they are read: that many numbers are broadcast at most.
BUCKETS = 1 << 21


def _grams(text: Column, size: Column) -> Column:
    """Distinct substrings of one size; none when the text is shorter."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(
        F.length(text) >= size,
        F.array_distinct(F.transform(starts, lambda start: F.substring(text, start, size))),
    )


@dataclass(frozen=True)
class GramIndex:
    """Stored grams of texts: ``lists (__gram, *ids, text)`` and ``counts (__gram, __texts)``.

    A batch of needles picks its rarest grams by the counts and reads the lists of these; no text is taken apart.
    """

    lists: DataFrame
    counts: DataFrame


def posting_lists(
    texts: DataFrame, text: str, ids: Sequence[str], sizes: Sequence[int] = SIZES, blank: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """``(__gram, *ids, text)`` for every distinct gram of every text; with ``blank`` also for the empty one.

    Texts are dealt to ``tasks`` tasks, or as ``spread`` does.
    """
    listed = [_grams(F.col(text), F.lit(n)) for n in sizes]
    if blank:
        listed.append(F.array(F.lit("")))
    grams = F.flatten(F.array_compact(F.array(*listed)))
    rows = texts.where(F.col(text).isNotNull()).select(*ids, text)
    dealt = rows.repartition(tasks) if tasks else spread(rows)
    return dealt.select(F.explode(grams).alias("__gram"), *ids, text)


def gram_counts(lists: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, __gram, __texts)``: how many texts have each gram."""
    return lists.groupBy(*by, "__gram").agg(F.count(F.lit(1)).alias("__texts"))


def _among(stored: DataFrame, grams: DataFrame) -> DataFrame:
    """The stored rows of some grams, and of those few others that share a hash with one; nothing stored is shuffled."""
    bucket = F.pmod(F.xxhash64("__gram"), F.lit(BUCKETS))
    wanted = grams.select(bucket.alias("__bucket")).distinct()
    return stored.withColumn("__bucket", bucket).join(F.broadcast(wanted), "__bucket", "left_semi").drop("__bucket")


def substring_pairs(
    texts: DataFrame,
    text: str,
    ids: Sequence[str],
    needles: DataFrame,
    needle: str = "needle",
    sizes: Sequence[int] = SIZES,
    blank: bool = False,
    index: GramIndex | None = None,
) -> DataFrame:
    """Rows ``(needle, *ids, text)`` for every text that contains the needle literally.

    ``needles`` must be distinct; case folding is up to the caller. The empty needle matches every text if ``blank``
    is set, else none. ``sizes`` starts with 1. Texts give their grams of all sizes, and those no needle has are
    dropped before anything else is done with them; with an ``index`` of the texts they give none.
    """
    sized = F.lit(sizes[0])
    for size in sizes[1:]:
        sized = F.when(F.length(F.col(needle)) >= size, F.lit(size)).otherwise(sized)
    own = _grams(F.col(needle), sized)
    if blank:
        # The empty text is a gram of every text, wanted only where an empty needle is.
        own = F.when(F.col(needle) == "", F.array(F.lit(""))).otherwise(own)
    needle_grams = needles.select(needle, F.explode(own).alias("__gram"))
    if index is None:
        text_grams = posting_lists(texts, text, ids, sizes, blank).join(needle_grams.select("__gram").distinct(), "__gram", "left_semi")
        frequency = gram_counts(text_grams)
    else:
        text_grams, frequency = index.lists.select("__gram", *ids, text), _among(index.counts, needle_grams)
        if blank:
            # Computed per row: joins on a constant would be planned as cross joins.
            empty = F.substring(text, 1, 0).alias("__gram")
            text_grams = text_grams.unionByName(texts.where(F.col(text).isNotNull()).select(empty, *ids, text))
    # A gram no text contains never joins, so needles without any match drop out here.
    rarest = (
        needle_grams.join(frequency, "__gram", "left")
        .groupBy(needle)
        .agg(
            F.min(
                F.struct(F.coalesce("__texts", F.lit(0)).alias("__texts"), F.col("__gram"))
            ).alias("__pick")
        )
        .select(needle, F.col("__pick.__gram").alias("__gram"))
    )
    if index is not None:
        text_grams = _among(text_grams, rarest)
    # Spark takes grams for as small as the texts they come from: without the hint it may broadcast all of them.
    candidates = text_grams.join(rarest.hint("merge"), "__gram")
    return candidates.where(F.contains(F.col(text), F.col(needle))).select(needle, *ids, text)
