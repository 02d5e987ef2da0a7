"""Mix sources to target weights by hash thresholds.

Every document has a hash that does not depend on its place. A source's documents below a threshold are taken, so
a larger budget takes a superset of a smaller one. The threshold comes from histograms: sizes are summed by source
and hash bucket, the bucket in which the budget ends is found, and only that bucket is split further, level by
level, until it holds one hash. No document is sorted, and what is shuffled is bounded by sources times buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import WORD, saved

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Bits of the hash, and of each level of buckets.
HASH_BITS = 48
LEVEL_BITS = 12


def word_count(text):
    """Number of words between blanks (space, tab to carriage return); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixing_hash(doc_id, text):
    """The first 48 bits of an MD5 over the id and the text's MD5; null id and null text count as empty."""
    key = F.concat_ws(":", doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_key(source):
    """A join key that null sources have too."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``(source, source_size)`` with each source's weight and target.

    Sources are weighed in code point order, null last, repeating ``weights``. A target is a common level times the
    weight, or ``most`` times the source's size where that is less: what clipping and resharing by weight ends in.
    Sources are clipped in order of ``size / weight``; the level is that of the first one not clipped. All of it
    works on one row per source; the two running sums over all sources are the only unpartitioned windows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn(
        "weight", F.element_at(listed, (F.pmod(F.row_number().over(order) - 1, len(weights)) + 1).cast("int")))
    everything = Window.partitionBy()
    poorest = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = poorest.rowsBetween(Window.unboundedPreceding, -1)
    budget = share * F.sum("source_size").over(everything)
    level = ((budget - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    clipped = weighed.withColumn("level", level).withColumn(
        "open", F.col("level") * F.col("weight") <= most * F.col("source_size"))
    final = clipped.withColumn(
        "final", F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), "level")))
        .over(everything)["level"])
    return final.select(
        "source", "source_size",
        F.least(F.coalesce(F.col("final") * F.col("weight"), F.lit(float("inf"))),
                most * F.col("source_size")).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source the whole copies that all its documents get, and the hash below which one more is taken.

    ``sized`` has ``source, size, hash``; ``goals`` has ``source, source_size, target``. The budget of the last,
    partial copy is ``target - copies * source_size``. A level of the search sums sizes by source and bucket within
    the bucket found before; the last one, of single hashes, takes the boundary hash if that comes nearer.
    """
    state = saved(goals.select(
        source_key(F.col("source")).alias("key"), "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0).cast("int").alias("copies"),
    ).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumn("low", F.lit(0).cast("long")), "mix")
    rows = sized.where("size > 0").select(source_key(F.col("source")).alias("key"), "size", "hash")
    for used in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        shift = HASH_BITS - used
        inside = rows if used == LEVEL_BITS else rows.join(
            state.select("key", "low"), "key").where(
            F.shiftright("hash", shift + LEVEL_BITS) == F.shiftright("low", shift + LEVEL_BITS)).drop("low")
        histogram = (inside.groupBy("key", F.shiftright("hash", shift).alias("bucket"))
                     .agg(F.sum("size").alias("size")))
        running = Window.partitionBy("key").orderBy("bucket")
        summed = (histogram.join(state.select("key", "budget"), "key")
                  .withColumn("sum", F.sum("size").over(running)))
        # The first bucket that the budget does not cover; the sizes before it are spent.
        found = (summed.where(F.col("sum") > F.col("budget")).groupBy("key").agg(
            F.min(F.struct("bucket", (F.col("sum") - F.col("size")).alias("spent"),
                           F.col("size").alias("held"))).alias("at")))
        state = saved(
            state.join(found, "key", "left").select(
                "key", "source", "source_size", "target", "copies",
                F.when(F.col("at").isNull(), F.col("budget"))
                .otherwise(F.col("budget") - F.col("at.spent")).alias("budget"),
                F.coalesce(F.shiftleft("at.bucket", shift), F.col("low")).alias("low"),
                F.col("at.held").alias("held")),
            "mix")
    near = F.col("held") - F.col("budget") < F.col("budget")
    return state.select(
        "key", "source_size", "target", "copies",
        F.when(F.col("held").isNull(), 0).otherwise(F.col("low") + F.when(near, 1).otherwise(0))
        .cast("long").alias("below"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                most: float = MOST, doc_id: str = "doc_id", text: str = "text",
                source: str = "source") -> DataFrame:
    """``docs`` packed in a struct ``row``, with ``size, source_size, target, copies``: how often each is taken.

    Nulls: a null text has size 0, a null source is a source of its own (last), a null id counts as an empty one.
    Texts without words have size 0 and are never taken. Rows that agree in id and text share a hash and are taken
    or left together. An empty table gives no rows. Extra columns stay inside ``row``.
    """
    sized = docs.select(
        F.struct("*").alias("row"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        mixing_hash(F.col(doc_id), F.col(text)).alias("hash"))
    narrow = saved(sized.select("source", "size", "hash"), "mix-sizes")
    goals = targets(
        narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    joined = sized.withColumn("key", source_key(F.col("source"))).join(thresholds(narrow, goals), "key", "left")
    taken = F.when(F.col("size") > 0, F.col("copies") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0))
    return joined.select(
        "row", "size", "source_size", "target",
        F.coalesce(taken, F.lit(0)).cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns only."""
    mix = mix_sources(docs, **options).where("copies > 0")
    return mix.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
