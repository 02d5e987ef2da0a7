"""The trie of conversations' common beginnings, found block by block.

Turns are digested, and conversations are cut into blocks of a fixed number of turns. A block's digest covers all of
its turns with their depths, and the digests of a conversation's first blocks, combined, stand for its beginning up
to there. Conversations are grouped by those digests first: where all that go on from a beginning share the next
block, the nodes inside that block are known at once. Only where blocks diverge behind a common beginning are their
turn boundaries compared.

Sums over subtrees need no walk over levels. A node's members are known as sums over blocks, and every node counts
for its smallest member: what a member adds to the trie beyond all smaller ones is one number of each conversation,
and a node's subtree is what its members add.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import WORD, saved
from tidepanel.plans import with_rank

#: Turns of a block.
BLOCK_TURNS = 4
#: Blocks of a conversation over which digests are combined in one window; longer ones are combined by such segments.
SEGMENT_BLOCKS = 1024
#: Conversations that start alike by construction: ids of a family, and how many turns may come from its first.
FAMILY, MOST_SHARED = 20, 4
NODE = ("depth", "x", "y")


# ---- the conversations -----------------------------------------------------------------------------------------


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of SHA-256 over a turn; the role's length keeps role and text apart."""
    whole = F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text))
    return F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, 16)


def ordered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """``(conv_id, place, digest, words)``: a conversation's turns by number, null first, then by role and text.

    Null roles and texts are empty. Rows without a conversation id belong to no conversation.
    """
    empty = F.lit("")
    chosen = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(role, empty).alias("role"), F.coalesce(text, empty).alias("text"))
    ranked = with_rank(
        chosen, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "place")
    return saved(ranked.select(
        "conv_id", "place", turn_digest(F.col("role"), F.col("text")).alias("digest"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), "turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as the trie has them: ``(conv_id, length)``, and their turns ``(conv_id, depth, digest, words,
    length)``.

    Conversation ``c`` begins with the first ``h`` turns of ``c - c % 20`` (all, if there are fewer), ``h`` being the
    CRC-32 of its decimal id modulo four; its own turns behind its first ``h`` follow.
    """
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    ids = counts.select("conv_id", "n", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    bases = counts.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("m"))
    taken = F.least("h", F.coalesce("m", F.lit(0)))
    convs = saved(
        ids.join(bases, "base", "left").withColumn("taken", taken)
        .select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
                .alias("length")), "conversations")
    # At most twenty conversations begin with one turn of another.
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < MOST_SHARED)).withColumnRenamed(
        "conv_id", "base")
    begun = heads.join(convs, "base").where(F.col("place") <= F.col("taken")).select(
        "conv_id", F.col("place").alias("depth"), "digest", "words", "length")
    own = turns.join(convs, "conv_id").where(F.col("place") > F.col("h")).select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "digest", "words", "length")
    return convs.select("conv_id", "length"), begun.unionByName(own)


# ---- blocks ----------------------------------------------------------------------------------------------------


def blocks(turns: DataFrame) -> DataFrame:
    """``(conv_id, k, length, last, turns, bx, by, bw, ex, ey)``: the blocks of all conversations.

    A turn is hashed with its depth to two longs, and a beginning's digest is the exclusive or of its turns': ``bx,
    by`` before the block and ``ex, ey`` behind it. ``bw`` counts the words before. ``turns`` is bounded by the size
    of a block; a long conversation is combined by segments of blocks.
    """
    hashed = turns.select(
        "conv_id", "depth", "length", F.floor((F.col("depth") - 1) / BLOCK_TURNS).alias("k"), "words",
        *[F.xxhash64(F.lit(seed), F.col("depth"), F.col("digest")).alias(name) for seed, name in ((1, "x"), (2, "y"))])
    made = hashed.groupBy("conv_id", "k").agg(
        F.max("length").alias("length"), F.array_sort(F.collect_list(F.struct("depth", "x", "y", "words"))).alias("turns"),
        F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("words").alias("w"),
    ).withColumn("segment", F.floor(F.col("k") / SEGMENT_BLOCKS))
    digests = {"x": F.bit_xor, "y": F.bit_xor, "w": F.sum}
    inside = Window.partitionBy("conv_id", "segment").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    local = made.select("conv_id", "segment", "k", "length", "turns", "x", "y", "w", *[
        f(name).over(inside).alias(f"local_{name}") for name, f in digests.items()])
    table = saved(local, "blocks")
    totals = table.groupBy("conv_id", "segment").agg(*[f(name).alias(name) for name, f in digests.items()])
    earlier = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("conv_id", "segment", *[
        F.coalesce(f(name).over(earlier), F.lit(0).cast("long")).alias(f"o{name}") for name, f in digests.items()]
    ).where("segment > 0")
    joined = table.join(offsets, ["conv_id", "segment"], "left")
    zero = F.lit(0).cast("long")

    def end(name: str) -> Column:
        return F.col(f"local_{name}").bitwiseXOR(F.coalesce(f"o{name}", zero))

    return joined.select(
        "conv_id", "k", "length", ((F.col("k") + 1) * BLOCK_TURNS >= F.col("length")).alias("last"), "turns",
        end("x").bitwiseXOR(F.col("x")).alias("bx"), end("y").bitwiseXOR(F.col("y")).alias("by"),
        (F.col("local_w") + F.coalesce("ow", zero) - F.col("w")).alias("bw"), end("x").alias("ex"), end("y").alias("ey"))


GROUP = ("k", "bx", "by", "ex", "ey")


def diverging(groups: DataFrame) -> DataFrame:
    """``groups`` of blocks with ``split``: whether other blocks follow the same beginning.

    First blocks all follow the empty beginning and count as diverging, so that no join has it as a key.
    """
    siblings = (groups.where("k > 0").groupBy("k", "bx", "by").agg(F.count(F.lit(1)).alias("n"))
                .where("n > 1").select("k", "bx", "by", F.lit(True).alias("split")))
    later = groups.where("k > 0").join(siblings, ["k", "bx", "by"], "left").withColumn(
        "split", F.coalesce("split", F.lit(False)))
    return groups.where("k = 0").withColumn("split", F.lit(True)).unionByName(later)


def boundaries(groups: DataFrame, carry: Sequence[Column]) -> DataFrame:
    """The nodes at the turn boundaries of blocks: ``(split, depth, x, y, px, py, words, path, *carry)``.

    ``px, py`` is the digest of the parent and ``path`` the words up to the node. ``carry`` may use ``at_end``: whether
    the block ends there.
    """
    def upto(name: str, j: Column) -> Column:
        return F.aggregate(F.slice("turns", F.lit(1), j), F.col(f"b{name}"), lambda acc, t: acc.bitwiseXOR(t[name]))

    def spot(j: Column) -> Column:
        turn = F.get("turns", j - 1)
        path = F.aggregate(F.slice("turns", F.lit(1), j), F.col("bw"), lambda acc, t: acc + t["words"])
        return F.struct(
            turn["depth"].alias("depth"), upto("x", j).alias("x"), upto("y", j).alias("y"),
            upto("x", j - 1).alias("px"), upto("y", j - 1).alias("py"), turn["words"].alias("words"),
            path.alias("path"), (j == F.size("turns")).alias("at_end"))

    spots = F.transform(F.sequence(F.lit(1), F.size("turns")), spot)
    return groups.select("*", F.inline(spots)).select("split", *NODE, "px", "py", "words", "path", *carry)


def merged(rows: DataFrame, several: Sequence[Column]) -> DataFrame:
    """One row a node: as it is where blocks don't diverge, and aggregated by ``several`` where they do."""
    alone = rows.where("not split").drop("split")
    shared = rows.where("split").groupBy(*NODE).agg(
        *[F.max(c).alias(c) for c in ("px", "py", "words", "path")], *several)
    return alone.unionByName(shared)


# ---- members that end at a node --------------------------------------------------------------------------------


def end_hashes(ends: DataFrame) -> DataFrame:
    """``(depth, x, y, ends_sha256)`` from ``(depth, x, y, conv_id)``: SHA-256 of a node's ids in order, comma-joined.

    Ids are sorted over range partitions, so that a crowded node covers several, and joined to pieces there; the task
    that hashes a node reads its pieces one after the other.
    """
    keys = [*NODE, "conv_id"]
    node = "depth bigint, x bigint, y bigint"

    def runs(batch: pa.RecordBatch) -> list[tuple[int, int]]:
        columns = [batch.column(c).to_numpy() for c in NODE]
        turns = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
        return [(i, j) for i, j in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows]) if i < j]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = runs(batch)
            ids = batch.column("conv_id").to_pylist()
            first = batch.take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*first.columns, pa.array([",".join(map(str, ids[i:j])) for i, j in found], pa.string())],
                names=[*keys, "ids"])

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if key != current:
                    if current:
                        done.append((*current, state.hexdigest()))
                    current, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield rows(done)
        if current:
            yield rows([(*current, state.hexdigest())])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = zip(*done) if done else [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()])], names=[*NODE, "ends_sha256"])

    pieces = (ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
              .mapInArrow(join, f"{node}, conv_id bigint, ids string"))
    return (pieces.repartition(*NODE).sortWithinPartitions(*keys)
            .mapInArrow(hash_all, f"{node}, ends_sha256 string"))


# ---- the trie --------------------------------------------------------------------------------------------------


def prefix_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The trie of the rebuilt conversations, one row for each distinct beginning, the empty one included.

    ``conv_id`` is the smallest member, ``depth`` the turns, ``parent_conv_id`` the parent's smallest member (root:
    null), ``n_convs`` the members, ``n_children`` the children, ``n_leaves`` the childless nodes of the subtree,
    ``saved_tokens`` its sum of (members - 1) times words of the last turn, ``ends_sha256`` the hash of the ids of
    members that end there. A subtree includes its top. Null roles and texts are empty; equal turn numbers are put
    in order by role and text, and repeated rows are turns of their own; rows without a conversation id are left out;
    an empty table gives no rows; other columns are not read. Digests have 128 bits.

    The driver gets one count per partition and the root's row. Joins on a beginning read written tables, whose hot
    keys adaptive execution can split.
    """
    convs, turns = rebuilt(ordered_turns(conversations, **columns))
    made = saved(blocks(turns), "trie-blocks")
    zero = F.lit(0).cast("long")

    # Members of blocks, and of nodes.
    groups = saved(made.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.count_if("last").alias("ended"),
        F.any_value("turns").alias("turns"), F.any_value("bw").alias("bw")), "trie-groups")
    known = saved(diverging(groups), "trie-split")
    found = merged(
        boundaries(known, ["n", "conv_id", F.when(F.col("at_end"), F.col("ended")).otherwise(zero).alias("ended")]),
        [F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.sum("ended").alias("ended")])
    top = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"),
                    F.count_if(F.col("length") == 0).alias("ended")).where("n > 0")
    root = top.select(*[zero.alias(c) for c in (*NODE, "px", "py", "words", "path")], "n", "conv_id", "ended")
    nodes = saved(found.unionByName(root), "trie-nodes")

    # What each member adds, and its sums over members.
    adds = nodes.groupBy("conv_id").agg(
        F.sum("words").alias("adds"), F.count_if(F.col("ended") == F.col("n")).alias("leaves"))
    ends = made.where("last").select(
        "conv_id", F.col("length").alias("depth"), F.col("ex").alias("x"), F.col("ey").alias("y"),
        F.aggregate("turns", F.col("bw"), lambda acc, t: acc + t["words"]).alias("total"))
    values = saved(convs.select("conv_id").join(ends.select("conv_id", "total"), "conv_id", "left")
                   .join(adds, "conv_id", "left").fillna(0, ["total", "adds", "leaves"]), "trie-values")
    least = F.struct("conv_id", (F.col("total") - F.col("adds")).alias("rest"))
    sums = [F.sum("total").alias("total"), F.sum("adds").alias("adds"), F.sum("leaves").alias("leaves")]
    of_groups = (made.select("conv_id", *GROUP).join(values, "conv_id").groupBy(*GROUP)
                 .agg(*sums, F.min(least).alias("least")))
    of_nodes = merged(
        boundaries(known.select(*GROUP, "split", "turns", "bw").join(of_groups, list(GROUP)),
                   ["total", "adds", "leaves", "least"]),
        [*sums, F.min("least").alias("least")])
    of_root = values.agg(*sums, F.min(least).alias("least")).select(
        *[zero.alias(c) for c in NODE], "total", "adds", "leaves", "least")
    summed = of_nodes.drop("px", "py", "words", "path").unionByName(of_root)

    # Neighbours in the trie, and members that end.
    first = nodes.where("depth = 0").select("conv_id").first()
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"),
                           F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").join(parents, ["depth", "px", "py"])
    high = nodes.where("depth <= 1").withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, F.lit(first["conv_id"] if first else None)).cast("long"))
    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    at_root = convs.where("length = 0").select(*[zero.alias(c) for c in NODE], "conv_id")
    hashes = end_hashes(ends.select(*NODE, "conv_id").unionByName(at_root))
    n, words, path = F.col("n"), F.col("words"), F.col("path")
    return (
        deep.unionByName(high).join(summed, list(NODE)).join(children, list(NODE), "left")
        .join(hashes, list(NODE), "left").select(
            "conv_id", "depth", "parent_conv_id", n.alias("n_convs"),
            F.coalesce("n_children", zero).alias("n_children"), F.col("leaves").alias("n_leaves"),
            (F.col("total") - n * (path - words)
             - (F.col("adds") + F.col("least.rest") - path + words)).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))
