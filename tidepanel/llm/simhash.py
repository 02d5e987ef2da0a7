"""SimHash near-duplicates by covering locality-sensitive hashing.

A radius of ``r`` bits takes ``2**(r+1) - 1`` tables. Every bit position gets a random vector of ``r + 1`` bits; the
mask of table ``v`` keeps the positions whose vector has an odd product with ``v``. For at most ``r`` differing
positions some ``v`` is orthogonal to all their vectors, so in that table the two fingerprints keep the same bits:
every pair within the radius collides somewhere. Nothing is missed, whatever the data.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import saved, with_row_id
from tidepanel.llm.components import connected_components

SHINGLE_WORDS = 3
RADIUS = 3
BITS = 64
SEED = 42
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 14
#: Fingerprints that are compared with each other at once; more are split further.
LEAF = 1024


# ---- fingerprints ----------------------------------------------------------------------------------------------


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Bit i is set if over half of the shingles' hashes set it; no words: zero."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = iter([b" ".join(found)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
        n = len(found) - words + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype=">u8", count=n)
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, BLOCK):
        part = hashes[start:start + BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">u8")[0])


def fingerprints(docs: DataFrame, doc_id: str, text: str, words: int, carry: tuple = ()) -> DataFrame:
    """``(doc_id, fp, *carry)``; fp is the fingerprint as a signed long."""
    chosen = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("doc_id"), *carry)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(0)),
                                 dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(values.view(np.int64))], names=[*batch.schema.names[1:], "fp"])

    schema = chosen.drop("_text").schema.add("fp", "long")
    return chosen.mapInArrow(compute, schema)


# ---- links between fingerprints --------------------------------------------------------------------------------


def covering_masks(radius: int, bits: int = BITS, seed: int = SEED) -> list[int]:
    rng = random.Random(seed)
    vectors = [rng.randrange(1 << (radius + 1)) for _ in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
            for v in range(1, 1 << (radius + 1))]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def spanning_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what pairs within ``radius`` bits connect; ``values`` are distinct.

    Small sets are compared directly. A larger one is split by the blocks of ``radius + 1`` even blocks of the bits
    in which its members differ: a pair within the radius agrees in at least one block. Each level leaves fewer
    free bits, so the sets end up small however many values there are.
    """
    links: list[tuple[int, int]] = []
    stack = [values]
    while stack:
        part = stack.pop()
        if len(part) <= LEAF:
            near = np.bitwise_count(part[:, None] ^ part[None, :]) <= radius
            waiting = np.ones(len(part), dtype=bool)
            for start in range(len(part)):
                if not waiting[start]:
                    continue
                waiting[start] = False
                reached = [start]
                while reached:
                    at = reached.pop()
                    new = np.flatnonzero(near[at] & waiting)
                    waiting[new] = False
                    reached.extend(new.tolist())
                    links.extend((int(part[at]), int(part[i])) for i in new)
            continue
        free = int(np.bitwise_or.reduce(part ^ part[0]))
        positions = [i for i in range(BITS) if free >> i & 1]
        for k in range(radius + 1):
            mask = np.uint64(sum(1 << i for i in positions[k::radius + 1]))
            keys = part & mask
            order = np.argsort(keys, kind="stable")
            cuts = np.flatnonzero(np.diff(keys[order])) + 1
            stack.extend(p for p in np.split(part[order], cuts) if len(p) > 1)
    return links


def near_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints that connect all that are within ``radius`` bits.

    Fingerprints are dealt by table and masked bits; a task gets its buckets one after the other in sorted order.
    Copies of a fingerprint have been merged before, so a bucket holds distinct values only: as many as the free
    bits of its table allow for one crowd of near copies, whatever the number of documents.
    """
    tables = F.array(*[
        F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("bits"))
        for i, mask in enumerate(covering_masks(radius))])
    dealt = (distinct.select("fp", F.inline(tables)).repartition("table", "bits")
             .sortWithinPartitions("table", "bits", "fp"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def edges(groups: list[np.ndarray]) -> pa.RecordBatch:
            found = [x for g in groups if len(g) > 1 for x in spanning_links(g, radius)]
            pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fp, tab, bits = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(tab) != 0) | (np.diff(bits) != 0)) + 1
            parts = np.split(fp.view(np.uint64), cuts)
            if last == (tab[0], bits[0]):
                held.append(parts.pop(0))
                if not parts:
                    continue
            ended = [np.concatenate(held)] if held else []
            held, last = [parts[-1]], (tab[-1], bits[-1])
            yield edges(ended + parts[:-1])
        if held:
            yield edges([np.concatenate(held)])

    return dealt.mapInArrow(link, "a long, b long")


def grouped(prints: DataFrame, radius: int) -> DataFrame:
    """``(fp, root, component_id)`` per distinct fingerprint; ``prints`` has ``doc_id, fp``."""
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "classes")
    roots = connected_components(near_links(classes.select("fp"), radius))
    rooted = saved(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                   .select("fp", "smallest", F.coalesce("root", "fp").alias("root")), "roots")
    smallest = saved(rooted.groupBy("root").agg(F.min("smallest").alias("component_id")), "components")
    return saved(rooted.join(smallest, "root").select("fp", "root", "component_id"), "grouped")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)``: the group of every document, named by its smallest id.

    One row per input row, repeated rows included. Null and blank texts have fingerprint zero and are linked like
    any other. A null id takes part but never names a group that has another id. An empty table gives no rows;
    other columns are not read.
    """
    prints = saved(fingerprints(docs, doc_id, text, words), "prints")
    return prints.join(grouped(prints, radius).select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id")


def near_deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the one with the smallest id stays, nulls last.

    Of rows with the same id the first by file and row number stays, so a group keeps exactly one row.
    """
    rows, rid = with_row_id(docs)
    prints = saved(fingerprints(rows, doc_id, text, words, (F.col(rid).alias("_rid"),)), "prints")
    groups = grouped(prints, radius).select("fp", "root")
    kept = (prints.join(groups, "fp").groupBy("root")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_rid")).alias("first"))
            .select(F.col("first._rid").alias("_rid")))
    # Hashing the few ids of a partition spares sorting the texts; every size takes this path.
    ids = saved(kept, "kept").withColumnRenamed("_rid", rid).hint("shuffle_hash")
    return rows.join(ids, rid, "left_semi").drop(rid)
