"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k edits is split into k + 1 pieces. Wherever the item occurs with at most k edits,
one piece occurs unchanged, at most k places off its own. Pieces are found by one Aho-Corasick pass over a document;
only around their hits Myers' bit-parallel recurrence computes the edit distance, with the whole item in one integer.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import free_name, remove, saved
from tidepanel.sources.storage import scratch_dir

#: Edits allowed per character of an item's normalised text.
ERROR_RATE = 0.08
#: Characters of items, and ID_CHARS for each id, that are collected, broadcast and searched at a time.
BLOCK_CHARS = 4_000_000
ID_CHARS = 16
#: About so many ids of equal items stay together.
IDS = 10_000
#: Each block is put together from about so many buckets of items.
BUCKETS = 16
WORDS = re.compile(r"\w+")


def normalised(text: str | None) -> str:
    """Words in lower case with one blank between: case, punctuation and layout do not count."""
    return " ".join(WORDS.findall((text or "").lower()))


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(length * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of almost equal length with their offsets; an item shorter than that has fewer."""
    count = min(errors + 1, len(item))
    cuts = [len(item) * i // count for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_distance(pattern: str, text: str) -> int:
    """Smallest edit distance between ``pattern`` and any stretch of ``text`` (Myers, one bit per character)."""
    m = len(pattern)
    marks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        marks[c] = marks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        equal = marks.get(c, 0)
        vertical = equal | minus
        diagonal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        up = up << 1 & full  # a match may start anywhere: nothing is carried in
        down = down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
    return best


class Items:
    """Benchmark items, ready to be searched for in documents.

    Items and documents stand between blanks, so that an item's ends are ends of words; to stop or start inside a word
    is an edit.
    """

    def __init__(self, items: list[tuple[object, str]], rate: float) -> None:
        self.items = [(key, f" {text} ", budget(len(text), rate)) for key, text in items if text]
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces(text, errors):
                places.setdefault(piece, []).append((number, offset))
        self.search = ahocorasick.Automaton()
        for piece, where in places.items():
            self.search.add_word(piece, (len(piece), where))
        if places:
            self.search.make_automaton()

    def found_in(self, text: str) -> list[tuple[int, int]]:
        """``(item number, distance)`` of every item within its budget."""
        if not self.items or not text:
            return []
        text = f" {text} "
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (length, where) in self.search.iter(text):
            start = last + 1 - length
            for number, offset in where:
                _, item, errors = self.items[number]
                low, high = start - offset - errors, start - offset + len(item) + errors
                spans = windows.setdefault(number, [])
                if spans and low <= spans[-1][1]:
                    spans[-1] = (min(low, spans[-1][0]), max(high, spans[-1][1]))
                else:
                    spans.append((low, high))
        found = []
        for number, spans in windows.items():
            _, item, errors = self.items[number]
            best = errors + 1
            for low, high in spans:
                best = min(best, best_distance(item, text[max(low, 0):max(high, 0)]))
                if not best:
                    break
            if best <= errors:
                found.append((number, best))
        return sorted(found)


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> list[DataFrame]:
    """The items as tables ``(norm, ids)`` small enough to be collected one at a time: none is empty.

    ``norm`` is the normalised text, ``ids`` lists ``(id, n)``: the ids of equal items and how often they occur. A
    block counts at most ``block_chars``, or else holds one entry of more than half of that.
    """
    @F.arrow_udf("string")
    def norm(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([normalised(value.as_py()) for value in batch], pa.string())

    ids = math.ceil(benchmark.count() / IDS)
    entries = saved(
        benchmark.select(F.col(item_id).alias("id"), norm(F.col(text)).alias("norm")).where("length(norm) > 0")
        .groupBy("id", "norm").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("norm", F.pmod(F.xxhash64("id"), F.lit(max(ids, 1))).alias("share"))
        .agg(F.collect_list(F.struct("id", "n")).alias("ids"))
        .withColumn("size", F.length("norm") + F.size("ids").cast("long") * ID_CHARS), "items")
    total = entries.agg(F.sum("size")).first()[0] or 0
    if total <= block_chars:
        return [entries.select("norm", "ids")] if total else []
    buckets = BUCKETS * math.ceil(total / block_chars)
    before = Window.partitionBy("bucket").orderBy("norm", "share").rowsBetween(Window.unboundedPreceding, -1)
    dealt = saved(
        entries.withColumn("bucket", F.pmod(F.xxhash64("norm", "share"), F.lit(buckets)))
        .withColumn("part", F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) * 2 / block_chars).cast("long")),
        "items")
    first, held = [], 0
    for row in dealt.groupBy("bucket", "part").agg(F.sum("size").alias("size")).orderBy("bucket", "part").collect():
        if not first or held + row["size"] > block_chars:
            first.append((row["bucket"], row["part"]))
            held = 0
        held += row["size"]
    place = F.struct("bucket", "part")
    starts = [F.struct(F.lit(bucket).cast("long"), F.lit(part).cast("long")) for bucket, part in first]
    return [dealt.where((place >= low) & (place < high if high is not None else F.lit(True))).select("norm", "ids")
            for low, high in zip(starts, [*starts[1:], None])]


def collected(block: DataFrame) -> list[tuple[list[tuple[object, int]], str]]:
    return [([(entry["id"], entry["n"]) for entry in row["ids"]], row["norm"]) for row in block.collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE,
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, distance, budget)``: every item that a document holds within its error budget.

    ``distance`` is the smallest over the whole normalised text; items begin and end with words of it. Null, empty and wordless documents and items hold
    and match nothing. Repeated rows each give their rows, as do repeated items. An empty table on either side gives
    no rows. Other columns are not read. Documents are only scanned, once per block of items, and never shuffled;
    blocks are searched one after the other, and what is found is written at once.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    item_type = benchmark.schema[item_id].dataType
    schema = (chosen.drop("text").schema.add("item_id", item_type)
              .add("distance", "integer").add("budget", "integer"))
    blocks = item_blocks(benchmark, item_id, item_text, block_chars)
    if not blocks:
        return spark.createDataFrame([], schema)
    path = scratch_dir(spark, "contaminated")
    for block in blocks:
        shared = spark.sparkContext.broadcast(collected(block))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, rate)
            for batch in batches:
                rows, keys, distances, budgets = [], [], [], []
                for i, value in enumerate(batch.column(1)):
                    for number, distance in items.found_in(normalised(value.as_py())):
                        ids, _, errors = items.items[number]
                        found = [key for key, times in ids for _ in range(times)]
                        keys.extend(found)
                        for column, entry in ((rows, i), (distances, distance), (budgets, errors)):
                            column.extend([entry] * len(found))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(keys) if keys else pa.array([], pa.null()),
                    pa.array(distances, pa.int32()), pa.array(budgets, pa.int32()),
                ], names=["doc_id", "item_id", "distance", "budget"])

        (chosen.mapInArrow(_cast(search, item_type), schema)
         .write.mode("append").option("compression", "zstd").parquet(path))
        shared.destroy()
    return spark.read.schema(schema).parquet(path)


def _cast(search, item_type):
    """Give the ids of found items the Arrow type of their column."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(item_type)

    def typed(batches):
        for batch in search(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(kind), *batch.columns[2:]], names=batch.schema.names)

    return typed


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", rate: float = ERROR_RATE,
                   block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item; nulls, empty texts and tables as in ``contaminated``.

    Each row is decided by its own text, so ids may be null or repeated. Columns stay as they are. With more than one
    block of items, the rows that are left are written after each block but the last.
    """
    spark = docs.sparkSession
    blocks = item_blocks(benchmark, item_id, item_text, block_chars)
    out, before = docs, None
    for left, block in zip(range(len(blocks) - 1, -1, -1), blocks):
        flag = free_name(out, "_clean")
        shared = spark.sparkContext.broadcast(collected(block))
        out = out.withColumn(flag, _clean(shared, rate)(F.col(text))).where(F.col(flag)).drop(flag)
        if left:
            # What is left is written, so that one block is held at a time.
            path = scratch_dir(spark, "decontaminated")
            out = saved(out, "decontaminated", path)
            shared.destroy()
            if before:
                remove(spark, before)
            before = path
    return out


def _clean(shared, rate):
    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = Items(shared.value, rate)
        for batch in batches:
            yield pa.array([not items.found_in(normalised(t.as_py())) for t in batch], pa.bool_())

    return clean
