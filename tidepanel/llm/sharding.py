"""Shards in random order by a two-pass external shuffle.

Pass 1 scatters the records uniformly over buckets that fit in memory, by a seeded hash. Pass 2 puts each bucket's
records into one fixed order, shuffles them (Fisher-Yates, seeded by the bucket) and writes them. The buckets one
after the other are then one random permutation of all records, and record ``p`` of it goes to shard ``p mod n`` at
slot ``p div n``: shards are read in slot order, and their row counts differ by one at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import free_name, quoted, with_row_id
from tidepanel.sources.storage import scratch_dir

SHARDS = 8
SEED = 42
#: Text bytes that a bucket holds in the mean, at most; a task keeps one bucket in memory.
BUCKET_BYTES = 64 << 20
#: Buckets that are made of any table, for parallel work, and tasks that shuffle them, at most.
LEAST_BUCKETS, MOST_TASKS = 64, 20_000


def record_size(text):
    """UTF-8 bytes and one for the end of the record; null: no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def fisher_yates(n: int, *seed: int) -> np.ndarray:
    """A permutation of ``range(n)``; numpy's shuffle is the Fisher-Yates exchange from the end."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64(list(seed))).shuffle(order)
    return order


def scattered(rid: str, doc_id: str, buckets: int, seed: int):
    """The columns of pass 1: a row's bucket, and the hash by which a bucket's rows are put into their fixed order.

    The hashes cover the id and the row's place (file name and number), so neither many rows of one text nor one row
    repeated very often meet in a bucket. The order says nothing about the bucket: it is hashed with another seed.
    """
    row = (F.col(doc_id), F.substring_index(F.col(rid)["file"], "/", -1), F.col(rid)["row"])
    return (F.pmod(F.xxhash64(F.lit(seed), *row), F.lit(buckets)).cast("int"),
            F.xxhash64(F.lit(seed + 1), *row))


def write_shards(docs: DataFrame, path: str | None = None, shards: int = SHARDS, seed: int = SEED,
                 bucket_bytes: int = BUCKET_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` to ``path/shard=k/`` and return them as read from there, with ``shard`` and ``slot``.

    Slots of a shard run from 0 without gaps. All columns are written, packed as ``record``, so their names cannot
    clash. Null ids and texts and repeated rows are records like any other; an empty table gives empty output. The
    driver gets one count a bucket. A lost task is repeated on the same rows in the same order, so it writes the
    same again.
    """
    spark = docs.sparkSession
    path = path or scratch_dir(spark, "shards")
    rows, rid = with_row_id(docs)
    total = rows.agg(F.sum(record_size(F.col(text)))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(total / bucket_bytes))
    bucket, order = scattered(rid, doc_id, buckets, seed)
    counts = dict(rows.select(bucket.alias("bucket")).groupBy("bucket").count().collect())
    starts, at = {}, 0
    for b in sorted(counts):
        starts[b] = at
        at += counts[b]
    packed = rows.select(
        bucket.alias("bucket"), order.alias("order"), F.struct(*[quoted(c) for c in docs.columns]).alias("record"),
        F.col(rid).alias("rid"))
    tasks = min(buckets, MOST_TASKS)
    task = F.floor(F.col("bucket").cast("long") * tasks / buckets).cast("int")
    dealt = (packed.repartitionById(tasks, task).sortWithinPartitions("bucket", "order", "rid")
             .select("bucket", "record"))
    record = packed.schema["record"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(starts)

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            number = rows["bucket"][0].as_py()
            rows = rows.take(pa.array(fisher_yates(len(rows), seed, number)))
            places = shared.value[number] + np.arange(len(rows))
            out = pa.table({"shard": pa.array((places % shards).astype(np.int32)),
                            "slot": pa.array(places // shards), "record": rows["record"]})
            yield from out.combine_chunks().to_batches(max_chunksize=2000)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and held[-1].column(0)[0].as_py() != numbers[a]:
                    yield from ended(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from ended(held)

    done = dealt.mapInArrow(shuffle, f"shard int, slot bigint, record {record}").sortWithinPartitions("shard", "slot")
    done.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema(done.schema).parquet(path)


def unpacked(written: DataFrame) -> DataFrame:
    """The records' own columns; ``shard`` and ``slot`` come last, under longer names where records have these."""
    records = written.select("record.*")
    names = [free_name(records, n) for n in ("shard", "slot")]
    return written.select("record.*", F.col("shard").alias(names[0]), F.col("slot").alias(names[1]))
