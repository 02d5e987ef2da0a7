"""Token ids in training order, as binary shards.

Every document's tokens are one sequence. Sequences are numbered by file and row; a keyed Feistel permutation of
``0 .. n-1`` gives each number its slot in the training order. A shard is a range of slots: its sequences stand one
after the other, each followed by the end token, in rows of a fixed number of tokens. A row is found by its number
alone, so a reader can go on anywhere and reads forward from there.
"""

from __future__ import annotations

import base64
import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm.common import mixed, saved, with_row_id
from tidepanel.sources.storage import scratch_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split of that vocabulary into pieces (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A vocabulary file larger than this is not broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
ROW_TOKENS = 2048
#: Text bytes of a shard in the mean.
SHARD_BYTES = 32 << 20
#: Tasks that write shards, at most; each writes a range of shards one after the other.
MOST_TASKS = 20_000
#: A run of blanks longer than this is a token sequence of its own: the library's matcher would run out of stack.
LONG_BLANKS = 5_000
BLANKS = re.compile("[\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_BLANKS)
KEY = 42
ROUNDS = 6
FLUSH_BYTES = 1 << 20


# ---- the permutation -------------------------------------------------------------------------------------------


def feistel(numbers: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of ``range(size)``, applied to ``numbers``.

    A balanced Feistel network permutes the next power of four; whoever lands outside the range walks on along its
    cycle until it is inside. That visits fewer than four values in the mean.
    """
    half = np.uint64(max(1, math.ceil((max(size, 2) - 1).bit_length() / 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    seeds = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key * 0x632BE59BD9B4E019 % (1 << 64)))
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> half, out[walking] & mask
        for seed in seeds:
            left, right = right, left ^ (mixed(right ^ seed) & mask)
        out[walking] = left << half | right
        walking = walking[out[walking] >= np.uint64(size)]
    return out.astype(np.int64)


def slots(rows: DataFrame, rid: str, key: int) -> tuple[DataFrame, int]:
    """``rows`` with ``slot``, and their number; the driver gets one count per input file."""
    files = rows.groupBy(F.col(rid)["file"].alias("file")).count().collect()
    starts, size = {}, 0
    for file, count in sorted(files, key=lambda f: (f["file"].rpartition("/")[2], f["file"])):
        starts[file] = size
        size += count
    shared = rows.sparkSession.sparkContext.broadcast(starts)

    @F.arrow_udf("long")
    def slot(files: pa.Array, numbers: pa.Array) -> pa.Array:
        coded = files.dictionary_encode()
        first = np.array([shared.value[f] for f in coded.dictionary.to_pylist()], dtype=np.int64)
        return pa.array(feistel(first[coded.indices.to_numpy()] + numbers.to_numpy(), size, key))

    return rows.withColumn("_slot", slot(F.col(rid)["file"], F.col(rid)["row"])), size


# ---- the tokenizer ---------------------------------------------------------------------------------------------

_LOADED: dict[tuple[int, str], tiktoken.Encoding] = {}


def tokenizer(vocabulary: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The encoding of a file of ranks, built once per process."""
    key = (zlib.crc32(vocabulary), pattern)
    if key not in _LOADED:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _LOADED[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]


def encoded(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a text, with blanks in any number.

    The split takes a run of blanks but for its last one as one piece; the last one goes with what follows. At the end
    of a text the whole run is one piece.
    """
    if len(text) < LONG_BLANKS or encoding._pat_str != PATTERN:
        return encoding.encode_ordinary(text)
    ids, at = [], 0
    for run in BLANKS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += encoding.encode_ordinary(text[at:run.start()])
        ids += encoding._encode_single_piece(text[run.start():end])
        at = end
    return ids + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes.")
    return data


# ---- shards ----------------------------------------------------------------------------------------------------


def shard_name(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


class ShardWriter:
    """One shard, written under a name of its own and given its final name when complete.

    Any attempt of a task writes the same bytes, so a repeated or a speculative one does no harm.
    """

    def __init__(self, folder: str, shard: int, row_tokens: int, kind: np.dtype, end: int) -> None:
        self.files, base = pafs.FileSystem.from_uri(folder)
        self.files.create_dir(base, recursive=True)
        self.final = shard_name(base, shard)
        self.partial = f"{self.final}.{np.random.default_rng().integers(1 << 62):x}.partial"
        self.out = self.files.open_output_stream(self.partial)
        self.row_tokens, self.kind, self.end = row_tokens, kind, end
        self.held: list[bytes] = []
        self.bytes = self.at = 0

    def add(self, ids: list[int]) -> tuple[int, int]:
        """Where the sequence starts in the shard, and the CRC-32 of its tokens."""
        data = np.array(ids, dtype=self.kind).tobytes()
        start = self.at
        self.held += [data, np.array([self.end], dtype=self.kind).tobytes()]
        self.at += len(ids) + 1
        self.bytes += len(data) + self.kind.itemsize
        if self.bytes >= FLUSH_BYTES:
            self.flush()
        return start, zlib.crc32(data)

    def flush(self) -> None:
        self.out.write(b"".join(self.held))
        self.held, self.bytes = [], 0

    def close(self) -> None:
        """Fill the last row with end tokens."""
        self.held.append(np.full(-self.at % self.row_tokens, self.end, dtype=self.kind).tobytes())
        self.flush()
        self.out.close()
        self.files.move(self.partial, self.final)


def write_training_order(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY,
                         pattern: str = PATTERN, row_tokens: int = ROW_TOKENS, shard_bytes: int = SHARD_BYTES,
                         key: int = KEY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the token shards of ``docs`` below ``path`` and return their index, one row per document.

    ``(doc_id, slot, shard, start, n_tokens, crc32, n_shards, path, row_tokens, kind)``: the sequence is tokens
    ``start`` to ``start + n_tokens`` of its shard; the end token, the id after the vocabulary's last, follows. Tokens
    are little endian, of 16 bits if the vocabulary allows it; index and shards say which (``kind``), and how many
    tokens a row has. A vocabulary file of over ``MAX_VOCABULARY_BYTES`` is refused. Null and empty texts are sequences of no token; rows with null
    or repeated ids, and repeated rows, have slots of their own; an empty table writes nothing; other columns are
    not read. Text is shuffled once and tokenised once, where it is written.
    """
    spark = docs.sparkSession
    path = path or scratch_dir(spark, "tokens")
    ranks = read_vocabulary(vocabulary)
    end = tokenizer(ranks, pattern).max_token_value + 1
    kind = np.dtype("<u2" if end < 1 << 16 else "<u4")
    rows, rid = with_row_id(docs)
    total = rows.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    chosen = rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(rid).alias("_rid"))
    numbered, size = slots(chosen, "_rid", key)
    shards = max(1, math.ceil(total / shard_bytes))
    tasks = min(shards, MOST_TASKS)
    dealt = (numbered.select(
        "doc_id", "text", F.col("_slot").alias("slot"),
        F.floor(F.col("_slot").cast("decimal(38,0)") * shards / max(size, 1)).cast("int").alias("shard"))
        .repartitionById(tasks, F.floor(F.col("shard").cast("long") * tasks / shards).cast("int"))
        .sortWithinPartitions("shard", "slot"))
    shared = spark.sparkContext.broadcast(ranks)
    folder = f"{path}/shards"
    write_layout(folder, row_tokens, kind)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(shared.value, pattern)
        writer, current = None, None
        for batch in batches:
            starts, lengths, sums = [], [], []
            for value, shard in zip(batch.column(1), batch.column(3).to_pylist()):
                if shard != current:
                    if writer:
                        writer.close()
                    writer, current = ShardWriter(folder, shard, row_tokens, kind, end), shard
                ids = encoded(encoding, value.as_py() or "")
                start, crc = writer.add(ids)
                starts.append(start)
                lengths.append(len(ids))
                sums.append(crc)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "slot", "shard", "start", "n_tokens", "crc32"])
        if writer:
            writer.close()

    schema = (dealt.select("doc_id", "slot", "shard").schema
              .add("start", "long").add("n_tokens", "long").add("crc32", "long"))
    index = saved(dealt.mapInArrow(write, schema), "index", f"{path}/index")
    return index.withColumns({"n_shards": F.lit(shards), "path": F.lit(folder), "row_tokens": F.lit(row_tokens),
                              "kind": F.lit(kind.str)})


def write_layout(folder: str, row_tokens: int, kind: np.dtype) -> None:
    files, base = pafs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base}/layout.json") as file:
        file.write(json.dumps({"row_tokens": row_tokens, "kind": kind.str}).encode())


def read_layout(folder: str) -> tuple[int, np.dtype]:
    """Tokens of a row, and their type, as the shards of a folder were written."""
    files, base = pafs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{base}/layout.json") as file:
        layout = json.loads(file.read())
    return layout["row_tokens"], np.dtype(layout["kind"])


def manifest(index: DataFrame) -> DataFrame:
    """``(shard, rows, first_row, path)``: how many rows a shard has, and the number of its first one."""
    rows = index.groupBy("shard", "path").agg(
        F.ceil(F.max((F.col("start") + F.col("n_tokens") + 1) / F.col("row_tokens"))).alias("rows"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("shard", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first_row"), "path")


def read_rows(folder: str, shard: int, first: int = 0) -> Iterator[np.ndarray]:
    """The rows of a shard from number ``first`` on; only what is asked for is read."""
    row_tokens, kind = read_layout(folder)
    files, base = pafs.FileSystem.from_uri(folder)
    stride = row_tokens * kind.itemsize
    with files.open_input_file(shard_name(base, shard)) as file:
        file.seek(first * stride)
        while data := file.read(stride):
            yield np.frombuffer(data, dtype=kind)


def read_back(index: DataFrame) -> DataFrame:
    """``index`` with ``read_crc32``, the CRC-32 of each sequence as it stands in its shard; shards are read forward."""
    ordered = index.repartition("shard").sortWithinPartitions("shard", "slot")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = file = None
        for batch in batches:
            sums = []
            for shard, folder, start, n, kind in zip(*(batch.column(c).to_pylist()
                                                       for c in ("shard", "path", "start", "n_tokens", "kind"))):
                if shard != current:
                    files, base = pafs.FileSystem.from_uri(folder)
                    file, current, wide = files.open_input_file(shard_name(base, shard)), shard, np.dtype(kind).itemsize
                file.seek(start * wide)
                sums.append(zlib.crc32(file.read(n * wide)))
            yield batch.append_column("read_crc32", pa.array(sums, pa.int64()))

    return ordered.mapInArrow(read, T.StructType([*ordered.schema.fields, T.StructField("read_crc32", T.LongType())]))
