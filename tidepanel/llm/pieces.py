"""SentencePiece encoding and decoding by a table of distinct chunks.

If no piece of the vocabulary holds a whitespace marker behind another character, no merge ever crosses the border
between a character and the marker that follows. A text then falls into chunks, runs of markers with the characters
behind them, that the library segments each on its own just as it would within the text. Every distinct chunk is
segmented once; documents keep the positions of their chunks in a list per block (see ``blocks``), and the ids go
back to that list. Models whose pieces or normaliser allow no such cut get each distinct text as one chunk.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from tidepanel.llm.blocks import block_number, numbering, packed, squeezed, stretched, unpacked
from tidepanel.llm.common import saved
from tidepanel.sources.storage import scratch_dir

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: A model file larger than this is not broadcast.
MAX_MODEL_BYTES = 64 << 20
MARK = "▁"
#: Markers (still blanks) and what follows them up to the next one.
CHUNK = re.compile(" +[^ ]*")
#: Characters of text of a block; a longer text is a block of its own.
BLOCK_CHARS = 32 << 20
#: Chunks that are encoded, and lists that are returned, at a time.
GROUP = 4096
#: Decoded characters that are returned at a time.
FLUSH_CHARS = 4 << 20
LEAST_BUCKETS, MOST_BUCKETS = 64, 1 << 16
#: Compression of what is stored: the lists are most of the disk that is taken.
LEVEL = 9
#: Distinct chunks that a task remembers of a bucket.
MOST_KNOWN = 1 << 20
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")

_LOADED: dict[int, Pieces] = {}


class Pieces:
    """A model, the bytes of its pieces, and whether texts may be cut before markers."""

    def __init__(self, model: bytes) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        rules, undo = proto.normalizer_spec, proto.denormalizer_spec
        self.bytes: list[bytes] = []
        for piece in proto.pieces:
            found = BYTE_PIECE.fullmatch(piece.piece) if piece.type == kinds.BYTE else None
            self.bytes.append(bytes([int(found[1], 16)]) if found
                              else piece.piece.replace(MARK, " ").encode())
        self.cuts = (
            not rules.precompiled_charsmap and not undo.precompiled_charsmap
            and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
            and not proto.trainer_spec.treat_whitespace_as_suffix
            and proto.trainer_spec.model_type == proto.trainer_spec.BPE
            and not any(re.search(f"[^{MARK}]{MARK}", p.piece) or p.type == kinds.USER_DEFINED
                        for p in proto.pieces))
        # A marker alone is the one chunk that the library doesn't give back: it adds none to an empty text.
        self.blank = self.library.encode("x ")[len(self.library.encode("x")):]

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text with its dummy prefix, markers as blanks; an empty text has none."""
        if not text:
            return []
        return CHUNK.findall(" " + text.replace(MARK, " ")) if self.cuts else [text]

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks; the library puts the first marker back."""
        if not self.cuts:
            return self.library.encode(chunks, num_threads=1)
        ids = self.library.encode([c[1:] for c in chunks], num_threads=1)
        return [part if chunk != " " else self.blank for chunk, part in zip(chunks, ids)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of encoded chunks; the library takes off the first marker, which only a text's first chunk lacks."""
        texts = self.library.decode(ids, num_threads=1)
        return [" " + t for t in texts] if self.cuts else texts

    def joined(self, parts: list[str]) -> str:
        """The decoded text of a document from that of its chunks."""
        return "".join(parts)[1:] if self.cuts else "".join(parts)


def pieces(model: bytes) -> Pieces:
    """The model of a file's content, built once per process."""
    key = zlib.crc32(model)
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes.")
    return data


# ---- blocks ----------------------------------------------------------------------------------------------------


def bucket_count(total: int) -> int:
    """Into how many buckets distinct chunks are dealt: one for each 4 MiB of text, within bounds."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, total >> 22))


def _listed(chunks: list[str]) -> bytes:
    """Chunks of one bucket: their lengths, then all of them, compressed."""
    lengths = packed(list(map(len, chunks)), LEVEL)
    return len(lengths).to_bytes(4, "little") + lengths + squeezed("".join(chunks).encode(), LEVEL)


def _unlisted(data: bytes) -> list[str]:
    head = 4 + int.from_bytes(data[:4], "little")
    text, ends = stretched(data[head:]).decode(), np.cumsum(unpacked(data[4:head])).tolist()
    return [text[i:j] for i, j in zip([0, *ends[:-1]], ends)]


def _coded(docs: DataFrame, shared, buckets: int, block_chars: int) -> DataFrame:
    """The blocks. Rows with ``list`` are the chunks of a block that fall into one bucket, in the order in which the
    block first meets them. The other row of a block has its documents: ids, numbers of chunks, the chunks' numbers,
    and the bucket of each number."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()),
        T.StructField("list", T.BinaryType()), T.StructField("doc_ids", T.ArrayType(kind)),
        T.StructField("sizes", T.BinaryType()), T.StructField("codes", T.BinaryType()),
        T.StructField("buckets", T.BinaryType())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(shared.value)
        index = chars = 0
        number, ids, codes, kind = numbering(), [], [], pa.null()

        def ended() -> Iterator[pa.RecordBatch]:
            block, chunks = block_number(index), list(number)
            dealt = np.fromiter((zlib.crc32(c.encode()) for c in chunks), np.uint32, len(chunks)) % buckets
            order = np.argsort(dealt, kind="stable")
            found, starts = np.unique(dealt[order], return_index=True)
            lists = [_listed([chunks[i] for i in part]) for part in np.split(order, starts[1:])] if len(found) else []
            for at in range(0, len(found), GROUP):
                part = pa.array(found[at:at + GROUP].astype(np.int32))
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.int64()), part, pa.array(lists[at:at + GROUP], pa.binary()),
                     pa.nulls(n, pa.list_(kind)), *[pa.nulls(n, pa.binary())] * 3], names=schema.names)
            del lists, chunks, order
            sizes = packed(list(map(len, codes)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, kind)),
                 *(pa.array([x], pa.binary()) for x in (sizes, packed(np.concatenate(codes), LEVEL), packed(dealt, LEVEL)))],
                names=schema.names)
            pa.default_memory_pool().release_unused()

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, value in zip(batch.column("doc_id"), batch.column("text")):
                text = value.as_py() or ""
                if ids and chars + len(text) > block_chars:
                    yield from ended()
                    index, chars = index + 1, 0
                    number, ids, codes = numbering(), [], []
                ids.append(doc_id)
                codes.append(np.array(list(map(number.__getitem__, model.chunks(text))), dtype="<u4"))
                chars += len(text)
        if ids:
            yield from ended()

    return saved(docs.mapInArrow(code, schema), "chunk-blocks")


def _segmented(coded: DataFrame, shared, buckets: int, wide: np.dtype) -> DataFrame:
    """``(block, bucket, ids, odd, texts)``: the ids of each list's chunks, and what chunks decode to where that isn't
    what their pieces spell. A task has one bucket's lists after the other, and segments what it meets first."""

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = pieces(shared.value)
        current, known = None, {}
        for batch in batches:
            out, odd, texts = [], [], []
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("list")):
                chunks = _unlisted(data.as_py())
                if bucket != current or len(known) > MOST_KNOWN:
                    current, known = bucket, {}
                fresh = [c for c in chunks if c not in known]
                for at in range(0, len(fresh), GROUP):
                    part = fresh[at:at + GROUP]
                    ids = library.encode(part)
                    for chunk, own, decoded in zip(part, ids, library.decode(ids)):
                        plain = library.cuts and decoded.encode() == b"".join([library.bytes[i] for i in own])
                        known[chunk] = (np.array(own, dtype=wide).tobytes(), None if plain else decoded)
                results = [known[c] for c in chunks]
                lengths = packed([len(r[0]) // wide.itemsize for r in results], LEVEL)
                ids = squeezed(b"".join([r[0] for r in results]), LEVEL)
                out.append(len(lengths).to_bytes(4, "little") + lengths + ids)
                places = [i for i, r in enumerate(results) if r[1] is not None]
                odd.append(places)
                texts.append([results[i][1] for i in places])
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary()),
                 pa.array(odd, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string()))],
                names=["block", "bucket", "ids", "odd", "texts"])

    lists = coded.where("list is not null").select("block", "bucket", "list")
    return (lists.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
            .mapInArrow(segment, "block bigint, bucket int, ids binary, odd array<int>, texts array<string>"))


def list_name(folder: str, block: int) -> str:
    return f"{folder}/{block:016x}.arrow"


def _gathered(segmented: DataFrame, folder: str) -> DataFrame:
    """Each block's results as one file in the shared folder; the blocks.

    The documents of a block are not shuffled: who reads them opens the block's file. A file gets its name when it is
    complete, so a repeated or speculative task does no harm.
    """
    ordered = segmented.repartition("block").sortWithinPartitions("block", "bucket")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        current = writer = partial = out = None

        def closed() -> None:
            writer.close()
            out.close()
            files.move(partial, list_name(base, current))

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            turns = np.flatnonzero(np.diff(blocks)) + 1
            done = []
            for i, j in zip([0, *turns.tolist()], [*turns.tolist(), len(blocks)]):
                if i == j:
                    continue
                if blocks[i] != current:
                    if writer:
                        closed()
                    current = int(blocks[i])
                    done.append(current)
                    partial = f"{list_name(base, current)}.{np.random.default_rng().integers(1 << 62):x}.partial"
                    out = files.open_output_stream(partial)
                    writer = pa.ipc.new_stream(out, batch.schema)
                writer.write_batch(batch.slice(i, j - i))
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["block"])
        if writer:
            closed()

    return saved(ordered.mapInArrow(gather, "block bigint"), "chunk-lists")


def _entries(folder: str, block: int, buckets: np.ndarray, library: Pieces, wide: np.dtype):
    """Of each chunk of a block, by its number: the bytes of its ids, and what it decodes to."""
    ids: list[bytes] = [b""] * len(buckets)
    texts: list[str] = [""] * len(buckets)
    order = np.argsort(buckets, kind="stable")
    found, starts = np.unique(buckets[order], return_index=True)
    places = dict(zip(found.tolist(), np.split(order, starts[1:]))) if len(found) else {}
    if not places:
        return ids, texts
    files, base = pafs.FileSystem.from_uri(folder)
    with files.open_input_stream(list_name(base, block)) as file, pa.ipc.open_stream(file) as batches:
        for batch in batches:
            for bucket, data, odd, others in zip(*(batch.column(c).to_pylist()
                                                   for c in ("bucket", "ids", "odd", "texts"))):
                head = 4 + int.from_bytes(data[:4], "little")
                ends = (np.cumsum(unpacked(data[4:head])) * wide.itemsize).tolist()
                flat, odd = stretched(data[head:]), dict(zip(odd, others))
                for k, (place, i, j) in enumerate(zip(places[bucket].tolist(), [0, *ends[:-1]], ends)):
                    own = ids[place] = flat[i:j]
                    texts[place] = odd[k] if k in odd else b"".join(
                        [library.bytes[t] for t in np.frombuffer(own, dtype=wide).tolist()]).decode()
    return ids, texts


def encoded(docs: DataFrame, model: str = MODEL, doc_id: str = "doc_id", text: str = "text",
            block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, ids, decoded)``: the ids the library gives each whole text, and the text it decodes them to.

    No begin or end ids and no sampling. Null and empty texts have no ids and decode to the empty text; null and
    repeated ids and repeated rows are rows like any other; an empty table gives no rows; other columns are not read.
    A block's distinct chunks are shuffled in compressed lists, one for each bucket of their hash; a bucket's task
    segments each distinct chunk once (again after ``MOST_KNOWN`` others). The ids are shuffled back to the block's
    file; documents are read where they were written, against that file. A chunk however frequent is one entry of
    each block.
    """
    spark = docs.sparkSession
    content = read_model(model)
    shared = spark.sparkContext.broadcast(content)
    wide = np.dtype("<u2" if len(pieces(content).bytes) <= 1 << 16 else "<u4")
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    total = chosen.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = bucket_count(total)
    coded = _coded(chosen, shared, buckets, block_chars)
    folder = scratch_dir(spark, "chunk-files")
    _gathered(_segmented(coded, shared, buckets, wide), folder)
    schema = T.StructType([chosen.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("decoded", T.StringType())])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = pieces(shared.value)
        for batch in batches:
            for row in range(batch.num_rows):
                block, sizes, codes, buckets = (batch.column(c)[row].as_py()
                                                for c in ("block", "sizes", "codes", "buckets"))
                docs = batch.column("doc_ids")[row].values
                ids, texts = _entries(folder, block, unpacked(buckets), library, wide)
                codes, ends = unpacked(codes), np.cumsum(unpacked(sizes)).tolist()
                first, out_ids, out_text, size = 0, [], [], 0
                for i, (start, end) in enumerate(zip([0, *ends[:-1]], ends)):
                    places = codes[start:end].tolist()
                    out_ids.append(np.frombuffer(b"".join([ids[p] for p in places]), dtype=wide).astype(np.int32))
                    out_text.append(library.joined([texts[p] for p in places]))
                    size += len(out_text[-1])
                    if size > FLUSH_CHARS or i == len(ends) - 1:
                        yield _rows(docs.slice(first, i + 1 - first), out_ids, out_text, schema)
                        first, out_ids, out_text, size = i + 1, [], [], 0

    return (coded.where("codes is not null").select("block", "doc_ids", "sizes", "codes", "buckets")
            .mapInArrow(joined, schema))


def _rows(docs: pa.Array, ids: list[np.ndarray], texts: list[str], schema: T.StructType) -> pa.RecordBatch:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(i) for i in ids], out=offsets[1:])
    return pa.RecordBatch.from_arrays(
        [docs, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32())),
         pa.array(texts, pa.string())], names=schema.names)
