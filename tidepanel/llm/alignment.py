"""Alignment of two tokenizers' tokens, window by window.

Both tokenizers encode the whole text, parts that recur only once. Where a token of each ends at the same byte, the tokens so far are aligned;
where besides both next tokens begin with a space, the document is cut into windows. Windows are memoised by their
tuples of ids: within a block of documents (see ``blocks``) each distinct window is aligned once, and documents keep
the positions of their windows. How many documents hold a pair of ids linked is counted per block, then summed over
blocks; the sums go back to the blocks by the pairs' positions.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidepanel.llm.blocks import block_number, numbering, packed, unpacked
from tidepanel.llm.common import saved
from tidepanel.llm.pieces import CHUNK, MARK, MODEL, Pieces, pieces, read_model

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Characters of text of a block, and those whose tokens are held at a time; a longer text is one block.
BLOCK_CHARS, BATCH_CHARS = 4 << 20, 1 << 19
#: Texts from this length on are searched for runs of blanks that the faster library can't take.
LONG_TEXT, LONG_BLANKS = 100_000, re.compile(r"\s{5000}")
#: White space before a blank, and how long a chunk is tokenised together with others.
MIXED, LONG_CHUNK = re.compile(r"[^\S ] "), 1000
#: Groups with more cells (pairs of places) than this are linked id by id, with counts.
MOST_CELLS = 4096
#: Positions of windows that are expanded to pairs at a time.
EXPAND = 1 << 18
#: Partitions over which blocks are dealt when their results come back, at most: else one a block.
MOST_PARTS = 20_000
#: Stands between the two sides of a window's key; no id.
SEPARATOR = (1 << 32) - 1
PAIR, WINDOWS, DOCUMENT = 0, 1, 2

_LOADED: dict[int, ByteBpe] = {}


class ByteBpe:
    """A byte-level BPE from a JSON file, and the bytes of its tokens.

    A file that is plain byte-level BPE with merges in the order of their ids is encoded by the faster library, by
    ranks; texts it can't take, and all other files, by the library of the format itself. Strings of special tokens
    are ordinary text.
    """

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        self.content = content
        # Byte-level files write a byte as itself if it prints, else as the next free character from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        vocabulary = spec["model"]["vocab"]
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.bytes = [b""] * (max([*vocabulary.values(), *added], default=-1) + 1)
        for token, i in vocabulary.items():
            if i not in added:
                self.bytes[i] = bytes(byte[c] for c in token)
        for i, token in added.items():
            self.bytes[i] = token
        self.ranked = self._ranked(spec, vocabulary, added)

    def _ranked(self, spec: dict, vocabulary: dict[str, int], added: dict[int, bytes]) -> tiktoken.Encoding | None:
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ())]
        ids = [vocabulary["".join(m)] for m in merges]
        plain = (
            model["type"] == "BPE" and spec["normalizer"] is None and cut.get("type") == "ByteLevel"
            and cut.get("use_regex") and not cut.get("add_prefix_space")
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                               "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and ids == sorted(set(ids)) and len(vocabulary) - len(set(vocabulary.values()) & set(added)) == 256 + len(ids)
            and sorted(b for i, b in enumerate(self.bytes) if i not in added and len(b) == 1)
            == [bytes([b]) for b in range(256)])
        if not plain:
            return None
        ranks = {b: i for i, b in enumerate(self.bytes) if i not in added}
        return tiktoken.Encoding("aligned", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens={})

    @cached_property
    def library(self) -> Tokenizer:
        made = Tokenizer.from_str(self.content.decode())
        made.encode_special_tokens = True
        return made

    def encode(self, text: str) -> np.ndarray:
        if self.ranked is None or (len(text) >= LONG_TEXT and LONG_BLANKS.search(text)):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.ranked.encode_to_numpy(text, disallowed_special=())


def byte_bpe(content: bytes) -> ByteBpe:
    """The tokenizer of a file's content, built once per process."""
    key = zlib.crc32(content)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(content)
    return _LOADED[key]


# ---- windows ---------------------------------------------------------------------------------------------------


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of the ranges ``starts[i] .. starts[i] + counts[i]``, one range after the other."""
    if not len(counts):
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - counts), counts)


def before(counts: np.ndarray) -> np.ndarray:
    """Where each of consecutive ranges starts."""
    return np.cumsum(counts) - counts


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


class Spelling:
    """The bytes of a vocabulary's tokens, for many tokens at once."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.sizes = np.array(list(map(len, tokens)), dtype=np.int64)
        self.spaced = np.array([t[:1] == b" " for t in tokens])
        self.data, self.starts = np.frombuffer(b"".join(tokens), dtype=np.uint8), before(self.sizes)

    def right(self, ids: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Of texts whose tokens stand one after the other, ``counts`` of each: whether they spell the text."""
        size = self.sizes[ids]
        lengths = np.array(list(map(len, texts)), dtype=np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(counts)
        good = upto[ends] - upto[ends - counts] == lengths
        if not good.all():
            # Only texts of the right length can be compared at once.
            ids = ids[np.repeat(good, counts)]
            size, lengths = self.sizes[ids], lengths[good]
            texts = [t for t, ok in zip(texts, good) if ok]
        spelled = self.data[spread(self.starts[ids], size)] == np.frombuffer(b"".join(texts), dtype=np.uint8)
        if not spelled.all():
            wrong = np.add.reduceat(~spelled, before(lengths)[lengths > 0], dtype=np.int64) > 0
            places = np.flatnonzero(good)[lengths > 0]
            good[places[wrong]] = False
        return good


class Table:
    """Distinct windows: their ids of both sides, the sizes of their groups and their numbers of groups."""

    def __init__(self, a, b, na, nb, groups) -> None:
        self.a, self.b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        self.na, self.nb, self.groups = (np.asarray(x, np.int64) for x in (na, nb, groups))
        self.first = before(self.groups)

    def parts(self) -> list[bytes]:
        return [packed(x) for x in (self.a, self.b, self.na, self.nb, self.groups)]

    def per_window(self, of_groups: np.ndarray) -> np.ndarray:
        """Sums over the groups of each window; every window has one at least."""
        return np.add.reduceat(of_groups, self.first) if len(self.groups) else of_groups

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(pairs, counts, place, weight)``: the sorted distinct pairs of ids, as one number each; for each window
        in order its number of entries; of each entry the pair's place and how many pairs of places it stands for.
        """
        window = np.repeat(np.arange(len(self.groups)), self.groups)
        a0, b0 = before(self.na), before(self.nb)
        cells = self.na * self.nb
        small = np.flatnonzero(cells <= MOST_CELLS)
        k = spread(np.zeros(len(small), np.int64), cells[small])
        wide = np.repeat(self.nb[small], cells[small])
        a = self.a[np.repeat(a0[small], cells[small]) + k // np.maximum(wide, 1)]
        b = self.b[np.repeat(b0[small], cells[small]) + k % np.maximum(wide, 1)]
        windows, keys, weights = [np.repeat(window[small], cells[small])], [a << 32 | b], [np.ones(len(a), np.int64)]
        for g in np.flatnonzero(cells > MOST_CELLS):
            ids, n = np.unique(self.a[a0[g]:a0[g] + self.na[g]], return_counts=True)
            others, m = np.unique(self.b[b0[g]:b0[g] + self.nb[g]], return_counts=True)
            keys.append((ids[:, None] << 32 | others[None, :]).ravel())
            weights.append((n[:, None] * m[None, :]).ravel())
            windows.append(np.full(len(keys[-1]), window[g]))
        windows, keys, weights = (np.concatenate(x) for x in (windows, keys, weights))
        order = np.argsort(windows, kind="stable")
        pairs, place = np.unique(keys[order], return_inverse=True)
        return pairs, np.bincount(windows, minlength=len(self.groups)), place, weights[order]

    def texts(self) -> list[str]:
        """The groups of each window, ``a1,a2|b1;a3|b2,b3``."""
        ids = list(map(str, range(int(max(self.a.max(initial=0), self.b.max(initial=0))) + 1)))
        sides = []
        for tokens, counts in ((self.a, self.na), (self.b, self.nb)):
            words, stops = [ids[t] for t in tokens.tolist()], np.cumsum(counts)
            sides.append([words[i] if j - i == 1 else ",".join(words[i:j])
                          for i, j in zip((stops - counts).tolist(), stops.tolist())])
        groups = list(map("|".join, zip(*sides)))
        return [groups[i] if n == 1 else ";".join(groups[i:i + n])
                for i, n in zip(self.first.tolist(), self.groups.tolist())]


class Block:
    """The windows of a run of documents, numbered as they come, and the documents' positions.

    Tokenisation is of the whole text, but the parts that texts share are tokenised and cut into windows once.
    """

    def __init__(self, left: ByteBpe, right: Pieces) -> None:
        self.left, self.right = left, right
        self.spelling = [Spelling(t.bytes) for t in (left, right)]
        self.cuts = left.ranked is not None and right.cuts
        self.clear()

    def clear(self) -> None:
        self.number = numbering()
        self.new: list[tuple[np.ndarray, ...]] = []
        self.rows: list[tuple[pa.Scalar, bytes]] = []
        self.chars = 0
        # Chunks: their numbers, whether both sides' tokens spell them, their windows, and how many each has.
        self.chunk = numbering()
        self.spelled, self.sizes = np.empty(0, bool), np.empty(0, np.int64)
        self.windows = np.empty(0, np.int64)

    def chunks(self, text: str) -> list[str]:
        """A text with a blank before, in parts that both sides tokenise each on its own just as within the text.

        Such a part begins with blanks behind a character that is none. A text in which other white space stands
        before a blank is one part, as is any text if either tokenizer isn't known to allow the cuts.
        """
        whole = " " + text
        return CHUNK.findall(whole) if self.cuts and not MIXED.search(whole) else [whole]

    def _left(self, chunks: list[str], data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The left side's tokens of chunks, one after the other, and how many each has."""
        # Chunks that end in a character are tokenised in one go; where they end is told by their bytes.
        lengths, joined = np.array(list(map(len, data)), dtype=np.int64), b"".join(data)
        last = np.frombuffer(joined, dtype=np.uint8)[np.cumsum(lengths) - 1]
        joint = (last > 32) & (lengths < LONG_CHUNK) & self.cuts
        for i in np.flatnonzero(joint & (last >= 127)).tolist():
            joint[i] = not chunks[i][-1].isspace()
        text = "".join(chunks) if joint.all() else "".join([c for c, ok in zip(chunks, joint.tolist()) if ok])
        together = self.left.encode(text) if text else np.empty(0, np.uint32)
        ends = np.cumsum(lengths[joint])
        upto = np.cumsum(self.spelling[0].sizes[together])
        stops = np.searchsorted(upto, ends) + 1
        if len(ends) and not (upto[-1] == ends[-1] and (upto[stops - 1] == ends).all()):
            joint[:] = False
            stops = stops[:0]
        parts, counts, at = [], np.zeros(len(chunks), dtype=np.int64), 0
        counts[joint] = np.diff(stops, prepend=0)
        alone = np.flatnonzero(~joint)
        if not len(alone):
            return together, counts
        starts = before(counts)
        for i in alone.tolist():
            parts += [together[at:starts[i]], self.left.encode(chunks[i])]
            at, counts[i] = starts[i], len(parts[-1])
        return np.concatenate([*parts, together[at:] if joint.any() else together[:0]]), counts

    def _right(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The right side's tokens of chunks; it puts the first blank back but of a chunk that is nothing else."""
        ids = self.right.library.encode([c[1:] for c in chunks], num_threads=1)
        if self.cuts:
            ids = [part if c != " " else self.right.blank for c, part in zip(chunks, ids)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.array(list(map(len, ids)), dtype=np.int64)

    def _learn(self, chunks: list[str]) -> None:
        """Tokenise new chunks on both sides and find their windows; one that isn't spelled has none."""
        data = [c.encode() for c in chunks]
        sides = [self._left(chunks, data), self._right(chunks)]
        spelled = np.ones(len(chunks), dtype=bool)
        for spelling, (tokens, counts) in zip(self.spelling, sides):
            spelled &= spelling.right(tokens, counts, data)
        sizes = np.zeros(len(chunks), dtype=np.int64)
        if spelled.any():
            left, right = (t[np.repeat(spelled, n)] for t, n in sides)
            found, cuts = self._windows(left, right, np.cumsum(sides[0][1][spelled]))
            sizes[spelled] = np.diff(cuts, prepend=0, append=len(found))
            self.windows = np.concatenate([self.windows, found])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.spelled = np.concatenate([self.spelled, spelled])

    def add(self, ids: list, texts: list[str]) -> None:
        """Documents with their texts; a text that either side's tokens don't spell has no windows.

        The right side writes blanks as markers and reads markers as blanks, so a text that holds one isn't spelled.
        """
        self.chars += sum(map(len, texts))
        known = len(self.chunk)
        parts = [np.array(list(map(self.chunk.__getitem__, self.chunks(t))) if t and MARK not in t else [], np.int64)
                 for t in texts]
        fresh = list(islice(self.chunk, known, None))
        if fresh:
            self._learn(fresh)
        starts = before(self.sizes)
        for i, part in zip(ids, parts):
            good = len(part) and self.spelled[part].all()
            codes = self.windows[spread(starts[part], self.sizes[part])] if good else part[:0]
            self.rows.append((i, packed(codes)))

    def _windows(self, left: np.ndarray, right: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows' numbers of documents one after the other, and where documents end; their tokens end at
        ``ends`` on the left."""
        tokens = [left, right]
        bytes_upto = [np.cumsum(s.sizes[t]) for s, t in zip(self.spelling, tokens)]
        mark = np.zeros(bytes_upto[0][-1] + 1, dtype=np.uint8)
        mark[bytes_upto[0]] = 1
        mark[bytes_upto[1]] += 1
        # One past the last token of each group, on both sides.
        stops = [np.flatnonzero(mark[e] == 2) + 1 for e in bytes_upto]
        sizes = [np.diff(s, prepend=0) for s in stops]
        cut = np.ones(len(stops[0]), dtype=bool)
        cut[:-1] = self.spelling[0].spaced[left[stops[0][:-1]]] & self.spelling[1].spaced[right[stops[1][:-1]]]
        document = np.searchsorted(stops[0], ends)
        cut[document] = True
        last = np.flatnonzero(cut)
        # A window's key: its tokens on the left, a separator, its tokens on the right.
        counts = [np.diff(s[last], prepend=0) for s in stops]
        length = counts[0] + counts[1] + 1
        start = before(length)
        keys = np.full(length.sum(), SEPARATOR, dtype="<u4")
        keys[spread(start, counts[0])] = left
        keys[spread(start + counts[0] + 1, counts[1])] = right
        data, bounds = keys.tobytes(), (4 * np.append(start, len(keys))).tolist()
        known = len(self.number)
        codes = np.fromiter(map(self.number.__getitem__, map(data.__getitem__, map(slice, bounds, bounds[1:]))),
                            np.int64, len(last))
        # Numbers are given in order, so a window is new where its number exceeds all before it.
        so_far = np.maximum.accumulate(np.concatenate([[known - 1], codes]))[:-1]
        new = np.flatnonzero(codes > so_far)
        groups = np.diff(last, prepend=-1)
        inside = spread(last[new] - groups[new] + 1, groups[new])
        self.new.append((
            *(t[spread((s - n)[inside], n[inside])] for t, s, n in zip(tokens, stops, sizes)),
            *(n[inside] for n in sizes), groups[new]))
        return codes, np.searchsorted(last, document)[:-1] + 1

    def table(self) -> Table:
        columns = zip(*self.new) if self.new else [[np.empty(0)]] * 5
        return Table(*(np.concatenate(c) for c in columns))

    def counts(self, pairs: np.ndarray, entries: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many documents hold each pair."""
        held, starts = np.zeros(len(pairs), dtype=np.int64), before(entries)
        seen = np.zeros(len(pairs), dtype=bool)
        for _, data in self.rows:
            codes = unpacked(data)
            for at in range(0, len(codes), EXPAND):
                part = codes[at:at + EXPAND]
                seen[place[spread(starts[part], entries[part])]] = True
            found = np.flatnonzero(seen)
            held[found] += 1
            seen[found] = False
        return held


# ---- the operator ----------------------------------------------------------------------------------------------


def _blocks(docs: DataFrame, left, right, block_chars: int) -> DataFrame:
    """Per block its pairs with their numbers of documents, its windows, and its documents."""
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()),
        T.StructField("code", T.IntegerType()), T.StructField("a", T.IntegerType()),
        T.StructField("b", T.IntegerType()), T.StructField("held", T.LongType()),
        T.StructField("parts", T.ArrayType(T.BinaryType())), T.StructField("doc_id", docs.schema["doc_id"].dataType)])

    def rows(block: int, kind: int, n: int, doc_type: pa.DataType, **columns) -> pa.RecordBatch:
        given = {"block": pa.array(np.full(n, block), pa.int64()), "kind": pa.array(np.full(n, kind), pa.int32()),
                 "code": pa.array(np.arange(n), pa.int32()), **columns}
        types = [pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.list_(pa.binary()), doc_type]
        return pa.RecordBatch.from_arrays(
            [given.get(name, pa.nulls(n, t)) for name, t in zip(schema.names, types)], names=schema.names)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(byte_bpe(left.value), pieces(right.value))
        index, kind = 0, pa.null()

        def ended() -> Iterator[pa.RecordBatch]:
            number, table = block_number(index), block.table()
            pairs, entries, place, _ = table.links()
            yield rows(number, WINDOWS, 1, kind, parts=pa.array([table.parts()], pa.list_(pa.binary())))
            held = block.counts(pairs, entries, place)
            for at in range(0, len(pairs), 1 << 16):
                part = pairs[at:at + (1 << 16)]
                yield rows(number, PAIR, len(part), kind, a=pa.array(part >> 32, pa.int32()),
                           b=pa.array(part & 0xFFFFFFFF, pa.int32()), held=pa.array(held[at:at + (1 << 16)]),
                           code=pa.array(np.arange(at, at + len(part)), pa.int32()))
            for at in range(0, len(block.rows), 4096):
                part = block.rows[at:at + 4096]
                yield rows(number, DOCUMENT, len(part), kind, doc_id=pa.array([r[0] for r in part], kind),
                           parts=pa.array([[r[1]] for r in part], pa.list_(pa.binary())))

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            ids, texts, size = [], [], 0
            for doc_id, value in zip(batch.column("doc_id"), batch.column("text")):
                text = value.as_py() or ""
                if ids and size + len(text) > BATCH_CHARS:
                    block.add(ids, texts)
                    ids, texts, size = [], [], 0
                if block.rows and not ids and block.chars + len(text) > block_chars:
                    yield from ended()
                    block.clear()
                    index += 1
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
            if ids:
                block.add(ids, texts)
        if block.rows:
            yield from ended()

    return saved(docs.mapInArrow(align, schema), "align-blocks")


def aligned(docs: DataFrame, left: str = BYTE_BPE, right: str = MODEL, doc_id: str = "doc_id", text: str = "text",
            block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)`` of each whole text.

    ``left`` encodes a space and the text, ``right`` the text, which it puts a space before. ``groups`` lists the ids
    between shared ends, ``a1,a2|b1;a3|b2,b3``; the ids of a group are linked, each with each. The count of a pair of
    ids is the number of documents that hold it linked; ``count_sum`` is summed over links, and ``n_best`` counts
    those whose count is the highest of their left id. Null and empty texts, and texts that either side's tokens
    don't spell, have zeros and no groups, and count nowhere. Null and repeated ids and repeated rows are documents
    like any other; an empty table gives no rows; other columns are not read. A group without a shared end in a very
    long run of characters is linked by its distinct ids.
    """
    spark = docs.sparkSession
    lefts, rights = (spark.sparkContext.broadcast(read_model(path)) for path in (left, right))
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    blocks = _blocks(chosen, lefts, rights, block_chars)
    parts = min(max(blocks.where(F.col("kind") == WINDOWS).count(), 1), MOST_PARTS)
    pairs = blocks.where(F.col("kind") == PAIR).select("block", "kind", "code", "a", "b", "held")
    counts = saved(pairs.groupBy("a", "b").agg(F.sum("held").alias("held")), "align-pairs")
    # An id has at most as many partners as the other vocabulary has ids.
    ranked = counts.join(counts.groupBy("a").agg(F.max("held").alias("most")), "a").select(
        "a", "b", "held", (F.col("held") == F.col("most")).alias("best"))
    found = pairs.drop("held").join(ranked, ["a", "b"]).select("block", "kind", "code", "held", "best")
    others = blocks.where(F.col("kind") != PAIR).select("block", "kind", "code", "parts", "doc_id")
    ordered = (found.unionByName(others, allowMissingColumns=True)
               .repartition(parts, "block").sortWithinPartitions("block", "kind", "code"))
    schema = T.StructType([
        T.StructField("doc_id", chosen.schema["doc_id"].dataType),
        *[T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
        T.StructField("groups", T.StringType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, best, sums, texts = None, [], [], None, []
        for batch in batches:
            kinds, numbers = (batch.column(c).to_numpy() for c in ("kind", "block"))
            turns = np.flatnonzero((np.diff(kinds) != 0) | (np.diff(numbers) != 0)) + 1
            for i, j in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows]):
                if i == j:
                    continue
                if numbers[i] != current:
                    current, held, best = numbers[i], [], []
                part = batch.slice(i, j - i)
                if kinds[i] == PAIR:
                    held.append(part.column("held").to_numpy())
                    best.append(part.column("best").to_numpy(zero_copy_only=False))
                elif kinds[i] == WINDOWS:
                    table = Table(*map(unpacked, part.column("parts")[0].as_py()))
                    _, entries, place, weight = table.links()
                    count = np.concatenate(held or [np.empty(0, np.int64)])
                    good = np.concatenate(best or [np.empty(0, bool)])
                    at = before(entries)
                    linked = [np.add.reduceat(x, at) if len(at) else x
                              for x in (weight * good[place], weight * count[place])]
                    sums = np.stack([
                        table.per_window(table.na), table.per_window(table.nb), table.groups,
                        table.per_window(table.na * table.nb), *linked], axis=1)
                    texts = table.texts()
                else:
                    yield from documents(part, sums, texts)

    def documents(part: pa.RecordBatch, sums: np.ndarray, texts: list[str]) -> Iterator[pa.RecordBatch]:
        at = 0
        while at < part.num_rows:
            first, rows, groups, size = at, [], [], 0
            while at < part.num_rows and size < BATCH_CHARS:
                codes = unpacked(part.column("parts")[at].as_py()[0])
                rows.append(sums[codes].sum(axis=0))
                groups.append(";".join([texts[c] for c in codes.tolist()]))
                size += len(groups[-1])
                at += 1
            numbers = np.array(rows, dtype=np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").slice(first, at - first), *(pa.array(c) for c in numbers.T.copy()),
                 pa.array(groups, pa.string())], names=schema.names)

    return ordered.mapInArrow(join, schema)
