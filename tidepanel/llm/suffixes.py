"""Repeated strings of bytes, by sorting suffixes (deep-shallow).

A string of ``length`` bytes is repeated if it also starts anywhere else, in any text. Sorting every suffix of the
corpus is not needed to find all of them: of the grams in a window of ``length`` bytes the one with the least hash is
its anchor, so equal windows have equal anchors at equal offsets. Only anchors whose gram occurs twice go on. Their
surroundings are gathered by gram, and there the suffixes that start at the anchor, and the prefixes that end there,
are sorted: multikey quicksort to a shallow depth, blind tries for the groups that are still equal. Neighbours'
common lengths then tell which windows occur twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import POWERS, free_name, mixed, prefix_hashes, quoted, saved, with_row_id

LENGTH = 400
GRAM = 64
#: Bytes whose windows are hashed at a time, and the bits that number them.
BLOCK = 1 << 20
PLACE_BITS = 21
#: Multikey quicksort compares this many bytes at a time, down to the shallow depth.
STEP, SHALLOW = 32, 128
#: Up to this many suffixes are compared by their pairs' common lengths, more by classes.
PAIRWISE = 48
#: Occurrences of one gram that a task sorts together; a more frequent gram is dealt to several tasks.
BUCKET = 4_000
#: Slices of the offsets by which a gram of several tasks is compared between them.
SLICES = 16
#: Rows that leave a task at a time.
ROWS_OUT = 10_000


# ---- anchors ---------------------------------------------------------------------------------------------------


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1: n])


def anchors(data: np.ndarray, units: list[tuple[int, int]], length: int, gram: int):
    """Anchors of the windows inside the stretches ``units`` of ``data``.

    Returns arrays: unit, place, largest and smallest offset of the windows that the anchor stands for, gram hash.
    """
    sums = prefix_hashes(data)
    hashes = mixed((sums[gram:] - sums[:-gram]) * POWERS.down[: len(data) - gram + 1])
    low = np.uint64(PLACE_BITS)
    ranked = hashes >> low << low | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_minimum(ranked, length - gram + 1)
    inside = np.zeros(len(least), dtype=bool)
    for start, end in units:
        inside[start: max(start, end - length + 1)] = True
    windows = np.flatnonzero(inside)
    places = (least[windows] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(places, prepend=-1))
    last = np.append(first[1:], len(places))[: len(first)] - 1
    at = places[first]
    unit = np.searchsorted(np.array([e for _, e in units]), at, side="right")
    return unit, at, at - windows[first], at - windows[last], hashes[at].view(np.int64)


def periodic_runs(data: np.ndarray, unit, at, hashes, length: int, gram: int):
    """Stretches that repeat themselves with a period of at most ``gram``, and which anchors can go.

    In such a stretch every period has an anchor of the same gram. Once it is a period longer than a window, all
    its windows occur twice. The first two anchors stand for the content of all windows inside; those after them
    whose windows end inside add nothing, for this text or for others.
    """
    regions, keep = [], np.ones(len(at), dtype=bool)
    steps = np.diff(at)
    linked = (np.diff(unit) == 0) & (np.diff(hashes) == 0) & (steps <= gram)
    i = 0
    for i in np.flatnonzero(linked & ~np.concatenate(([False], linked[:-1] & (steps[1:] == steps[:-1])))):
        period = int(steps[i])
        k = i + 1
        while k < len(steps) and linked[k] and steps[k] == period:
            k += 1
        start, end = int(at[i]), int(at[k]) + gram
        if end - start >= length + period and np.array_equal(data[start:end - period], data[start + period:end]):
            regions.append((int(unit[i]), start, end))
            inner = np.arange(i + 2, k + 1)
            keep[inner[at[inner] <= end - length]] = False
    return regions, keep


def text_anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """``(text number, hash, place, back, least, stop)`` of all anchors; for a periodic stretch the hash is None.

    Windows start ``least`` to ``back`` bytes before the place. Long texts are cut into blocks that overlap by one
    byte less than a window, so every window is in one block.
    """
    def flush(held):
        data = np.frombuffer(b"".join(piece for _, _, piece in held), dtype=np.uint8)
        ends = np.cumsum([len(piece) for _, _, piece in held])
        units = [(int(e) - len(piece), int(e)) for e, (_, _, piece) in zip(ends, held)]
        unit, at, back, least, hashes = anchors(data, units, length, gram)
        regions, keep = periodic_runs(data, unit, at, hashes, length, gram)
        shift = np.array([offset - start for (_, offset, _), (start, _) in zip(held, units)])
        owner = np.array([number for number, _, _ in held])
        unit, at, back, least, hashes = (x[keep] for x in (unit, at, back, least, hashes))
        yield from zip(owner[unit].tolist(), hashes.tolist(), (at + shift[unit]).tolist(), back.tolist(),
                       least.tolist(), [None] * len(at))
        for u, start, end in regions:
            yield held[u][0], None, start + int(shift[u]), None, None, end + int(shift[u])

    held, size = [], 0
    for number, text in enumerate(texts):
        for offset in range(0, max(len(text) - length + 1, 0), BLOCK):
            piece = text[offset: offset + BLOCK + length - 1]
            if held and size + len(piece) > BLOCK + length:
                yield from flush(held)
                held, size = [], 0
            held.append((number, offset, piece))
            size += len(piece)
    if held:
        yield from flush(held)


# ---- deep-shallow sorting --------------------------------------------------------------------------------------


def common_length(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Strings in order, by their branching bytes only; a full comparison is made once per insertion."""

    __slots__ = ("root",)

    def __init__(self, strings: list[bytes], members: list[int]) -> None:
        # An inner node is [depth, {byte or -1 at the end: child}]; a leaf is a tuple (string, [members]).
        self.root: list | tuple = (strings[members[0]], [members[0]])
        for i in members[1:]:
            self.insert(strings[i], i)

    def insert(self, string: bytes, member: int) -> None:
        node = self.root
        while isinstance(node, list):
            depth, children = node
            node = children.get(string[depth] if depth < len(string) else -1) or next(iter(children.values()))
        other, same = node
        common = common_length(string, other)
        if common == len(string) == len(other):
            same.append(member)
            return
        parent, branch, node = None, None, self.root
        while isinstance(node, list) and node[0] < common:
            parent, branch = node, string[node[0]]
            node = node[1][branch]
        leaf = (string, [member])
        byte = string[common] if common < len(string) else -1
        if isinstance(node, list) and node[0] == common:
            node[1][byte] = leaf
            return
        old = other[common] if common < len(other) else -1
        inner = [common, {old: node, byte: leaf}]
        if parent is None:
            self.root = inner
        else:
            parent[1][branch] = inner

    def ordered(self) -> Iterator[int]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                yield from node[1]


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The sorted order of ``strings``, and the common length of each with the next."""
    order: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        members, depth = stack.pop()
        if len(members) == 1:
            order.append(members[0])
        elif depth >= SHALLOW:
            order.extend(BlindTrie(strings, members).ordered())
        else:
            pivot = strings[members[len(members) // 2]][depth:depth + STEP]
            less, same, more = [], [], []
            for i in members:
                piece = strings[i][depth:depth + STEP]
                (same if piece == pivot else less if piece < pivot else more).append(i)
            if more:
                stack.append((more, depth))
            if len(pivot) < STEP:
                # All of these end here; they are equal.
                stack.extend(([i], depth) for i in reversed(same))
            else:
                stack.append((same, depth + STEP))
            if less:
                stack.append((less, depth))
    return order, [common_length(strings[a], strings[b]) for a, b in zip(order, order[1:])]


# ---- which windows of a bucket occur twice ---------------------------------------------------------------------


def pair_lengths(strings: list[bytes]) -> np.ndarray:
    """Common lengths of all pairs, from those of neighbours in sorted order; own: -1."""
    order, lengths = deep_shallow(strings)
    n = len(strings)
    out = np.full((n, n), -1)
    for i in range(n - 1):
        out[order[i], order[i + 1:]] = np.minimum.accumulate(lengths[i:])
    return np.maximum(out, out.T)


def classes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each string its place in sorted order, and the neighbours' common lengths in that order."""
    order, lengths = deep_shallow(strings)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return place, np.array(lengths, dtype=np.int64)


def window_classes(lefts: list[bytes], rights: list[bytes], offsets: range, length: int):
    """``(offset, class of each member)``: members are in one class if their windows at the offset are equal."""
    left_place, left_common = classes([x[::-1] for x in lefts])
    right_place, right_common = classes(rights)
    for offset in offsets:
        left = np.concatenate(([0], np.cumsum(left_common < offset)))[left_place]
        right = np.concatenate(([0], np.cumsum(right_common < length - offset)))[right_place]
        yield offset, left * len(lefts) + right


def repeated_offsets(members: list[tuple[int, int, bytes, bytes]], length: int) -> list[tuple[int, int] | None]:
    """Smallest and largest offset of each member's windows that another member has too.

    A member is ``(least, back, left, right)``: the bytes before and after its anchor that its windows cover.
    """
    same: dict[tuple[bytes, bytes], list[int]] = {}
    for i, (_, _, left, right) in enumerate(members):
        same.setdefault((left, right), []).append(i)
    distinct = list(same)
    n = len(distinct)
    low = np.full(n, length + 1)
    high = np.full(n, -1)
    least = np.array([members[same[d][0]][0] for d in distinct])
    back = np.array([members[same[d][0]][1] for d in distinct])
    twice = np.array([len(same[d]) > 1 for d in distinct])
    low[twice], high[twice] = least[twice], back[twice]
    lefts, rights = [d[0] for d in distinct], [d[1] for d in distinct]
    if 1 < n <= PAIRWISE:
        before = np.minimum(pair_lengths([x[::-1] for x in lefts]), back[:, None])
        after = np.maximum(length - pair_lengths(rights), least[:, None])
        found = before >= after
        low = np.minimum(low, np.where(found, after, length + 1).min(axis=1))
        high = np.maximum(high, np.where(found, before, -1).max(axis=1))
    elif n > 1:
        for offset, own in window_classes(lefts, rights, range(int(least.min()), int(back.max()) + 1), length):
            _, number, counts = np.unique(own, return_inverse=True, return_counts=True)
            found = (counts[number] > 1) & (least <= offset) & (offset <= back)
            low[found] = np.minimum(low[found], offset)
            high[found] = np.maximum(high[found], offset)
    out: list[tuple[int, int] | None] = [None] * len(members)
    for d, a, b in zip(distinct, low.tolist(), high.tolist()):
        if b >= a:
            for i in same[d]:
                out[i] = (a, b)
    return out


def distinct_slices(members: list[tuple[int, int, bytes, bytes]], length: int, gram: int):
    """``(member, low, high, core, whole)`` of one member of each content that occurs in the bucket.

    The offsets of windows are cut into slices; a member has offsets ``low`` to ``high`` of a slice. ``core`` is the
    digest of the bytes that all windows of the slice share, ``whole`` that of all bytes that the member's windows
    cover. So equal windows have equal cores, and with equal wholes all windows are equal.
    """
    def digest(left: bytes, right: bytes, *at: int) -> bytes:
        return hashlib.md5(b"%d:%d:" % at + left + right, usedforsecurity=False).digest()

    last = length - gram
    width = -(-(last + 1) // SLICES)
    for first in range(0, last + 1, width):
        end = min(first + width - 1, last)
        seen = set()
        for i, (least, back, left, right) in enumerate(members):
            low, high = max(least, first), min(back, end)
            if low > high:
                continue
            whole = digest(left[len(left) - high:], right[: length - low], low, high)
            if whole not in seen:
                seen.add(whole)
                yield i, low, high, digest(left[len(left) - first:], right[: length - end], first, end), whole


# ---- the operator ----------------------------------------------------------------------------------------------

ANCHOR = "key binary, hash bigint, place bigint, back int, least int, stop bigint"


def all_anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("hash", pa.int64()), ("place", pa.int64()),
                            ("back", pa.int32()), ("least", pa.int32()), ("stop", pa.int64())])
        for batch in batches:
            found = list(text_anchors(batch.column(1).to_pylist(), length, gram))
            if found:
                owner, *rest = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)),
                     *[pa.array(x, f.type) for x, f in zip(rest, list(schema)[1:])]], schema=schema)

    return texts.mapInArrow(find, ANCHOR)


def surroundings(candidates: DataFrame, length: int) -> DataFrame:
    """What the windows of each repeated anchor cover, before and after it."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("hash", pa.int64()), ("salts", pa.int32()), ("key", pa.binary()), ("place", pa.int64()),
                            ("least", pa.int32()), ("back", pa.int32()), ("left", pa.binary()),
                            ("right", pa.binary())])
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                rows = []
                for key, text, found in zip(*(part.column(i).to_pylist() for i in range(3))):
                    for x in found:
                        at, least, back = x["place"], x["least"], x["back"]
                        rows.append((x["hash"], x["salts"], key, at, least, back,
                                     text[at - back:at], text[at:at - least + length]))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return candidates.select("key", "text", "found").mapInArrow(
        cut, "hash bigint, salts int, key binary, place bigint, least int, back int, left binary, right binary")


def covered(dealt: DataFrame, length: int, gram: int) -> DataFrame:
    """``(key, place, low, high, core, whole)``: anchors with the smallest and largest offset of repeated windows.

    With ``core`` it is a slice of a gram dealt to more tasks instead, which waits for what the others have.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("place", pa.int64()), ("low", pa.int32()), ("high", pa.int32()),
                            ("core", pa.binary()), ("whole", pa.binary())])

        def results(bucket: list[tuple]) -> Iterator[tuple]:
            members = [row[4:8] for row in bucket]
            if len(bucket) > 1:
                for row, offsets in zip(bucket, repeated_offsets(members, length)):
                    if offsets:
                        yield row[2], row[3], *offsets, None, None
            if bucket and bucket[0][1] > 1:
                for i, *slice_ in distinct_slices(members, length, gram):
                    yield bucket[i][2], bucket[i][3], *slice_

        def found() -> Iterator[tuple]:
            held: list[tuple] = []
            for batch in batches:
                for row in zip(*(column.to_pylist() for column in batch.columns)):
                    if held and (row[0], row[8]) != (held[0][0], held[0][8]):
                        yield from results(held)
                        held = []
                    held.append(row)
            yield from results(held)

        rows = found()
        while out := list(islice(rows, ROWS_OUT)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return dealt.mapInArrow(search, "key binary, place bigint, low int, high int, core binary, whole binary")


def listed_windows(asked: DataFrame, length: int) -> DataFrame:
    """``(key, start, window)``: the digest of each window of the slices ``asked (place, low, high)`` of a text."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def windows() -> Iterator[tuple]:
            for batch in batches:
                for key, text, places in zip(*batch.columns):
                    key, text = key.as_py(), text.as_py()
                    for x in places.as_py():
                        for start in range(x["place"] - x["high"], x["place"] - x["low"] + 1):
                            yield key, start, hashlib.md5(text[start:start + length], usedforsecurity=False).digest()

        rows = windows()
        while out := list(islice(rows, ROWS_OUT)):
            key, start, window = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.binary()), pa.array(start, pa.int64()), pa.array(window, pa.binary())],
                names=["key", "start", "window"])

    return asked.select("key", "text", "asked").mapInArrow(listed, "key binary, start bigint, window binary")


def repeated_between_tasks(slices: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """``(key, start, stop)``: what slices of grams dealt to several tasks have in common.

    A core that occurs in one place only is done with. If its occurrences have one whole content, all their windows
    are repeated. What is left are slices within which contents begin to differ: their windows are compared singly.
    """
    place = F.xxhash64("key", "place")
    cores = saved(slices.groupBy("core").agg(
        F.min(place).alias("a"), F.max(place).alias("b"),
        (F.min(F.xxhash64("whole")) == F.max(F.xxhash64("whole"))).alias("alike"))
        .where("a <> b").select("core", "alike"), "cores")
    shared = saved(slices.join(cores, "core").select("key", "place", "low", "high", "alike"), "slices")
    asked = (shared.where("not alike").groupBy("key")
             .agg(F.collect_set(F.struct("place", "low", "high")).alias("asked"))
             .join(texts.select("key", "text"), "key"))
    windows = saved(listed_windows(asked, length), "windows")
    start = F.xxhash64("key", "start")
    twice = saved(windows.groupBy("window").agg(F.min(start).alias("a"), F.max(start).alias("b"))
                  .where("a <> b").select("window"), "twice")
    return stretches_of(shared.where("alike"), length).union(
        windows.join(twice, "window").select("key", "start", (F.col("start") + length).alias("stop")))


def stretches_of(offsets: DataFrame, length: int) -> DataFrame:
    """``(key, start, stop)``: the bytes that the windows ``low`` to ``high`` before a place cover."""
    return offsets.select("key", (F.col("place") - F.col("high")).alias("start"),
                          (F.col("place") - F.col("low") + length).alias("stop"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def kept_text(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for start, stop in spans:
        parts.append(text[at:start])
        at = stop
    return b"".join([*parts, text[at:]])


def repeated_spans(located: DataFrame, rid: str, doc_id: str, text: str, length: int, gram: int,
                   bucket: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is repeated in documents whose column ``rid`` identifies each; ``gram`` must be shorter than ``length``.

    Three written tables: ``rows (doc_id, rid, key, n_bytes, sha256)``, one per input row, with ``key`` the MD5 of
    the text; ``texts (key, text, copies)``, texts that may hold repeats, once each; ``spans (key, spans)``,
    stretches of them that other places of the corpus cover. A text with several copies is covered wholly if it is
    at least ``length`` long; its spans count only what other texts show.
    """
    whole = located.select(
        F.col(doc_id).alias("doc_id"), F.col(rid).alias("rid"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    rows = saved(whole.select(
        "doc_id", "rid", F.unhex(F.md5("text")).alias("key"), F.octet_length("text").cast("long").alias("n_bytes"),
        F.unhex(F.sha2("text", 256)).alias("sha256")), "texts")
    copies = saved(rows.where(F.col("n_bytes") >= length).groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.min("rid").alias("rid")), "copies")
    found = saved(all_anchors(
        whole.where(F.octet_length("text") >= length).select(F.unhex(F.md5("text")).alias("key"), "text"),
        length, gram), "anchors")
    # Two occurrences differ if their text or their place does; min and max combine before the shuffle.
    place = F.xxhash64("key", "place")
    repeated = saved(
        found.where("hash is not null").groupBy("hash")
        .agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("n"))
        .where("a <> b").select("hash", F.ceil(F.col("n") / bucket).cast("int").alias("salts")), "repeated")
    listed = saved(
        found.join(repeated, "hash").groupBy("key")
        .agg(F.collect_set(F.struct("hash", "salts", "place", "least", "back")).alias("found"))
        .join(copies, "key"), "listed")
    texts = saved(whole.select("rid", "text").join(listed, "rid").select("key", "text", "copies", "found"), "candidates")
    dealt = (surroundings(texts, length)
             .withColumn("salt", F.pmod(F.xxhash64("key", "place"), F.col("salts")))
             .repartition("hash", "salt").sortWithinPartitions("hash", "salt"))
    seen = saved(covered(dealt, length, gram), "covered")
    stretches = stretches_of(seen.where("core is null"), length).union(
        found.where("hash is null").select("key", F.col("place").alias("start"), "stop"))
    if repeated.where("salts > 1").limit(1).count():
        stretches = stretches.union(repeated_between_tasks(seen.where("core is not null"), texts, length))
    spans = saved(stretches.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")
    return rows, texts, spans


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
             gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, rid, n_bytes, spans, kept_sha256)``: what to remove from each row of ``docs``.

    Every byte that a repeated string of ``length`` bytes covers goes; what is repeated is judged on the texts as
    they are given, and matches do not cross texts. ``spans`` are the maximal runs of removed bytes, in order, and
    ``kept_sha256`` is the digest of the other bytes, in order. Null texts are empty; texts shorter than ``length``
    stay as they are. Ids are only carried, so they may be null or repeated; an empty table gives no rows; other
    columns are not read.
    """
    return _removals(*with_row_id(docs), doc_id, text, length, gram, bucket)


def _removals(located: DataFrame, rid: str, doc_id: str, text: str, length: int, gram: int, bucket: int) -> DataFrame:
    rows, texts, spans = repeated_spans(located, rid, doc_id, text, length, gram, bucket)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            stretches = [merged([(s["start"], s["stop"]) for s in found]) for found in batch.column(2).to_pylist()]
            digests = [hashlib.sha256(kept_text(value, found)).digest()
                       for value, found in zip(batch.column(1).to_pylist(), stretches)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0),
                 pa.array([[{"start": a, "stop": b} for a, b in found] for found in stretches], kind),
                 pa.array(digests, pa.binary())], names=["key", "spans", "kept"])

    kind = "array<struct<start:bigint,stop:bigint>>"
    partly = (texts.where("copies = 1").select("key", "text").join(spans, "key")
              .mapInArrow(remove, f"key binary, spans {kind}, kept binary").withColumn("copies", F.lit(1)))
    # A text with copies is repeated from its first byte to its last.
    wholly = (rows.where(F.col("n_bytes") >= length).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
              .where("n > 1").select("key", F.lit(None).cast(kind).alias("spans"),
                                     F.unhex(F.sha2(F.lit(b""), 256)).alias("kept"), F.lit(2).alias("copies")))
    decided = saved(partly.union(wholly), "removals")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    return rows.join(decided, "key", "left").select(
        "doc_id", "rid", "n_bytes",
        F.when(F.col("copies").isNull(), F.array().cast(kind)).when(F.col("copies") > 1, everything)
        .otherwise(F.col("spans")).alias("spans"),
        F.lower(F.hex(F.coalesce("kept", "sha256"))).alias("kept_sha256"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                    gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``, which becomes binary: a cut may fall inside a character.

    Other columns stay as they are; see ``removals``.
    """
    located, rid = with_row_id(docs)

    @F.arrow_udf("binary")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([kept_text(t or b"", [(s["start"], s["stop"]) for s in found])
                         for t, found in zip(texts.to_pylist(), spans.to_pylist())], pa.binary())

    name = free_name(located, "_spans")
    found = _removals(located, rid, doc_id, text, length, gram, bucket).select(
        F.col("rid").alias(rid), F.col("spans").alias(name))
    return (located.join(found, rid).withColumn(text, cut(F.col(text).cast("binary"), F.col(name)))
            .select(*[quoted(c) for c in docs.columns]))
