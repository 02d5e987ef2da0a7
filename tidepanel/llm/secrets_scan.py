"""Secrets in texts: keywords first, anchored patterns near their hits, checksums last.

One Aho-Corasick pass over the lower-cased text finds every keyword; a kind's pattern is tried only where its
keyword stands. Runs of hex digits have no keyword: a run of 32 covers four neighbouring positions of every eighth,
so the pattern is tried only where four such probes in a row are hex digits. Tokens that embed a checksum are
reported only if it fits.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "checked")
BASE = KINDS[:3]
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "checked": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
}
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
PROBES = re.compile(r"[0-9a-f]{4,}")
#: Prefix, 30 random characters, six base-62 digits of their CRC-32.
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LEAST = {"assign": 8, "access": 16, "hex": 32}
STEP = 8


def base62(number: int, width: int = 6) -> str:
    out = ""
    while number:
        number, digit = divmod(number, 62)
        out = DIGITS[digit] + out
    return out.rjust(width, DIGITS[0])


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def hex_spans(text: str) -> list[tuple[int, int]]:
    spans = []
    for probe in PROBES.finditer(text[STEP - 1::STEP]):
        low, high = STEP * probe.start(), min(len(text), STEP * (probe.end() + 1) - 1)
        for run in HEX.finditer(text, low, high):
            if run.end() - run.start() >= LEAST["hex"]:
                spans.append(run.span())
    return spans


def scan(text: str | None, keywords: ahocorasick.Automaton) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` by start, then kind as listed. A match that is too short still uses up its text."""
    if not text:
        return []
    # The one character whose lower case has another length would shift all later positions.
    lowered = text.replace("İ", ".").lower()
    spans = [(start, "hex", end) for start, end in hex_spans(text)]
    used = dict.fromkeys(KEYWORDS, 0)
    for last, (kind, length) in keywords.iter(lowered):
        start = last + 1 - length
        if start < used[kind]:
            continue
        if kind == "assign":
            match = ASSIGN.match(text, start)
            good = match and len(match[2]) >= LEAST[kind]
        elif kind == "access":
            match = ACCESS.match(text, start)
            good = match and match.end() - start >= LEAST[kind]
        else:
            match = CHECKED.match(text, start)
            good = match and base62(zlib.crc32(match[1].encode())) == match[2]
        if match:
            used[kind] = match.end()
        if good:
            spans.append((start, kind, match.end()))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, spans)``: all secrets of every whole text, as an array of structs of kind, start and end.

    Positions are code points, the end is exclusive. Null and empty texts have no spans; every input row gives one
    row, repeated rows too, whatever its id; an empty table gives none; other columns are not read. Nothing is
    shuffled, and a task holds one Arrow batch.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, k, e in scan(t.as_py(), keywords)]
                     for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(find, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(spans):
    """The spans of an array column as one string."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sha256_text(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()
