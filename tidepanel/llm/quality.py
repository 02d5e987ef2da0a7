"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A token is a run of word characters or a run of other visible characters, letters A to Z in lower case. Tokens and
pairs of neighbouring tokens are hashed into ``2**BITS`` slots, and a text's features are their relative
frequencies; pairs of equal tokens also share one slot, whatever the token. Training reads a bounded sample of labelled rows, one row at a time; scoring is a sparse dot product
per text, for whole batches at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import free_name, mixed, prefix_hashes, range_hashes

BITS = 18
#: Labelled rows that the model is fitted on, at most: those whose ids have the smallest hashes.
MAX_ROWS = 16_000
PASSES = 1
ALPHA, BETA, L1, L2 = 3.0, 1.0, 1e-4, 1e-4
#: Relative frequencies are scaled by this, so that weights stay in a moderate range.
SCALE = 20.0
#: Bytes of text whose features are computed at a time.
BLOCK_BYTES = 1 << 20

DOUBLED = np.uint64(0x5851F42D4C957F2D)
#: Classes of bytes: 0 blank, 1 word (letters, digits, underscore, all of other scripts), 2 other visible.
CLASSES = np.full(256, 2, dtype=np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] = 0
CLASSES[[*b"abcdefghijklmnopqrstuvwxyz0123456789_", *b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
CLASSES[128:] = 1


def token_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the tokens of lower-cased UTF-8 bytes."""
    kinds = CLASSES[data]
    edges = np.flatnonzero(np.diff(kinds)) + 1
    starts = np.concatenate(([0], edges))
    ends = np.concatenate((edges, [len(data)]))
    visible = kinds[starts] > 0 if len(data) else np.zeros(len(starts), dtype=bool)
    starts, ends = starts[visible], ends[visible]
    return range_hashes(prefix_hashes(data), starts, ends), starts


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """``(row, slot)`` of every token and every pair of neighbouring tokens; rows number the texts."""
    buffer = b"\n".join(texts).lower()
    bounds = np.cumsum([len(t) + 1 for t in texts])
    hashes, starts = token_hashes(np.frombuffer(buffer, dtype=np.uint8))
    rows = np.searchsorted(bounds, starts, side="right")
    together = rows[1:] == rows[:-1]
    pairs = mixed(hashes[:-1] * np.uint64(3) + hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F))[together]
    doubled = rows[1:][together & (hashes[1:] == hashes[:-1])]
    shift = np.uint64(64 - bits)
    return (np.concatenate((rows, rows[1:][together], doubled)),
            np.concatenate((hashes >> shift, pairs >> shift, np.full(len(doubled), DOUBLED) >> shift))
            .astype(np.int64))


def blocks(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    """The texts, in order, in lists of about ``BLOCK_BYTES``."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text or b"")
        size += len(held[-1])
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def margins(texts: list[bytes | None], weights: np.ndarray, bias: float) -> np.ndarray:
    """The log-odds of each text."""
    out = []
    bits = len(weights).bit_length() - 1
    for block in blocks(texts):
        rows, slots = features(block, bits)
        counts = np.bincount(rows, minlength=len(block))
        sums = np.bincount(rows, weights=weights[slots], minlength=len(block))
        out.append(bias + SCALE * sums / np.maximum(counts, 1))
    return np.concatenate(out) if out else np.zeros(0)


class Ftrl:
    """FTRL-Proximal with per-coordinate rates; the bias is a feature of its own without penalty."""

    def __init__(self, bits: int = BITS) -> None:
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    @property
    def bias(self) -> float:
        return -self.bias_z / ((BETA + self.bias_n ** 0.5) / ALPHA)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: float) -> None:
        """One update; ``slots`` are distinct."""
        weights, bias = self.weights(slots), self.bias
        gradient = 1 / (1 + np.exp(-np.clip(weights @ values + bias, -35, 35))) - label
        g = gradient * values
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * weights
        self.n[slots] = n + g * g
        step = ((self.bias_n + gradient ** 2) ** 0.5 - self.bias_n ** 0.5) / ALPHA
        self.bias_z += gradient - step * bias
        self.bias_n += gradient ** 2


def held_out(doc_id):
    """Rows that no label may be learned from: CRC-32 of the id as text, modulo 3, is 1; a null id: not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_rows: int) -> DataFrame:
    """``(order, text, label)``: at most ``max_rows`` labelled rows that are not held out.

    A document labelled more than once has the rounded mean; null labels, ids and texts are left out. The labels are
    cut to the bound first, so the documents are only scanned: the joined side is small by that bound.
    """
    order = F.xxhash64("id", F.lit(1))
    known = (labels.select(F.col(doc_id).alias("id"), F.col(label).alias("label"))
             .where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
             .groupBy("id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
             .orderBy(order, "id").limit(max_rows))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null")
    # The bound holds for rows too, should ids be repeated.
    return (texts.join(F.broadcast(known), "id")
            .select(order.alias("order"), F.xxhash64("text").alias("tie"), "text", "label")
            .orderBy("order", "tie").limit(max_rows).select("order", "text", "label"))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "quality", max_rows: int = MAX_ROWS, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights and bias; their size is fixed by ``bits``. No labelled rows: all zero, so every score is 0.5."""
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, np.ndarray, float]] = []
        for batch in batches:
            for value, label in zip(batch.column(1), batch.column(2)):
                _, slots = features([value.as_py().encode("utf-8", "surrogatepass")], bits)
                if len(slots):
                    own, counts = np.unique(slots, return_counts=True)
                    rows.append((own.astype(np.int32), (SCALE * counts / len(slots)).astype(np.float32),
                                 label.as_py()))
        model = Ftrl(bits)
        for _ in range(PASSES):
            for own, values, label in rows:
                model.learn(own, values.astype(np.float64), label)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights().astype(np.float32).tobytes()]), pa.array([model.bias])],
            names=["weights", "bias"])

    ordered = training_rows(docs, labels, doc_id, text, label, max_rows)
    row = ordered.coalesce(1).sortWithinPartitions("order").mapInArrow(
        fit, "weights binary, bias double").collect()
    if not row:
        return np.zeros(1 << bits), 0.0
    return np.frombuffer(row[0]["weights"], dtype=np.float32).astype(np.float64), row[0]["bias"]


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1; only the text is read for it.

    Null and empty texts have no features: their score is that of the bias. Rows keep all columns; nothing is
    shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, bias = shared.value
        for batch in batches:
            values = margins(batch.cast(pa.binary()).to_pylist(), weights, bias)
            yield pa.array(1 / (1 + np.exp(-np.clip(values, -500, 500))))

    return docs.withColumn(score, probability(F.col(text)))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``; columns stay as they are."""
    name = free_name(docs, "_score")
    return scored(docs, train(docs, labels, **options), score=name).where(F.col(name) >= threshold).drop(name)
