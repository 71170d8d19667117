"""Quality classifier: a byte-level convolutional network in numpy.

Every text is covered by overlapping chunks of 512 bytes. Learned filters of 8 bytes slide over each chunk in steps
of 4; their responses are max-pooled per chunk, a linear layer turns the pooled responses into the chunk's log-odds,
and the mean over all chunks gives the document's probability.

The network is fitted on a bounded sample of labelled rows (``sample`` documents of at most ``sample_bytes`` bytes,
chosen by a hash of doc_id); scoring reads every whole text, inside Arrow batches, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.textual import encoded, text_batches, trim

CHUNK, STEP, BLOCK = 512, 448, 4  # bytes of a chunk, between chunks, between filter positions
PAD = 256
EMBED, FILTERS = 4, 32


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all chunks as (chunks, 512) symbols, padded; and each text's number of chunks (1 at least)."""
    counts = np.array([1 + max(0, -(-(len(t) - CHUNK) // STEP)) for t in texts], np.int64)
    need = (counts - 1) * STEP + CHUNK
    ends = np.cumsum(need)
    flat = np.full(int(ends[-1]) if len(texts) else 0, PAD, np.uint16)
    for t, end, n in zip(texts, ends, need, strict=True):
        flat[end - n : end - n + len(t)] = np.frombuffer(t, np.uint8)
    first = np.repeat(ends - need, counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * STEP
    return flat[first[:, None] + np.arange(CHUNK)], counts


class ConvNet:
    """Embedding, one layer of filters, max-pooling and a linear layer; float32 throughout."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        width = BLOCK * EMBED
        self.embed = rng.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        self.filters = rng.normal(0, 1 / np.sqrt(2 * width), (2 * width, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.shift]

    def pooled(self, symbols: np.ndarray, where: bool = False):
        """Largest response of each filter per chunk; with ``where`` also the blocks and the winning positions."""
        width = BLOCK * EMBED
        blocks = self.embed[symbols].reshape(len(symbols), CHUNK // BLOCK, width)
        response = blocks[:, :-1] @ self.filters[:width]
        response += blocks[:, 1:] @ self.filters[width:]
        if not where:
            return response.max(axis=1)
        at = response.argmax(axis=1)
        return np.take_along_axis(response, at[:, None], 1)[:, 0], blocks, at

    def chunk_odds(self, symbols: np.ndarray, step: int = 1024) -> np.ndarray:
        parts = [np.maximum(self.pooled(symbols[i : i + step]) + self.bias, 0) @ self.out for i in range(0, len(symbols), step)]
        return np.concatenate(parts) + self.shift[0] if parts else np.zeros(0, np.float32)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each whole text. A very long text is scored in pieces of whole chunks."""
        out = np.empty(len(texts))
        sums, counts = np.zeros(len(texts)), np.ones(len(texts))
        group, size = [], 0
        for i, t in enumerate([*texts, None]):
            if group and (t is None or size + len(t) > 1 << 20):
                symbols, n = chunks([texts[j] for j in group])
                odds = self.chunk_odds(symbols)
                sums[group] = np.add.reduceat(odds.astype(np.float64), np.cumsum(n) - n)
                counts[group] = n
                group, size = [], 0
            if t is None:
                break
            if len(t) > 1 << 20:
                span = 2048 * STEP
                whole = 0
                for begin in range(0, max(1, len(t) - (CHUNK - STEP)), span):
                    symbols, n = chunks([t[begin : begin + span + CHUNK - STEP]])
                    sums[i] += self.chunk_odds(symbols).astype(np.float64).sum()
                    whole += int(n[0])
                counts[i] = whole
            else:
                group.append(i)
                size += len(t)
        out[:] = 1 / (1 + np.exp(-np.clip(sums / counts, -40, 40)))
        return out

    def gradients(self, symbols: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean log loss of the documents and its gradient by every parameter."""
        width = BLOCK * EMBED
        best, blocks, at = self.pooled(symbols, True)
        hidden = np.maximum(best + self.bias, 0)
        odds = hidden @ self.out + self.shift[0]
        begin = np.cumsum(counts) - counts
        doc = np.clip(np.add.reduceat(odds, begin) / counts, -30, 30)
        p = 1 / (1 + np.exp(-doc))
        loss = float(-(labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9)).mean())
        d_odds = np.repeat(((p - labels) / len(labels) / counts).astype(np.float32), counts)
        d_best = d_odds[:, None] * self.out * (best + self.bias > 0)
        rows = np.arange(len(symbols))[:, None]
        left, right = blocks[rows, at], blocks[rows, at + 1]
        d_filters = np.concatenate([np.einsum("cf,cfw->wf", d_best, left), np.einsum("cf,cfw->wf", d_best, right)])
        d_embed = np.zeros_like(self.embed)
        place = at[..., None] * BLOCK + np.arange(2 * BLOCK)
        byte = symbols[rows[..., None], place]
        pull = d_best[..., None] * self.filters.T[None]
        for e in range(EMBED):
            d_embed[:, e] = np.bincount(byte.ravel(), pull[:, :, e::EMBED].ravel(), 257)
        return loss, [d_embed, d_filters, d_best.sum(0), hidden.T @ d_odds, np.array([d_odds.sum()], np.float32)]


def fit(texts: list[bytes], labels: np.ndarray, steps: int = 600, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ConvNet:
    """Adam on batches of whole documents. With labels of one kind only, the net learns that kind's share alone."""
    net = ConvNet(seed)
    if not len(texts):
        return net
    rng = np.random.default_rng(seed)
    params = net.params()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = rng.choice(len(texts), min(batch, len(texts)), replace=False)
        symbols, counts = chunks([texts[i] for i in pick])
        _, grads = net.gradients(symbols, counts, labels[pick])
        speed = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, m, v, g in zip(params, first, second, grads, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, sample_bytes: int = 16384, folds: int = 5, held_out: int = 0) -> ConvNet:
    """Fit on labelled rows outside the held-out fold: crc32(doc_id as text) mod ``folds`` is not ``held_out``.

    Bounds: at most ``sample`` documents, each of at most ``sample_bytes`` bytes and taken whole, reach the driver
    (64 MB at most by default). Repeated doc_ids of the labels count once; null labels, ids and texts are left out.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    marked = (
        labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("_label"))
        .where("doc_id is not null and _label in (0, 1)")
        .where(fold != held_out)
        .groupBy("doc_id")
        .agg(F.min("_label").alias("_label"))
    )
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    short = docs.where("text is not null").where(F.octet_length("text") <= sample_bytes).select("doc_id", "text")
    # At most ``sample`` ids are sent to the tasks, and their texts come back: no text is shuffled.
    texts = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_label").alias("_label"))
    rows = sorted(texts.collect())  # bounded by sample * sample_bytes
    return fit(encoded(r[1] for r in rows), np.array([r[2] for r in rows], np.float32))


def score(docs: DataFrame, net: ConvNet, folds: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    A null text is the empty text and gets a score as well; null doc_ids give a null held_out. Rows repeat as they
    do in the input, and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.score(texts), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == held_out).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold. One pass over the texts, no join. A null
    text is scored as the empty text.

    The score is computed beside the row in an Arrow function, so rows with equal ids need no key.
    """
    net = train(docs, labels, **options)

    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(net.score(encoded(t if isinstance(t, str) else None for t in texts)))
        trim()

    return docs.where(F.pandas_udf(probability, "double")(F.col("text")) >= threshold)
