"""Helpers that the text operators share: words, hashes and batches of rows inside a task."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # text handled by numpy at a time; its arrays take some 60 times as much
BLOCK = 4  # such chunks make a block of rows, for the exchanges of packed arrays

_rng = np.random.default_rng(20240917)
# One random number per (byte, place in the word modulo 64): a word's hash is the sum over its bytes.
_ZOBRIST = _rng.integers(0, 1 << 64, 64 * 256, dtype=np.uint64)
_GRAM = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True  # the separators \x20 and \x09-\x0D


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def trim() -> None:
    """Give freed memory back to the system. A Python worker lives on between tasks, and several of them share an
    executor's memory while only some are at work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such call in this C library
        pass


def encoded(texts: Iterable[str | None]) -> list[bytes]:
    """UTF-8 bytes; null is the empty text. Lone surrogates, which Spark can't hold, become question marks."""
    return [b"" if t is None else t.encode("utf-8", "replace") for t in texts]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+``, and the offset of each text's first word (one more at the end)."""
    hashes, offsets, _, _ = word_places(texts)
    return hashes, offsets


def word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes``, and where each word starts and ends in the texts joined by one byte."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends_at = np.cumsum([0] + [len(t) + 1 for t in texts])
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), *(np.zeros(0, np.int64),) * 2
    inside = ~_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.append(0, edges)
    starts, ends = edges[::2].copy(), edges[1::2].copy()  # the last byte is a separator
    offsets = np.searchsorted(starts, ends_at)
    if not len(starts):
        return np.zeros(0, np.uint64), offsets, starts, starts
    # Byte by byte, over all words that are long enough: the longest come first.
    size = ends - starts
    order = np.argsort(64 - np.minimum(size, 65).astype(np.int8), kind="stable")
    longer = len(size) - np.cumsum(np.bincount(np.minimum(size, 65), minlength=66))  # words of more than k bytes
    at, value = starts[order], np.zeros(len(starts), np.uint64)
    for k in range(64):
        n = int(longer[k])
        if not n:
            break
        value[:n] += _ZOBRIST[k << 8 : (k + 1) << 8].take(data.take(at[:n]))
        at[:n] += 1
    if n := int(longer[64]):
        more = size[order[:n]] - 64
        first = np.cumsum(more) - more
        place = np.arange(64, 64 + more.sum()) - np.repeat(first, more)
        byte = data[np.repeat(starts[order[:n]], more) + place]
        rest = _ZOBRIST[(place & 63) << 8 | byte]
        rest *= (place >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        value[:n] += np.add.reduceat(rest, first)
    hashes = np.empty_like(value)
    hashes[order] = value
    return mix(hashes), offsets, starts, ends


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words (at most 64), without regard to text borders."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(size), np.uint64)
    for k in range(size):
        total += words[k : k + n] * _GRAM[k]
    return mix(total)


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text with A-Z lower-cased; fewer words than ``size`` make one shingle."""
    words, offsets = word_hashes([t.lower() for t in texts])
    grams = gram_hashes(words, size)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(gram_hashes(words[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def text_batches(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches that hold about ``limit`` bytes of text each, with the texts as bytes.

    A single longer text is a slice of its own; no text is cut. Memory is trimmed before the first and after the last.
    """
    trim()
    for whole in batches:
        column = whole.schema.get_field_index(text)
        # Few rows at a time become Python objects, however many Arrow brings.
        for row in range(0, whole.num_rows, 1024):
            batch = whole.slice(row, 1024)
            texts = encoded(batch.column(column).to_pylist())
            begin, size = 0, 0
            for i, t in enumerate(texts):
                if size and size + len(t) > limit:
                    yield batch.slice(begin, i - begin), texts[begin:i]
                    begin, size = i, 0
                size += len(t)
            if begin < len(texts):
                yield batch.slice(begin), texts[begin:]
        del whole
    trim()


def by_partition(part: np.ndarray, parts: int, *columns: np.ndarray) -> Iterator[tuple]:
    """(partition, bytes of each column's values that go there), for every partition that gets some.

    Arrays travel as one binary value per batch and partition, so the shuffle moves few rows.
    """
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if cuts[p] < cuts[p + 1]:
            at = order[cuts[p] : cuts[p + 1]]
            yield (p, *(c[at].tobytes() for c in columns))


def joined(values: Iterable[bytes], dtype) -> np.ndarray:
    """The array whose pieces travelled as binary values."""
    return np.frombuffer(b"".join(values), dtype)


def partitions(df) -> int:
    """Partitions for an exchange of packed arrays: the session's own number, which the cluster sets for its data."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
