"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A document is contaminated by an item if some part of it lies within ``floor(rate * m)`` edits of the whole item of m
characters. Both sides are normalised first: letters A-Z and their Latin-1 kin in lower case, runs of white space as
one space. By the q-gram lemma such a part shares at least ``m - q + 1 - k * q`` q-grams with the item, all within
2k + 1 neighbouring diagonals. Hits are counted in bands of twice that width which overlap by half, so one band
holds them all; bands that reach the bound are aligned in the band, all at once in numpy.

The documents are read in one pass without a shuffle. The benchmark's q-grams travel with the tasks; that side is
measured first, and beyond ``slice_chars`` it is cut into slices, each with a pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.textual import mix, text_batches, trim

Q = 8  # leaves the lemma a bound of one q-gram at least for every item that is looked for, at the budget of RATE
RATE = 0.08
SHORTEST = 24  # characters; a shorter item is no evidence of anything and matches nothing
SLICE_CHARS = 8 << 20
CELLS = 1 << 20  # of the bands aligned together
_END = 0x110000  # after each text; equal to no character
_BASE = 0x9E3779B97F4A7C15
_SCALE = 1 << 32  # an alignment state is edits * 2**32 + begin
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32, 133, 160]] = True


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points after normalisation, and the place of each in the text."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    upper = ((c >= 65) & (c <= 90)) | ((c >= 0xC0) & (c <= 0xDE) & (c != 0xD7))
    c = np.where(upper, c + 32, c)
    white = _WHITE[np.minimum(c, 255)] & (c < 256)
    c = np.where(white, 32, c)
    keep = ~white
    keep[1:] |= white[1:] & ~white[:-1]
    keep[:1] = ~white[:1]
    at = np.flatnonzero(keep)
    return c[at].astype(np.uint32), at


def gram_codes(c: np.ndarray) -> np.ndarray:
    """Hash of every string of Q = 8 characters."""
    n = len(c) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = mix(c.astype(np.uint64) + np.uint64(1))
    for w in (1, 2, 4):
        h = h[:-w] * np.uint64(pow(_BASE, w, 1 << 64)) + h[w:]
    return mix(h)


class Items:
    """The normalised items, their budgets and the lists of their q-grams."""

    def __init__(self, ids: list[int], texts: list[str], rate: float = RATE):
        self.ids, self.codes = [], []
        for i, t in zip(ids, texts, strict=True):
            c, _ = normalised((t or "").strip())
            while len(c) and c[-1] == 32:
                c = c[:-1]
            if len(c) >= SHORTEST:
                self.ids.append(i)
                self.codes.append(c)
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.budget = (self.size * rate).astype(np.int64)
        if (self.size - Q + 1 - self.budget * Q < 1).any():
            raise ValueError(f"a rate of {rate} leaves some items no q-gram of {Q} characters to be found by")
        self.bound = self.size - Q + 1 - self.budget * Q
        self.step = 2 * self.budget + 1
        grams = [gram_codes(c) for c in self.codes]
        g = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(x) for x in grams])
        place = np.concatenate([np.arange(len(x)) for x in grams]) if grams else item
        order = np.argsort(g, kind="stable")
        self.gram, self.item, self.place = g[order], item[order], place[order]
        self.seen = np.zeros(1 << 22, bool)  # by the low bits of a gram, so that most are refused at once
        self.seen[(self.gram & np.uint64(0x3FFFFF)).astype(np.int64)] = True
        self.flat = np.concatenate([*self.codes, np.zeros(0, np.uint32)])
        self.offset = np.cumsum(self.size) - self.size

    def hits(self, text: np.ndarray, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, item, place in the item) of every shared q-gram."""
        out = []
        for begin in range(0, len(text), piece):
            codes = gram_codes(text[begin : begin + piece + Q - 1])
            at = np.flatnonzero(self.seen[(codes & np.uint64(0x3FFFFF)).astype(np.int64)])
            g = codes[at]
            low, high = np.searchsorted(self.gram, g), np.searchsorted(self.gram, g, side="right")
            n = high - low
            some = n > 0
            at, low, n = at[some], low[some], n[some]
            entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((np.repeat(at + begin, n), self.item[entry], self.place[entry]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def align(self, text: np.ndarray, item: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edits, begin, end) of the best part of text[left:right] for each item in the band of diagonals from ``first``."""
        budget, rows = self.budget[item], self.size[item]
        width = int((2 * self.step[item] + 2 * budget).max())
        start = first - budget
        cells = start[:, None] + np.arange(width)
        usable = np.arange(width) < (2 * self.step[item] + 2 * budget)[:, None]
        big = np.int64(1) << 52
        state = np.where(usable & (cells >= left[:, None]) & (cells <= right[:, None]), cells, big)
        ramp = np.arange(width) * _SCALE
        final = np.full(len(item), big)
        where = np.zeros(len(item), np.int64)
        for j in range(int(rows.max())):
            i = cells + j
            inside = usable & (i >= left[:, None]) & (i < right[:, None])
            same = inside & (text[np.clip(i, 0, len(text) - 1)] == self.flat[self.offset[item] + np.minimum(j, rows - 1)][:, None])
            # From the same diagonal: match or replace. From the next: the item's character is missing in the text.
            step = np.where(inside, state + np.where(same, 0, _SCALE), big)
            skip = np.full_like(state, big)
            skip[:, :-1] = state[:, 1:] + _SCALE
            step = np.minimum(step, np.where(i + 1 >= left[:, None], skip, big))
            # Within the row: extra characters of the text.
            step = np.minimum.accumulate(step - ramp, axis=1) + ramp
            state = np.where(usable & (i < right[:, None]) & (i + 1 >= left[:, None]), step, big)
            last = np.flatnonzero(rows == j + 1)
            if len(last):
                best = state[last].argmin(axis=1)
                final[last] = state[last, best]
                where[last] = i[last, best] + 1
        return final // _SCALE, final % _SCALE, where

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, begin, end, edits) of all contaminated parts, begin and end in the text's own characters."""
        parts, places, starts, at = [], [], [], 0
        for t in texts:
            c, p = normalised(t)
            parts += [c, np.array([_END], np.uint32)]
            places.append(p)
            starts.append(at)
            at += len(c) + 1
        if not parts or not len(self.size):
            return []
        text, edges = np.concatenate(parts), np.array([*starts, at], np.int64)
        i, item, j = self.hits(text)
        if not len(i):
            return []
        doc = np.searchsorted(edges, i, side="right") - 1
        band = (i - j) // self.step[item]
        low = int(band.min()) - 1
        bands = int(band.max()) - low + 1
        key = (item * len(texts) + doc) * bands
        both = np.concatenate([key + band - low, key + band - 1 - low])
        names, count = np.unique(both, return_counts=True)
        who = names // bands // len(texts)
        names = names[count >= self.bound[who]]
        who, doc, band = names // bands // len(texts), names // bands % len(texts), names % bands + low
        best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        # Items of like length are aligned together, as many as CELLS allow.
        order = np.argsort(self.size[who], kind="stable")
        who, doc, band = who[order], doc[order], band[order]
        begin = 0
        while begin < len(who):
            width = 2 * self.step[who[begin:]] + 2 * self.budget[who[begin:]]
            fit = int(np.searchsorted(width * np.arange(1, len(width) + 1), CELLS, side="right"))
            w, d, b = (x[begin : begin + min(256, max(1, fit))] for x in (who, doc, band))
            begin += len(w)
            edits, a, e = self.align(text, w, b * self.step[w], edges[d], edges[d + 1] - 1)
            for k in np.flatnonzero((edits <= self.budget[w]) & (e > a)):
                best.setdefault((int(d[k]), int(w[k])), []).append((int(edits[k]), int(a[k]), int(e[k])))
        out = []
        for (d, w), found in sorted(best.items()):
            taken: list[tuple[int, int, int]] = []
            for edits, a, e in sorted(found):  # the best of those that overlap
                if all(e <= x or a >= y for _, x, y in taken):
                    taken.append((edits, a, e))
            for edits, a, e in sorted(taken, key=lambda x: x[1]):
                own = places[d]
                out.append((d, w, int(own[a - edges[d]]), int(own[e - 1 - edges[d]]) + 1, edits))
        return out


def sliced(benchmark: DataFrame, limit: int) -> Iterator[Items]:
    """The benchmark as slices of about ``limit`` characters, usually one."""
    known = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = -(-total // limit)
    for s in range(slices):
        rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == s).orderBy("item_id", "text").collect()
        yield Items([r[0] for r in rows], [r[1] for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """doc_id, item_id, begin, end, edits: one row per part of a row of ``docs`` that an item matches.

    begin and end count the characters of the text; overlapping parts for one item give the best alone, the first of
    equal ones. Rows with a null text, empty texts, null item ids or texts, and items of fewer than 24 characters
    match nothing. Repeated rows and items repeat their matches once per row and distinct (item_id, text); a null
    doc_id stays null. Other columns are ignored; empty tables give no rows.
    """
    kind = "doc_id long, item_id long, begin long, end long, edits int"

    def searched(items: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in text_batches(batches, limit=1 << 20):
                found = items.matches([t.decode() for t in texts])
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], items.ids[w], a, e, x) for d, w, a, e, x in found]
                columns = zip(*rows, strict=True) if rows else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "begin", "end", "edits"])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)

    out = None
    for items in sliced(benchmark, slice_chars):
        out = searched(items) if out is None else out.unionByName(searched(items))
    return out if out is not None else docs.sparkSession.createDataFrame([], kind)


def keep_clean(docs: DataFrame, benchmark: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, that no item contaminates. Rows with a null text stay."""
    def test(items: Items) -> Column:
        def clean(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for column in columns:
                texts = [t if isinstance(t, str) else "" for t in column]
                dirty, begin, size = set(), 0, 0
                for i in range(len(texts) + 1):
                    if i == len(texts) or (size and size + len(texts[i]) > 1 << 20):
                        dirty.update(begin + m[0] for m in items.matches(texts[begin:i]))
                        begin, size = i, 0
                    if i < len(texts):
                        size += len(texts[i])
                yield pd.Series([i not in dirty for i in range(len(texts))], dtype=bool)
            trim()

        return F.pandas_udf(clean, "boolean")(F.col("text"))

    for items in sliced(benchmark, slice_chars):
        docs = docs.where(test(items))
    return docs
