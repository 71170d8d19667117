"""Repeated word windows by level-wise doubling.

Every word covered by a window of ``length`` words (35) that also starts anywhere else in the table is removed. Level
lengths double up to it: 9, 18, 35. A window can only be repeated if every shorter window inside it is, so each level
looks at survivors of the one before alone.

* First level: in each window the run of 9 words with the smallest hash stands for it (about one position in 14 is
  chosen, the same in equal windows). The words under all windows of a run are its context. Runs that occur once take
  their windows out at once; that is most of the text. Where whole contexts occur twice or more, every window in them
  is repeated and nothing is left to ask. The other runs that occur again go on, one copy of each context.
* Second level: their runs are extended to 18 words inside the windows that they stand for; windows whose extension
  occurs once go.
* Last level: the survivors are extended to the whole window. Those that occur twice or more are removed.

Each level counts packed hashes per block of text, so a passage of a third of all rows costs one entry per block, and
the counts return to the blocks; no text, pair or group is collected anywhere. Word hashes have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.exchange import frequencies
from papyrine.llm.suffix_dedup import OWNER, keyed, merged, told, verdicts
from papyrine.llm.textual import BLOCK, encoded, gram_hashes, joined, mix, text_batches, word_hashes
from papyrine.session import materialise

FIRST = 9
WINDOW = np.dtype([("hash", "<u8"), ("at", "<u4")])
_BASE, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def owned_runs(words: np.ndarray, length: int, size: int) -> np.ndarray:
    """The chosen run of ``size`` words of every window of one text: its hash, the hash of its context, its first
    window, the words before it there, and the number of windows."""
    windows = len(words) - length + 1
    if windows <= 0:
        return np.zeros(0, OWNER)
    grams = gram_hashes(words, size)
    span = length - size + 1
    out = []
    for begin in range(0, windows, 1 << 20):
        g = grams[begin : begin + (1 << 20) + span - 1]
        # 40 bits of hash, then the position: the left one of equal runs is chosen.
        low = (g & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(g), dtype=np.uint64)
        w = 1
        while 2 * w <= span:
            low = np.minimum(low[:-w], low[w:])
            w *= 2
        n = len(g) - span + 1
        chosen = (np.minimum(low[:n], low[span - w :][:n]) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        r = np.zeros(len(first), OWNER)
        r["gram"], r["start"] = g[chosen[first]], first + begin
        r["offset"], r["windows"] = chosen[first] - first, np.diff(np.append(first, n))
        # The context's hash from sums of word hashes times powers, shifted to the context's start.
        piece = words[begin : begin + n + length - 1]
        sums = np.append(np.uint64(0), np.cumsum(piece * powers(_BASE, len(piece))[:-1]))
        whole = (sums[first + r["windows"] + length - 1] - sums[first]) * powers(_BACK, len(piece))[first]
        r["context"] = mix(whole + r["windows"].astype(np.uint64) * np.uint64(1 << 32) + r["offset"])
        out.append(r)
    return np.concatenate(out)


def extension(first: np.ndarray, at: np.ndarray, length: int, small: int, large: int) -> np.ndarray:
    """Start of the ``large`` words around the run at ``at`` that lie inside the window starting at ``first``."""
    wanted = at - (large - small) // 2
    return np.clip(wanted, first, first + length - large)


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """True where a value is in the sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def sift(table: DataFrame, decide: Callable[[tuple, np.ndarray], bytes]) -> DataFrame:
    """(b, k1, k2, kept): what ``decide(row, repeated)`` keeps of each row (b, k1, k2, s, ...) of ``table``.

    ``s`` holds packed hashes; ``repeated`` are the hashes, in order, that occur twice or more in the whole table.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        again = np.sort(joined(right["t"], np.uint64))
        found = ((row.b, row.k1, row.k2, decide(row, again)) for row in left.itertuples(index=False))
        return pd.DataFrame([x for x in found if len(x[3])], columns=["b", "k1", "k2", "kept"])

    return table.groupBy("b").cogroup(frequencies(table).groupBy("b")).applyInPandas(run, "b long, k1 long, k2 int, kept binary")


def run_table(rows: DataFrame, length: int) -> DataFrame:
    """(b, k1, k2, owners) of every row that has a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 24
        for at, (batch, texts) in enumerate(text_batches(batches)):
            words, cut = word_hashes(texts)
            found = [owned_runs(words[a:b], length, FIRST) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            some = [i for i, r in enumerate(found) if len(r)]
            pick = pa.array(some, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([place + at // BLOCK] * len(some), pa.int64()), batch.column(0).take(pick), batch.column(1).take(pick), pa.array([found[i].tobytes() for i in some], pa.binary())],
                ["b", "k1", "k2", "owners"],
            )

    return materialise(rows.select("k1", "k2", "text").mapInArrow(run, "b long, k1 long, k2 int, owners binary"), "runs")


def extended(rows: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """(b, k1, k2, s, u, r): for the windows of the runs that go on, hashes s of their distinct extensions to twice
    the run, the extension u of each window, and the windows r with the hash of all their words for the last level."""
    large = 2 * FIRST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 24
        for n, (batch, texts) in enumerate(text_batches(batches)):
            words, cut = word_hashes(texts)
            wide, whole = gram_hashes(words, large), gram_hashes(words, length)
            k1, k2, ship = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for i, packed in enumerate(ship):
                r = np.frombuffer(packed, OWNER)
                count = r["windows"].astype(np.int64)
                owner = np.repeat(np.arange(len(r)), count)
                first = r["start"].astype(np.int64)
                window = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                part, which = np.unique(extension(window, (first + r["offset"])[owner], length, FIRST, large), return_inverse=True)
                records = np.zeros(len(window), WINDOW)
                records["hash"], records["at"] = whole[cut[i] + window], window
                out.append((place + n // BLOCK, k1[i], k2[i], wide[cut[i] + part].tobytes(), which.astype("<u4").tobytes(), records.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], ["b", "k1", "k2", "s", "u", "r"])

    shipping = found.where(F.octet_length("ship") > 0).select("k1", "k2", "ship")
    texts = rows.join(shipping, ["k1", "k2"]).select("k1", "k2", "ship", "text")
    return materialise(texts.mapInArrow(run, "b long, k1 long, k2 int, s binary, u binary, r binary"), "extended")


def repeated_words(rows: DataFrame, length: int) -> DataFrame:
    """(k1, k2, found): packed spans [begin, end) of removed words of every row that has some."""

    def windows_again(row, again: np.ndarray) -> bytes:
        on = among(np.frombuffer(row.s, np.uint64), again)[np.frombuffer(row.u, "<u4")]
        return np.frombuffer(row.r, WINDOW)[on].tobytes()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [np.frombuffer(x, WINDOW)["hash"].tobytes() for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(packed, pa.binary()), b.column(3)], ["b", "k1", "k2", "s", "r"])

    def spans(row, again: np.ndarray) -> bytes:
        w = np.frombuffer(row.r, WINDOW)
        at = w["at"][among(w["hash"], again)].astype(np.int64)
        return merged(np.stack([at, at + length], 1)).tobytes()

    table = run_table(rows, length)
    first = verdicts(table, told(table), length)
    second = materialise(sift(extended(rows, first, length), windows_again), "level18")
    last = sift(second.mapInArrow(hashes, "b long, k1 long, k2 int, s binary, r binary"), spans)
    both = first.where(F.octet_length("spans") > 0).select("k1", "k2", "spans").unionByName(last.select("k1", "k2", F.col("kept").alias("spans")))
    return both.groupBy("k1", "k2").agg(F.collect_list("spans").alias("found"))


def remove_windows(docs: DataFrame, length: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs`` (doc_id, text).

    Words are ``[^\x20\x09-\x0D]+``, unchanged; a null text has none. Windows never cross rows; equal rows repeat
    each other. kept_sha256 is of the kept words joined by one space. doc_id may be null or repeated; other columns
    are ignored; an empty table gives no rows. ``length`` lies between 18 and 64.
    """
    if not 2 * FIRST <= length <= 64:
        raise ValueError("length must lie between 18 and 64")
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, found in zip(encoded(batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True):
                words = t.split()
                kept, at = [], 0
                for a, b in merged(joined(found or [], np.int64).reshape(-1, 2)).tolist():
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = zip(*out, strict=True) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    whole = rows.join(repeated_words(rows, length), ["k1", "k2"], "left").select("doc_id", "text", "found")
    return whole.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
