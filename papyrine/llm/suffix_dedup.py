"""Exact removal of repeated byte strings with suffix arrays by induced sorting.

Every byte covered by a string of ``length`` bytes (200) that also starts anywhere else in the table is removed.
A suffix array of all texts does not fit anywhere, so the suffixes are cut into shards by content:

1. A window is a string of ``length`` bytes at any position. Its owner is the 64-byte gram in it with the smallest
   hash. Equal windows have equal owners at equal distances, so only windows whose owner grams are equal can be
   equal. About 1.5 % of all positions are owners; each owns a run of windows, and the bytes under that run are its
   context.
2. Owners are counted by gram and context digest over all texts. Counting is packed per block of text, so a passage
   that a third of all rows share costs one entry per block. Equal contexts are repeated throughout. Contexts of
   one gram that are not all equal go on, one copy of each.
3. Those contexts, joined into strings of bounded length, are the shard arrays: suffix arrays by induced sorting,
   then permuted common prefixes; a window is repeated if it shares ``length`` bytes with a neighbour in the array.
4. Grams with more than ``BOUND`` different contexts (a passage under a third of all rows has different surroundings
   everywhere) would make unbounded shards. Their windows are counted by hash instead, again packed per block.
5. The spans found join their rows, which are cut in one pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.exchange import frequencies
from papyrine.llm.induced_sort import common_prefixes, suffix_arrays
from papyrine.llm.textual import BLOCK, by_partition, encoded, joined, mix, partitions, text_batches
from papyrine.session import materialise

GRAM = 64
BOUND = 16  # different contexts of a gram that may share a shard
PIECE = 2 << 20  # bytes whose grams are hashed at a time
OWNER = np.dtype([("gram", "<u8"), ("context", "<u8"), ("start", "<u4"), ("offset", "<u2"), ("windows", "<u2")])
ASKED = np.dtype([("gram", "<u8"), ("context", "<u8"), ("count", "<i8")])
TOLD = np.dtype([("gram", "<u8"), ("context", "<u8"), ("flag", "<i8")])
REPEATED, SHIP, HOT = 1, 2, 4
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every string of ``size`` bytes, by doubling: strings of 2w bytes from two of w."""
    parts: list[tuple[int, np.ndarray]] = []
    h, w = _BYTE[data], 1
    while True:
        if size & w:
            parts.append((w, h))
        if 2 * w > size:
            break
        h = h[:-w] * np.uint64(pow(_BASE, w, 1 << 64)) + h[w:]
        w *= 2
    n = len(data) - size + 1
    out, at = np.zeros(max(n, 0), np.uint64), 0
    for w, h in parts:
        out = out * np.uint64(pow(_BASE, w, 1 << 64)) + h[at : at + n] if n > 0 else out
        at += w
    return mix(out)


def owners(data: bytes, length: int) -> list[tuple[int, int, int, int]]:
    """(gram hash, first window, last window, owner) of every run of windows of one text."""
    out = []
    span = length - GRAM + 1  # grams in a window
    for begin in range(0, max(0, len(data) - length + 1), PIECE):
        piece = np.frombuffer(data[begin : begin + PIECE + length - 1], np.uint8)
        gram = rolling(piece, GRAM)
        # 40 bits of hash, then the position: the smallest key names the owner, the left one of equal grams.
        low = (gram & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(gram), dtype=np.uint64)
        w = 1
        while 2 * w <= span:
            low = np.minimum(low[:-w], low[w:])
            w *= 2
        low = np.minimum(low[: len(gram) - span + 1], low[span - w :][: len(gram) - span + 1])
        owner = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        last = np.append(first[1:], len(owner)) - 1
        at = owner[first]
        out.extend(zip(gram[at].tolist(), (first + begin).tolist(), (last + begin).tolist(), (at + begin).tolist(), strict=True))
    return out


def owner_rows(data: bytes, length: int) -> np.ndarray:
    """Packed owners of one text."""
    found = owners(data, length)
    rows = np.zeros(len(found), OWNER)
    for i, (gram, a, b, at) in enumerate(found):
        digest = hashlib.blake2b(data[a : b + length], digest_size=8, salt=(at - a).to_bytes(2, "little")).digest()
        rows[i] = (gram, int.from_bytes(digest, "little"), a, at - a, b - a + 1)
    return rows


def owner_table(rows: DataFrame, length: int) -> DataFrame:
    """(b, k1, k2, owners) of every row with a window, in blocks of about 4 MB of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 24
        for at, (batch, texts) in enumerate(text_batches(batches)):
            some = [i for i, t in enumerate(texts) if len(t) >= length]
            pick = pa.array(some, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([place + at // BLOCK] * len(some), pa.int64()), batch.column(0).take(pick), batch.column(1).take(pick), pa.array([owner_rows(texts[i], length).tobytes() for i in some], pa.binary())],
                ["b", "k1", "k2", "owners"],
            )

    return materialise(rows.select("k1", "k2", "text").mapInArrow(run, "b long, k1 long, k2 int, owners binary"), "owners")


def told(table: DataFrame) -> DataFrame:
    """(b, told): for every block its owners that are repeated or have to be compared, with flags."""
    parts = partitions(table)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(b: int, packed: list[bytes]) -> pa.RecordBatch:
            r = joined(packed, OWNER)
            r = r[np.lexsort((r["context"], r["gram"]))]
            begin = np.flatnonzero(np.concatenate([[True], (r["gram"][1:] != r["gram"][:-1]) | (r["context"][1:] != r["context"][:-1])]))
            asked = np.zeros(len(begin), ASKED)
            asked["gram"], asked["context"], asked["count"] = r["gram"][begin], r["context"][begin], np.diff(np.append(begin, len(r)))
            rows = list(by_partition((asked["gram"] % np.uint64(parts)).astype(np.int64), parts, asked))
            p, x = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array([b] * len(p), pa.int64()), pa.array(x, pa.binary())], ["p", "b", "x"])

        now, packed = None, []
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != now and packed:
                    yield flush(now, packed)
                    packed = []
                now = b
                packed.append(x)
        if packed:
            yield flush(now, packed)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for x in batches for r in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True))
        if not rows:
            return
        r = joined((x for _, x in rows), ASKED)
        order = np.lexsort((r["context"], r["gram"]))  # stable: blocks stay in order within equal contexts
        s = r[order]
        new_gram = np.concatenate([[True], s["gram"][1:] != s["gram"][:-1]])
        new = new_gram | np.concatenate([[True], s["context"][1:] != s["context"][:-1]])
        context = np.cumsum(new) - 1
        gram = np.cumsum(new_gram) - 1
        times = np.bincount(context, s["count"])[context]
        kinds = np.bincount(gram, new)[gram]
        flag = REPEATED * (times > 1) + SHIP * ((kinds > 1) & new) + HOT * (kinds > BOUND)
        flags = np.empty(len(r), np.int64)
        flags[order] = flag
        out, at = [], 0
        for b, x in rows:
            n = len(x) // ASKED.itemsize
            mine, f = r[at : at + n], flags[at : at + n]
            at += n
            on = (f & (REPEATED | SHIP)) > 0
            answer = np.zeros(int(on.sum()), TOLD)
            answer["gram"], answer["context"], answer["flag"] = mine["gram"][on], mine["context"][on], f[on]
            if len(answer):
                out.append((b, answer.tobytes()))
        if out:
            b, x = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(x, pa.binary())], ["b", "told"])

    sent = table.select("b", "owners").mapInArrow(send, "p int, b long, x binary").repartition(parts, "p")
    return sent.mapInArrow(decide, "b long, told binary")


def verdicts(table: DataFrame, answers: DataFrame, length: int) -> DataFrame:
    """(k1, k2, spans, ship) of the rows with repeated spans or contexts to compare."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        told = {(g, c): f for g, c, f in joined(right["told"], TOLD).tolist()}
        out = []
        for k1, k2, packed in zip(left["k1"], left["k2"], left["owners"], strict=True):
            rows = np.frombuffer(packed, OWNER)
            pairs = list(zip(rows["gram"].tolist(), rows["context"].tolist(), strict=True))
            flag = np.array([told.get(x, 0) for x in pairs], np.int64)
            for i in np.flatnonzero(flag & SHIP):  # one copy per context is enough
                if told[pairs[i]] & SHIP:
                    told[pairs[i]] &= ~SHIP
                else:
                    flag[i] &= ~SHIP
            again, ship = rows[(flag & REPEATED) > 0], np.flatnonzero(flag & SHIP)
            if len(again) or len(ship):
                begin = again["start"].astype(np.int64)
                spans = merged(np.stack([begin, begin + again["windows"] + length - 1], 1))
                out.append((k1, k2, spans.tobytes(), rows[ship].tobytes(), ((flag[ship] & HOT) > 0).tobytes()))
        return pd.DataFrame(out, columns=["k1", "k2", "spans", "ship", "hot"])

    found = table.groupBy("b").cogroup(answers.groupBy("b")).applyInPandas(run, "k1 long, k2 int, spans binary, ship binary, hot binary")
    return materialise(found, "verdicts")


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted spans [begin, end) with overlapping and touching ones united."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[new, 0], np.maximum.reduceat(spans[:, 1], new)], 1)


def contexts(rows: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """(gram, hot, k1, k2, start, windows, context) of every context to compare, with its bytes, in blocks b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 24
        for at, (batch, texts) in enumerate(text_batches(batches)):
            k1, k2, ship, hot = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for i, t in enumerate(texts):
                on = np.frombuffer(hot[i], bool)
                for r, h in zip(np.frombuffer(ship[i], OWNER), on, strict=True):
                    a = int(r["start"])
                    out.append((int(r["gram"]) - (1 << 63), bool(h), k1[i], k2[i], a, int(r["windows"]), t[a : a + int(r["windows"]) + length - 1], place + at // BLOCK))
            columns = zip(*out, strict=True) if out else [()] * 8
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["gram", "hot", "k1", "k2", "start", "windows", "context", "b"])

    shipping = found.where(F.octet_length("ship") > 0).select("k1", "k2", "ship", "hot")
    texts = rows.join(shipping, ["k1", "k2"]).select("k1", "k2", "ship", "hot", "text")
    kind = "gram long, hot boolean, k1 long, k2 int, start long, windows int, context binary, b long"
    return materialise(texts.mapInArrow(run, kind), "contexts")


def repeated_windows(groups: list[list[bytes]], length: int) -> list[list[np.ndarray]]:
    """For each context of each group, the positions of its windows that occur elsewhere in the same group.

    Groups are packed into lanes of equal height; contexts end in a separator, so no common prefix of ``length``
    bytes crosses one.
    """
    heights = [sum(len(c) + 1 for c in g) for g in groups]
    out: list[list[np.ndarray]] = [[] for _ in groups]
    order = np.argsort(heights, kind="stable")
    done = 0
    while done < len(order):
        # A class of groups whose heights differ by no more than a factor of three, in lanes of its tallest group.
        top = int(np.searchsorted(np.array(heights)[order], 3 * heights[order[done]], side="right"))
        lanes: list[list[int]] = []
        height, room, size = heights[order[top - 1]], 0, 0
        chunk_end = done
        for g in order[done:top]:
            if heights[g] > room:
                if size + height > 1 << 20 and lanes:
                    break
                lanes.append([])
                room = height
                size += height
            lanes[-1].append(int(g))
            room -= heights[g]
            chunk_end += 1
        done = chunk_end
        text = np.full((height + 1, len(lanes)), 258, np.int32)  # padding in front is larger than any byte
        text[-1] = 0
        places: list[tuple[int, int, int, int]] = []
        for lane, members in enumerate(lanes):
            at = height - sum(heights[g] for g in members)
            for g in members:
                for c in groups[g]:
                    text[at : at + len(c), lane] = np.frombuffer(c, np.uint8).astype(np.int32) + 2
                    text[at + len(c), lane] = 1
                    places.append((g, lane, at, len(c) - length + 1))
                    at += len(c) + 1
        sa = suffix_arrays(text, 259)
        prefix = common_prefixes(text, sa, length) >= length
        # A window is repeated if it shares the prefix with the suffix before it, or the one after it does with it.
        again = prefix.copy()
        lane = np.broadcast_to(np.arange(len(lanes)), (height, len(lanes)))
        follows = prefix[sa[1:], lane]
        again[sa[:-1][follows], lane[follows]] = True
        for g, x, at, windows in places:
            # 258 and 1 never lie inside a window, so equal prefixes are equal windows.
            out[g].append(np.flatnonzero(again[at : at + windows, x]))
    return out


def shard_spans(cold: DataFrame, length: int) -> DataFrame:
    """Repeated spans by suffix arrays over shards of whole gram groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
        groups: list[list[tuple]] = []
        for r in rows:
            if not groups or groups[-1][0][0] != r[0]:
                groups.append([])
            groups[-1].append(r)
        out = []
        for group, found in zip(groups, repeated_windows([[r[5] for r in g] for g in groups], length), strict=True):
            for r, at in zip(group, found, strict=True):
                if len(at):
                    out.append((r[1], r[2], merged(np.stack([at + r[3], at + r[3] + length], 1)).tobytes()))
        columns = zip(*out, strict=True) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["k1", "k2", "spans"])

    dealt = cold.select("gram", "k1", "k2", "start", "windows", "context").repartition(partitions(cold), "gram")
    return dealt.mapInArrow(run, "k1 long, k2 int, spans binary")


def hot_spans(hot: DataFrame, length: int) -> DataFrame:
    """Repeated spans under grams with many contexts: every window counted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("context")).to_pylist()
            hashes = []
            if texts:
                h = rolling(np.frombuffer(b"".join(texts), np.uint8), length)
                ends = np.cumsum([len(t) for t in texts])
                hashes = [h[e - len(t) : e - length + 1].tobytes() for t, e in zip(texts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(hashes, pa.binary())], ["b", "k1", "k2", "start", "s"])

    windows = hot.select("b", "k1", "k2", "start", "context").mapInArrow(run, "b long, k1 long, k2 int, start long, s binary")

    def decide(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(joined(right["t"], np.uint64))
        out = []
        for k1, k2, start, raw in zip(left["k1"], left["k2"], left["start"], left["s"], strict=True):
            s = np.frombuffer(raw, np.uint64)
            if len(t):
                at = np.flatnonzero(t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s) + start
                if len(at):
                    out.append((k1, k2, merged(np.stack([at, at + length], 1)).tobytes()))
        return pd.DataFrame(out, columns=["k1", "k2", "spans"])

    return windows.groupBy("b").cogroup(frequencies(windows).groupBy("b")).applyInPandas(decide, "k1 long, k2 int, spans binary")


def spans_of(rows: DataFrame, length: int) -> DataFrame:
    """(k1, k2, found): all removed spans of every row that has some, as packed arrays."""
    table = owner_table(rows, length)
    found = verdicts(table, told(table), length)
    shipped = contexts(rows, found, length)
    spans = found.select("k1", "k2", "spans").unionByName(shard_spans(shipped.where("not hot"), length)).unionByName(hot_spans(shipped.where("hot"), length))
    return spans.where(F.octet_length("spans") > 0).groupBy("k1", "k2").agg(F.collect_list("spans").alias("found"))


def keyed(docs: DataFrame) -> DataFrame:
    """A 96-bit key of every row's id and text; rows that are equal in both share it, and their spans."""
    return docs.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.hash("text", "doc_id")})


def cut(text: bytes, found: list[bytes] | None) -> tuple[bytes, np.ndarray]:
    """What is left of a text, and its maximal removed spans."""
    spans = merged(joined(found or [], np.int64).reshape(-1, 2))
    kept, at = [], 0
    for a, b in spans.tolist():
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), spans


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text).

    Texts are judged as UTF-8 bytes; null is empty, and texts shorter than ``length`` keep everything. Matches
    never cross rows; equal rows repeat each other. doc_id may be null or repeated. Other columns are ignored; an
    empty table gives no rows.
    """
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, f in zip(encoded(batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True):
                kept, spans = cut(t, f)
                out.append((len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            columns = zip(*out, strict=True) if out else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    whole = rows.join(spans_of(rows, length), ["k1", "k2"], "left").select("doc_id", "text", "found")
    return whole.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with the same columns and rows, repeated bytes cut from ``text``; ``n_chars`` follows if there is one.

    A character of which only some bytes are removed goes entirely. A null text stays null.
    """
    # The row travels as one column, so that no name of the input can clash.
    rows = keyed(docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("text")))

    def run(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, found in texts:
            out = []
            for t, f in zip(text, found, strict=True):
                some = isinstance(t, str) and f is not None and len(f)
                out.append(cut(t.encode("utf-8", "replace"), list(f))[0].decode("utf-8", "ignore") if some else t)
            yield pd.Series(out, dtype=object)

    whole = rows.join(spans_of(rows.select("doc_id", "text", "k1", "k2"), length), ["k1", "k2"], "left")
    left = F.when(F.col("found").isNull(), F.col("text")).otherwise(F.pandas_udf(run, "string")("text", "found"))
    done = whole.select("row", left.alias("left"))
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    changed = {"text": F.col("left"), "n_chars": F.length("left").cast(kinds.get("n_chars", "long"))}
    return done.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
