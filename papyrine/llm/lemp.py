"""Exact ranked search by norm buckets of impact vectors.

A document is a vector with a coordinate per term, its impact; an item is a vector of term weights, and a score is
their product. Both sides are scaled by the root of the term's weight, so rare terms make a vector long. Vectors are
ordered by length and cut into buckets. A bucket whose greatest length times the item's length (Cauchy-Schwarz) stays
below the item's k-th score so far is skipped whole. Inside a bucket the item's heaviest coordinates are looked up,
just as many as leave a rest that cannot reach that score alone; vectors without any of them are out, and of the others
those whose sum over these coordinates plus the bound of the rest (lengths of both rests, or greatest coordinates of
the bucket) stays below. What survives is scored again in 64-bit integers, so results are exact, ties included.

How it is spread: one scan counts the items' terms in every text and writes packed vectors; document frequencies come
from those. Vectors are dealt by range of (length, hash of the key), so equal lengths, as of copies, don't meet in one
task. The longest 1/64 are searched first and give every item a k-th score to start from; the others follow in one
pass, each task going down its own lengths with rising scores. A task returns at most k rows an item. Items travel with
the tasks in slices of ``SLICE`` characters, measured first; each slice is a pass of its own over the table.

Null or empty texts have no terms, don't count as documents and are never found; items without terms have no rows.
Repeated documents are ranked each; equal scores go by ascending key, nulls last. Repeated items are asked each. Empty
tables give no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.textual import encoded, partitions
from papyrine.session import materialise

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # matches of [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+ in UTF-8
OTHER = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
SLICE = 8_000_000  # characters of items sent at a time
PIECE = 1 << 20  # bytes of a text split at a time
HEAD = 64  # the longest 1/HEAD of the vectors give the first k-th scores
ROWS, VALUES = 4096, 1 << 20  # vectors of a bucket, and coordinates
SLACK = 1 + 1e-9  # bounds are computed in doubles


def terms(text: bytes) -> Iterator[list[bytes]]:
    """A text's terms in pieces, A-Z lower-cased; no term is cut."""
    text, at = text.lower(), 0
    while at < len(text):
        cut = OTHER.search(text, at + PIECE)
        stop = cut.start() if cut else len(text)
        yield TERM.findall(text, at, stop)
        at = stop


def vectors(docs: DataFrame, ids: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(key, n, ids, tf) of every text with a term: number of all its terms, the asked ones among them and how often."""
    sent = docs.sparkSession.sparkContext.broadcast(ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                at, ns, held, often = [], [], [], []
                for row, t in enumerate(encoded(batch.column(1).to_pylist())):
                    n, found = 0, Counter()
                    for part in terms(t):
                        n += len(part)
                        found.update(map(get, part))
                    if not n:
                        continue
                    found.pop(None, None)
                    own = np.fromiter(found.keys(), np.int32, len(found))
                    order = np.argsort(own)
                    at.append(row)
                    ns.append(n)
                    held.append(own[order].tobytes())
                    often.append(np.fromiter(found.values(), np.int64, len(found))[order].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ns, pa.int64()), pa.array(held, pa.binary()), pa.array(often, pa.binary())], ["key", "n", "ids", "tf"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(count, f"key {kind}, n long, ids binary, tf binary")


def frequencies(table: DataFrame, size: int) -> np.ndarray:
    """In how many documents each asked term is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for row in batch.column(0).to_pylist():
                total[np.frombuffer(row, np.int32)] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for r in table.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n")).collect():  # a row a term of the slice
        out[r[0]] = r[1]
    return out


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def impacts(tf: np.ndarray, n: int, documents: int, total: int) -> np.ndarray:
    m = 25 + 75 * n * documents // total
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def ordered(table: DataFrame, weights: np.ndarray, documents: int, total: int, parts: int) -> DataFrame:
    """(length, key, ids, impact): vectors of weighted terms, stored by descending length."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lengths, held, values = [], [], [], []
            for row, (n, i, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                i, t = np.frombuffer(i, np.int32), np.frombuffer(t, np.int64)
                some = weights[i] > 0
                i, x = i[some], impacts(t[some], n, documents, total)
                if len(i):
                    at.append(row)
                    lengths.append(math.sqrt(float((weights[i] * x.astype(np.float64) ** 2).sum())))
                    held.append(i.tobytes())
                    values.append(x.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.float64()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(held, pa.binary()), pa.array(values, pa.binary())], ["length", "key", "ids", "impact"])

    kind = table.schema["key"].dataType.simpleString()
    weighed = table.mapInArrow(weigh, f"length double, key {kind}, ids binary, impact binary")
    dealt = weighed.repartitionByRange(parts, F.desc("length"), F.xxhash64("key", "ids"))
    return materialise(dealt.sortWithinPartitions(F.desc("length")), "impacts")


class Items:
    """The asked items of a slice: their terms with repeats, scaled for bounds, plain for scores."""

    def __init__(self, asked: list[Counter], weights: np.ndarray):
        self.ids, self.scaled, self.rest, self.whole = [], [], [], []
        for counts in asked:
            i = np.array(sorted(t for t in counts if weights[t] > 0), np.int64)
            y = np.sqrt(weights[i].astype(np.float64)) * np.array([counts[t] for t in i.tolist()], np.float64)
            order = np.argsort(-y, kind="stable")
            i, y = i[order], y[order]
            self.ids.append(i)
            self.scaled.append(y)
            self.rest.append(np.sqrt(np.append(np.cumsum(y[::-1] ** 2)[::-1], 0.0)))  # length of what follows
            self.whole.append(weights[i] * np.array([counts[t] for t in i.tolist()], np.int64))
        self.length = np.array([r[0] for r in self.rest])


class Bucket:
    """Vectors of about one length, in any order, by coordinate."""

    def __init__(self, keys: list, lengths: np.ndarray, ids: list[bytes], impact: list[bytes], root: np.ndarray):
        self.keys, self.lengths = keys, lengths
        at = np.repeat(np.arange(len(ids)), [len(i) // 4 for i in ids])
        flat, value = np.frombuffer(b"".join(ids), np.int32), np.frombuffer(b"".join(impact), np.int32).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.row, self.value = at[order], value[order]
        self.names, self.begin = np.unique(flat[order], return_index=True)
        self.begin = np.append(self.begin, len(order))
        self.x = self.value * root[flat[order]]
        self.most = np.maximum.reduceat(self.x, self.begin[:-1]) if len(order) else np.zeros(0)

    def search(self, items: Items, q: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may reach the score ``least`` for item ``q``, with their exact scores."""
        ids, y = items.ids[q], items.scaled[q]
        slot = np.minimum(np.searchsorted(self.names, ids), max(len(self.names) - 1, 0))
        here = self.names[slot] == ids
        top = np.where(here, self.most[slot] * y, 0.0)
        after = np.append(np.cumsum(top[::-1])[::-1], 0.0)  # greatest sum over what follows
        bound = np.minimum(items.rest[q] * self.lengths.max(), after) * SLACK
        focus = int(np.argmax(bound < least)) if least > 0 and (bound < least).any() else len(ids)
        spans = [slice(self.begin[s], self.begin[s + 1]) for s in slot[:focus][here[:focus]]]
        if not spans:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = np.concatenate([self.row[s] for s in spans])
        x = np.concatenate([self.x[s] for s in spans])
        times = np.repeat(y[:focus][here[:focus]], [s.stop - s.start for s in spans])
        part = np.bincount(row, x * times, len(self.keys))
        touched = np.bincount(row, minlength=len(self.keys)) > 0
        if focus < len(ids):
            left = np.sqrt(np.maximum(self.lengths**2 * SLACK - np.bincount(row, x * x, len(self.keys)), 0.0))
            touched &= (part + np.minimum(items.rest[q][focus] * left, after[focus])) * SLACK >= least
        rows = np.flatnonzero(touched)
        if not len(rows):
            return rows, rows
        score = np.zeros(len(self.keys), np.int64)
        for s, w in zip(slot[here].tolist(), items.whole[q][here].tolist(), strict=True):
            own = slice(self.begin[s], self.begin[s + 1])
            mine = touched[self.row[own]]
            score[self.row[own][mine]] += w * self.value[own][mine]  # a row has a term once
        return rows, score[rows]


def buckets(batches: Iterator[pa.RecordBatch], root: np.ndarray) -> Iterator[Bucket]:
    """The stored vectors in their order, ROWS rows or VALUES coordinates at a time."""
    held, size = [], 0

    def made() -> Bucket:
        length, keys, ids, impact = zip(*held, strict=True)
        return Bucket(list(keys), np.array(length), list(ids), list(impact), root)

    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            for r in zip(*(c.to_pylist() for c in batch.slice(a, ROWS).columns), strict=True):
                held.append(r)
                size += len(r[2]) // 4
                if len(held) >= ROWS or size >= VALUES:
                    yield made()
                    held, size = [], 0
    if held:
        yield made()


def found(table: DataFrame, items: Items, root: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """(q, key, score): each task's k best rows of every item that reach the item's ``least`` score."""
    sent = table.sparkSession.sparkContext.broadcast((items, root, least))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, root, least = sent.value
        least, best = least.copy(), [[] for _ in items.ids]
        for bucket in buckets(batches, root):
            for q in np.flatnonzero(items.length * bucket.lengths.max() * SLACK >= np.maximum(least, 1)).tolist():
                rows, score = bucket.search(items, q, int(least[q]))
                good = score >= max(least[q], 1)
                if good.any():
                    new = [(-s, bucket.keys[r] is None, bucket.keys[r]) for r, s in zip(rows[good].tolist(), score[good].tolist(), strict=True)]
                    best[q] = sorted(best[q] + new, key=lambda x: x[:2] if x[1] else x)[:k]
                    if len(best[q]) == k:
                        least[q] = max(least[q], -best[q][-1][0])
        for q, rows in enumerate(best):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(rows), pa.int32()), pa.array([r[2] for r in rows], keys), pa.array([-r[0] for r in rows], pa.int64())], ["q", "key", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    keys = to_arrow_type(table.schema["key"].dataType)
    return table.select("length", "key", "ids", "impact").mapInArrow(search, f"q int, key {table.schema['key'].dataType.simpleString()}, score long")


def best_of(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, key, score): the ``k`` best documents of every item with a score above 0."""
    spark, parts = docs.sparkSession, partitions(docs)
    kinds = items.schema[item].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    asked = items.select(F.col(item).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = -(-size // SLICE)
    out = None
    for s in range(slices):
        # About SLICE characters: the sizes of the slices follow from the sum above.
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == s).collect()
        counts = [Counter(t for part in terms(x) for t in part) for x in encoded(r.text for r in rows)]
        ids = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        if not ids:
            continue
        table = materialise(vectors(docs, ids, key, text), "vectors")
        documents, total = table.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            continue
        frequency = frequencies(table, len(ids))
        weights = np.array([weight(documents, f) if f else 0 for f in frequency.tolist()], np.int64)
        root = np.sqrt(weights.astype(np.float64))
        packed = Items([Counter({ids[t]: n for t, n in c.items()}) for c in counts], weights)
        stored = ordered(table, weights, documents, total, parts)
        cut = stored.agg(F.percentile_approx("length", 1 - 1 / HEAD, 10_000)).first()[0]
        if cut is None:
            continue
        none = np.zeros(len(rows), np.int64)
        head = materialise(best_of(found(stored.where(F.col("length") >= cut), packed, root, none, k), k), "head")
        least = none.copy()
        for r in head.where(F.col("rank") == k).select("q", "score").collect():  # a row an item of the slice
            least[r.q] = r.score
        others = found(stored.where(F.col("length") < cut), packed, root, least, k)
        both = best_of(head.select("q", "key", "score").unionByName(others), k)
        names = spark.createDataFrame([(q, r["item"]) for q, r in enumerate(rows)], f"q int, item {kinds[0]}")
        named = both.join(names, "q").select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
        out = named if out is None else out.unionByName(named)
    if out is None:
        return spark.createDataFrame([], f"`{item}` {kinds[0]}, rank int, `{key}` {kinds[1]}, score long")
    return out
