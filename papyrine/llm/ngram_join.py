"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is its set of five-word shingles; two documents link when ``100 * |A & B| >= 80 * |A | B|``. All shingles
have one global order, rare ones first. If a pair links, then for every l the first ``n - ceil(0.8 n) + l`` shingles
of both share at least l. Each document picks its own l: a longer prefix scans more lists but asks candidates for
more shared prefix shingles, so l is chosen by the estimated cost of its candidates; a pair is verified when its
prefixes share min(l, l') shingles.

How it is spread over a cluster:

1. Equal sets form one class; only its smallest document goes on.
2. A shingle that one class alone has cannot be shared. A class whose shingles in a fixed hash slice (30 % of the hash
   space) show more than ``n - ceil(0.8 n)`` such shingles links with nothing and is dropped. This loses no pair. Hashes travel packed in
   arrays, once per batch, so a shingle that a third of all texts have costs one entry per batch.
3. Document frequencies among the classes left come the same way and give the order, the prefixes and l.
4. Classes that share a prefix shingle, directly or through others, form clusters, found from star edges (one per
   shingle and batch), never from pairs.
5. A cluster is cut into blocks of bounded weight and every pair of blocks is one task. Inside, prefix lists give
   the candidates. Classes already joined to the block pair's first class need no comparison among each other, so
   groups of near copies cost far less than their pairs. Only a spanning forest of the links leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.exchange import frequencies
from papyrine.llm.graph import EDGE, components
from papyrine.llm.textual import BLOCK, by_partition, joined, mix, partitions, shingle_sets, text_batches
from papyrine.session import materialise

SLICE = 0.3  # part of the hash space that step 2 looks at
LEVELS = 8  # largest number of shared prefix shingles asked for
BLOCK_SHINGLES = 1 << 20  # shingles of a block, unless one document has more
GATHER = 16 << 20  # bytes of text behind one packed exchange row per partition


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that depend on the set alone."""
    one = np.array([np.add.reduce(s) + np.uint64(len(s)) for s in sets], np.uint64)
    two = np.array([np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))) for s in sets], np.uint64)
    return mix(one).view(np.int64), mix(two).view(np.int64)


def allowed_misses(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of n that a linked set may lack: n - ceil(n * percent / 100)."""
    return n - -(-n * percent // 100)


def shingle_keys(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (distinct shingles) and the set's key (k1, k2) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            sets = shingle_sets(texts, size)
            k1, k2 = set_keys(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1), pa.array(k2)], ["doc_id", "n", "k1", "k2"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long")


def lonely_shingles(docs: DataFrame, size: int) -> DataFrame:
    """(k1, lone): the shingles in the hash slice that no other class has, counted per class that has any."""
    parts = partitions(docs)
    bound = np.uint64(int(SLICE * 2**32))

    def pack(tokens: list[np.ndarray], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        t, k = np.concatenate(tokens), np.concatenate(keys)
        order = np.argsort(t)
        t, k = t[order], k[order]
        begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
        if len(t):
            low, high = np.minimum.reduceat(k, begin), np.maximum.reduceat(k, begin)
            t, k = t[begin], np.where(low == high, low, 0)  # key 0: several classes
        where = (mix(t) % np.uint64(parts)).astype(np.int64)
        rows = list(by_partition(where, parts, t, k))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["p", "t", "k"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, keys, gathered = [], [], 0
        for _, texts in text_batches(batches):
            sets = shingle_sets(texts, size)
            k1, _ = set_keys(sets)
            for s, key in zip(sets, k1, strict=True):
                inside = s[(s & np.uint64(0xFFFFFFFF)) < bound]
                tokens.append(inside)
                keys.append(np.full(len(inside), key))
            gathered += sum(map(len, texts))
            if gathered > GATHER:
                yield from pack(tokens, keys)
                tokens, keys, gathered = [], [], 0
        if tokens:
            yield from pack(tokens, keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(1).to_pylist(), b.column(2).to_pylist()) for b in batches]
        t = joined((x for a, _ in got for x in a), np.uint64)
        k = joined((x for _, a in got for x in a), np.int64)
        del got
        if not len(t):
            return
        order = np.argsort(t)
        t, k = t[order], k[order]
        begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        low, high = np.minimum.reduceat(k, begin), np.maximum.reduceat(k, begin)
        keys, lone = np.unique(low[(low == high) & (low != 0)], return_counts=True)
        rows = list(by_partition((keys.view(np.uint64) % np.uint64(parts)).astype(np.int64), parts, keys, lone.astype(np.int64)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["p", "t", "k"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(1).to_pylist(), b.column(2).to_pylist()) for b in batches]
        keys, code = np.unique(joined((x for a, _ in got for x in a), np.int64), return_inverse=True)
        lone = np.bincount(code, joined((x for _, a in got for x in a), np.int64), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(lone)], ["k1", "lone"])

    packed = "p int, t binary, k binary"
    sent = docs.select("text").mapInArrow(send, packed).repartition(parts, "p")
    return sent.mapInArrow(count, packed).repartition(parts, "p").mapInArrow(add, "k1 long, lone long")


def shingle_table(docs: DataFrame, alive: DataFrame, size: int) -> DataFrame:
    """(b, cid, n, s): packed shingles of the classes left, in blocks b of about 4 MB of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 24
        for at, (batch, texts) in enumerate(text_batches(batches)):
            sets = shingle_sets(texts, size)
            k1, k2 = set_keys(sets)
            # A repeated doc_id may bring another text than the one the class is of.
            same = (k1 == batch.column(2).to_numpy()) & (k2 == batch.column(3).to_numpy())
            rows = np.flatnonzero(same)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), place + at // BLOCK)), batch.column(0).take(pa.array(rows)), pa.array([len(sets[i]) for i in rows], pa.int64()), pa.array([sets[i].tobytes() for i in rows], pa.binary())],
                ["b", "cid", "n", "s"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("cid"), "text").join(alive, "cid").select("cid", "text", "k1", "k2")
    return materialise(texts.mapInArrow(run, "b long, cid long, n long, s binary"), "shingles")


def choose_prefix(s: np.ndarray, f: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """(l, prefix shingles that others have too) of one set with document frequencies f.

    With prefix sum S(l) of f - 1, a document has at most S(l) / l candidates that share l prefix shingles; the cost
    is S(l) list entries plus the verification of those candidates.
    """
    n = len(s)
    order = np.lexsort((s, f))
    base = int(allowed_misses(np.int64(n), percent))
    most = min(LEVELS, n - base)
    scanned = np.cumsum(f[order] - 1)[base : base + most]
    level = np.arange(1, most + 1)
    best = int(np.argmin(scanned + scanned / level * (8 + n / 16))) + 1
    prefix = order[: base + best]
    return best, s[prefix[f[prefix] > 1]]


def prefixes(table: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(cid, n, l, prefix, s) of every class that shares a prefix shingle with another."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        t, f = joined(right["t"], np.uint64), joined(right["f"], np.int64)
        order = np.argsort(t)
        t, f = t[order], f[order]
        out = []
        for cid, n, raw in zip(left["cid"], left["n"], left["s"], strict=True):
            s = np.frombuffer(raw, np.uint64)
            freq = np.ones(len(s), np.int64)
            if len(t):
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                freq = np.where(t[at] == s, f[at], 1)
            level, prefix = choose_prefix(s, freq, percent)
            if len(prefix):
                out.append((cid, n, level, prefix.tobytes(), raw))
        return pd.DataFrame(out, columns=["cid", "n", "l", "prefix", "s"])

    chosen = table.groupBy("b").cogroup(shared.groupBy("b")).applyInPandas(run, "cid long, n long, l long, prefix binary, s binary")
    return materialise(chosen, "prefixes")


def cluster_edges(chosen: DataFrame) -> DataFrame:
    """Star edges between classes that share a prefix shingle: within a batch, and between batches by shingle."""
    parts = partitions(chosen)

    def stars(t: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((c, t))
        t, c = t[order], c[order]
        begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        hub = np.repeat(c[begin], np.diff(np.append(begin, len(t))))
        pair = np.unique(np.stack([c, hub], 1)[c != hub], axis=0)
        return t[begin], c[begin], pair[:, 0], pair[:, 1]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            t, c, u, v = stars(np.concatenate(lists), np.repeat(batch.column(0).to_numpy(), [len(x) for x in lists]))
            rows = list(by_partition((mix(t) % np.uint64(parts)).astype(np.int64), parts, t, c))
            rows.append((-1, u.tobytes(), v.tobytes()))
            p, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["p", "x", "y"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, c = [], []
        for batch in batches:
            for p, x, y in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if p < 0:
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)), pa.array(np.frombuffer(y, np.int64))], ["u", "v"])
                else:
                    t.append(x)
                    c.append(y)
        if t:
            _, _, u, v = stars(joined(t, np.uint64), joined(c, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    sent = chosen.select("cid", "prefix").mapInArrow(send, "p int, x binary, y binary")
    # Ready edges (p < 0) go anywhere; packed shingles meet at their partition.
    return sent.repartition(parts, F.when(F.col("p") < 0, F.hash("x")).otherwise(F.col("p"))).mapInArrow(meet, EDGE)


def joined_classes(cid: np.ndarray, n: np.ndarray, level: np.ndarray, prefix: list[np.ndarray], sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Links among the classes of one task, as the position of each class's root in a spanning forest.

    Every class outside the first class's component is compared with all its candidates, so a pair is left out only
    when both its members are in that component already.
    """
    m = len(cid)
    root = np.arange(m)
    code = np.unique(np.concatenate(prefix), return_inverse=True)[1]
    owner = np.repeat(np.arange(m), [len(p) for p in prefix])
    order = np.argsort(code, kind="stable")
    posting, cut = owner[order], np.searchsorted(code[order], np.arange(code.max() + 2))
    at = np.cumsum([0] + [len(p) for p in prefix])
    full: list[np.ndarray] = []
    weight = np.add.reduceat(np.append(cut[code + 1] - cut[code], 0), at[:-1]) if m else np.zeros(0)
    first = int(np.argmax(weight))
    for x in [first, *(i for i in range(m) if i != first)]:
        if x != first and root[x] == root[first]:
            continue
        mine = code[at[x] : at[x + 1]]
        hits = np.bincount(np.concatenate([posting[cut[k] : cut[k + 1]] for k in mine]), minlength=m) if len(mine) else np.zeros(m, np.int64)
        near = (hits >= np.minimum(level[x], level)) & (root != root[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        near = np.flatnonzero(near)
        if not len(near):
            continue
        if len(near) > 12:
            if not full:  # positions of every class in the lists of all shingles
                names, all_code = np.unique(np.concatenate(sets), return_inverse=True)
                by = np.argsort(all_code, kind="stable")
                full = [np.repeat(np.arange(m), n)[by], np.searchsorted(all_code[by], np.arange(len(names) + 1)), all_code, np.concatenate([[0], np.cumsum(n)])]
            lists, begin, all_code, edge = full
            common = np.bincount(np.concatenate([lists[begin[k] : begin[k + 1]] for k in all_code[edge[x] : edge[x + 1]]]), minlength=m)[near]
        else:
            s = sets[x]
            common = np.array([int((s[np.minimum(np.searchsorted(s, sets[y]), len(s) - 1)] == sets[y]).sum()) for y in near])
        for y in near[100 * common >= percent * (n[x] + n[near] - common)]:
            if root[y] != root[x]:
                low, high = sorted((root[x], root[y]))
                root[root == high] = low
    return root


def verified_links(chosen: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Spanning-forest edges (u, v) of the links, from tasks of two blocks of one cluster each."""
    placed = chosen.join(clusters.withColumnRenamed("id", "cid"), "cid")
    blocks = placed.groupBy("component").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    spread = (
        placed.join(blocks, "component")
        .withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "cid", "n", "l", "prefix", "s")
    )

    def tile(rows: list[tuple]) -> pa.RecordBatch:
        cid = np.array([r[3] for r in rows], np.int64)
        root = joined_classes(cid, np.array([r[4] for r in rows]), np.array([r[5] for r in rows]), [np.frombuffer(r[6], np.uint64) for r in rows], [np.frombuffer(r[7], np.uint64) for r in rows], percent)
        linked = np.flatnonzero(root != np.arange(len(rows)))
        return pa.RecordBatch.from_arrays([pa.array(cid[linked]), pa.array(cid[root[linked]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key and rows:
                    yield tile(rows)
                    rows = []
                key = row[:3]
                rows.append(row)
        if rows:
            yield tile(rows)

    dealt = spread.repartition(partitions(chosen), "component", "i", "j").sortWithinPartitions("component", "i", "j", "cid")
    return dealt.mapInArrow(run, EDGE)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased. A text of fewer than ``size`` words has its whole
    sequence as one shingle; a null text, or one without words, has none and links with nothing. Rows with equal
    sets link. Rows that share a doc_id keep their own texts and components; a row with a null doc_id takes part in
    no link and gets a null component_id. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = materialise(shingle_keys(docs, size), "keys")
    classes = keys.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("cid"), F.min("n").alias("n"))
    lone = lonely_shingles(docs.where("doc_id is not null"), size)
    misses = F.col("n") - F.expr(f"(n * {percent} + 99) div 100")
    alive = classes.join(lone, "k1", "left").where(F.coalesce("lone", F.lit(0)) <= misses).select("cid", "k1", "k2")
    table = shingle_table(docs, alive, size)
    chosen = prefixes(table, frequencies(table), percent)
    clusters = components(cluster_edges(chosen))
    links = components(verified_links(chosen, clusters, percent))
    named = classes.join(links.withColumnRenamed("id", "cid"), "cid", "left").select("k1", "k2", F.coalesce("component", "cid").alias("_c"))
    return keys.join(named, ["k1", "k2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("_c")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose component has a smaller doc_id.

    Rows that share a doc_id stay or go together; rows with a null doc_id stay.
    """
    gone = near_duplicates(docs, **options).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
