"""Spelling variants by Bloom-guided edit neighbourhoods.

Words of all texts are counted; two words are near when exactly one inserted, deleted or replaced code point tells them
apart. Every word's edits are generated (all deletions, and all replacements by a letter that comes earlier in the
alphabet, so each pair is met once: an insertion is the other word's deletion) and probed against blocked Bloom filters
of the vocabulary, one per word length. Only edits that a filter holds leave their task; an exact join with the
vocabulary removes the false ones. A word's form is its most frequent near word, if that is at least twice as frequent;
its root is where following forms ends.

How it is spread: counting is an aggregate with map-side combine. Filters hold at most ``SHARD`` words each, built by
the task that has the shard, and are broadcast in slices of at most ``SLICE`` bytes, whose sizes are known from the
counts per length before anything is sent; each slice is one pass over the words whose edits have its lengths, so a
vocabulary of any size is probed whole. Hashes of edits are sums over places, so an edit's hash takes a few array
operations and no string. A word has at most 180 near words per letter, which bounds every group of the last joins.

Null texts have no words. A null key is the empty text in the rule that picks an occurrence to shorten. Repeated rows
count as often as they occur. An empty table gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.textual import mix, partitions
from papyrine.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZE = 90  # letters after lower-casing: a-z and U+00C0 to U+00FF
LONG = 65  # words of this length or more share filters
SHARD = 1 << 16  # words of one filter
BITS = 16  # of a filter for each word
SLICE = 32 << 20  # bytes of filters sent at a time
PROBES = 1 << 18  # edits hashed at a time
SHORTENED = 97  # one occurrence in so many loses a letter


def words(docs: DataFrame, text: str = "text", key: str = "doc_id", shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): the words of at least ``shortest`` letters that occur at least ``least`` times."""
    named = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("d"), F.col(text).alias("t"))
    run = named.select("d", F.explode(F.regexp_extract_all("t", F.lit(f"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))).alias("r"))
    # lower() of a text of bytes touches A-Z alone; others keep their accented capitals.
    plain = F.octet_length("r") == F.length("r")
    low = run.select("d", F.when(plain, F.lower("r")).otherwise(F.translate("r", UPPER, LOWER)).alias("r"))
    picked = low.select("r", F.crc32(F.concat("d", F.lit(":"), "r")).alias("h"))
    at = F.pmod("h", F.length("r")).cast("int")
    shorter = F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.length("r")))
    word = picked.select(F.when(F.col("h") % SHORTENED == 0, shorter).otherwise(F.col("r")).alias("word"))
    return word.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def codes(text: list[str]) -> np.ndarray:
    """Letters 0 to SIZE-1 of words of one length, one word a row."""
    points = np.frombuffer("".join(text).encode("utf-16-le"), np.uint16).reshape(len(text), -1)
    return np.where(points < 128, points - 97, points - 0xC0 + 26).astype(np.uint8)


def letter(code: int) -> str:
    return chr(code + 97 if code < 26 else code - 26 + 0xC0)


def letters_at(start: int, stop: int) -> np.ndarray:
    """The hash of every letter at places start to stop-1."""
    at = np.arange(start, stop, dtype=np.uint64)[:, None] * np.uint64(128) + np.arange(SIZE, dtype=np.uint64) + np.uint64(1)
    return mix(at * np.uint64(0x9E3779B97F4A7C15))


def finished(total: np.ndarray, length: int) -> np.ndarray:
    """A word's hash from the sum over its letters."""
    return mix(total + np.uint64((length * 0xD1342543DE82EF95) & ((1 << 64) - 1)))


def hashes(table: np.ndarray) -> np.ndarray:
    """Hash of every row of letters."""
    total = np.zeros(len(table), np.uint64)
    for a in range(0, table.shape[1], 4096):
        part = table[:, a : a + 4096]
        total += letters_at(a, a + part.shape[1])[np.arange(part.shape[1]), part].sum(1, dtype=np.uint64)
    return finished(total, table.shape[1])


def by_length(text: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words of equal length, and their letters."""
    lengths = np.fromiter(map(len, text), np.int64, len(text))
    order = np.argsort(lengths, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(part):
            same = [text[i] for i in part]
            yield same, codes(same)


def place_of(h: np.ndarray, subs: int) -> np.ndarray:
    """Which of a length's filters a hash belongs to."""
    return (mix(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(subs)).astype(np.int64)


def block_of(h: np.ndarray, blocks: np.ndarray | int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.asarray(blocks, np.uint64)) >> np.uint64(32)).astype(np.int64)


def lane(h: np.ndarray, k: int) -> np.ndarray:
    """The two bits that a hash sets in word ``k`` of its block of four."""
    one = np.uint64(1)
    low = np.uint64(6)
    x = mix(h + np.uint64(k))
    return (one << (x & np.uint64(63))) | (one << ((x >> low) & np.uint64(63)))


def blocks_for(n: int) -> int:
    """Blocks of 256 bits of a filter for n words."""
    return max(4, -(-n * BITS // 256))


def bloom(h: np.ndarray, n: int) -> np.ndarray:
    """A filter laid out for ``n`` words that holds the hashes."""
    bits = np.zeros((blocks_for(n), 4), np.uint64)
    at = block_of(h, len(bits))
    for k in range(4):
        np.bitwise_or.at(bits[:, k], at, lane(h, k))
    return bits


class Slice:
    """Some filters in one array, and where each begins; probes for filters of other slices find nothing."""

    def __init__(self, subs: dict[int, int], sizes: dict[tuple[int, int], int], bits: dict[tuple[int, int], bytes]):
        self.subs = subs
        self.begin = {c: np.full(n, -1, np.int64) for c, n in subs.items()}
        self.blocks = {c: np.zeros(n, np.int64) for c, n in subs.items()}
        at, parts = 0, []
        for (c, s), data in bits.items():
            part = np.frombuffer(data, np.uint64).reshape(-1, 4)
            if len(part) != blocks_for(sizes[c, s]):
                raise ValueError("a filter's size differs from its word count")
            self.begin[c][s], self.blocks[c][s] = at, len(part)
            parts.append(part)
            at += len(part)
        self.bits = np.concatenate(parts)
        self.classes = {c for c, _ in bits}

    def has(self, length: int) -> bool:
        return min(length, LONG) in self.classes

    def holds(self, h: np.ndarray, length: int) -> np.ndarray:
        """Places of the hashes that the filters of this length may hold."""
        c = min(length, LONG)
        sub = place_of(h, self.subs[c])
        left = np.flatnonzero(self.begin[c][sub] >= 0)
        sub, h = sub[left], h[left]
        row = self.begin[c][sub] + block_of(h, self.blocks[c][sub])
        for k in range(4):
            want = lane(h, k)
            yes = (self.bits[row, k] & want) == want
            left, row, h = left[yes], row[yes], h[yes]
        return left


def _edits(text: list[str], table: np.ndarray, filters: Slice) -> Iterator[tuple[str, str]]:
    """(word, edit) for the deletions and replacements of words of one length that the filters may hold."""
    n, length = table.shape
    # Prefix sums of the letters at their places, suffix sums of the letters one place further left.
    total = np.zeros(n, np.uint64)
    moved = np.zeros(n, np.uint64)
    span = max(1, min(length, 4096))
    for a in range(0, length, span):
        part = table[:, a : a + span]
        value = letters_at(a, a + part.shape[1])
        total += value[np.arange(part.shape[1]), part].sum(1, dtype=np.uint64)
        if a + part.shape[1] > 1:
            left = letters_at(max(a - 1, 0), a + part.shape[1] - 1)
            inner = part if a else part[:, 1:]
            moved += left[np.arange(inner.shape[1]), inner].sum(1, dtype=np.uint64)
    shorter, same = filters.has(length - 1) and length > 1, filters.has(length)
    before = np.zeros(n, np.uint64)  # letters left of the place
    after = moved.copy()  # letters right of the place, moved one to the left
    alphabet = np.arange(SIZE)
    for a in range(0, length, span):
        part = table[:, a : a + span]
        value = letters_at(max(a - 1, 0), a + part.shape[1])
        for j in range(part.shape[1]):
            i = a + j
            here = value[i - max(a - 1, 0)]
            own = part[:, j]
            if i:
                after -= value[i - 1 - max(a - 1, 0)][own]
            if shorter:
                # Of a run of equal letters only the first is deleted.
                new = np.flatnonzero(own != table[:, i - 1]) if i else np.arange(n)
                for w in new[filters.holds(finished(before[new] + after[new], length - 1), length - 1)].tolist():
                    yield text[w], text[w][:i] + text[w][i + 1 :]
            if same:
                rows, letters = np.nonzero(alphabet < own[:, None])
                h = finished((total - here[own])[rows] + here[letters], length)
                for x in filters.holds(h, length).tolist():
                    w = int(rows[x])
                    yield text[w], text[w][:i] + letter(int(letters[x])) + text[w][i + 1 :]
            before += here[own]


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, near) with near a word of the vocabulary one edit away, in both directions; ``vocabulary`` is stored."""
    spark, parts = vocabulary.sparkSession, partitions(vocabulary)
    kind = F.least(F.length("word"), F.lit(LONG))
    counts = {r[0]: r[1] for r in vocabulary.groupBy(kind.alias("c")).agg(F.count("*")).collect()}  # at most LONG rows
    subs = {c: -(-n // SHARD) for c, n in counts.items()}

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, table in by_length(batch.column(0).to_pylist()):
                c = min(table.shape[1], LONG)
                h = hashes(table)
                sub = place_of(h, subs[c])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), c, np.int32)), pa.array(sub.astype(np.int32)), pa.array(h.view(np.int64))], ["c", "s", "h"])

    def build(group: pa.Table) -> pa.Table:
        h = group.column("h").to_numpy().view(np.uint64)
        one = group.slice(0, 1)
        return pa.table({"c": one.column("c"), "s": one.column("s"), "n": pa.array([len(h)], pa.int64()), "bits": pa.array([bloom(h, len(h)).tobytes()], pa.binary())})

    dealt = vocabulary.select("word").mapInArrow(sharded, "c int, s int, h long")
    filters = materialise(dealt.groupBy("c", "s").applyInArrow(build, "c int, s int, n long, bits binary"), "filters")
    sizes = {(r.c, r.s): r.n for r in filters.select("c", "s", "n").orderBy("c", "s").collect()}
    found = None
    for part in _slices(sizes):
        low, high = part[0], part[-1]
        rows = filters.where(F.struct("c", "s").between(F.struct(*map(F.lit, low)), F.struct(*map(F.lit, high)))).collect()
        sent = spark.sparkContext.broadcast(Slice(subs, sizes, {(r.c, r.s): bytes(r.bits) for r in rows}))

        def probe(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for text, table in by_length(batch.column(0).to_pylist()):
                    step = max(1, PROBES // SIZE)
                    for a in range(0, len(text), step):
                        pairs = list(_edits(text[a : a + step], table[a : a + step], sent.value))
                        w, e = zip(*pairs, strict=True) if pairs else ((), ())
                        yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(e, pa.string())], ["word", "near"])

        asked = vocabulary.select("word").where(F.length("word").between(low[0], high[0] + 1) | (F.length("word") >= LONG if high[0] == LONG else F.lit(False)))
        edits = asked.repartition(parts).mapInArrow(probe, "word string, near string")
        edits = materialise(edits.join(vocabulary.select(F.col("word").alias("near")), "near", "left_semi").select("word", "near"), "edits")
        found = edits if found is None else found.unionByName(edits)
    if found is None:
        return vocabulary.select("word", F.col("word").alias("near")).limit(0)
    return found.unionByName(found.select(F.col("near").alias("word"), F.col("word").alias("near")))


def _slices(sizes: dict[tuple[int, int], int]) -> Iterator[list[tuple[int, int]]]:
    """Filters in order, cut where ``SLICE`` bytes are full."""
    now, full = [], 0
    for k, n in sorted(sizes.items()):
        size = blocks_for(n) * 32
        if now and full + size > SLICE:
            yield now
            now, full = [], 0
        now.append(k)
        full += size
    if now:
        yield now


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by doubling: each round follows as many forms again as all before; counts at least double with
    every form, so a handful of rounds suffices."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialise(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not after.where("moved").limit(1).count():
            return after.select("word", "root")
        now = after.select("word", "root")


def group(docs: DataFrame, text: str = "text", key: str = "doc_id", shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the texts."""
    vocabulary = materialise(words(docs, text, key, shortest, least), "vocabulary")
    near = neighbours(vocabulary).join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("b"))
    joined = vocabulary.join(best, "word", "left")
    is_form = -F.col("b.m") >= 2 * F.col("n")
    formed = materialise(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("b.near")).alias("form"), F.when(is_form, -F.col("b.m")).alias("form_n")), "forms"
    )
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

