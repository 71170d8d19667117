"""Packing of tokenised documents into sequences by lexical retrieval.

Documents are tokenised once and stored as packed token ids. What fills whole sequences is cut off at once; the rest
of each document, shorter than a sequence, is dealt to index shards of bounded size. Shards are ranges of a lexical
signature (two minimum hashes of the token set), so documents with like words meet, and copies stand side by side; a
group of any size spreads over as many shards as it fills, because the row's hash ends the range key. Each shard
holds a BM25 inverted index; its document frequencies and mean length are those of the rests of all documents, without
what was cut off as whole sequences. A seed document fetches its unused neighbours in the shard, best first; those that fit go into its window whole, and the next one is cut to fill it, its
remainder being the next seed. So every sequence of a shard is full, but the last, which is cut at powers of two.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.textual import mix, text_batches, word_places
from papyrine.session import materialise

WINDOW = 4096
END = 2  # the id that closes each document
SHARD_TOKENS = 4 << 20
TERMS = 12  # tokens of a seed that make its query, the weightiest ones
RANKED = 64  # best neighbours that are put in order first; twice as many follow each time the window has room left
K1, B = 1.2, 0.75
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# The printable bytes that byte-level vocabularies write as themselves (the others follow from 256 on),
# and how the tokenizer cuts lower-case words into pieces.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


class WordTokenizer:
    """Token ids of whole texts, made word by word.

    The tokenizer's pieces never cross white space, so each distinct word between the six ASCII separators is
    encoded once per task. Words of ASCII and Latin-1 letters, which no normalisation but lower case touches, are cut
    into pieces here and go through the tokenizer's model in long runs: every piece ends in a token that ends a word,
    which tells them apart. All other words take the whole tokenizer. Tests compare the ids with those of whole texts.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        assert max(vocabulary.values()) < 1 << 16, "token ids must fit 16 bits"
        self.closes = np.zeros(1 << 16, bool)
        for token, i in vocabulary.items():
            self.closes[i] = token.endswith("</w>")
        other = iter(range(256, 512))
        letter = {b: chr(b) if b in PRINTABLE else chr(next(other)) for b in range(256)}
        self.written = {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}  # words by hash
        self.flat, self.begin = np.zeros(0, np.uint16), np.zeros(1, np.int64)
        self.pieces: dict[str, int] = {}
        self.piece_ids, self.piece_begin = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def encode_pieces(self, new: list[str]) -> None:
        """Encode pieces that are new, all at once."""
        runs = [" ".join(p if p.isascii() else p.translate(self.written) for p in new[i : i + 512]) for i in range(0, len(new), 512)]
        ids = np.array([i for e in self.model.encode_batch_fast(runs, add_special_tokens=False) for i in e.ids], np.uint16)
        ends = np.flatnonzero(self.closes[ids]) + 1
        assert len(ends) == len(new), "a piece must end in one closing token"
        self.piece_begin = np.concatenate([self.piece_begin, self.piece_begin[-1] + ends])
        self.piece_ids = np.concatenate([self.piece_ids, ids])

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of words that are new to this task."""
        pieces, fresh, used, counts, odd = self.pieces, [], [], [], []
        for k, w in enumerate(new):
            if not PLAIN.fullmatch(w) or "<|" in w:
                odd.append(k)
                counts.append(0)
                continue
            w = w.lower()
            if w.isalpha():
                cut = (w,)
            elif w[-1] in ".,;:!?" and w[:-1].isalpha():
                cut = (w[:-1], w[-1])
            else:
                cut = PIECES.findall(w)
            for p in cut:
                i = pieces.get(p)
                if i is None:
                    i = pieces[p] = len(pieces)
                    fresh.append(p)
                used.append(i)
            counts.append(len(cut))
        if fresh:
            self.encode_pieces(fresh)
        at = np.array(used, np.int64)
        size = self.piece_begin[at + 1] - self.piece_begin[at]
        flat = gathered(self.piece_ids, self.piece_begin[at], size)
        ends = np.append(0, np.cumsum(size))[np.cumsum(counts)]
        if odd:
            slow = [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch([new[k] for k in odd], add_special_tokens=False)]
            flat = np.insert(flat, np.repeat(ends[odd], [len(x) for x in slow]), np.concatenate(slow))
            more = np.zeros(len(new), np.int64)
            more[odd] = [len(x) for x in slow]
            ends = ends + np.cumsum(more)
        return flat, ends

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Token ids of every text, without the closing id."""
        words, cut, starts, stops = word_places(texts)
        names, first, code = np.unique(words, return_index=True, return_inverse=True)
        known = self.known
        at = [known.get(h, -1) for h in names.tolist()]
        missing = [k for k, i in enumerate(at) if i < 0]
        if missing:
            data = b"\n".join(texts)
            new = [data[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[missing]].tolist(), stops[first[missing]].tolist(), strict=True)]
            flat, ends = self.learn(new)
            self.begin = np.concatenate([self.begin, self.begin[-1] + ends])
            self.flat = np.concatenate([self.flat, flat])
            for k in missing:
                at[k] = known[int(names[k])] = len(known)
        place = np.array(at, np.int64)[code] if len(code) else code
        size = self.begin[place + 1] - self.begin[place]
        flat = gathered(self.flat, self.begin[place], size)
        out = np.split(flat, np.append(0, np.cumsum(size))[cut[1:-1]])
        if len(known) > 1 << 20:  # bounded memory, whatever the texts hold
            self.forget()
        return out


def gathered(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that start at ``begin``, one after another."""
    ends = np.cumsum(size)
    return values[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


# Two random orders of the token ids.
_ORDERS = (mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64)) >> np.uint64(33), mix(np.arange(1 << 16, 1 << 17, dtype=np.uint64)) >> np.uint64(33))


def signature(ids: np.ndarray) -> int:
    """Two minimum hashes of the token set, the first in the high half."""
    return int(_ORDERS[0][ids].min()) << 31 | int(_ORDERS[1][ids].min())


def token_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n, whole, rest, signature, salt) of every row: tokens with the closing id, packed checksums of the
    whole windows, the packed ids after them, and the keys that deal rows to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = None
        for batch, texts in text_batches(batches, limit=2 << 20):  # fewer lookups of the words that chunks share
            tokenizer = tokenizer or WordTokenizer(path)
            out = []
            for ids in tokenizer.ids(texts):
                ids = np.append(ids, np.uint16(END))
                full = len(ids) // WINDOW
                whole = np.array([crc(ids[i * WINDOW : (i + 1) * WINDOW]) for i in range(full)], np.int64)
                rest = ids[full * WINDOW :]
                out.append((len(ids), whole.tobytes(), rest.tobytes(), signature(rest) if len(rest) else 0))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "salt", "n", "whole", "rest", "signature"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("salt"))
    return materialise(rows.mapInArrow(run, "doc_id long, salt long, n long, whole binary, rest binary, signature long"), "tokens")


def statistics(table: DataFrame) -> tuple[np.ndarray, int, int]:
    """(document frequency by token id, rows, tokens) of the rests of all documents; the vocabulary bounds its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << 16, np.int64)
        rows, tokens = 0, 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 1 << 10):
                lists = [np.frombuffer(x, np.uint16) for x in batch.column(0).slice(begin, 1 << 10).to_pylist()]
                size = [len(x) for x in lists]
                pair = np.sort(np.repeat(np.arange(len(lists), dtype=np.uint32) << np.uint32(16), size) | np.concatenate(lists))
                first = np.append(True, pair[1:] != pair[:-1])[: len(pair)]
                df += np.bincount(pair[first] & np.uint32(0xFFFF), minlength=1 << 16)
                rows += len(lists)
                tokens += len(pair)
        some = np.flatnonzero(df)
        token = np.concatenate([some, [-1, -2]])
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.concatenate([df[some], [rows, tokens]]))], ["token", "n"])

    sums = table.select("rest").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    got = {r.token: r.n for r in sums.collect()}  # at most 65,538 rows
    df = np.zeros(1 << 16, np.int64)
    for token, n in got.items():
        if token >= 0:
            df[token] = n
    return df, got.get(-1, 0), got.get(-2, 0)


class Shard:
    """An inverted index of some documents, which hands out each document once."""

    def __init__(self, docs: list[np.ndarray], df: np.ndarray, rows: int, tokens: int):
        self.docs = docs
        d = len(docs)
        size = np.array([len(x) for x in docs], np.int64)
        code = np.concatenate(docs).astype(np.int64) << 32 | np.repeat(np.arange(d), size)
        code, tf = np.unique(code, return_counts=True)
        self.token, self.doc = code >> 32, code & 0xFFFFFFFF
        idf = np.log1p((rows - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / max(1.0, tokens / max(1, rows)))
        self.weight = idf[self.token] * tf * (K1 + 1) / (tf + norm[self.doc])
        self.begin = np.searchsorted(self.token, np.arange((1 << 16) + 1))
        self.by = np.argsort(self.doc, kind="stable")  # the entries of each document
        self.first = np.searchsorted(self.doc[self.by], np.arange(d + 1))
        self.unused = np.ones(d, bool)
        self.size = size
        self.next = 0

    def any(self) -> int | None:
        """The first unused document in shard order."""
        while self.next < len(self.docs) and not self.unused[self.next]:
            self.next += 1
        return self.next if self.next < len(self.docs) else None

    def scored(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """All unused documents with a BM25 score for the seed's weightiest tokens, and the scores."""
        own = self.by[self.first[seed] : self.first[seed + 1]]
        if len(own) > TERMS:
            own = own[np.argpartition(-self.weight[own], TERMS)[:TERMS]]
        query = self.token[own]
        lists = [slice(self.begin[t], self.begin[t + 1]) for t in query]
        score = np.bincount(np.concatenate([self.doc[x] for x in lists]), np.concatenate([self.weight[x] for x in lists]), len(self.docs))
        found = np.flatnonzero((score > 0) & self.unused)
        return found, score[found]

    def neighbours(self, seed: int) -> np.ndarray:
        """The same documents, all in order, best first; windows put only as many in order as they need."""
        found, score = self.scored(seed)
        return found[np.argsort(-score, kind="stable")]

    def sequences(self) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences of (document, begin, end); all but the last have exactly WINDOW tokens."""
        left: tuple[int, int] | None = None  # a document that was cut, and where
        while True:
            if left is None:
                seed = self.any()
                if seed is None:
                    return
                self.unused[seed] = False
                left = (seed, 0)
            seed, begin = left
            left = None
            pieces = [(seed, begin, len(self.docs[seed]))]
            room = WINDOW - (len(self.docs[seed]) - begin)
            found, score = self.scored(seed) if room else (np.zeros(0, np.int64), np.zeros(0))
            skipped, run = None, RANKED
            while room and len(found):
                if skipped is not None:  # the piece that is cut is known, so only what fits whole is looked for
                    fits = self.size[found] <= room
                    found, score = found[fits], score[fits]
                by = np.argpartition(-score, run) if len(found) > run else np.arange(len(found))
                best = np.sort(by[:run])
                for d in found[best[np.argsort(-score[best], kind="stable")]].tolist():
                    if self.size[d] <= room:
                        self.unused[d] = False
                        pieces.append((d, 0, len(self.docs[d])))
                        room -= len(self.docs[d])
                        if not room:
                            break
                    elif skipped is None:
                        skipped = d
                found, score, run = found[by[run:]], score[by[run:]], 2 * run
            while room:
                d = skipped if skipped is not None else self.any()
                skipped = None
                if d is None:
                    break
                self.unused[d] = False
                take = min(room, len(self.docs[d]))
                pieces.append((d, 0, take))
                room -= take
                if take < len(self.docs[d]):
                    left = (d, take)
            yield pieces


def powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """A short sequence as sequences whose lengths are powers of two, the largest first."""
    total = sum(e - b for _, b, e in pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        need = total & (1 << bit)
        part = []
        while need:
            d, b, e = pieces[0]
            take = min(need, e - b)
            part.append((d, b, b + take))
            need -= take
            pieces = [(d, b + take, e), *pieces[1:]] if b + take < e else pieces[1:]
        if part:
            yield part


def pack(docs: DataFrame, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece of a row of ``docs``.

    Every row has its tokens and the id 2 after them, a null or empty text that id alone. Each id lies in exactly one
    piece. Sequences have 4096 ids or a power of two of them, so none needs padding. Rows with equal or null doc_ids
    are packed each for itself; other columns are ignored; an empty table gives no rows.
    """
    table = token_table(docs, path)
    df, rows, tokens = statistics(table)
    shards = max(1, -(-tokens // shard_tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        got.sort(key=lambda r: (r[4], r[5]))
        number = TaskContext.get().partitionId() << 32
        out = []
        for doc, n, whole, _, _, _ in got:
            for i, check in enumerate(np.frombuffer(whole, np.int64).tolist()):
                out.append((doc, i * WINDOW, WINDOW, check, n, number, 0))
                number += 1
        rests = [(r[0], r[1], np.frombuffer(r[3], np.uint16)) for r in got if r[3]]
        del got
        if rests:
            for pieces in Shard([r[2] for r in rests], df, rows, tokens).sequences():
                full = sum(e - b for _, b, e in pieces) == WINDOW
                for part in [pieces] if full else powers(pieces):
                    offset = 0
                    for d, b, e in part:
                        doc, n, ids = rests[d]
                        out.append((doc, n - len(ids) + b, e - b, crc(ids[b:e]), n, number, offset))
                        offset += e - b
                    number += 1
        for begin in range(0, len(out), 1 << 14):
            columns = zip(*out[begin : begin + (1 << 14)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    dealt = table.select("doc_id", "n", "whole", "rest", "signature", "salt").repartitionByRange(shards, "signature", "salt")
    return dealt.mapInArrow(run, PIECE)
