"""Token counts by linear longest match.

A word's pieces are the greedy ones: from left to right always the longest entry of the vocabulary. A trie of the
vocabulary gets failure links that pop pieces: when no edge goes on from a node, the node's popped pieces are final
and the walk goes on from the node that spells the rest. Here a node keeps the number of popped pieces only, so a
walk that looks at each byte once gives the length in pieces, and no piece is ever built.

The vocabulary holds byte strings, some of which end a word; the end is one more symbol, which closes every walk. An
entry with it is the longer match where a word ends; where there is none, the entry without it closes the word.
Distinct words of a chunk walk together in numpy, one byte of each per step. Texts are read whole in one pass without
a shuffle; the automaton travels with the tasks and is as large as the vocabulary.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.packing import PRINTABLE
from papyrine.llm.textual import text_batches, word_places

END = 256  # the symbol after a word's last byte
SYMBOLS = 257
KNOWN = 1 << 20  # words remembered in a task at most


def read_vocabulary(path: str | None = None) -> list[list[int]]:
    """Entries as symbols, from a tokenizers file of byte-level entries with ``</w>`` at word ends."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    other = iter(range(256, 512))
    byte = {chr(b) if b in PRINTABLE else chr(next(other)): b for b in range(256)}
    suffix = model.get("end_of_word_suffix") or ""
    entries = []
    for token in model["vocab"]:
        ends = bool(suffix) and token.endswith(suffix)
        spelt = token[: -len(suffix)] if ends else token
        if spelt and all(c in byte for c in spelt):
            entries.append([byte[c] for c in spelt] + [END] * ends)
    return entries


class Automaton:
    """Trie edges in a hash table of arrays, failure links and popped-piece counts.

    Node 0 is the root. ``fail`` is -1 where nothing can be popped: a word that ends up there has no pieces, and
    counts as one unknown token.
    """

    def __init__(self, entries: list[list[int]]):
        edges: dict[int, int] = {}
        parent, symbol, final = [-1], [-1], [False]
        for entry in [*entries, [END]]:  # the end by itself can always be read; it is no piece
            node = 0
            for s in entry:
                key = node * SYMBOLS + s
                node = edges.get(key, 0)
                if not node:
                    node = edges[key] = len(parent)
                    parent.append(key // SYMBOLS)
                    symbol.append(s)
                    final.append(False)
            final[node] = True
        n = len(parent)
        depth = [0] * n
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        fail, pops = [-1] * n, [0] * n
        for v in sorted(range(1, n), key=depth.__getitem__):  # breadth first
            if final[v]:
                fail[v], pops[v] = 0, int(parent[v] != 0 or symbol[v] != END)
                continue
            u = parent[v]
            z, popped = fail[u], pops[u]
            while z != -1 and z * SYMBOLS + symbol[v] not in edges:
                popped += pops[z]
                z = fail[z]
            if z != -1:
                fail[v], pops[v] = edges[z * SYMBOLS + symbol[v]], popped
        self.fail, self.pops = np.array(fail, np.int32), np.array(pops, np.int32)
        keys = np.array(sorted(edges), np.int64)
        self.keys, self.targets = keys, np.array([edges[k] for k in keys.tolist()], np.int32)
        self.prepare()

    def prepare(self) -> None:
        """Rows of targets for the nodes that have children; all others share row 0."""
        node = self.keys // SYMBOLS
        owners = np.unique(node)
        self.row = np.zeros(len(self.fail), np.int32)
        self.row[owners] = np.arange(1, len(owners) + 1)
        self.table = np.zeros((len(owners) + 1) * SYMBOLS, np.int32)
        self.table[self.row[node].astype(np.int64) * SYMBOLS + self.keys % SYMBOLS] = self.targets

    def state(self) -> tuple[np.ndarray, ...]:
        return self.fail, self.pops, self.keys, self.targets

    @classmethod
    def of(cls, state: tuple[np.ndarray, ...]) -> Automaton:
        out = cls.__new__(cls)
        out.fail, out.pops, out.keys, out.targets = state
        out.prepare()
        return out

    def counts(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Pieces of each word data[start:stop]; 1 for a word that the vocabulary can't spell."""
        order = np.argsort(start - stop, kind="stable")  # long words first, so those still walking are in front
        start, size = start[order], (stop - start)[order]
        node, total = np.zeros(len(start), np.int32), np.zeros(len(start), np.int64)
        lost = np.zeros(len(start), bool)
        for t in range(int(size[0]) + 1 if len(size) else 0):
            live = int(np.searchsorted(-size, -t, side="right"))
            s = np.full(live, END, np.int64)
            inside = size[:live] > t
            s[inside] = data[start[:live][inside] + t]
            walk = np.flatnonzero(~lost[:live])
            while len(walk):
                to = self.table[self.row[node[walk]].astype(np.int64) * SYMBOLS + s[walk]]
                done = to > 0
                node[walk[done]] = to[done]
                walk = walk[~done]
                total[walk] += self.pops[node[walk]]
                node[walk] = self.fail[node[walk]]
                off = node[walk] < 0
                lost[walk[off]] = True
                node[walk[off]] = 0
                walk = walk[~off]
        # After the end symbol a node spells the rest of the word; pop what is left.
        walk = np.flatnonzero(~lost & (node > 0))
        while len(walk):
            total[walk] += self.pops[node[walk]]
            node[walk] = self.fail[node[walk]]
            off = node[walk] < 0
            lost[walk[off]] = True
            walk = walk[~off & (node[walk] > 0)]
        total[lost] = 1
        out = np.empty_like(total)
        out[order] = total
        return out


def token_counts(docs: DataFrame, path: str | None = None, entries: list[list[int]] | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens for every row of ``docs`` (doc_id, text).

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased, as UTF-8 bytes. A null or empty text has no words and
    no tokens. Rows may repeat and doc_ids may be null; other columns are ignored; an empty table gives no rows.
    """
    automaton = Automaton(read_vocabulary(path) if entries is None else entries)
    sent = docs.sparkSession.sparkContext.broadcast(automaton.state())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton.of(sent.value)
        known: dict[int, int] = {}
        for batch, texts in text_batches(batches):
            texts = [t.lower() for t in texts]
            words, cut, start, stop = word_places(texts)
            names, first, code = np.unique(words, return_index=True, return_inverse=True)
            found = [known.get(h, -1) for h in names.tolist()]
            new = np.array([k for k, n in enumerate(found) if n < 0], np.int64)
            size = np.array(found, np.int64)
            if len(new):
                data = np.frombuffer(b"\n".join(texts), np.uint8)
                size[new] = machine.counts(data, start[first[new]], stop[first[new]])
                if len(known) > KNOWN:
                    known.clear()
                known.update(zip(names[new].tolist(), size[new].tolist(), strict=True))
            sums = np.append(0, np.cumsum(size[code])) if len(code) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(cut), pa.int64()), pa.array(np.diff(sums[cut]), pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
