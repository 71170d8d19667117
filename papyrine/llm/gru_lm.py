"""Language-model scores of whole documents by a gated recurrent network in numpy.

Words and one end token make a document. Counts of all training words come from every training document, packed per
batch and summed by hash; they give the unigram base, the network's vocabulary and the distribution of all other
words. The network reads and predicts the most frequent words, as many as make up ``SHARE`` of all tokens, and a
common symbol for the rest:

* a gated recurrent cell, whose state starts at zero in each document and is carried from window to window, so
  scores cover complete documents of any length;
* a class-factored softmax: a token's probability is that of its class times that of the word in its class, and
  both start at the corpus counts; classes of like sums of ``freq ** 0.6`` keep both parts small;
* training by truncated backpropagation: gradients stop at window borders, the state does not. Tasks train copies of
  the network on their own documents, copies are averaged by token counts in a tree, and the next round starts from
  the average. Each round takes another of ``slices`` hash slices of the training documents, until every training
  document has been learned from once.

A word outside the vocabulary has the probability of the common symbol times (c + 1) / (N' + V' + 1) over those
words. Counts of the ``FREQUENT`` most frequent words travel with the tasks; the counts of all others are fetched by
block, from the partition that holds the word's hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.textual import by_partition, joined, mix, partitions, text_batches, word_hashes
from papyrine.session import materialise

FREQUENT = 1 << 17
SHARE = 0.6  # of all tokens: the network's words make it up
LEAST, MOST = 1024, 1 << 15  # words of the network, whatever the share; eight sums of networks must fit the driver
HIDDEN, CLASSES, WINDOW = 24, 32, 24
MANY = 32  # tokens of a symbol in a window
LONG = 20 * WINDOW  # training documents of more tokens start before others
END = np.uint64(0x1F3D5B79A8C6E402)  # stands for the end token among word hashes
GATHER = 16 << 20


def count_words(docs: DataFrame) -> DataFrame:
    """(p, h, c): packed word hashes and counts of all training documents; p is the partition that owns the hash."""
    parts = partitions(docs)

    def pack(counted: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, code = np.unique(np.concatenate([x for x, _ in counted]), return_inverse=True)
        c = np.bincount(code, np.concatenate([x for _, x in counted]), len(h)).astype(np.int64)
        rows = list(by_partition((mix(h) % np.uint64(parts)).astype(np.int64), parts, h, c))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["p", "h", "c"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, gathered = [], 0
        for _, texts in text_batches(batches):
            words, _ = word_hashes([t.lower() for t in texts])
            words = np.concatenate([words, np.full(len(texts), END)])
            counted.append(np.unique(words, return_counts=True))
            gathered += sum(map(len, texts))
            if gathered > GATHER:
                yield pack(counted)
                counted, gathered = [], 0
        if counted:
            yield pack(counted)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(*(x.to_pylist() for x in b.columns), strict=True)]
        for p in sorted({r[0] for r in got}):
            own = [r for r in got if r[0] == p]
            h, code = np.unique(joined((r[1] for r in own), np.uint64), return_inverse=True)
            c = np.bincount(code, joined((r[2] for r in own), np.int64), len(h)).astype(np.int64)
            for a in range(0, len(h), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([h[a : a + (1 << 18)].tobytes()], pa.binary()), pa.array([c[a : a + (1 << 18)].tobytes()], pa.binary())], ["p", "h", "c"])

    kind = "p int, h binary, c binary"
    return materialise(docs.select("text").mapInArrow(send, kind).repartition(parts, "p").mapInArrow(add, kind), "words")


class WordTable:
    """Counts of the most frequent words by hash, with a directory by leading bits, and the totals of all words."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, distinct: int, vocabulary: int):
        self.state = (hashes, counts, tokens, distinct, vocabulary)  # what a task needs to build the table anew
        order = np.argsort(hashes)
        self.hash, self.count = hashes[order], counts[order]
        self.tokens, self.distinct = tokens, distinct
        rank = np.lexsort((self.hash, -self.count))[:vocabulary]
        if END in self.hash and END not in self.hash[rank]:
            rank = np.append(rank, np.searchsorted(self.hash, END))
        if END not in self.hash:  # nothing to learn from
            self.hash, self.count, rank = np.array([END]), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.words = len(rank)
        self.id = np.full(len(self.hash), self.words, np.int32)  # the common symbol
        self.id[rank] = np.arange(self.words)
        self.freq = self.count[rank].astype(np.float64)
        self.end = int(self.id[np.searchsorted(self.hash, END)])
        self.rest_tokens, self.rest_distinct = tokens - int(self.freq.sum()), distinct - int((self.freq > 0).sum())
        self.start = np.searchsorted(self.hash, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash in the table, or -1."""
        out = np.minimum(self.start[(h >> np.uint64(46)).astype(np.int64)], len(self.hash) - 1)
        there = self.hash[out]
        todo = np.flatnonzero(there < h)  # few after a step, for hashes are in order
        out[there > h] = -1
        while len(todo):
            at = out[todo] + 1
            there = self.hash[np.minimum(at, len(self.hash) - 1)]
            out[todo] = np.where((there == h[todo]) & (at < len(self.hash)), at, np.where((there > h[todo]) | (at >= len(self.hash)), -1, at))
            todo = todo[(there < h[todo]) & (at < len(self.hash))]
        return out


def word_table(counted: DataFrame, vocabulary: int | None = None, frequent: int = FREQUENT) -> WordTable:
    """Totals over all words and the ``frequent`` most frequent ones at most, ties at the border left out together.

    The end token is always among them, for no document asks for its count. The network gets ``vocabulary`` words, or as many as make up SHARE of all tokens.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, n = np.unique(joined(b.column(2).to_pylist(), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], ["c", "n"])

    sizes = counted.mapInArrow(spread, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    totals = sizes.agg(F.sum(F.col("c") * F.col("n")), F.sum("n")).first()
    # Counts above the square root of all tokens, or of many distinct values, are few; walk down from the largest.
    bound, taken = 0, 0
    missing, words = SHARE * (totals[0] or 0), 0
    for c, n in sizes.orderBy(F.desc("c")).limit(frequent).collect():
        if missing > 0:
            more = min(n, math.ceil(missing / c))
            missing, words = missing - more * c, words + more
        if taken + n > frequent:
            bound = c
            break
        taken += n
    if vocabulary is None:
        vocabulary = min(max(words, LEAST), MOST)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, c = joined(b.column(1).to_pylist(), np.uint64), joined(b.column(2).to_pylist(), np.int64)
            kept = (c > bound) | (h == END)
            yield pa.RecordBatch.from_arrays([pa.array([h[kept].tobytes()], pa.binary()), pa.array([c[kept].tobytes()], pa.binary())], ["h", "c"])

    rows = counted.mapInArrow(top, "h binary, c binary").collect()  # at most ``frequent`` words and the end token
    return WordTable(joined((r[0] for r in rows), np.uint64), joined((r[1] for r in rows), np.int64), totals[0] or 0, totals[1] or 0, vocabulary)


def distinct(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of ids below ``n``, in order, and each id's place among them."""
    there = np.zeros(n, bool)
    there[ids] = True
    known = np.flatnonzero(there)
    place = np.empty(n, np.int64)
    place[known] = np.arange(len(known))
    return known, place[ids]


def lowered(values: np.ndarray, blocks: list[np.ndarray], bound: float = 60.0) -> None:
    """Lowers each column of the blocks by its largest value if any of all values is too large for exp, or too small."""
    if values.size and (values.max() > bound or values.min() < -bound):
        for block in blocks:
            block -= block.max(axis=0)


class Network:
    """Parameters and passes of the recurrent network. Symbols: words by rank, then the common one, then the start."""

    def __init__(self, table: WordTable, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = table.words + 1
        freq = np.append(table.freq, max(0, table.rest_tokens)) + 1
        order = np.argsort(-freq, kind="stable")
        share = freq[order] ** 0.6
        share /= share.sum()
        classes = max(CLASSES, int(np.sqrt(n) * 2 / 3))
        group = np.minimum((np.cumsum(share) - share / 2) * classes, classes - 1).astype(np.int64)
        group = np.unique(group, return_inverse=True)[1]
        self.cls, self.place = np.empty(n, np.int64), np.empty(n, np.int64)
        self.cls[order] = group
        sizes = np.bincount(group)
        self.place[order] = np.arange(n) - (np.cumsum(sizes) - sizes)[group]
        self.sizes = sizes
        per_class = np.bincount(self.cls, freq)
        h = HIDDEN
        self.p = {
            "x": rng.normal(0, 0.1, (n + 1, 3 * h)),
            "u": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)),
            "b": np.zeros(3 * h),
            # The last column of both is the offset; rows of a class lie together.
            "c": np.column_stack([np.zeros((len(sizes), h)), np.log(per_class / per_class.sum())]),
            "w": np.column_stack([np.zeros((n, h)), np.log(freq[order] / per_class[group])]),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.begin = np.append(0, np.cumsum(sizes))
        self.learned = 0  # tokens that gave a gradient

    def gates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the inputs add to the three gates, gate by gate, and the recurrent weights likewise. The first two
        gates have their sign turned, for their logistic function asks for it."""
        x = (self.p["x"].take(ids, axis=0) + self.p["b"]).reshape(len(ids), 3, HIDDEN).transpose(1, 0, 2)
        u = self.p["u"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2)
        sign = np.array([-1, -1, 1], x.dtype)[:, None, None]
        return x * sign, u * sign

    def recur(self, h: np.ndarray, x: np.ndarray, u: np.ndarray, gate: np.ndarray, out: np.ndarray, past: np.ndarray) -> None:
        """New state of every document from its input ``x``: into ``out``, the gates into ``gate``, and what is left of
        the past in the third of them into ``past``."""
        s = np.matmul(h, u)
        zr, n = gate[:2], gate[2]
        np.add(x[:2], s[:2], out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        np.multiply(zr[1], s[2], out=past)
        np.add(past, x[2], out=n)
        np.tanh(n, out=n)
        np.subtract(h, n, out=out)
        out *= zr[0]
        out += n

    def step(self, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New state and the gates, for one token of every document."""
        x, u = self.gates(ids)
        gate, out, past = np.empty_like(x), np.empty_like(x[0]), np.empty_like(x[0])
        with np.errstate(over="ignore"):
            self.recur(h.astype(x.dtype, copy=False), x, u, gate, out, past)
        return out, gate

    def log_probability(self, states: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each target; with ``grads``, puts the gradients of minus their sum there and
        returns that by the states."""
        c, w = self.p["c"], self.p["w"]
        n, d, kind = len(target), HIDDEN, c.dtype
        cls = self.cls[target].astype(np.int16)
        order = np.argsort(cls, kind="stable")  # tokens of a class lie together from here on
        cls, place = cls[order].astype(np.int64), self.place[target[order]]
        row = n if n < 512 else n + 16 + -n % 1024  # so that rows don't start in the same lines of the cache
        s, whole = np.empty((d + 1, row), kind)[:, :n], np.empty((len(self.sizes), row), kind)
        s[:d], s[d] = states.take(order, axis=0).T, 1
        cut = np.searchsorted(cls, np.arange(len(self.sizes) + 1))
        # Logits of a token's class, in one block for all classes, and of its word, in a block for each class.
        count = np.diff(cut)
        used = np.flatnonzero((count > 0) & (self.sizes > 1))
        area = np.where(self.sizes > 1, count * self.sizes, 0)
        start = np.cumsum(area) - area
        logits, flat = np.matmul(c, s, out=whole[:, :n]), np.empty(area.sum(), kind)
        blocks = [(k, slice(cut[k], cut[k + 1]), flat[start[k] : start[k] + area[k]].reshape(self.sizes[k], count[k])) for k in used.tolist()]
        for k, at, block in blocks:
            np.matmul(w[self.begin[k] : self.begin[k + 1]], s[:, at], out=block)
        inner = np.flatnonzero(self.sizes[cls] > 1)
        spot, mine = cls * row + np.arange(n), (start[cls] + place * count[cls] + np.arange(n) - cut[cls])[inner]
        lowered(logits, [logits])
        lowered(flat, [x[2] for x in blocks])
        found = whole.ravel()[spot]
        found[inner] += flat[mine]
        total, within = np.empty(n, kind), np.ones(n, kind)
        np.exp(logits, out=logits)
        np.add.reduce(logits, axis=0, out=total)
        np.exp(flat, out=flat)
        for _, at, block in blocks:
            np.add.reduce(block, axis=0, out=within[at])
        found -= np.log(total)
        found -= np.log(within)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        found = found[back]
        if grads is None:
            return found, None
        logits *= np.reciprocal(total, out=total)
        whole.ravel()[spot] -= 1
        grads["c"] = logits @ s.T
        pull = logits.T @ c[:, :d]
        np.reciprocal(within, out=within)
        for _, at, block in blocks:
            block *= within[at]
        flat[mine] -= 1
        g = grads["w"] = np.zeros_like(w)
        for k, at, block in blocks:
            inside = slice(self.begin[k], self.begin[k + 1])
            np.matmul(block, s[:, at].T, out=g[inside])
            pull[at] += block.T @ w[inside, :d]
        return found, pull.take(back, axis=0)

    def forward(self, h: np.ndarray, ids: np.ndarray, flat: np.ndarray, base: np.ndarray, size: np.ndarray, t0: int, tape: bool) -> tuple[np.ndarray, ...]:
        """One window of every document still going: each step's tokens, where they end, and all states; with ``tape``
        also what was read and what it adds to the gates, the states before, the gates, the past in them, and the
        recurrent weights."""
        live = np.searchsorted(-size, -np.arange(t0, min(t0 + WINDOW, int(size[0]))), side="left")  # documents longer than t
        ends = np.append(0, np.cumsum(live))
        steps = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        target = np.concatenate([flat[base[: b - a] + t] for t, (a, b) in enumerate(steps, t0)])
        seen = np.concatenate([ids[: live[0]], *(target[a : a + n] for (a, _), n in zip(steps, live[1:].tolist(), strict=False))])
        known, code = distinct(seen, len(self.cls) + 1)
        x, u = self.gates(known)
        x = x.take(code, axis=1)
        after = np.empty((len(seen), HIDDEN), x.dtype)
        gate = np.empty((3, len(seen) if tape else live[0], HIDDEN), x.dtype)
        past = np.empty_like(gate[0])
        before = np.empty_like(after) if tape else None
        with np.errstate(over="ignore"):
            for a, b in steps:
                at = slice(a, b) if tape else slice(b - a)
                h = h[: b - a]
                if tape:
                    before[at] = h
                self.recur(h, x[:, a:b], u, gate[:, at], after[a:b], past[at])
                h = after[a:b]
        return target, ends, after, seen, x, before, gate, past, u

    def score(self, docs: list[np.ndarray], end: int, width: int = 512) -> np.ndarray:
        """Natural log probability of every document's symbols and end; the state is carried across windows."""
        out = np.zeros(len(docs))
        by = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        for begin in range(0, len(by), width):
            group = by[begin : begin + width]
            size = np.array([len(docs[i]) + 1 for i in group])
            flat = np.concatenate([np.append(docs[i], end) for i in group]).astype(np.int64)
            base = np.cumsum(size) - size
            h = np.zeros((len(group), HIDDEN), np.float32)
            ids = np.full(len(group), len(self.cls), np.int64)  # the start symbol
            sums = np.zeros(len(group))
            for t0 in range(0, int(size[0]), WINDOW):
                target, ends, after, *_ = self.forward(h, ids, flat, base, size, t0, tape=False)
                found, _ = self.log_probability(after, target)
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    sums[: b - a] += found[a:b]
                h, ids = after[ends[-2] :], target[ends[-2] :]
            out[group] = sums
        return out

    def window(self, h: np.ndarray, ids: np.ndarray, flat: np.ndarray, base: np.ndarray, size: np.ndarray, t0: int) -> tuple[dict, float, int, np.ndarray, np.ndarray]:
        """Gradients over one window of every document still going, its loss and tokens, and the state after it."""
        d = HIDDEN
        target, ends, after, seen, by, before, (z, r, n), past, u = self.forward(h, ids, flat, base, size, t0, tape=True)
        grads = {}
        found, pull = self.log_probability(after, target, grads)
        # All that doesn't depend on later steps, for the whole window at once: the gates' gradients by that of the state.
        # They take the place of the inputs.
        one_z = 1 - z
        by_n = n * n
        np.subtract(1, by_n, out=by_n)
        by_n *= one_z
        np.subtract(before, n, out=by[0])
        by[0] *= z
        by[0] *= one_z
        np.subtract(1, r, out=by[1])
        by[1] *= past
        by[1] *= by_n
        np.multiply(by_n, r, out=by[2])
        turned = np.ascontiguousarray(u.transpose(0, 2, 1))
        turned[:2] *= -1
        back = np.zeros((0, d), pull.dtype)
        for a, b in zip(ends[-2::-1].tolist(), ends[:0:-1].tolist(), strict=True):
            g, ds = pull[a:b], by[:, a:b]
            g[: len(back)] += back
            ds *= g
            if a:
                parts = ds @ turned
                back = g * z[a:b]
                back += parts[0]
                back += parts[1]
                back += parts[2]
        grads["u"] = np.concatenate(before.T @ by, axis=1)
        np.multiply(pull, by_n, out=by[2])  # from here on by the inputs
        order = np.argsort(seen.astype(np.uint16) if len(self.cls) < 1 << 16 else seen, kind="stable")
        rows, first, times = np.unique(seen[order], return_index=True, return_counts=True)
        few = times <= MANY
        g = np.empty((3, len(rows), d), by.dtype)
        if few.any():
            at, starts = order[np.repeat(few, times)], np.cumsum(times[few]) - times[few]
            g[:, few] = [np.add.reduceat(x.take(at, axis=0), starts, axis=0) for x in by]
        for k in np.flatnonzero(~few).tolist():  # one product is faster than a sum row by row
            at = order[first[k] : first[k] + times[k]]
            g[:, k] = np.ones(len(at), by.dtype) @ by.take(at, axis=1)
        grads["x"] = (rows, np.concatenate(g, axis=1))
        grads["b"] = grads["x"][1].sum(axis=0)
        return grads, float(-found.sum()), len(found), after[ends[-2] :], target[ends[-2] :]

    def descend(self, grads: dict, tokens: int, rate: float, memory: dict) -> None:
        """One Adagrad step along the gradients of ``tokens`` tokens, which it uses up."""
        scale = np.float32(1 / max(tokens, 64))
        for name, v in self.p.items():
            at, g = grads[name] if name == "x" else (slice(None), grads[name])
            g *= scale
            np.clip(g, -0.05, 0.05, out=g)
            if name not in memory:
                memory[name] = np.full_like(v, 1e-6)
            m = memory[name][at]
            m += g * g
            if name == "x":
                memory[name][at] = m
            g *= rate
            g /= np.sqrt(m)
            v[at] -= g

    def packed(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size


class Lanes:
    """Truncated backpropagation over whole documents, many in step.

    A document takes a free lane with a state of zero and keeps it, window after window, to its end; lanes stay open
    from one call to the next, so few run alone before the last.
    """

    def __init__(self, net: Network, end: int, rate: float, width: int = 128):
        self.net, self.end, self.rate, self.width = net, end, rate, width
        self.memory: dict[str, np.ndarray] = {}
        self.waiting: list[np.ndarray] = []
        self.open: list[np.ndarray] = []  # what is left of documents under way
        self.h, self.before = np.zeros((0, HIDDEN), np.float32), np.zeros(0, np.int64)
        self.random = np.random.default_rng(17)

    def learn(self, docs: list[np.ndarray], last: bool = False) -> int:
        """Learn from the documents while all lanes are taken, to the ends of all with ``last``; returns the tokens."""
        self.waiting += [np.append(x, self.end) for x in docs]
        order = self.random.permutation(len(self.waiting))
        # The longest start first, the others in any order.
        self.waiting = sorted((self.waiting[i] for i in order), key=lambda x: -(len(x) // LONG))
        taken, seen = len(self.open), 0
        flat = np.concatenate([np.zeros(0, np.int64), *self.open, *self.waiting])
        stop = np.cumsum([len(x) for x in self.open + self.waiting], dtype=np.int64)
        start = np.append(0, stop[:-1])[: len(stop)]
        at, to = start[:taken], stop[:taken]
        while (taken < len(stop) or len(at)) if last else len(at) + len(stop) - taken >= self.width:
            fresh = slice(taken, taken + self.width - len(at))
            at, to = np.append(at, start[fresh]), np.append(to, stop[fresh])
            new, taken = len(at) - len(self.h), min(fresh.stop, len(stop))
            h = np.concatenate([self.h, np.zeros((new, HIDDEN), np.float32)])
            before = np.append(self.before, np.full(new, len(self.net.cls)))
            size = np.minimum(WINDOW, to - at)
            by = np.argsort(-size, kind="stable")
            at, to = at[by], to[by]
            grads, _, tokens, h, before = self.net.window(h[by], before[by], flat, at, size[by], 0)
            self.net.descend(grads, tokens, self.rate, self.memory)
            seen += tokens
            # Only lanes that filled the window can go on; they come first, and h has at least them.
            go = np.flatnonzero(at + WINDOW < to)
            at, to, self.h, self.before = at[go] + WINDOW, to[go], h[go], before[go]
        self.open = [flat[a:b] for a, b in zip(at, to, strict=True)]
        self.waiting = self.waiting[taken - len(stop) :] if taken < len(stop) else []
        return seen


def symbols(table: WordTable, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their places in the table, the network's symbols, and the texts' offsets."""
    words, cut = word_hashes([t.lower() for t in texts])
    at = table.find(words)
    return words, at, np.where(at >= 0, table.id[at], table.words), cut


def train(docs: DataFrame, table: WordTable, slices: int = 2, rate: float = 0.08) -> Network:
    """One pass over every document, a round for each hash slice: partitions train copies, averaged after each round."""
    spark = docs.sparkSession
    net = Network(table)
    sent = spark.sparkContext.broadcast(table.state)  # at most FREQUENT words
    for turn in range(slices):
        start = spark.sparkContext.broadcast(net.packed())

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            lanes, own, tokens, docs, size = None, None, 0, [], 0
            for _, texts in text_batches(batches):
                if lanes is None:
                    own = WordTable(*sent.value)
                    mine = Network(own)
                    mine.unpack(start.value)
                    lanes = Lanes(mine, own.end, rate)
                _, _, ids, cut = symbols(own, texts)
                docs += [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                size += sum(map(len, texts))
                if size > GATHER // 4:
                    tokens += lanes.learn(docs)
                    docs, size = [], 0
            if lanes:
                tokens += lanes.learn(docs, last=True)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([(lanes.net.packed().astype(np.float64) * tokens).tobytes()], pa.binary())], ["n", "w"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, w = 0, None
            for b in batches:
                for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    n, w = n + k, np.frombuffer(raw, np.float64) + (0 if w is None else w)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], ["n", "w"])

        slice_docs = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(slices)) == turn).select("text")
        kind = "n long, w binary"
        copies = slice_docs.mapInArrow(run, kind).repartition(partitions(docs)).mapInArrow(add, kind).repartition(8).mapInArrow(add, kind)
        rows = copies.collect()  # at most eight sums of one network each
        if rows:
            net.unpack(sum(np.frombuffer(r.w, np.float64) for r in rows) / sum(r.n for r in rows))
            net.learned += sum(r.n for r in rows)
    return net


REST = np.dtype([("hash", "<u8"), ("times", "<u4")])


def scored_rows(docs: DataFrame, table: WordTable, net: Network) -> DataFrame:
    """(b, doc_id, held_out, n, known, base, model, rest, need): all that the frequent words give, and packed hashes
    of the words whose counts are still needed."""
    sent = docs.sparkSession.sparkContext.broadcast((table.state, net.packed()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, weights = sent.value
        table = WordTable(*state)
        net = Network(table)
        net.unpack(weights)
        gain = np.log10(table.count + 1.0)
        end_at = int(np.searchsorted(table.hash, END))
        block = TaskContext.get().partitionId() << 24
        rows, symbol_lists, size = [], [], 0

        def flush() -> pa.RecordBatch:
            # Many documents at once keep the matrices tall; the longest alone decides the number of steps.
            model = net.score(symbol_lists, table.end) / np.log(10)
            doc_id, held, n, known, base, rest, outside, need = zip(*rows, strict=True)
            columns = [(np.full(len(rows), block), pa.int64()), (doc_id, pa.int64()), (held, pa.bool_()), (n, pa.int64()), (known, pa.int64()), (base, pa.float64()), (model, pa.float64()), (rest, pa.float64()), (outside, pa.int64()), (need, pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["b", "doc_id", "held_out", "n", "known", "base", "model", "rest", "outside", "need"])

        for batch, texts in text_batches(batches):
            words, at, ids, cut = symbols(table, texts)
            doc_ids, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                here, mine = at[a:b], ids[a:b]
                found = here[here >= 0]
                h, times = np.unique(words[a:b][here < 0], return_counts=True)
                r = np.zeros(len(h), REST)
                r["hash"], r["times"] = h, times
                known = len(found) + int(table.count[end_at] > 0)
                rest = float(gain[found[table.id[found] == table.words]].sum())
                rows.append((doc_ids[i], held[i], int(b - a) + 1, known, float(gain[found].sum() + gain[end_at]), rest, int((mine == table.words).sum()), r.tobytes()))
                symbol_lists.append(mine)
            size += sum(map(len, texts))
            if size > GATHER:
                yield flush()
                block, rows, symbol_lists, size = block + 1, [], [], 0
        if rows:
            yield flush()

    kind = "b long, doc_id long, held_out boolean, n long, known long, base double, model double, rest double, outside long, need binary"
    return materialise(docs.select("doc_id", "held_out", "text").mapInArrow(run, kind), "scores")


def needed_counts(rows: DataFrame, counted: DataFrame, parts: int) -> DataFrame:
    """(b, h, c): for each block the packed hashes that it needs and the training counts of those that have one."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(b: int, need: list[bytes]) -> pa.RecordBatch:
            h = np.unique(joined(need, REST)["hash"])
            sent = list(by_partition((mix(h) % np.uint64(parts)).astype(np.int64), parts, h))
            p, x = zip(*sent, strict=True) if sent else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array([b] * len(p), pa.int64()), pa.array(x, pa.binary()), pa.array([b""] * len(p), pa.binary())], ["p", "b", "h", "c"])

        now, need = None, []
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != now and need:
                    yield flush(now, need)
                    need = []
                now = b
                need.append(x)
        if need:
            yield flush(now, need)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, h, c = [], [], []
        for batch in batches:
            for _, b, x, n in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if b < 0:
                    h.append(x)
                    c.append(n)
                else:
                    asked.append((b, x))
        h, c = joined(h, np.uint64), joined(c, np.int64)
        order = np.argsort(h)
        h, c = h[order], c[order]
        for b, x in asked:
            want = np.frombuffer(x, np.uint64)
            if len(h):
                at = np.minimum(np.searchsorted(h, want), len(h) - 1)
                hit = h[at] == want
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([want[hit].tobytes()], pa.binary()), pa.array([c[at[hit]].tobytes()], pa.binary())], ["b", "h", "c"])

    requests = rows.select("b", "need").mapInArrow(send, "p int, b long, h binary, c binary")
    owned = counted.select("p", F.lit(-1).cast("long").alias("b"), "h", "c")
    return requests.unionByName(owned).repartition(parts, "p").mapInArrow(answer, "b long, h binary, c binary")


def score(docs: DataFrame, folds: int = 7, held_out: int = 2, vocabulary: int | None = None, slices: int = 2, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased, and one end token closes each document; a null text
    is the end token alone. Learning takes the rows whose crc32(doc_id as text) mod ``folds`` is not ``held_out``;
    rows with a null doc_id are scored, with a null held_out, and not learned from. Repeated rows count as often as
    they occur; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("held_out", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == held_out)
    learned = docs.where("not held_out")
    parts = partitions(docs)
    counted = count_words(learned)
    table = word_table(counted, vocabulary, frequent)
    net = train(learned, table, slices)
    rows = scored_rows(docs, table, net)
    answers = needed_counts(rows, counted, parts)
    unit = float(np.log10(table.tokens + table.distinct + 1))
    rest_unit = float(np.log10(table.rest_tokens + table.rest_distinct + 1))
    tokens = table.tokens

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        h, c = joined(right["h"], np.uint64), joined(right["c"], np.int64)
        order = np.argsort(h)
        h, gain = h[order], np.log10(c[order] + 1.0)
        base, rest, known = [], [], []
        for row in left.itertuples(index=False):
            r = np.frombuffer(row.need, REST)
            more = 0.0
            hits = 0
            if len(h) and len(r):
                at = np.minimum(np.searchsorted(h, r["hash"]), len(h) - 1)
                hit = h[at] == r["hash"]
                more = float((gain[at[hit]] * r["times"][hit]).sum())
                hits = int(r["times"][hit].sum())
            base.append(row.base + more - row.n * unit)
            rest.append(row.model + row.rest + more - row.outside * rest_unit)
            known.append(row.known + hits)
        return pd.DataFrame({"doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": left["n"], "n_known": known, "train_tokens": tokens, "base_score": base, "score": rest})

    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("b").cogroup(answers.groupBy("b")).applyInPandas(finish, kind)
