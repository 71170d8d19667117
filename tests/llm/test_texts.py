"""Text operators against brute force, on whole texts and every odd row."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from papyrine.llm import gru_lm, ngram_join, packing, substring_dedup, suffix_dedup, wordpiece
from papyrine.llm.induced_sort import common_prefixes, suffix_arrays
from papyrine.llm.textual import word_hashes


def words_of(text, lower=True):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_word_hashes_tell_words_apart():
    texts = [b"a bb a", b"", b" \t", b"bb\x0bccc" + b"d" * 200, b"d" * 200 + b" ccc" + b"d" * 200]
    hashes, cut = word_hashes(texts)
    names = [w for t in texts for w in t.split()]
    assert np.diff(cut).tolist() == [3, 0, 0, 2, 2]
    assert len(set(hashes.tolist())) == len(set(names)) and [hashes[0], hashes[1]] == [hashes[2], hashes[3]]


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(40):
        k, n, a = int(rng.integers(1, 6)), int(rng.integers(1, 50)), int(rng.integers(1, 4))
        text = rng.integers(1, a + 1, (n, k))
        text[-1] = 0
        sa = suffix_arrays(text, a + 1)
        shared = common_prefixes(text, sa, 12)
        for lane in range(k):
            s = bytes(text[:, lane].tolist())
            order = sorted(range(n), key=lambda i: s[i:])
            assert sa[:, lane].tolist() == order
            for before, at in zip(order, order[1:], strict=False):
                same = next((x for x in range(12) if max(before, at) + x >= n or s[before + x] != s[at + x]), 12)
                assert shared[at, lane] == same


def shingles(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    real = [(i, s) for i, s in sets if i is not None and s]
    root = {s: i for i, s in real}
    for i, s in real:
        root[s] = min(root[s], i)
    changed = True
    while changed:
        changed = False
        for s in root:
            for t in root:
                inter = len(s & t)
                if root[s] < root[t] and 100 * inter >= 80 * (len(s) + len(t) - inter):
                    root[t] = root[s]
                    changed = True
    return sorted(((i, len(s), None if i is None else root[s] if s else i) for i, s in sets), key=repr)


def test_near_duplicates(docs, documents, no_docs):
    assert found(ngram_join.near_duplicates(docs)) == brute_components(documents)
    assert ngram_join.near_duplicates(no_docs).collect() == []


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    """Near copies of one text whose links form chains, over several blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 2000)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    want = brute_components(rows)
    assert len({c for _, _, c in want}) > 3
    assert found(got) == want


def test_keep_one(docs, documents):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    first = {i: c for i, _, c in brute_components(documents)}
    gone = {i for i, _, c in brute_components(documents) if i is not None and c < i}
    assert found(kept) == sorted((r for r in documents if r[0] not in gone), key=repr) and first


def brute_bytes(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    counts = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), int(gone.sum()), spans, kept))
    return out


@pytest.mark.parametrize("bound", [16, 1])
def test_repeated_bytes(docs, documents, no_docs, bound, monkeypatch):
    """With the bound at 1 every shared gram takes the counting path."""
    monkeypatch.setattr(suffix_dedup, "BOUND", bound)
    want = sorted(((*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute_bytes(documents)), key=repr)
    assert found(suffix_dedup.remove_repeats(docs)) == want
    if bound == 16:
        assert suffix_dedup.remove_repeats(no_docs).collect() == []


def test_repeated_bytes_cut_from_rows(docs, documents):
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    want = [(r[0], None if r[1] is None else b[4].decode("utf-8", "ignore"), *r[2:]) for r, b in zip(documents, brute_bytes(documents), strict=True)]
    assert found(out) == sorted(want, key=repr)


def test_repeated_windows(docs, documents, no_docs):
    texts = [(i, words_of(t, lower=False)) for i, t, *_ in documents]
    counts = Counter(tuple(w[k : k + 35]) for _, w in texts for k in range(len(w) - 34))
    want = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if counts[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    assert found(substring_dedup.remove_windows(docs)) == sorted(want, key=repr)
    assert substring_dedup.remove_windows(no_docs).collect() == []


def test_packing(docs, documents, no_docs):
    from tokenizers import Tokenizer

    public = pytest.importorskip("public_tokenizers")
    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    pieces = packing.pack(docs, shard_tokens=1500).collect()
    texts = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, *_ in documents)
    by_sequence, covered = {}, Counter()
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
        own = [ids for (i, ids) in texts if i == p.doc_id and len(ids) == p.doc_tokens and zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32]
        assert own and p.length > 0
        covered[p.doc_id, p.doc_tokens] += p.length
    assert covered == Counter({k: sum(n * c for (i, ids), c in texts.items() if (i, len(ids)) == k for n in [len(ids)]) for k in covered})
    assert sum(covered.values()) == sum(len(ids) * c for (_, ids), c in texts.items())
    for sequence in by_sequence.values():
        sequence.sort(key=lambda p: p.offset)
        assert [p.offset for p in sequence] == np.cumsum([0] + [p.length for p in sequence[:-1]]).tolist()
        total = sum(p.length for p in sequence)
        assert total == 4096 or total & (total - 1) == 0
    assert packing.pack(no_docs).collect() == []


def test_retrieval_prefers_like_documents():
    rng = np.random.default_rng(3)
    docs = [rng.integers(100 * (i % 3), 100 * (i % 3) + 60, 400).astype(np.uint16) for i in range(30)]
    df = np.zeros(1 << 16, np.int64)
    for d in docs:
        df[np.unique(d)] += 1
    shard = packing.Shard(docs, df, len(docs), 12000)
    first = shard.neighbours(0)
    assert set(first[:9].tolist()) <= set(range(0, 30, 3))
    parts = [p for s in packing.Shard(docs, df, len(docs), 12000).sequences() for p in s]
    assert sum(e - b for _, b, e in parts) == 12000


def test_wordpiece_automaton():
    rng = random.Random(1)
    for _ in range(200):
        letters = b"abc"[: rng.randint(1, 3)]
        entries = {tuple([*(rng.choice(letters) for _ in range(rng.randint(1, 5))), *([wordpiece.END] if rng.random() < 0.4 else [])]) for _ in range(rng.randint(1, 12))}
        machine = wordpiece.Automaton([list(e) for e in entries])
        words = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(20)]
        stop = np.cumsum([len(w) for w in words])
        got = machine.counts(np.frombuffer(b"".join(words), np.uint8), stop - [len(w) for w in words], stop)
        assert got.tolist() == [greedy(entries, w) for w in words]


def greedy(entries, word):
    w, at, n = (*word, wordpiece.END), 0, 0
    while at < len(w) and w[at] != wordpiece.END:
        end = next((j for j in range(len(w), at, -1) if w[at:j] in entries), 0)
        if not end:
            return 1
        at, n = end, n + 1
    return n


def test_token_counts(docs, documents, no_docs):
    pytest.importorskip("public_tokenizers")
    entries = {tuple(e) for e in wordpiece.read_vocabulary()}
    want = [(i, len(w), sum(greedy(entries, x) for x in w)) for i, w in ((r[0], words_of(r[1])) for r in documents)]
    assert found(wordpiece.token_counts(docs)) == sorted(want, key=repr)
    assert wordpiece.token_counts(no_docs).collect() == []


def test_language_model_base_and_form(docs, documents, no_docs):
    got = gru_lm.score(docs)
    rows = got.collect()
    texts = [(i, words_of(t) + [b"\0end"]) for i, t, *_ in documents]
    learned = [w for i, w in texts if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(x for w in learned for x in w)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, None if i is None else zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n, round(float(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w)), 6)) for i, w in texts), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=repr) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert gru_lm.score(no_docs).collect() == []


def small_network():
    rng = np.random.default_rng(0)
    hashes = np.append(np.sort(rng.integers(0, 2**63, 20).astype(np.uint64)), gru_lm.END)
    table = gru_lm.WordTable(hashes, np.arange(21, 0, -1), 231 + 30, 21 + 9, 12)
    net = gru_lm.Network(table)
    net.p = {k: v.astype(np.float64) + rng.normal(0, 0.1, v.shape) for k, v in net.p.items()}
    return rng, table, net


def test_gradients():
    rng, table, net = small_network()
    docs = [rng.integers(0, table.words + 1, n) for n in (9, 5, 0)]
    size = np.array([10, 6, 1])
    flat, base = np.concatenate([np.append(d, table.end) for d in docs]).astype(np.int64), np.cumsum(size) - size
    start, ids = np.zeros((3, gru_lm.HIDDEN)), np.full(3, len(net.cls))
    grads, loss, _, _, _ = net.window(start, ids, flat, base, size, 0)
    for name, value in net.p.items():
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in value.shape)
            both = []
            for step in (1e-5, -2e-5):
                value[at] += step
                both.append(net.window(start, ids, flat, base, size, 0)[1])
            value[at] += 1e-5
            slope = (both[0] - both[1]) / 2e-5
            rows, g = grads["x"]
            mine = grads[name][at] if name != "x" else g[rows.tolist().index(at[0])][at[1]] if at[0] in rows else 0
            assert abs(slope - mine) < 1e-4 * max(1, abs(slope))
    assert np.isclose(net.score(docs, table.end).sum(), -loss, rtol=1e-4)


def test_probabilities_add_up_and_state_is_carried():
    rng, table, net = small_network()
    state = rng.normal(0, 1, (1, gru_lm.HIDDEN))
    every = np.arange(table.words + 1)
    p, _ = net.log_probability(np.repeat(state, len(every), 0), every)
    assert np.isclose(np.exp(p).sum(), 1)
    long = rng.integers(0, table.words + 1, 3 * gru_lm.WINDOW + 5)
    h, before, total = np.zeros((1, gru_lm.HIDDEN)), np.array([len(net.cls)]), 0.0
    for x in np.append(long, table.end):
        h, *_ = net.step(h, before)
        total += float(net.log_probability(h, np.array([x]))[0][0])
        before = np.array([x])
    assert np.isclose(net.score([long], table.end)[0], total, rtol=1e-4)


def test_training_carries_the_state_to_the_end_of_every_document():
    rng, table, net = small_network()
    net.p = {k: v.astype(np.float32) for k, v in net.p.items()}
    docs = [rng.integers(0, table.words + 1, n) for n in (0, 1, gru_lm.WINDOW - 1, gru_lm.WINDOW, 700, 5000, 30, 2000)]
    losses, window = [], net.window
    net.window = lambda *a: [losses.append(x := window(*a)), x][1]
    lanes = gru_lm.Lanes(net, table.end, 0.0, width=3)
    seen = lanes.learn(docs[:5]) + lanes.learn(docs[5:], last=True)  # without steps, so that losses are scores
    assert seen == sum(len(d) + 1 for d in docs)
    assert np.isclose(sum(x[1] for x in losses), -net.score(docs, table.end).sum(), rtol=1e-4)


def test_every_training_document_gives_gradients(spark):
    rows = spark.createDataFrame([(i, "a b a c " * (1 + i % 3)) for i in range(40)], "doc_id long, text string")
    for slices in (1, 4):
        for part in range(4):
            some = rows.where(f"pmod(xxhash64(doc_id), 4) = {part}")
            table = gru_lm.word_table(gru_lm.count_words(some), 8)
            net = gru_lm.train(some, table, slices=slices)
            assert net.learned == table.tokens > 0
            assert not np.array_equal(net.packed(), gru_lm.Network(table).packed())


def test_network_words_follow_the_counts(spark):
    for words in (3000, 6000):
        rows = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i % 4, words, 4))) for i in range(8)], "doc_id long, text string")
        table = gru_lm.word_table(gru_lm.count_words(rows))
        assert table.words >= 0.6 * words and table.freq.sum() >= gru_lm.SHARE * table.tokens
        net = gru_lm.Network(table)
        state = np.random.default_rng(2).normal(0, 1, (1, gru_lm.HIDDEN)).astype(np.float32)
        every = np.arange(table.words + 1)
        assert np.isclose(np.exp(net.log_probability(np.repeat(state, len(every), 0), every)[0]).sum(), 1, rtol=1e-4)


def test_held_out_scores_beat_the_base(spark):
    rng = random.Random(3)
    rows = []
    for i in range(700):
        at, words = rng.randrange(2000), []
        for _ in range(rng.randint(50, 150)):
            # a word of many, which no count of single words tells from the others, and what always follows it
            words += [f"w{at}", "is" if at % 2 else "was", "the"]
            at = rng.randrange(2000)
        rows.append((i, " ".join(words)))
    got = gru_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert len(got) > 50 and sum(r.score for r in got) > 0.95 * sum(r.base_score for r in got)


def test_end_token_counts_whatever_the_bound(spark):
    texts = [(0, " ".join(f"w{k}" for k in range(50))), (1, None), (2, "w1 w1 new")]
    learned = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in texts]
    assert learned[0]
    rows = spark.createDataFrame(texts[:1] + [(i, t) for (i, t), x in zip(texts[1:], learned[1:], strict=True) if not x], "doc_id long, text string")
    for frequent in (1, 10, 1000):
        for r in gru_lm.score(rows, frequent=frequent).where("doc_id = 0").collect():
            # 51 tokens that occur once each, the end among them
            assert (r.n_known, r.train_tokens) == (51, 51) and np.isclose(r.base_score, 51 * np.log10(2 / 103))
            assert np.isfinite(r.score)
    counted = gru_lm.count_words(rows.where("doc_id = 0"))
    table = gru_lm.word_table(counted, frequent=10)
    assert table.hash.tolist() == [int(gru_lm.END)] and table.count.tolist() == [1]


def test_windows_take_every_scored_neighbour_before_shard_order():
    # Many short documents of one topic, and long ones that rank before short ones that would fit.
    for long in (0, 150):
        rng = np.random.default_rng(long)
        docs = [np.concatenate([rng.integers(100 * (i % 2) + 10, 100 * (i % 2) + 60, rng.integers(3, 12)), [2]]) for i in range(700)]
        docs += [np.concatenate([rng.integers(10, 60, rng.integers(3000, 4000)), [2]]) for _ in range(long)]
        docs = [d[d != 2].astype(np.uint16) for d in docs]
        df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1 << 16)
        make = lambda: packing.Shard(docs, df, len(docs), sum(map(len, docs)))  # noqa: B023, E731
        other = make()
        hit = np.isin(other.token, docs[0])
        score = np.bincount(other.doc[hit], other.weight[hit], len(docs))
        found = np.flatnonzero(score > 0)[1:]  # without the seed
        score = score[found]
        assert len(found) > 64
        room, want, rest = packing.WINDOW - len(docs[0]), {0}, set()
        for d in found[np.argsort(-score, kind="stable")].tolist():
            if len(docs[d]) <= room:
                want.add(d)
                room -= len(docs[d])
            else:
                rest.add(d)
        first = next(make().sequences())
        whole = [d for d, b, e in first if e - b == len(docs[d])]
        assert set(whole[: len(want)]) == want
        assert not rest or first[-1][0] in rest or room == 0
