"""What a token costs the recurrent network."""

import numpy as np

from papyrine.llm import gru_lm


def test_classes_keep_a_tokens_logits_few():
    """Over words whose frequencies fall as natural ones do, a token looks at few classes and few words of its own."""
    words = 4000
    counts = (1e6 / np.arange(1, words + 1)).astype(np.int64)
    hashes = np.append(np.sort(np.random.default_rng(5).integers(0, 2**63, words - 1).astype(np.uint64)), gru_lm.END)
    table = gru_lm.WordTable(hashes, counts, int(counts.sum() * 5 / 3), 10 * words, words)
    net = gru_lm.Network(table)
    share = np.append(table.freq, table.rest_tokens) / table.tokens
    own = net.sizes[net.cls]
    assert len(net.sizes) + (share * own * (own > 1)).sum() < 90
    state = np.zeros((table.words + 1, gru_lm.HIDDEN), np.float32)
    found, _ = net.log_probability(state, np.arange(table.words + 1))
    assert np.isclose(np.exp(found).sum(), 1, rtol=1e-4)


def test_scores_do_not_depend_on_the_lanes():
    rng = np.random.default_rng(6)
    table = gru_lm.WordTable(np.append(np.arange(1, 40, dtype=np.uint64) << np.uint64(50), gru_lm.END), np.arange(40, 0, -1), 1000, 60, 40)
    net = gru_lm.Network(table)
    for name in "cw":
        net.p[name][:, :-1] = rng.normal(0, 40, net.p[name][:, :-1].shape)  # logits that exp in single precision can't take
    docs = [rng.integers(0, table.words + 1, n) for n in (0, 1, 23, 24, 25, 90, 3)]
    found = net.score(docs, table.end)
    assert np.isfinite(found).all() and (found < 0).all()
    assert np.allclose(found, net.score(docs, table.end, width=2), rtol=1e-4)


def test_every_hash_is_found_at_its_place():
    """Also those that crowd one end of the directory."""
    rng = np.random.default_rng(7)
    near = rng.integers(0, 50, 40).astype(np.uint64)
    hashes = np.unique(np.concatenate([rng.integers(0, 2**64, 500, dtype=np.uint64), near, ~near, [gru_lm.END]]))
    table = gru_lm.WordTable(hashes, np.ones(len(hashes), np.int64), len(hashes), len(hashes), 3)
    asked = np.concatenate([hashes, hashes + np.uint64(1), hashes - np.uint64(1), [np.uint64(0), ~np.uint64(0)]])
    places = {int(h): i for i, h in enumerate(table.hash)}
    assert table.find(asked).tolist() == [places.get(int(h), -1) for h in asked]
