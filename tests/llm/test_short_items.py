"""Decontamination at every item length: the whole budget, and long items among short ones."""

import random

import pytest

from papyrine.llm import decontaminate
from tests.llm.test_others import brute_edits


@pytest.mark.parametrize("size", [24, 25, 27, 29, 30, 37, 38, 39, 40, 50, 75])
def test_the_whole_budget_at_every_length(size):
    """Items with floor(0.08 m) edits are found, as brute force finds them; one edit more is not."""
    rng = random.Random(size)
    budget = int(0.08 * size)
    for _ in range(25):
        item = "".join(rng.choice("abcdefghij ") for _ in range(size - 2)).strip().ljust(size - 1, "x") + "z"
        item = " ".join(item.split())
        item += "q" * (size - len(item))
        places = sorted(rng.sample(range(1, size - 1), budget + 2))
        for edits in (budget, budget + 1):
            text = list(item)
            for p in places[:edits]:
                text[p] = rng.choice(["", "X", text[p] + "Y"])
            told = "head of the text " + "".join(text) + " and its tail"
            least = brute_edits(item, "".join(map(chr, decontaminate.normalised(told)[0])))
            found = decontaminate.Items([7], [item]).matches([told])
            assert bool(found) == (least <= budget), (item, told)


def test_one_long_item_among_many_short_ones():
    """A million characters beside ten thousand short items: memory follows the sum, not the product."""
    rng = random.Random(1)
    short = ["".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(10_000)]
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_000_000))
    items = decontaminate.Items(list(range(10_001)), [*short, long])
    assert items.flat.nbytes < 8_000_000
    found = items.matches(["so " + short[3] + " and " + short[9_999], "nothing at all to see in this text"])
    assert [(f[0], f[1], f[4]) for f in found] == [(0, 3, 0), (0, 9_999, 0)]


def test_a_rate_that_the_filter_cannot_serve_is_refused():
    with pytest.raises(ValueError):
        decontaminate.Items([1], ["a text of thirty characters, ok"], rate=0.3)
