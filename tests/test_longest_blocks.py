"""What prunes pairs of texts before a subsequence or a ratio is computed: nothing alike is lost, and little else is left."""

import difflib
import random

import numpy as np
import pytest
from chronofold.core import likeness
from chronofold.operators import align

SYLLABLES = ["th", "he", "in", "er", "an", "re", "on", "nd", "ou", "ti", "ea", "st", "ble", "ing"]


def texts_of(rng, n, letters):
    out = []
    while len(out) < n:
        text = ""
        while len(text) < letters:
            text += "".join(rng.choice(SYLLABLES) for _ in range(rng.choice([1, 2, 3]))) + " "
        out.append(text.strip())
        if len(out) % 5 == 0:  # a near copy, and one near the bar
            for share in (0.02, 0.12):
                out.append(" ".join(rng.choice(["x", w[::-1], w]) if rng.random() < share else w for w in text.split()))
    return out[:n]


def tile(texts, first):
    return align.Tile([str(k) for k in range(len(texts))], list(range(first, first + len(texts))), texts)


@pytest.mark.parametrize("letters", [60, 400, 900])
def test_longest_blocks_leave_what_is_alike_and_little_else(letters, monkeypatch):
    rng = random.Random(letters)
    texts = texts_of(rng, 40, letters)
    monkeypatch.setattr(align, "ASKED", 7)
    x, y = tile(texts[:25], 0), tile(texts[15:], 15)
    wanted = np.ones((len(y.d), len(x.d)), bool)
    for mine_first in (wanted, ~wanted):
        left = set(x.open(y, wanted, 0.9, mine_first))
        alike = set()
        for k, a in enumerate(x.texts):
            for j, b in enumerate(y.texts):
                pair = (a, b) if mine_first[j, k] else (b, a)
                if likeness.ratio(*pair, 0.9) >= 0.9:
                    alike.add((k, j))
        assert alike <= left and len(alike) >= 10
        if letters > 100:  # lengths and letters alone leave over half
            assert len(left) - len(alike) < 0.1 * wanted.size


def test_too_many_pieces_leave_the_pair(monkeypatch):
    monkeypatch.setattr(likeness, "_MOST", 100)
    texts = ["ab" * 200, "ba" * 200, "abc" * 130]
    x = tile(texts, 0)
    wanted = np.ones((3, 3), bool)
    assert {(k, j) for k in (0, 1) for j in (0, 1)} <= set(x.open(tile(texts, 0), wanted, 0.9, wanted))


def test_ratio_of_near_copies_needs_few_searches(monkeypatch):
    """All blocks of some letters are found at once; before, each was searched for by a dozen hashes of both texts."""
    rng = random.Random(3)
    a = texts_of(rng, 1, 4000)[0]
    b = " ".join("annet" if rng.random() < 0.04 else w for w in a.split())
    looks = []
    at = likeness.Blocks._at
    monkeypatch.setattr(likeness.Blocks, "_at", lambda self, *x: looks.append(1) or at(self, *x))
    assert likeness.ratio(a, b, 0.9) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.9
    assert len(looks) < 20
