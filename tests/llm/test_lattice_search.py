"""Units told apart by hashes, and a search that draws only values that may count, give what plain ways give."""

import random
import re

import numpy as np
import pytest

from telemill.llm import segmentation

UNIT = segmentation.UNIT
RNG = random.Random(7)
TEXTS = ["".join(RNG.choice(["the ", "of", " ", "a", "é", "日", "\n", "😀", "stop", "pots "]) for _ in range(n)) for n in (1, 2, 9, 300, 3000)]
TEXTS += ["", " ", " " * 47, " " * 48, " " * 49 + "x" * 47, "a" + " " * 200, "x" * 47, "x" * 48, " " * 47 + "y" * 200 + " z"]


@pytest.fixture
def pieces():
    with open(segmentation.MODEL, "rb") as f:
        return segmentation.Pieces(f.read(), sharpness=0.5)


def samples(pieces, texts, n=4):
    found = segmentation.sample_segmentations(texts, list(range(len(texts))), segmentation.Units(pieces), n)
    return [[(ids.tolist(), lp, score) for ids, lp, score in f] for f in found]


def test_values_are_drawn_only_where_they_may_count(pieces, monkeypatch):
    want = samples(pieces, TEXTS)
    drawn = []
    plain = segmentation._truncated
    monkeypatch.setattr(segmentation, "_truncated", lambda phi, top, u: (drawn.append(len(phi)), plain(phi, top, u))[1])
    found = samples(pieces, TEXTS[4:5], 2)[0]
    assert sum(drawn) < sum(len(ids) for ids, _, _ in found) / 4
    # All pieces are looked at, and the same ones count.
    monkeypatch.setattr(segmentation, "WINDOW", 1 << 30, raising=False)
    assert samples(pieces, TEXTS) == want


def test_units_with_the_same_hash_stay_apart(pieces, monkeypatch):
    want = samples(pieces, TEXTS)
    monkeypatch.setattr(segmentation, "_POWERS", np.ones_like(segmentation._POWERS))
    lat = segmentation.Units(pieces)
    for i in range(len(TEXTS)):
        one = segmentation.sample_segmentations(TEXTS[i : i + 1], [i], lat, 4)[0]
        assert [(ids.tolist(), lp, score) for ids, lp, score in one] == want[i]


def test_units_are_cut_as_by_a_pattern():
    pattern = re.compile(f" {{1,{UNIT}}}(?:[^ ]{{1,{UNIT - 1}}})?|[^ ]{{1,{UNIT}}}")
    texts = [" " + t for t in TEXTS]
    size = np.array([len(t) for t in texts])
    start = segmentation._cut(segmentation._points("".join(texts)), np.cumsum(size) - size)
    want = [len(u) for t in texts for u in pattern.findall(t)]
    assert np.diff(start, append=size.sum()).tolist() == want
