"""Lattices of units met later take their place beside the others, which stay where they are."""

import numpy as np

from telemill.llm import segmentation

TEXTS = ["the cat sat on the mat", "", "日本語 😀 and more", "x" * 120 + "  two  spaces", "another text with other words", "the end"]


def samples(lat, groups):
    out = []
    for a, b in groups:
        found = segmentation.sample_segmentations(TEXTS[a:b], list(range(a, b)), lat, 3)
        out += [[(ids.tolist(), lp, score) for ids, lp, score in f] for f in found]
    return out


def test_tables_grow_in_place_and_groups_change_nothing(monkeypatch):
    with open(segmentation.MODEL, "rb") as f:
        pieces = segmentation.Pieces(f.read())
    lat = segmentation.Units(pieces)
    want = samples(lat, [(0, 1)])
    tables = lat.ids, lat.cum
    want += samples(lat, [(1, 6)])
    assert all(np.shares_memory(x, y) for x, y in zip(tables, (lat.ids, lat.cum)))
    monkeypatch.setattr(segmentation, "BUILD_CHARS", 7)
    assert samples(segmentation.Units(pieces), [(0, 6)]) == want
    monkeypatch.setattr(segmentation, "NODES", 30)  # tables are started anew and outgrown
    assert samples(segmentation.Units(pieces), [(i, i + 1) for i in range(6)]) == want
