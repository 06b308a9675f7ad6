"""Stretches without spaces are never cut, however long, and a model's longest pieces count: held against a plain sum over all segmentations."""

import io
import math

import numpy as np
import pytest
import sentencepiece

from telemill.llm import segmentation

TEXTS = ["the" * 170, "x" * 96, "日本語" * 60 + "é😀" * 20, " " * 300 + "stop" * 30, "a " * 40 + "pots" * 2000, "http://x.org/" + "0f" * 60 + " end"]


def plain(text, pieces, sp):
    """The log of the sum over all segmentations of the text, each the product of its pieces' weights."""
    text, weights = " " + text, {}
    for i in range(sp.get_piece_size()):
        if pieces.weights[i] > -math.inf:
            weights[sp.id_to_piece(i).replace("▁", " ")] = float(pieces.weights[i])
    longest, other = max(map(len, weights)), float(pieces.logs[-2])
    sums = [0.0]
    for end in range(1, len(text) + 1):
        terms = []
        for start in range(max(0, end - longest), end):
            piece = text[start:end]
            # A piece does not reach across the start of a word.
            if " " in piece.lstrip(" "):
                continue
            if start and text[start - 1] != " " and piece[0] == " " or piece[0] != " " or not start or text[start - 1] == " ":
                if piece in weights or end - start == 1:
                    terms.append(sums[start] + weights.get(piece, other))
        top = max(terms)
        sums.append(top + math.log(sum(math.exp(x - top) for x in terms)))
    return sums[-1]


def own(ids, pieces, sp):
    """The same product for one segmentation; a character that is written as bytes counts once."""
    total, bytes_left = 0.0, 0
    for i in ids:
        if pieces.weights[i] > -math.inf:
            total += float(pieces.weights[i])
            continue
        byte = pieces.data[pieces.starts[i]]
        if bytes_left == 0:
            total += float(pieces.logs[-2])
            bytes_left = 0 if byte < 128 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
        else:
            bytes_left -= 1
    return total


def held(model, texts, n=3, sharpness=0.7):
    pieces = segmentation.Pieces(model, sharpness)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    found = segmentation.sample_segmentations(texts, list(range(len(texts))), segmentation.Units(pieces), n)
    for text, samples in zip(texts, found):
        whole = plain(text, pieces, sp)
        assert len({tuple(ids) for ids, _, _ in samples}) == len(samples)
        for ids, log_prob, _ in samples:
            assert pieces.decode(ids).decode() == text
            assert log_prob == pytest.approx(own(ids, pieces, sp) - whole, abs=1e-6)
    return found, pieces


def test_long_stretches_have_the_probabilities_of_the_whole():
    with open(segmentation.MODEL, "rb") as f:
        model = f.read()
    for sharpness in (0.7, 3.0):
        held(model, TEXTS, sharpness=sharpness)


def test_short_and_long_units_agree(monkeypatch):
    with open(segmentation.MODEL, "rb") as f:
        pieces = segmentation.Pieces(f.read())
    texts = ["the cat sat on the mat", "日本語 😀 and more", "x" * 80, "  two  spaces", "a"]

    def samples():
        return segmentation.sample_segmentations(texts, list(range(len(texts))), segmentation.Units(pieces), 3)

    want = samples()
    monkeypatch.setattr(segmentation, "WIDE", 0)
    for x, y in zip(want, samples(), strict=True):
        assert [ids.tolist() for ids, _, _ in x] == [ids.tolist() for ids, _, _ in y]
        assert np.allclose([(lp, score) for _, lp, score in x], [(lp, score) for _, lp, score in y], rtol=1e-9)


def test_pieces_of_over_16_characters_count():
    made = io.BytesIO()
    words = ["internationalizations", "uncharacteristicallyso", "misrepresentativeness"]
    lines = [" ".join(words[(i + k) % 3] for k in range(5)) for i in range(200)]
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter(lines), model_writer=made, vocab_size=420, model_type="bpe", byte_fallback=True,
        max_sentencepiece_length=40, hard_vocab_limit=False, character_coverage=1.0, minloglevel=2,
    )
    found, pieces = held(made.getvalue(), [" ".join(words)] * 60 + ["".join(words) * 3, "other words"], sharpness=1.0)
    assert pieces.longest > 16
    assert any(pieces.sizes[i] > 16 for samples in found for ids, _, _ in samples for i in ids)
