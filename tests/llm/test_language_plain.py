"""The network's predictions against a plain forward pass, one byte after the other."""

import numpy as np

from telemill.llm import language


def squash(x):
    return x / (1 + abs(x))


def plain_states(weights, way, window):
    """The state after each byte of a window, read forwards (0) or backwards (1)."""
    hidden = weights["u"].shape[2]
    x, u, c = (weights[k][way].astype(float) for k in "xuc")
    state, states = np.zeros(hidden), {}
    for t in range(len(window)) if way == 0 else range(len(window) - 1, -1, -1):
        given, pulled = x[:, window[t]], u @ state
        z = 0.5 + 0.5 * squash(given[:hidden] + pulled[:hidden])
        r = 0.5 + 0.5 * squash(given[hidden : 2 * hidden] + pulled[hidden : 2 * hidden])
        new = squash(given[2 * hidden :] + r * (pulled[2 * hidden :] + c[:, 0]))
        state = z * state + (1 - z) * new
        states[t] = state
    return states


def plain_prediction(weights, text):
    """Mean of the probabilities at every byte; the last window reaches back over bytes that do not count again."""
    steps, found = language.STEPS, []
    starts = list(range(0, len(text) - steps + 1, steps))
    windows = [(s, 0) for s in starts]
    covered = len(starts) * steps
    if covered < len(text):
        windows.append((max(0, len(text) - steps), covered))
    for start, first in windows:
        window = text[start : start + steps].ljust(steps)
        ways = [plain_states(weights, way, window) for way in (0, 1)]
        for t in range(steps):
            if first <= start + t < len(text):
                logits = weights["b"][:, 0].astype(float) + sum(weights["o"][way].astype(float) @ ways[way][t] for way in (0, 1))
                share = np.exp(logits - logits.max())
                found.append(share / share.sum())
    return np.mean(found, axis=0)


def test_predictions_equal_a_plain_forward_pass():
    samples = [("aa", "abcab cabba " * 5), ("bb", "xyzzy yxzxy " * 5), ("cc", "été à la école " * 5)]
    languages, weights = language.train(samples, epochs=3)
    steps = language.STEPS
    texts = [b"a", b"xyz abc", "étoile ".encode() * 40, b"q" * steps, b"ab xy " * steps, b"w" * (2 * steps + 1)]
    found = language.predict(weights, texts)
    assert languages == ["aa", "bb", "cc"]
    for text, row in zip(texts, found):
        np.testing.assert_allclose(row, plain_prediction(weights, text), atol=2e-5)
