"""Language identification: a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm.common import pieces, text_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEPS = 48  # bytes in a window
HIDDEN = 8
SLOTS = 64  # that the texts of a language are dealt to while its sample is picked
SAMPLE_DOCS = 500  # different texts of each language to learn from
SAMPLE_CHARS = 400  # characters of each
EPOCHS = 300
MANY = 200  # with more languages there are more epochs, so that each is shown as often
BATCH = 96
RATE = 0.02
FOLDS = 5
SLAB = 4096  # windows worked on at once, of up to 32 languages
UNKNOWN = "und"


def _squash(x: np.ndarray) -> np.ndarray:
    """``x / (1 + |x|)``: has the shape of tanh and costs a small part of it. Works in place."""
    size = np.abs(x)
    size += 1
    x /= size
    return x


def forward(weights: dict[str, np.ndarray], windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits ``(step, language, window)`` of windows of bytes ``(window, step)``.

    ``keep`` collects what the way back needs. Gates are squashed into (0, 1), states into (-1, 1).
    """
    count, steps = windows.shape
    hidden = weights["u"].shape[2]
    by_step = np.ascontiguousarray(windows.T).astype(np.intp)
    logits = np.empty((steps, weights["o"].shape[1], count), np.float32)
    logits[:] = weights["b"]
    given = np.empty((3 * hidden, count), np.float32)
    for way in (0, 1):
        state = np.zeros((hidden, count), np.float32)
        for t in range(steps) if way == 0 else reversed(range(steps)):
            np.take(weights["x"][way], by_step[t], axis=1, out=given, mode="clip")
            pulled = weights["u"][way] @ state
            gates = _squash(given[: 2 * hidden] + pulled[: 2 * hidden])
            gates *= 0.5
            gates += 0.5
            z, r = gates[:hidden], gates[hidden:]
            own = pulled[2 * hidden :]
            own += weights["c"][way]
            new = r * own
            new += given[2 * hidden :]
            new = _squash(new)
            after = state - new
            after *= z
            after += new
            if keep is not None:
                keep[way, t] = (state, z, r, own, new, after)
            state = after
            logits[t] += weights["o"][way] @ state
    return logits


def probabilities(logits: np.ndarray) -> np.ndarray:
    """Of each language ``(step, language, window)``. Works in place."""
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def backward(
    weights: dict[str, np.ndarray], windows: np.ndarray, keep: dict, error: np.ndarray
) -> dict[str, np.ndarray]:
    """Gradients through time, given those of the logits."""
    steps = windows.shape[1]
    grads = {k: np.zeros_like(v) for k, v in weights.items()}
    grads["b"] = error.sum(axis=(0, 2))[:, None]
    bytes_met = np.eye(256, dtype=np.float32)
    for way in (0, 1):
        carry = np.float32(0)
        for t in reversed(range(steps)) if way == 0 else range(steps):
            state, z, r, own, new, after = keep[way, t]
            grads["o"][way] += error[t] @ after.T
            d = carry + weights["o"][way].T @ error[t]
            d_new = d * (1 - z) * (1 - np.abs(new)) ** 2
            d_z = d * (state - new) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            d_own = d_new * r
            d_r = d_new * own * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            pulled = np.concatenate([d_z, d_r, d_own])
            grads["c"][way] += d_own.sum(axis=1, keepdims=True)
            grads["u"][way] += pulled @ state.T
            grads["x"][way] += np.concatenate([d_z, d_r, d_new]) @ bytes_met[windows[:, t]]
            carry = d * z + weights["u"][way].T @ pulled
    return grads


def windows_of(text: bytes, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text in windows ``(window, step)``, and which positions count.

    The last window reaches back over bytes already seen, which then don't count
    again; a text shorter than a window is filled up with spaces.
    """
    data = np.frombuffer(text, np.uint8)
    if len(data) <= steps:
        full = np.full(steps, 32, np.uint8)
        full[: len(data)] = data
        return full[None], (np.arange(steps) < len(data))[None]
    whole, rest = divmod(len(data), steps)
    windows = data[: whole * steps].reshape(whole, steps)
    counts = np.ones((whole + (rest > 0), steps), bool)
    if rest:
        windows = np.concatenate([windows, data[None, -steps:]])
        counts[-1, : steps - rest] = False
    return windows, counts


def train(samples: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 7) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages and weights learned from ``(lang, text)`` rows by backpropagation through time, with Adam."""
    languages = sorted({lang for lang, _ in samples})
    number = {lang: i for i, lang in enumerate(languages)}
    epochs = epochs * max(len(languages), MANY) // MANY
    rng = np.random.default_rng(seed)
    k, h = len(languages), HIDDEN
    weights = {
        "x": rng.normal(0, 0.3, (2, 3 * h, 256)),
        "u": rng.normal(0, 0.3, (2, 3 * h, h)),
        "c": np.zeros((2, h, 1)),
        "o": rng.normal(0, 0.3, (2, k, h)),
        "b": np.zeros((k, 1)),
    }
    weights = {name: w.astype(np.float32) for name, w in weights.items()}
    if k < 2:
        return languages, weights
    parts, owners = [], []
    for lang, text in samples:
        windows, _ = windows_of(text.encode())
        parts.append(windows)
        owners += [number[lang]] * len(windows)
    data, label = np.concatenate(parts), np.array(owners)
    groups = [np.flatnonzero(label == i) for i in range(k)]
    mean = {n: np.zeros_like(w) for n, w in weights.items()}
    square = {n: np.zeros_like(w) for n, w in weights.items()}
    for step in range(1, epochs + 1):
        lang = rng.integers(0, k, BATCH)
        chosen = np.array([groups[i][rng.integers(len(groups[i]))] for i in lang])
        keep: dict = {}
        error = probabilities(forward(weights, data[chosen], keep))
        error[:, lang, np.arange(BATCH)] -= 1
        grads = backward(weights, data[chosen], keep, error / (BATCH * STEPS))
        rate = RATE * (1 - step / (epochs + 1))
        for n, g in grads.items():
            mean[n] = 0.9 * mean[n] + 0.1 * g
            square[n] = 0.99 * square[n] + 0.01 * g * g
            fit = (mean[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.99**step)) + 1e-8)
            weights[n] = (weights[n] - rate * fit).astype(np.float32)
    return languages, weights


def predict(weights: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Mean probability of each language over all bytes of each text."""
    total = np.zeros((len(texts), len(weights["b"])))
    queue: list[tuple[int, np.ndarray, np.ndarray]] = []
    waiting = 0
    slab = max(1, SLAB * 32 // max(32, len(weights["b"])))

    def flush() -> None:
        windows = np.concatenate([w for _, w, _ in queue])
        counts = np.concatenate([c for _, _, c in queue])
        owner = np.repeat([i for i, _, _ in queue], [len(w) for _, w, _ in queue])
        labelled = probabilities(forward(weights, windows))  # every position
        pooled = (labelled * counts.T[:, None]).sum(axis=0, dtype=np.float64)
        np.add.at(total, owner, pooled.T)

    for i, text in enumerate(texts):
        windows, counts = windows_of(text)
        for start in range(0, len(windows), slab):
            queue.append((i, windows[start : start + slab], counts[start : start + slab]))
            waiting += len(queue[-1][1])
            if waiting >= slab:
                flush()
                queue, waiting = [], 0
    if queue:
        flush()
    return total / np.maximum([len(t) for t in texts], 1)[:, None]


def held_out(doc_id) -> "F.Column":
    """Documents that nothing is learned from: crc32 of the id's text leaves 0 modulo five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """A sample ``(lang, text)``: a stretch of up to ``per_language`` different texts of each language there is.

    Those with the smallest hashes are picked, and stretches by the hash too, alike in every run. However
    often a text is repeated, it counts once.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    usable = usable.where("doc_id IS NOT NULL").select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("pick"))
    # The stretches are cut before anything is shuffled.
    start = F.pmod(F.col("pick"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    parts = usable.select("lang", "pick", F.col("text").substr(start.cast("int"), F.lit(SAMPLE_CHARS)).alias("part"))
    # The smallest picks of each slot of a language, then those of the language: one of very many texts is no burden to a task.
    picked = usable.select("lang", "pick", F.pmod("pick", F.lit(SLOTS)).alias("slot")).distinct()
    for keys in (["lang", "slot"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy("pick")
        picked = picked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).drop("n")
    rows = (
        parts.join(picked.drop("slot"), ["lang", "pick"], "left_semi")
        .distinct()
        .orderBy("pick", "lang", "part")
        .collect()
    )
    return [(r["lang"], r["part"]) for r in rows]


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` per row.

    The network is learned from a sample of all languages among the labelled rows outside the held-out fold and
    then labels every byte of every whole text; the means of the labels' probabilities decide. A text that is null or
    holds no letter is ``und`` with score 0, as are all if there is no labelled row. Rows are judged
    one by one: repeated rows have equal results. ``lang`` and all other columns play no part in a prediction.
    """
    languages, weights = train(training_sample(docs))
    names = [*languages, UNKNOWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 128):
            texts = [t or b"" for t in text_bytes(batch.column(2))]
            ok = np.array(batch.column(3).to_pylist(), bool)
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            if languages and ok.any():
                pooled = predict(weights, [t for t, good in zip(texts, ok) if good])
                best[ok], score[ok] = pooled.argmax(axis=1), np.clip(pooled.max(axis=1), 0, 1)
            found = pa.array([names[i] for i in best], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), found, pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text",
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("ok"),
    )
    return rows.mapInArrow(run, f"doc_id {key}, held_out boolean, lang_pred string, score double")
