"""Repeated passages across documents: seeds from winnowing, extended to whole windows."""

from __future__ import annotations

import hashlib
import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import pieces, remove_stored, stored, text_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 13
SEED_WORDS = 5
_BASE = 0x9E3779B97F4A7C15
_SECOND_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_CACHE = 400_000


class WordHashes(dict):
    """XXH64 of each word met, kept for as long as the memory bound allows."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes."""
    total = len(words) - size + 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(total, np.uint64), 1
    for i in range(size):
        out += words[i : i + total] * np.uint64(factor)
        factor = factor * _BASE & _MASK
    return _mix(out)


def found_among(one: np.ndarray, two: np.ndarray, wanted: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which pairs are among the wanted ones."""
    order = np.argsort(wanted)
    wanted, second = wanted[order], second[order]
    hit = np.zeros(len(one), bool)
    place = np.searchsorted(wanted, one)
    while True:  # once more for each repetition of the first 64 bits, which is next to never
        inside = place < len(wanted)
        inside[inside] = wanted[place[inside]] == one[inside]
        if not inside.any():
            return hit
        hit[inside] |= second[place[inside]] == two[inside]
        place = np.where(inside, place + 1, len(wanted))


def chosen_seeds(words: np.ndarray, window: int, seed_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes, and the position of the seed that stands for each window.

    Every window of ``window`` words is stood for by the smallest of the hashes of
    its runs of ``seed_words`` words, the last of them if several are equal. The
    choice depends on the window's words alone, so equal windows choose equal seeds.
    """
    hashes = gram_hashes(words, seed_words)
    total = len(words) - window + 1
    if total <= 0:
        return hashes, np.zeros(0, np.int64)
    best, place = hashes[:total].copy(), np.arange(total)
    for i in range(1, window - seed_words + 1):
        other = hashes[i : i + total]
        place = np.where(other <= best, np.arange(i, i + total), place)
        np.minimum(best, other, out=best)
    return hashes, place


class Words:
    """The words of several texts one after the other, as hashes; what spans two texts counts for neither."""

    def __init__(self, texts: list[bytes | None], known: WordHashes):
        self.texts = [(text or b"").split() for text in texts]
        self.sizes = np.array([len(words) for words in self.texts], np.int64)
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        flat = itertools.chain.from_iterable(self.texts)
        self.hashes = np.fromiter(map(known.__getitem__, flat), np.uint64, len(self.owner))

    def windows(self, window: int) -> np.ndarray:
        """Where windows start that lie within one text."""
        return np.flatnonzero(self.owner[: len(self.owner) - window + 1] == self.owner[window - 1 :]) if len(self.owner) >= window else np.zeros(0, np.int64)

    def hashes_at(self, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """96 bits for each window: 64, and 32 of another hash."""
        one, two = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        factors = 1, 1
        for i in range(window):
            word = self.hashes[starts + i]
            one += word * np.uint64(factors[0])
            two += word * np.uint64(factors[1])
            factors = factors[0] * _BASE & _MASK, factors[1] * _SECOND_BASE & _MASK
        return _mix(one), _mix(two) >> np.uint64(32)


def _of_owner(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A hash that also tells the texts of a batch apart."""
    return hashes + owner.astype(np.uint64) * np.uint64(_SECOND_BASE)


def _once(owner: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Places of rows, each kept once (a rare repetition may stay)."""
    key = _of_owner(columns[0], owner)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    same = [np.diff(c[order].view(np.int64)) == 0 for c in (key, *columns)]
    new[1:] = ~np.logical_and.reduce(same)
    return order[new]


def _by_owner(ids: pa.Array, owner: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    values = [pa.array(c.view(np.int64 if c.itemsize == 8 else np.int32)) for c in columns]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), *values], names)


def seeds(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """``(doc_id, seed)``: each seed of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in pieces(batches):
            words = Words(text_bytes(batch.column(1)), known)
            hashes, place = chosen_seeds(words.hashes, window, seed_words)
            at = np.unique(place[words.windows(window)])
            owner, found = words.owner[at], hashes[at]
            kept = _once(owner, found)
            yield _by_owner(batch.column(0), owner[kept], [found[kept]], ["doc_id", "seed"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, seed bigint")


def _flat_lists(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All values of a column of lists, and the row of each."""
    sizes = [len(x) if x.is_valid else 0 for x in lists]
    return lists.flatten(), np.repeat(np.arange(len(lists)), sizes)


def _extended(docs: DataFrame, window: int, seed_words: int) -> DataFrame:
    """``(doc_id, m1, m2)``: 96-bit hashes of the windows whose seed is in the row's ``shared`` list.

    Around a seed these are all the ways to extend it left and right to the length threshold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in pieces(batches):
            words = Words(text_bytes(batch.column(1)), known)
            hashes, place = chosen_seeds(words.hashes, window, seed_words)
            starts = words.windows(window)
            shared, of = _flat_lists(batch.column(2))
            # Seeds that only look alike add windows, which are compared by themselves.
            wanted = _of_owner(shared.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), of)
            starts = starts[np.isin(_of_owner(hashes[place[starts]], words.owner[starts]), wanted)]
            (one, two), owner = words.hashes_at(starts, window), words.owner[starts]
            kept = _once(owner, one, two)
            yield _by_owner(batch.column(0), owner[kept], [one[kept], two[kept].astype(np.uint32)], ["doc_id", "m1", "m2"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "shared").mapInArrow(run, f"doc_id {key}, m1 bigint, m2 int")


def later_matches(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """``(doc_id, repeats)``: hashes of the row's windows that also start in a row with a smaller ``doc_id``.

    Seeds that only one document holds can extend to no match and go first; of
    the rest, rows are told apart by whole windows. Documents are never paired,
    so a passage that very many share costs no more than the places it stands in.
    """
    rows = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    # Each step is a table of its own: it is worked out once, and a join of plain tables can be split at busy seeds and windows.
    found = stored(seeds(rows, window, seed_words), "repeat-found")
    ends = F.min("doc_id").alias("x"), F.max("doc_id").alias("y")
    common = stored(found.groupBy("seed").agg(*ends).where("x <> y").select("seed"), "repeat-common")
    shared = stored(found.join(common, "seed", "left_semi"), "repeat-seeds")
    remove_stored(found, common)
    lists = stored(shared.groupBy("doc_id").agg(F.collect_set("seed").alias("shared")), "repeat-lists")
    remove_stored(shared)
    matches = stored(_extended(rows.join(lists, "doc_id"), window, seed_words), "repeat-windows")
    first = stored(matches.groupBy("m1", "m2").agg(*ends).where("x <> y").select("m1", "m2", "x"), "repeat-first")
    later = stored(matches.join(first, ["m1", "m2"]).where("doc_id > x").select("doc_id", "m1", "m2"), "repeat-later")
    remove_stored(matches, first, lists)
    return stored(later.groupBy("doc_id").agg(F.collect_set(F.struct("m1", "m2")).alias("repeats")), "repeat-of-rows")


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """Per row ``(doc_id, n_words, n_removed, kept_text, kept_sha256, repeats)``.

    A word goes if a window of ``window`` words over it, as it stands in the input,
    also starts in a document with a smaller ``doc_id``; neighbouring windows make up the maximal
    repeat, listed in ``repeats`` as ``start:end`` in words, end exclusive. A null text
    has no words. Rows without a ``doc_id`` are left as they are and count for nobody
    else. Rows that repeat a ``doc_id`` are one document to the comparison and an
    own row in the result. Other columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    known_repeats = later_matches(rows, window, seed_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in pieces(batches):
            counts, gone, texts, sums, spans = [], [], [], [], []
            contents, listed = text_bytes(batch.column(1)), batch.column(2).is_valid().to_pylist()
            # Only texts with repeats are hashed again.
            some = Words([t if has else b"" for t, has in zip(contents, listed)], known)
            starts = some.windows(window)
            repeats, of = _flat_lists(batch.column(2))
            wanted, second = (c.to_numpy() for c in repeats.flatten())
            wanted = _of_owner(wanted.astype(np.int64).view(np.uint64), of)
            one, two = some.hashes_at(starts, window)
            one = _of_owner(one, some.owner[starts])
            starts = starts[found_among(one, two, wanted, second.astype(np.int32).view(np.uint32))]
            edge = np.zeros(len(some.owner) + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
            every, at = np.cumsum(edge[:-1]) > 0, 0
            for text, has, words in zip(contents, listed, some.texts):
                words = words if has else (text or b"").split()
                runs: list[str] = []
                n = len(words)
                if has:
                    covered = every[at : at + n]
                    at += n
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                    runs = [f"{x}:{y}" for x, y in zip(turns[::2], turns[1::2])]
                    words = list(itertools.compress(words, (~covered).tolist()))
                kept = b" ".join(words)
                counts.append(n)
                gone.append(n - len(words))
                texts.append(kept)
                sums.append(hashlib.sha256(kept).hexdigest())
                spans.append(runs)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                    pa.array(sums, pa.string()),
                    pa.array(spans, pa.list_(pa.string())),
                ],
                ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "repeats"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(known_repeats, "doc_id", "left").mapInArrow(
        run,
        f"doc_id {key}, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string, repeats array<string>",
    )
