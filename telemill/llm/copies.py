"""Near copies by SimHash fingerprints, and by the Jaccard similarity of their word shingles: MinHash bands find candidates, whole sets decide."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import connected_components, pieces, stored, text_bytes
from telemill.llm.simhash import near_pairs, simhash
from telemill.session import quoted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24  # two sets of similarity s share none of the bands with a chance of (1 - s ** ROWS) ** BANDS:
ROWS = 5  # 7e-5 at 0.8, 4e-7 at 0.85
BLOCK = 256
SKETCH = 16  # 64-bit words of a set's parity sketch
PAIR_ROWS = 64  # pairs handed to Python at once: each holds two texts


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the different shingles in order; a text with fewer words is one shingle, one without a word has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingle = min(shingle, len(words))
    digest = functools.partial(xxhash.xxh64_intdigest, seed=SEED)
    hashes = map(digest, map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    return np.unique(np.fromiter(hashes, np.uint64, len(words) - shingle + 1))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def permutations(bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """An odd factor for each permutation, the same in every run."""
    return np.random.default_rng(SEED).integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, factors: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One number per band, from the smallest values of ``rows`` permutations of the hashes."""
    lowest = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), BLOCK):
        x = hashes[start : start + BLOCK] * factors[:, None]
        x ^= x >> np.uint64(32)
        x *= factors[:, None]
        np.minimum(lowest, x.min(axis=1), out=lowest)
    key = np.arange(bands, dtype=np.uint64)
    for row in lowest.reshape(bands, rows).T:
        key = _mixed(key * np.uint64(0xBF58476D1CE4E5B9) + row)
    return key


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of different hashes; 1 if both are empty."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - common
    return common / total if total else 1.0


def parity_sketch(hashes: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Bits that tell of each part of the hashes whether an odd number of them is in it.

    Two sets differ in at least as many hashes as their sketches in bits.
    """
    parts = (hashes >> np.uint64(32)) % np.uint64(words * 64)
    odd = np.bincount(parts.astype(np.int64), minlength=words * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_be_similar(similarity: float) -> Column:
    """Whether sets of ``size`` and ``size_b`` hashes, with these sketches, can be that similar; none that is gets lost.

    A similarity of s leaves a difference of (1 - s) / (1 + s) of both sizes together.
    """
    bits = [F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH)]
    apart = sum(bits[1:], bits[0])
    return apart * F.lit(1 + similarity) <= (F.col("size") + F.col("size_b")) * F.lit(1 - similarity) + F.lit(1e-6)


def _row_key() -> Column:
    return F.xxhash64(F.col("text"))


def _prints(docs: DataFrame, shingle: int, fingerprints: bool) -> DataFrame:
    """``(doc_id, k, print, size, sketch, bands, fp)`` per row: a hash of the text, of its shingles a digest, their number,
    their parity sketch and their band keys, and the text's SimHash if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = permutations()
        for batch in pieces(batches):
            texts = [t or b"" for t in text_bytes(batch.column(2))]
            sets = [shingle_set(t, shingle) for t in texts]
            prints = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
            keys = [band_keys(s, factors).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            lists = pa.list_(pa.int64())
            sizes, sketches = pa.array(map(len, sets), pa.int64(), size=len(sets)), pa.array(map(parity_sketch, sets), lists, size=len(sets))
            fps = pa.array(np.array([simhash(t) for t in texts], np.uint64).view(np.int64)) if fingerprints else pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints, pa.binary()), sizes, sketches, pa.array(keys, lists), fps],
                ["doc_id", "k", "print", "size", "sketch", "bands", "fp"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _row_key().alias("k"), "text").mapInArrow(
        run, f"doc_id {key}, k bigint, print binary, size bigint, sketch array<bigint>, bands array<bigint>, fp bigint"
    )


def _rows_of(docs: DataFrame, heads: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of ``docs``, whole in ``kept_row``, with ``own_id`` and ``own_k``, that ``heads`` names by ``head_id`` and ``head_k``."""
    keyed = docs.select(
        F.struct(*[quoted(c) for c in docs.columns]).alias("kept_row"), F.col("doc_id").alias("own_id"), _row_key().alias("own_k")
    )
    named = F.col("own_id").eqNullSafe(F.col("head_id")) & (F.col("own_k") == F.col("head_k"))
    return keyed.join(heads, named, how)


def _similar(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs ``(a, b)`` of prints whose shingle sets are that similar."""
    asked = pairs.select(F.col("a").alias("print")).unionAll(pairs.select(F.col("b").alias("print"))).distinct()
    heads = classes.join(asked, "print", "left_semi").select("print", F.col("head.id").alias("head_id"), F.col("head.k").alias("head_k"))
    texts = _rows_of(docs.select("doc_id", "text"), heads).groupBy("print").agg(F.any_value("kept_row.text").alias("text"))
    texts = stored(texts, "copies-texts")
    left = texts.select(F.col("print").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("print").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, np.zeros(0, np.uint64)
        for batch in pieces(batches):
            near = []
            for a, text_a, text_b in zip(batch.column(0).to_pylist(), text_bytes(batch.column(2)), text_bytes(batch.column(3))):
                if a != last:
                    last, known = a, shingle_set(text_a, shingle)
                near.append(jaccard(known, shingle_set(text_b, shingle)) >= similarity)
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    # Texts may be long, and neither side is bounded: no broadcast.
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "text_a", "text_b")
    return stored(both.mapInArrow(run, "a binary, b binary"), "copies-links", PAIR_ROWS)


def _fingerprint_links(prints: DataFrame, distance: int) -> DataFrame:
    """Links ``(a, b)`` between prints that tie all rows whose fingerprints differ in up to ``distance`` bits.

    Prints with one fingerprint are linked with the smallest of them, which stands for it in the pairs of different fingerprints.
    """
    held = stored(prints.select("print", "fp").distinct(), "copies-fingerprints")
    firsts = stored(held.groupBy("fp").agg(F.min("print").alias("first")), "copies-firsts")
    same = held.join(firsts, "fp").where("print <> first").select(F.col("print").alias("a"), F.col("first").alias("b"))
    left = firsts.select(F.col("fp").alias("a"), F.col("first").alias("first_a"))
    right = firsts.select(F.col("fp").alias("b"), F.col("first").alias("first_b"))
    pairs = near_pairs(firsts.select("fp"), distance)
    near = pairs.join(left, "a").join(right, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return stored(same.unionAll(near).distinct(), "copies-near-prints")


def near_copies(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, distance: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(print, component)`` of every shingle set in ``docs``, and the prints of every row.

    With a ``distance``, rows whose SimHash fingerprints differ in that many bits or fewer are linked, by multi-index hashing.

    Sets that share a band and are ``similarity`` or more alike are linked, whatever
    their number: first each with the two ends of each of its buckets, then the pairs of a bucket
    that are not in one component yet. Pairs whose sizes and parity sketches rule out that similarity
    go where they would arise, so nearly all that are compared by their whole sets are links between components, and
    the components are those of comparing all pairs in all buckets.
    """
    prints = stored(_prints(docs, shingle, distance is not None), "copies-prints")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "k"))
    same = [F.any_value(c).alias(c) for c in ("size", "sketch", "bands")]
    classes = stored(prints.groupBy("print").agg(head.alias("head"), *same), "copies-classes")
    sketches = classes.select("print", "size", "sketch")
    others = classes.select(F.col("print").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b"))
    entries = classes.select("print", F.explode("bands").alias("key"))
    ends = entries.groupBy("key").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low <> high")
    shared = stored(entries.join(ends, "key"), "copies-buckets")
    star = shared.select("print", F.explode(F.array("low", "high")).alias("end")).where("print <> end")
    star = stored(star.select(F.least("print", "end").alias("a"), F.greatest("print", "end").alias("b")).distinct(), "copies-ends")
    star = star.join(sketches.withColumnRenamed("print", "a"), "a").join(others, "b").where(_may_be_similar(similarity))
    star = stored(star.select("a", "b"), "copies-pairs")
    links = _similar(star, docs, classes, shingle, similarity)
    if distance is not None:
        links = links.unionAll(_fingerprint_links(prints, distance))
    roots = connected_components(links, "copies-components").withColumnRenamed("node", "print")

    placed = shared.select("print", "key").join(roots, "print", "left").select(
        "key", "print", F.coalesce("root", "print").alias("root")
    )
    placed = stored(placed, "copies-placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("m"), F.max("root").alias("n")).where("m <> n").select("key")
    open_ = stored(placed.join(mixed, "key", "left_semi").join(sketches, "print"), "copies-open")
    other = open_.select(
        "key", F.col("print").alias("b"), F.col("root").alias("root_b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b")
    )
    apart = (F.col("print") < F.col("b")) & (F.col("root") != F.col("root_b"))
    rest = open_.join(other, "key").where(apart & _may_be_similar(similarity)).select(F.col("print").alias("a"), "b").distinct()
    rest = stored(rest.join(star, ["a", "b"], "left_anti"), "copies-pairs")
    if not rest.isEmpty():
        links = links.unionAll(_similar(rest, docs, classes, shingle, similarity))
        roots = connected_components(links, "copies-components").withColumnRenamed("node", "print")
    labels = classes.join(roots, "print", "left").select("print", "head", F.coalesce("root", "print").alias("component"))
    return labels, prints


def drop_near_copies(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, distance: int | None = None
) -> DataFrame:
    """One row of each component of near copies: that of the smallest ``doc_id``, and one without an id if none has any.

    Near copies have word shingles whose Jaccard similarity is ``similarity`` or more; words are split at
    white space, and ASCII letters compared without case. With a ``distance``, texts whose SimHash fingerprints (``simhash``) differ in up to
    that many bits are near copies too; links of both kinds make up the components. Rows are told apart by ``doc_id`` and text, so repeated rows are copies of each
    other like any others. All texts without a word are copies of one another.
    """
    labels, prints = near_copies(docs, shingle, similarity, distance)
    kept = labels.groupBy("component").agg(F.min("head").alias("head"))
    kept = stored(kept.select(F.col("head.id").alias("head_id"), F.col("head.k").alias("head_k")), "copies-kept")
    again = prints.groupBy("doc_id", "k").count().where("count > 1").select("doc_id", "k")
    repeated = stored(_named(kept, again, "left_semi"), "copies-repeated")
    if repeated.isEmpty():
        return _rows_of(docs, kept, "left_semi").select("kept_row.*")
    once = _rows_of(docs, _named(kept, again, "left_anti"), "left_semi")
    one = _rows_of(docs, repeated, "left_semi").dropDuplicates(["own_id", "own_k"])
    return once.unionByName(one).select("kept_row.*")


def _named(kept: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    return kept.join(rows, F.col("head_id").eqNullSafe(F.col("doc_id")) & (F.col("head_k") == F.col("k")), how)
