"""Phrase collocations from a weighted de Bruijn graph of the longest word runs.

An edge is a run of ``longest`` words, its nodes the overlapping runs of one word less at both ends, its
weight how often it occurs. Every word position begins one edge, or, near the end of a piece, a shorter run (the
piece-end corrections). So the count of a shorter run is the weight that flows out of its node: all
edges and ends that begin with it, level by level, each from the level above. A node whose whole flow
runs on through one edge (a unary path) adds nothing to that edge, and is compacted into it.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm.common import pieces, remove_stored, stored, text_bytes
from telemill.session import join_lookup

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONGEST = 5
MIN_COUNT = 100
ABSORBED = 100  # per cent of a phrase's occurrences that a longer one must take to absorb it
TOP = 2000
COUNTED_WORDS = 300_000  # different words a task counts before it sends its counts on
KNOWN_WORDS = 500_000  # words that are broadcast with their numbers, about 30 bytes each
FLUSH = 200_000  # words to a row of codes
PAIRS_AT_ONCE = 2_000_000  # pairs of words counted before they are sent on
FILTER_BITS = 1 << 26  # of the bitmap of frequent pairs, 8 MB

_LOWER = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 10
)


def tokens(text: bytes | None) -> list[bytes]:
    """Words in order, ``\\n`` between pieces; empty strings among them count for nothing."""
    return (text or b"").translate(_LOWER).replace(b"\n", b" \n ").split(b" ")


def word_counts(docs: DataFrame) -> DataFrame:
    """``(lang, word, f)`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[pa.RecordBatch]:
            while met:
                lang, counts = met.popitem()
                counts.pop(b"", None)
                counts.pop(b"\n", None)
                words = pa.array(counts.keys(), pa.binary(), size=len(counts)).cast(pa.string())
                f = np.fromiter(counts.values(), np.int64, len(counts))
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(words)), words, pa.array(f)], ["lang", "word", "f"])

        met: dict[str, Counter] = {}
        for batch in pieces(batches):
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                met.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, met.values())) > COUNTED_WORDS:
                yield from rows()
        yield from rows()

    found = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(
        run, "lang string, word string, f bigint"
    )
    return found.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def code_of(lang: str, word: bytes) -> int:
    """A negative number for a word that has none of its own."""
    return -1 - (xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word) >> 1)


def coded(docs: DataFrame, known: dict[str, dict[bytes, int]], complete: bool) -> DataFrame:
    """``(codes)``: all texts as words' numbers, many texts to a row, with 0 between pieces.

    If ``complete``, words without a number are too rare for any phrase and end a piece; else they go by their hashes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held = shared.value, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.array(held, np.int64)], pa.list_(pa.int64()))], ["codes"])

        for batch in pieces(batches):
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                own = tables.get(lang, {})
                words = tokens(text)
                if complete:
                    held += [own.get(w, 0) for w in words if w]
                else:
                    held += [own.get(w) or (0 if w == b"\n" else code_of(lang, w)) for w in words if w]
                held.append(0)
                if len(held) > FLUSH:
                    yield row()
                    held.clear()
        yield row()

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, "codes array<bigint>")


def _flat(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for codes in batch.column(0):
        yield np.concatenate([codes.values.to_numpy(), np.zeros(1, np.int64)])


def pair_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of each word and the next one."""
    x = codes[:-1].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + codes[1:].view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def frequent_pairs(codes: DataFrame, min_count: int) -> np.ndarray:
    """A bitmap of fixed size, in bytes, with a bit for the hash of every pair of words that is frequent enough for a phrase.

    Other pairs may share a bit; they cost work, but change no count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            pairs, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64)), pa.array(counts)], ["pair", "f"])

        for batch in batches:
            for flat in _flat(batch):
                held.append(pair_hashes(flat)[(flat[:-1] != 0) & (flat[1:] != 0)])
                size += len(held[-1])
                if size > PAIRS_AT_ONCE:
                    yield rows()
                    held.clear()
                    size = 0
        if held:
            yield rows()

    pairs = codes.mapInArrow(run, "pair bigint, f bigint").groupBy("pair").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
    place = pairs.select((F.pmod("pair", F.lit(FILTER_BITS)) + 1).alias("place"))  # bits are numbered from 1
    parts = place.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    found = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in stored(parts, "phrase-filter", batch_rows=1).collect():  # no more than FILTER_BITS all together
        start = (row.bucket - 1) * len(row.bits)
        found[start : start + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return found


def edges(codes: DataFrame, pairs: np.ndarray, longest: int) -> DataFrame:
    """``(w1 ... wn, f)``: for each position the longest run of up to ``longest`` words, 0 behind a shorter one.

    A run ends with its piece, or where the next pair of words is too rare for any phrase.
    """
    shared = codes.sparkSession.sparkContext.broadcast(pairs)
    names = [f"w{i}" for i in range(1, longest + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for flat in _flat(batch):
                place = pair_hashes(flat).view(np.int64) % FILTER_BITS
                joined = (flat[:-1] != 0) & (flat[1:] != 0) & (bits[place >> 3] >> (place & 7) & 1 == 1)
                joined = np.concatenate([joined, np.zeros(longest, bool)])
                flat = np.concatenate([flat, np.zeros(longest, np.int64)])
                starts = np.flatnonzero(joined)  # single words are counted already
                columns, open_ = [pa.array(flat[starts])], np.ones(len(starts), bool)
                for i in range(1, longest):
                    open_ &= joined[starts + i - 1]
                    columns.append(pa.array(np.where(open_, flat[starts + i], 0)))
                yield pa.RecordBatch.from_arrays(columns, names)

    found = codes.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
    return found.groupBy(*names).agg(F.count("*").alias("f"))


def phrase_counts(docs: DataFrame, frequent: DataFrame, complete: bool, longest: int, min_count: int) -> DataFrame:
    """``(p, f)``: runs of 2 to ``longest`` words, as arrays of their numbers, that occur ``min_count`` times or more."""
    known: dict[str, dict[bytes, int]] = {}
    for batch in frequent.select("lang", "word", "id").toArrow().to_batches():
        for lang, word, number in zip(*(c.to_pylist() for c in batch.columns)):
            known.setdefault(lang, {})[word.encode()] = number
    # One level at a time: the flow out of the nodes of a level is summed up from the level above, which then goes.
    codes = stored(coded(docs, known, complete), "phrase-codes")
    pairs = frequent_pairs(codes, min_count)
    level, found = stored(edges(codes, pairs, longest), "phrase-edges", batch_rows=1), None
    remove_stored(codes)
    for size in range(longest, 1, -1):
        names = [f"w{i}" for i in range(1, size + 1)]
        often = level.where(f"f >= {min_count} AND w{size} <> 0").select(F.array(*names).alias("p"), "f")
        often = stored(often, "phrases")
        found = often if found is None else found.unionAll(often)
        if size > 2:
            nodes = level.groupBy(*names[:-1]).agg(F.sum("f").alias("f"))
            above, level = level, stored(nodes, "phrase-nodes")
            remove_stored(above)
    remove_stored(level)
    return found


def collocations(
    docs: DataFrame,
    longest: int = LONGEST,
    min_count: int = MIN_COUNT,
    absorbed: int = ABSORBED,
    top: int = TOP,
    known_words: int = KNOWN_WORDS,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language.

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\n-\\r]`` into pieces and those into words ``[^\\x20\\x09]+``. A null text
    is empty, a null language ``und``. A phrase of 2 to ``longest`` words that occurs ``a >= min_count`` times in
    its language is cut after its first ``k`` words into parts that occur ``l`` and ``r`` times; its score is
    the lowest ``floor(1000 a n / (l r))`` of all cuts, that of the smallest ``k`` if several are equal, ``n`` being the language's
    words. It is dropped if a longer phrase holds it and takes ``absorbed`` per cent of its occurrences. Ranks go by
    score, then ``a``, both descending, then the phrase in the order of its bytes. Repeated rows count as often as they occur; other
    columns are ignored; an empty table has no phrases.

    Counts are exact at any size. A phrase holds no word and no pair of words that is rarer than itself, so words and pairs below
    ``min_count`` end pieces (pairs by a bitmap of fixed size, which may let rare ones pass, but no frequent one end). Words are numbered, and up to ``known_words`` of them, the most frequent, are broadcast with
    their numbers; if there are more, all other words travel as 63-bit hashes.
    """
    rows = docs.select("lang", "text")
    words = stored(word_counts(rows), "phrase-words")
    totals = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    often = stored(words.where(F.col("f") >= min_count), "phrase-often")
    remove_stored(words)
    complete = often.count() <= known_words
    least = min_count
    if not complete:
        # The smallest count whose words, with all of higher counts, are no more than may be broadcast.
        sizes = often.groupBy("f").agg(F.count("*").alias("words"))
        so_far = Window.orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        fit = sizes.withColumn("all", F.sum("words").over(so_far)).where(F.col("all") <= known_words)
        least = fit.agg(F.min("f")).first()[0] or (1 << 62)
    # In one task, for small numbers: no more rows than may be broadcast.
    numbered = often.where(F.col("f") >= least).coalesce(1).withColumn("id", F.monotonically_increasing_id() + 1)
    frequent = stored(numbered, "phrase-vocabulary")
    phrases = phrase_counts(rows, frequent, complete, longest, min_count)

    vocabulary = frequent
    if not complete:
        rest = often.where(F.col("f") < least)
        vocabulary = vocabulary.unionAll(stored(_hashed(rest), "phrase-hashed"))
    counts = phrases.unionAll(vocabulary.select(F.array("id").alias("p"), "f"))

    # Unary nodes: all their flow goes on to one longer phrase. Longer ones still are reached one word at a time.
    size = F.size("p")
    longer = phrases.where(size > 2).select(
        F.explode(F.array(F.slice("p", F.lit(1), size - 1), F.slice("p", F.lit(2), size - 1))).alias("p"), "f"
    )
    most = longer.groupBy("p").agg(F.max("f").alias("most"))
    kept = phrases.join(most, "p", "left").where(
        F.coalesce(F.lit(100) * F.col("most") < F.lit(absorbed) * F.col("f"), F.lit(True))
    )
    kept = stored(kept.select("p", F.col("f").alias("a")), "phrases-kept")

    cut = kept.select("p", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.select(
        "p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("left"), F.slice("p", F.col("k") + 1, size - F.col("k")).alias("right")
    )
    left, right = counts.select(F.col("p").alias("left"), F.col("f").alias("l")), counts.select(F.col("p").alias("right"), F.col("f").alias("r"))
    cut = stored(cut.join(left, "left").select("p", "a", "k", "right", "l").join(right, "right").select("p", "a", "k", "l", "r"), "phrase-cuts")

    cut = cut.groupBy("p", "a").agg(F.collect_list(F.struct("k", "l", "r")).alias("cuts"))
    spelled = cut.select("p", "a", "cuts", F.posexplode("p").alias("at", "id"))
    spelled = join_lookup(spelled, vocabulary.select("id", "lang", "word"), ["id"]).groupBy("p").agg(
        F.any_value("lang").alias("lang"), F.any_value("a").alias("a"), F.any_value("cuts").alias("cuts"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"),
    )
    scored = _scored(join_lookup(spelled, totals, ["lang"]).select("lang", "phrase", "a", "n", "cuts"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _hashed(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [code_of(lang, word.encode()) for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int64())], ["lang", "word", "f", "id"])

    return words.select("lang", "word", "f").mapInArrow(run, "lang string, word string, f bigint, id bigint")


def _scored(rows: DataFrame) -> DataFrame:
    """The cut that counts, in whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, n = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            best = [
                min((1000 * x * y // (c["l"] * c["r"]), c["k"], c["l"], c["r"]) for c in cuts)
                for x, y, cuts in zip(a, n, batch.column(4).to_pylist())
            ]
            found = np.array(best, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(found[2]), pa.array(found[3]), pa.array(found[0])],
                ["lang", "phrase", "a", "n", "l", "r", "score"],
            )

    return rows.mapInArrow(run, "lang string, phrase string, a bigint, n bigint, l bigint, r bigint, score bigint")
