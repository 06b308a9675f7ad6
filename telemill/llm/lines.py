"""Line dedup: overlapping documents are aligned in pairs, and the later one gives up the common blocks."""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import pieces, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_WORDS = 10
RARE_FLOOR = 20  # no rule of this module any more: the plain comparison in the tests takes its seeds by them
RARE_SHARE = 0.1
TRIED = 8
ALIGNED_ROWS = 64  # pairs handed to Python at once: each holds the lines of two documents
_FACTOR = 0x9E3779B97F4A7C15


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of the common lines that patience diff aligns, in order.

    Lines that occur once on either side, in the longest run of equal order, are
    fixed points; equal lines that follow or precede a fixed point directly
    are aligned with it, and the gaps between are treated in the same way.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: i for i, x in enumerate(a[a0:a1], a0) if once_a[x] == 1 and once_b[x] == 1}
        points = [(place[x], j) for j, x in enumerate(b[b0:b1], b0) if x in place]
        tops: list[int] = []
        ends: list[int] = []
        before: list[int] = [-1] * len(points)
        for k, (i, _) in enumerate(points):
            at = bisect_left(tops, i)
            before[k] = ends[at - 1] if at else -1
            tops[at : at + 1], ends[at : at + 1] = [i], [k]
        chain, k = [], ends[-1] if ends else -1
        while k >= 0:
            chain.append(points[k])
            k = before[k]
        left_a, left_b = a0, b0
        for i, j in reversed(chain):
            todo.append((left_a, i, left_b, j))
            out.append((i, j))
            left_a, left_b = i + 1, j + 1
        if chain:
            todo.append((left_a, a1, left_b, b1))
    return sorted(out)


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Lines of ``b`` in blocks that stand in both texts without a break and hold ``min_words`` words of ``b``."""
    gone: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in block) >= min_words:
                gone += block
            block = []
        block.append(j)
        last = (i, j)
    return gone


def _lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, hashes, words)`` of the lines that hold a word, as two arrays in the order of the text."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = F.transform(lines, lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")))
    return docs.select("doc_id", cut.alias("lines")).select(
        "doc_id",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"),
        F.transform("lines", lambda x: F.size(F.split(x, r"[\x20\x09-\x0D]+"))).alias("words"),
    )


def windows(hashes: np.ndarray, words: np.ndarray, cuts: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """``(row, start, stop, key)`` of the shortest runs of lines of ``min_words`` words, from each line on and up to each line.

    ``cuts`` has the place of the first line of each row, and the end. Every common block of ``min_words`` words is a union of such runs, and they
    have equal keys in both texts.
    """
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    line = np.arange(n)
    stop = np.searchsorted(total, total[:-1] + min_words)
    start = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    on, upto = stop <= cuts[owner + 1], start >= cuts[owner]
    runs = np.unique(np.concatenate([line[on] * (n + 1) + stop[on], start[upto] * (n + 1) + line[upto] + 1]))
    start, stop = np.divmod(runs, n + 1)
    powers, back = (
        np.multiply.accumulate(np.array([1] + [f] * n, np.uint64)) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64))
    )
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes.view(np.uint64) * powers[:-1], dtype=np.uint64)])
    key = (sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64)
    key = (key ^ (key >> np.uint64(32))) * np.uint64(_FACTOR)
    row = owner[start]
    return row, start - cuts[row], stop - cuts[row], (key ^ (key >> np.uint64(29))).view(np.int64)


def _windows(heads: DataFrame, min_words: int) -> DataFrame:
    """``(doc_id, start, stop, key)`` of the runs of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes, words = batch.column(1), batch.column(2)
            cuts = np.asarray(hashes.offsets, dtype=np.int64)
            row, start, stop, key = windows(
                np.asarray(hashes.flatten()).astype(np.int64), np.asarray(words.flatten()), cuts - cuts[0], min_words
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(key)],
                ["doc_id", "start", "stop", "key"],
            )

    kind = heads.schema["doc_id"].dataType.simpleString()
    return heads.select("doc_id", "hashes", "words").mapInArrow(run, f"doc_id {kind}, start int, stop int, key bigint")


def _aligned(pairs: DataFrame, heads: DataFrame, min_words: int) -> DataFrame:
    """``(doc_id, gone)`` of the pairs ``(doc_id, first)`` that have common blocks."""
    earlier = heads.select(F.col("doc_id").alias("first"), F.col("hashes").alias("earlier"))
    # None of these tables is bounded, so none is broadcast, however small it may be.
    both = pairs.join(earlier.hint("merge"), "first").join(heads.hint("merge"), "doc_id").select("doc_id", "earlier", "hashes", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            gone = [
                common_blocks(e.tolist(), h.tolist(), w.tolist(), min_words)
                for e, h, w in zip(
                    *([np.asarray(x.values) for x in batch.column(i)] for i in (1, 2, 3))
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "gone"]
            )

    key = heads.schema["doc_id"].dataType.simpleString()
    return stored(both.mapInArrow(run, f"doc_id {key}, gone array<int>"), "line-blocks", ALIGNED_ROWS).where("size(gone) > 0")


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, gone)``: numbers of the lines, among those with a word, that go from a document.

    These are the lines of all common blocks with any earlier document (by ``doc_id``). A document is aligned first with the first holder of each
    run of ``min_words`` words that it shares; for runs that this leaves (they stand there in another order, or several times), with about
    ``TRIED`` other earlier holders, then with ``TRIED`` times as many, and so on, until the run is gone or all were tried.
    However many documents hold a run, it is looked for. Documents of equal lines are aligned as one, their first.
    """
    lines = stored(
        _lines(docs.where("doc_id IS NOT NULL")).groupBy("doc_id").agg(F.max_by(F.struct("hashes", "words"), F.struct("hashes")).alias("l"))
        .select("doc_id", "l.*"), "line-hashes"
    )
    whole = F.xxhash64("hashes")
    sets = lines.where("size(hashes) > 0").withColumn("whole", whole)
    firsts = stored(sets.groupBy("whole").agg(F.min("doc_id").alias("first")), "line-classes")
    heads = lines.join(firsts.select(F.col("first").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    # Equal lists of lines align as one block, which is all of them.
    n_words = F.aggregate("words", F.lit(0).cast("bigint"), lambda total, n: total + n)
    copies = sets.join(firsts.hint("merge"), "whole").where("doc_id > first").where(n_words >= min_words)
    copies = copies.select("doc_id", F.sequence(F.lit(0), F.size("hashes") - 1).alias("gone"))
    runs = stored(_windows(heads, max(min_words, 1)), "line-runs")
    held = runs.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    # A table of its own: a join with an aggregate in its stage cannot have a busy run's rows split over tasks.
    held = stored(held.where("first < last").select("key", "first", "n"), "line-holders")
    shared = stored(runs.join(held.hint("merge"), "key"), "line-shared")
    pairs = stored(shared.where("doc_id > first").select("doc_id", "first").distinct(), "line-pairs")
    found = _aligned(pairs, heads, min_words)
    todo, tried = shared.where("doc_id > first"), 1
    while True:
        so_far = found.select("doc_id", F.explode("gone").alias("line")).groupBy("doc_id").agg(F.collect_set("line").alias("gone"))
        left = F.array_except(F.sequence("start", F.col("stop") - 1), F.coalesce("gone", F.array().cast("array<int>")))
        todo = todo.where(F.col("n") > tried).join(so_far.hint("merge"), "doc_id", "left").where(F.size(left) > 0).drop("gone")
        todo = stored(todo, "line-todo")
        if todo.isEmpty():
            return so_far.unionByName(copies)
        tried *= TRIED
        chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) * F.col("n") < F.lit(float(tried << 30))
        others = shared.where(chance).select("key", F.col("doc_id").alias("other")).distinct()
        more = todo.join(others.hint("merge"), "key").where("other < doc_id").select("doc_id", F.col("other").alias("first")).distinct()
        more = stored(more.join(pairs.hint("merge"), ["doc_id", "first"], "left_anti"), "line-pairs")
        pairs, found = pairs.unionAll(more), found.unionAll(_aligned(more, heads, min_words))


def dedup_lines(docs: DataFrame, keep: list[str] | None = None, **rules) -> DataFrame:
    """Per row ``(doc_id, n_lines, n_removed, kept_text)``, and the columns in ``keep``.

    Lines are numbered among those that hold a word; the others, and all lines
    of rows without ``doc_id``, stay as they are. A null text stays null. Rows that
    repeat a ``doc_id`` are one document: the one whose list of lines is the greatest stands for all in the
    comparison, and the numbers found go from each row with the same lines. Other columns are ignored.
    """
    row = F.struct(*[F.col(c) for c in keep or ["doc_id"]]).alias("kept_row")
    gone = removed_lines(docs.select("doc_id", "text"), **rules)
    out = docs.select("doc_id", "text", row).join(gone.hint("merge"), "doc_id", "left")
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    out = out.withColumn("lines", F.split("text", "\n"))
    out = out.withColumn("n_lines", F.coalesce(F.size(F.filter("lines", has_word)), F.lit(0)).cast("bigint"))

    # Numbers of the kept lines: a set difference, so the work is in proportion to the lines.
    out = out.withColumn("worded", F.filter(F.transform("lines", lambda x, i: F.when(has_word(x), i)), lambda i: i.isNotNull()))
    out = out.withColumn("dropped", F.transform(F.coalesce("gone", F.array().cast("array<int>")), lambda k: F.get("worded", k)))
    out = out.withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n")
    )
    out = out.select(
        "doc_id", "kept_row", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        kept.alias("kept_text"),
    )
    return (out if keep else out.drop("kept_row")).select(F.inline(F.array(F.struct(*(out if keep else out.drop("kept_row")).columns))))
