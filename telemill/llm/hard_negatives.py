"""Hard negatives by segment summaries: bounds from means and deviations, refined level by level, then exact scores."""

from __future__ import annotations

import math
import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm.common import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 256
LEVELS = (4, 16)  # segments of a vector, coarse to fine
ANCHOR_BLOCK = 16_384
ROW_BLOCK = 4096
TILE = 256  # anchors bounded at once
SLOTS = 64  # parts the blocks of rows are dealt to for each block of anchors, at least,
SLOT_BLOCKS = 64  # and how many of them a part may hold before there are more parts
_LONG = (1 << 63) - 1
_SLIP = 1e-6  # of the largest score there can be: more than summaries in single precision lose


def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` of each component: doubles where they hold it, else Python's whole numbers."""
    with np.errstate(over="ignore"):
        wide = np.floor(vectors * scale)
    if wide.size == 0 or np.abs(wide).max() < 2.0**31:
        return wide
    exact = [math.floor(x * scale) if abs(x) < 2.0**40 else int(x) * scale for x in vectors.ravel().tolist()]
    found = np.empty(len(exact), object)
    found[:] = exact
    return found.reshape(vectors.shape)


def summaries(codes: np.ndarray, levels: tuple[int, ...] = LEVELS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level each segment's mean, times the root of its length, and its deviation: the length of what the mean leaves.

    In each segment the inner product of two vectors is that of their means, give or take the product of their deviations.
    """
    found, size = [], codes.shape[1]
    for segments in levels:
        starts = [size * i // min(segments, size) for i in range(min(segments, size))]
        lengths = np.diff([*starts, size])
        means = np.add.reduceat(codes, starts, axis=1) / lengths
        left = codes - np.repeat(means, lengths, axis=1)
        deviations = np.sqrt(np.add.reduceat(left * left, starts, axis=1))
        found.append(((means * np.sqrt(lengths)).astype(np.float32), deviations.astype(np.float32)))
    return found


class Block:
    """Vectors of one length: ids, labels, whole components, summaries, and what is wanted for each, if they are anchors."""

    def __init__(self, ids: list, labels: list, vectors: list, scale: int, wanted: list):
        self.ids, self.labels, self.wanted = np.array(ids, np.int64), np.array(labels), wanted
        codes = whole(np.array(vectors, np.float64), scale)
        self.levels = summaries(codes) if codes.dtype != object else []
        narrow = codes.dtype != object and np.abs(codes).max() < 1 << 15
        self.codes = codes.astype(np.int16) if narrow else codes

    def bounds(self, rows: slice, other: Block, columns: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest score that each of the rows may have with each of the other block's columns."""
        means, deviations = (x[rows].astype(np.float64) for x in self.levels[level])
        means2, deviations2 = (x[columns].astype(np.float64) for x in other.levels[level])
        middle, reach = means @ means2.T, deviations @ deviations2.T
        norms, norms2 = (np.sqrt((m * m + d * d).sum(axis=1)) for m, d in ((means, deviations), (means2, deviations2)))
        reach += _SLIP * norms[:, None] * norms2
        return np.clip(middle - reach, -_LONG, _LONG), np.clip(middle + reach, -_LONG, _LONG)

    def scores(self, rows: slice, other: Block, columns: np.ndarray) -> np.ndarray:
        """Exact inner products; beyond 64 bits the nearest number of 64 bits."""
        a, b = self.codes[rows], other.codes[columns]
        if a.dtype != object and b.dtype != object:
            a, b = a.astype(np.float64), b.astype(np.float64)
            if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
                return (a @ b.T).astype(np.int64)
        plain = lambda x: np.array([[int(c) for c in row] for row in x.tolist()], object).reshape(x.shape)
        return np.clip(plain(a) @ plain(b).T, -_LONG, _LONG).astype(np.int64)

    def refined(self, rows: slice, other: Block, alive: np.ndarray, keep) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per row its place, the columns that ``keep`` leaves after every level, and their exact scores.

        ``keep(rows, alive, low, high)`` says which of the pairs still alive may be in the result.
        """
        columns = np.flatnonzero(alive.any(axis=0))
        alive = alive[:, columns]
        for level in range(min(len(self.levels), len(other.levels))):
            if len(columns) == 0:
                return
            low, high = self.bounds(rows, other, columns, level)
            alive = keep(rows, alive, low, high)
            still = alive.any(axis=0)
            columns, alive = columns[still], alive[:, still]
        if len(columns):
            scores = self.scores(rows, other, columns)
            for row in range(len(alive)):
                left = np.flatnonzero(alive[row])
                if len(left):
                    yield rows.start + row, columns[left], scores[row][left]


def _ordered(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places by falling score, ties by id."""
    return np.lexsort((ids, -scores))


def _largest(low: np.ndarray, alive: np.ndarray, k: int) -> np.ndarray:
    """Per row a score that ``k`` of its pairs reach for certain; minus infinity if they are fewer."""
    if low.shape[1] < k:
        return np.full((len(low), 1), -np.inf)
    return np.partition(np.where(alive, low, -np.inf), low.shape[1] - k, axis=1)[:, -k][:, None]


def find_positives(a: Block, b: Block, k: int) -> list[tuple[int, int, int]]:
    """``(anchor, row, score)``: the first ``k`` other rows of each anchor's label."""

    def keep(_, alive, low, high):
        return alive & (high >= _largest(low, alive, k))

    found = []
    for start in range(0, len(a.ids), TILE):
        rows = slice(start, min(start + TILE, len(a.ids)))
        alive = (a.labels[rows][:, None] == b.labels) & (a.ids[rows][:, None] != b.ids)
        for i, columns, scores in a.refined(rows, b, alive, keep):
            for j in _ordered(b.ids[columns], scores)[:k].tolist():
                found.append((int(a.ids[i]), int(b.ids[columns[j]]), int(scores[j])))
    return found


def find_negatives(a: Block, b: Block, k: int, low_share: int, high_share: int) -> list[tuple[int, int, int, int, int]]:
    """``(anchor, positive, row, positive's score, score)``: of each positive's score range the first ``k`` rows of other labels."""
    # Whole-number limits of 100 * score: low * positive <= 100 * score <= high * positive.
    ranges = [[(-(-low_share * s // 100), high_share * s // 100) for _, s in wanted] for wanted in a.wanted]

    def keep(rows, alive, low, high):
        left = np.zeros_like(alive)
        for j in range(max(map(len, ranges[rows]))):
            mine = [r[j] if j < len(r) else (1, 0) for r in ranges[rows]]
            least, most = (np.array([[float(x[side])] for x in mine]) for side in (0, 1))
            sure = alive & (low >= least) & (high <= most)
            left |= alive & (high >= np.maximum(least, _largest(low, sure, k))) & (low <= most) & (least <= most)
        return left

    found = []
    for start in range(0, len(a.ids), TILE):
        rows = slice(start, min(start + TILE, len(a.ids)))
        alive = a.labels[rows][:, None] != b.labels
        for i, columns, scores in a.refined(rows, b, alive, keep):
            order = _ordered(b.ids[columns], scores)
            ids, falling = b.ids[columns[order]], scores[order]
            for (positive, score), (least, most) in zip(a.wanted[i], ranges[i]):
                inside = np.flatnonzero((falling <= most) & (falling >= least))[:k]
                found += [(int(a.ids[i]), positive, int(ids[j]), score, int(falling[j])) for j in inside]
    return found


def _blocks(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """``(dim, part, block, payload)``: the rows ``(id, label, v[, wanted])`` of each partition in blocks of equal length of vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple]] = {}

        def out(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, labels, vectors, wanted = zip(*held.pop(dim))
            block = pickle.dumps(Block(ids, labels, vectors, scale, list(wanted)).__dict__, protocol=5)
            made += 1
            columns = [pa.array([dim], pa.int64()), pa.array([part], pa.int64()), pa.array([made], pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([block], pa.binary())], ["dim", "part", "block", "payload"])

        for batch in batches:
            wanted = batch.column(3).to_pylist() if batch.num_columns > 3 else [()] * batch.num_rows
            wanted = [[(w["id"], w["score"]) for w in ws] for ws in wanted]
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), wanted):
                own = held.setdefault(len(row[2]), [])
                own.append(row)
                if len(own) >= size:
                    yield out(len(row[2]))
            if sum(map(len, held.values())) > 2 * size:  # very many lengths
                yield out(max(held, key=lambda dim: len(held[dim])))
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(run, "dim bigint, part bigint, block bigint, payload binary")


def _block(payload: pa.Scalar) -> Block:
    found = Block.__new__(Block)
    found.__dict__.update(pickle.loads(payload.as_py()))
    return found


def _tiles(anchors: DataFrame, blocks: DataFrame, search, schema: str, label: str) -> DataFrame:
    """``search(anchors, rows)`` of every block of anchors with every block of rows of that length of vector.

    Blocks of rows are dealt to slots, and each slot goes to every block of anchors; both are multiplied from
    counts, no two rows are compared to find that out.
    """
    spark = blocks.sparkSession
    number = F.row_number().over(Window.partitionBy("dim").orderBy("part", "block"))  # a few rows: blocks
    asks = stored(anchors.withColumn("ask", number), f"{label}-anchors")
    total = blocks.count()
    slots = max(1, min(total, max(SLOTS, -(-total // SLOT_BLOCKS))))
    left = asks.select("dim", "ask", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.col("payload").alias("a"))
    counts = asks.groupBy("dim").agg(F.count("*").alias("asks"))
    right = blocks.join(counts, "dim").select(
        "dim", F.explode(F.sequence(F.lit(1), F.col("asks").cast("int"))).alias("ask"),
        F.pmod(F.xxhash64("part", "block"), F.lit(slots)).cast("int").alias("slot"), F.col("payload").alias("b"),
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                found = list(zip(*search(_block(a), _block(b)))) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names)

    joined = left.join(right, ["dim", "ask", "slot"]).select("a", "b")
    return stored(joined.mapInArrow(run, schema), label, batch_rows=1)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = SCALE,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` from ``(vec_id, label, embedding)``.

    Components become ``floor(scale * x)``, and a score is the whole inner product. An anchor's positives are the first ``positives`` other
    rows of its label, by score, ties to the smaller id. For each of them the first ``negatives`` rows of
    other labels whose score is ``low`` to ``high`` per cent of the positive's are returned, ranked from 1.

    Rows without id or label, and vectors that are null, empty or hold null or non-finite components, take no part. Vectors
    are compared with those of equal length. Rows that repeat an id count once, with the smallest label and vector;
    such an id is an anchor if any of its rows is. Scores beyond 64 bits count as the
    nearest number of 64 bits. Other columns are ignored; an empty table has no anchors.

    Anchors meet all rows in blocks. Each tile is bounded by stored segment summaries, coarse ones first; pairs that may
    still count are scored exactly. A tile sends on the few best rows of an anchor.
    """
    wide = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").alias("id"), "label", wide.alias("v"), is_anchor.alias("asks"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND size(v) > 0").where(fine)
    one = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row"), F.max(F.coalesce("asks", F.lit(False))).alias("asks"))
    rows = stored(one.select("id", "row.label", "row.v", "asks"), "negatives-rows", batch_rows=ROW_BLOCK)
    asked = rows.where("asks").select("id", "label", "v")
    parts = max(1, -(-asked.count() // ANCHOR_BLOCK))
    blocks = stored(_blocks(rows.select("id", "label", "v"), ROW_BLOCK, scale), "negatives-blocks", batch_rows=ROW_BLOCK)

    found = _tiles(
        _blocks(asked.repartition(parts), ANCHOR_BLOCK, scale), blocks,
        lambda a, b: find_positives(a, b, positives), "anchor bigint, row bigint, score bigint", "negatives-positives",
    )
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "row")
    first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    lists = first.groupBy(F.col("anchor").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("row").alias("id"), "score"))).alias("wanted")
    )
    asked = stored(asked.join(lists, "id").select("id", "label", "v", "wanted"), "negatives-asked")

    found = _tiles(
        _blocks(asked.repartition(parts), ANCHOR_BLOCK, scale), blocks,
        lambda a, b: find_negatives(a, b, negatives, low, high),
        "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint", "negatives-found",
    )
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
