"""Exact nearest neighbours by blocks: int8 products with error bounds, then the rest in full precision."""

from __future__ import annotations

import heapq
import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERY_BLOCK = 512
ROW_BLOCK = 4096
TILE = 1024


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, a scale per vector, and a bound on the length of what rounding takes away."""
    scale = np.abs(vectors).max(axis=1) / 127
    scale[scale == 0] = 1
    codes = np.rint(vectors / scale[:, None])
    lost = np.sqrt(((vectors - codes * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9)
    return codes.astype(np.int8), scale, lost


def exact_distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components added in their order."""
    total = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        gap = vectors[:, j] - query[j]
        total += gap * gap
    return np.sqrt(total)


def nearest_in_blocks(
    query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int
) -> list[list[tuple[float, int]]]:
    """The ``k`` nearest ``(distance, id)`` of each query among the rows, ties to smaller ids.

    A tile of int8 products gives each distance up to the rounding bounds of both sides. Pairs that
    may still be among the ``k`` nearest are computed anew in double precision.
    """
    q_codes, q_scale, q_lost = quantised(queries)
    q_wide, q_norm = q_codes.astype(np.float32), ((q_codes * q_scale[:, None]) ** 2).sum(axis=1)
    best: list[dict[int, float]] = [{} for _ in query_ids]
    for start in range(0, len(row_ids), TILE):
        ids, part = row_ids[start : start + TILE], rows[start : start + TILE]
        codes, scale, lost = quantised(part)
        # Products of int8 codes are whole numbers that float32 adds exactly up to 2**24, i.e. 1,040 components.
        wide = np.float32 if part.shape[1] <= 1024 else np.float64
        product = (q_wide.astype(wide) @ codes.astype(wide).T).astype(np.float64)
        norm = ((codes * scale[:, None]) ** 2).sum(axis=1)
        square = q_norm[:, None] + norm[None] - 2 * product * (q_scale[:, None] * scale[None])
        about = np.sqrt(np.maximum(square, 0))
        # Cancellation in the line above adds an error of its own, largest where the distance is near zero.
        slip = np.sqrt(1e-12 * (q_norm[:, None] + norm[None]))
        bound = q_lost[:, None] + lost[None] + slip
        own = query_ids[:, None] == ids[None]
        low, high = about - bound, np.where(own, np.inf, about + bound)
        low[own] = np.inf
        for i in range(len(query_ids)):
            held = best[i]
            limit = max(held.values()) if len(held) >= k else math.inf
            if len(ids) > k:
                # Of equal ids only one counts, so the limit is that of different ids.
                near = np.argpartition(high[i], k - 1)[:k]
                if len(set(ids[near].tolist())) == k:
                    limit = min(limit, high[i][near].max())
            left = np.flatnonzero(low[i] <= limit)
            left = left[low[i][left] < np.inf]
            if len(left) == 0:
                continue
            for d, v in zip(exact_distances(part[left], queries[i]).tolist(), ids[left].tolist()):
                if d < held.get(v, math.inf):
                    held[v] = d
            if len(held) > k:
                best[i] = {v: d for d, v in heapq.nsmallest(k, ((d, v) for v, d in held.items()))}
    return [sorted((d, v) for v, d in held.items()) for held in best]


def usable(vector: Column) -> Column:
    """Vectors with a component other than zero, and none that is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(wide, lambda x: x != 0), F.lit(False))


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows of each query by Euclidean distance.

    All rows ``(vec_id, embedding)`` are candidates but those with the query's own id; vectors that are null, zero, or hold
    nulls or non-finite components, and rows without ``vec_id``, take no part. Vectors are compared with those of
    equal length. Ties go to the smaller id. Rows that repeat an id count once, at their smallest distance; a query id
    that repeats is asked with each of its vectors, and the nearest found count. Other columns are ignored.

    Queries and rows are cut into blocks by their place in their partition, so no value can
    gather in one block; each pair of blocks is one task's work, which sends on ``k`` rows per query.
    """
    rows = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), is_query.alias("asks"))
    rows = rows.where("vec_id IS NOT NULL").where(usable(F.col("v")))
    rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), "vectors")

    def blocks(df: DataFrame, size: int) -> DataFrame:
        counted = df.withColumn("part", F.shiftrightunsigned("place", 33)).withColumn(
            "block", F.floor(F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) / size)
        )
        return counted.withColumn("block", F.struct(F.size("v").alias("size"), "part", "block"))

    asked = blocks(rows.where("asks"), QUERY_BLOCK * 100).select("block", F.col("vec_id").alias("id"), "v")
    given = blocks(rows, ROW_BLOCK).select("block", F.col("vec_id").alias("id"), "v")
    ask_blocks = stored(asked.select("block").distinct(), "ask-blocks").withColumnRenamed("block", "ask")
    give_blocks = stored(given.select("block").distinct(), "give-blocks").withColumnRenamed("block", "give")
    # Pairs of blocks, not of rows.
    tiles = ask_blocks.join(give_blocks, ask_blocks["ask"]["size"] == give_blocks["give"]["size"])
    tiles = stored(tiles.select("ask", "give"), "tiles")
    left = asked.withColumnRenamed("block", "ask").join(tiles, "ask").select("ask", "give", "id", "v")
    right = given.withColumnRenamed("block", "give").join(tiles, "give").select(
        F.col("ask").alias("ask2"), F.col("give").alias("give2"), F.col("id").alias("id2"), F.col("v").alias("v2")
    )

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(a) and len(b):
            ids, rows = b["id2"].to_numpy(), np.stack(b["v2"].to_list())
            for start in range(0, len(a), QUERY_BLOCK):
                part = a.iloc[start : start + QUERY_BLOCK]
                asked_ids = part["id"].to_numpy()
                found = nearest_in_blocks(asked_ids, np.stack(part["v"].to_list()), ids, rows, k)
                out += [(q, v, d) for q, near in zip(asked_ids.tolist(), found) for d, v in near]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = (
        left.groupBy("ask", "give")
        .cogroup(right.groupBy("ask2", "give2"))
        .applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    )

    def merge(batch: pd.DataFrame) -> pd.DataFrame:
        nearest: dict[int, float] = {}
        for v, d in zip(batch["vec_id"].tolist(), batch["score"].tolist()):
            nearest[v] = min(d, nearest.get(v, math.inf))
        kept = heapq.nsmallest(k, ((d, v) for v, d in nearest.items()))
        return pd.DataFrame(
            {
                "query_id": [batch["query_id"].iloc[0]] * len(kept),
                "rank": range(1, len(kept) + 1),
                "vec_id": [v for _, v in kept],
                "score": [d for d, _ in kept],
            }
        )

    return found.groupBy("query_id").applyInPandas(merge, "query_id bigint, rank int, vec_id bigint, score double")
