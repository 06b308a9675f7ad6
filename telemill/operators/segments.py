"""Rotation: which segment a stored row belongs to.

Aligned segments are epoch-aligned windows. Anchored segments form a chain: one
starts at the first row, ends before the first row that is ``latency`` or more
later, and that row starts the next.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.session import cut_lineage, floor_div, join_lookup, quoted

# The block functions below travel to the executors as code, so those need
# numpy and pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MINUTE_MS = 60_000
NAME_FORMAT = "yyyy-MM-dd_HH-mm-ss.SSS"

# A block of the time axis is one task's work. Times count in milliseconds, so
# a block holds at most its own length of distinct times, whatever the volume.
BLOCK_MINUTES = 360  # of the time axis to a task: 21.6 million different milliseconds (173 MB) at most
# Up to this many rows the block summaries are chained in one step per type,
# beyond it as a tree.
FLAT_CHAIN_ROWS = 1_000_000
FAN_IN = 16


def to_millis(time: Column) -> Column:
    return F.unix_millis(time.cast("timestamp"))


def from_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis).cast("timestamp_ntz")


def segment_name(start: Column) -> Column:
    """A segment is named by the ingest time of its first row."""
    return F.date_format(start, NAME_FORMAT)


def aligned_window(time: Column, minutes: Column) -> Column:
    """Start of the epoch-aligned window of ``minutes`` around ``time``."""
    width = minutes.cast("bigint") * F.lit(MINUTE_MS)
    millis = to_millis(time)
    return from_millis(millis - F.pmod(millis, width))


def _minutes_column(minutes: int | Mapping[str, int], type_col: str | None) -> Column:
    if isinstance(minutes, Mapping):
        return F.create_map(*[F.lit(x) for pair in minutes.items() for x in pair])[quoted(type_col)]
    return F.lit(minutes)


def assign_aligned(
    df: DataFrame,
    minutes: int | Mapping[str, int],
    time_col: str = "ingest_time",
    type_col: str | None = None,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """Add ``segment``, the name of the row's aligned segment.

    The first time of each window is found by a grouped minimum, combined before
    the shuffle, and joined back; no window of rows is ever gathered in a task.
    """
    keys = ([type_col] if type_col else []) + ["__window"]
    windowed = df.withColumn("__window", aligned_window(quoted(time_col), _minutes_column(minutes, type_col)))
    firsts = windowed.groupBy(*[quoted(k) for k in keys]).agg(segment_name(F.min(quoted(time_col))).alias("segment"))
    joined = join_lookup(windowed, cut_lineage(firsts, "segments"), keys, broadcast_rows)
    return joined.select(*[quoted(c) for c in df.columns], "segment")


# --- anchored chain --------------------------------------------------------------
# For one block of the time axis, "given that the running segment ends at e, when
# does the segment running at the end of the block end?" is a step function of e.
# It is kept as arrays (keys, outs): the answer for e is the out of the first key
# at or after e, and e itself if there is none (no row in the block restarts).


def _block_function(times: np.ndarray, last_end: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Function of a block with these ``times``, for ends up to ``last_end``."""
    following = np.searchsorted(times, times + width)
    entries = np.arange(min(len(times), int(np.searchsorted(times, last_end)) + 1))
    last = entries.copy()
    while True:
        step = following[last]
        moves = step < len(times)
        if not moves.any():
            break
        last[moves] = step[moves]
    return _squeeze(times[entries], times[last] + width)


def _squeeze(keys: np.ndarray, outs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of neighbours with the same answer only the last key is needed."""
    keep = np.append(outs[1:] != outs[:-1], True) if len(outs) else np.zeros(0, bool)
    return keys[keep], outs[keep]


def _answer(keys: np.ndarray, outs: np.ndarray, ends: np.ndarray) -> np.ndarray:
    at = np.searchsorted(keys, ends)
    return np.where(at < len(keys), outs[np.minimum(at, len(keys) - 1)], ends)


def _then(first, second) -> tuple[np.ndarray, np.ndarray]:
    """Two neighbouring stretches of time as one."""
    keys, outs = first
    later = second[0] > keys[-1]
    return _squeeze(
        np.concatenate([keys, second[0][later]]), np.concatenate([_answer(*second, outs), second[1][later]])
    )


def _nodes(pdf: pd.DataFrame):
    """The functions in ``pdf`` in time order."""
    pdf = pdf.sort_values(["node", "key"])
    for node, part in pdf.groupby("node", sort=True):
        yield int(node), (part["key"].to_numpy(), part["out"].to_numpy())


_FUNCTION = "type_no int, node bigint, key bigint, out bigint"
_ENTRY = "type_no int, node bigint, entry bigint"
_NO_ENTRY = -(2**62)


def anchored_starts(
    times: DataFrame,
    minutes: Mapping[str, int],
    carry: Mapping[str, int] | None = None,
    flat_rows: int = FLAT_CHAIN_ROWS,
    fan_in: int = FAN_IN,
    block_minutes: int = BLOCK_MINUTES,
) -> DataFrame:
    """Segment starts ``(type_name, start_ms)`` of ``(type_name, ms)`` rows.

    ``carry`` gives the start of a type's running segment, if there is one. Beyond ``flat_rows``
    summary rows blocks are chained as a tree, ``fan_in`` at a time.

    The time axis is cut into blocks of ``block_minutes``, whatever the latencies: an end that lies behind a block goes through
    it unchanged, so a segment may span very many. Each block becomes a step function in a task of
    its own. The functions, small as they are, are chained to find where the
    running segment ends at each block's start, and then every block lists its
    starts, again in parallel.
    """
    names = sorted(minutes)
    widths = {i: minutes[n] * MINUTE_MS for i, n in enumerate(names)}
    length = block_minutes * MINUTE_MS
    entries = {i: carry[n] + widths[i] for i, n in enumerate(names) if carry and n in carry}

    def lookup(values: Mapping, key: Column) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]

    number = lookup({n: i for i, n in enumerate(names)}, F.col("type_name"))
    # Rows of unknown types are in no segment.
    numbered = times.select(number.alias("type_no"), "ms").where("type_no IS NOT NULL AND ms IS NOT NULL").distinct()
    block = floor_div(F.col("ms"), F.lit(length).cast("bigint"))
    located = cut_lineage(numbered.select("type_no", block.alias("node"), "ms"), "segment-times")
    lo, hi = located.agg(F.min("node"), F.max("node")).first()
    if lo is None:
        lo = hi = 0

    def summarize(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        type_no, node = key
        # A segment from before the block ends within one width; a carried one may
        # have started inside the block, or end after it.
        last_end = max(node * length + widths[type_no], entries.get(type_no, _NO_ENTRY))
        found = _block_function(np.sort(pdf["ms"].to_numpy()), last_end, widths[type_no])
        return pd.DataFrame({"type_no": type_no, "node": node - lo, "key": found[0], "out": found[1]})

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        type_no, parent = key
        total = None
        for _, function in _nodes(pdf):
            total = function if total is None else _then(total, function)
        return pd.DataFrame({"type_no": type_no, "node": parent, "key": total[0], "out": total[1]})

    def descend(key: tuple, pdf: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
        type_no = key[0]
        end = int(parents["entry"].iloc[0]) if len(parents) else entries.get(type_no, _NO_ENTRY)
        rows = []
        for node, (keys, outs) in _nodes(pdf):
            rows.append((type_no, node, end))
            end = int(_answer(keys, outs, np.array([end]))[0])
        return pd.DataFrame(rows, columns=["type_no", "node", "entry"])

    def list_starts(key: tuple, pdf: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        type_no, width, found = key[0], widths[key[0]], []
        if len(pdf) and len(given):
            ms = np.sort(pdf["ms"].to_numpy())
            at = int(np.searchsorted(ms, int(given["entry"].iloc[0])))
            while at < len(ms):
                found.append(int(ms[at]))
                at = int(np.searchsorted(ms, ms[at] + width))
        return pd.DataFrame({"type_no": np.full(len(found), type_no, "int32"), "start_ms": np.array(found, "int64")})

    levels = [cut_lineage(located.groupBy("type_no", "node").applyInPandas(summarize, _FUNCTION), "segment-blocks")]
    span = hi - lo + 1
    if levels[0].count() <= flat_rows:
        fan_in = span
    parent = floor_div(F.col("node"), F.lit(fan_in).cast("bigint"))
    while span > fan_in:
        grouped = levels[-1].groupBy("type_no", parent.alias("parent"))
        levels.append(cut_lineage(grouped.applyInPandas(merge, _FUNCTION), "segment-blocks"))
        span = -(-span // fan_in)

    spark = times.sparkSession
    ends = spark.createDataFrame([], _ENTRY)
    for level in reversed(levels):
        children = level.groupBy("type_no", parent.alias("parent"))
        ends = cut_lineage(
            children.cogroup(ends.groupBy("type_no", F.col("node").alias("parent"))).applyInPandas(descend, _ENTRY),
            "segment-entries",
        )
    by_block = located.withColumn("node", F.col("node") - F.lit(lo)).groupBy("type_no", "node")
    starts = by_block.cogroup(ends.groupBy("type_no", "node")).applyInPandas(
        list_starts, "type_no int, start_ms bigint"
    )
    name = lookup(dict(enumerate(names)), F.col("type_no"))
    return starts.select(name.alias("type_name"), "start_ms")


def assign_anchored(
    df: DataFrame,
    minutes: int | Mapping[str, int],
    time_col: str = "ingest_time",
    type_col: str | None = None,
    carry: Mapping[str, int] | None = None,
    **chaining: int,
) -> DataFrame:
    """Add ``segment_start`` and ``segment`` (its name) of the anchored chain.

    Times count in milliseconds, as ingest times do. A window of one latency
    holds at most one start, so a row's segment started in its own window or in
    the one before: a lookup by window, no range join. ``chaining`` is for ``anchored_starts``.
    """
    widths = dict(minutes) if isinstance(minutes, Mapping) else {"": minutes}
    type_name = quoted(type_col) if type_col else F.lit("")
    marked = df.withColumn("__type", type_name).withColumn("__ms", to_millis(quoted(time_col)))
    times = marked.select(F.col("__type").alias("type_name"), F.col("__ms").alias("ms"))
    starts = anchored_starts(times, widths, carry, **chaining)
    if carry:
        running = df.sparkSession.createDataFrame(
            [(n, s) for n, s in carry.items() if n in widths], "type_name string, start_ms bigint"
        )
        starts = starts.unionByName(running).distinct()

    def width(key: Column) -> Column:
        return F.create_map(*[F.lit(x) for n, m in widths.items() for x in (n, m * MINUTE_MS)])[key].cast("bigint")

    window = floor_div(F.col("start_ms"), width(F.col("type_name")))
    none = F.lit(None).cast("bigint")
    own = starts.select(F.col("type_name").alias("__type"), window.alias("__window"), F.col("start_ms").alias("own"), none.alias("before"))
    following = starts.select(F.col("type_name").alias("__type"), (window + 1).alias("__window"), none.alias("own"), F.col("start_ms").alias("before"))
    lookup = own.unionByName(following).groupBy("__type", "__window").agg(F.max("own").alias("__own"), F.max("before").alias("__before"))
    located = marked.withColumn("__window", floor_div(F.col("__ms"), width(F.col("__type"))))
    joined = join_lookup(located, cut_lineage(lookup, "segments"), ["__type", "__window"])
    start = F.when(F.col("__own") <= F.col("__ms"), F.col("__own")).otherwise(F.col("__before"))
    if carry:
        # A row from before the running segment is late: it joins that segment.
        late = F.create_map(*[F.lit(x) for pair in carry.items() for x in pair])[F.col("__type")]
        start = F.coalesce(start, late)
    return joined.select(*[quoted(c) for c in df.columns], from_millis(start).alias("segment_start")).withColumn(
        "segment", segment_name(F.col("segment_start"))
    )
