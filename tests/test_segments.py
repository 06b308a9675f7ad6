import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from telemill.operators.segments import MINUTE_MS, anchored_starts, assign_aligned, assign_anchored
from telemill import session as telemill_session

EPOCH = dt.datetime(1970, 1, 1)


def chain(times, width, end=None):
    """Segment starts, one row after the other."""
    starts = []
    for t in sorted(times):
        if end is None or t >= end:
            starts.append(t)
            end = t + width
    return starts


def frame(spark, times):
    rows = [(k, EPOCH + dt.timedelta(milliseconds=t), t) for k, ts in times.items() for t in ts]
    return spark.createDataFrame(rows, "type_name string, at timestamp_ntz, ms bigint").repartition(5)


def sample(seed):
    rng = random.Random(seed)
    base = 1_717_200_000_000
    day = 86_400_000
    return {
        "sparse": [base + rng.randrange(30 * day) for _ in range(300)],
        "dense": [base + rng.randrange(day // 4) for _ in range(3000)],
        "every": [base + 60_000 * i for i in range(2000)],
        "gaps": [base + g * 7 * day + rng.randrange(3_600_000) for g in range(4) for _ in range(100)],
        "old": [-rng.randrange(5 * day) for _ in range(200)],
        "one": [base],
    }


MINUTES = {"sparse": 45, "dense": 1, "every": 7, "gaps": 5, "old": 1440, "one": 60}


@pytest.fixture(params=[{}, {"flat_rows": 0, "fan_in": 4}], ids=["flat", "tree"])
def shape(request):
    return request.param


def found(df):
    result = {}
    for r in df.collect():
        result.setdefault(r.type_name, []).append(r.start_ms)
    return {k: sorted(v) for k, v in result.items()}


def test_anchored_starts_match_the_plain_chain(spark, shape):
    times = sample(1)
    starts = found(anchored_starts(frame(spark, times).select("type_name", "ms"), MINUTES, **shape))
    assert starts == {k: chain(set(ts), MINUTES[k] * MINUTE_MS) for k, ts in times.items()}


def test_carried_segment(spark, shape):
    times = sample(2)
    carry = {k: min(ts) - 1000 for k, ts in times.items() if k != "sparse"}
    carry["every"] = min(times["every"]) + 500_000
    starts = found(anchored_starts(frame(spark, times).select("type_name", "ms"), MINUTES, carry, **shape))
    expected = {}
    for k, ts in times.items():
        width = MINUTES[k] * MINUTE_MS
        expected[k] = chain(set(ts), width, carry[k] + width if k in carry else None)
    assert starts == {k: v for k, v in expected.items() if v}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_rows_find_their_segment(spark, monkeypatch, limit):
    monkeypatch.setattr(telemill_session, "BROADCAST_ROWS", limit)
    times = sample(3)
    rows = assign_anchored(frame(spark, times), MINUTES, "at", "type_name").collect()
    starts = {k: chain(set(ts), MINUTES[k] * MINUTE_MS) for k, ts in times.items()}
    assert len(rows) == sum(map(len, times.values()))
    for r in rows:
        own = max(s for s in starts[r.type_name] if s <= r.ms)
        assert r.segment_start == EPOCH + dt.timedelta(milliseconds=own)
        assert r.segment == r.segment_start.strftime("%Y-%m-%d_%H-%M-%S.") + f"{r.segment_start.microsecond // 1000:03d}"


def test_chain_over_two_arrivals_equals_one(spark):
    times = sample(4)
    cut = 1_717_200_000_000 + 10 * 86_400_000
    whole = {k: chain(set(ts), MINUTES[k] * MINUTE_MS) for k, ts in times.items()}
    early = {k: [t for t in ts if t < cut] for k, ts in times.items()}
    late = {k: [t for t in ts if t >= cut] for k, ts in times.items()}
    first = found(anchored_starts(frame(spark, early).select("type_name", "ms"), MINUTES))
    carry = {k: v[-1] for k, v in first.items()}
    second = found(anchored_starts(frame(spark, late).select("type_name", "ms"), MINUTES, carry))
    assert {k: first.get(k, []) + second.get(k, []) for k in whole} == whole


@pytest.mark.parametrize("limit", [200_000, 0])
def test_aligned(spark, monkeypatch, limit):
    monkeypatch.setattr(telemill_session, "BROADCAST_ROWS", limit)
    times = sample(5)
    rows = assign_aligned(frame(spark, times), MINUTES, "at", "type_name").collect()
    firsts = {}
    for r in rows:
        key = (r.type_name, r.ms // (MINUTES[r.type_name] * MINUTE_MS))
        firsts[key] = min(firsts.get(key, r.at), r.at)
    for r in rows:
        first = firsts[(r.type_name, r.ms // (MINUTES[r.type_name] * MINUTE_MS))]
        assert r.segment == first.strftime("%Y-%m-%d_%H-%M-%S.") + f"{first.microsecond // 1000:03d}"
    assert len(rows) == sum(map(len, times.values()))


def test_empty_input(spark):
    df = spark.createDataFrame([], "type_name string, at timestamp_ntz, ms bigint")
    assert anchored_starts(df.select("type_name", "ms"), MINUTES).count() == 0
    assert assign_aligned(df, 5, "at").count() == 0
    assert assign_anchored(df, MINUTES, "at", "type_name").where(F.col("segment").isNull()).count() == 0


def test_a_busy_window_is_no_burden_for_one_task(spark):
    """Nine rows of ten are in one window, and the names of windows are too many to broadcast."""
    base = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    number = F.col("id")
    late = F.when(number % 10 == 0, number * 60).otherwise(number % 50)
    rows = spark.range(0, 200_000, 1, 8).select("id", (base + F.make_dt_interval(secs=late.cast("decimal(18,6)"))).alias("ingest_time"))
    expected = assign_aligned(rows, 1)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        found = assign_aligned(rows, 1, broadcast_rows=0)
        tasks = sorted(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect())
        assert len(tasks) == 8 and sum(tasks) == 200_000
        assert tasks[-1] < 2 * (tasks[3] + tasks[4]) / 2
        assert found.exceptAll(expected).count() == 0
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@pytest.mark.parametrize("block_minutes, chained", [(60, {}), (1, {}), (7, {"flat_rows": 0, "fan_in": 3})])
def test_blocks_shorter_than_a_latency(spark, block_minutes, chained):
    times, minutes = sample(6), {k: 1440 for k in MINUTES}
    carry = {"every": min(times["every"]) + 500_000}
    for given in (None, carry):
        starts = found(anchored_starts(frame(spark, times).select("type_name", "ms"), minutes, given, block_minutes=block_minutes, **chained))
        expected = {k: chain(set(ts), 1440 * MINUTE_MS, given[k] + 1440 * MINUTE_MS if given and k in given else None) for k, ts in times.items()}
        assert starts == {k: v for k, v in expected.items() if v}
