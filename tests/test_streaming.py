import dataclasses
import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

import telemill
from telemill import Registry, StreamIngest
from telemill.plans.store import read_quarantine
from telemill.session import write_text
from telemill.streaming.items import ItemLimit
from tests.types import ALPHA, BETA, QUERY_TEST

ALPHA_LATER = dataclasses.replace(ALPHA, latency_minutes=60)
GOOD = {"querytest": {"label": "x", "value": 1}}
WRONG = {"querytest": {"label": "x", "value": "no"}}


@pytest.fixture
def places(tmp_path):
    (tmp_path / "in").mkdir()
    return {k: str(tmp_path / k) for k in ("in", "root", "checkpoint", "registry")}


def drop(places, name, *batches):
    text = "\n".join(b if isinstance(b, str) else json.dumps(b) for b in batches)
    with open(f"{places['in']}/{name}.txt", "w") as f:
        f.write(text + "\n")


def run(spark, stream, places, files=1):
    stream.start(telemill.stream_batches(spark, places["in"], files), places["checkpoint"], every=None).awaitTermination()


def test_accounts_and_restart(spark, places):
    drop(places, "a", [GOOD] * 5 + [WRONG] * 3, "not json")
    drop(places, "b", [GOOD] * 2, [], [{"querytest": "x"}])
    stream = StreamIngest(spark, places["root"], "s", lambda: [QUERY_TEST])
    run(spark, stream, places)
    run(spark, StreamIngest(spark, places["root"], "s", lambda: [QUERY_TEST]), places)
    assert telemill.scan_table(spark, places["root"], "querytest").count() == 7
    events = telemill.scan_table(spark, places["root"], "ingest-event").collect()
    counts = sorted((r.itemsIn, r.ingested, r.rejected, r.statusCode) for r in events)
    assert counts == [(0, 0, 0, 400), (0, 0, 1, 400), (1, 0, 1, 400), (2, 2, 0, 200), (8, 5, 3, 200)]
    flushed = telemill.scan_table(spark, places["root"], "writer-flush").collect()
    assert sorted(r.itemsFlushed for r in flushed) == [2, 5]
    assert read_quarantine(spark, places["root"]).count() == 5


def test_new_checkpoint_is_another_stream(spark, places):
    values = []
    for n, checkpoint in enumerate(("one", "two", "three")):
        drop(places, "a", [{"querytest": {"label": "x", "value": n}}])
        stream = StreamIngest(spark, places["root"], "s", lambda: [QUERY_TEST])
        source = telemill.stream_batches(spark, places["in"])
        stream.start(source, f"{places['checkpoint']}-{checkpoint}", every=None).awaitTermination()
        if n == 1:
            telemill.close_segment(spark, places["root"], QUERY_TEST)
        values.append(n)
        rows = telemill.scan_table(spark, places["root"], "querytest").collect()
        assert sorted(r.value for r in rows) == values


def test_manifest_cut_off_by_a_crash(spark, places):
    stream = StreamIngest(spark, places["root"], "s", lambda: [QUERY_TEST])
    batch = spark.createDataFrame([(json.dumps([GOOD] * 4),)], "body string")
    write_text(spark, f"{places['root']}/_epochs/s/{'0' * 32}/{0:012d}.json", "")
    stream.process(batch, 0)
    assert telemill.scan_table(spark, places["root"], "querytest").count() == 4


def test_epoch_repeated_after_its_rows_were_closed(spark, places):
    stream = StreamIngest(spark, places["root"], "s", lambda: [QUERY_TEST])
    batch = spark.createDataFrame([(json.dumps([GOOD] * 4),)], "body string")
    stream.process(batch, 0)
    telemill.close_segment(spark, places["root"], QUERY_TEST)
    stream.process(batch, 0)
    assert telemill.scan_table(spark, places["root"], "querytest").count() == 4
    stream.process(batch, 1)
    assert telemill.scan_table(spark, places["root"], "querytest").count() == 8


def test_repeated_epoch_keeps_time_and_types(spark, places):
    types = [QUERY_TEST]
    stream = StreamIngest(spark, places["root"], "s", lambda: list(types))
    batch = spark.createDataFrame([(json.dumps([GOOD] * 4),)], "body string")
    stream.process(batch, 0)
    first = telemill.scan_table(spark, places["root"], "querytest").first().ingest_time
    types.clear()
    stream.process(batch, 0)
    rows = telemill.scan_table(spark, places["root"], "querytest").collect()
    assert len(rows) == 4 and {r.ingest_time for r in rows} == {first}


def test_rotation_by_latency(spark, places):
    times = iter(["2024-06-01 00:00:00.000", "2024-06-01 00:01:59.999", "2024-06-01 00:02:00.000", "2024-06-01 00:04:30.000", "2024-06-01 00:05:00.000"])
    stream = StreamIngest(spark, places["root"], "s", lambda: [BETA], clock=lambda: next(times))
    beta = {"beta": {"betaStr": "b", "betaBool": True, "betaReal": 1.5}}

    def loads():
        rows = telemill.scan_table(spark, places["root"], "beta").select(F.input_file_name().alias("f")).collect()
        return sorted("closed" if "closed-" in r.f else "open" for r in rows)

    def process(items, epoch):
        stream.process(spark.createDataFrame([(json.dumps(items),)], "body string"), epoch)

    process([beta], 0)
    process([beta] * 2, 1)
    assert loads() == ["open"] * 3
    for _ in range(2):  # a repeated epoch closes the same loads, and not its own
        process([beta], 2)
        assert loads() == ["closed"] * 3 + ["open"]
    process([], 3)  # no rows of the type, but its latency has passed
    assert loads() == ["closed"] * 4
    with pytest.raises(ValueError, match="not for 9"):
        stream.process(spark.createDataFrame([("[]",)], "body string"), 9)


def test_types_come_and_go(spark, places):
    registry = Registry(spark, places["registry"])
    registry.add(ALPHA.to_json())
    stream = StreamIngest(spark, places["root"], "s", registry.definitions)
    beta = {"beta": {"betaStr": "b", "betaBool": True, "betaReal": 1.5}}
    for name, change in (("a", None), ("b", lambda: registry.add(BETA.to_json())), ("c", lambda: registry.remove("beta"))):
        if change:
            change()
        drop(places, name, [beta, beta])
        run(spark, stream, places, 10)
    assert telemill.scan_table(spark, places["root"], "beta").count() == 2
    quarantined = read_quarantine(spark, places["root"]).collect()
    assert [r.errors[0].code for r in quarantined] == ["item_type_not_defined"] * 4


def test_failed_write_is_on_record(spark, places):
    def failing(rows, root, definition, load):
        if definition.name == "querytest":
            raise OSError("disk full")
        return telemill.write_table(rows, root, definition, load)

    drop(places, "a", [GOOD] * 3)
    with pytest.raises(Exception, match="disk full"):
        run(spark, StreamIngest(spark, places["root"], "s", lambda: [QUERY_TEST], writer=failing), places)
    failure = telemill.scan_table(spark, places["root"], "writer-error").collect()
    assert [(r.itemType, r.operation) for r in failure] == [("querytest", "flush")]
    assert "disk full" in failure[0].errorMsg
    run(spark, StreamIngest(spark, places["root"], "s", lambda: [QUERY_TEST]), places)
    assert telemill.scan_table(spark, places["root"], "querytest").count() == 3


def test_a_quiet_type_is_closed_by_its_timer(spark, places):
    """No further epoch comes; BETA's two minutes have passed, the accounts' hours have not."""
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    times = [now - dt.timedelta(minutes=3), now - dt.timedelta(minutes=2, seconds=30)]
    stream = StreamIngest(spark, places["root"], "s", lambda: [ALPHA_LATER, BETA], clock=lambda: str(times.pop(0))[:23])
    beta = {"beta": {"betaStr": "b", "betaBool": True, "betaReal": 1.5}}
    for epoch in range(2):
        stream.process(spark.createDataFrame([(json.dumps([beta, {"alpha": {"alphaStr": "a", "alphaInt": 1, "alphaDate": "2024-06-01 00:00:00"}}]),)], "body string"), epoch)
    before = scan_state(spark, places["root"])
    timers = stream.start_timers(places["checkpoint"], "500 milliseconds")
    try:
        end = time.monotonic() + 90
        while scan_state(spark, places["root"])["beta"] != ["closed"] * 2 and time.monotonic() < end and timers.isActive:
            time.sleep(0.5)
    finally:
        timers.stop()
    assert before == {"alpha": ["open"] * 2, "beta": ["open"] * 2}
    assert scan_state(spark, places["root"]) == {"alpha": ["open"] * 2, "beta": ["closed"] * 2}


def scan_state(spark, root):
    found = {}
    for name in ("alpha", "beta"):
        rows = telemill.scan_table(spark, root, name).select(F.input_file_name().alias("f")).collect()
        found[name] = sorted("closed" if "closed-" in r.f else "open" for r in rows)
    return found


@pytest.mark.parametrize("size", [1, 7, 100])
def test_an_epoch_takes_so_many_items(spark, places, size):
    limit = ItemLimit(spark, places["root"], size)
    expected = []
    for epoch, count in enumerate((10, 0, 3, 25)):
        rows = [(f"{epoch}-{n}",) for n in range(count)]
        expected += [r[0] for r in rows]
        batch = spark.createDataFrame(rows, "body string")
        limit.take(batch, epoch)
        limit.take(batch.repartition(3), epoch)  # repeated, in another order
    limit.flush()
    limit.flush()
    epochs = []
    query = limit.stream().writeStream.option("checkpointLocation", places["checkpoint"])
    query.foreachBatch(lambda df, _: epochs.append([r.body for r in df.collect()])).trigger(availableNow=True).start().awaitTermination()
    sizes = sorted((len(e) for e in epochs), reverse=True)
    assert sizes == [size] * (38 // size) + [38 % size] * (38 % size > 0)
    assert sorted(x for e in epochs for x in e) == sorted(expected)
    with pytest.raises(ValueError):
        ItemLimit(spark, places["root"], 0)
