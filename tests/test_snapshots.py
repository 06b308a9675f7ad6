"""Snapshots of tables, the log below them, and readers and writers that meet."""

import datetime as dt
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

import telemill
from telemill import Registry
from telemill.session import create_text, list_files, list_names, path_exists, read_text, readable, write_text
from telemill.sources import sinks, snapshots
from telemill.sources.log import ControlLog
from telemill.sources.sinks import prepare_tables, scan_definition
from telemill.streaming.registry import DefinitionError
from tests.types import QUERY_TEST
from workloads.queries import rows_scanned


@pytest.fixture
def root(spark, tmp_path):
    prepare_tables(spark, str(tmp_path / "ro{o}t [1]*"), [QUERY_TEST])
    return str(tmp_path / "ro{o}t [1]*")


def rows(spark, *minutes, label="x"):
    start = dt.datetime(2024, 6, 1)
    data = [(start + dt.timedelta(minutes=m), label, m, None) for m in minutes]
    return spark.createDataFrame(data, QUERY_TEST.stored_schema)


def values(spark, root, **period):
    df = scan_definition(spark, root, QUERY_TEST) if not period else telemill.scan_table(spark, root, "querytest", **period)
    return sorted(r.value for r in df.collect())


# --- the log -------------------------------------------------------------------


def test_created_once(spark, tmp_path):
    path = f"{tmp_path}/a/b.json"
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda n: create_text(spark, path, f"text {n}"), range(8)))
    assert sum(made) == 1 and read_text(spark, path) == f"text {made.index(True)}"
    assert list_names(spark, f"{tmp_path}/a") == ["b.json"] and list_files(spark, f"{tmp_path}/a") == [("b.json", 6)]
    assert list_names(spark, f"{tmp_path}/none") == []


@pytest.mark.parametrize("prune", [True, False])
def test_log_of_many_writers(spark, tmp_path, prune):
    fold = lambda state, entry: {"sum": state.get("sum", 0) + entry["n"], "seen": state.get("seen", []) + [entry["n"]]}
    log = lambda: ControlLog(spark, f"{tmp_path}/log", fold, fold_every=4, prune=prune)
    assert log().state() == (0, {})

    def add(n):
        return log().commit(lambda state: {"n": n, "after": len(state.get("seen", []))})

    with ThreadPoolExecutor(8) as pool:
        entries = list(pool.map(add, range(22)))
    total, state = log().state()
    assert total == 22 and sorted(state["seen"]) == list(range(22))
    # Each was made from the state right before it.
    assert [e["after"] for e in sorted(entries, key=lambda e: state["seen"].index(e["n"]))] == list(range(22))
    assert len(log().entries()) == (6 if prune else 22)
    assert log().commit(lambda _: None) is None and log().state()[0] == 22


def test_registry_of_many_writers(spark, tmp_path):
    texts = json.loads(QUERY_TEST.to_json())
    with ThreadPoolExecutor(8) as pool:
        added = list(pool.map(lambda n: _add(spark, tmp_path, {**texts, "name": f"type{n % 6}"}), range(24)))
    registry = Registry(spark, f"{tmp_path}/types")
    assert sum(added) == 6 and registry.names() == [f"type{n}" for n in range(6)]
    assert [r.seq for r in registry.log().orderBy("seq").collect()] == list(range(6))
    assert {n % 6 for n, ok in enumerate(added) if ok} == set(range(6))


def _add(spark, tmp_path, definition):
    try:
        Registry(spark, f"{tmp_path}/types").add(json.dumps(definition))
        return True
    except DefinitionError as cause:
        assert cause.code == "already_exists"
        return False


# --- snapshots -------------------------------------------------------------------


def test_readers_between_all_steps_of_a_closing(spark, root, monkeypatch):
    for k in range(3):
        telemill.write_table(rows(spark, k, k + 10), root, QUERY_TEST, f"load{k}")
    planned = scan_definition(spark, root, QUERY_TEST)
    seen = []

    def watched(step):
        def run(*args, **kwargs):
            seen.append(values(spark, root))
            out = step(*args, **kwargs)
            seen.append(values(spark, root))
            return out

        return run

    for name in ("clean", "commit_loads", "measured_files"):
        monkeypatch.setattr(snapshots, name, watched(getattr(snapshots, name)))
    assert telemill.close_segment(spark, root, QUERY_TEST, keep_seconds=0).startswith("closed-2024-06-01_00-00-00.000")
    seen.append(values(spark, root))
    assert len(seen) >= 7 and all(s == [0, 1, 2, 10, 11, 12] for s in seen)
    # A reader of the snapshot before goes on; its files go with a later closing.
    assert sorted(r.value for r in planned.collect()) == [0, 1, 2, 10, 11, 12]


def test_of_two_closers_one_wins(spark, root, monkeypatch):
    telemill.write_table(rows(spark, 1, 2), root, QUERY_TEST, "one")
    telemill.write_table(rows(spark, 3), root, QUERY_TEST, "two")
    measured, inner = snapshots.measured_files, []

    def overtaken(*args):
        monkeypatch.setattr(snapshots, "measured_files", measured)
        inner.append(telemill.close_segment(spark, root, QUERY_TEST))
        return measured(*args)

    monkeypatch.setattr(snapshots, "measured_files", overtaken)
    assert telemill.close_segment(spark, root, QUERY_TEST) is None
    assert inner[0] is not None and values(spark, root) == [1, 2, 3]
    folders = [n for n in list_names(spark, f"{root}/querytest/querytest") if "closed-" in n]
    assert folders == [f"__load={inner[0]}"]


def test_closers_side_by_side(spark, root):
    for k in range(3):
        telemill.write_table(rows(spark, k), root, QUERY_TEST, f"load{k}")
    with ThreadPoolExecutor(4) as pool:
        closed = list(pool.map(lambda _: telemill.close_segment(spark, root, QUERY_TEST), range(4)))
    assert sum(c is not None for c in closed) == 1 and values(spark, root) == [0, 1, 2]


def test_a_load_written_again_replaces_itself(spark, root):
    telemill.write_table(rows(spark, 1, 2), root, QUERY_TEST, "one")
    before = scan_definition(spark, root, QUERY_TEST)
    telemill.write_table(rows(spark, 5), root, QUERY_TEST, "one")
    assert values(spark, root) == [5] and sorted(r.value for r in before.collect()) == [1, 2]
    assert len(sinks.clean_table(spark, root, QUERY_TEST, keep_seconds=0)) == 1
    assert values(spark, root) == [5]


def test_writer_during_a_closing(spark, root, monkeypatch):
    telemill.write_table(rows(spark, 1), root, QUERY_TEST, "one")
    commit, writes = snapshots.commit_loads, iter([("two", 2), ("one", 7)])

    def late(*args):
        load, minute = next(writes)
        monkeypatch.setattr(snapshots, "commit_loads", commit)
        telemill.write_table(rows(spark, minute), root, QUERY_TEST, load)
        return commit(*args)

    monkeypatch.setattr(snapshots, "commit_loads", late)
    assert telemill.close_segment(spark, root, QUERY_TEST) is not None  # another load is no conflict
    assert values(spark, root) == [1, 2]
    telemill.write_table(rows(spark, 6), root, QUERY_TEST, "one")
    monkeypatch.setattr(snapshots, "commit_loads", late)
    assert telemill.close_segment(spark, root, QUERY_TEST) is None  # "one" is not what was read any more
    assert values(spark, root) == [1, 2, 7]


def test_tables_from_before_snapshots(spark, root):
    path = f"{root}/querytest/querytest"
    for k in range(2):
        rows(spark, k).withColumn("__date", F.to_date("ingest_time")).write.partitionBy("__date").parquet(
            f"{path}/__load=old{k}"
        )
    write_text(spark, f"{path}/__load=half/_temporary/part", "half")
    assert values(spark, root) == [0, 1]
    telemill.write_table(rows(spark, 2), root, QUERY_TEST, "new")
    assert values(spark, root) == [0, 1, 2]
    assert values(spark, root, start="2024-06-01 00:01:00") == [1, 2]
    assert telemill.close_segment(spark, root, QUERY_TEST).startswith("closed-2024-06-01_00-00-00.000")
    assert values(spark, root) == [0, 1, 2] and path_exists(spark, f"{path}/__load=half/_temporary/part")


# --- periods -------------------------------------------------------------------------


def test_only_files_of_a_period_are_opened(spark, root):
    loads = telemill.write_loads(rows(spark, *range(600)), root, QUERY_TEST, F.date_format("ingest_time", "'h'HH:mm"))
    assert len(loads) == 600
    telemill.write_table(rows(spark, 100, label="late"), root, QUERY_TEST, "late")
    period = {"start": "2024-06-01 01:39:30", "end": "2024-06-01T01:42"}
    found = telemill.scan_table(spark, root, "querytest", **period)
    assert len(found.inputFiles()) == 3 and values(spark, root, **period) == [100, 100, 101]
    assert values(spark, root, start="2024-06-01 09:59:00.000001") == [] == values(spark, root, end="2024-06-01")
    assert len(values(spark, root)) == 601
    # A closed segment has a zone for each of its files.
    assert telemill.close_segment(spark, root, QUERY_TEST) is not None
    assert values(spark, root, **period) == [100, 100, 101] and len(values(spark, root)) == 601


def test_loads_of_nothing(spark, root):
    assert telemill.write_loads(rows(spark), root, QUERY_TEST, F.lit("a")) == []
    telemill.write_table(rows(spark), root, QUERY_TEST, "empty")
    assert values(spark, root) == [] and telemill.close_segment(spark, root, QUERY_TEST) is None


def test_bloom_filters_of_key_columns(spark, root):
    """Without dictionaries to look into, only a Bloom filter can rule out a row group for a key between its ends."""
    data = [(dt.datetime(2024, 6, 1), f"{n * 7919 % 4001:06d}", n, None) for n in range(4000)]
    df = spark.createDataFrame(data, QUERY_TEST.stored_schema).repartition(8, F.xxhash64("label"))
    scanned = {}
    for load, keys in (("plain", []), ("keyed", ["label"])):
        path = telemill.write_table(df, root, QUERY_TEST, load, key_columns=keys)
        read = spark.read.option("parquet.filter.dictionary.enabled", "false").parquet(readable(path))
        scanned[load] = rows_scanned(read.where(F.col("label") == "000077"))
    assert scanned["plain"] == 4000 and scanned["keyed"] < 1500
    assert telemill.close_segment(spark, root, QUERY_TEST, key_columns=["label"]) is not None
    assert values(spark, root) == sorted([*range(4000)] * 2)
