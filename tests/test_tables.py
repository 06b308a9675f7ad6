import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import telemill
from telemill import Column, ItemDefinition
from telemill.plans.store import read_quarantine, store_batch
from telemill.session import path_exists, read_text, write_text
from telemill import session
from telemill.plans import store
from telemill.sources import sinks, snapshots
from telemill.sources.catalog import CatalogError, find_table
from telemill.sources.sinks import prepare_tables, scan_definition, stream_load
from telemill.sources.tables import CsvSegment, SchemaDriftError, scan_csv, segments_in_period
from tests.types import ALL, ALL_SCALARS, QUERY_TEST, VM_REBOOT, VM_SHUTDOWN, VM_START, bodies

BODY = json.dumps(
    [
        {"querytest": {"label": "alpha", "value": 10, "note": "first"}},
        {"querytest": {"label": "beta", "value": 20}},
        {"querytest": {"label": "gamma", "value": 30, "note": "third"}},
    ]
)


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "root")


@pytest.fixture
def stored(spark, root):
    store_batch(bodies(spark, BODY), ALL, root, "one", "2024-06-01 10:00:00.123")
    return root


def labels(df):
    return sorted(r.label for r in df.collect())


# --- catalog ---------------------------------------------------------------------


def sidecar(spark, root, folder, name, text=None):
    text = text or json.dumps({"name": name, "orderedColumns": [{"name": "v", "type": "string"}]})
    write_text(spark, f"{root}/{folder}/{name}.json", text)


def test_two_types_in_two_folders_and_three_in_one(spark, root):
    for folder, name in (("alpha-folder", "alpha"), ("beta", "beta"), ("shared", "x-1"), ("shared", "x-2"), ("shared", "x-3")):
        sidecar(spark, root, folder, name)
    write_text(spark, f"{root}/logs/readme.txt", "no table")
    listed = telemill.list_tables(telemill.discover_catalog(spark, root)).collect()
    assert [tuple(r) for r in listed] == [
        ("alpha", "alpha-folder", "file"), ("beta", "beta", "file"), ("x-1", "shared", "file"), ("x-2", "shared", "file"),
        ("x-3", "shared", "file"),
    ]


def test_empty_and_missing_roots(spark, tmp_path):
    assert telemill.discover_catalog(spark, str(tmp_path)).count() == 0
    with pytest.raises(CatalogError):
        telemill.discover_catalog(spark, str(tmp_path / "nowhere"))


@pytest.mark.parametrize(
    "text, problem",
    [
        ("{not valid json", "invalid JSON"),
        ('{"name":"","orderedColumns":[{"name":"a","type":"int"}]}', "empty name"),
        ('{"name":"x","orderedColumns":[]}', "no columns"),
        ('{"name":"x"}', "no columns"),
        ('{"name":"x","orderedColumns":[{"name":"a","type":"blob"}]}', "unknown column type"),
    ],
)
def test_invalid_schema_files(spark, root, text, problem):
    sidecar(spark, root, "good", "good")
    sidecar(spark, root, "bad", "bad", text)
    with pytest.raises(CatalogError, match=problem):
        telemill.discover_catalog(spark, root)
    catalog, skipped = telemill.discover_catalog_lenient(spark, root)
    assert [r.type_name for r in catalog.collect()] == ["good"]
    assert [r.problem for r in skipped.collect()] == [problem]


# --- queries -----------------------------------------------------------------------


def test_query_forms(spark, stored):
    table = telemill.open_table(spark, stored, "querytest")
    assert table.df.columns == ["ingest_time", "label", "value", "note"]
    assert table.df.count() == 3
    assert labels(table.where("value", ">=", 20).df) == ["beta", "gamma"]
    assert labels(table.where("value", ">", 20).df) == ["gamma"]
    assert table.where("value", ">", 9999).df.count() == 0
    projected = table.project("label", "value").df
    assert projected.columns == ["label", "value"]
    row = table.where("label", "==", "beta").df.first()
    assert row.note is None and "note" in row.asDict()
    assert table.take(2).df.count() == 2
    chained = table.where("value", ">=", 10).project("ingest_time", "label").take(3).df
    assert labels(chained) == ["alpha", "beta", "gamma"]
    counted = table.summarize_count("note").df.collect()
    assert {(r.note, r.count_) for r in counted} == {("first", 1), ("third", 1), (None, 1)}
    assert labels(table.where(F.col("value") < 20).df) == ["alpha"]


def test_query_errors(spark, stored):
    table = telemill.open_table(spark, stored, "querytest")
    for bad in (("nope", "==", 1), ("value", "==", "x"), ("value", "==", True), ("label", ">", 5), ("value", "~", 1)):
        with pytest.raises(telemill.plans.query.QueryError):
            table.where(*bad)
    with pytest.raises(telemill.plans.query.QueryError):
        table.project("nope")
    with pytest.raises(CatalogError):
        telemill.open_table(spark, stored, "nope")


def test_rows_as_json(spark, stored):
    rows = [json.loads(r.row) for r in telemill.open_table(spark, stored, "querytest").rows_as_json().collect()]
    assert {"ingest_time": "2024-06-01 10:00:00.123", "label": "beta", "value": 20, "note": None} in rows
    d = ItemDefinition("job", (Column("ttl", "timespan"), Column("ok", "bool"), Column("score", "real")))
    body = '[{"job":{"ttl":"1h30m30s","ok":true,"score":9.5}},{"job":{"ttl":"7d","ok":false,"score":1}}]'
    df = telemill.ingest_batch(bodies(spark, body), [d], "2026-05-01 00:15:33.421").accepted("job")
    found = sorted(r.row for r in telemill.rows_as_json(df).collect())
    assert found == [
        '{"ingest_time":"2026-05-01 00:15:33.421","ok":false,"score":1.0,"ttl":"168h0m0s"}',
        '{"ingest_time":"2026-05-01 00:15:33.421","ok":true,"score":9.5,"ttl":"1h30m30s"}',
    ]
    assert telemill.rows_as_json(df.limit(0)).collect() == []


def test_period_reads_only_its_days(spark, root):
    for day in (1, 2, 3):
        store_batch(bodies(spark, BODY), [QUERY_TEST], root, f"day{day}", f"2024-06-0{day} 10:00:00")
    df = telemill.scan_table(spark, root, "querytest", "2024-06-02 00:00:00", "2024-06-03 00:00:00")
    # The table's snapshot says which files can hold the period; the others are not even listed.
    assert df.count() == 3 and len(df.inputFiles()) == 1
    selective = telemill.open_table(spark, root, "querytest").where("value", ">=", 20).project("label").df
    plan = selective._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(value,20)" in plan and "ReadSchema: struct<label:string,value:bigint>" in plan


# --- writing ------------------------------------------------------------------------


def test_folder_shared_by_three_types(spark, root):
    items = [
        {"vm-shutdown": {"vmId": "v1", "shutdownStart": "2023-10-01 12:00:00.125"}},
        {"vm-start": {"vmId": "v1", "startTime": "2023-10-01 12:00:00"}},
        {"vm-start": {"vmId": "v2", "startTime": "2023-10-01 12:00:00"}},
        {"vm-reboot": {"vmId": "v1", "eventTime": "2023-10-01 12:00:00", "rebootStart": "2023-10-01 12:00:00"}},
    ]
    store_batch(bodies(spark, json.dumps(items)), [VM_SHUTDOWN, VM_START, VM_REBOOT], root, "one")
    counts = {n: telemill.scan_table(spark, root, n).count() for n in ("vm-shutdown", "vm-start", "vm-reboot")}
    assert counts == {"vm-shutdown": 1, "vm-start": 2, "vm-reboot": 1}
    # A default with commas and quotes stays one value.
    assert telemill.scan_table(spark, root, "vm-reboot").first().OS == '{"os": "Windows", "version": "11"}'


def test_same_load_twice_is_stored_once(spark, root):
    for _ in range(2):
        store_batch(bodies(spark, BODY, '[{"ghost":{}}]'), [QUERY_TEST], root, "one", "2024-06-01 10:00:00")
    assert telemill.scan_table(spark, root, "querytest").count() == 3
    assert telemill.scan_table(spark, root, "ingest-event").count() == 2
    assert telemill.scan_table(spark, root, "writer-flush").first().itemsFlushed == 3
    assert read_quarantine(spark, root).count() == 1


def test_drift_blocks_writing(spark, stored):
    changed = ItemDefinition("querytest", (Column("label", "string"), Column("value", "real")))
    before = read_text(spark, f"{stored}/querytest/querytest.json")
    with pytest.raises(SchemaDriftError, match="column count mismatch"):
        store_batch(bodies(spark, BODY), [changed], stored, "two")
    assert read_text(spark, f"{stored}/querytest/querytest.json") == before
    assert telemill.scan_table(spark, stored, "querytest").count() == 3
    prepare_tables(spark, stored, [QUERY_TEST])


def test_roots_must_agree(spark, stored, tmp_path):
    other = str(tmp_path / "other")
    store_batch(bodies(spark, BODY), [QUERY_TEST], other, "one")
    assert telemill.scan_roots(spark, [stored, other], "querytest").count() == 6
    third = str(tmp_path / "third")
    prepare_tables(spark, third, [ItemDefinition("querytest", (Column("label", "string"),))])
    with pytest.raises(SchemaDriftError):
        telemill.scan_roots(spark, [stored, third], "querytest")


HARD = ["plain", "hello, world", 'say "hi"', "two\nlines", "cr\r\nlf", "\r", " lead and trail ", "back\\slash", '\\"', "é😀", "#x", "a\tb"]


def test_csv_round_trip(spark, root):
    items = [{"allscalars": {"_boolean": i % 2 == 0, "_string": s, "_real": i / 3, "_timespan": f"{i}m30s"}} for i, s in enumerate(HARD)]
    items.append({"allscalars": {"_boolean": True, "_string": "", "_datetime": "2024-01-01 00:00:00.123456"}})
    rows = telemill.ingest_batch(bodies(spark, json.dumps(items)), [ALL_SCALARS], "2024-06-01 10:00:00.120").accepted("allscalars")
    prepare_tables(spark, root, [ALL_SCALARS])
    telemill.write_csv(rows, root, ALL_SCALARS)
    expected = [tuple(r) for r in rows.collect()]
    expected = [(t[0], t[1] or None, *t[2:]) for t in expected]
    got = telemill.scan_table(spark, root, "allscalars")
    assert got.schema == rows.schema
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(expected, key=repr)


def test_csv_files_from_elsewhere(spark, root):
    prepare_tables(spark, root, [QUERY_TEST, ItemDefinition("test", (Column("v", "int"),), "querytest")])
    folder = f"{root}/querytest"
    write_text(spark, f"{folder}/2024-06-01_10-00-00.000_querytest.csv", '2024-06-01 10:00:00.000,"a, ""b""",1,\n2024-06-01 10:00:59.000,x,2,n\n')
    write_text(spark, f"{folder}/2024-06-01_10-01-00.000_querytest", "2024-06-01 10:01:00.000,y,3,\n")
    write_text(spark, f"{folder}/2024-06-01_12-00-00.000_querytest.csv", "2024-06-01 12:00:00.000,z,4,\n")
    write_text(spark, f"{folder}/2024-06-01_10-00-00.000_test.csv", "2024-06-01 10:00:00.000,7\n")
    table = telemill.open_table(spark, root, "querytest")
    assert sorted(r.label for r in table.df.collect()) == ['a, "b"', "x", "y", "z"]
    assert table.where("label", "==", "y").df.first().note is None
    assert telemill.scan_table(spark, root, "test").first().v == 7
    entry = find_table(telemill.discover_catalog(spark, root), "querytest")
    part = scan_csv(spark, entry, "2024-06-01 10:00:30", "2024-06-01 10:30:00", skew_seconds=1)
    assert labels(part) == ["x", "y"] and len(part.inputFiles()) == 2


def test_segment_choice_is_conservative():
    names = [f"2024-06-01_1{h}-00-00.000" for h in range(6)]
    segments = [CsvSegment(n, n) for n in names]
    pick = lambda a, b, skew=0.0: [s.name[11:13] for s in segments_in_period(segments, a, b, skew)]
    assert pick(None, None) == ["10", "11", "12", "13", "14", "15"]
    assert pick("2024-06-01 12:30:00", "2024-06-01 13:30:00") == ["12", "13"]
    assert pick("2024-06-01 12:00:00", "2024-06-01 12:00:01") == ["11", "12"]
    assert pick("2024-06-01 12:00:30", "2024-06-01 12:30:00", 60) == ["11", "12"]
    assert pick("2024-06-01 12:30:00", "2024-06-01 12:59:30", 60) == ["12", "13"]
    assert pick("2024-06-02 00:00:00", None) == ["15"]
    assert pick(None, "2024-06-01 09:00:00") == []


def test_close_segment(spark, root):
    store_batch(bodies(spark, BODY), [QUERY_TEST], root, "one", "2024-06-01 10:00:00.500")
    store_batch(bodies(spark, BODY), [QUERY_TEST], root, stream_load("s", "a" * 32, 4), "2024-06-02 10:00:00")
    closed = telemill.close_segment(spark, root, QUERY_TEST)
    assert closed.startswith("closed-2024-06-01_10-00-00.500")
    assert telemill.scan_table(spark, root, "querytest").count() == 6
    assert telemill.close_segment(spark, root, QUERY_TEST) is None
    table = f"{root}/querytest/querytest"
    assert sinks.is_closed(spark, table, stream_load("s", "a" * 32, 4))
    assert not sinks.is_closed(spark, table, stream_load("s", "a" * 32, 3))
    assert not sinks.is_closed(spark, table, stream_load("s", "b" * 32, 4))
    store_batch(bodies(spark, BODY), [QUERY_TEST], root, "three", "2024-06-03 10:00:00")
    assert telemill.close_segment(spark, root, QUERY_TEST).startswith("closed-2024-06-03")
    assert telemill.scan_table(spark, root, "querytest").count() == 9


def test_close_leaves_writes_in_progress(spark, root):
    store_batch(bodies(spark, BODY), [QUERY_TEST], root, "one", "2024-06-01 10:00:00")
    going_on = f"{root}/querytest/querytest/__load={stream_load('s', 'a' * 32, 1)}/_temporary"
    write_text(spark, f"{going_on}/part", "half")
    telemill.close_segment(spark, root, QUERY_TEST)
    assert path_exists(spark, f"{going_on}/part")
    assert not sinks.is_closed(spark, f"{root}/querytest/querytest", stream_load("s", "a" * 32, 1))
    assert telemill.scan_table(spark, root, "querytest").count() == 3


def test_closing_that_never_published(spark, root, monkeypatch):
    store_batch(bodies(spark, BODY), [QUERY_TEST], root, "one", "2024-06-01 10:00:00")
    commit = snapshots.commit_loads
    monkeypatch.setattr(snapshots, "commit_loads", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        telemill.close_segment(spark, root, QUERY_TEST)
    assert telemill.scan_table(spark, root, "querytest").count() == 3
    monkeypatch.setattr(snapshots, "commit_loads", commit)
    assert telemill.close_segment(spark, root, QUERY_TEST) is not None
    assert telemill.scan_table(spark, root, "querytest").count() == 3


def test_csv_exports_that_overlap(spark, root):
    items = [{"allscalars": {"_boolean": True, "_string": str(i)}} for i in range(5)]
    parts = [
        telemill.ingest_batch(bodies(spark, json.dumps(items)), [ALL_SCALARS], f"2024-06-01 10:{m:02d}:00").accepted("allscalars")
        for m in (1, 2, 30)
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    prepare_tables(spark, root, [ALL_SCALARS])
    for load in ("a", "a", "b"):  # the same export again replaces itself
        telemill.write_csv(rows, root, ALL_SCALARS, load)
    assert telemill.scan_table(spark, root, "allscalars").count() == 30
    period = telemill.scan_table(spark, root, "allscalars", "2024-06-01 10:01:30", "2024-06-01 10:05:00")
    assert period.count() == 10


def test_csv_late_rows_and_odd_names(spark, root):
    prepare_tables(spark, root, [QUERY_TEST])
    folder = f"{root}/querytest"
    write_text(spark, f"{folder}/2024-06-01_10-00-00.000_querytest.csv", "2024-06-01 10:00:00.000,a,1,\n2024-06-01 10:05:00.000,late,2,\n")
    write_text(spark, f"{folder}/2024-06-01_10-01-00.000_querytest.csv", "2024-06-01 10:01:00.000,b,3,\n")
    write_text(spark, f"{folder}/backup_querytest.csv", "2024-06-01 10:05:30.000,odd,4,\n")
    period = telemill.scan_table(spark, root, "querytest", "2024-06-01 10:04:00", "2024-06-01 10:06:00")
    assert labels(period) == ["late", "odd"]


def test_reserved_column_names(spark, root):
    odd = ItemDefinition("odd", (Column("__date", "string"),), "odd")
    with pytest.raises(ValueError, match="reserved"):
        prepare_tables(spark, root, [odd])


def test_failed_batch_write_is_on_record(spark, root, monkeypatch):
    real = store.write_table

    def failing(rows, root, definition, load):
        if definition.name == "querytest":
            raise OSError("disk full " + "x" * 5000)
        return real(rows, root, definition, load)

    monkeypatch.setattr(store, "write_table", failing)
    with pytest.raises(OSError):
        store_batch(bodies(spark, BODY), [QUERY_TEST], root, "one", "2024-06-01 10:00:00")
    failure = telemill.scan_table(spark, root, "writer-error").collect()
    assert [r.itemType for r in failure] == ["querytest"] and len(failure[0].errorMsg) > 5000
    monkeypatch.setattr(store, "write_table", real)
    store_batch(bodies(spark, BODY), [QUERY_TEST], root, "one", "2024-06-01 10:00:00")
    assert [(r.type_name, r.rows_written) for r in store.read_ledger(spark, root).collect()] == [("querytest", 3)]


def test_scratch_needs_a_shared_folder(spark, monkeypatch, tmp_path):
    plain = spark.conf.get
    monkeypatch.setattr(spark.conf, "get", lambda key, *rest: None if key == "spark.checkpoint.dir" else plain(key, *rest))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://elsewhere:7077")
    monkeypatch.setattr(session, "_context_checkpoint_dir", lambda _: None)
    with pytest.raises(session.ScratchError):
        session.scratch_dir(spark, "x")
    monkeypatch.setattr(session, "_context_checkpoint_dir", lambda _: f"file:{tmp_path}/shared")
    assert session.scratch_dir(spark, "x").startswith(f"file:{tmp_path}/shared/x-")


def test_cut_short_while_closing(spark, root, monkeypatch):
    store_batch(bodies(spark, BODY), [QUERY_TEST], root, "one", "2024-06-01 10:00:00")
    store_batch(bodies(spark, BODY), [QUERY_TEST], root, "two", "2024-06-01 11:00:00")
    table = f"{root}/querytest/querytest"
    assert telemill.close_segment(spark, root, QUERY_TEST) is not None
    # The closed segment is there and so are the loads it replaces; each row counts once.
    assert scan_definition(spark, root, QUERY_TEST).count() == 6
    assert path_exists(spark, f"{table}/__load=one") and path_exists(spark, f"{table}/__load=two")
    remove = snapshots.remove_path
    monkeypatch.setattr(snapshots, "remove_path", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        sinks.clean_table(spark, root, QUERY_TEST, keep_seconds=0)
    assert scan_definition(spark, root, QUERY_TEST).count() == 6
    monkeypatch.setattr(snapshots, "remove_path", remove)
    assert telemill.close_segment(spark, root, QUERY_TEST, keep_seconds=0) is None
    assert not path_exists(spark, f"{table}/__load=one") and not path_exists(spark, f"{table}/__load=two")
    assert sinks.clean_table(spark, root, QUERY_TEST, keep_seconds=0) == []
    assert telemill.scan_table(spark, root, "querytest").count() == 6


def test_read_batches(spark, tmp_path):
    (tmp_path / "lines.txt").write_text('[{"a":{}}]\n[]\nnope\n')
    lines = telemill.read_batches(spark, str(tmp_path / "lines.txt"))
    assert sorted(r.body for r in lines.collect()) == ["[]", '[{"a":{}}]', "nope"]
    assert lines.select("batch_id").distinct().count() == 3
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "b1.json").write_text('[\n {"a":{}}\n]\n')
    whole = telemill.read_batches(spark, str(tmp_path / "whole"), body_per_file=True)
    assert telemill.split_envelopes(whole).first().kind == "item"


def test_batch_ids_do_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, end in (("a b", "\n"), ("c", "\r\n"), ("empty", "")):
        (tmp_path / "in" / f"{name}.txt").write_bytes("".join(f"{name} {'x' * (n % 37)}{n}{end}" for n in range(500) if end).encode())
    found = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("100", "777", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = telemill.read_batches(spark, str(tmp_path / "in"))
        found.append(sorted(map(tuple, rows.collect())))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] == found[2] and len(found[0]) == 1000
    for batch_id, body in found[0]:
        path, number = batch_id.rsplit(":", 1)
        assert body.split()[-1].lstrip("x") == number and path.endswith("c.txt" if body[0] == "c" else "a%20b.txt")


def test_ingest_time_column_comes_first_and_is_cut(spark):
    df = bodies(spark, BODY).withColumn("ingest_time", F.lit(dt.datetime(2024, 6, 1, 1, 2, 3, 456789)).cast("timestamp_ntz"))
    row = telemill.ingest_batch(df, [QUERY_TEST]).accepted("querytest").first()
    assert row[0] == dt.datetime(2024, 6, 1, 1, 2, 3, 456000)


def test_rebalanced_write_and_one_time_per_run(spark, root):
    rows = telemill.ingest_batch(bodies(spark, *[BODY] * 40), [QUERY_TEST]).accepted("querytest")
    assert rows.select("ingest_time").distinct().collect() == rows.select("ingest_time").distinct().collect()
    prepare_tables(spark, root, [QUERY_TEST])
    telemill.write_table(rows.repartition(8), root, QUERY_TEST, "one", rebalance=True)
    stored = telemill.scan_table(spark, root, "querytest")
    assert stored.count() == 120 and len(stored.inputFiles()) == 1


def test_release_removes_the_staged_copy(spark):
    result = telemill.ingest_batch(bodies(spark, BODY), [QUERY_TEST]).staged()
    assert path_exists(spark, result.staged_at) and result.accepted("querytest").count() == 3
    result.release()
    assert not path_exists(spark, result.staged_at)
