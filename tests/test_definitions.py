import json

import pytest

from telemill import ItemDefinition, Registry, load_definitions
from telemill.operators.lint import dedupe_definitions, detect_schema_drift, lint_definitions, read_sidecars, sidecars
from telemill.streaming.registry import DefinitionError

COLUMNS = [{"name": "a", "type": "int"}]


def definition(**members):
    base = {"name": "alpha", "orderedColumns": COLUMNS, **members}
    return json.dumps({k: v for k, v in base.items() if v is not ...})


def column(**members):
    return definition(orderedColumns=[{"name": "a", "type": "int", **members}])


CASES = [
    (definition(), "ok"),
    (definition(folder="my-folder", latencyMinutes=0, documentation="x"), "ok"),
    (definition(folder=None, latencyMinutes=None, documentation=None), "ok"),
    (definition(latencyMinutes=2.0), "ok"),
    (definition(name=...), "missing_name"),
    (definition(name=5), "missing_name"),
    ("null", "missing_name"),
    ("[]", "invalid_json"),
    ("{bad", "invalid_json"),
    ('{"name":"alpha"} x', "invalid_json"),
    ("", "invalid_json"),
    (definition(name="ingest_time"), "reserved_name"),
    (definition(name="Alpha"), "invalid_file_name"),
    (definition(name="al pha"), "invalid_file_name"),
    (definition(name="al"), "invalid_file_name"),
    (definition(name=""), "invalid_file_name"),
    (definition(name="a--b"), "invalid_file_name"),
    (definition(name="-ab"), "invalid_file_name"),
    (definition(name="ab-"), "invalid_file_name"),
    (definition(name="x" * 64), "invalid_file_name"),
    (definition(name="x" * 63), "ok"),
    (definition(name="abc\n"), "invalid_file_name"),
    (definition(documentation=5), "invalid_documentation"),
    (definition(folder="ab"), "invalid_folder"),
    (definition(folder="a/bc"), "invalid_folder"),
    (definition(folder=5), "invalid_folder"),
    (definition(latencyMinutes=-1), "negative_latency"),
    (definition(latencyMinutes=1.5), "invalid_latency"),
    (definition(latencyMinutes=-1.5), "invalid_latency"),
    (definition(latencyMinutes="1"), "invalid_latency"),
    (definition(orderedColumns=...), "missing_columns"),
    (definition(orderedColumns={}), "missing_columns"),
    (definition(orderedColumns=[]), "empty_columns"),
    (definition(orderedColumns=[*COLUMNS, *COLUMNS]), "duplicate_column"),
    (definition(orderedColumns=["x"]), "invalid_column_name"),
    (definition(orderedColumns=[None]), "invalid_column_name"),
    (column(name="ingest_time"), "reserved_name"),
    (column(name=""), "ok"),
    (column(name=5), "invalid_column_name"),
    (column(type="blob"), "unsupported_column_type"),
    (column(type=None), "missing_column_type"),
    (definition(orderedColumns=[{"name": "a"}]), "missing_column_type"),
    (column(defaultValue=None), "inconsistent_default"),
    (column(defaultValue=5), "ok"),
    (column(defaultValue=5.5), "inconsistent_default"),
    (column(defaultValue="5"), "inconsistent_default"),
    (column(type="bool", defaultValue="true"), "inconsistent_default"),
    (column(type="bool", defaultValue=False), "ok"),
    (column(type="real", defaultValue=1), "ok"),
    (column(type="string", defaultValue=1), "inconsistent_default"),
    (column(type="datetime", defaultValue="2000-01-01 00:00:01"), "ok"),
    (column(type="datetime", defaultValue="2000-01-01"), "inconsistent_default"),
    (column(type="timespan", defaultValue="1d2h"), "ok"),
    (column(type="timespan", defaultValue="2days"), "inconsistent_default"),
    (column(type="dynamic", defaultValue='{"a":1}'), "ok"),
    (column(type="dynamic", defaultValue="[1]"), "inconsistent_default"),
    (column(type="dynamic", defaultValue={"a": 1}), "inconsistent_default"),
    (column(optional=True), "ok"),
    (column(optional=None), "ok"),
    (column(optional="yes"), "inconsistent_default"),
    # The first fault counts, in the order of the members.
    (definition(name="Bad", folder="x", latencyMinutes=-1), "invalid_file_name"),
    (definition(folder="x", orderedColumns=[]), "invalid_folder"),
    (definition(orderedColumns=[*COLUMNS, {"name": "b", "type": "blob"}, *COLUMNS]), "unsupported_column_type"),
    (definition(orderedColumns=[*COLUMNS, *COLUMNS, {"name": "b", "type": "blob"}]), "duplicate_column"),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "seq int, definition string")
    rows = lint_definitions(df).orderBy("seq").collect()
    assert [(CASES[r.seq][0], r.verdict) for r in rows] == CASES


def test_members_with_defaults(spark):
    df = spark.createDataFrame([(0, definition())], "seq int, definition string")
    row = lint_definitions(df).first()
    assert (row.name, row.folder, row.latency_minutes) == ("alpha", "alpha", 1)
    assert ItemDefinition.from_json(definition(latencyMinutes=0)).segment_minutes == 60


def test_first_of_a_name_stays(spark):
    texts = [definition(name="bad one"), definition(), definition(name="beta"), definition()]
    df = spark.createDataFrame(list(enumerate(texts)), "seq int, definition string")
    rows = dedupe_definitions(lint_definitions(df)).orderBy("seq").collect()
    assert [r.verdict for r in rows] == ["invalid_file_name", "ok", "ok", "already_exists"]


def test_schema_file_has_ingest_time_first(spark):
    text = definition(orderedColumns=[{"name": "z", "type": "int"}, {"name": "a", "type": "string", "optional": True}])
    expected = {
        "name": "alpha",
        "orderedColumns": [
            {"name": "ingest_time", "type": "datetime"},
            {"name": "z", "type": "int"},
            {"name": "a", "type": "string"},
        ],
    }
    df = spark.createDataFrame([(0, text)], "seq int, definition string")
    assert json.loads(sidecars(lint_definitions(df)).first().sidecar) == expected
    assert json.loads(ItemDefinition.from_json(text).sidecar()) == expected


def stored(*columns):
    return json.dumps({"name": "alpha", "orderedColumns": [{"name": n, "type": t} for n, t in columns]})


TIME = ("ingest_time", "datetime")


@pytest.mark.parametrize(
    "text, verdict, detail",
    [
        (None, "ok", None),
        (stored(TIME, ("label", "string"), ("value", "int")), "ok", None),
        (stored(("label", "string"), ("value", "int")), "ok", None),
        (stored(TIME, ("label", "string")), "column_count",
         "column count mismatch: stored schema has 1 user columns, definition has 2"),
        (stored(TIME, ("label", "string"), ("count", "int")), "column_mismatch",
         'column[2] mismatch: stored {"count" "int"}, definition {"value" "int"}'),
        (stored(TIME, ("label", "string"), ("value", "real")), "column_mismatch",
         'column[2] mismatch: stored {"value" "real"}, definition {"value" "int"}'),
        ("{bad json", "unreadable", "invalid JSON"),
    ],
)
def test_drift(spark, text, verdict, detail):
    columns = "array<struct<name:string,type:string>>"
    declared = spark.createDataFrame(
        [("alpha", [("label", "string"), ("value", "int")])], f"type_name string, columns {columns}"
    )
    texts = [] if text is None else [("alpha", text)]
    known = read_sidecars(spark.createDataFrame(texts, "key string, sidecar string")).selectExpr(
        "key as type_name", "columns", "problem"
    )
    assert tuple(detect_schema_drift(declared, known).first()) == ("alpha", verdict, detail)


def test_registry(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "registry"))
    assert registry.names() == []
    registry.add(definition())
    registry.add(definition(name="beta", latencyMinutes=7))
    assert registry.names() == ["alpha", "beta"]
    assert registry.get("beta").latency_minutes == 7
    with pytest.raises(DefinitionError, match="already_exists"):
        registry.add(definition())
    with pytest.raises(DefinitionError, match="invalid_latency"):
        registry.add(definition(name="gamma", latencyMinutes="x"))
    registry.remove("alpha")
    with pytest.raises(DefinitionError, match="not_found"):
        registry.remove("alpha")
    registry.add(definition(folder="elsewhere"))
    again = Registry(spark, str(tmp_path / "registry"))
    assert [(d.name, d.folder) for d in again.definitions()] == [("alpha", "elsewhere"), ("beta", "beta")]


def test_loading_many(spark):
    loaded = load_definitions(spark, [definition(), column(type="real", defaultValue=1)])
    assert loaded[1].columns[0].default == 1.0 and isinstance(loaded[1].columns[0].default, float)
    assert ItemDefinition.from_json(loaded[1].to_json()) == loaded[1]
    with pytest.raises(DefinitionError):
        load_definitions(spark, ["{bad"])
