import datetime as dt
import json
import random

import pytest

import telemill
from telemill import Column, ItemDefinition, ingest_batch
from telemill.definitions import KINDS
from telemill.operators.validation import NO_ROUTE, check_items
from tests.types import ALL, ALL_SCALARS, ALPHA, BETA, GAMMA, STAMP, VM_REBOOT, bodies

NOON = dt.datetime(2024, 6, 1, 10)


def ingest(spark, items, definitions=ALL):
    return ingest_batch(bodies(spark, json.dumps(items)), definitions, STAMP)


def accepted(spark, definition, data):
    rows = ingest(spark, [{definition.name: data}]).accepted(definition.name).collect()
    return [tuple(r) for r in rows]


def codes(spark, type_name, data, definitions=ALL):
    rows = ingest(spark, [{type_name: data}], definitions).rejected.collect()
    return [(e.code, e.field, e.value) for r in rows for e in r.errors]


def test_typed_rows(spark):
    assert accepted(spark, ALPHA, {"alphaStr": "hello, world", "alphaInt": 42, "alphaDate": "2024-01-15 08:30:00.000"}) == [
        (NOON, "hello, world", 42, dt.datetime(2024, 1, 15, 8, 30))
    ]
    assert accepted(spark, BETA, {"betaStr": "world", "betaBool": True, "betaReal": 3.14}) == [(NOON, "world", True, 3.14)]
    assert accepted(spark, GAMMA, {"gammaInt": 7, "gammaStr": "", "gammaDynamic": '{"key":"value"}'}) == [
        (NOON, 7, "", '{"key":"value"}')
    ]


def test_defaults_and_missing_optional(spark):
    row = accepted(spark, ALL_SCALARS, {"_boolean": False})
    assert row == [
        (NOON, None, False, dt.datetime(2000, 1, 1, 0, 0, 1, 100000), '{"key": "value"}', 10, 55.55, None)
    ]


def test_undeclared_fields_are_dropped(spark):
    data = {
        "vmId": "vm_1", "eventTime": "2023-10-01 12:00:00.125", "rebootStart": "2023-10-01 11:00:00",
        "rebootDurationSec": "120s", "OS": '{"os": "Linux"}',
    }
    row = accepted(spark, VM_REBOOT, data)[0]
    assert row[4:] == (None, "unknown", '{"os": "Linux"}')


def test_all_errors_of_an_item(spark):
    assert codes(spark, "alpha", {"alphaStr": "only"}) == [
        ("missing_required_field", "alphaInt", "missing"),
        ("missing_required_field", "alphaDate", "missing"),
    ]
    assert codes(spark, "alpha", {"alphaStr": 1, "alphaInt": "x", "alphaDate": "not-a-date"}) == [
        ("invalid_field_type", "alphaStr", "1"),
        ("invalid_field_type", "alphaInt", "x"),
        ("invalid_datetime", "alphaDate", "not-a-date"),
    ]


@pytest.mark.parametrize("name", ["_string", "_boolean", "_datetime", "_dynamic", "_int", "_real", "_timespan"])
def test_explicit_null_is_a_wrong_type(spark, name):
    data = {"_boolean": True, name: None}
    assert codes(spark, "allscalars", data) == [("invalid_field_type", name, "<nil>")]


def test_type_names_are_exact(spark):
    assert codes(spark, "Alpha", {}) == [("item_type_not_defined", None, None)]
    assert codes(spark, "no-such-type", {}) == [("item_type_not_defined", None, None)]
    assert codes(spark, "alpha", {}, []) == [("item_type_not_defined", None, None)]


def test_field_names_are_exact(spark):
    d = ItemDefinition("odd", tuple(Column(n, "int") for n in ("a.b", "it's", 'say "x"', "a]b", "Id", "id", "", "a,b", "`")))
    data = {c.name: i for i, c in enumerate(d.columns)}
    assert [tuple(r)[1:] for r in ingest(spark, [{"odd": data}], [d]).accepted("odd").collect()] == [tuple(range(9))]
    assert codes(spark, "odd", {**data, "Id": "x"}, [d]) == [("invalid_field_type", "Id", "x")]


def test_large_integers_keep_every_digit(spark):
    d = ItemDefinition("num", (Column("n", "int"),))
    body = '[{"num":{"n":9007199254740993}},{"num":{"n":-9223372036854775808}},{"num":{"n":9223372036854775807.0}},{"num":{"n":1e18}}]'
    rows = ingest_batch(bodies(spark, body), [d], STAMP).accepted("num", ["pos"]).orderBy("pos").collect()
    assert [r.n for r in rows] == [9007199254740993, -9223372036854775808, 10**18]
    assert [r.pos for r in rows] == [0, 1, 3]


def test_batch_counts(spark):
    items = [
        {"alpha": {"alphaStr": "a", "alphaInt": 1, "alphaDate": "2024-01-01 00:00:00"}},
        {"beta": {"betaStr": "b", "betaBool": True, "betaReal": 1}},
        {"unknownType": {}},
        {"beta": {"betaStr": "b", "betaBool": "not-a-bool", "betaReal": 1.0}},
    ]
    result = ingest(spark, items)
    report = result.report.first()
    assert (report.items_in, report.ingested, report.rejected, report.status, report.reason) == (4, 2, 2, 200, None)
    messages = [m for r in result.rejected.orderBy("kind", "pos").collect() for m in r.messages]
    assert messages == [
        "ingest convert failed for item type 'unknownType' with input 'item type: unknownType': item type not defined",
        "ingest validate_field failed for item type 'beta' with input 'field:betaBool value:not-a-bool': invalid field type",
    ]


def test_long_inputs_are_cut_in_messages(spark):
    result = ingest(spark, [{"alpha": {"alphaStr": "a", "alphaInt": "x" * 90, "alphaDate": "2024-01-01 00:00:00"}}])
    message = result.rejected.first().messages[0]
    assert "with input 'field:alphaInt value:" + "x" * (47 - len("field:alphaInt value:")) + "...'" in message


def test_staged_result_is_the_same(spark):
    items = [{"beta": {"betaStr": "b", "betaBool": True, "betaReal": i}} for i in range(5)] + [{"ghost": {}}, {"a": 1}]
    plain = ingest(spark, items)
    staged = plain.staged()
    assert sorted(map(tuple, staged.accepted("beta").collect())) == sorted(map(tuple, plain.accepted("beta").collect()))
    assert staged.report.collect() == plain.report.collect()
    assert staged.rejected.count() == 2


def test_ingest_time_is_one_per_batch(spark):
    items = [{"beta": {"betaStr": "b", "betaBool": True, "betaReal": i}} for i in range(50)]
    result = ingest_batch(bodies(spark, json.dumps(items)), ALL)
    times = {r.ingest_time for r in result.accepted("beta").collect()}
    assert len(times) == 1 and times.pop().microsecond % 1000 == 0


def test_many_types_are_checked_like_few(spark):
    """Checked by place and kind, items have the errors and values they have when each type is compiled by itself."""
    rng = random.Random(3)
    kinds = sorted(KINDS)
    types = []
    for n in range(30):
        columns = [
            Column(f"c{n} {i}", rng.choice(kinds), optional=rng.random() < 0.3) for i in range(rng.randrange(1, 6))
        ]
        types.append(ItemDefinition(f"type{n}", tuple(columns)))
    values = [1, 2.5, True, "x", "{}", "1.02:03:04", "2024-06-01 10:00:00", None, [], 10**25]
    items = []
    for n in range(400):
        d = types[rng.randrange(30)]
        items.append({d.name: {c.name: rng.choice(values) for c in d.columns if rng.random() < 0.9}})
    items += [{"unknown": {}}, {"type1": 3}, {"type2": {}, "type3": {}}]
    split = telemill.split_envelopes(bodies(spark, json.dumps(items)))
    many = {r.pos: r for r in check_items(split, types).collect()}
    assert len(many) == 403
    for some in (types[:3], types[3:6]):
        for r in check_items(split, some).collect():
            if r.route != NO_ROUTE or r.type_name is None:
                assert many[r.pos].errors == r.errors and many[r.pos].route == r.route
    plans = [len(check_items(split, types[:n])._jdf.queryExecution().analyzed().toString()) for n in (15, 30)]
    assert plans[1] < 1.2 * plans[0]
