import json
import random

import pytest
from pyspark.sql import functions as F

import telemill
from telemill import pack_bodies, split_envelopes, wrap_rows
from tests.types import QUERY_TEST, bodies


def split(spark, text):
    rows = split_envelopes(bodies(spark, text)).orderBy("pos").collect()
    return [(r.kind, r.pos, r.type_name, r.code) for r in rows]


ITEM = ("item", 0, "a", None)
NO_ARRAY = [("body_error", -1, None, "invalid_json_array")]
NO_KEY = ("split_error", 0, None, "invalid_item_structure")
NO_DATA = ("split_error", 0, None, "item_data_parsing_failed")
EMPTY = [("empty_body", -1, None, None)]

CASES = {
    '[{"a":{"x":1}}]': [ITEM],
    ' \n[ {"a" : {} } ]\t': [ITEM],
    '[{"a":null}]': [ITEM],
    '[{"a":{"x":1}},{"b":"no"},{"c":{}}]': [ITEM, ("split_error", 1, None, "item_data_parsing_failed"), ("item", 2, "c", None)],
    '[{"a":{},"b":{}}]': [NO_KEY],
    "[{}]": [NO_KEY],
    "[null]": [NO_KEY],
    '[{"a":"x"}]': [NO_DATA],
    '[{"a":[]}]': [NO_DATA],
    '[{"a":1}]': [NO_DATA],
    '[{"a":{},"a":{"x":2}}]': [ITEM],
    "[]": EMPTY,
    " [ ] ": EMPTY,
    "null": EMPTY,
    "[1]": NO_ARRAY,
    '[{"a":{}},[1]]': NO_ARRAY,
    '[{"a":{}},"x"]': NO_ARRAY,
    '{"not": "an array"}': NO_ARRAY,
    "this is not json": NO_ARRAY,
    "": NO_ARRAY,
    '[{"a":{}}] x': NO_ARRAY,
    '[{"a":{}}] []': NO_ARRAY,
    '[{"a":{}}]]': NO_ARRAY,
    '[{"a":{}}': NO_ARRAY,
    '[{"a":{}},]': NO_ARRAY,
    '[{"a":{"x":NaN}}]': NO_ARRAY,
    "[{'a':{}}]": NO_ARRAY,
    '[{"a":{"x":01}}]': NO_ARRAY,
    '[{"a":{"x":"\n"}}]': NO_ARRAY,
    '[{"a":{}} {"b":{}}]': NO_ARRAY,
    '[{"a":{}}, // note\n {"b":{}}]': NO_ARRAY,
}


def test_bodies(spark):
    texts = list(CASES)
    rows = split_envelopes(bodies(spark, *texts)).orderBy("batch_id", "pos").collect()
    found = {text: [] for text in texts}
    for r in rows:
        found[texts[r.batch_id]].append((r.kind, r.pos, r.type_name, r.code))
    assert found == CASES


def test_sql_null_body_is_no_array(spark):
    df = spark.createDataFrame([(1, None)], "batch_id bigint, body string")
    assert [r.code for r in split_envelopes(df).collect()] == ["invalid_json_array"]


def test_last_of_repeated_keys_counts(spark):
    df = split_envelopes(bodies(spark, '[{"a":{"x":1,"x":2}}]'))
    assert df.select(F.variant_get("data", "$.x", "int")).first()[0] == 2


def test_error_input_is_clipped(spark):
    row = split_envelopes(bodies(spark, '{"long":"' + "x" * 200 + '"}')).first()
    assert row.value == '{"long":"' + "x" * 38 + "..."


def test_body_larger_than_a_variant(spark):
    item = '{"a":{"s":"' + "x" * 4000 + '"}}'
    n = 140 * 1024 * 1024 // len(item)
    # Not a constant, or the optimizer would put the whole body into the plan.
    body = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit(item), F.col("id").cast("int") + n), ","), F.lit("]"))
    df = spark.range(1).select(F.col("id").alias("batch_id"), body.alias("body"))
    assert split_envelopes(df).where("kind = 'item'").count() == n


def test_text_longer_than_the_parser_default(spark):
    body = F.concat(F.lit('[{"a":{"s":"'), F.repeat(F.lit("x"), F.col("id").cast("int") + 25_000_000), F.lit('"}}]'))
    df = spark.range(1).select(F.col("id").alias("batch_id"), body.alias("body"))
    text = F.variant_get("data", "$.s", "string")
    assert split_envelopes(df).select(F.length(text)).first()[0] == 25_000_000


def test_round_trip_of_random_rows(spark):
    rng = random.Random(7)
    alphabet = 'ab"\\\n\t,{}[]é€😀/ '
    rows = [
        (i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(12))), rng.uniform(-1e9, 1e9)) for i in range(500)
    ]
    df = spark.createDataFrame(rows, "id bigint, s string, d double")
    wrapped = wrap_rows(df, "thing", 7, F.col("id"))
    assert wrapped.count() == -(-500 // 7)
    back = split_envelopes(wrapped).select(
        *[F.variant_get("data", f"$.{n}", t).alias(n) for n, t in (("id", "bigint"), ("s", "string"), ("d", "double"))]
    )
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_bodies_stay_small_without_a_sequence(spark):
    df = spark.range(1000).repartition(3)
    sizes = split_envelopes(wrap_rows(df, "thing", 10)).groupBy("batch_id").count()
    assert sizes.agg(F.max("count"), F.sum("count")).first() == (10, 1000)


def test_packing_keeps_order_and_large_numbers_apart(spark):
    base = 2**53
    rows = [(base + i, json.dumps({"t": {"i": i}})) for i in range(20)]
    packed = pack_bodies(spark.createDataFrame(rows, "seq bigint, envelope string"), 1).collect()
    assert sorted(r.batch_id for r in packed) == [base + i for i in range(20)]


@pytest.mark.parametrize("text", ['[{"a":{"x":1}},{"b":"no"}]'])
def test_carried_columns(spark, text):
    df = bodies(spark, text).withColumn("ingest_time", F.lit("t"))
    assert [r.ingest_time for r in split_envelopes(df).collect()] == ["t", "t"]
    assert split(spark, text)[0] == ITEM


def deep(n):
    return "[" * n + "]" * n


def test_odd_values_leave_their_neighbours_alone(spark):
    good = '{"querytest":{"label":"x","value":1}}'
    for odd in (f'"extra":{deep(900)}', f'"extra":{"1" * 1200}', f'"extra":"{"y" * (9 << 20)}"'):
        body = f'[{good},{{"querytest":{{"label":"x","value":2,{odd}}}}}]'
        result = telemill.ingest_batch(bodies(spark, body), [QUERY_TEST], "2024-06-01 10:00:00")
        assert sorted(r.value for r in result.accepted("querytest").collect()) == [1, 2]


def test_nesting_beyond_the_limit_rejects_the_item(spark):
    body = f'[{{"querytest":{{"label":"x","value":2,"extra":{deep(1500)}}}}}]'
    result = telemill.ingest_batch(bodies(spark, body), [QUERY_TEST], "2024-06-01 10:00:00")
    assert [r.code for r in result.checked.select(F.col("errors")[0]["code"].alias("code")).collect()] == ["item_data_parsing_failed"]


def nested(depth):
    return "[" * depth + "1" + "]" * depth


def test_only_the_item_that_is_too_deep_is_rejected(spark):
    deep, fine, number = nested(1500), nested(900), "1" * 1200
    body = (
        f'[{{"a":{{"x":{fine}}}}}, {{"b" : {{"x":{deep}}} }}, null, {{"c":{{"s":"}}], {{\\"q\\": [1}}","n":{number}}}}}, '
        f'{{"d":"{{\\"x\\":1}}"}}, {{"e":{{}},"f":{deep}}}, {{"g":null}}] \n'
    )
    rows = sorted(split_envelopes(bodies(spark, body)).collect(), key=lambda r: r.pos)
    assert [(r.pos, r.kind, r.type_name, r.code) for r in rows] == [
        (0, "item", "a", None),
        (1, "split_error", None, "item_data_parsing_failed"),
        (2, "split_error", None, "invalid_item_structure"),
        (3, "item", "c", None),
        (4, "split_error", None, "item_data_parsing_failed"),
        (5, "split_error", None, "invalid_item_structure"),
        (6, "item", "g", None),
    ]
    assert rows[1].value.startswith('{"x":[[[[') and rows[5].value.startswith('{"e":{},"f":[[')
    short = split_envelopes(bodies(spark, body.replace(deep, "[1]"))).collect()
    by_place = {r.pos: (r.kind, r.type_name, r.code, r.value) for r in short}
    assert all(by_place[r.pos] == (r.kind, r.type_name, r.code, r.value) for r in rows if r.pos not in (1, 5))


def test_deep_bodies_that_are_not_arrays_of_objects(spark):
    deep = nested(1200)
    texts = [f'[{{"a":{{}}}}, {deep}]', f'[{{"a":{{"x":{deep}}}}}, "b"]', f'[{{"a":{deep}}}] x', f'{{"a":{deep}}}', f'[{{"a":{deep}}}', f"[{deep}]"]
    for text in texts:
        row = split_envelopes(bodies(spark, text)).collect()
        assert [(r.kind, r.code) for r in row] == [("body_error", "invalid_json_array")], text[:40]
