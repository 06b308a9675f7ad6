"""Telemetry made from the given tables, with faults laid out by row number.

``events`` becomes items of type ``user-event``; what is wrong with an item
follows from ``event_id % 20``, so plain SQL over ``events`` can say what each
step must produce.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.definitions import Column as Field
from telemill.definitions import ItemDefinition
from telemill.operators.envelopes import pack_bodies

BATCH_SIZE = 50
START = "2024-06-01 00:00:00"

USER_EVENT = ItemDefinition(
    "user-event",
    (
        Field("event_id", "int"),
        Field("ts", "datetime"),
        Field("user_id", "int"),
        Field("event_type", "string", "unknown"),
        Field("value", "real"),
        Field("props", "dynamic", optional=True),
        Field("dur", "timespan", optional=True),
    ),
    folder="usage",
    latency_minutes=2,
)
ORDER = ItemDefinition(
    "order-placed",
    (
        Field("o_orderkey", "int"),
        Field("o_custkey", "int"),
        Field("o_orderstatus", "string"),
        Field("o_totalprice", "real"),
        Field("o_orderdate", "datetime"),
        Field("open", "bool", False),
    ),
    folder="sales",
    latency_minutes=0,
)
CUSTOMER = ItemDefinition(
    "customer-seen",
    (Field("c_custkey", "int"), Field("c_name", "string"), Field("c_acctbal", "real")),
    folder="sales",
    latency_minutes=10,
)
DOCUMENT = ItemDefinition(
    "document",
    (
        Field("doc_id", "int"),
        Field("text", "string"),
        Field("lang", "string", optional=True),
        Field("source", "string", optional=True),
        Field("n_chars", "int"),
    ),
    latency_minutes=60,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ingest_time_of(batch_id: Column) -> Column:
    """Each batch has its own second."""
    return F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=batch_id.cast("decimal(18,6)"))


def with_ingest_time(bodies: DataFrame) -> DataFrame:
    return bodies.withColumn("ingest_time", ingest_time_of(F.col("batch_id")))


def _text_member(name: str, value: Column) -> Column:
    escaped = F.to_json(F.array(value))
    return F.concat(F.lit(f'"{name}":'), F.substring(escaped, F.lit(2), F.char_length(escaped) - 2))


def faulty_events(events: DataFrame) -> DataFrame:
    """``(seq, envelope)`` rows of ``user-event`` items, most with a fault."""
    m = F.col("event_id") % 20
    when_ = lambda cases, value: F.when(m.isin(*cases), value)
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    dur = F.concat((F.col("event_id") % 90).cast("string"), F.lit("m"))
    members = F.concat_ws(
        ",",
        F.concat(F.lit('"event_id":'), F.col("event_id").cast("string")),
        _text_member("ts", when_([4], F.lit("not-a-date")).otherwise(ts)),
        F.when(~m.isin(1, 8), F.concat(F.lit('"user_id":'), F.col("user_id").cast("string"), F.when(m == 13, ".5").otherwise(""))),
        F.when(m != 5, _text_member("event_type", F.col("event_type"))),
        F.when(m.isin(2, 8), F.concat(F.lit('"value":"'), F.col("value").cast("string"), F.lit('"'))).otherwise(
            F.concat(F.lit('"value":'), F.col("value").cast("string"))
        ),
        F.when(m == 7, F.lit('"props":null'))
        .when(m == 3, F.lit('"props":"{bad"'))
        .when(m != 6, _text_member("props", F.col("props"))),
        F.when(m == 12, F.lit('"dur":"2days"')).when(m != 6, _text_member("dur", dur)),
        F.when(m == 11, F.lit('"zzz":1')),
    )
    item = F.concat(F.lit("{"), members, F.lit("}"))
    envelope = (
        F.when(m == 0, F.concat(F.lit('{"ghost-event":'), item, F.lit("}")))
        .when(m == 9, F.concat(F.lit('{"user-event":'), item, F.lit(',"other":{}}')))
        .when(m == 10, F.lit('{"user-event":"not-an-object"}'))
        .otherwise(F.concat(F.lit('{"user-event":'), item, F.lit("}")))
    )
    return events.select(F.col("event_id").alias("seq"), envelope.alias("envelope"))


def event_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(batch_id, body, ingest_time)`` of all events."""
    return with_ingest_time(pack_bodies(faulty_events(table(spark, sf_dir, "events")), BATCH_SIZE))


# --- broken bodies -----------------------------------------------------------


def malformed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One body per order; ``o_orderkey % 16`` says what is wrong with it."""
    key = F.col("o_orderkey").cast("string")
    item = F.concat(
        F.lit('{"order-placed":{"o_orderkey":'), key,
        F.lit(',"o_custkey":1,"o_orderstatus":"O","o_totalprice":2.5,"o_orderdate":"2024-01-01 00:00:00"}}'),
    )
    cases = [
        F.concat(F.lit("["), item, F.lit("]")),
        F.lit("this is not json"),
        F.lit('{"not":"an array"}'),
        F.lit("[]"),
        F.lit("null"),
        F.lit("[1]"),
        F.lit("[null]"),
        F.concat(F.lit("["), item, F.lit("] x")),
        F.concat(F.lit("["), item, F.lit("] [1]")),
        F.lit('[{"order-placed":null}]'),
        F.lit('[{"order-placed":"x"},{"order-placed":[]}]'),
        F.lit("[{'order-placed':{}}]"),
        F.lit("  [ ]\t"),
        F.concat(F.lit(" [ "), item, F.lit(" ,\r\n"), item, F.lit("] ")),
        F.concat(F.lit("["), item, F.lit(',{"ghost":{}}]')),
        F.lit(""),
    ]
    body = F.get(F.array(*cases), F.pmod("o_orderkey", F.lit(16)).cast("int"))
    orders = table(spark, sf_dir, "orders")
    return with_ingest_time(orders.select(F.col("o_orderkey").alias("batch_id"), body.alias("body")))


# --- every literal against every type ------------------------------------------

# A JSON literal and the column types that accept it.
LITERALS = [
    ("true", "bool"),
    ("false", "bool"),
    ("1", "int real"),
    ("1.0", "int real"),
    ("1e3", "int real"),
    ("1.5", "real"),
    ("-7", "int real"),
    ("12345678901234567890", "real"),
    ("9223372036854775807", "int real"),
    ("null", ""),
    ("{}", ""),
    ("[]", ""),
    ('{"a":1}', ""),
    ('""', "string"),
    ('"5"', "string dynamic"),
    ('"true"', "string dynamic"),
    ('"2024-01-01 00:00:00"', "string datetime"),
    ('"2024-01-01 1:02:03,5"', "string datetime"),
    ('"2024-01-01 00:00:00.123456789"', "string datetime"),
    ('"2024-02-29 23:59:59"', "string datetime"),
    ('"2023-02-29 00:00:00"', "string"),
    ('"2024-02-30 00:00:00"', "string"),
    ('"2024-01-01"', "string"),
    ('"2024-01-01T00:00:00"', "string"),
    ('"2024-01-01 24:00:00"', "string"),
    ('"2024-01-01 00:00:60"', "string"),
    ('"2024-01-01 00:00:00 "', "string"),
    ('"2024-01-01 00:00:00\\n"', "string"),
    ('"1h30m"', "string timespan"),
    ('"7d"', "string timespan"),
    ('"1.5d"', "string timespan"),
    ('"1d12h30m"', "string timespan"),
    ('"2days"', "string"),
    ('"-1h"', "string timespan"),
    ('"1d-2h"', "string timespan"),
    ('"1d+5m"', "string timespan"),
    ('"+5m"', "string timespan"),
    ('"-1d"', "string"),
    ('"0"', "string timespan dynamic"),
    ('".5h"', "string timespan"),
    ('"1.h"', "string timespan"),
    ('"100us"', "string timespan"),
    ('"1µs"', "string timespan"),
    ('"1h 30m"', "string"),
    ('"1H"', "string"),
    ('"d"', "string"),
    ('".d"', "string"),
    ('"1d1"', "string"),
    ('"1h-5m"', "string"),
    ('"5m\\n"', "string"),
    ('"{\\"a\\":1}"', "string dynamic"),
    ('"{\\"a\\":1,\\"a\\":2}"', "string dynamic"),
    ('"  {} "', "string dynamic"),
    ('"null"', "string dynamic"),
    ('"\\"x\\""', "string dynamic"),
    ('"{bad}"', "string"),
    ('"[1] 2"', "string"),
    ('"1],[2"', "string"),
    ('"[1,]"', "string"),
    ('"{\'a\':1}"', "string"),
    ('"NaN"', "string"),
    ('"01"', "string"),
]
CHECKED_KINDS = ["bool", "datetime", "dynamic", "int", "real", "string", "timespan"]
PROBES = [ItemDefinition(f"probe-{kind}", (Field("no", "int"), Field("v", kind))) for kind in CHECKED_KINDS]


def literal_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per line item: a literal offered to a column of some type."""
    no = F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(len(LITERALS)))
    kind = F.get(F.array(*[F.lit(k) for k in CHECKED_KINDS]), F.pmod("l_partkey", F.lit(len(CHECKED_KINDS))).cast("int"))
    literal = F.get(F.array(*[F.lit(text) for text, _ in LITERALS]), no.cast("int"))
    envelope = F.concat(
        F.lit('{"probe-'), kind, F.lit('":{"no":'), no.cast("string"), F.lit(',"v":'), literal, F.lit("}}")
    )
    lines = table(spark, sf_dir, "lineitem")
    return pack_bodies(lines.select(F.monotonically_increasing_id().alias("seq"), envelope.alias("envelope")), 200)


# --- definitions made from parts -----------------------------------------------------

_GOOD_COLUMNS = (
    '[{"name":"size","type":"int"},{"name":"price","type":"real","defaultValue":1.5},'
    '{"name":"seen","type":"datetime","optional":true}]'
)


def definition_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, definition)``, one per part; ``p_partkey % 24`` picks the fault."""
    name = F.concat(F.lit('"name":"part-'), F.col("p_partkey").cast("string"), F.lit('"'))
    columns = F.lit(f'"orderedColumns":{_GOOD_COLUMNS}')

    def text(*members: Column) -> Column:
        return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))

    def with_columns(columns_json: str) -> Column:
        return text(name, F.lit(f'"orderedColumns":{columns_json}'))

    latency = F.concat(F.lit('"latencyMinutes":'), F.col("p_size").cast("string"))
    folder = F.concat(F.lit('"folder":"'), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit('"'))
    cases = [
        text(name, _text_member("documentation", F.col("p_name")), folder, latency, columns),
        text(columns),
        text(F.lit('"name":"ingest_time"'), columns),
        text(F.lit('"name":"Part-1"'), columns),
        text(F.lit('"name":"pa"'), columns),
        text(name, F.lit('"documentation":5'), columns),
        text(name, F.lit('"folder":"ab"'), columns),
        text(name, F.lit('"folder":7'), columns),
        text(name, F.lit('"latencyMinutes":1.5'), columns),
        text(name, F.lit('"latencyMinutes":-1'), columns),
        text(name, F.lit('"latencyMinutes":"x"'), columns),
        text(name),
        with_columns("[]"),
        with_columns('[{"type":"int"}]'),
        with_columns('[{"name":"ingest_time","type":"datetime"}]'),
        with_columns('[{"name":"a","type":"int"},{"name":"b"}]'),
        with_columns('[{"name":"a","type":"blob"}]'),
        with_columns('[{"name":"a","type":"bool","defaultValue":"x"}]'),
        with_columns('[{"name":"a","type":"int","defaultValue":1.5}]'),
        with_columns('[{"name":"a","type":"int"},{"name":"a","type":"real"},{"name":"b","type":"blob"}]'),
        F.lit("{bad"),
        with_columns('[{"name":"a","type":"int","optional":"yes"}]'),
        with_columns('[{"name":"v","type":"timespan","defaultValue":"1d2h"}]'),
        with_columns('[{"name":"a","type":"dynamic","defaultValue":"[1]"}]'),
    ]
    chosen = F.get(F.array(*cases), F.pmod("p_partkey", F.lit(24)).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), chosen.alias("definition"))


def repeated_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid definitions of few names; a third of them share one name."""
    key = F.col("p_partkey")
    name = F.when(key % 3 == 0, F.lit("brand-hot")).otherwise(F.concat(F.lit("brand-"), (key % 50).cast("string")))
    text = F.concat(F.lit('{"name":"'), name, F.lit(f'","orderedColumns":{_GOOD_COLUMNS}}}'))
    return table(spark, sf_dir, "part").select(key.alias("seq"), text.alias("definition"))


def declared_and_stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Declared types and schema files that agree with them, or do not, by ``p_partkey % 6``."""
    key = F.col("p_partkey")
    type_name = F.concat(F.lit("part-"), key.cast("string"))
    columns = "array<struct<name:string,type:string>>"

    def listed(*pairs: tuple[str, str]) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in pairs]).cast(columns)

    declared = table(spark, sf_dir, "part").select(
        type_name.alias("type_name"),
        listed(("size", "int"), ("price", "real"), ("seen", "datetime")).alias("columns"),
    )
    time = ("ingest_time", "datetime")
    stored_columns = (
        F.when(key % 6 == 1, listed(time, ("size", "int"), ("price", "real")))
        .when(key % 6 == 2, listed(time, ("size", "int"), ("cost", "real"), ("seen", "datetime")))
        .when(key % 6 == 3, listed(time, ("size", "int"), ("price", "real"), ("seen", "string")))
        .otherwise(listed(time, ("size", "int"), ("price", "real"), ("seen", "datetime")))
    )
    text = F.to_json(F.struct(type_name.alias("name"), stored_columns.alias("orderedColumns")))
    stored = (
        table(spark, sf_dir, "part")
        .where(key % 6 != 5)
        .select(type_name.alias("declared_as"), F.when(key % 6 == 4, F.lit("{bad")).otherwise(text).alias("sidecar"))
    )
    return declared, stored


def sidecar_root(spark: SparkSession, sf_dir: str, faulty: bool) -> str:
    """A root with one schema file per supplier, the suppliers of a nation in one folder."""
    from telemill.session import scratch_dir

    root = scratch_dir(spark, "sidecars")
    key = F.col("s_suppkey")
    columns = "array<struct<name:string,type:string>>"
    good = F.array(
        F.struct(F.lit("ingest_time").alias("name"), F.lit("datetime").alias("type")),
        F.struct(F.lit("acctbal").alias("name"), F.lit("real").alias("type")),
    ).cast(columns)
    name = F.concat(F.lit("supplier-"), key.cast("string"))
    stored = good
    if faulty:
        name = F.when(key % 5 == 1, F.lit("")).otherwise(name)
        odd = F.array(F.struct(F.lit("x").alias("name"), F.lit("blob").alias("type"))).cast(columns)
        stored = F.when(key % 5 == 2, F.array().cast(columns)).when(key % 5 == 3, odd).otherwise(good)
    files = table(spark, sf_dir, "supplier").select(
        name.alias("name"),
        stored.alias("orderedColumns"),
        F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("bucket"),
    )
    # One task would write all of a small table's files one after another.
    files = files.repartition(4 * spark.sparkContext.defaultParallelism)
    files.write.option("maxRecordsPerFile", 1).partitionBy("bucket").json(root)
    return root


# --- very many types ---------------------------------------------------------------

MANY_TYPES, MANY_COLUMNS = 200, 8


def _kind_number(n, i: int):
    """Which kind the i-th column of type n has; works for numbers and for columns of them."""
    power = 7 ** (i % 4)
    whole = F.floor(n / power) if isinstance(n, Column) else n // power
    return (whole + i) % 7


def many_types() -> list[ItemDefinition]:
    """Types with columns of their own names and of nearly as many sequences of kinds; the last column of odd types is optional."""
    return [
        ItemDefinition(
            f"part-{n}",
            tuple(
                Field(f"c{n}_{i}", CHECKED_KINDS[_kind_number(n, i)], optional=i == MANY_COLUMNS - 1 and n % 2 == 1)
                for i in range(MANY_COLUMNS)
            ),
            folder="parts",
        )
        for n in range(MANY_TYPES)
    ]


def many_type_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as an item of one of many types; of some the first value is wrong, or the last is missing."""
    parts = table(spark, sf_dir, "part")
    key, n = F.col("p_partkey"), F.col("p_partkey") % MANY_TYPES
    number = lambda c: c.cast("string")
    text = lambda *parts: F.concat(F.lit('"'), *parts, F.lit('"'))
    by_kind = {
        "bool": number(F.col("p_size") > 25),
        "datetime": text(F.lit("2024-06-01 10:00:"), F.lpad(number(key % 60), 2, "0")),
        "dynamic": text(F.lit(r"{\"size\":"), number(F.col("p_size")), F.lit("}")),
        "int": number(key),
        "real": number(F.col("p_retailprice")),
        "string": text(F.col("p_brand")),
        "timespan": text(number(F.col("p_size")), F.lit("m")),
    }
    values = F.array(*[by_kind[kind] for kind in CHECKED_KINDS])
    members = []
    for i in range(MANY_COLUMNS):
        value = F.get(values, _kind_number(n, i).cast("int"))
        if i == 0:
            value = F.when(key % 5 == 0, F.lit("[]")).otherwise(value)
        member = F.concat(F.lit('"c'), number(n), F.lit(f'_{i}":'), value)
        members.append(F.when(key % 7 != 0, member) if i == MANY_COLUMNS - 1 else member)
    envelope = F.concat(F.lit('{"part-'), number(n), F.lit('":{'), F.concat_ws(",", *members), F.lit("}}"))
    return with_ingest_time(pack_bodies(parts.select(key.cast("bigint").alias("seq"), envelope.alias("envelope")), BATCH_SIZE))


# --- deep and long values ------------------------------------------------------------


def deep_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as an item; by number some carry a value of depth 1,500 or 900, or a number of 1,200 digits."""
    customers, m = table(spark, sf_dir, "customer"), F.col("c_custkey") % 40
    nested = lambda depth: F.lit(',"extra":' + "[" * depth + "1" + "]" * depth)
    extra = F.when(m == 0, nested(1500)).when(m == 1, nested(900)).when(m == 2, F.lit(',"extra":' + "7" * 1200)).otherwise("")
    envelope = F.concat(
        F.lit('{"customer-seen":{"c_custkey":'), F.when(m == 3, F.lit("9" * 1200)).otherwise(F.col("c_custkey").cast("string")),
        F.lit(',"c_name":"'), F.col("c_name"), F.lit('","c_acctbal":'), F.col("c_acctbal").cast("string"), extra, F.lit("}}"),
    )
    rows = customers.select(F.col("c_custkey").cast("bigint").alias("seq"), envelope.alias("envelope"))
    return with_ingest_time(pack_bodies(rows, BATCH_SIZE))
