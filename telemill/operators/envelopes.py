"""Envelopes: ``[{"typeName": {fields}}, ...]`` bodies to items and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.definitions import kind_of
from telemill.functions.errors import clip
from telemill.functions.strict_json import (
    ends_with_marker,
    is_array_of_objects,
    is_empty_array,
    is_object,
    marked_array,
    object_fields,
    only_value,
    parse_strict,
    raw_elements,
)
from telemill.functions.timespan import format_timespan
from telemill.session import floor_div, quoted, settle

ITEM, SPLIT_ERROR, BODY_ERROR, EMPTY_BODY = "item", "split_error", "body_error", "empty_body"


def split_envelopes(bodies: DataFrame) -> DataFrame:
    """One row per array element, and one for a body that yields none.

    In: ``body`` plus any other columns (``batch_id``, ``ingest_time``), which
    are carried along. Out: those columns and

    * ``pos``: index in the array, -1 for a body-level row
    * ``kind``: ``item``, ``split_error``, ``body_error`` or ``empty_body``
    * ``type_name``, ``data`` (VARIANT): of an item
    * ``code``, ``value``: of an error

    Each body is parsed once; the step is narrow (no shuffle). Only a body that is right but cannot be parsed as a whole is
    cut up first, so that a value nested too deep (over 1,000 levels) is an error of its own item and not of its neighbours.
    """
    carried = [quoted(c) for c in bodies.columns if c != "body"]
    body = F.coalesce(F.col("body"), F.lit(""))

    whole = bodies.select(*carried, F.col("body"), marked_array(body).alias("__marked"))
    complete = F.coalesce(ends_with_marker(F.col("__marked")), F.lit(False))
    parsed = whole.select(*carried, F.col("body"), F.col("__marked"), complete.alias("__complete"))
    too_deep = ~F.col("__complete") & ~F.coalesce(is_empty_array(body), F.lit(False)) & is_array_of_objects(body)
    parsed = parsed.select("*", F.when(too_deep, raw_elements(body)).alias("__apart"))
    elements = F.slice(F.col("__marked"), F.lit(1), F.size("__marked") - 1)
    # One element that is neither an object nor null spoils the whole body.
    all_items = F.forall(elements, lambda e: F.is_variant_null(e) | is_object(e))
    usable_body = F.when(F.col("__complete"), F.coalesce(all_items, F.lit(False))).otherwise(F.col("__apart").isNotNull())
    fault = F.when(~usable_body, F.when(is_empty_array(body), F.lit(EMPTY_BODY)).otherwise(F.lit(BODY_ERROR)))
    faulted = parsed.select("*", fault.alias("__fault"))
    each = F.transform("__apart", parse_strict)
    judged = faulted.select(
        *carried,
        F.col("__fault"),
        F.col("__apart"),
        F.when(F.col("__fault").isNull(), F.when(F.col("__complete"), elements).otherwise(each)).alias("__elements"),
        F.when(F.col("__fault") == BODY_ERROR, clip(body)).alias("__head"),
    )
    rows = judged.select(
        *carried, "__fault", "__head", "__apart", F.posexplode_outer("__elements").alias("__pos", "__element")
    )
    # An element that could be told apart, but not be parsed.
    raw = F.when(F.col("__element").isNull(), F.get("__apart", F.col("__pos")))
    rows = rows.withColumn("__raw", raw).withColumn("__envelope", object_fields(F.col("__element")))

    one_key = F.coalesce(F.size("__envelope") == 1, F.lit(False))
    type_name = F.get(F.map_keys("__envelope"), F.lit(0))
    data = F.get(F.map_values("__envelope"), F.lit(0))
    keyed = rows.select(
        *carried,
        F.coalesce("__pos", F.lit(-1)).alias("pos"),
        "__fault",
        "__head",
        "__element",
        "__raw",
        F.when(F.col("__fault").isNull() & one_key, type_name).alias("__type"),
        F.when(one_key, data).alias("__data"),
    )
    usable = F.is_variant_null(F.col("__data")) | is_object(F.col("__data"))
    kind = (
        F.when(F.col("__fault").isNotNull(), F.col("__fault"))
        .when(F.col("__type").isNotNull() & usable, F.lit(ITEM))
        .otherwise(F.lit(SPLIT_ERROR))
    )
    one_raw = F.col("__raw").isNotNull() & (F.size(raw_elements(F.col("__raw"))) == 1)
    code = (
        F.when(F.col("__fault") == BODY_ERROR, F.lit("invalid_json_array"))
        .when(one_raw, F.lit("item_data_parsing_failed"))
        .when(F.col("__fault").isNull() & F.col("__type").isNull(), F.lit("invalid_item_structure"))
        .when(F.col("__fault").isNull() & ~usable, F.lit("item_data_parsing_failed"))
    )
    value = F.coalesce(
        F.col("__head"),
        F.when(one_raw, only_value(F.col("__raw"))).otherwise(F.col("__raw")),
        F.when(F.col("__fault").isNull() & F.col("__type").isNull(), F.to_json("__element")).when(
            F.col("__fault").isNull() & ~usable, F.to_json("__data")
        ),
    )
    is_item = F.col("__fault").isNull() & F.col("__type").isNotNull() & usable
    return settle(
        keyed,
        [*carried, F.col("pos")],
        {
            "kind": kind,
            "type_name": F.when(is_item, F.col("__type")),
            "data": F.when(is_item, F.col("__data")),
            "code": code,
            "value": clip(value),
        },
    )


def item_json(df: DataFrame) -> Column:
    """JSON object of a row's columns; NULL columns are left out."""
    fields = []
    for f in df.schema.fields:
        col = quoted(f.name)
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind_of(f) == "timespan":
            col = format_timespan(col)
        fields.append(col.alias(f.name))
    return F.struct(*fields)


def envelopes(df: DataFrame, type_name: str, seq: Column | None = None) -> DataFrame:
    """Rows of any table as ``(seq, envelope)`` with one JSON envelope each.

    ``seq`` numbers the rows (unique, not negative). Without it the rows are
    numbered per partition, which needs no shuffle.
    """
    number = F.monotonically_increasing_id() if seq is None else seq
    return df.select(
        number.cast("bigint").alias("seq"), F.to_json(F.create_map(F.lit(type_name), item_json(df))).alias("envelope")
    )


def pack_bodies(items: DataFrame, batch_size: int) -> DataFrame:
    """``(seq, envelope)`` rows to ``(batch_id, body)`` arrays of ``batch_size``.

    As ``seq`` is unique, no group holds more than ``batch_size`` envelopes.
    """
    entry = F.struct(F.col("seq"), F.col("envelope"))
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["envelope"])
    return (
        items.groupBy(floor_div(F.col("seq"), F.lit(batch_size).cast("bigint")).alias("batch_id"))
        .agg(ordered.alias("__items"))
        .select("batch_id", F.concat(F.lit("["), F.array_join("__items", ","), F.lit("]")).alias("body"))
    )


def wrap_rows(df: DataFrame, type_name: str, batch_size: int, seq: Column | None = None) -> DataFrame:
    """Inverse of splitting: any table to bodies of ``batch_size`` envelopes."""
    return pack_bodies(envelopes(df, type_name, seq), batch_size)
