"""The seven type checks, each compiled to plain column expressions.

``field`` is always the VARIANT found under a column's name: SQL NULL when the
key is absent, a VARIANT null when the item says ``null``.
"""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from telemill.definitions import KINDS, Column
from telemill.functions.errors import ERROR_TYPE, error, render_value
from telemill.functions.strict_json import is_number, is_strict_json, kind_of_value
from telemill.functions.timespan import format_timespan, is_timespan, parse_timespan

# One or two hour digits; any number of fraction digits after a dot or comma.
_DATETIME = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?\z"
_LONG_EDGE = float(2**63)
_EXACT_EDGE = float(2**53)


def parse_datetime(text: SparkColumn) -> SparkColumn:
    """TIMESTAMP_NTZ of a datetime text (microseconds), else NULL."""
    return F.when(text.rlike(_DATETIME), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp_ntz"))


def format_datetime(value: SparkColumn) -> SparkColumn:
    """``yyyy-MM-dd HH:mm:ss.SSS``; six digits only where they are needed."""
    micros = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.when(F.endswith(micros, F.lit("000")), F.left(micros, F.lit(23))).otherwise(micros)


def _text(field: SparkColumn) -> SparkColumn:
    return F.try_variant_get(field, "$", "string")


def _as_double(field: SparkColumn) -> SparkColumn:
    return F.try_variant_get(field, "$", "double")


def _integral(field: SparkColumn) -> SparkColumn:
    """BIGINT of a number without fraction, else NULL.

    64-bit integers keep every digit. A number written with a point or an
    exponent counts as integral if its double value is.
    """
    as_double, as_long = _as_double(field), F.try_variant_get(field, "$", "bigint")
    in_range = (as_double == F.floor(as_double)) & (as_double >= -_LONG_EDGE) & (as_double < _LONG_EDGE)
    return F.when(kind_of_value(field) == "BIGINT", as_long).when(
        in_range, F.when(F.abs(as_double) < _EXACT_EDGE, as_double.try_cast("bigint")).otherwise(as_long)
    )


def present_value(kind: str, field: SparkColumn) -> SparkColumn:
    """Typed value of a field that has passed ``present_error``."""
    if kind == "datetime":
        return parse_datetime(_text(field))
    if kind == "timespan":
        return parse_timespan(_text(field))
    if kind == "int":
        return _integral(field)
    return F.try_variant_get(field, "$", KINDS[kind].simpleString())


def present_error(kind: str, name: str | SparkColumn, field: SparkColumn) -> SparkColumn:
    """Error struct of a field that is present, NULL if it is right."""
    name_col = F.lit(name)
    wrong_type = error("invalid_field_type", name_col, render_value(field))
    none = F.lit(None).cast(ERROR_TYPE)
    kind_now = kind_of_value(field)
    if kind == "bool":
        return F.when(kind_now != "BOOLEAN", wrong_type)
    if kind == "real":
        finite = kind_now.startswith("DECIMAL") | (kind_now == "BIGINT")
        too_large = F.abs(_as_double(field)) == float("inf")
        return F.when(finite, none).when(~is_number(field) | too_large, wrong_type)
    if kind == "int":
        fraction = error("invalid_field_type", name_col, F.format_string("%f", _as_double(field)))
        return (
            F.when(kind_now == "BIGINT", none)
            .when(~is_number(field), wrong_type)
            .when(_integral(field).isNull(), fraction)
        )
    text = _text(field)
    if kind == "string":
        return F.when(kind_now != "STRING", wrong_type)
    if kind == "datetime":
        bad, code = parse_datetime(text).isNull(), "invalid_datetime"
    elif kind == "timespan":
        bad, code = ~F.coalesce(is_timespan(text), F.lit(False)), "invalid_timespan"
    else:
        bad, code = ~F.coalesce(is_strict_json(text), F.lit(False)), "invalid_json"
    return F.when(kind_now != "STRING", wrong_type).when(bad, error(code, name_col, text)).otherwise(none)


def default_value(column: Column) -> SparkColumn:
    """Typed literal of a default, NULL without one."""
    if column.default is None:
        return F.lit(None).cast(KINDS[column.kind])
    if column.kind == "datetime":
        return parse_datetime(F.lit(column.default))
    if column.kind == "timespan":
        return parse_timespan(F.lit(column.default))
    return F.lit(column.default).cast(KINDS[column.kind])


def field_error(column: Column, field: SparkColumn) -> SparkColumn:
    """Error struct of one declared column, NULL if its field is acceptable."""
    checked = present_error(column.kind, column.name, field)
    if column.optional or column.default is not None:
        return F.when(field.isNotNull(), checked)
    return F.when(field.isNull(), missing_error(column.name)).otherwise(checked)


def missing_error(name: str | SparkColumn) -> SparkColumn:
    return error("missing_required_field", F.lit(name), F.lit("missing"))


def field_value(column: Column, field: SparkColumn) -> SparkColumn:
    """Typed value of one declared column of an accepted item.

    A default stands in for an absent required field; an absent optional field
    is NULL even where a default is declared.
    """
    value = present_value(column.kind, field)
    if column.optional or column.default is None:
        return value
    return F.when(field.isNull(), default_value(column)).otherwise(value)


def value_from_text(kind: str, text: SparkColumn) -> SparkColumn:
    """Typed value of a stored text cell; empty is NULL."""
    if kind == "datetime":
        return parse_datetime(text)
    if kind == "timespan":
        return parse_timespan(text)
    return text.try_cast(KINDS[kind])


def value_to_text(kind: str | None, value: SparkColumn) -> SparkColumn:
    """Text cell of a typed value."""
    if kind == "datetime":
        return format_datetime(value)
    if kind == "timespan":
        return format_timespan(value)
    return value.cast("string")
