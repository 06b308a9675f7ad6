"""Reject reasons: codes, their texts, and how a message reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR_TYPE = "struct<code:string,field:string,value:string>"

# Reason code -> text.
REASONS = {
    "invalid_json_array": "input is not a valid JSON array",
    "invalid_item_structure": "item does not have exactly one key",
    "item_data_parsing_failed": "item data cannot be parsed as JSON object",
    "item_type_not_defined": "item type not defined",
    "missing_required_field": "missing required field",
    "invalid_field_type": "invalid field type",
    "invalid_json": "invalid JSON format",
    "invalid_datetime": "invalid datetime format",
    "invalid_timespan": "invalid timespan format",
}


def error(code: str, field: Column | None = None, value: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(code).alias("code"),
        (none if field is None else field).alias("field"),
        (none if value is None else value).alias("value"),
    )


def clip(text: Column, limit: int = 50) -> Column:
    """Texts over ``limit`` bytes are cut and end in three dots."""
    head = F.substring(text.cast("binary"), 1, limit - 3).cast("string")
    return F.when(F.octet_length(text) > limit, F.concat(F.make_valid_utf8(head), F.lit("..."))).otherwise(text)


def render_value(value: Column) -> Column:
    """How a rejected VARIANT reads in a message."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "VOID", F.lit("<nil>"))
        .when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        .otherwise(F.to_json(value))
    )


def render_error(err: Column, type_name: Column, pos: Column) -> Column:
    """Message of one error struct."""
    code = err["code"]
    reasons = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    split = code.isin("invalid_json_array", "invalid_item_structure", "item_data_parsing_failed")
    operation = (
        F.when(split, F.lit("split"))
        .when(code == "item_type_not_defined", F.lit("convert"))
        .otherwise(F.lit("validate_field"))
    )
    item_type = F.when(split, F.concat(F.lit("item_"), pos.cast("string"))).otherwise(type_name)
    given = (
        F.when(split, err["value"])
        .when(code == "item_type_not_defined", F.concat(F.lit("item type: "), type_name))
        .otherwise(F.concat(F.lit("field:"), err["field"], F.lit(" value:"), err["value"]))
    )
    return F.format_string(
        "ingest %s failed for item type '%s' with input '%s': %s", operation, item_type, clip(given), reasons[code]
    )
