"""Routing and validation of split items against their definitions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.definitions import INGEST_TIME, ItemDefinition
from telemill.functions.checks import field_error, field_value, missing_error, present_error
from telemill.functions.errors import ERROR_TYPE, error, render_error
from telemill.functions.strict_json import object_fields
from telemill.operators.envelopes import ITEM
from telemill.session import quoted, settle

# Route of everything that belongs to no table. No type can have this name.
NO_ROUTE = "__none"


def route_by_type(type_name: Column, definitions: Iterable[ItemDefinition]) -> Column:
    """The item's own type if it is defined, else ``NO_ROUTE``.

    Names from clients are unbounded; routes are one per definition.
    """
    known = [d.name for d in definitions]
    if not known:
        return F.lit(NO_ROUTE)
    return F.when(type_name.isin(known), type_name).otherwise(F.lit(NO_ROUTE))


# A definition is compiled once per driver, not once per batch: putting the
# expressions together costs more than running a small micro-batch.


@lru_cache(maxsize=4096)
def _compiled_errors(definition: ItemDefinition, gateway: int) -> tuple[Column, ...]:
    return tuple(field_error(c, F.col("__fields")[c.name]).cast(ERROR_TYPE) for c in definition.columns)


@lru_cache(maxsize=4096)
def _compiled_values(definition: ItemDefinition, gateway: int) -> tuple[Column, ...]:
    stored = definition.stored_schema.fields[1:]
    return tuple(
        field_value(c, F.col("__fields")[c.name]).alias(f.name, metadata=f.metadata)
        for c, f in zip(definition.columns, stored)
    )


def _gateway() -> int:
    return id(SparkContext._gateway)


def check_items(items: DataFrame, definitions: Iterable[ItemDefinition]) -> DataFrame:
    """Add ``route`` and ``errors`` to split items, every error of every item.

    One narrow pass for all types: an item runs through the checks of its own
    type only. Rows without errors and with a route are accepted. A few types are compiled each by itself;
    of many, columns are checked by their place and kind, with names as data, so the plan does not grow with the number of types.
    """
    definitions = list(definitions)
    kept = [quoted(c) for c in items.columns if c not in ("code", "value")]
    positions = max((len(d.columns) for d in definitions), default=0)
    kinds = sorted({c.kind for d in definitions for c in d.columns})
    if sum(len(d.columns) for d in definitions) > positions * len(kinds):
        probed = _checked_by_kind(items, kept, definitions, positions, kinds)
    else:
        probed = _checked_by_type(items, kept, definitions, positions)

    nothing = F.array().cast(f"array<{ERROR_TYPE}>")
    undefined = F.array(error("item_type_not_defined").cast(ERROR_TYPE))
    split_error = F.array(
        F.struct(F.col("code"), F.lit(None).cast("string").alias("field"), F.col("value")).cast(ERROR_TYPE)
    )
    found = F.when(F.col("kind") != ITEM, F.when(F.col("code").isNotNull(), split_error).otherwise(nothing)).when(
        F.col("__type_no").isNull(), undefined
    )
    if positions:
        of_item = [F.col(f"__error_{at}") for at in range(positions)]
        # Most items are right: only those that are not get an array put together.
        found = found.when(F.coalesce(*of_item).isNotNull(), F.array_compact(F.array(*of_item)))
    return settle(
        probed,
        kept,
        {"route": route_by_type(F.col("type_name"), definitions), "errors": found.otherwise(nothing)},
    )


def _checked_by_type(
    items: DataFrame, kept: list[Column], definitions: list[ItemDefinition], positions: int
) -> DataFrame:
    """``__type_no``, and ``__error_<n>``: what is wrong with the n-th column of the item's own type.

    Each check runs once, and each compiles to a method of its own.
    """
    opened = _with_fields(items, [*kept, F.col("code"), F.col("value")], definitions)
    compiled = [_compiled_errors(d, _gateway()) for d in definitions]
    by_position = []
    for at in range(positions):
        branches = None
        for number, errors in enumerate(compiled):
            if at < len(errors):
                test = F.col("__type_no") == number
                branches = F.when(test, errors[at]) if branches is None else branches.when(test, errors[at])
        by_position.append(branches.alias(f"__error_{at}"))
    return opened.select(*kept, F.col("code"), F.col("value"), F.col("__type_no"), *by_position)


_TYPE_SCHEMA = "type_name string, __type_no int, __names array<string>, __kinds array<string>, __required array<boolean>"


def _checked_by_kind(
    items: DataFrame, kept: list[Column], definitions: list[ItemDefinition], positions: int, kinds: list[str]
) -> DataFrame:
    """The same for any number of types: an item is joined with its type's names and kinds, a small broadcast table."""
    rows = [
        (d.name, n, [c.name for c in d.columns], [c.kind for c in d.columns], [not c.optional and c.default is None for c in d.columns])
        for n, d in enumerate(definitions)
    ]
    types = F.broadcast(items.sparkSession.createDataFrame(rows, _TYPE_SCHEMA))
    typed = [F.col(c) for c in ("code", "value", "__type_no", "__names", "__kinds", "__required")]
    opened = settle(items.join(types, "type_name", "left"), [*kept, *typed], {"__fields": object_fields(F.col("data"))})
    fields = {f"__field_{at}": F.col("__fields")[F.get("__names", F.lit(at))] for at in range(positions)}
    spread = settle(opened, [*kept, *typed], fields)
    errors = []
    for at in range(positions):
        field, name, kind = F.col(f"__field_{at}"), F.get("__names", F.lit(at)), F.get("__kinds", F.lit(at))
        checked = F.when(field.isNull(), F.when(F.get("__required", F.lit(at)), missing_error(name).cast(ERROR_TYPE)))
        for k in kinds:
            checked = checked.when(kind == k, present_error(k, name, field).cast(ERROR_TYPE))
        errors.append(checked.alias(f"__error_{at}"))
    return spread.select(*kept, F.col("code"), F.col("value"), F.col("__type_no"), *errors)


def _with_fields(items: DataFrame, kept: list[Column], definitions: list[ItemDefinition] = ()) -> DataFrame:
    """Add ``__fields``, the members of an item by name, and the number of its type."""
    number = F.lit(None).cast("int")
    for at, d in enumerate(definitions):
        test = F.col("type_name") == d.name
        number = F.when(test, F.lit(at)) if at == 0 else number.when(test, F.lit(at))
    return settle(items, kept, {"__fields": object_fields(F.col("data")), "__type_no": number})


def is_accepted() -> Column:
    return (F.col("kind") == ITEM) & (F.size("errors") == 0)


def is_rejected() -> Column:
    return F.size("errors") > 0


def typed_rows(checked: DataFrame, definition: ItemDefinition, keep: Iterable[str] = ()) -> DataFrame:
    """Accepted items of one type as typed rows, ``ingest_time`` first."""
    own = (F.col("type_name") == definition.name) & (F.col("route") == definition.name)
    mine = checked.where(own & is_accepted())
    kept = [quoted(c) for c in keep]
    time_field = definition.stored_schema[INGEST_TIME]
    return _with_fields(mine, [*kept, F.col(INGEST_TIME)]).select(
        *kept,
        F.col(INGEST_TIME).cast("timestamp_ntz").alias(INGEST_TIME, metadata=time_field.metadata),
        *_compiled_values(definition, _gateway()),
    )


def rejected_rows(checked: DataFrame) -> DataFrame:
    """Quarantine rows: all reasons and messages of each rejected item.

    ``(batch_id, kind, pos)`` puts them in reporting order: errors of the split
    (``kind`` 0) before errors of items (``kind`` 1), both in input order.
    """
    message = F.transform(F.col("errors"), lambda e: render_error(e, F.col("type_name"), F.col("pos")))
    return checked.where(is_rejected()).select(
        "batch_id",
        INGEST_TIME,
        F.when(F.col("kind") == ITEM, F.lit(1)).otherwise(F.lit(0)).alias("kind"),
        "pos",
        "type_name",
        "errors",
        message.alias("messages"),
    )
