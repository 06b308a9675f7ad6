"""Definitions as data: verdicts, duplicates, schema files and schema drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.definitions import DEFAULT_LATENCY_MINUTES, INGEST_TIME, KINDS
from telemill.functions.checks import parse_datetime
from telemill.functions.strict_json import (
    is_number,
    is_object,
    kind_of_value,
    object_fields,
    parse_strict,
)
from telemill.functions.timespan import is_timespan
from telemill.session import quoted, settle

OK = "ok"

_COLUMNS_TYPE = "array<struct<name:string,type:string>>"


def is_file_name(text: Column) -> Column:
    """3 to 63 of a-z, 0-9 and single inner hyphens."""
    return text.rlike(r"\A[a-z0-9]+(?:-[a-z0-9]+)*\z") & F.length(text).between(3, 63)


def _string(value: Column) -> Column:
    """Text of a JSON string, NULL for anything else."""
    return F.when(kind_of_value(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _absent(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def _whole_number(value: Column) -> Column:
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce(is_number(value) & (number == F.floor(number)) & (F.abs(number) < 2.0**63), F.lit(False))


def _default_fits(kind: Column, value: Column) -> Column:
    text = _string(value)
    as_json = parse_strict(text)
    return F.coalesce(
        F.when(kind == "bool", kind_of_value(value) == "BOOLEAN")
        .when(kind == "int", _whole_number(value))
        .when(kind == "real", is_number(value))
        .when(kind == "string", text.isNotNull())
        .when(kind == "datetime", parse_datetime(text).isNotNull())
        .when(kind == "timespan", is_timespan(text))
        .when(kind == "dynamic", is_object(as_json) | F.is_variant_null(as_json)),
        F.lit(False),
    )


def _column_fault(entry: Column, index: Column, names: Column) -> Column:
    """First thing wrong with one column, in the order of its members."""
    name, kind = _string(entry["name"]), _string(entry["type"])
    default, optional = entry["defaultValue"], entry["optional"]
    return (
        F.when(name.isNull(), F.lit("invalid_column_name"))
        .when(name == INGEST_TIME, F.lit("reserved_name"))
        .when(kind.isNull(), F.lit("missing_column_type"))
        .when(~kind.isin(*KINDS), F.lit("unsupported_column_type"))
        .when(default.isNotNull() & ~_default_fits(kind, default), F.lit("inconsistent_default"))
        .when(~_absent(optional) & (kind_of_value(optional) != "BOOLEAN"), F.lit("inconsistent_default"))
        .when(F.array_position(names, name) <= index, F.lit("duplicate_column"))
    )


def lint_definitions(texts: DataFrame, text_col: str = "definition") -> DataFrame:
    """Add ``name``, ``folder``, ``latency_minutes``, ``columns`` and ``verdict``.

    ``verdict`` is ``ok`` or the code of the first fault. A definition is judged
    within its row; nothing is shuffled.
    """
    parsed = texts.withColumn("__json", parse_strict(F.coalesce(F.col(text_col), F.lit(""))))
    parsed = parsed.withColumn("__m", object_fields(F.col("__json")))
    m = F.col("__m")
    entries = F.transform(F.try_variant_get(m["orderedColumns"], "$", "array<variant>"), object_fields)
    opened = parsed.withColumn("__entries", entries)
    names = F.transform(F.col("__entries"), lambda e: _string(e["name"]))
    faults = F.transform(
        F.col("__entries"), lambda e, i: _column_fault(e, i, F.col("__names"))
    )
    judged = opened.withColumn("__names", names).withColumn("__faults", F.array_compact(faults))

    name, folder, latency = _string(m["name"]), m["folder"], m["latencyMinutes"]
    verdict = (
        F.when(F.col("__json").isNull() | (m.isNull() & ~F.is_variant_null(F.col("__json"))), F.lit("invalid_json"))
        .when(name.isNull(), F.lit("missing_name"))
        .when(name == INGEST_TIME, F.lit("reserved_name"))
        .when(~is_file_name(name), F.lit("invalid_file_name"))
        .when(~_absent(m["documentation"]) & _string(m["documentation"]).isNull(), F.lit("invalid_documentation"))
        .when(~_absent(folder) & ~F.coalesce(is_file_name(_string(folder)), F.lit(False)), F.lit("invalid_folder"))
        .when(~_absent(latency) & ~_whole_number(latency), F.lit("invalid_latency"))
        .when(F.try_variant_get(latency, "$", "double") < 0, F.lit("negative_latency"))
        .when(F.col("__entries").isNull(), F.lit("missing_columns"))
        .when(F.size("__entries") == 0, F.lit("empty_columns"))
        .otherwise(F.coalesce(F.get("__faults", F.lit(0)), F.lit(OK)))
    )
    columns = F.transform(
        F.col("__entries"), lambda e: F.struct(_string(e["name"]).alias("name"), _string(e["type"]).alias("type"))
    )
    kept = [quoted(c) for c in texts.columns]
    settled = settle(
        judged,
        kept,
        {
            "name": name,
            "folder": F.coalesce(_string(folder), name),
            "latency_minutes": F.when(_absent(latency), F.lit(DEFAULT_LATENCY_MINUTES).cast("bigint")).otherwise(
                F.try_variant_get(latency, "$", "bigint")
            ),
            "columns": columns,
            "verdict": verdict,
        },
    )
    good = F.col("verdict") == OK
    return settled.select(
        *kept,
        "name",
        *[F.when(good, F.col(c)).alias(c) for c in ("folder", "latency_minutes", "columns")],
        "verdict",
    )


def definition_columns(linted: DataFrame) -> DataFrame:
    """Columns of the accepted definitions, one row each."""
    return linted.where(F.col("verdict") == OK).select(
        F.col("name").alias("type_name"), F.posexplode("columns").alias("pos", "column")
    ).select("type_name", "pos", F.col("column.name").alias("name"), F.col("column.type").alias("type"))


def dedupe_definitions(linted: DataFrame, seq_col: str = "seq") -> DataFrame:
    """The first accepted definition of a name stays, later ones are marked.

    The first ``seq`` per name comes from a grouped minimum. Joining it back on
    name *and* seq spreads the rows of an often repeated name over all tasks.
    """
    firsts = (
        linted.where(F.col("verdict") == OK)
        .groupBy("name")
        .agg(F.min(seq_col).alias(seq_col))
        .withColumn("__first", F.lit(True))
    )
    joined = linted.join(firsts, ["name", seq_col], "left")
    late = (F.col("verdict") == OK) & F.col("__first").isNull()
    return joined.withColumn(
        "verdict", F.when(late, F.lit("already_exists")).otherwise(F.col("verdict"))
    ).select(*linted.columns)


def sidecars(linted: DataFrame) -> DataFrame:
    """``(type_name, folder, sidecar)``: the schema file text of each definition."""
    stored = F.concat(
        F.array(F.struct(F.lit(INGEST_TIME).alias("name"), F.lit("datetime").alias("type"))), F.col("columns")
    )
    text = F.to_json(F.struct(F.col("name"), stored.alias("orderedColumns")))
    return linted.where(F.col("verdict") == OK).select(F.col("name").alias("type_name"), "folder", text.alias("sidecar"))


def read_sidecars(texts: DataFrame, text_col: str = "sidecar") -> DataFrame:
    """Add ``type_name``, ``columns`` (``ingest_time`` included) and ``problem``.

    ``problem`` is NULL for a valid schema file: an object with a name that is
    not empty, at least one column, and known column types only.
    """
    parsed = texts.withColumn("__json", parse_strict(F.col(text_col)))
    parsed = parsed.withColumn("__m", object_fields(F.col("__json")))
    entries = F.transform(F.try_variant_get(F.col("__m")["orderedColumns"], "$", "array<variant>"), object_fields)
    columns = F.transform(
        entries, lambda e: F.struct(_string(e["name"]).alias("name"), _string(e["type"]).alias("type"))
    ).cast(_COLUMNS_TYPE)
    opened = parsed.select(
        *texts.columns,
        "__m",
        _string(F.col("__m")["name"]).alias("type_name"),
        columns.alias("columns"),
    )
    known = F.forall(F.col("columns"), lambda c: F.coalesce(c["type"].isin(*KINDS), F.lit(False)))
    problem = (
        F.when(F.col("__m").isNull(), F.lit("invalid JSON"))
        .when(F.coalesce(F.col("type_name"), F.lit("")) == "", F.lit("empty name"))
        .when(F.coalesce(F.size("columns"), F.lit(0)) < 1, F.lit("no columns"))
        .when(~known, F.lit("unknown column type"))
    )
    kept = [quoted(c) for c in texts.columns]
    return settle(opened, [*kept, F.col("type_name"), F.col("columns")], {"problem": problem})


def detect_schema_drift(declared: DataFrame, stored: DataFrame) -> DataFrame:
    """``(type_name, verdict, detail)`` for each declared type.

    Both sides have one row per type with ``columns``; a stored row may have a
    ``problem`` instead. The count of columns is compared first, then names and
    types by position; the first difference is reported. A type that is not
    stored yet is fine.
    """
    on_disk = stored.select(
        "type_name",
        F.when(
            F.get("columns", F.lit(0))["name"] == INGEST_TIME, F.slice("columns", F.lit(2), F.size("columns"))
        ).otherwise(F.col("columns")).alias("__stored"),
        F.col("problem").alias("__problem"),
        F.lit(True).alias("__known"),
    )
    joined = declared.select("type_name", F.col("columns").alias("__declared")).join(on_disk, "type_name", "left")
    have, want = F.col("__stored"), F.col("__declared")
    differing = F.filter(
        F.transform(want, lambda c, i: F.struct((i + 1).alias("pos"), F.get(have, i).alias("have"), c.alias("want"))),
        lambda d: ~(d["have"].eqNullSafe(d["want"])),
    )
    first = F.get(differing, F.lit(0))

    def shown(c: Column) -> Column:
        return F.format_string('{"%s" "%s"}', c["name"], c["type"])

    unreadable = F.col("__problem").isin("invalid JSON")
    verdict = (
        F.when(F.col("__known").isNull(), F.lit(OK))
        .when(unreadable, F.lit("unreadable"))
        .when(F.coalesce(F.size(have), F.lit(0)) != F.size(want), F.lit("column_count"))
        .when(first.isNotNull(), F.lit("column_mismatch"))
        .otherwise(F.lit(OK))
    )
    # The wording of both messages.
    detail = (
        F.when(F.col("verdict") == "column_count", F.format_string(
            "column count mismatch: stored schema has %d user columns, definition has %d",
            F.coalesce(F.size(have), F.lit(0)), F.size(want)))
        .when(F.col("verdict") == "column_mismatch", F.format_string(
            "column[%d] mismatch: stored %s, definition %s", first["pos"], shown(first["have"]), shown(first["want"])))
        .when(F.col("verdict") == "unreadable", F.col("__problem"))
    )
    return joined.withColumn("verdict", verdict).select("type_name", "verdict", detail.alias("detail"))
