"""Pipe-style queries over stored tables: stages apply left to right.

``Table(df).where("value", ">=", 20).project("label").take(5)``; the result of
any stage is a plain DataFrame under ``.df``.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.definitions import kind_of
from telemill.functions.checks import format_datetime, parse_datetime
from telemill.functions.timespan import format_timespan, parse_timespan
from telemill.session import configure_session, quoted
from telemill.sources.tables import scan_roots, scan_table

_COMPARE = {
    "==": lambda c, v: c == v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}
# Which Python literals a column of each kind is compared with.
_LITERALS: dict[str, tuple[type, ...]] = {
    "bool": (bool,),
    "datetime": (str, datetime),
    "dynamic": (str,),
    "int": (int,),
    "real": (int, float),
    "string": (str,),
    "timespan": (str,),
}


class QueryError(ValueError):
    """A stage names a column or a literal that does not fit the table."""


@dataclass(frozen=True)
class Table:
    df: DataFrame

    def _field(self, name: str):
        if name not in self.df.columns:
            raise QueryError(f"unknown column {name}")
        return self.df.schema[name]

    def where(self, column: str | Column, op: str | None = None, value: Any = None) -> Table:
        """Rows for which ``column op value`` holds; a Spark condition works too.

        NULL compares as unknown, so such rows are left out.
        """
        if isinstance(column, Column):
            return Table(self.df.where(column))
        kind = kind_of(self._field(column))
        if op not in _COMPARE:
            raise QueryError(f"unknown comparison {op}")
        fits = _LITERALS.get(kind, (object,))
        if not isinstance(value, fits) or (isinstance(value, bool) and bool not in fits and object not in fits):
            raise QueryError(f"{column} is {kind} and cannot be compared with {value!r}")
        literal = F.lit(value)
        if kind == "datetime" and isinstance(value, str):
            literal = parse_datetime(literal)
        elif kind == "datetime":
            literal = literal.cast("timestamp_ntz")
        elif kind == "timespan":
            literal = parse_timespan(literal)
        return Table(self.df.where(_COMPARE[op](quoted(column), literal)))

    def project(self, *columns: str) -> Table:
        """Exactly the named columns, in the order named."""
        for name in columns:
            self._field(name)
        return Table(self.df.select(*[quoted(c) for c in columns]))

    def take(self, n: int) -> Table:
        """Any ``n`` rows."""
        return Table(self.df.limit(n))

    def summarize_count(self, *by: str) -> Table:
        """Rows per key, as ``count_``."""
        for name in by:
            self._field(name)
        return Table(self.df.groupBy(*[quoted(c) for c in by]).agg(F.count("*").alias("count_")))

    def rows_as_json(self) -> DataFrame:
        return rows_as_json(self.df)


def open_table(
    spark: SparkSession, root: str | list[str], type_name: str, start: str | None = None, end: str | None = None
) -> Table:
    """All rows of a stored type, of one root or several."""
    configure_session(spark)
    if isinstance(root, str):
        return Table(scan_table(spark, root, type_name, start, end))
    return Table(scan_roots(spark, root, type_name, start, end))


def rows_as_json(df: DataFrame) -> DataFrame:
    """One JSON object per row, keyed by column, NULL cells as ``null``.

    Datetimes have milliseconds, timespans read like ``1h30m30s``.
    """
    members = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        value = quoted(f.name)
        if f.dataType.typeName().startswith("timestamp"):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSS")
        elif kind_of(f) == "timespan":
            value = format_timespan(value)
        members.append(value.alias(f.name))
    return df.select(F.to_json(F.struct(*members), {"ignoreNullFields": "false"}).alias("row"))
