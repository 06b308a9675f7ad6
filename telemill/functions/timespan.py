"""Timespans: text such as ``1d12h`` or ``-90m`` and BIGINT nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names and their length in nanoseconds.
UNIT_NANOS = {
    "ns": 1,
    "us": 1_000,
    "µs": 1_000,
    "μs": 1_000,
    "ms": 1_000_000,
    "s": 1_000_000_000,
    "m": 60_000_000_000,
    "h": 3_600_000_000_000,
}
DAY_NANOS = 86_400_000_000_000

_NUMBER = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
_UNIT = "(?:" + "|".join(UNIT_NANOS) + ")"
_DAYS = rf"\A({_NUMBER})d"
_GRAMMAR = rf"\A(?:{_NUMBER}d)?(?:[+-]?(?:0|(?:{_NUMBER}{_UNIT})+))?\z"
_PART = rf"({_NUMBER})({_UNIT})"
# The usual case, one short whole number and a unit, fits BIGINT in any unit.
_SIMPLE = "\\A([0-9]{1,5})(d|" + "|".join(UNIT_NANOS) + ")\\z"


def _scaled(number: Column, nanos: Column) -> Column:
    """``number`` units of ``nanos`` each, cut to whole nanoseconds; NULL if too large."""
    exact = F.call_function("try_multiply", number.try_cast("decimal(38,18)"), nanos)
    return F.floor(exact).try_cast("decimal(30,0)")


def _unit_nanos(unit: Column) -> Column:
    lengths = {"d": DAY_NANOS, **UNIT_NANOS}
    return F.create_map(*[F.lit(x).cast("bigint") if isinstance(x, int) else F.lit(x) for p in lengths.items() for x in p])[unit]


def parse_timespan(text: Column) -> Column:
    """Nanoseconds of a timespan text, NULL if it is none or does not fit BIGINT.

    An optional day count comes first; a sign belongs to the rest only, so
    ``1d-2h`` is 22 hours.
    """
    days = F.nullif(F.regexp_extract(text, _DAYS, 1), F.lit(""))
    day_nanos = F.when(days.isNull(), F.lit(0).cast("decimal(30,0)")).otherwise(
        _scaled(days, F.lit(DAY_NANOS).cast("decimal(15,0)"))
    )
    rest = F.regexp_replace(text, _DAYS, "")
    parts = F.zip_with(
        F.regexp_extract_all(rest, F.lit(_PART), F.lit(1)),
        F.regexp_extract_all(rest, F.lit(_PART), F.lit(2)),
        lambda n, u: _scaled(n, _unit_nanos(u).cast("decimal(15,0)")),
    )
    total = F.aggregate(
        parts,
        F.lit(0).cast("decimal(38,0)"),
        lambda acc, part: F.call_function("try_add", acc, part).cast("decimal(38,0)"),
    )
    signed = F.when(rest.startswith("-"), -total).otherwise(total)
    nanos = F.call_function("try_add", day_nanos, signed).try_cast("bigint")
    simple = F.regexp_extract(text, _SIMPLE, 1).try_cast("bigint") * _unit_nanos(F.regexp_extract(text, _SIMPLE, 2))
    return F.when(text.rlike(_SIMPLE), simple).when((text != "") & text.rlike(_GRAMMAR), nanos)


def is_timespan(text: Column) -> Column:
    return F.when(text.rlike(_SIMPLE), F.lit(True)).otherwise(parse_timespan(text).isNotNull())


def _with_fraction(amount: Column, digits: int) -> Column:
    """``amount`` / 10^digits as text without trailing zeros."""
    scale = F.lit(10**digits).cast("decimal(20,0)")
    whole = F.floor(amount / scale).cast("decimal(20,0)")
    rest = F.lpad((amount - whole * scale).cast("decimal(20,0)").cast("string"), digits, "0")
    rest = F.regexp_replace(rest, "0+$", "")
    return F.when(rest == "", whole.cast("string")).otherwise(F.concat_ws(".", whole.cast("string"), rest))


def format_timespan(nanos: Column) -> Column:
    """Text such as ``1h30m30s`` or ``1.5ms``; seven days are ``168h0m0s``."""
    n = F.abs(nanos.cast("decimal(20,0)"))
    hour, minute, second = (F.lit(UNIT_NANOS[u]).cast("decimal(20,0)") for u in ("h", "m", "s"))
    hours = F.floor(n / hour).cast("decimal(20,0)")
    minutes = F.floor((n % hour) / minute).cast("decimal(20,0)")
    seconds = F.concat(_with_fraction((n % minute).cast("decimal(20,0)"), 9), F.lit("s"))
    text = (
        F.when(nanos == 0, F.lit("0s"))
        .when(n < 1_000, F.concat(n.cast("string"), F.lit("ns")))
        .when(n < 1_000_000, F.concat(_with_fraction(n, 3), F.lit("µs")))
        .when(n < 1_000_000_000, F.concat(_with_fraction(n, 6), F.lit("ms")))
        .when(hours > 0, F.concat(hours.cast("string"), F.lit("h"), minutes.cast("string"), F.lit("m"), seconds))
        .when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m"), seconds))
        .otherwise(seconds)
    )
    return F.when(nanos < 0, F.concat(F.lit("-"), text)).when(nanos.isNotNull(), text)


def to_interval(nanos: Column) -> Column:
    """Nanoseconds as a day-time interval (microseconds, the finer part is cut)."""
    return F.make_dt_interval(secs=(nanos.cast("decimal(20,0)") / 1_000_000_000).cast("decimal(18,6)"))
