"""Whole-text JSON parsing into VARIANT.

Spark's parsers stop after the first JSON value and ignore what follows. Here a
random marker is appended as a last array element: only a text that is one
complete JSON value leaves the marker where it was put.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON as the standard has it: double quotes, no NaN, no leading zeros.
_STRICT = {
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "allowNumericLeadingZeros": "false",
    "allowUnquotedControlChars": "false",
    "allowBackslashEscapingAnyCharacter": "false",
    # As long as a text can be. A VARIANT keeps the parser's limit of 1,000 levels: copying one of
    # depth 1,500 overflows the JVM's stack, which ends the executor. See ``raw_elements``.
    "maxStringLen": str(2**31 - 1),
    "maxNumLen": str(2**31 - 1),
}

_WHITESPACE = " \t\r\n"


# Nobody who writes a body can know it: it is drawn anew by every driver.
_MARKER = uuid.uuid4().hex


def _marked_elements(text: Column) -> Column:
    # Every element becomes a VARIANT of its own, so neither the size limit of a
    # VARIANT nor its key dictionary spans the whole array.
    return F.from_json(text, "array<variant>", _STRICT)


def ends_with_marker(elements: Column) -> Column:
    return _is_marker(F.try_element_at(elements, F.lit(-1)))


def marked_array(text: Column) -> Column:
    """Elements of a text that should hold one JSON array, the marker last.

    NULL or without the marker if it does not; an empty array is never
    complete either, see ``is_empty_array``.
    """
    # Cut and joined as bytes: trimming and substrings by character walk the
    # whole text, which for a body costs more than parsing it.
    trimmed = F.when(F.endswith(text, F.lit("]")), text).otherwise(F.rtrim(text, F.lit(_WHITESPACE)))
    opened = F.substring(trimmed.cast("binary"), F.lit(1), F.octet_length(trimmed) - 1).cast("string")
    return _marked_elements(F.when(F.endswith(trimmed, F.lit("]")), F.concat(opened, F.lit(f',"{_MARKER}"]'))))


# Objects without declared members are skipped over, not built up, so their depth needs no stack.
_DEEP = {**_STRICT, "maxNestingDepth": str(2**31 - 1)}
_TOKENS = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{},]|[^"\[\]{},]++'
_ONLY_VALUE = r'(?s)\A\{[ \t\r\n]*+"[^"\\]*+(?:\\.[^"\\]*+)*+"[ \t\r\n]*+:[ \t\r\n]*+(.*?)[ \t\r\n]*\}\z'


def is_array_of_objects(text: Column) -> Column:
    """Whether a text is one JSON array of objects and nulls, however deep its values are nested."""
    trimmed = F.rtrim(text, F.lit(_WHITESPACE))
    opened = F.substring(trimmed.cast("binary"), F.lit(1), F.octet_length(trimmed) - 1).cast("string")
    marked = F.when(F.endswith(trimmed, F.lit("]")), F.concat(opened, F.lit(f',{{"{_MARKER}":1}}]')))
    elements = F.from_json(marked, f"array<struct<`{_MARKER}`:int>>", _DEEP)
    return F.coalesce(F.try_element_at(elements, F.lit(-1))[_MARKER] == 1, F.lit(False))


def raw_elements(text: Column) -> Column:
    """What stands between the outermost commas of a JSON array or object, as it is written.

    The text must be valid JSON; it is cut by counting brackets, so its depth does not matter.
    """
    tokens = F.regexp_extract_all(F.trim(text, F.lit(_WHITESPACE)), F.lit(_TOKENS), F.lit(0))
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(2).alias("first"),
        F.array().cast("array<struct<first:int,size:int>>").alias("cuts"),
    )

    def step(state: Column, token: Column) -> Column:
        change = F.when(token.isin("[", "{"), 1).when(token.isin("]", "}"), -1).otherwise(0)
        depth, at = state["depth"] + change, state["at"] + 1
        ends = (state["depth"] == 1) & ((token == ",") | (depth == 0))
        cut = F.struct(state["first"].alias("first"), (at - state["first"]).alias("size"))
        return F.struct(
            depth.alias("depth"), at.alias("at"), F.when(ends, at + 1).otherwise(state["first"]).alias("first"),
            F.when(ends, F.concat(state["cuts"], F.array(cut))).otherwise(state["cuts"]).alias("cuts"),
        )

    cuts = F.aggregate(tokens, start, step, lambda state: state["cuts"])
    part = lambda cut: F.array_join(F.slice(tokens, cut["first"], cut["size"]), "")
    return F.transform(cuts, lambda cut: F.trim(part(cut), F.lit(_WHITESPACE)))


def only_value(text: Column) -> Column:
    """The value of an object that has one member, as it is written."""
    return F.regexp_extract(text, _ONLY_VALUE, 1)


def is_empty_array(text: Column) -> Column:
    return text.rlike(r"\A[ \t\r\n]*(?:null|\[[ \t\r\n]*\])[ \t\r\n]*\z")


def _wrapped(text: Column) -> Column:
    # With the marker second, exactly one value stands before it.
    return F.concat(F.lit("["), text, F.lit(f',"{_MARKER}"]'))


def _is_marker(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "string") == F.lit(_MARKER), F.lit(False))


def parse_strict(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON value, else NULL."""
    elements = _marked_elements(_wrapped(text))
    return F.when(_is_marker(F.get(elements, F.lit(1))), F.get(elements, F.lit(0)))


def is_strict_json(text: Column) -> Column:
    """Whether a text is exactly one JSON value.

    The quick parser gives up on values beyond its limits; whatever it turns
    down is looked at again by the one with higher ones.
    """
    quick = F.try_variant_get(F.try_parse_json(_wrapped(text)), "$[1]", "string") == F.lit(_MARKER)
    return F.when(F.coalesce(quick, F.lit(False)), F.lit(True)).otherwise(
        _is_marker(F.get(_marked_elements(_wrapped(text)), F.lit(1)))
    )


def is_object(value: Column) -> Column:
    """Whether a VARIANT holds a JSON object; looks at no field of it."""
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def object_fields(value: Column) -> Column:
    """One level of a VARIANT object as ``map<string, variant>``, else NULL."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def kind_of_value(value: Column) -> Column:
    """STRING, BOOLEAN, BIGINT, DOUBLE, DECIMAL(p,s), VOID, OBJECT<..>, ARRAY<..>."""
    return F.schema_of_variant(value)


def is_number(value: Column) -> Column:
    kind = kind_of_value(value)
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
