"""Item definitions: what a telemetry type looks like.

A definition is a small driver-side object. Everything done *with* it (checks,
typed columns, schema files) is compiled to DataFrame expressions elsewhere.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

# The seven column types and how Spark holds them.
KINDS: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "datetime": T.TimestampNTZType(),
    "dynamic": T.StringType(),
    "int": T.LongType(),
    "real": T.DoubleType(),
    "string": T.StringType(),
    "timespan": T.LongType(),  # nanoseconds
}

INGEST_TIME = "ingest_time"
DEFAULT_LATENCY_MINUTES = 1
ZERO_LATENCY_MINUTES = 60
KIND_KEY = "telemetry_kind"  # StructField metadata key


def typed_field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, KINDS[kind], True, {KIND_KEY: kind})


def kind_of(struct_field: T.StructField) -> str | None:
    return (struct_field.metadata or {}).get(KIND_KEY)


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    default: Any = None
    optional: bool = False


@dataclass(frozen=True)
class ItemDefinition:
    name: str
    columns: tuple[Column, ...]
    folder: str = ""
    latency_minutes: int = DEFAULT_LATENCY_MINUTES
    documentation: str = field(default="", compare=False)

    def __post_init__(self):
        object.__setattr__(self, "columns", tuple(self.columns))
        object.__setattr__(self, "folder", self.folder or self.name)

    @property
    def segment_minutes(self) -> int:
        """Rotation age: zero latency means an hour."""
        return self.latency_minutes or ZERO_LATENCY_MINUTES

    @property
    def stored_columns(self) -> list[tuple[str, str]]:
        return [(INGEST_TIME, "datetime"), *((c.name, c.kind) for c in self.columns)]

    @property
    def stored_schema(self) -> T.StructType:
        return stored_schema(self.stored_columns)

    def sidecar(self) -> str:
        """Text of the schema file kept next to the data."""
        columns = [{"name": n, "type": k} for n, k in self.stored_columns]
        return json.dumps({"name": self.name, "orderedColumns": columns}, ensure_ascii=False, indent=2)

    def to_json(self) -> str:
        columns = []
        for c in self.columns:
            entry: dict[str, Any] = {"name": c.name, "type": c.kind}
            if c.default is not None:
                entry["defaultValue"] = c.default
            if c.optional:
                entry["optional"] = True
            columns.append(entry)
        return json.dumps(
            {
                "name": self.name,
                "documentation": self.documentation,
                "folder": self.folder,
                "latencyMinutes": self.latency_minutes,
                "orderedColumns": columns,
            },
            ensure_ascii=False,
        )

    @classmethod
    def from_json(cls, text: str) -> ItemDefinition:
        """Build from a definition text that ``lint_definitions`` has passed."""
        raw = json.loads(text)
        columns = []
        for entry in raw["orderedColumns"]:
            default = entry.get("defaultValue")
            if default is not None and entry["type"] in ("int", "real"):
                default = int(default) if entry["type"] == "int" else float(default)
            columns.append(Column(entry["name"], entry["type"], default, bool(entry.get("optional") or False)))
        latency = raw.get("latencyMinutes")
        return cls(
            name=raw["name"],
            columns=tuple(columns),
            folder=raw.get("folder") or "",
            latency_minutes=DEFAULT_LATENCY_MINUTES if latency is None else int(latency),
            documentation=raw.get("documentation") or "",
        )


def stored_schema(columns: list[tuple[str, str]]) -> T.StructType:
    """Schema of a stored table; optionality is not stored, so all is nullable."""
    return T.StructType([typed_field(name, kind) for name, kind in columns])
