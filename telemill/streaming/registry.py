"""The registry of definitions, kept as a log so that it survives restarts and takes several writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from telemill.definitions import ItemDefinition
from telemill.operators.lint import OK, lint_definitions
from telemill.session import configure_session
from telemill.sources.log import ControlLog

_SCHEMA = "seq bigint, name string, action string, definition string"


class DefinitionError(ValueError):
    """A definition that is not valid, exists already, or does not exist."""

    def __init__(self, code: str, name: str | None):
        super().__init__(f"{code}: {name}")
        self.code = code


def load_definitions(spark: SparkSession, texts: list[str]) -> list[ItemDefinition]:
    """Definition texts, linted in one job, as definitions."""
    configure_session(spark)
    rows = spark.createDataFrame(list(enumerate(texts)), "seq int, definition string")
    for row in lint_definitions(rows).orderBy("seq").collect():
        if row.verdict != OK:
            raise DefinitionError(row.verdict, row.name)
    return [ItemDefinition.from_json(text) for text in texts]


def _fold(state: dict, entry: dict) -> dict:
    rest = {name: text for name, text in state.items() if name != entry["name"]}
    return {**rest, entry["name"]: entry["definition"]} if entry["action"] == "add" else rest


class Registry:
    """Log of definitions added and removed under ``path``.

    Every change is an entry made by exclusive create, with a number of its own. A writer that finds its number taken looks
    again, so of several that add a type at once one succeeds, and the others are told that it exists.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._log = ControlLog(spark, path, _fold, prune=False)

    def _current(self) -> dict[str, str]:
        return self._log.state()[1]

    def log(self) -> DataFrame:
        """``(seq, name, action, definition)`` of all changes."""
        rows = [(n, e["name"], e["action"], e["definition"]) for n, e in enumerate(self._log.entries())]
        return self.spark.createDataFrame(rows, _SCHEMA)

    def current(self) -> DataFrame:
        """``(name, definition)`` of every type that is defined now."""
        return self.spark.createDataFrame(sorted(self._current().items()), "name string, definition string")

    def definitions(self) -> list[ItemDefinition]:
        return [ItemDefinition.from_json(text) for _, text in sorted(self._current().items())]

    def names(self) -> list[str]:
        return sorted(self._current())

    def get(self, name: str) -> ItemDefinition:
        text = self._current().get(name)
        if text is None:
            raise DefinitionError("not_found", name)
        return ItemDefinition.from_json(text)

    def add(self, text: str) -> ItemDefinition:
        definition = load_definitions(self.spark, [text])[0]

        def change(state: dict) -> dict:
            if definition.name in state:
                raise DefinitionError("already_exists", definition.name)
            return {"name": definition.name, "action": "add", "definition": text}

        self._log.commit(change)
        return definition

    def remove(self, name: str) -> None:
        def change(state: dict) -> dict:
            if name not in state:
                raise DefinitionError("not_found", name)
            return {"name": name, "action": "remove", "definition": None}

        self._log.commit(change)
