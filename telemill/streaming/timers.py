"""Timers per type: which segments are due although nothing comes any more."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# The processor travels as code, so that a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STARTED = "type_name string, due bigint, definition string"
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


class DueTypes(StatefulProcessor):
    """Holds, per type, when its running segment is due, and says so once that time has come."""

    def init(self, handle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "due bigint, definition string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = list(rows)
        last = pd.concat(frames).sort_values("due").iloc[-1]
        due = int(last["due"])
        if not self.running.exists() or due > self.running.get()[0]:
            self.running.update((due, str(last["definition"])))
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # A timer of a segment that has been followed by another one says nothing.
        if self.running.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self.running.get()[0]:
            _, definition = self.running.get()
            self.running.clear()
            yield pd.DataFrame({"type_name": [key[0]], "definition": [definition]})

    def close(self) -> None:
        pass


def due_types(started: DataFrame) -> DataFrame:
    """``(type_name, definition)`` of each type as its time ``due`` (milliseconds) comes, by the clock of the machines.

    ``started`` is a stream of the segments begun: ``(type_name, due, definition)``. Timers need no further rows.
    """
    rows = started.select(*[F.col(part.split()[0]) for part in STARTED.split(", ")])
    return rows.groupBy("type_name").transformWithStateInPandas(
        statefulProcessor=DueTypes(), outputStructType="type_name string, definition string", outputMode="Update", timeMode="ProcessingTime"
    )
