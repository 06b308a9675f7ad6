"""Ingestion as one streaming query for all types."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Collection, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from telemill.definitions import INGEST_TIME, ItemDefinition
from telemill.operators.accounts import ACCOUNT_TYPES
from telemill.operators.segments import MINUTE_MS, assign_anchored
from telemill.plans.ingest import ingest_batch, utc_now
from telemill.plans.store import PARALLEL_WRITES, store_result
from telemill.session import configure_session, make_folder, path_exists, read_text, write_text
from telemill.sources.sinks import close_segment, is_closed, prepare_tables, stream_load, write_table
from telemill.sources.tables import table_path
from telemill.streaming.timers import STARTED, STATE_STORE, due_types

EPOCHS = "_epochs"
SEGMENTS = "segments.json"


@dataclass
class StreamIngest:
    """Where and how a stream stores what it ingests.

    ``definitions`` is asked once per epoch, so types can come and go while the
    stream runs. ``writer`` stores the rows of one type; it is a field so that a
    failing store can be tried out; ``clock`` gives an epoch's ingest time, as UTC text.

    With ``rotate``, a type's open loads become a closed segment with the first epoch that is its latency or
    more after the epoch its segment began with; ``start_timers`` does so too where no further epoch comes.
    """

    spark: SparkSession
    root: str
    name: str
    definitions: Callable[[], list[ItemDefinition]]
    instance: str = "telemill"
    writer: Callable[..., str] = field(default=write_table)
    rotate: bool = True
    key_columns: Mapping[str, Collection[str]] = field(default_factory=dict)  # of closed segments, by type
    clock: Callable[[], str] = utc_now
    _prepared: list[ItemDefinition] | None = field(default=None, init=False)
    _identity: str = field(default="0" * 32, init=False)

    # --- one epoch -----------------------------------------------------------

    def _manifest(self, epoch: int) -> tuple[str, list[ItemDefinition], bool]:
        """Ingest time and definitions of an epoch, fixed on its first attempt, and whether it is a further one.

        A repeated epoch then stores exactly the rows of the first attempt, in
        the same places.
        """
        path = f"{self.root}/{EPOCHS}/{self.name}/{self._identity}/{epoch:012d}.json"
        plan = None
        if path_exists(self.spark, path):
            try:
                plan = json.loads(read_text(self.spark, path))
            except ValueError:
                plan = None  # cut off by a crash, so nothing was stored by it yet
        repeated = plan is not None
        if plan is None:
            plan = {"ingest_time": self.clock(), "definitions": [d.to_json() for d in self.definitions()]}
            write_text(self.spark, path, json.dumps(plan))
        return plan["ingest_time"], [ItemDefinition.from_json(text) for text in plan["definitions"]], repeated

    def _load(self, epoch: int) -> str:
        return stream_load(self.name, self._identity, epoch)

    # --- rotation -------------------------------------------------------------

    def _segments_path(self) -> str:
        return f"{self.root}/{EPOCHS}/{self.name}/{self._identity}/{SEGMENTS}"

    def _running(self, epoch: int) -> dict[str, int]:
        """Start of each type's running segment, in milliseconds, as the epoch before left them.

        The file has the starts before and after the last epoch, so a repeated epoch
        finds what its first attempt found.
        """
        if epoch == 0:
            return {}
        if not path_exists(self.spark, self._segments_path()):
            raise FileNotFoundError(f"the running segments before epoch {epoch} are not known: {self._segments_path()}")
        state = json.loads(read_text(self.spark, self._segments_path()))
        if epoch not in (state["epoch"], state["epoch"] + 1):
            raise ValueError(f"running segments are known for epoch {state['epoch']}, not for {epoch}")
        return state["before" if epoch == state["epoch"] else "after"]

    def _close(self, definition: ItemDefinition, leave: Collection[str] = ()) -> None:
        close_segment(self.spark, self.root, definition, leave, key_columns=self.key_columns.get(definition.name, ()))

    def _close_old(self, running: dict[str, int], now: int, epoch: int, types: list[ItemDefinition]) -> dict[str, int]:
        """Close the segments whose latency has passed; returns those that still run."""
        old = [t for t in types if t.name in running and now >= running[t.name] + t.segment_minutes * MINUTE_MS]
        with ThreadPoolExecutor(max_workers=PARALLEL_WRITES) as pool:
            # A repeated epoch may find its own rows stored already: they belong to the next segment.
            list(pool.map(lambda t: self._close(t, leave=[self._load(epoch)]), old))
        return {name: start for name, start in running.items() if name not in {t.name for t in old}}

    def _started_path(self) -> str:
        return f"{self.root}/{EPOCHS}/{self.name}/{self._identity}/started"

    def _note_started(self, before: dict[str, int], after: dict[str, int], epoch: int, types: list[ItemDefinition]) -> None:
        """When the segments that began with this epoch are due, for the timers."""
        lines = [
            json.dumps({"type_name": t.name, "due": after[t.name] + t.segment_minutes * MINUTE_MS, "definition": t.to_json()})
            for t in types
            if t.name in after and after[t.name] != before.get(t.name)
        ]
        if lines:
            write_text(self.spark, f"{self._started_path()}/{epoch:012d}.json", "\n".join(lines) + "\n")

    def start_timers(self, checkpoint: str, every: str = "1 second") -> StreamingQuery:
        """A second query, beside a started one, that closes the segments of types from which nothing comes any more.

        Each type has a timer on the executors; a segment is closed when its latency has passed, whether
        an epoch of the stream comes or not. Both may find the same segment due: one of them closes it. The query keeps its state
        in RocksDB.
        """
        make_folder(self.spark, self._started_path())
        started = self.spark.readStream.schema(STARTED).json(self._started_path())

        def close(due: DataFrame, _: int) -> None:
            for row in due.collect():  # one row a type
                self._close(ItemDefinition.from_json(row.definition))

        settings = {key: self.spark.conf.get(key, None) for key in STATE_STORE}
        for key, value in STATE_STORE.items():
            self.spark.conf.set(key, value)
        try:
            writer = due_types(started).writeStream.queryName(f"{self.name}-timers").outputMode("update")
            return writer.option("checkpointLocation", checkpoint).foreachBatch(close).trigger(processingTime=every).start()
        finally:
            for key, value in settings.items():
                self.spark.conf.set(key, value) if value is not None else self.spark.conf.unset(key)

    def _store(self, definition: ItemDefinition, rows: DataFrame, epoch: int, repeated: bool) -> str | None:
        path = table_path(self.root, definition.folder, definition.name)
        load = self._load(epoch)
        if repeated and is_closed(self.spark, path, load):
            return None
        return self.writer(rows, self.root, definition, load)

    def process(self, bodies: DataFrame, epoch: int) -> None:
        """Ingest one micro-batch: every table, the quarantine and the accounts."""
        configure_session(self.spark)
        ingest_time, definitions, repeated = self._manifest(epoch)
        if definitions != self._prepared:
            prepare_tables(self.spark, self.root, [*definitions, *ACCOUNT_TYPES])
            self._prepared = definitions
        if "batch_id" not in bodies.columns:
            number = F.monotonically_increasing_id().cast("string")
            bodies = bodies.withColumn("batch_id", F.concat(F.lit(f"{self.name}-{epoch}-"), number))
        before = self._running(epoch) if self.rotate else {}
        now = int(datetime.fromisoformat(ingest_time).replace(tzinfo=timezone.utc).timestamp() * 1000)
        after = self._close_old(before, now, epoch, [*definitions, *ACCOUNT_TYPES])

        def put(rows: DataFrame, definition: ItemDefinition) -> str | None:
            path = self._store(definition, rows, epoch, repeated)
            after.setdefault(definition.name, now)
            return path

        result = ingest_batch(bodies.drop("source"), definitions, ingest_time)
        result.checked.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            store_result(
                result,
                self.root,
                self._load(epoch),
                self.instance,
                put,
            )
            if self.rotate:
                self._note_started(before, after, epoch, [*definitions, *ACCOUNT_TYPES])
                state = {"epoch": epoch, "before": before, "after": after}
                write_text(self.spark, self._segments_path(), json.dumps(state))
        finally:
            result.checked.unpersist()

    def _checkpoint_identity(self, checkpoint: str) -> str:
        """An id that lives as long as the checkpoint does: epochs of another one are other epochs."""
        path = f"{checkpoint.rstrip('/')}/telemill-stream-id"
        if not path_exists(self.spark, path):
            write_text(self.spark, path, uuid.uuid4().hex)
        return read_text(self.spark, path).strip()

    # --- the query -------------------------------------------------------------

    def start(
        self, bodies: DataFrame, checkpoint: str, every: str | None = "500 milliseconds"
    ) -> StreamingQuery:
        """Flush by time (``every``) and size (the source's per-trigger limit).

        ``every=None`` takes what is there in as many epochs as the source's
        limit asks for, and stops.
        """
        self._identity = self._checkpoint_identity(checkpoint)
        writer = bodies.writeStream.queryName(self.name).option("checkpointLocation", checkpoint)
        trigger = {"availableNow": True} if every is None else {"processingTime": every}
        return writer.foreachBatch(self.process).trigger(**trigger).start()


class StreamRotation:
    """Anchored segments across micro-batches.

    The running segment of each type is all the state there is. It is stored per
    epoch, and an epoch starts from the state of the one before, so a repeated
    epoch yields the same segments.
    """

    def __init__(self, spark: SparkSession, root: str, minutes: dict[str, int]):
        self.spark, self.root, self.minutes = spark, root, minutes

    def _state(self, epoch: int) -> dict[str, int]:
        path = f"{self.root}/{epoch:012d}.json"
        if epoch < 0:
            return {}
        if not path_exists(self.spark, path):
            raise FileNotFoundError(f"the running segments after epoch {epoch} are not known: {path}")
        return json.loads(read_text(self.spark, path))

    def assign(self, rows: DataFrame, epoch: int, time_col: str = INGEST_TIME, type_col: str = "type_name") -> DataFrame:
        """Add ``segment_start`` and ``segment`` to the rows of one epoch."""
        before = self._state(epoch - 1)
        assigned = assign_anchored(rows, self.minutes, time_col, type_col, before)
        last = assigned.groupBy(type_col).agg(F.unix_millis(F.max("segment_start").cast("timestamp")).alias("start"))
        after = {**before, **{row[type_col]: row.start for row in last.collect()}}
        write_text(self.spark, f"{self.root}/{epoch:012d}.json", json.dumps(after))
        return assigned


