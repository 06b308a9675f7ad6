"""What the operators share: stored steps, row batches, and linked components."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.session import remove_path, scratch_dir

# Functions that run on executors travel as code, so that a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 500


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stored(df: DataFrame, label: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder, and read again.

    The copy survives lost executors and ends the lineage. Shuffle files of the
    write are removed as it ends, and batches handed to Python are kept small,
    as texts may be long.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    with _settings(spark, {_CLEANUP: "true", _BATCH: str(batch_rows)}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_stored(*tables: DataFrame) -> None:
    """Stored steps that nothing reads any more make room for the next."""
    for table in tables:
        for folder in {path.rsplit("/", 1)[0] for path in table.inputFiles()}:
            remove_path(table.sparkSession, folder)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bounds what one step holds."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none if it is null."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.array_remove(parts, "")


def connected_components(links: DataFrame, label: str = "components") -> DataFrame:
    """``(node, root)`` of all nodes in ``links`` (columns ``a``, ``b``); the root is the smallest node.

    Large-star and small-star steps take turns until nothing changes. Every step
    first combines minima within its task, so a node with very many links is no
    burden, and each round is written to the shared folder.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label
    )
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        edges = stored(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionAll(lowest.select("u", F.col("m").alias("v")))
            .distinct(),
            label,
        )
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.max("u")).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        roots.select("node", F.col("node").alias("root"))
    )
