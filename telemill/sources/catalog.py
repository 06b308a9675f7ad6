"""What is stored under a root, found from the schema files alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.operators.lint import read_sidecars
from telemill.session import configure_session, glob_count, list_names, path_exists, readable, scratch_dir

# Object stores, by URI scheme; everything else is a file system.
_BLOB_SCHEMES = r"\A(?:abfss?|wasbs?|s3[an]?|gs)://"
_RAW = "bucket string, path string, sidecar string"
# Schema files that are listed and read at once; so many are read anew by each use, more are copied once.
GROUP_FILES = 20_000


class CatalogError(ValueError):
    """A root that cannot be read, or a schema file in it that is not valid."""


def _read_sidecars(spark: SparkSession, patterns: list[str]) -> DataFrame:
    path = F.col("_metadata.file_path")
    return spark.read.text(patterns, wholetext=True).select(
        F.url_decode(F.element_at(F.split(path, "/"), -2)).alias("bucket"),
        path.alias("path"),
        F.col("value").alias("sidecar"),
    )


def _sidecar_files(spark: SparkSession, root: str) -> DataFrame:
    """``(bucket, path, sidecar)`` of all schema files.

    Many are read some folders at a time, by few tasks, and copied to scratch space: the driver holds the names of one group
    (or of the largest folder), and no schema file is opened twice.
    """
    if not path_exists(spark, root):
        raise CatalogError(f"cannot read {root}")
    base = readable(root.rstrip("/"))
    groups: list[list[str]] = []
    held = GROUP_FILES
    for name in list_names(spark, root):
        pattern = f"{base}/{readable(name)}/*.json"
        found = glob_count(spark, pattern)
        if not found:
            continue
        if held + found > GROUP_FILES:
            groups.append([])
            held = 0
        groups[-1].append(pattern)
        held += found
    if not groups:
        return spark.createDataFrame([], _RAW)
    if len(groups) == 1 and held <= GROUP_FILES:
        return _read_sidecars(spark, [f"{base}/*/*.json"])
    copy, tasks = scratch_dir(spark, "schema-files"), 4 * spark.sparkContext.defaultParallelism
    own = spark.newSession()  # whose settings are nobody else's
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(tasks))
    for k, patterns in enumerate(groups):
        _read_sidecars(own, patterns).coalesce(tasks).write.parquet(f"{copy}/{k}")
    return spark.read.schema(_RAW).parquet(*[f"{copy}/{k}" for k in range(len(groups))])


def _entries(spark: SparkSession, root: str) -> DataFrame:
    configure_session(spark)
    root = root.rstrip("/")
    mode = F.when(F.lit(root).rlike(_BLOB_SCHEMES), F.lit("blob")).otherwise(F.lit("file"))
    return read_sidecars(_sidecar_files(spark, root)).select(
        "type_name",
        F.col("bucket").alias("storage_bucket"),
        mode.alias("mode"),
        F.lit(root).alias("root"),
        "columns",
        "path",
        "problem",
    )


def _one_per_type(valid: DataFrame) -> DataFrame:
    # The same type in two buckets: the last bucket in name order counts.
    rest = [c for c in valid.columns if c not in ("type_name", "problem")]
    latest = F.max_by(F.struct(*rest), F.struct("storage_bucket", "path")).alias("e")
    return valid.groupBy("type_name").agg(latest).select("type_name", "e.*")


def discover_catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row per stored type; any invalid schema file is an error.

    Folders without a schema file are not tables and are left out.
    """
    entries = _entries(spark, root)
    invalid = entries.where(F.col("problem").isNotNull()).select("path", "problem")
    bad = invalid.orderBy("path").head(20)
    if bad:
        more = invalid.count() - len(bad)
        rest = [f"and {more} more"] if more else []
        raise CatalogError("; ".join([*(f"{row.path}: {row.problem}" for row in bad), *rest]))
    return _one_per_type(entries)


def discover_catalog_lenient(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``(catalog, skipped)``: invalid schema files are listed, not raised."""
    entries = _entries(spark, root)
    skipped = entries.where(F.col("problem").isNotNull()).select("path", "problem")
    return _one_per_type(entries.where(F.col("problem").isNull())), skipped


def list_tables(catalog: DataFrame) -> DataFrame:
    return catalog.select(
        F.col("type_name").alias("typeName"), F.col("storage_bucket").alias("storageBucket"), "mode"
    ).orderBy("typeName")


@dataclass(frozen=True)
class TableEntry:
    """One catalog row on the driver: enough to open the table."""

    type_name: str
    folder: str
    root: str
    columns: tuple[tuple[str, str], ...]


def find_table(catalog: DataFrame, type_name: str) -> TableEntry:
    row = catalog.where(F.col("type_name") == type_name).first()
    if row is None:
        raise CatalogError(f"unknown table {type_name}")
    return TableEntry(row.type_name, row.storage_bucket, row.root, tuple((c["name"], c["type"]) for c in row["columns"]))
