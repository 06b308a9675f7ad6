"""Session settings, shared scratch space and small control files."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, VariantType

# Stored timestamps carry no zone and are read as UTC; a repeated JSON key keeps
# its last value; column and type names are exact, so "Id" is not "id". Checks
# of wide types compile to long methods, and the JVM only interprets methods over
# 8000 bytes: beyond that operators are better off compiled one by one.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.caseSensitive": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure_session(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings that the library's expressions rely on."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def quoted(name: str) -> Column:
    """Column reference for any name, including dots, spaces and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def floor_div(number: Column, divisor: Column) -> Column:
    """Exact floored quotient of two BIGINTs (``/`` would go through DOUBLE)."""
    return F.call_function("div", number - F.pmod(number, divisor), divisor)


def settle(df: DataFrame, kept: list[Column], computed: dict[str, Column]) -> DataFrame:
    """``select(kept + computed)`` whose computed columns are worked out once.

    A filter on a computed column would otherwise be pushed below the projection
    with the whole expression copied into it, once per use. The projection is
    followed by a one-row generator: filters on the kept columns pass it, others
    do not.
    """
    projected = df.select(*kept, *[value.alias(f"__settled_{name}") for name, value in computed.items()])
    row = F.struct(*[quoted(f"__settled_{name}").alias(name) for name in computed])
    names = [c for c in projected.columns if not c.startswith("__settled_")]
    return projected.select(*[quoted(c) for c in names], F.inline(F.array(row)))


# --- scratch space -----------------------------------------------------------


_SCRATCH: list[str] = []


class ScratchError(RuntimeError):
    """There is no folder that all executors can reach."""


def _context_checkpoint_dir(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, empty folder that every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``, or the job by
    ``SparkContext.setCheckpointDir``. Only where neither is set and everything runs in one
    process a local temporary folder is used, and removed again at exit.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _context_checkpoint_dir(spark)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ScratchError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="telemill-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Remove the scratch folders this driver has made; call it when a job is done.

    DataFrames that read them, such as assigned segments, cannot be used any more.
    """
    while _SCRATCH:
        remove_path(spark, _SCRATCH.pop())


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared scratch space as Parquet and read it back.

    Unlike a cache the copy survives lost executors, and its file sizes give the
    optimizer a measured size.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# --- joins against lookup tables ---------------------------------------------

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
HEAVY_KEYS = 1000  # busiest keys that are looked at
PARTS_PER_TASK = 16  # parts that a busy key's rows are cut into, for each task's share of rows it holds


def _fits_broadcast(lookup: DataFrame, rows: int) -> bool:
    """Whether a lookup has few enough rows, and bytes: 8 for each column, and the length of its texts."""
    texts = [F.octet_length(quoted(f.name)) for f in lookup.schema if f.dataType.typeName() in ("string", "binary")]
    width = F.lit(8 * len(lookup.columns))
    for text in texts:
        width = width + F.coalesce(text, F.lit(0))
    found = lookup.agg(F.count("*").alias("rows"), F.coalesce(F.sum(width.cast("bigint")), F.lit(0)).alias("bytes")).first()
    return found.rows <= rows and found.bytes <= BROADCAST_BYTES


def heavy_keys(big: DataFrame, keys: list[str], tasks: int) -> dict[int, int]:
    """Of the busiest keys, by a hash of theirs, the number of parts that makes each no burden for one of so many tasks.

    They are found in one pass by a sketch, which tasks fill by themselves and which is merged.
    """
    key = big.select(F.xxhash64(*[quoted(c) for c in keys]).alias("key"))
    sketch = F.call_function("approx_top_k", F.col("key"), F.lit(HEAVY_KEYS), F.lit(10 * HEAVY_KEYS))
    total, busiest = key.agg(F.count("*"), sketch).first()
    share = max(1, total // (tasks * PARTS_PER_TASK))
    return {row["item"]: -(-row["count"] // share) for row in busiest or [] if row["count"] > share}


def join_lookup(big: DataFrame, lookup: DataFrame, keys: list[str], broadcast_rows: int | None = None) -> DataFrame:
    """Left-join ``lookup`` (unique on ``keys``) to ``big`` without a hot task.

    The lookup is measured first. Up to ``broadcast_rows`` rows (``BROADCAST_ROWS``) and ``BROADCAST_BYTES`` it is broadcast
    and ``big`` is not shuffled at all. Beyond that a sketch finds the busy keys of ``big``. Only those are
    cut up: their lookup rows are repeated once per part, as many parts as their rows ask for.
    """
    if _fits_broadcast(lookup, BROADCAST_ROWS if broadcast_rows is None else broadcast_rows):
        return big.join(F.broadcast(lookup), keys, "left")
    parts = heavy_keys(big, keys, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if not parts:
        return big.join(lookup, keys, "left")
    counts = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
    of_key = F.coalesce(counts[F.xxhash64(*[quoted(c) for c in keys])], F.lit(1))
    payload = [f.name for f in big.schema if f.name not in keys and isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType)]
    part = F.pmod(F.xxhash64(*[quoted(c) for c in payload or keys]), of_key).cast("int")
    cut = lookup.withColumn("__part", F.explode(F.sequence(F.lit(0), (of_key - 1).cast("int"))))
    return big.withColumn("__part", part).join(cut, [*keys, "__part"], "left").drop("__part")


# --- control files -------------------------------------------------------------
# Schema files, stream manifests and the like: a few hundred bytes each, written
# through the file system of whatever URI the table root has.


_GLOB = re.compile(r"([{}\[\]*?\\])")


def readable(path: str) -> str:
    """A path that means itself, also where it has characters of a pattern."""
    return _GLOB.sub(r"\\\1", path)


def _path(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def glob_count(spark: SparkSession, pattern: str) -> int:
    """How many files and folders have such names."""
    fs, p = _path(spark, pattern)
    found = fs.globStatus(p)
    return 0 if found is None else len(found)


def remove_path(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def rename_path(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _path(spark, source)
    _, t = _path(spark, target)
    if not fs.rename(p, t):
        raise OSError(f"cannot rename {source} to {target}")


# Stores in which a file appears whole or not at all when it is closed.
_WHOLE_PUTS = ("s3", "s3a", "s3n", "gs", "abfs", "abfss", "wasb", "wasbs")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file; readers see the old text or the new one, also after a crash."""
    fs, p = _path(spark, path)
    whole = fs.getUri().getScheme() in _WHOLE_PUTS
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = p if whole else hadoop.Path(p.getParent(), f"_{p.getName()}.{uuid.uuid4().hex}")
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if not whole:
        rename = getattr(hadoop, "Options$Rename")
        options = spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(target), fs.makeQualified(p), options)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file if there is none yet; of several callers at once one gets True. It appears whole.

    Stores with whole puts check as the file is closed (S3 by a conditional put); a local file gets its name by a hard
    link, others by a rename that replaces nothing.
    """
    fs, p = _path(spark, path)
    hadoop, scheme = spark._jvm.org.apache.hadoop.fs, fs.getUri().getScheme()
    fs.mkdirs(p.getParent())
    whole = scheme in _WHOLE_PUTS
    target = p if whole else hadoop.Path(p.getParent(), f"_{p.getName()}.{uuid.uuid4().hex}")
    try:
        builder = fs.createFile(target).overwrite(False)
        out = builder.opt("fs.option.create.conditional.overwrite", True).build()
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        if scheme == "file":
            local = lambda x: spark._jvm.java.io.File(x.toUri().getPath()).toPath()
            spark._jvm.java.nio.file.Files.createLink(local(p), local(target))
        elif not whole:
            nothing = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
            context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
            context.rename(fs.makeQualified(target), fs.makeQualified(p), nothing)
    except Py4JJavaError as cause:
        if "AlreadyExists" in str(cause.java_exception) or whole and fs.exists(p):
            return False
        raise
    finally:
        if not whole:
            fs.delete(target, False)
    return True


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.mkdirs(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    fs, p = _path(spark, path)
    return sorted(status.getPath().getName() for status in fs.listStatus(p)) if fs.exists(p) else []


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files below a folder, by their path from there, and their sizes; hidden ones are left out."""
    fs, p = _path(spark, path)
    found, base = [], len(fs.makeQualified(p).toUri().getPath().rstrip("/")) + 1
    files = fs.listFiles(p, True)
    while files.hasNext():
        status = files.next()
        name = status.getPath().toUri().getPath()[base:]
        if not any(part[0] in "_." and "=" not in part for part in name.split("/")):
            found.append((name, status.getLen()))
    return sorted(found)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        data = spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
    finally:
        stream.close()
    return bytes(data).decode("utf-8")
