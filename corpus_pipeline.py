"""A corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing sources, and sampled segmentations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import copies, lines, mixing, quality, segmentation
from telemill.llm.common import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_text(found: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of documents, with the new text and its length."""
    changed = {"text": F.col(text), "n_chars": F.length(text).cast("bigint")}
    return found.select(*[changed.get(c, F.col("kept_row")[c]).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and failing lines of the others."""
    row = [c for c in docs.columns if c != "text"]
    found = quality.clean_lines(docs, keep=row).where("kept")
    return _with_text(found, docs.columns, "clean_text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common blocks go from the later document; one that has nothing left goes with them."""
    row = [c for c in docs.columns if c != "text"]
    found = lines.dedup_lines(docs, keep=row).where(r"n_removed = 0 OR kept_text RLIKE '[^\\x20\\x09-\\x0D]'")
    return _with_text(found, docs.columns, "kept_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked one stays, the one with the smallest id.

    Links are SimHash fingerprints that differ in two bits or fewer, as in op1, and 0.8 or more of the five-word shingles in common.
    """
    return copies.drop_near_copies(docs, distance=2)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal shares of all sources; a document occurs as often as it was drawn."""
    mixed = mixing.mix_sources(docs, keep=docs.columns)
    return mixed.select(*[F.col("kept_row")[c].alias(c) for c in docs.columns])


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations as piece ids."""
    return segmentation.encode_samples(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix),
    ("sentencepiece", segment),
]

# Fingerprints and sampled segmentations cannot be written in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
