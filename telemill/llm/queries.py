"""One registered query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import (
    collocations,
    hard_negatives,
    language,
    lines,
    mixing,
    neighbours,
    packing,
    pii,
    quality,
    segmentation,
    simhash,
    substrings,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = [pii.span_text(k, F.col(k)) for k in pii.BASE]
    # Added spans stand with those of their kind; kinds that have no base spans follow by name.
    kind = lambda y: y["kind"]
    bare = lambda y: F.struct(y["start"].alias("start"), y["stop"].alias("stop"))
    of_kind = lambda k: F.transform(F.filter("added", lambda y: kind(y) == k), bare)
    every = [pii.span_text(k, F.array_sort(F.concat(F.col(k), of_kind(k)))) for k in pii.BASE]
    other = F.array_sort(F.filter("added", lambda y: ~kind(y).isin(*pii.BASE)))
    return found.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(F.array_join(F.concat(*base), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*every, pii.span_text(None, other)), ",").alias("spans"),
    )


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query
def op6_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of all pages are laid out as WARC records; a hash of the id decides which records of the second
    are damaged or lost, and which the first lacks."""
    records = warc.warc_layout(table(spark, sf_dir, "pages"))
    fate = F.substring(F.sha2(F.col("page_id").cast("string"), 256), 1, 2)
    first = records.where(fate != "02")
    damaged = F.when(fate == "00", F.concat(F.substring("record", 1, 100), F.lit("?").cast("binary"))).otherwise(F.col("record"))
    second = records.where(fate != "01").withColumn("record", damaged)
    return warc.audit(warc.leaves(first), warc.leaves(second)).select("file", "slot", "kind")


@query
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_kept_words",
    )


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmentation.encode_samples(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "rank", F.size("ids").cast("bigint").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        "log_prob", "inclusion", "round_trip",
    )


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh row are wrong on purpose; every hundredth row is an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
