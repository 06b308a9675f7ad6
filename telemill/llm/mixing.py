"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import stored

SEED = "mix"
DRAW_MEAN = 64.0  # a draw's mean stays below this; larger ones are sums of several draws
BROADCAST_BYTES = 8 << 20
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A number from 0 (included) to 1 that depends on the parts' text only."""
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / float(1 << 52)


def poisson_cdf(mean: Column) -> Column:
    """Values of the distribution function from 0 on, until the rest is beyond a double's precision."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k.cast("double")
        return F.struct(p.alias("p"), F.array_append(acc["c"], F.element_at(acc["c"], -1) + p).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["c"])


def repetition_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, total: int | None = None) -> DataFrame:
    """``(source, rate, draws, cdf)`` of each source: how often its documents are to occur on average.

    ``weights`` gives the share of each source in the result (a null source is the key ``None``; those not named get
    none); without it all sources have the same share. ``total`` is the expected size, by default that of ``docs``.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for source, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(value))).otherwise(weight)
    sizes = stored(sizes.withColumn("weight", weight), "mix-sizes")
    sums = sizes.agg(F.sum("weight").alias("all_weights"), F.sum("n").alias("all_rows"))
    size = F.col("all_rows") if total is None else F.lit(total)
    rate = F.when(
        F.col("all_weights") > 0, size.cast("double") * F.col("weight") / (F.col("all_weights") * F.col("n"))
    ).otherwise(0.0)
    draws = F.greatest(F.ceil(F.col("rate") / DRAW_MEAN), F.lit(1)).cast("int")
    return (
        sizes.crossJoin(F.broadcast(sums))  # a single row
        .select("source", rate.alias("rate"))
        .withColumn("draws", draws)
        .withColumn("cdf", poisson_cdf(F.col("rate") / F.col("draws")))
    )


def _with_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """``docs`` with their source's rate; broadcast if the table is measured to be small, else joined on salted sources."""
    rates = stored(rates, "mix-rates")
    size = rates.agg(
        F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 8 * F.size("cdf") + 32).alias("size")
    ).first()["size"]
    rates = rates.withColumnRenamed("source", "mix_source")
    if (size or 0) <= BROADCAST_BYTES:
        return docs.join(F.broadcast(rates), docs["source"].eqNullSafe(F.col("mix_source")))
    salted = rates.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("kept_row"), F.lit(SALTS)).cast("int")
    return docs.withColumn("own_salt", salt).join(
        salted, F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("own_salt") == F.col("mix_salt"))
    )


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    total: int | None = None,
    seed: str = SEED,
    keep: list[str] | None = None,
) -> DataFrame:
    """``(doc_id, source, copy, shuffle_key)``, and the columns in ``keep``: each document as often as it is drawn.

    The number of copies is the inverse of its source's Poisson distribution function at
    a number hashed from ``seed`` and ``doc_id``; means above 64 are drawn in several parts, whose
    sum has the same distribution. Rows that repeat a ``doc_id`` have equal draws, rows without one share theirs;
    a null source is a source. Rows are dealt out by ``shuffle_key`` and sorted by it within each task.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    row = F.struct(*[F.col(c) for c in keep or ["doc_id"]]).alias("kept_row")
    df = _with_rates(
        docs.select("doc_id", "source", row), repetition_rates(docs.select("source"), weights, total)
    )
    draws = F.transform(
        F.sequence(F.lit(1), F.col("draws")),
        lambda d: F.size(F.filter("cdf", lambda c: c < uniform(F.lit(seed), key, d))),
    )
    df = df.select(
        "doc_id", "source", "kept_row",
        F.aggregate(draws, F.lit(0).cast("bigint"), lambda total, n: total + n).alias("copies"),
    ).where("copies > 0")
    df = df.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))).drop("copies")
    df = df.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed + "-order"), key, F.col("copy").cast("string"))))
    return (df if keep else df.drop("kept_row")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
