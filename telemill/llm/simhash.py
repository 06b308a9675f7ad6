"""SimHash near-duplicates, linked by multi-index hashing."""

from __future__ import annotations

import functools
import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import connected_components, pieces, stored, text_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
SHINGLE = 3
BITS = 64
CHUNK = 1 << 16


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of a text as an unsigned number; 0 if it holds no word."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingle = len(words)
    digest = functools.partial(xxhash.xxh64_intdigest, seed=SEED)
    hashes = map(digest, map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    total = len(words) - shingle + 1
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, total, CHUNK):
        part = np.fromiter(itertools.islice(hashes, CHUNK), np.uint64, min(CHUNK, total - start))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Sums of up to 255 rows fit a byte, which is what numpy adds fastest.
        for block in range(0, len(bits), 255 * 64):
            rows = bits[block : block + 255 * 64]
            whole = len(rows) // 255 * 255
            if whole:
                counts += rows[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            counts += rows[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` per row: the fingerprint's 64 bits as a BIGINT. A null text has none of the words: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            prints = [simhash(t or b"", shingle) for t in text_bytes(batch.column(1))]
            column = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], ["doc_id", "fp"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, fp bigint")


def ball(width: int, radius: int) -> list[int]:
    """Masks of a segment of ``width`` bits with up to ``radius`` bits set."""
    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in itertools.combinations(range(width), n)]


def segment_balls(distance: int, segments: int) -> list[tuple[int, int, list[int]]]:
    """``(shift, width, masks)`` of each segment to look into.

    Of fingerprints within ``distance`` bits, with ``distance = segments * r + a``,
    either one of the first ``a + 1`` segments differs in at most ``r`` bits, or
    one of the others in at most ``r - 1``.
    """
    r, a = divmod(distance, segments)
    width, rest = divmod(BITS, segments)
    out, shift = [], 0
    for i in range(segments):
        w = width + (i < rest)
        radius = r if i <= a else r - 1
        if radius >= 0:
            out.append((shift, w, ball(w, radius)))
        shift += w
    return out


# Beyond as many fingerprints in one bucket, looking up every neighbour of each is cheaper than comparing them.
BUCKET = 4096


def near_pairs(prints: DataFrame, distance: int = 2, segments: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of distinct fingerprints (column ``fp``) that differ in up to ``distance`` bits.

    Members of a bucket with more than ``bucket`` fingerprints are not compared
    with each other: each looks up its whole ball in the table of fingerprints
    instead, so work stays linear in the size of such a bucket and no pair is lost.
    """
    table, probes = [], []
    for number, (shift, width, masks) in enumerate(segment_balls(distance, segments)):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1 if width < BITS else -1))
        table.append(F.struct(F.lit(number).alias("segment"), value.alias("key")))
        probes += [F.struct(F.lit(number).alias("segment"), value.bitwiseXOR(F.lit(m)).alias("key")) for m in masks]
    entries = prints.select(F.col("fp").alias("b"), F.inline(F.array(*table)))
    lookups = prints.select(F.col("fp").alias("a"), F.inline(F.array(*probes)))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    hot = stored(
        entries.groupBy("segment", "key").count().where(F.col("count") > bucket).select("segment", "key"), "hot-buckets"
    )
    if hot.isEmpty():
        return lookups.join(entries, ["segment", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    crowded = entries.join(hot, ["segment", "key"], "left_semi").select(F.col("b").alias("a")).distinct()
    masks = F.array(*[F.lit(m - (1 << BITS) if m >> (BITS - 1) else m) for m in ball(BITS, distance)])
    around = crowded.select("a", F.explode(masks).alias("mask")).select(
        "a", F.col("a").bitwiseXOR(F.col("mask")).alias("b")
    )
    found = around.join(prints.select(F.col("fp").alias("b")), "b").where("a <> b")
    entries = entries.join(hot, ["segment", "key"], "left_anti")
    pairs = lookups.join(entries, ["segment", "key"]).where((F.col("a") != F.col("b")) & near)
    return (
        pairs.select("a", "b").unionAll(found.select("a", "b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row.

    Texts whose fingerprints differ in up to ``distance`` bits are linked; a
    component is named by its smallest ``doc_id``. Equal fingerprints, repeated
    rows and texts without a word (fingerprint 0) are linked like any others. A
    row without ``doc_id`` has the component of its fingerprint, which is null if no
    row with that fingerprint has an id. Other columns are ignored.
    """
    prints = stored(fingerprints(docs, shingle), "simhash-prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    named = classes.where("first IS NOT NULL")
    pairs = near_pairs(named.select("fp"), distance)
    left = named.select(F.col("fp").alias("a"), F.col("first").alias("first_a"))
    right = named.select(F.col("fp").alias("b"), F.col("first").alias("first_b"))
    links = pairs.join(left, "a").join(right, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    roots = connected_components(links, "simhash-links").withColumnRenamed("node", "first")
    labels = classes.join(roots, "first", "left").select("fp", F.coalesce("root", "first").alias("component_id"))
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = 2) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` names their component: one document of each group, and rows without an id."""
    kept = near_duplicates(docs, shingle, distance).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))


def fingerprint_text(fp: Column) -> Column:
    """Sixteen lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
