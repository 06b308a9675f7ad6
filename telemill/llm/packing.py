"""Packing by powers of two: documents are cut into binary lengths, and equal lengths share a bucket of sequences."""

from __future__ import annotations

import base64
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from telemill.llm.common import pieces, stored
from telemill.session import join_lookup

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
END_ID = 1
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
# Letters, marks and spaces that every version of Unicode puts into the same classes.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e¡-Ƞ‐-‧€]")


class Encoder:
    """Token ids as ``tokenizers`` gives them for a vocabulary, special tokens' strings being ordinary text.

    With ``ranks``, the same vocabulary for ``tiktoken``, plain texts are encoded by that, several times faster; the two
    libraries may class rare characters differently, so texts that have any go to ``tokenizers``.
    """

    def __init__(self, vocabulary: str = VOCABULARY, ranks: str | None = RANKS):
        self.whole = Tokenizer.from_file(vocabulary)
        self.whole.encode_special_tokens = True
        self.plain = None
        if ranks is not None:
            with open(ranks, "rb") as file:
                merges = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
            pattern = public_tokenizers.PATTERN
            self.plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.plain is None or _UNUSUAL.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.plain.encode_ordinary(text), "<u4")


def binary_lengths(total: int, capacity: int = CAPACITY) -> list[int]:
    """Full sequences first, then the powers of two in what is left, largest first."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if rest >> b & 1]


def cut_documents(docs: DataFrame, capacity: int, end_id: int, encoder: tuple, with_ids: bool) -> DataFrame:
    """A row per piece, with the task it was made in (``part``) and its place among that task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of, part = Encoder(*encoder).ids, TaskContext.get().partitionId()
        met: dict[int, int] = {}
        for batch in pieces(batches):
            owners, rows, ids = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                tokens = np.append(tokens_of(text or ""), np.uint32(end_id)).astype("<u4")
                start = 0
                for length in binary_lengths(len(tokens), capacity):
                    place = met[length] = met.get(length, 0) + 1
                    piece = tokens[start : start + length]
                    owners.append(i)
                    rows.append((start, length, zlib.crc32(piece.tobytes()), len(tokens), part, place - 1))
                    if with_ids:
                        ids.append(piece.astype(np.int32))
                    start += length
            numbers = np.array(rows, np.int64).reshape(-1, 6)
            columns = [batch.column(0).take(pa.array(owners, pa.int32())), *map(pa.array, numbers.T)]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([(n, c.type) for n, c in zip(names, columns)]))

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"] + ["ids"] * with_ids
    key = docs.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{n} bigint" for n in names[1:7])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, {numbers}" + ", ids array<int>" * with_ids)


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = True,
    vocabulary: str = VOCABULARY,
    ranks: str | None = RANKS,
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``, a row per piece.

    A document is its token ids with ``end_id`` behind them. It is cut into pieces of ``capacity`` (a power of two) and,
    for what is left, of the powers of two that add up to it. A piece is a sequence of its own, of its own
    length, so no sequence holds two documents and nothing is padded; ``offset`` is 0. Sequences of equal
    length are numbered one after the other, the longest first, from 0 and without gaps, so each length is a range of ids.

    A null text is empty, and an empty document is its ``end_id``. Rows that repeat, or
    have no ``doc_id``, are documents like others. Other columns are ignored. An empty table has no pieces.

    Texts are encoded once, without a shuffle. Pieces are numbered by the counts per task and length, a table
    of at most 12 rows a task (at the default capacity).
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    cut = stored(cut_documents(docs, capacity, end_id, (vocabulary, ranks), with_ids), "pack-pieces")
    counts = cut.groupBy("length", "part").count()
    so_far = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = F.sum("count").over(so_far) - F.col("count")
    counts = stored(counts.withColumn("earlier", earlier), "pack-counts")
    totals = counts.groupBy("length").agg(F.sum("count").alias("n"))
    longer = totals.select(F.col("length").alias("other"), F.col("n").alias("more"))
    # One row for each power of two up to the capacity.
    base = totals.join(F.broadcast(longer), F.col("other") > F.col("length"), "left").groupBy("length")
    base = base.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("base"))
    first = counts.join(F.broadcast(base), "length").select("length", "part", (F.col("base") + F.col("earlier")).alias("first"))
    numbered = join_lookup(cut, stored(first, "pack-first"), ["length", "part"])
    return numbered.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("place")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
        *["ids"] * with_ids,
    )

