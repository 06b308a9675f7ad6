"""WARC records, and a fixity audit of replicas by Merkle trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telemill.llm.common import stored

FANOUT = 16
RECORDS = 256  # ids of a file


def warc_record(url: Column, payload: Column) -> Column:
    """Bytes of a WARC ``resource`` record; a null address or payload is written as an empty one."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20]", "%20"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.sha1(body),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def parse_record(record: Column) -> Column:
    """``struct(url, content_length, payload)`` of a record's bytes; null fields where a header is missing."""
    head = F.substring_index(record.cast("string"), "\r\n\r\n", 1)
    length = F.nullif(F.regexp_extract(head, r"Content-Length: ([0-9]{1,9})\b", 1), F.lit("")).cast("int")
    url = F.nullif(F.regexp_extract(head, r"WARC-Target-URI: ([^\r\n]*)", 1), F.lit(""))
    payload = F.substr(record, F.octet_length(head) + 5, length)
    return F.struct(url.alias("url"), length.cast("bigint").alias("content_length"), payload.alias("payload"))


def warc_layout(pages: DataFrame, per_file: int = RECORDS) -> DataFrame:
    """``(page_id, file, slot, record)``: each page as a record, and its place in the files.

    A file takes ``per_file`` neighbouring ids, and a slot is an id's place among them. Where
    ids are repeated so often that a range has more rows, it is split into as many files as keep that size,
    by the record's hash. Rows with a null id share a range of their own. Other columns are ignored.
    """
    number = F.floor(F.col("page_id") / per_file).cast("bigint")
    rows = pages.select(
        "page_id",
        number.alias("range"),
        F.coalesce(F.col("page_id") - number * per_file, F.lit(0)).cast("bigint").alias("slot"),
        warc_record(F.col("url"), F.col("html")).alias("record"),
    )
    crowded = pages.groupBy(number.alias("r")).agg(F.ceil(F.count("*") / per_file).alias("splits")).where("splits > 1")
    rows = rows.join(stored(crowded, "warc-crowded"), F.col("range").eqNullSafe(F.col("r")), "left")
    split = F.pmod(F.xxhash64("record"), F.coalesce("splits", F.lit(1)))
    file = F.concat_ws("-", F.lit("pages"), F.coalesce(F.col("range").cast("string"), F.lit("none")), split.cast("string"))
    return rows.select("page_id", file.alias("file"), "slot", "record")


def with_offsets(records: DataFrame) -> DataFrame:
    """Records with the ``offset`` and ``length`` at which they stand in their file, in the order of their slots.

    Only lengths are summed up, and a file holds a bounded number of records.
    """
    order = Window.partitionBy("file").orderBy("slot", "sha")
    sized = records.withColumns({"length": F.octet_length("record").cast("bigint"), "sha": F.sha2("record", 256)})
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return sized.withColumn("offset", F.coalesce(before, F.lit(0))).drop("sha")


def leaves(records: DataFrame) -> DataFrame:
    """``(file, slot, sha, n, size)`` of a replica's records: the hash of what stands at each slot.

    A record that is repeated exactly counts once; several records of a slot are hashed in the order of their hashes.
    """
    hashed = records.select("file", "slot", F.sha2("record", 256).alias("sha"), F.octet_length("record").alias("size"))
    found = F.sort_array(F.collect_set(F.struct("sha", "size")))
    return (
        hashed.where("file IS NOT NULL AND slot IS NOT NULL").groupBy("file", "slot").agg(found.alias("of"))
        .select(
            "file", "slot", F.sha2(F.concat_ws(":", F.transform("of", lambda x: x["sha"])), 256).alias("sha"),
            F.size("of").cast("bigint").alias("n"),
            F.aggregate("of", F.lit(0).cast("bigint"), lambda total, x: total + x["size"]).alias("size"),
        )
    )


def merkle_levels(replica: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the trees of all files, leaves first: ``(file, node, first, size, sha)``.

    A node joins the hashes of up to ``fanout`` neighbours below and stands for their range: ``size`` bytes from slot ``first`` on.
    The last level holds roots only. A null-free ``(file, slot)`` is a leaf.
    """
    level = stored(
        replica.select("file", F.col("slot").alias("node"), F.col("slot").alias("first"), "size", "sha"), "merkle-0"
    )
    out = [level]
    top = level.agg(F.max("node").alias("n")).first()["n"] or 0
    while top:
        parts = F.transform(
            F.sort_array(F.collect_list(F.struct("node", "sha", "size"))),
            lambda x: F.concat_ws(":", x["node"].cast("string"), x["sha"], x["size"].cast("string")),
        )
        level = level.groupBy("file", F.floor(F.col("node") / fanout).alias("parent")).agg(
            F.min("first").alias("first"), F.sum("size").alias("size"), F.sha2(F.concat_ws("\n", parts), 256).alias("sha")
        )
        level = stored(level.withColumnRenamed("parent", "node"), f"merkle-{len(out)}")
        out.append(level)
        top //= fanout
    return out


def audit(first: DataFrame, second: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``(file, slot, kind, depth)`` of the leaves in which two replicas, given as ``leaves``, differ.

    Roots are compared first; from then on only children of nodes that differ are looked at, level by level, ``depth`` in all.
    ``kind`` is ``changed``, ``missing`` (not in the second replica) or ``extra`` (not in the first). Equal replicas give no row;
    an empty one misses all of the other.
    """
    mine, theirs = merkle_levels(first, fanout), merkle_levels(second, fanout)
    depth = max(len(mine), len(theirs))
    # A replica that ends sooner has roots of lower ranges only: their ancestors are just theirs.
    suspects = None
    for number in reversed(range(min(len(mine), len(theirs)))):
        a = mine[number].select("file", "node", F.col("sha").alias("sha_a"))
        b = theirs[number].select("file", "node", F.col("sha").alias("sha_b"))
        if suspects is not None:
            parents = suspects.select("file", F.col("node").alias("parent"))
            a, b = (
                x.withColumn("parent", F.floor(F.col("node") / fanout))
                .join(parents, ["file", "parent"], "left_semi")
                .drop("parent")
                for x in (a, b)
            )
        different = a.join(b, ["file", "node"], "full").where(~F.col("sha_a").eqNullSafe(F.col("sha_b")))
        suspects = stored(different, f"audit-{number}")
    kind = F.when(F.col("sha_b").isNull(), "missing").when(F.col("sha_a").isNull(), "extra").otherwise("changed")
    return suspects.select("file", F.col("node").alias("slot"), kind.alias("kind"), F.lit(depth).alias("depth"))
