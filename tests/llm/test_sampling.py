"""Samples that must not depend on the layout or on copies: segmentations, and texts to learn languages from."""

from pyspark.sql import functions as F

from telemill.llm import language, segmentation

SF = "/root/testdata/sf0.001"


def test_segmentations_depend_on_the_row_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 5000").limit(40)
    docs = docs.unionByName(spark.createDataFrame([(-1, "a b"), (-2, None), (-3, "日本 😀 x")], docs.schema)).cache()

    def rows(df):
        return {tuple(map(str, r)) for r in segmentation.encode_samples(df, samples=3).collect()}

    want = rows(docs.coalesce(1))
    assert rows(docs.repartition(5).sortWithinPartitions(F.desc("doc_id"))) == want
    assert rows(docs.unionAll(docs.orderBy(F.desc("doc_id"))).coalesce(1)) == want
    alone = docs.where("doc_id = -3 OR doc_id % 20 = 0").collect()
    assert len(alone) > 1
    for row in alone:
        found = rows(spark.createDataFrame([row], docs.schema))
        assert found == {r for r in want if r[0] == str(row.doc_id)}


def test_copies_do_not_thin_out_what_is_learned(spark):
    docs = spark.range(30000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text number "), (F.col("id") % 60).cast("string")).alias("text"), F.lit("xx").alias("lang")
    )
    assert len(language.training_sample(docs)) == 60
    few = docs.withColumn("text", F.concat("text", F.lit(" "), F.col("doc_id").cast("string")))
    assert len(language.training_sample(few)) == language.SAMPLE_DOCS


def test_every_language_is_learned(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"),
        F.concat(F.lit("l"), (F.col("id") % 250).cast("string")).alias("lang"),
    )
    assert len({lang for lang, _ in language.training_sample(docs)}) == 250
