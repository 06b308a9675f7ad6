"""Registered queries against their SQL, the pipeline against its stages, and the repository without both."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from telemill.llm.oracles import ORACLES
from telemill.llm.queries import QUERIES
from workloads import compare

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name, monkeypatch):
    monkeypatch.setattr(compare, "QUERIES", QUERIES)
    monkeypatch.setattr(compare, "ORACLES", ORACLES)
    assert compare.compare(spark, compare.connect(SF), SF, name) is None


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns, name
            assert docs.where("n_chars <> length(text)").count() == 0
        if i < 3:
            assert 0 < docs.count() <= before
            before = docs.count()
    assert docs.where("NOT round_trip").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))


def test_pipeline_stages_take_odd_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    text = "Some plain words that make up a line, and so it is kept in the end."
    rows = [(None, None, None, None, None), (1, text, None, None, None), (1, text, None, None, None), (2, "", "en", "a", 0)]
    for docs in (spark.createDataFrame([], schema), spark.createDataFrame(rows, schema).withColumn("kept_row", F.lit(1))):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).collect()


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n[:3] in ('op1', 'op2', 'pip') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)
