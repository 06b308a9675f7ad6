"""Very many small files and splits: what is read, and by how many tasks."""

import pytest

from telemill.sources import batches, catalog
from workloads import fixtures


def schema_files(root, faulty=False):
    for k in range(7):
        folder = root / ["a b", "c+d", "e{x}", "f"][k % 3]
        folder.mkdir(parents=True, exist_ok=True)
        text = '{"name":"type-%d","orderedColumns":[{"name":"ingest_time","type":"datetime"},{"name":"v","type":"int"}]}' % k
        (folder / f"type-{k}.json").write_text("{bad" if faulty and k % 2 else text)
    (root / "f").mkdir()
    (root / "no-folder.json").write_text("{}")
    (root / "f" / "rows").mkdir()
    return str(root)


@pytest.mark.parametrize("group", [1, 3, 6, 7])
def test_a_catalog_of_many_files_is_that_of_few(spark, tmp_path, monkeypatch, group):
    root, bad = schema_files(tmp_path / "fine"), schema_files(tmp_path / "bad", faulty=True)
    want = sorted(catalog.discover_catalog(spark, root).collect())
    want_bad = [sorted(x.collect()) for x in catalog.discover_catalog_lenient(spark, bad)]
    assert len(want) == 7 and [len(x) for x in want_bad] == [4, 3]
    monkeypatch.setattr(catalog, "GROUP_FILES", group, raising=False)
    found = catalog.discover_catalog(spark, root)
    assert sorted(found.collect()) == want
    # Beyond a group the files themselves are read once, into a copy.
    assert all(("schema-files" in x) == (group < 7) for x in found.inputFiles())
    assert [sorted(x.collect()) for x in catalog.discover_catalog_lenient(spark, bad)] == want_bad
    with pytest.raises(catalog.CatalogError, match="type-1.json"):
        catalog.discover_catalog(spark, bad)


def test_schema_files_are_written_by_many_tasks(spark, tmp_path):
    spark.range(60).selectExpr("id AS s_suppkey", "cast(id % 4 AS int) AS s_nationkey", "1.5D AS s_acctbal").coalesce(1).write.parquet(
        f"{tmp_path}/supplier.parquet"
    )
    root = fixtures.sidecar_root(spark, str(tmp_path), faulty=False)
    files = spark.read.text(f"{root}/*/*.json").inputFiles()
    assert len(files) == 60
    assert len({x.rsplit("/part-", 1)[1][:5] for x in files}) > 1


def test_small_splits_share_tasks_and_many_are_read_file_by_file(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for name in ("a b", "c{d}", "e"):
        (tmp_path / "in" / f"{name}.txt").write_text("".join(f"{name} {'x' * (n % 37)}{n}\n" for n in range(3000)))
    (tmp_path / "in" / "empty.txt").write_text("")
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    want = sorted(map(tuple, batches.read_batches(spark, str(tmp_path / "in")).collect()))
    assert len(want) == 9000 and all(b.split()[-1].lstrip("x") == i.rsplit(":", 1)[1] for i, b in want)
    try:
        spark.conf.set(size, "300")
        found = batches.read_batches(spark, str(tmp_path / "in"))
        # Some 700 splits, in no more tasks than some for each core.
        assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert sorted(map(tuple, found.collect())) == want
        for most in (50, 500):
            monkeypatch.setattr(batches, "MANY_SPLITS", most)
            found = batches.read_batches(spark, str(tmp_path / "in"))
            assert all("numbered" in x for x in found.inputFiles())
            assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
            assert sorted(map(tuple, found.collect())) == want
    finally:
        spark.conf.set(size, before)
