"""Stored upserts: counts, versions, runs again, half-written merges, children."""

from pyspark.sql import functions as F

from regulith.operators.stored import Store


def rows(store):
    return sorted((tuple(r) for r in store.read().collect()), key=repr)


def test_merge_counts_versions_and_runs_again(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", "k string, d int, v double", ["k", "d"], 4)
    new = lambda x: spark.createDataFrame(x, "k string, d int, v double")
    assert rows(store) == [] and store.version() == 0
    first = [("a", 1, 1.0), ("a", 2, None), (None, 1, 3.0)]
    assert store.merge(new(first)) == {"inserted": 3, "updated": 0, "skipped": 0, "removed": 0}
    assert store.merge(new(first)) == {"inserted": 0, "updated": 0, "skipped": 3, "removed": 0}
    assert store.version() == 1, "a merge that changes nothing leaves the store as it is"
    got = store.merge(new([("a", 1, 1.0), ("a", 2, 5.0), ("b", 1, 1.0)]))
    assert got == {"inserted": 1, "updated": 1, "skipped": 1, "removed": 0}
    assert rows(store) == sorted([("a", 1, 1.0, 1), ("a", 2, 5.0, 2), (None, 1, 3.0, 1), ("b", 1, 1.0, 1)], key=repr)
    assert store.merge(new([])) == {"inserted": 0, "updated": 0, "skipped": 0, "removed": 0}
    got = store.merge(new([("c", 1, 1.0), ("c", 1, 9.0), ("c", 1, 4.0)]), [F.col("v")])
    assert got["inserted"] == 1 and ("c", 1, 9.0, 1) in rows(store)


def test_buckets_without_new_rows_are_not_written(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", "k int, v int", ["k"], 8)
    store.merge(spark.range(200).selectExpr("CAST(id AS INT) AS k", "1 AS v"))
    store.merge(spark.createDataFrame([(3, 2)], "k int, v int"))
    versions = store.manifest()
    assert sorted(versions) == list(range(8)) and sorted(versions.values()).count(2) == 1
    assert store.read().count() == 200 and store.read().filter("version = 2").count() == 1


def test_half_written_merge_is_not_read(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", "k int, v int", ["k"], 2)
    store.merge(spark.createDataFrame([(1, 1)], "k int, v int"))
    spark.createDataFrame([(1, 7, 2, "updated", 0), (1, 7, 2, "updated", 1)], "k int, v int, version long, _kind string, _bucket int").write.partitionBy("_bucket").parquet(f"{tmp_path}/s/data/2")
    (tmp_path / "s" / "manifest" / "2").mkdir()
    assert rows(store) == [(1, 1, 1)]
    assert store.merge(spark.createDataFrame([(1, 5)], "k int, v int"))["updated"] == 1 and rows(store) == [(1, 5, 2)]


def test_children_are_replaced_with_their_parents(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", "p int, gap string", ["p"], 3)
    new = lambda x: spark.createDataFrame(x, "p int, gap string")
    parents = lambda *x: spark.createDataFrame([(i,) for i in x], "p int")
    assert store.replace_children(parents(1, 2), new([(1, "a"), (1, "a"), (1, "b"), (2, "c")]))["inserted"] == 4
    assert store.replace_children(parents(1), new([(1, "a"), (1, "d")])) == {"inserted": 1, "updated": 0, "skipped": 1, "removed": 2}
    assert [r[:2] for r in rows(store)] == [(1, "a"), (1, "d"), (2, "c")]
    n = store.version()
    assert store.replace_children(parents(1), new([(1, "a"), (1, "d")]))["skipped"] == 2 and store.version() == n
    assert store.replace_children(parents(2), new([]))["removed"] == 1
    assert [r[:2] for r in rows(store)] == [(1, "a"), (1, "d")]
    assert store.replace_children(parents(), new([]))["removed"] == 0
