import pytest
from pyspark.sql import functions as F

from lodeline.llm import compaction, storage


@pytest.fixture()
def store(spark, docs):
    return compaction.Store(spark, storage.new_dir(spark, "store"), docs.schema)


def rows(df):
    return sorted(map(str, df.collect()))


def test_round_trip_through_versions(spark, docs, store):
    store.append(docs, F.pmod("doc_id", F.lit(5)))
    assert store.versions() == [1, 2, 3, 4, 5]
    before = store.shards()
    assert rows(store.read()) == rows(docs) and rows(store.read(1)) == rows(docs.where("doc_id % 5 = 0"))
    made = store.compact(target_bytes=1 << 20, fan_in=4)
    assert made == [6] and len(store.shards()) < len(before)
    assert rows(store.read()) == rows(docs) and rows(store.read(5)) == rows(docs)
    assert sum(s["rows"] for s in store.shards()) == docs.count()
    assert store.vacuum() == len(before)
    assert store.versions() == [6] and rows(store.read()) == rows(docs)


def test_merge_goes_to_target_sized_files(spark, docs, store):
    for _ in range(8):
        store.append(docs.coalesce(1))
    size = store.shards()[0]["bytes"]
    store.compact(target_bytes=size * 4, fan_in=4)
    assert len(store.shards()) < 8 and all(s["bytes"] < size * 8 for s in store.shards())
    assert store.read().count() == 8 * docs.count()


def test_a_version_is_committed_once(store):
    assert store._commit(1, []) and not store._commit(1, [{"path": "x", "bytes": 1, "rows": 1}])
    assert store.shards() == []
    assert store.commit([], {"gone"}) is None


def test_tiers():
    assert [compaction.tier(n << 20, 4) for n in (0, 1, 3, 4, 15, 16, 64)] == [0, 1, 1, 2, 2, 3, 4]


def test_empty_and_clashing_names(spark, no_docs, store):
    assert store.read().count() == 0 and store.compact() == []
    store.append(no_docs)
    assert store.versions() == [1] and store.read().count() == 0
    df = spark.createDataFrame([(1, None)], "arrival long, text string")
    other = compaction.Store(spark, storage.new_dir(spark, "store"), df.schema)
    other.append(df, F.lit(3))
    assert other.read().collect() == df.collect()
