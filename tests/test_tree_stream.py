"""Creates, changes and removals in one stream; an index that follows; subscribers of which one goes."""

import os
import time

from lodeline.streaming import events, files


def settled(query, listener, epoch):
    deadline = time.time() + 90
    while listener.epoch < epoch and time.time() < deadline:
        assert query.exception() is None
        time.sleep(0.2)
    return listener.epoch


def test_a_tree_followed(spark, tmp_path):
    root, seen = tmp_path / "tree", []
    (root / "a").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / ".git/x").write_text("no")
    (root / "a/one.py").write_text("1")
    (root / "two.py").write_text("2")
    spark.dataSource.register(files.TreeChanges)
    stream = spark.readStream.format("lodeline_tree").option("root", str(root)).option("state", str(tmp_path / "state")).load()
    listener, told, once = files.Reindexed("follow"), [], []
    listener.subscribe(told.append)
    listener.subscribe(lambda event: once.append(event) or False)
    spark.streams.addListener(listener)

    def apply(rows, epoch):
        seen.extend((epoch, r.deleted, r.path) for r in rows.collect())

    def start():
        return events.reindex(stream, apply, str(tmp_path / "events"), str(tmp_path / "checkpoint"), name="follow")

    query = start()
    try:
        assert settled(query, listener, 1) == 1
        assert sorted(seen) == [(0, False, "a/one.py"), (0, False, "two.py")]
        (root / "a/one.py").write_text("1 and more")
        (root / "two.py").unlink()
        (root / "a/three.py").write_text("3")
        seen.clear()
        assert settled(query, listener, 2) >= 2
        time.sleep(1)
        assert {(d, p) for _, d, p in seen} == {(True, "two.py"), (False, "a/one.py"), (False, "a/three.py")}
        by_epoch = [(epoch, not deleted) for epoch, deleted, _ in seen]
        assert by_epoch == sorted(by_epoch)  # removals first
    finally:
        query.stop()
        query.awaitTermination(30)
    # Gone while nobody looked; the checkpoint knows what was there.
    os.remove(root / "a/three.py")
    seen.clear()
    before, query = listener.epoch, start()
    try:
        assert settled(query, listener, before + 1) == before + 1
        assert [(d, p) for _, d, p in seen] == [(True, "a/three.py")]
    finally:
        query.stop()
        spark.streams.removeListener(listener)
    notes = spark.read.parquet(str(tmp_path / "events")).orderBy("epoch").collect()
    assert len(notes) == listener.epoch and all(n.last_reindex_ms >= 0 for n in notes)
    assert [e["epoch"] for e in told] == list(range(1, listener.epoch + 1)) and len(once) == 1 and listener.subscribers == 1
    assert listener.last_reindex_ms > 0 and told[0]["files"] == 2
    listener.clear()
    assert listener.subscribers == 0


def test_offsets_are_listings(tmp_path):
    (tmp_path / "t").mkdir()
    reader = files._Reader(str(tmp_path / "t"), str(tmp_path / "s"), ())
    assert reader.latestOffset() == {"listing": 0} and reader.partitions({"listing": 0}, {"listing": 0}) == []
    (tmp_path / "t/x").write_text("1")
    assert reader.latestOffset() == {"listing": 1} == reader.latestOffset()
    (tmp_path / "t/x").unlink()
    assert reader.latestOffset() == {"listing": 2}
    rows = [list(files._Reader(str(tmp_path / "t"), str(tmp_path / "s"), ()).read(p)) for p in reader.partitions({"listing": 1}, {"listing": 2})]
    assert [(r[0], r[1]) for r in rows[0]] == [("x", True)]
    reader.commit({"listing": 2})
    assert reader._numbers() == [2]


def test_a_raising_subscriber_is_dropped():
    listener, told = files.Reindexed(), []
    listener.subscribe(lambda event: 1 / 0)
    listener.subscribe(told.append)
    listener.tell(3, 12)
    listener.tell(1, 7)
    assert [(e["files"], e["epoch"]) for e in told] == [(3, 1), (1, 2)] and listener.subscribers == 1 and listener.last_reindex_ms == 7
