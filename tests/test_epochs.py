"""Versions of an index: one writer wins, readers stay where they are, failures are counted."""

import pytest

from lodeline.api import Index
from lodeline.epochs import Conflict, Folder, Versions


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "one.py").write_text("def one():\n    return two()\n\ndef two():\n    return 2\n")
    (root / "broken.py").write_text("def broken(:\n")
    return root


def test_one_of_two_writers_wins(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/v")
    ours, theirs = Versions(folder), Versions(folder)
    assert ours.read() is None and ours.all() == []
    assert ours.commit(0, {"epoch": "epoch-1"}) == 1
    with pytest.raises(Conflict):
        theirs.commit(0, {"epoch": "epoch-2"})
    assert theirs.read() == {"epoch": "epoch-1", "version": 1} and theirs.commit(1, {"epoch": "epoch-3"}) == 2
    assert ours.read(1)["epoch"] == "epoch-1" and ours.read()["epoch"] == "epoch-3"
    assert [n for n in folder.names("versions") if n.startswith(".") and not n.endswith(".crc")] == []


def test_a_file_system_that_is_not_local(spark, tmp_path):
    """By a mount that only Hadoop knows: moved without overwriting there, too."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    (tmp_path / "mounted").mkdir()
    conf.set("fs.viewfs.mounttable.epochs.link./d", f"file://{tmp_path}/mounted")
    folder = Folder(spark, "viewfs://epochs/d/index")
    versions = Versions(folder)
    assert versions.commit(0, {"epoch": "epoch-1"}) == 1
    with pytest.raises(Conflict):
        versions.commit(0, {"epoch": "epoch-2"})
    spark.range(3).write.parquet(folder.at("epoch-1", "t"))
    assert spark.read.parquet(folder.at(versions.read()["epoch"], "t")).count() == 3 and set(folder.names()) == {"versions", "epoch-1"}


def test_build_counts_errors_and_readers_stay(spark, tmp_path, tree, monkeypatch):
    uri = f"file://{tmp_path}/index"
    writer = Index(spark, uri)
    assert writer.manifest() is None
    counts = writer.build(str(tree))
    assert (counts["files"], counts["errors"]) == (2, 1)
    reader, late = Index(spark, uri), Index(spark, uri, version=1)
    assert reader.table("files").count() == 2
    (tree / "three.py").write_text("def three():\n    return 3\n")
    assert writer.build(str(tree))["files"] == 3
    assert [i.table("files").count() for i in (writer, reader, late)] == [3, 2, 2]
    assert reader.refresh() == 2 and reader.table("files").count() == 3
    assert reader.config()["counts"]["errors"] == 1 and reader.config()["versions"] == 2

    # Another build commits while this one runs: this one leaves nothing behind.
    slow, before = Index(spark, uri), set(writer.folder.names())
    commit = slow.versions.commit
    monkeypatch.setattr(slow.versions, "commit", lambda base, manifest: (Versions(slow.folder).commit(base, {"epoch": reader.epoch()}), commit(base, manifest)))
    with pytest.raises(Conflict):
        slow.build(str(tree))
    assert set(writer.folder.names()) == before and writer.versions.all() == [1, 2, 3]

    assert writer.versions.vacuum(keep=1, grace_seconds=3600) == []
    spark.range(1).write.parquet(writer.folder.at("epoch-lost", "files"))
    gone = writer.versions.vacuum(keep=1, grace_seconds=0)
    assert "epoch-lost" in gone and reader.epoch() not in gone and writer.versions.all() == [3]
    assert reader.table("files").count() == 3
    assert writer.reset("vectors") == [] and writer.reset("index", dry_run=True) == sorted(["versions", reader.epoch()], key=lambda n: n != "versions")
    assert set(writer.reset()) == {"versions", reader.epoch()} and writer.manifest() is None
