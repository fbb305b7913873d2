"""A tree of files as a stream of changes, removals among them (ST01), and who hears of them (ST05, ST06).

    spark.dataSource.register(TreeChanges)
    spark.readStream.format("lodeline_tree").option("root", ...).option("state", ...).load()

An offset is the number of a listing, kept below ``state`` as Parquet; a batch is
the difference of two of them: path, deleted, size, mtime, at. The first batch
has every file as new. A stream that starts again from its checkpoint reads
the same listings, so what was seen before a failure is told apart from what came after it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQueryListener

from lodeline.sources.tree import _children, open_fs

#: Changes that one task makes rows of.
PART = 10_000


class TreeChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodeline_tree"

    def schema(self) -> str:
        return "path string, deleted boolean, size long, mtime long, at timestamp"

    def streamReader(self, schema) -> DataSourceStreamReader:
        pruned = tuple(filter(None, self.options.get("pruned", ".git").split(",")))
        return _Reader(self.options["root"], self.options["state"], pruned)


class _Part(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str, state: str, pruned: tuple[str, ...]):
        self.root, self.state, self.pruned = root, state, pruned

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        numbers = self._numbers()
        last = numbers[-1] if numbers else 0
        found = self._walk()
        if found == self._kept(last):
            return {"listing": last}
        self._keep(last + 1, found)
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = self._kept(start["listing"]), self._kept(end["listing"])
        changes = [(path, False, *after[path]) for path in sorted(after) if before.get(path) != after[path]]
        changes += [(path, True, None, None) for path in sorted(before.keys() - after.keys())]
        stamp = self._stamp(end["listing"])
        return [_Part([(*c, stamp) for c in changes[i : i + PART]]) for i in range(0, len(changes), PART)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from datetime import datetime, timezone

        for *values, stamp in partition.rows:
            yield (*values, datetime.fromtimestamp(stamp, timezone.utc))

    def commit(self, end: dict) -> None:
        """Listings before the last one done are no batch's start any more."""
        fs, base = open_fs(self.state)
        for number in self._numbers():
            if number < end["listing"]:
                fs.delete_file(f"{base}/{number:012d}.parquet")

    def _walk(self) -> dict[str, tuple[int, int | None]]:
        fs, base = open_fs(self.root)
        todo, found = [""], {}
        while todo:
            inner, files = _children(fs, base, todo.pop(), self.pruned)
            todo += inner
            found |= {path: (size, mtime) for path, size, mtime in files}
        return found

    def _numbers(self) -> list[int]:
        fs, base = open_fs(self.state)
        fs.create_dir(base, recursive=True)
        names = [i.base_name for i in fs.get_file_info(pa.fs.FileSelector(base))]
        return sorted(int(n[: -len(".parquet")]) for n in names if n.endswith(".parquet"))

    def _kept(self, number: int) -> dict[str, tuple[int, int | None]]:
        if not number:
            return {}
        fs, base = open_fs(self.state)
        table = pq.read_table(f"{base}/{number:012d}.parquet", filesystem=fs)
        return {p: (s, m) for p, s, m in zip(*(table.column(c).to_pylist() for c in ("path", "size", "mtime")))}

    def _stamp(self, number: int) -> float:
        fs, base = open_fs(self.state)
        return float(pq.read_schema(f"{base}/{number:012d}.parquet", filesystem=fs).metadata[b"at"]) if number else 0.0

    def _keep(self, number: int, found: dict[str, tuple[int, int | None]]) -> None:
        """A listing appears whole under its number."""
        fs, base = open_fs(self.state)
        rows = [(path, *found[path]) for path in sorted(found)]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
        table = pa.Table.from_arrays(columns, names=["path", "size", "mtime"]).replace_schema_metadata({"at": str(time.time())})
        private = f"{base}/.{uuid.uuid4().hex}"
        pq.write_table(table, private, filesystem=fs)
        fs.move(private, f"{base}/{number:012d}.parquet")


class Reindexed(StreamingQueryListener):
    """Counts the batches of a query that had rows (``epoch``), keeps how long the last one took, and tells subscribers.

    A subscriber is called with an event; one that raises or returns False is gone and is told nothing more.
    """

    def __init__(self, name: str | None = None):
        self.name, self.epoch, self.last_reindex_ms = name, 0, 0
        self._subscribers: list[Callable[[dict], object]] = []

    def subscribe(self, send: Callable[[dict], object]) -> None:
        self._subscribers.append(send)

    @property
    def subscribers(self) -> int:
        return len(self._subscribers)

    def clear(self) -> None:
        self._subscribers.clear()

    def tell(self, files: int, took_ms: int) -> None:
        self.epoch, self.last_reindex_ms = self.epoch + 1, took_ms
        event = {"event": "reindexed", "files": files, "epoch": self.epoch, "ts": int(time.time())}
        self._subscribers[:] = [send for send in self._subscribers if _alive(send, event)]

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.numInputRows and (self.name is None or progress.name == self.name):
            self.tell(progress.numInputRows, int(progress.durationMs.get("triggerExecution", 0)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _alive(send: Callable[[dict], object], event: dict) -> bool:
    try:
        return send(event) is not False
    except Exception:
        return False
