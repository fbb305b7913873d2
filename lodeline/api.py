"""The engine's entry points: index a tree, then ask. Tables are Parquet, one folder per epoch, in any file system that Spark reads."""

from __future__ import annotations

import argparse
import json
import sys
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodeline.epochs import Conflict, Folder, Versions
from lodeline.functions.scalars import hotspot_hint, short_number, snippet, truncate_command
from lodeline.operators import architecture as A
from lodeline.operators import context as C
from lodeline.operators import crates
from lodeline.operators import evalkit as E
from lodeline.operators import extract as X
from lodeline.operators import graph as G
from lodeline.operators import handlers
from lodeline.operators import history as H
from lodeline.operators import incremental as I
from lodeline.operators import resolve as R
from lodeline.operators import search as S
from lodeline.operators import textfilter as T
from lodeline.sources import gitlog, scan

TABLES = ("files", "symbols", "chunks", "refs", "file_metrics", "arch_facts", "arch_modules", "commits", "commit_files", "change_coupling")


class Index:
    """A folder of versions. A reader stays with the version it began with (the latest, or a named one) until ``refresh``."""

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None):
        self.spark, self.folder = spark, Folder(spark, str(folder))
        self.versions = Versions(self.folder)
        self._pinned = self.versions.read(version) if version is not None else None

    def manifest(self) -> dict | None:
        """What the reader's version holds: epoch, root, counts; None before the first build."""
        if self._pinned is None:
            self._pinned = self.versions.read()
        return self._pinned

    def refresh(self) -> int | None:
        """Goes on to the latest version."""
        self._pinned = None
        return (self.manifest() or {}).get("version")

    def epoch(self) -> str:
        if (manifest := self.manifest()) is None:
            raise FileNotFoundError(f"{self.folder.uri} has no version yet")
        return manifest["epoch"]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.folder.at(self.epoch(), name))

    # -- building --

    def build(self, root: str, ignore: list[str] = (), overrides: list[tuple[str, str, float]] = (), index_generated: bool = False, days: int = 90, full: bool = False, since: str | None = None) -> dict[str, int]:
        """Scans, extracts, resolves and derives everything into a new epoch, then commits it as the next version.

        Raises ``Conflict`` (and drops the epoch) if another build has committed meanwhile.
        The counts returned have ``errors``, the files that didn't parse. Files whose hash the epoch before has are not read again by a parser, unless ``full``;
        ``since`` takes what git says has changed since a ref instead of comparing hashes.
        """
        spark, epoch = self.spark, f"epoch-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        base = self.refresh() or 0
        at = lambda name: self.folder.at(epoch, name)

        def store(name: str, df: DataFrame) -> DataFrame:
            df.write.mode("overwrite").parquet(at(name))
            return spark.read.parquet(at(name))

        found = scan.scan(spark, root, ignore)
        scan.guard(root, found)
        contents = store("_contents", found)
        files = store("files", contents.drop("content"))
        seen = Observation("extract")
        rows = store("_rows", X.observed(self._extracted(contents, root, index_generated, full, since), seen))
        symbols, raw, measured = store("symbols", X.symbols(rows)), X.refs(rows), X.metrics(rows)
        chunks = store("chunks", X.chunks(rows))
        store("postings", S.postings(chunks))
        manifests = contents.where(F.element_at(F.split("path", "/"), -1) == crates.MANIFEST).select("path", F.col("content").cast("string").alias("content"))
        refs = store("refs", self._resolve(raw, files, symbols, manifests))
        parsed = gitlog.log(spark, root, days)
        indexed = files.select(F.col("path").alias("file_path"), F.col("id").alias("file_id"))
        touched = parsed.join(indexed, "file_path").withColumn("commit_id", F.xxhash64("hash"))
        commits = store("commits", touched.select(F.col("commit_id").alias("id"), "hash", "author", F.col("ts").cast("timestamp").alias("at"), "message").dropDuplicates(["hash"]))
        commit_files = store("commit_files", touched.select("commit_id", "file_id", "file_path", "added", "deleted", "pos").dropDuplicates(["commit_id", "file_id"]))
        store("file_metrics", H.metrics(measured.select("file_id", "cyclomatic"), commits, commit_files, F.lit(int(time.time()))))
        store("change_coupling", H.coupling(commits, commit_files))
        edges = G.edges(refs)
        listed = files.join(measured.select(F.col("file_id").alias("id"), "is_entry"), "id", "left").withColumn("is_entry", F.coalesce("is_entry", F.lit(False)))
        facts = store("_facts", A.facts(listed, A.fuse_layers(listed, overrides), G.degrees(edges), G.pagerank(edges), G.scc(edges)))
        depth = G.depth(listed.where("is_entry").select("id"), edges).withColumnRenamed("depth", "depth_from_entry")
        members = facts.join(G.louvain(edges), "id", "left").join(depth, "id", "left").withColumn("module_id", F.coalesce("module_id", F.lit(-1).cast("long")))
        stored = store("arch_facts", members)
        inside = stored.where("module_id >= 0")
        store("arch_modules", A.modules(inside).join(A.labels(inside).select("module_id", "label"), "module_id"))
        counts = {"files": files.count(), "symbols": symbols.count(), "chunks": chunks.count(), "refs": refs.count(), "commits": commits.count(), "errors": seen.get["errors"]}
        try:
            self.versions.commit(base, {"epoch": epoch, "root": str(root), "counts": counts, "at": int(time.time())})
        except Conflict:
            self.folder.delete(epoch)
            raise
        self.refresh()
        return counts

    def _extracted(self, contents: DataFrame, root: str, index_generated: bool, full: bool, since: str | None) -> DataFrame:
        if full or self.manifest() is None:
            return X.extract(contents, index_generated)
        if since is None:
            changed = I.changed(contents, self.table("files"))
        else:
            touched = gitlog.changed_since(self.spark, root, since).select(F.col("file_path").alias("path"))
            changed = contents.join(touched, "path", "left_semi").unionByName(contents.join(self.table("files").select("path"), "path", "left_anti")).dropDuplicates(["path"])
        kept = contents.select(F.col("id").alias("file_id")).join(changed.select(F.col("id").alias("file_id")), "file_id", "left_anti")
        return X.extract(changed, index_generated).unionByName(self.table("_rows").join(kept, "file_id", "left_semi"))

    def _resolve(self, raw: DataFrame, files: DataFrame, symbols: DataFrame, manifests: DataFrame) -> DataFrame:
        wanted = raw.where("kind = 'import_binding'").join(files.select(F.col("id").alias("source_file_id"), "lang_family", "dir"), "source_file_id")
        paths = R.module_candidates(F.col("lang_family"), F.col("target_qualifier"), F.col("dir"))
        bound = R.resolve_modules(wanted.select("id", paths.alias("paths")), files, F.col("paths"))
        rust = crates.modules(wanted.where("lang_family = 'rust'").select("id", "dir", F.col("target_qualifier").alias("module")), files, manifests)
        bound = rust.unionByName(bound.join(rust, "id", "left_anti"))
        bindings = wanted.select("id", "source_file_id", "target_name").join(bound, "id", "left")
        bindings = R.chase_barrels(bindings.select("id", "source_file_id", "target_name", "target_file_id"), symbols)
        inherits = raw.where("kind = 'inherit' and target_qualifier is null")
        done = R.cascade(raw, files, symbols, bindings, R.mro(raw, files, symbols, inherits)).join(bindings.select("id", F.col("target_file_id").alias("bound_file")), "id", "left")
        return done.withColumn("target_file_id", F.coalesce("target_file_id", "bound_file")).drop("bound_file")

    def reset(self, scope: str = "all", dry_run: bool = False) -> list[str]:
        """Forgets what ``scope`` names and lists it: ``index`` (versions and epochs), ``vectors``, ``scip``, ``savings``, or ``all`` but the savings."""
        wanted = {"index": ("versions", "epoch-"), "vectors": ("vectors",), "scip": ("scip",), "savings": ("tracking",), "all": ("versions", "epoch-", "vectors", "scip")}[scope]
        gone = sorted((n for n in self.folder.names() if n.startswith(wanted)), key=lambda n: n != "versions")  # no version may name a lost epoch
        if not dry_run:
            for name in gone:
                self.folder.delete(name)
            self._pinned = None
        return gone

    # -- asking --

    def search(self, text: str, limit: int = 10, vectors: DataFrame | None = None, query_vector: list[float] | None = None) -> DataFrame:
        described = self._described_chunks()
        names = self.table("symbols").select("file_id", "name", "line").join(described.select(F.col("file_id"), "start_line", "end_line", F.col("id").alias("chunk_id")), "file_id").where("line between start_line and end_line")
        lists = {"fulltext": S.fulltext(described, text, 3 * limit, self.table("postings")), "symbol": S.symbols(names.select(F.col("chunk_id").alias("id"), "name"), text, 3 * limit)}
        if vectors is not None and query_vector is not None:
            lists["semantic"] = S.knn(vectors, query_vector, 3 * limit)
        terms = S.parse_query(text)
        shown = snippet(F.col("content"), terms).alias("snippet") if terms else F.lit(None).cast("string").alias("snippet")
        return S.fuse(lists, described, limit).join(described.select("id", "path", "start_line", "end_line", "kind", "scope", shown), "id").orderBy(F.desc("score"), "id")

    def _described_chunks(self) -> DataFrame:
        facts = self.table("arch_facts").select(F.col("id").alias("file_id"), "centrality")
        paths = self.table("files").select(F.col("id").alias("file_id"), "path")
        return self.table("chunks").join(paths, "file_id").join(facts, "file_id", "left")

    def get_symbols(self, text: str, limit: int = 10) -> DataFrame:
        found = S.symbols(self.table("symbols"), text, limit)
        return found.join(self.table("symbols"), "id").join(self.table("files").select(F.col("id").alias("file_id"), "path"), "file_id").orderBy("rank")

    def callers(self, symbol: str, limit: int = 20, min_confidence: float = 0.7, include_tests: bool = False, kinds: str = "both") -> DataFrame:
        return G.callers(self.table("refs"), self.table("files"), symbol, limit, min_confidence, include_tests, kinds)

    def impact(self, symbol: str, depth: int = 3, min_confidence: float = 0.7, kinds: str = "both") -> DataFrame:
        return G.impact(self.table("refs"), self.table("files"), symbol, depth, min_confidence, kinds)

    def risk(self, symbol: str, depth: int = 3, min_confidence: float = 0.7, kinds: str = "both") -> DataFrame:
        return G.risk(self.impact(symbol, depth, min_confidence, kinds))

    def _file(self, path: str) -> DataFrame:
        return I.fuzzy(self.table("files"), path).select(F.col("id").alias("file_id"))

    def history(self, path: str, symbol: str | None = None, limit: int = 30) -> DataFrame:
        """The latest commits of a file, those of one second in the log's order; with ``symbol``, only those that touched its lines, with where it stands."""
        own = self.table("commit_files").join(F.broadcast(self._file(path)), "file_id")  # one row
        commits = self.table("commits").withColumnRenamed("id", "commit_id")
        order = (F.desc("at"), "pos" if "pos" in own.columns else "commit_id")  # indexes of older builds have no positions
        found = commits.join(own, "commit_id").orderBy(*order)
        if symbol is None:
            return found.limit(limit).drop("pos")
        named = self.table("symbols").where(F.col("name") == symbol).groupBy("file_id").agg(F.min(F.struct("line", "end_line", "kind")).alias("s"))
        here = named.join(self._file(path), "file_id").join(self.table("files").select(F.col("id").alias("file_id"), "path"), "file_id")
        if (row := here.first()) is None:
            return found.limit(0).drop("pos")
        # Lines of an index count from 0, those of a diff from 1.
        lines = self.spark.createDataFrame([(row.file_id, row.path, row.s.line + 1, row.s.end_line + 1)], "symbol_id long, file_path string, first int, last int")
        traced = H.symbol_trace(lines, gitlog.hunks(self.spark, self.manifest()["root"], row.path)).select("hash", "nth")
        touched = found.join(traced, "hash").orderBy("nth").limit(limit)
        return touched.select("*", F.lit(symbol).alias("symbol"), F.lit(row.s.line).alias("line"), F.lit(row.s.end_line).alias("end_line"), F.lit(row.s.kind).alias("symbol_kind")).drop("pos", "nth")

    def context(self, path: str, budget: int = 20) -> DataFrame:
        """What to know before an edit of a file, as (section, item, value): its place, callers of its symbols, what it needs, what changes with it."""
        file = self._file(path).join(self.table("files").select(F.col("id").alias("file_id"), F.col("path")), "file_id").first()
        if file is None:
            return self.spark.createDataFrame([], "section string, item string, value string")
        refs = self.table("refs").withColumn("name", F.col("target_name"))
        paths = self.table("files").select(F.col("id").alias("target_file_id"), F.col("path").alias("target"))
        row = lambda df, section, item, value: df.select(F.lit(section).alias("section"), item.alias("item"), value.cast("string").alias("value"))
        facts = self.table("arch_facts").where(F.col("id") == file.file_id)
        place = row(facts, "place", F.col("path"), F.concat_ws(" ", "layer", "role", F.format_string("in=%d out=%d", "in_degree", "out_degree")))
        called = C.external_callers(self.table("symbols"), refs, self.table("files"), file.file_id).limit(budget)
        callers = row(called, "callers", F.concat_ws(" ", "kind", "name"), F.format_string("%d sure, %d possible, in %d files", "confident", "possible", "files"))
        needs = row(C.dependencies(refs, file.file_id, budget).join(paths, "target_file_id", "left"), "needs", F.col("name"), F.concat_ws(" ", "kind", "target"))
        near = H.coupled_with(self.table("change_coupling"), file.path, 5, distinct=True)
        coupled = row(near.where("score > 0.3"), "changes with", F.col("other"), F.format_string("%d%%", F.round(F.col("score") * 100).cast("int")))
        heat = row(self.table("file_metrics").where((F.col("file_id") == file.file_id) & (F.col("hotspot_score") > 0)), "hotspot", F.lit(file.path), F.format_string("changed %d times in 30 days, complexity %.0f", "changes_30d", "cyclomatic"))
        return reduce(DataFrame.unionByName, (place, heat, callers, needs, coupled))

    # -- outputs of programs --

    def proxy(self, command: str, output: str, errors: str = "", exit_code: int = 0) -> str:
        """A program's output as a reader needs it; what that saved is appended to the tracking table."""
        _, shown = handlers.handle(command, output, errors, exit_code)
        raw = output if not errors else f"{output}\n{errors}"
        row = [(command, handlers.tokens(raw), handlers.tokens(shown))]
        run = self.spark.createDataFrame(row, "command string, raw_tokens long, filtered_tokens long").withColumn("at", F.current_timestamp())
        run.write.mode("append").parquet(self.folder.at("tracking"))
        return shown

    def gain(self) -> DataFrame:
        """Savings as (section, item, value): in all, by day, by command."""
        rows = self.spark.read.schema("command string, raw_tokens long, filtered_tokens long, at timestamp").parquet(self.folder.at("tracking"))
        total = T.gain_totals(rows).select(F.lit("total").alias("section"), F.format_string("%d commands", "commands").alias("item"), F.format_string("%s saved (%.1f%%)", short_number(F.col("saved")), F.col("pct")).alias("value"))
        days = T.gain_daily(rows).select(F.lit("day"), F.col("day").cast("string"), short_number(F.col("saved")))
        best = T.gain_top(rows).select(F.lit("command"), truncate_command(F.col("command")), F.concat_ws(" ", short_number(F.col("saved")), F.repeat(F.lit("#"), F.round(F.col("pct") / 10).cast("int"))))
        return total.union(days).union(best)

    def rewrite(self, command: str) -> str | None:
        return self.spark.range(1).select(T.rewrite(F.lit(command)).alias("c")).first().c

    def ingest_scip(self, path: str) -> DataFrame:
        """Stores another indexer's occurrences and returns their summary."""
        at = self.folder.at("scip")
        E.read_scip(self.spark, path).write.mode("overwrite").parquet(at)
        return E.summary(self.spark.read.parquet(at))

    def embed(self, model, batch: int = 128) -> DataFrame:
        """Vectors of chunks that have none yet, by a callable; all vectors so far."""
        at = self.folder.at("vectors")
        empty = self.spark.createDataFrame([], "id long, embedding array<float>")
        have = self.spark.read.schema(empty.schema).parquet(at) if self.folder.exists("vectors") else empty
        languages = self.table("files").select(F.col("id").alias("file_id"), "language")
        S.embed(S.unembedded(self.table("chunks").join(languages, "file_id"), have), model, batch).write.mode("append").parquet(at)
        return self.spark.read.schema(empty.schema).parquet(at)

    def where(self, path: str) -> DataFrame:
        return self.table("arch_facts").join(F.broadcast(self._file(path)), F.col("id") == F.col("file_id")).drop("file_id")  # one row

    def map(self, limit: int = 15) -> DataFrame:
        paths = self.table("files").select(F.col("id").alias("file_id"), "path")
        hot = H.hotspots(self.table("file_metrics"), limit).join(paths, "file_id").select(F.lit("hotspot").alias("section"), F.col("path").alias("item"), F.col("hotspot_score").alias("score"))
        near = H.top(self.table("change_coupling"), limit, F.desc("score"), "file_a", "file_b").select(F.lit("coupling").alias("section"), F.concat_ws(" ", "file_a", "file_b").alias("item"), "score")
        counts = self.table("file_metrics").agg(F.count_if(F.col("hotspot_score") > 0).alias("hot")).join(F.broadcast(self.table("commits").agg(F.count(F.lit(1)).alias("n"))))  # one row each
        hint = counts.select(F.lit("hint").alias("section"), hotspot_hint(F.col("hot"), F.col("n")).alias("item"), F.lit(None).cast("double").alias("score")).where("item is not null")
        return hot.unionByName(near).unionByName(hint)

    def arch_map(self) -> DataFrame:
        return C.arch_map(self.table("arch_facts"))

    def stats(self) -> DataFrame:
        return I.stats({n: self.table(n) for n in TABLES})

    def config(self) -> dict:
        """Where the index is, what it was made from, and what its version holds."""
        manifest = self.manifest() or {}
        return {"folder": self.folder.uri, "version": manifest.get("version"), "versions": len(self.versions.all()), "root": manifest.get("root"), "counts": manifest.get("counts", {}), "built_at": manifest.get("at")}


def main(argv: list[str] | None = None) -> None:
    """A thin command line; every answer is JSON lines."""
    from lodeline.session import build

    parser = argparse.ArgumentParser(prog="lodeline")
    parser.add_argument("--index", default=".lodeline")
    sub = parser.add_subparsers(dest="command", required=True)
    commands = {"index": ["root"], "search": ["text"], "symbols": ["text"], "callers": ["symbol"], "impact": ["symbol"], "history": ["path"], "context": ["path"], "where": ["path"], "map": [], "arch-map": [], "stats": [], "config": [], "reset": [], "proxy": ["program"], "gain": [], "rewrite": ["program"], "scip": ["path"]}
    made = {name: sub.add_parser(name) for name in commands}
    for name, args in commands.items():
        for arg in args:
            made[name].add_argument(arg)
    for name in ("callers", "impact"):
        made[name].add_argument("--min-confidence", type=float, default=0.7)
        made[name].add_argument("--kinds", nargs="*", default=None, help="calls, types, inherits; all by default")
    for name, most in (("search", 10), ("symbols", 10), ("callers", 20), ("history", 30), ("map", 15)):
        made[name].add_argument("--limit", type=int, default=most)
    made["callers"].add_argument("--include-tests", action="store_true")
    made["impact"].add_argument("--depth", type=int, default=3)
    made["impact"].add_argument("--rows", action="store_true", help="the callers themselves instead of the risk")
    made["history"].add_argument("--symbol")
    made["proxy"].add_argument("--exit-code", type=int, default=0)
    for flag in ("--full", "--index-generated"):
        made["index"].add_argument(flag, action="store_true")
    made["index"].add_argument("--since")
    made["reset"].add_argument("--scope", choices=("all", "index", "vectors", "scip", "savings"), default="all")
    made["reset"].add_argument("--dry-run", action="store_true")
    given = parser.parse_args(argv)
    index = Index(build(), given.index)
    kinds = lambda: next(k for k, v in G.KINDS.items() if v == G.kind_filter(given.kinds))
    run = {
        "index": lambda: index.build(given.root, index_generated=given.index_generated, full=given.full, since=given.since),
        "search": lambda: index.search(given.text, given.limit),
        "symbols": lambda: index.get_symbols(given.text, given.limit),
        "callers": lambda: index.callers(given.symbol, given.limit, given.min_confidence, given.include_tests, kinds()),
        "impact": lambda: (index.impact if given.rows else index.risk)(given.symbol, given.depth, given.min_confidence, kinds()),
        "history": lambda: index.history(given.path, given.symbol, given.limit),
        "context": lambda: index.context(given.path),
        "where": lambda: index.where(given.path),
        "map": lambda: index.map(given.limit),
        "arch-map": index.arch_map,
        "stats": index.stats,
        "config": index.config,
        "reset": lambda: index.reset(given.scope, given.dry_run),
        "proxy": lambda: index.proxy(given.program, sys.stdin.read(), exit_code=given.exit_code),
        "gain": index.gain,
        "rewrite": lambda: index.rewrite(given.program),
        "scip": lambda: index.ingest_scip(given.path),
    }[given.command]()
    if isinstance(run, (dict, list)):
        print(json.dumps(run))
    elif isinstance(run, str):
        print(run)
    elif run is not None:
        for line in run.toJSON().toLocalIterator():
            print(line)


if __name__ == "__main__":
    main()
