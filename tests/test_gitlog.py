"""Logs in blocks, and the history of a symbol's own lines, against plain versions and git itself."""

import os
import random
import subprocess

import pytest

from lodeline.operators import history as H
from lodeline.sources import gitlog


@pytest.fixture
def small_blocks(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def plain(lines):
    out, now = [], None
    for line in lines:
        if line.startswith("@@|"):
            _, h, author, ts, message = line.split("|", 4)
            now = (h, author, int(ts), message)
        elif now and line.count("\t") == 2 and not line.startswith("-"):
            added, deleted, path = line.split("\t")
            out.append((*now, path, int(added), int(deleted)))
    return out


def test_headers_span_blocks(spark, tmp_path, small_blocks):
    rng, logs = random.Random(4), []
    for f in range(2):
        lines = ["5\t5\tbefore/any/commit.py"]
        for c in range(40):
            lines.append(f"@@|{f}h{c}|a {c}|{1000 + c}|m | {c}")
            lines += [rng.choice(["{}\t{}\tdir/f{}.py", "-\t-\timg{2}.png"]).format(rng.randrange(99), rng.randrange(99), i) for i in range(rng.choice([0, 1, 3, 400]))] + [""]
        logs.append(lines)
        (tmp_path / f"log{f}.txt").write_text("\n".join(lines) + "\n")
    got = gitlog.read_log(spark, str(tmp_path))
    assert gitlog.read_lines(spark, str(tmp_path)).select("file", "block").distinct().count() > 20
    rows = got.collect()
    assert sorted(tuple(r)[:-1] for r in rows) == sorted(plain(logs[0]) + plain(logs[1]))
    ordered = [tuple(r)[:-1] for r in sorted(rows, key=lambda r: r.pos) if r.hash.startswith("0")]
    assert ordered == plain(logs[0])
    assert [type(x) for x in (got.schema["ts"].dataType, got.schema["added"].dataType)] == [type(got.schema["pos"].dataType)] * 2


def test_windows_hold_a_block(spark, tmp_path):
    (tmp_path / "log.txt").write_text("@@|h|a|1|m\n1\t1\tx\n")
    plan = gitlog.read_log(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("block" in w for w in windows)


def fold(first, last, commits):
    """The plain version: ranges carried back commit by commit, line by line."""
    touched, lo, hi = [], first, last
    for name, hunks in commits:
        if lo > hi:
            break
        hit = any((c <= hi and c + d - 1 >= lo) if d else lo <= c < hi for _, _, c, d in hunks)
        if hit:
            touched.append(name)
        old_lo, old_hi = lo, hi
        for a, b, c, d in hunks:
            if d and c <= lo <= c + d - 1:
                old_lo = a if b else a + 1
                break
        else:
            old_lo = lo + sum(b - d for a, b, c, d in hunks if (c + d - 1 < lo if d else c < lo))
        for a, b, c, d in hunks:
            if d and c <= hi <= c + d - 1:
                old_hi = a + b - 1 if b else a
                break
        else:
            old_hi = hi + sum(b - d for a, b, c, d in hunks if (c + d - 1 < hi if d else c < hi))
        lo, hi = old_lo, old_hi
    return touched


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    """A file edited forty times at random places, with a rename-free second file."""
    root, rng = tmp_path_factory.mktemp("repo"), random.Random(6)
    git = lambda *a, **k: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True, text=True, **k).stdout
    git("init", "-q")
    lines = [f"line {i}" for i in range(60)]
    for step in range(40):
        (root / "a b.txt").write_text("\n".join(lines) + "\n")
        (root / "other.txt").write_text(f"{step}\n-- a/fake\n@@|x|y|1|z\n")
        git("add", ".")
        git("commit", "-qm", f"step {step} | x", env={**os.environ, "GIT_AUTHOR_DATE": f"{1700000000 + step} +0000", "GIT_COMMITTER_DATE": f"{1700000000 + step} +0000"})
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(lines))
            kind = rng.randrange(3)
            if kind == 0:
                lines[at] = f"changed {step} {rng.random()}"
            elif kind == 1:
                lines[at:at] = [f"new {step} {rng.random()}" for _ in range(rng.randrange(1, 6))]
            elif len(lines) > 40:
                del lines[at : at + rng.randrange(1, 4)]
    return root, git, int(git("show", "HEAD:a b.txt").count("\n"))


def test_symbol_history_matches_git_and_a_fold(spark, repository):
    root, git, size = repository
    hunks = gitlog.hunks(spark, str(root)).cache()
    assert {r.file_path for r in hunks.select("file_path").distinct().collect()} == {"a b.txt", "other.txt"}
    ranges = [(i, first, min(size, first + long)) for i, (first, long) in enumerate([(1, 0), (5, 9), (20, 3), (30, 25), (1, size), (size, 0), (17, 1)])]
    symbols = spark.createDataFrame([(i, "a b.txt", a, b) for i, a, b in ranges], "symbol_id int, file_path string, first int, last int")
    got = {}
    for r in H.symbol_trace(symbols, hunks).orderBy("symbol_id", "nth").collect():
        got.setdefault(r.symbol_id, []).append(r.hash)
    commits = {}
    for r in hunks.where("file_path = 'a b.txt'").orderBy("pos").collect():
        commits.setdefault(r.hash, []).append((r.old_start, r.old_lines, r.new_start, r.new_lines))
    for i, first, last in ranges:
        assert got.get(i, []) == fold(first, last, list(commits.items()))
        own = git("log", "--format=%H", "--no-patch", f"-L{first},{last}:a b.txt").split()
        assert set(own) <= set(got[i]) and len(set(got[i]) - set(own)) <= 2
    assert 0 < len(got[0]) < len(commits)


def test_traces_of_nothing(spark):
    hunks = spark.createDataFrame([], "file_path string, hash string, pos long, old_start int, old_lines int, new_start int, new_lines int")
    symbols = spark.createDataFrame([(1, "x", 1, 2)], "symbol_id int, file_path string, first int, last int")
    assert H.symbol_trace(symbols, hunks).count() == 0
