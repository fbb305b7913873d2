"""A small tree, indexed and asked."""

import os
import subprocess
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodeline.api import Index
from lodeline.operators import extract as X

TREE = {
    "app/main.py": "from app.core import run\nfrom .shapes import Circle\n\ndef start():\n    run()\n    c = Circle()\n    c.area()\n    c.describe()\n\nif __name__ == '__main__':\n    start()\n",
    "app/core.py": "import os\n\nLIMIT = 3\n\ndef run(x=1):\n    if x and LIMIT:\n        return helper(x)\n    return None\n\ndef helper(x):\n    for i in range(x):\n        pass\n    return x\n",
    "app/shapes.py": "class Shape:\n    def describe(self):\n        return self.area()\n\nclass Circle(Shape):\n    def area(self):\n        return 3\n",
    "app/tests/test_core.py": "from app.core import run\n\ndef test_run():\n    run()\n",
    "web/handlers/page.ts": "import { draw } from './draw'\nexport function render() {\n  draw()\n}\n",
    "web/handlers/draw.ts": "export function draw() {\n  return new Set()\n}\n",
    "gen/made.py": "# DO NOT EDIT\ndef made():\n    run()\n",
    "node_modules/x/skip.py": "def skipped(): pass\n",
    "rs/src/main.rs": "use crate::store::Store;\nfn main() { let s = Store::new(); s.put(1); }\n",
    "rs/src/store/mod.rs": "pub struct Store { n: u32 }\nimpl Store { pub fn put(&self, n: u32) {} }\n",
    "jv/a/Use.java": "package jv.a;\nimport jv.b.Help;\npublic class Use { void go(Help h) { h.give(); } }\n",
    "jv/b/Help.java": "package jv.b;\npublic class Help { void give() {} }\n",
    "ws/Cargo.toml": "[workspace]\nmembers = ['*']\n",
    "ws/tool/Cargo.toml": "[package]\nname = 'tool'\n",
    "ws/tool/src/main.rs": "use text_kit::trim::Trim;\nfn main() { let t = Trim::new(); t.cut(); }\n",
    "ws/kit/Cargo.toml": "[package]\nname = 'text-kit'\n",
    "ws/kit/src/trim.rs": "pub struct Trim { n: u32 }\nimpl Trim { pub fn cut(&self) {} }\n",
    "srv/main.go": "package main\n\nfunc main() {\n\tserve()\n}\n\nfunc serve() {}\n",
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, body in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "first | with a pipe")
    (root / "app/core.py").write_text(TREE["app/core.py"] + "# more\n")
    git("commit", "-qam", "second")
    made = Index(spark, str(tmp_path_factory.mktemp("index")))
    stats = made.build(str(root))
    assert stats["files"] == len(TREE) - 1 and stats["commits"] == 2
    made.roots = [str(root)]
    return made


def test_symbols_and_complexity(index):
    files = {r.id: r.path for r in index.table("files").collect()}
    found = {(files[r.file_id], r.name, r.kind, r.scope) for r in index.table("symbols").collect()}
    assert {("app/shapes.py", "area", "method", "Circle"), ("app/core.py", "LIMIT", "const", None), ("app/core.py", "run", "function", None), ("web/handlers/page.ts", "render", "function", None), ("srv/main.go", "serve", "function", None)} <= found
    assert X.parse("python", TREE["app/core.py"]).complexity == 4


def test_references_resolve(index):
    files = {r.id: r.path for r in index.table("files").collect()}
    refs = {(files[r.source_file_id], r.target_name, r.kind): (files.get(r.target_file_id), r.confidence) for r in index.table("refs").collect()}
    assert refs["app/main.py", "run", "call"] == ("app/core.py", 0.95)
    assert refs["app/core.py", "helper", "call"] == ("app/core.py", 1.0)
    assert refs["app/main.py", "area", "call"] == ("app/shapes.py", 0.95)
    assert refs["app/main.py", "describe", "call"] == ("app/shapes.py", 0.95)
    assert refs["web/handlers/page.ts", "draw", "call"] == ("web/handlers/draw.ts", 0.95)
    assert refs["app/main.py", "app.core", "import"] == (None, 0.0)
    assert ("gen/made.py", "run", "call") not in refs


def test_questions(index):
    assert [r.file_path for r in index.callers("run").collect()] == ["app/main.py"]
    assert index.callers("run", include_tests=True).count() == 2
    risk = index.risk("helper").first()
    assert risk.direct == 1 and risk.transitive >= 1
    where = index.where("core.py").first()
    assert where.path == "app/core.py" and where.in_degree >= 1
    assert index.where("page.ts").first().layer == "api"
    assert index.where("app/main.py").first().layer == "entry"
    assert {r.path for r in index.search("helper run", 5).collect()} >= {"app/core.py"}
    assert index.get_symbols("area").first().path == "app/shapes.py"
    assert [r.message for r in index.history("core.py").collect()][-1] == "first | with a pipe"
    assert index.map().where("section = 'hotspot'").count() >= 1
    assert {r.section for r in index.arch_map().collect()} == {"layer", "role", "central", "files"}
    assert index.stats().where("item = 'files'").first().n == len(TREE) - 1


def test_chunks_cover_definitions(index):
    chunks = index.table("chunks").where(F.col("content").contains("def helper")).collect()
    assert len(chunks) == 1 and chunks[0].kind == "function" and chunks[0].token_count > 5


def test_context_and_history_of_a_symbol(index):
    rows = {(r.section, r.item): r.value for r in index.context("app/core.py").collect()}
    assert rows["callers", "function run"] == "1 sure, 0 possible, in 1 files" or rows["callers", "function run"].startswith("2 sure")
    assert ("needs", "helper") in rows and rows["place", "app/core.py"].split()[0] and ("hotspot", "app/core.py") in rows
    assert index.context("no/such/file").count() == 0
    named = index.history("core.py", "helper").first()
    assert (named.symbol, named.symbol_kind, named.line) == ("helper", "function", 9)
    assert [r.message for r in index.history("core.py", "helper").collect()] == ["first | with a pipe"] and index.history("core.py", "nothing").count() == 0


def test_imports_bind_in_other_languages(index):
    files = {r.id: r.path for r in index.table("files").collect()}
    bound = {(files[r.source_file_id], r.target_name): files.get(r.target_file_id) for r in index.table("refs").where("kind = 'import_binding'").collect()}
    assert bound["web/handlers/page.ts", "draw"] == "web/handlers/draw.ts" and bound["app/main.py", "Circle"] == "app/shapes.py"
    assert bound["rs/src/main.rs", "Store"] == "rs/src/store/mod.rs" and bound["ws/tool/src/main.rs", "Trim"] == "ws/kit/src/trim.rs" and bound["jv/a/Use.java", "Help"] == "jv/b/Help.java"


def test_second_build_reads_changed_files_only(spark, index, monkeypatch):
    root = next(iter(index.roots))
    (Path(root) / "app/more.py").write_text("def added():\n    return 1\n")
    (Path(root) / "gen/made.py").unlink()
    seen = []
    real = X.extract
    monkeypatch.setattr(X, "extract", lambda files, generated=False: seen.append(sorted(r.path for r in files.select("path").collect())) or real(files, generated))
    stats = index.build(root)
    assert seen == [["app/more.py"]] and stats["files"] == len(TREE) - 1
    assert index.get_symbols("added").first().path == "app/more.py" and index.get_symbols("made").count() == 0
    assert [r.file_path for r in index.callers("run").collect()] == ["app/main.py"]


def test_savings(index):
    text = "\n".join(["On branch main", "Changes not staged for commit:", *(f"\tmodified:   src/file{i}.py" for i in range(40))])
    shown = index.proxy("git status", text)
    assert 0 < len(shown) <= len(text)
    assert {r.section for r in index.gain().collect()} == {"total", "day", "command"}
    assert index.rewrite("git status") == "lodeline proxy git status" and index.rewrite("cd /tmp") is None


def test_big_files_are_parsed_whole():
    """The size limit is for entry detection alone."""
    pad = "# " + "x" * 98 + "\n"
    text = "import os\n\n\ndef first():\n    return os.sep\n\n\n" + pad * (X.BIG_FILE // 100 + 1) + "def last():\n    return first()\n\n\nif __name__ == '__main__':\n    last()\n"
    assert len(text) > X.BIG_FILE
    found = X.parse("python", text)
    assert {"first", "last"} <= {s[0] for s in found.symbols} and "first" in {r[2] for r in found.refs} and not found.is_entry
    rust = X.parse("rust", "fn main() {\n}\n" + ("//" + pad[2:]) * (X.BIG_FILE // 100 + 1) + "fn last() {\n}\n")
    assert {"main", "last"} <= {s[0] for s in rust.symbols} and not rust.is_entry
    assert X.parse("rust", "fn main() {\n}\n").is_entry


def test_history_of_commits_in_one_second(spark, tmp_path):
    """In the log's order, the latest first, whatever their hashes."""
    root, now = tmp_path / "tree", f"{int(time.time()) - 60} +0000"
    root.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True, env={**os.environ, "GIT_AUTHOR_DATE": now, "GIT_COMMITTER_DATE": now})
    git("init", "-q")
    for i in range(6):
        (root / "one.py").write_text(f"def one():\n    return {i}\n")
        git("add", ".")
        git("commit", "-qm", f"number {i}")
    made = Index(spark, str(tmp_path / "index"))
    made.build(str(root))
    latest = [f"number {i}" for i in (5, 4, 3, 2, 1, 0)]
    assert [r.message for r in made.history("one.py").collect()] == latest
    assert [r.message for r in made.history("one.py", limit=4).collect()] == latest[:4]
    assert [r.message for r in made.history("one.py", "one").collect()] == latest
    assert "pos" not in made.history("one.py").columns
