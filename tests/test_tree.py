"""Listing, contents and ignore rules against git itself."""

import itertools
import subprocess

import pytest
from pyspark.sql import functions as F

from lodeline.sources import scan, tree

RULES = {
    ".gitignore": "# comment\n*.log\n!keep.log\n/top.py\nout/\ndocs/**/draft.md\na/**\n!a/b\n**/deep.py\nsp\\ ace.py   \n\\#odd.py\n\\!bang.py\n[!k]x.py\nq?.py\nfoo[bar.py\n\nno.such/\n  lead.py\ntrail.py\\ \n",
    "lib/.gitignore": "!*.log\n*.tmp.py\n!/keep.tmp.py\nsub/out.py\n",
    "lib/sub/.gitignore": "*.py\n!main.py\n",
    "out/.gitignore": "!*\n",
}
NAMES = ["x.log", "keep.log", "top.py", "draft.md", "deep.py", "sp ace.py", "#odd.py", "!bang.py", "kx.py", "ax.py", "q1.py", "q.py", "foo[bar.py", "y.tmp.py", "keep.tmp.py", "out.py", "main.py", "lead.py", "plain.py", "__init__.py", "a.b+c.py"]
FOLDERS = ["", "lib", "lib/sub", "lib/sub/out", "out", "a", "a/b", "docs", "docs/x/y", "other/lib", "_private"]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("ignoring")
    for folder, name in itertools.product(FOLDERS, NAMES):
        (root / folder).mkdir(parents=True, exist_ok=True)
        (root / folder / name).write_text(f"{folder}/{name}")
    for path, text in RULES.items():
        (root / path).write_text(text)
    (root / "node_modules/m").mkdir(parents=True)
    (root / "node_modules/m/plain.py").write_text("no")
    (root / "lib/link").symlink_to(root / "lib")
    subprocess.run(["git", "-C", str(root), "init", "-q"], check=True)
    (root / ".git/info/exclude").write_text("plain.py\n")
    return root


def by_git(root, paths):
    done = subprocess.run(["git", "-C", str(root), "-c", "core.excludesFile=/dev/null", "check-ignore", "--no-index", "--stdin", "-z"], input="\0".join(paths), capture_output=True, text=True)
    return set(filter(None, done.stdout.split("\0")))


@pytest.mark.parametrize("units,few", [(64, 20_000), (2, 0)])
def test_rules_agree_with_git(spark, root, monkeypatch, units, few):
    monkeypatch.setattr(tree, "UNITS", units)
    monkeypatch.setattr(tree, "FEW_RULES", few)
    listed = tree.listing(spark, str(root), scan.PRUNED)
    paths = sorted(r.path for r in listed.collect())
    assert paths == sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and not {"node_modules", ".git", "link"} & set(p.relative_to(root).parts))
    got = {r.path for r in tree.ignored(listed, scan.rules(spark, str(root), listed)).collect()}
    assert got == by_git(root, paths)
    assert {"x.log", "a/b/plain.py", "out/main.py", "lib/sub/kx.py"} <= got and not {"lib/x.log", "lib/sub/main.py", "keep.log", "lib/keep.tmp.py"} & got


def test_ignore_files_win_over_gitignore(spark):
    files = spark.createDataFrame([("a/.gitignore", "x.py\n!z.py"), (".ignore", "!x.py\nz.py"), ("", "y.py\nx.py")], "path string, text string")
    paths = spark.createDataFrame([(p,) for p in ("a/x.py", "x.py", "y.py", "a/z.py")], "path string")
    assert sorted(r.path for r in tree.ignored(paths, tree.rules(files)).collect()) == ["a/z.py", "y.py"]
    assert tree.ignored(paths, tree.rules(files.limit(0))).count() == 0 and tree.ignored(paths.limit(0), tree.rules(files)).count() == 0


def test_scan_sees_underscores_and_reads(spark, root):
    rows = {r.path: r for r in scan.scan(spark, str(root)).where(~F.col("path").contains("out")).collect()}
    assert {"__init__.py", "_private/__init__.py", "lib/__init__.py"} <= set(rows) and "plain.py" not in rows and "x.log" not in rows
    assert rows["_private/__init__.py"].content == "_private/__init__.py" and rows["lib/__init__.py"].size == 15
    assert scan.scan(spark, f"file://{root}/lib").where("path = '__init__.py'").count() == 1
