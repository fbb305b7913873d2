import pytest
from pyspark.sql import functions as F

from lodeline.functions import paths as P
from lodeline.sources import gitlog, scan, tree


def test_numstat(spark):
    lines = ["@@|h1|ann|100|fix | pipes", "3\t1\ta/b.py", "-\t-\timg.png", "", "@@|h2|bob|200|two", "1\t0\ta/b.py"]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "block int, pos long, line string")
    got = [tuple(r) for r in gitlog.parse_numstat(df, "block", "pos").collect()]
    assert sorted(got) == [("h1", "ann", 100, "fix | pipes", "a/b.py", 3, 1), ("h2", "bob", 200, "two", "a/b.py", 1, 0)]


def test_no_repository_is_empty(spark, tmp_path):
    assert gitlog.log(spark, str(tmp_path)).count() == 0
    assert gitlog.changed_since(spark, str(tmp_path), "HEAD").count() == 0


def test_overrides(tmp_path):
    file = tmp_path / "arch.toml"
    assert scan.layer_overrides(str(file)) == ([], [])
    file.write_text("[layers.gateway]\nlayer = 'edge'\nweight = 0.9\n[layers.x]\nlayer = 'y'\n[ignore]\npatterns = ['^docs/']\n")
    assert scan.layer_overrides(str(file)) == ([("gateway", "edge", 0.9), ("x", "y", 0.5)], ["^docs/"])
    file.write_text("[layers")
    assert scan.layer_overrides(str(file)) == ([], [])


def test_guard(spark):
    with pytest.raises(ValueError):
        scan.guard("/", spark.range(1))


@pytest.mark.parametrize("path,out", [("a/b.log", True), ("out/x.py", True), ("a/out/x.py", True), ("about/x.py", False), ("a/keep.py", False)])
def test_ignore_rules(spark, path, out):
    rules = tree.rules(spark.createDataFrame([(".gitignore", "*.log\nout/\n")], "path string, text string"))
    assert tree.ignored(spark.createDataFrame([(path,)], "path string"), rules).count() == int(out)


@pytest.mark.parametrize("path,kept", [("a/x.py", True), (".git/x.py", False), ("node_modules/a.ts", False), ("a/x.bin", False), ("README.md", True), ("a/.hidden.py", False)])
def test_kept(spark, path, kept):
    assert spark.range(1).select(F.coalesce(scan.kept(F.lit(path)), F.lit(False)).alias("o")).first().o is kept


@pytest.mark.parametrize("name,hits", [("callers", "a/tests/x.py a_test.go a.spec.ts"), ("candidate", "tests/x.py __tests__/x.ts playground/a.ts A/TESTS/x.py"), ("fulltext", "latest.rs a/testing.py"), ("metric", "latest.rs a/test/x.py"), ("entry", "tests/x.py a/__tests__/b.ts")])
def test_predicates_differ(spark, name, hits):
    every = "a/tests/x.py a_test.go a.spec.ts tests/x.py __tests__/x.ts playground/a.ts A/TESTS/x.py latest.rs a/testing.py a/test/x.py a/__tests__/b.ts plain.py".split()
    df = spark.createDataFrame([(p,) for p in every], "path string")
    found = {r.path for r in df.where(getattr(P, f"is_test_{name}")(F.col("path"))).collect()}
    assert set(hits.split()) <= found and "plain.py" not in found
    if name == "callers":
        assert "tests/x.py" not in found and "latest.rs" not in found
