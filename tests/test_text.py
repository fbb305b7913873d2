import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeline.functions import scalars as S
from lodeline.operators import handlers as H
from lodeline.operators import textfilter as T


def many(fmt, n):
    return "\n".join(fmt.format(i) for i in range(n)) + "\n"


def test_git_status():
    out = "On branch main\nChanges to be committed:\n  (use \"git restore\")\n" + many("\tmodified:   s{}.py", 3) + "\nUntracked files:\n" + many("\tu{}.txt", 12)
    made = H.git_status(out, "", 0)
    assert "staged (3):" in made and "untracked (12):" in made and "..." in made and "u11.txt" not in made


def test_git_diff_budget():
    body = "diff --git a/x.py b/x.py\nindex 1..2\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n" + "".join(f"-old{i}\n+new{i}\n ctx\n ctx\n ctx\n" for i in range(60))
    made = H.git_diff(body, "", 0)
    assert "--- x.py (+60/-60) ---" in made and "lines skipped" in made and len(made) < len(body) / 2


def test_git_log():
    log = "".join(f"commit {i:040d}\nAuthor: a\nDate: now\n\n    subject {i}\n\n" for i in range(30))
    made = H.git_log(log, "", 0)
    assert "0000000000" in made and "Date" not in made and "(10 more commits)" in made
    assert H.git_log("commit 1\n", "", 0) == "commit 1\n"


def test_builds_and_tests():
    assert "build ok: 2 crate(s)" in H.cargo_build("", "Compiling a\nCompiling b\n", 0)
    out = many("test t{} ... ok", 500) + "---- t::bad stdout ----\ntest result: FAILED. 499 passed; 1 failed; 3 ignored\n"
    made = H.cargo_test(out, "", 101)
    assert "499 passed, 1 failed, 3 ignored" in made and "- t::bad" in made
    assert H.go_build("", "", 0) == "go build: ok\n"
    assert "✓ pkg/a (0.1s)" in H.go_test("ok  pkg/a 0.1s\n", "", 0)
    assert "jest FAILED" in H.npm_test("● suite fails\nexpected 1\nTests: 1 failed, 2 passed\n", "", 1)
    made = H.pytest_run("___ test_x ___\nassert 1\n=== 1 failed, 9 passed in 1s ===\n", "", 1)
    assert "9 passed, 1 failed" in made and "assert 1" in made


def test_lists_and_linters():
    made = H.grep(many("src/f.py:{}:hit", 300), "", 0)
    assert "300 matches in 1 files" in made and "295 more in this file" in made
    assert "100 results" in H.find(many("./d/f{}", 100), "", 0)
    assert ".py (40)" in H.ls(many("f{}.py", 40), "", 0)
    made = H.kubectl_logs(many("2024-01-02T03:04:05Z same", 60), "", 0)
    assert "×60" in made and "1 unique" in made
    made = H.ruff(many("a.py:{}:1: E501 long", 50) + many("a.py:{}:1: F401 unused", 20), "", 1)
    assert "70 issue(s)" in made and made.index("E501: 50") < made.index("F401: 20")
    assert H.tsc("", "", 0) == "tsc: clean (no errors)\n"
    code = "".join(f"fn f{i}() {{\n" + "    x();\n" * 48 + "}\n" for i in range(20))
    assert "// ... 48 lines" in H.cat(code, "", 0)


@pytest.mark.parametrize("command,name", [("git status -s", "git-status"), ("python x.py", "pytest"), ("docker compose up", "docker-compose"), ("rg x", "grep"), ("echo", None), (None, None)])
def test_routing(command, name):
    assert H.handle(command, "x", "", 0)[0] == name


@given(st.sampled_from(["git status", "git diff", "cat f", "grep x", "pytest", "kubectl logs p", "ls", "ruff", "mvn x", "helm x"]), st.text(max_size=400), st.text(max_size=60), st.integers(0, 2))
def test_never_worse(command, out, err, code):
    raw = out if not err else f"{out}\n{err}"
    assert H.tokens(H.handle(command, out, err, code)[1]) <= H.tokens(raw)


def col(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("o")).first().o


def test_rules(spark):
    text = many("line {}", 100)
    made = col(spark, text, lambda t: T.route(F.lit("unknown"), t))
    assert made.split("\n")[40] == "... (40 lines skipped)" and made.endswith("line 99")
    assert col(spark, "\n \n", lambda t: T.route(F.lit("make all"), t)) == "make: ok"
    assert col(spark, "warning: a\nnoise\n  --> x\n", lambda t: T.route(F.lit("cargo clippy"), t)) == "warning: a\n  --> x"
    rule = T.Rule("x", match_output=(("all good", "fine", "error"),))
    assert col(spark, "all good", lambda t: T.compile_rule(rule, t)) == "fine"
    assert col(spark, "all good\nerror", lambda t: T.compile_rule(rule, t)) == "all good\nerror"


def test_rule_file_needs_trust(tmp_path, monkeypatch):
    import hashlib

    file = tmp_path / "f.toml"
    file.write_text("[filters.make]\nmatch_command = '^make'\nmax_lines = 3\n")
    assert T.load_rules(str(file)) == T.BUILTIN
    (tmp_path / "t").write_text(hashlib.sha256(file.read_bytes()).hexdigest())
    assert T.load_rules(str(file), str(tmp_path / "t"))["make"].most == 3


def test_scalars(spark):
    assert col(spark, "\x1b[31mred\x1b[0m", S.strip_ansi) == "red"
    assert col(spark, "rust crate `a/b`/Foo#bar().", S.scip_name) == "bar"
    assert col(spark, "12345", S.estimate_tokens) == 2
    assert col(spark, "a && git diff", T.rewrite) == "a && lodeline proxy git diff"
    assert col(spark, "git log $(x)", T.rewrite) is None and col(spark, "cd x", T.rewrite) is None


def test_snippets_paths_and_hints(spark):
    from pyspark.sql import functions as F

    from lodeline.functions import scalars as S

    rows = spark.createDataFrame([("a b Run, c running d " + "x " * 80, 0, 3), ("nothing here", 2, 3), ("", 0, 30)], "content string, hot long, commits long")
    got = rows.select(S.snippet(F.col("content"), ["run"], 8).alias("s"), S.hotspot_hint(F.col("hot"), F.col("commits")).alias("h")).collect()
    assert got[0].s == "a b >>>Run,<<< c >>>running<<< d x x..." and got[1].s == "nothing here" and got[2].s == ""
    assert "3 commits" in got[0].h and got[1].h is None and "30 days" in got[2].h


def test_failure_sections_match_a_loop(spark):
    """Tools as loops over their lines, with the same limits."""
    import random

    def loop(tool, lines):
        out, inside, section, count, shown = [], False, 0, 0, 0
        for pos, line in enumerate(lines):
            x = line.strip()
            if {"go test": x.startswith("--- FAIL:"), "pytest": x.startswith(("FAILED ", "___")), "jest": x.startswith(("● ", "FAIL "))}[tool]:
                inside, section, count = True, section + 1, 0
                fits = True
            elif inside and tool == "go test" and x.startswith(("--- ", "=== ")):
                inside = False
            else:
                fits = {"go test": shown < 30, "pytest": count < 15, "jest": count <= 10}[tool]
            if inside:
                count += 1
                if fits:
                    shown += 1
                    out.append((section, pos, x))
        return out

    rng, rows, want = random.Random(1), [], []
    words = ["--- FAIL: a", "--- PASS: b", "=== RUN c", "FAILED t", "___ u", "● v", "FAIL w", "", "\tplain  ", "text", "more"]
    for i in range(60):
        tool = ["go test", "pytest", "jest"][i % 3]
        lines = rng.choices(words, weights=[1, 1, 1, 1, 1, 1, 1, 9, 9, 9, 9], k=rng.randrange(0, 150))
        rows += [(i, tool, pos, x) for pos, x in enumerate(lines)]
        want += [(i, *r) for r in loop(tool, lines)]
    found = T.failure_sections(spark.createDataFrame([*rows, (99, "other", 0, "FAIL x")], "id int, tool string, pos int, line string").repartition(5))
    assert sorted((r.id, r.section, r.pos, r.line) for r in found.collect()) == sorted(want)
