"""The tier ladder and the inheritance walk on rows, without a parser."""

import pytest

from lodeline.operators import resolve as R

FILES = "id long, path string, dir string, lang_family string"
SYMBOLS = "id long, file_id long, name string, kind string, scope string"
REFS = "id long, source_file_id long, source_symbol string, target_name string, target_qualifier string, receiver_type string, kind string"


def run(spark, files, symbols, refs, bindings=()):
    frames = spark.createDataFrame([(i, p, p.rpartition("/")[0] + "/" if "/" in p else "", f) for i, p, f in files], FILES), spark.createDataFrame(symbols, SYMBOLS)
    calls = spark.createDataFrame(refs, REFS)
    bound = spark.createDataFrame(list(bindings), "source_file_id long, target_name string, target_file_id long")
    inherits = calls.where("kind = 'inherit'")
    done = R.cascade(calls, *frames, bound, R.mro(calls, *frames, inherits))
    return {r.id: (r.confidence, r.target_file_id) for r in done.collect()}


PY = [(1, "a/x.py", "python"), (2, "a/y.py", "python"), (3, "b/z.py", "python"), (4, "tests/t.py", "python"), (5, "c/w.js", "ts"), (6, "a/v.py", "python")]


@pytest.mark.parametrize(
    "symbols,ref,bindings,want",
    [
        ([(1, 1, "f", "function", None)], (1, "f", None, None), (), (1.0, 1)),
        ([(1, 2, "f", "function", None)], (1, "f", None, None), (), (0.95, 2)),
        ([(1, 3, "f", "function", None)], (1, "f", None, None), (), (0.8, 3)),
        ([(1, 3, "f", "function", None)], (1, "f", "x", None), (), (0.5, 3)),
        ([(1, 3, "f", "method", "C")], (1, "f", "x", None), (), (0.8, 3)),
        ([(1, 2, "f", "function", None), (2, 6, "f", "function", None)], (1, "f", None, None), (), (0.6, 2)),
        ([(1, 1, "f", "function", None)], (1, "f", "x", None), (), (0.6, 1)),
        ([(1, 4, "f", "function", None), (2, 3, "f", "function", None)], (1, "f", None, None), (), (0.8, 3)),
        ([(1, 5, "f", "function", None)], (1, "f", None, None), (), (0.0, None)),
        ([(1, 3, "f", "method", "C")], (1, "f", "c", "C"), (), (0.95, 3)),
        ([(1, 3, "f", "function", None), (2, 1, "f", "function", None)], (1, "f", None, None), [(1, "f", 3)], (0.95, 3)),
    ],
)
def test_tiers(spark, symbols, ref, bindings, want):
    source, name, qualifier, receiver = ref
    assert run(spark, PY, symbols, [(1, source, "s", name, qualifier, receiver, "call")], bindings)[1] == want


def test_imports_never_resolve(spark):
    assert run(spark, PY, [(1, 1, "f", "function", None)], [(1, 1, None, "f", None, None, "import")])[1] == (0.0, None)


def test_inheritance_walk(spark):
    files = [(1, "a/base.py", "python"), (2, "a/mid.py", "python"), (3, "a/use.py", "python"), (4, "z/base.py", "python")]
    symbols = [(1, 1, "Base", "class", None), (2, 1, "go", "method", "Base"), (3, 2, "Mid", "class", None), (4, 2, "Leaf", "class", None), (5, 4, "Base", "class", None), (6, 4, "go", "method", "Base")]
    refs = [(1, 2, "Mid", "Base", None, None, "inherit"), (2, 2, "Leaf", "Mid", None, None, "inherit"), (3, 3, "u", "go", "x", "Leaf", "call"), (4, 3, "u", "stop", "x", "Leaf", "call")]
    got = run(spark, files, symbols, refs)
    assert got[3] == (0.95, 1) and got[4] == (0.0, None)


def walked(files, symbols, calls, inherits, depth=6):
    """The walk with a stack, call by call."""
    paths = dict(files)
    classes, above, own = {}, {}, {}
    for i, file, name, kind in symbols:
        own.setdefault((file, name), i)
        if kind == "class" and file not in classes.setdefault(name, []):
            classes[name].append(file)
    for _, file, name, base in inherits:
        above.setdefault((file, name), []).append(base)
    out = {}
    for ref, source, receiver, name in calls:

        def near(f, source=source):
            x, y = paths[source].split("/"), paths[f].split("/")
            same = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
            return len(x) + len(y) - 2 * same, len(paths[f])

        seen, hit = set(), None
        for start in sorted(classes.get(receiver, []), key=near):
            stack = [(b, 1) for b in reversed(above.get((start, receiver), []))]
            while stack and hit is None:
                base, level = stack.pop()
                for f in sorted(classes.get(base, []), key=near) if level <= depth else []:
                    if (f, base) in seen:
                        continue
                    seen.add((f, base))
                    if (f, name) in own:
                        hit = (own[f, name], f)
                        break
                    stack += [(b, level + 1) for b in reversed(above.get((f, base), []))]
            if hit:
                out[ref] = hit
                break
    return out


def test_inheritance_walks_on_random_hierarchies(spark):
    """Several files a class, several bases, bases of the class's own name, and rings."""
    import random

    rng = random.Random(4)
    files = [(k, f"{'/'.join(rng.choice('ab') for _ in range(rng.randrange(3)))}/f{k}.py") for k in range(30)]
    symbols = [(k, rng.randrange(30), rng.choice("ABCDEFGH"), "class") for k in range(60)]
    symbols += [(100 + k, rng.randrange(30), f"m{rng.randrange(8)}", "method") for k in range(40)]
    defined = sorted({(f, n) for _, f, n, kind in symbols if kind == "class"})
    inherits = [(k, *rng.choice(defined), rng.choice("ABCDEFGH")) for k in range(70)]
    calls = [(k, rng.randrange(30), rng.choice("ABCDEFGH"), f"m{rng.randrange(8)}") for k in range(200)]
    got = R.mro(
        spark.createDataFrame([(*c, "call") for c in calls], "id long, source_file_id long, receiver_type string, target_name string, kind string"),
        spark.createDataFrame([(*f, "python") for f in files], "id long, path string, lang_family string"),
        spark.createDataFrame([(*s, None) for s in symbols], "id long, file_id long, name string, kind string, scope string"),
        spark.createDataFrame(inherits, "id long, source_file_id long, source_symbol string, target_name string"),
        depth=12,
    )
    want = walked(files, symbols, calls, inherits, depth=12)
    assert {r.ref_id: (r.symbol_id, r.file_id) for r in got.collect()} == want and len(want) > 50


def test_one_tier_alone_writes_and_keeps_only_what_it_needs(spark, monkeypatch):
    written = []
    keep = lambda df, name="cut": written.append(name) or df
    monkeypatch.setattr(R, "cut", keep)
    files = spark.createDataFrame([(1, "a/x.py", "a/", "python"), (2, "a/y.py", "a/", "python")], "id long, path string, dir string, lang_family string")
    symbols = spark.createDataFrame([(1, 1, "f", "function", None)], "id long, file_id long, name string, kind string, scope string")
    refs = spark.createDataFrame([(1, 1, "f", None, None, "call"), (2, 2, "f", None, None, "call")], "id long, source_file_id long, target_name string, target_qualifier string, receiver_type string, kind string")
    bindings = spark.createDataFrame([], "source_file_id long, target_name string, target_file_id long")
    made = R.tiers(refs, files, symbols, bindings, names=["l4a"])
    assert [tuple(r) for r in made["l4a"].collect()] == [(1, 9, 1, 1, 0.6)] and list(made) == ["l4a"]
    assert written == ["owned"]


def shuffled(spark, run):
    """Rows written to shuffles by the stages of ``run``, with no join a broadcast."""
    gate, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    empty = gate.jvm.java.util.ArrayList

    def rows():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(empty(), False, False, gate.new_array(gate.jvm.double, 0), empty()).iterator()
        out = {}
        while stages.hasNext():
            stage = stages.next()
            out[stage.stageId()] = stage.shuffleWriteRecords()
        return out

    before = set(rows())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return sum(n for stage, n in rows().items() if stage not in before)


def test_the_cascade_shuffles_references_by_file_and_then_once(spark):
    files = spark.createDataFrame([(k, f"d{k % 5}/f{k}.py", f"d{k % 5}/", "python") for k in range(20)], FILES)
    symbols = spark.createDataFrame([(k, k % 20, f"n{k}", "function", None) for k in range(60)], SYMBOLS)
    refs = R.cut(spark.range(20_000).selectExpr("id", "id % 20 AS source_file_id", "'s' AS source_symbol", "concat('n', id % 70) AS target_name", "CAST(null AS string) AS target_qualifier", "CAST(null AS string) AS receiver_type", "'call' AS kind"))
    bound = spark.createDataFrame([(1, "n3", 3)], "source_file_id long, target_name string, target_file_id long")
    made: list = []
    # Files and imports are met before, each by a shuffle where neither is small enough for a broadcast.
    assert shuffled(spark, lambda: made.extend(R.cascade(refs, files, symbols, bound).collect())) < 3.3 * 20_000
    assert len(made) == 20_000 and sum(row.tier is None for row in made) == 2850


def test_files_and_imports_that_every_task_holds_cost_no_shuffle(spark, monkeypatch):
    files = spark.createDataFrame([(k, f"d{k % 5}/f{k}.py", f"d{k % 5}/", "python") for k in range(20)], FILES)
    symbols = spark.createDataFrame([(k, k % 20, f"n{k}", "function", None) for k in range(60)], SYMBOLS)
    refs = R.cut(spark.range(20_000).selectExpr("id", "id % 20 AS source_file_id", "'s' AS source_symbol", "CASE id % 49 WHEN 0 THEN 'x/f1' ELSE concat('n', id % 63) END AS target_name", "CASE id % 3 WHEN 0 THEN 'f1' END AS target_qualifier", "CAST(null AS string) AS receiver_type", "CASE id % 49 WHEN 0 THEN 'import' ELSE 'call' END AS kind"))
    bound = spark.createDataFrame([(1, "n3", 3)], "source_file_id long, target_name string, target_file_id long")
    made: dict = {}
    run = lambda held: made.update({held: sorted(map(repr, R.cascade(refs, files, symbols, bound).collect()))})
    assert shuffled(spark, lambda: run(True)) < 1.3 * 20_000
    monkeypatch.setattr(R, "HELD", 0)
    assert shuffled(spark, lambda: run(False)) > 1.9 * 20_000
    assert made[True] == made[False] and sum("tier=7" in row for row in made[True]) > 0
