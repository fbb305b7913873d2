import random
import time

from lodeline.operators import context as C

SYMBOL = "id long, file_id long, name string, kind string, line int"
REF = "id long, name string, source_file_id long, target_file_id long, confidence double, kind string"


def rows(spark):
    rng = random.Random(3)
    symbols = [(i, rng.choice([1, 2, 3, None]), rng.choice("ab"), rng.choice(["function", "class", "const"]), i % 9) for i in range(30)]
    refs = [(i, rng.choice(["a", "b", "c", None]), rng.randrange(1, 5), rng.choice([1, 2, 3, None, None]), rng.choice([0.5, 0.9, None]), rng.choice(["call", "inherit"])) for i in range(80)]
    files = [(1, "a/x.py"), (2, "a/tests/y.py"), (3, "z.py"), (4, "w.py")]
    return symbols, refs, files


def pairs(symbols, refs, files):
    path = dict(files)
    for s in symbols:
        for r in refs:
            if s[3] in C.DEFINED and r[5] in C.USES and s[1] and r[1] == s[2] and r[3] in (s[1], None) and r[2] != s[1]:
                yield s, r, "/tests/" in path[r[2]]


def test_contracts_and_callers_count_all_pairs(spark):
    symbols, refs, files = rows(spark)
    frames = spark.createDataFrame(symbols, SYMBOL), spark.createDataFrame(refs, REF), spark.createDataFrame(files, "id long, path string")
    want, callers = {}, {}
    for s, r, test in pairs(symbols, refs, files):
        got = want.setdefault((s[1], s[2], s[3]), [0, 0, set(), set()])
        sure = (r[4] or 0) >= C.GATE
        got[0] += sure and not test
        got[1] += sure and test
        got[2].add(s[0])
        got[3].add(s[4])
        if s[1] == 2:
            one = callers.setdefault((s[4], s[0], s[2], s[3]), [0, 0, set()])
            one[0] += sure
            one[1] += r[4] is not None and not sure
            one[2].add(r[2])
    assert {(r.file_id, r.name, r.kind): (r.prod, r.tests, r.impls, r.first_line) for r in C.contracts(*frames).collect()} == {k: (p, t, len(i), min(x)) for k, (p, t, i, x) in want.items()}
    assert [tuple(r) for r in C.external_callers(*frames, 2).collect()] == [(k[2], k[3], k[0], a, b, len(f)) for k, (a, b, f) in sorted(callers.items())]


def test_contracts_of_a_common_name_make_no_pairs(spark):
    """30,000 symbols of one name and 30,000 references to it: 900 million pairs."""
    symbols = spark.range(30_000).selectExpr("id", "id % 50 as file_id", "'a' as name", "'function' as kind", "cast(id as int) as line")
    refs = spark.range(30_000).selectExpr("id", "'a' as name", "id % 50 as source_file_id", "cast(null as long) as target_file_id", "0.9D as confidence", "'call' as kind")
    files = spark.range(50).selectExpr("id", "concat('f', id) as path")
    start = time.monotonic()
    got = C.contracts(symbols, refs, files).collect()
    assert {(r.prod, r.tests, r.impls) for r in got} == {(600 * 49 * 600, 0, 600)} and len(got) == 50
    assert time.monotonic() - start < 30
