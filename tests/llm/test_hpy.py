import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodeline.llm import hpy

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("small_packs", [False, True])
def test_base_matches_brute_force(docs, texts, monkeypatch, small_packs):
    if small_packs:
        monkeypatch.setattr(hpy, "PACK_TOKENS", 100)
    count = Counter(t for i, x in enumerate(texts) if not held(i) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in hpy.score(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        own = tokens(text)
        row = got[i]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held(i), len(own), sum(count[t] > 0 for t in own), n)
        assert row.base_score == pytest.approx(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in own), rel=1e-9)
        assert row.score < 0


def sentences(rng, n, order):
    words = [f"w{i}" for i in range(30)]
    out = []
    for _ in range(n):
        at, text = 0, []
        for _ in range(25):
            at = (at * 7 + 3 + (rng.integers(30) if rng.random() > order else 0)) % 30
            text.append(words[at])
        out.append(" ".join(text))
    return out


def test_held_out_perplexity_beats_the_base(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame(list(enumerate(sentences(rng, 400, 0.8))), "doc_id long, text string")
    rows = [r for r in hpy.score(df).collect() if r.held_out]
    per_token = lambda name: 10 ** (-sum(r[name] for r in rows) / sum(r.n_tokens for r in rows))
    assert len(rows) > 30 and per_token("score") < 0.4 * per_token("base_score")


def test_probabilities_sum_to_one(spark, monkeypatch):
    """Over all known words and one unknown, in every context."""
    rng = np.random.default_rng(4)
    count = rng.integers(0, 6, (40, 5)) * (rng.random((40, 5)) < 0.6)
    count[0] += 50
    dish, context = np.meshgrid(np.arange(40), np.arange(5), indexing="ij")
    pairs = hpy.Pairs(hpy._squeeze(np.full(40, -1, "<i2"), np.diff(dish.ravel().astype("<u4"), prepend=np.uint32(0)).astype("<u4"), context.ravel().astype("<u2"), count.ravel().astype("<u4")))
    tables = (pairs.served > 0).astype(np.int64)
    customers = pairs.parents(tables)
    known = int((pairs.total > 0).sum())
    total = lambda t, c, s: {0: count.sum(0), 1: np.bincount(pairs.context_at, t, minlength=5).astype(float), 2: np.zeros(5), 3: np.zeros(5), 4: np.array([count.sum(), known, c.sum(), s.sum(), 5, 3, 9, 3], float)}
    g = hpy._restaurants(total(tables, customers, (customers > 0).astype(int)), 0, None)
    tables, customers, shared, _ = pairs.reseat(g, rng)
    g = hpy._restaurants(total(tables, customers, shared), 1, g)
    p = (customers - g["d1"] * shared + (hpy.STRENGTH + g["d1"] * g["T1"]) * g["root"]) / (hpy.STRENGTH + g["C1"])
    unknown = (hpy.STRENGTH + g["d1"] * g["T1"]) * g["root"] / (hpy.STRENGTH + g["C1"])
    p = np.where(pairs.total > 0, p, 0)
    assert p.sum() + unknown == pytest.approx(1)
    by_context = np.bincount(pairs.context_at, np.where(pairs.total[pairs.dish] > 0, pairs.predict(g, tables, p), 0), minlength=5)
    rest = (hpy.STRENGTH + g["d2"] * g["TT"]) / (hpy.STRENGTH + g["CT"]) * unknown
    np.testing.assert_allclose(by_context + rest, 1)


def test_seating_follows_the_process():
    """Mean number of tables against its exact recursion, also where customers are seated in blocks."""
    rng, discount, weight = np.random.default_rng(1), 0.5, 2.0
    for customers, tolerance in ((1, 0), (20, 0.02), (400, 0.03)):
        t = hpy.seat(np.full(4000, customers), np.full(4000, weight), discount, rng)
        probability = np.zeros(customers + 2)
        probability[1] = 1
        for n in range(1, customers):
            k = np.arange(customers + 2)
            opens = weight / np.maximum(weight + n - discount * k, 1e-9)
            moved = probability * opens
            probability = probability - moved + np.append(0, moved[:-1])
        assert t.mean() == pytest.approx((probability * np.arange(customers + 2)).sum(), rel=tolerance + 1e-9)
    assert hpy.seat(np.array([0, 1]), np.ones(2), 0.5, rng).tolist() == [0, 1]


def test_frequent_words_and_empty(spark, docs, no_docs, monkeypatch):
    monkeypatch.setattr(hpy, "CONTEXTS", 50)
    rows = docs.collect()
    count = Counter(t for r in rows if not held(r.doc_id) for t in tokens(r.text))
    n = sum(count.values())
    words = set(hpy.frequent_words(docs, "doc_id", "text")[0])
    sure = {w.encode() for w, c in count.items() if w and c * 50 >= n * 1.2}
    assert sure <= words <= {w.encode() for w, c in count.items() if w and c * 50 >= n} and len(words) <= 50
    assert hpy.score(no_docs).count() == 0
    two = spark.createDataFrame([(None, "a b"), (None, "a b"), (2, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in hpy.score(two).collect()) == [1, 3, 3]


def test_every_context_has_a_restaurant(spark, monkeypatch):
    """Pairs of words each too rare to be frequent: the second is foretold by the first, the shared restaurant can't."""
    monkeypatch.setattr(hpy, "CONTEXTS", 50)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"a{i} b{i}" for i in rng.integers(0, 200, 20)) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert hpy.frequent_words(df, "doc_id", "text")[0] == []
    rows = [r for r in hpy.score(df).collect() if r.held_out]
    # Half of the words are all but certain; by the unigram alone each costs log10(400) = 2.6.
    assert -sum(r.score for r in rows) / sum(r.n_tokens for r in rows) < 0.65 * 2.6


def test_totals_of_contexts_over_shares(spark):
    """Customers of a context that many shares have come back as one sum to each of them."""
    keys = [np.array([3, 7, 9], np.uint64), np.array([7, 9], np.uint64)]
    rows = [(s, 0, hpy._squeeze(k, np.full(len(k), 2 + s, "<u4"), np.full(len(k), 1, "<u4"))) for s, k in enumerate(keys)]
    df = spark.createDataFrame(rows, hpy._PART).repartition(1).sortWithinPartitions("part", "share")
    got = {r.share: [x.tolist() for x in hpy._unsqueeze(bytes(r.payload))] for r in df.mapInArrow(hpy._answer, hpy._PART).collect()}
    assert got == {0: [[2, 5, 5], [1, 2, 2]], 1: [[5, 5], [2, 2]]}


def test_rows_of_a_sweep_follow_the_tokens(spark, docs, texts, monkeypatch):
    """Many shuffle partitions and frequent words: a row of a share for each partition of contexts and one more; the totals stay whole however contexts are dealt."""
    monkeypatch.setattr(hpy, "SWEEPS", 0)
    made, totals = [], []
    real_table, real_restaurants = hpy.table, hpy._restaurants

    def table(df, name, path=None, **options):
        out = real_table(df, name, path, **options)
        if path and "/seating-" in path:
            made.append((out.count(), out.select("share").distinct().count(), out.where("part >= 0").select("part").distinct().count()))
        return out

    monkeypatch.setattr(hpy, "table", table)
    monkeypatch.setattr(hpy, "_restaurants", lambda s, *rest: totals.append(s) or real_restaurants(s, *rest))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        for least in (hpy.CONTEXT_TOKENS, 300):
            monkeypatch.setattr(hpy, "CONTEXT_TOKENS", least)
            assert hpy.score(docs).count() == len(texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    training = [tokens(x) for i, x in enumerate(texts) if not held(i)]
    count, pairs = Counter(t for x in training for t in x), {(a, b) for x in training for a, b in zip([None, *x], x)}
    hot = [*(w.decode() for w in hpy.frequent_words(docs, "doc_id", "text")[0]), None]
    for (rows, shares, parts), s, most in zip(made, totals, (1, 10), strict=True):
        assert shares > 40 and parts <= most and rows <= shares * (most + 1)
        assert s[3].tolist() == [count[w] for w in hot]
        assert s[2].tolist() == [sum(b == w for _, b in pairs) for w in hot]
        assert s[4][0] == sum(count.values())
    assert made[1][2] == 10


def test_slices_of_frequent_dishes():
    """Every index is in the slice it is dealt to, also where there are more slices than dishes."""
    for size, count in ((1, 1), (7, 3), (3, 8), (100, 12)):
        pairs = hpy.Pairs(hpy._squeeze(np.arange(size, dtype="<i2"), np.diff(np.arange(size, dtype="<u4"), prepend=np.uint32(0)).astype("<u4"), np.zeros(size, "<u2"), np.arange(1, size + 1, dtype="<u4")))
        sent = pairs.frequent(np.full(size, 2), size, count)
        batch = hpy.pa.RecordBatch.from_arrays([hpy.pa.array([p for p in sorted(sent) for _ in "ab"], "int32"), hpy.pa.array([sent[p] for p in sorted(sent) for _ in "ab"], "binary")], names=["part", "frequent"])
        got = [hpy._unsqueeze(bytes(b.column(1)[0].as_py())) for b in hpy._summed(size, count)([batch])]
        index, customers, total = (np.concatenate(x) for x in zip(*got))
        assert index.tolist() == list(range(size)) and set(customers) == {4} and total.tolist() == [2 * (i + 1) for i in range(size)]
