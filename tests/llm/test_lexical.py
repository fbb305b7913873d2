import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodeline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    """(item, rank, id, score) by the formula, every document scored for every item."""
    held = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    rows = []
    for item, own in asked.items():
        scored = []
        for doc, counts in held:
            m = 100 - 50 + (50 * sum(counts.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * counts[t]) // (1000 * counts[t] + 20 * m)) for t in own if counts[t])
            if score > 0:
                scored.append((-score, doc is None, doc))
        rows += [(item, r, doc, -score) for r, (score, _, doc) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def items(texts):
    return [(1, texts[0]), (2, "alpha"), (3, None), (4, ""), (5, "über STRASSE zzzz 你好"), (None, texts[7]), (11, texts[9]), (1, texts[11]), (12, "nowhere"), (-3, "the of and to")]


def rows_of(found):
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("segment_bytes,block_bytes,k", [(8 << 20, 1 << 20, 5), (2000, 300, 50), (1, 1 << 20, 1)])
def test_matches_brute_force(spark, docs, texts, items, monkeypatch, segment_bytes, block_bytes, k):
    monkeypatch.setattr(lexical, "SEGMENT_BYTES", segment_bytes)
    index, n = lexical.build(docs)
    found = lexical.search(index, n, spark.createDataFrame(items, "item_id long, text string"), k=k, block_bytes=block_bytes)
    assert rows_of(found) == brute(list(enumerate(texts)), items, k)


def test_random_tables(spark):
    rng = random.Random(2)
    for _ in range(2):
        vocabulary = [f"w{i}" for i in range(40)]
        docs = [(rng.choice([None, i // 2]), " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(40)], k=rng.randrange(0, 60)))) for i in range(150)]
        items = [(i, " ".join(rng.choices(vocabulary, k=6))) for i in range(8)]
        index, n = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
        assert rows_of(lexical.search(index, n, spark.createDataFrame(items, "item_id long, text string"), k=7)) == brute(docs, items, 7)


def test_bytes_bound_the_gain():
    g = np.unique(np.concatenate((np.arange(5000), np.random.default_rng(1).integers(0, lexical.TOP + 1, 5000), [lexical.TOP])))
    b = lexical.byte_of(g)
    assert (lexical.LOWER[b] <= g).all() and (g <= lexical.UPPER[b]).all() and (lexical.UPPER - lexical.LOWER).max() < lexical.TOP / 255 + 1


def test_only_what_can_win_is_rescored(spark, docs, items, monkeypatch):
    # A bound that let nothing through would lose rows; one that let all through would not be a bound.
    index, n = lexical.build(docs)
    by_item = next(lexical._items(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 1 << 20))
    df = lexical._frequencies(index, sorted(set().union(*by_item.values())))
    weighted = spark.sparkContext.broadcast([[(t, lexical.weight(n, df[t])) for t in ts if t in df] for ts in by_item.values()])
    least = lexical._kth_lower(index, weighted, 3)
    row = index.selectExpr("*", "size(ids) AS size").first().asDict()
    reached = {i: int((bound >= least.get(i, 0)).sum()) for i, bound, _ in lexical._bounds(lexical.Postings(row), weighted.value, lexical.UPPER, row["size"])}
    assert all(0 <= r for r in reached.values()) and min(reached.values()) < row["size"] / 2


def test_empty_tables(spark, docs, no_docs, items):
    queries = spark.createDataFrame(items, "item_id long, text string")
    index, n = lexical.build(no_docs)
    assert n == 0 and lexical.search(index, n, queries).count() == 0
    index, n = lexical.build(docs)
    assert lexical.search(index, n, queries.limit(0)).count() == 0
