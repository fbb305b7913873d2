import random
import re

import numpy as np
import pytest
import xxhash

from lodeline.llm import graph, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    codes = sorted(set(prints.values()))
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    groups = {}
    for i, c in prints.items():
        groups.setdefault(find(c), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


def test_fingerprints_and_components(docs, texts):
    got = {r.doc_id: r for r in simhash.cluster(docs).collect()}
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == brute_components(prints)


def test_long_texts_in_chunks(monkeypatch, texts):
    text = texts[-3]
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK_WORDS", 37)
    assert simhash.fingerprint(text) == whole == brute_print(text)


def planted(rng, n, flips):
    """Codes around a few centres, so that groups are dense and chains long."""
    codes = [rng.getrandbits(64) for _ in range(8)]
    while len(codes) < n:
        code = rng.choice(codes)
        for _ in range(rng.randrange(flips + 1)):
            code ^= 1 << rng.randrange(64)
        codes.append(code)
    return sorted(set(codes))


def gray(code):
    for s in (1, 2, 4, 8, 16, 32):
        code ^= code >> s
    return code


@pytest.mark.parametrize("seed,n,flips", [(1, 50, 3), (2, 700, 5), (3, 1500, 9), (4, 900, 64)])
def test_index_finds_every_link(seed, n, flips):
    codes = sorted(planted(random.Random(seed), n, flips), key=gray)
    got = simhash.Index(np.array(codes, np.uint64)).joined()
    want = brute_components(dict(enumerate(codes)))
    assert got.tolist() == [want[i] for i in range(len(codes))]


def test_index_of_several_groups():
    rng = random.Random(6)
    groups = [sorted(planted(rng, n, 5), key=gray) for n in (8, 9, 500, 17, 300, 12)]
    groups.insert(2, [5])
    first = np.cumsum([0, *map(len, groups[:-1])])
    got = simhash.Index(np.array([c for g in groups for c in g], np.uint64), first).joined()
    for start, codes in zip(first.tolist(), groups):
        want = brute_components(dict(enumerate(codes)))
        assert (got[start : start + len(codes)] - start).tolist() == [want[i] for i in range(len(codes))]


def test_hot_groups_are_dealt_again(spark, monkeypatch):
    """Codes that share all but 24 bits, so that groups of the first deal are larger than a task may hold."""
    rng = random.Random(3)
    codes = sorted({rng.getrandbits(24) | 7 << 40 for _ in range(400)} | {5 | 7 << 40, 4 | 7 << 40})
    codes = sorted(set(codes) | {c ^ 1 << rng.randrange(24) for c in codes[:150]})
    df = spark.createDataFrame(list(zip(codes, range(len(codes)))), "fp long, node long")
    monkeypatch.setattr(simhash, "GROUP", 60)
    found = {r.node: r.component for r in graph.components(simhash.links(df)).collect()}
    want = brute_components(dict(enumerate(codes)))
    assert len(set(want.values())) > 20 and {i: found.get(i, i) for i in range(len(codes))} == want


def test_families_lose_no_pair():
    rng = random.Random(9)
    for _ in range(2000):
        bits = rng.sample(range(64), 4)
        flip = sum(1 << b for b in bits)
        assert any(flip & (m % (1 << 64)) == 0 for m in simhash.families())


def test_links_of_planted_codes(spark):
    codes = planted(random.Random(11), 800, 6)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = simhash.links(spark.createDataFrame(list(zip(signed, range(len(codes)))), "fp long, node long"))
    found = {r.node: r.component for r in graph.components(links).collect()}
    want = brute_components(dict(enumerate(codes)))
    assert {i: found.get(i, i) for i in range(len(codes))} == want


def test_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5000, 5000)]
    random.Random(1).shuffle(edges)
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(301)} | {1000 + k: 1000 for k in range(50)}


def test_null_ids_and_empty(spark, docs, no_docs):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (4, "a b c d e"), (4, "a b c d e")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.cluster(df).collect()) == [(0, 0), (3, 3), (4, 3), (4, 3)]
    assert sorted(str(r.doc_id) for r in simhash.clean(df).collect()) == ["3", "None"]
    assert simhash.cluster(no_docs).count() == 0
    assert simhash.clean(docs).columns == docs.columns


def test_unsettled_components_are_an_error(spark, monkeypatch):
    from lodeline.llm import graph

    monkeypatch.setattr(graph, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="not settled"):
        graph.components(spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long"))
