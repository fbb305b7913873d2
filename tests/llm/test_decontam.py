import hashlib
import re

import pytest

from lodeline.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, n):
    words, hit, found = brute_words(text), set(), set()
    for item, body in items:
        own = brute_words(body)
        if item is None or not own:
            continue
        size = min(n, len(own))
        for k in range(len(own) - size + 1):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[k : k + size]:
                    hit |= set(range(i, i + size))
                    found.add(item)
    return len(words), len(hit), found


@pytest.fixture(scope="module")
def items(texts):
    return [(1, texts[0]), (2, "alpha"), (3, None), (4, ""), (5, (texts[5] or "") + " zzzz"), (None, texts[7]), (11, " ".join((texts[9] or "").split()[2:20])), (1, texts[11])]


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_matches_brute_force(spark, docs, texts, items, block_bytes):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.digest(decontam.scan(docs, bench, keep=["doc_id"], block_bytes=block_bytes)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n, hit, found = brute(text, items, 10)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (n, hit, len(found), digest, hit > 0)


def test_chunks_of_long_texts(monkeypatch):
    monkeypatch.setattr(decontam, "CHUNK_WORDS", 16)
    windows = decontam.windows_of([(7, b"a b c d e f g h i j k l")], 10)
    words = [b"z"] * 13 + b"a b c d e f g h i j k l".split() + [b"z"] * 40
    assert [(a, b) for a, b, _ in decontam.hits_of(words, windows)] == [(13, 23), (14, 24), (15, 25)]


def test_clean_and_empty(spark, docs, no_docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontam.clean(docs.drop("n_words"), bench)
    assert kept.columns == docs.drop("n_words").columns
    dirty = {r.doc_id for r in decontam.digest(decontam.scan(docs, bench, keep=["doc_id"])).where("contaminated").collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - dirty
    assert decontam.scan(no_docs, bench).count() == 0
    assert decontam.scan(docs, bench.limit(0)).where("size(hit_items) > 0").count() == 0
