import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeline.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, min_length=24, min_exponent=3):
    """Every period tried at every place; of equal stretches the least period."""
    found = {}
    for q in range(1, len(words) // min_exponent + 1):
        s = 0
        while s + q < len(words):
            t = s
            while t + q < len(words) and words[t] == words[t + q]:
                t += 1
            if t > s:
                if t - s + q >= max(min_length, min_exponent * q):
                    found.setdefault((s, t - s + q), q)
                s = t
            s += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_collapsed(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def planted_words(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def repetitive(rng, n, letters):
    words = [b"%d" % rng.randrange(letters) for _ in range(n)]
    for _ in range(3):
        at, period, long = rng.randrange(n), rng.randrange(1, 13), rng.randrange(1, 90)
        for i in range(at + period, min(n, at + long)):
            words[i] = words[i - period]
    return words


@pytest.mark.parametrize("min_length,min_exponent", [(24, 3), (6, 2), (9, 4), (1, 2)])
def test_runs_match_brute_force(min_length, min_exponent):
    rng = random.Random(min_length)
    for _ in range(300):
        words = repetitive(rng, rng.randrange(1, 150), rng.choice([1, 2, 3, 6, 50]))
        assert periodic.runs_of_words(words, min_length, min_exponent) == brute(words, min_length, min_exponent)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=80))
def test_runs_of_few_letters(words):
    assert periodic.runs_of_words(words, 4, 2) == brute(words, 4, 2)


def test_sets_of_many_positions(monkeypatch):
    monkeypatch.setattr(periodic, "LOAD", 4)
    rng = random.Random(1)
    held, ends = [50], periodic.Ends(50)
    for x in rng.sample([i for i in range(400) if i != 50], 300):
        assert ends.add(x) == (max((h for h in held if h < x), default=None), min((h for h in held if h > x), default=None))
        held.append(x)
    assert list(ends) == sorted(held)


def test_long_runs_and_no_runs():
    assert periodic.runs_of_words([b"a"] * 30_000) == [(0, 30_000, 1)]
    assert periodic.runs_of_words([b"%d" % (i % 37) for i in range(30_000)]) == [(0, 30_000, 37)]
    assert periodic.runs_of_words([b"%d" % i for i in range(5000)]) == [] == periodic.stretches(periodic._numbered([b"%d" % i for i in range(5000)]))
    assert periodic.runs_of_words([b"a"] * 23) == [] and periodic.runs_of_words([b"a"] * 24) == [(0, 24, 1)]


def test_find_and_clean(spark, docs, no_docs, texts):
    wide = docs.withColumn("runs", docs.source)
    found = {r.doc_id: r for r in periodic.find(wide, keep=["doc_id", "runs"]).collect()}
    cleaned = {r.doc_id: r for r in periodic.clean(wide).collect()}
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        if len(words) > 1500:
            continue
        runs = brute(words)
        assert [(r.start, r.length, r.period) for r in found[i].runs] == runs and found[i].n_words == len(words)
        assert (found[i].collapsed or "").split() == " ".join(brute_collapsed(words, runs)).split()
        assert cleaned[i].text == (" ".join(brute_collapsed(words, runs)) if runs else text) and cleaned[i].runs == f"s{i % 2}"
    assert periodic.clean(wide).columns == wide.columns
    assert periodic.find(no_docs).count() == 0 and periodic.digest(periodic.find(no_docs)).count() == 0


def test_planted_rows(spark, docs, texts):
    rows = {r.doc_id: r.text for r in periodic.planted(docs).collect()}
    for i, text in enumerate(texts):
        want = planted_words(i, text)
        assert WORD.findall(rows[i] or "") == want
    assert sum(rows[i] != t for i, t in enumerate(texts)) > 3
    assert periodic.planted(spark.createDataFrame([(None, "a b c")], "doc_id long, text string")).first().text == "a b c"
