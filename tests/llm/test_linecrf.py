import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.llm import linecrf
from tests.llm.conftest import prose


def brute_marginals(model, rows):
    """All labelings, one by one."""
    odds = model._odds(rows)
    total, good = 0.0, np.zeros(len(rows))
    for labels in itertools.product((0, 1), repeat=len(rows)):
        weight = np.prod([odds[t, y] for t, y in enumerate(labels)]) * np.exp(sum(model.pairs[a, b] for a, b in zip(labels, labels[1:])))
        total += weight
        good += weight * np.array(labels)
    return good / total


@pytest.fixture(scope="module")
def random_model():
    rng = np.random.default_rng(4)
    return linecrf.Model(rng.normal(0, 0.4, linecrf.N_FEATURES), rng.normal(0, 1, (2, 2)))


def test_marginals_match_all_labelings(random_model, texts):
    for text in [t for t in texts if t and 1 <= t.count("\n") <= 9][:12] + ["one line", "", None]:
        rows = linecrf.features(linecrf.measures((text or "").encode())[0])
        assert random_model.marginals(rows) == pytest.approx(brute_marginals(random_model, rows), abs=1e-9)


def test_chains_side_by_side(random_model, texts):
    documents = [linecrf.features(linecrf.measures(t.encode())[0]) for t in texts if t and len(t) < 20_000]
    chains = linecrf._Chains(documents)
    marginal, counts = chains.expected(random_model._odds(chains.rows), random_model.pairs)
    want = chains.lay([random_model.marginals(d) for d in documents])
    assert marginal == pytest.approx(want, abs=1e-9)
    assert counts.sum() == pytest.approx(sum(len(d) - 1 for d in documents))
    one = linecrf._Chains([documents[0][:1]] * 2 + [np.repeat(documents[0][:1], 3, axis=0)])
    odds = random_model._odds(one.rows)
    _, counts = one.expected(odds, random_model.pairs)
    step, want, total = np.exp(random_model.pairs), np.zeros((2, 2)), 0
    for a, b, c in itertools.product((0, 1), repeat=3):
        weight = odds[0, a] * odds[0, b] * odds[0, c] * step[a, b] * step[b, c]
        want[a, b] += weight
        want[b, c] += weight
        total += weight
    assert counts == pytest.approx(want / total)


def test_a_line_in_numbers():
    values, chars = linecrf.measures("Éa #b!\n\n \nA A A A A A\nÉa #b!".encode())
    lines = [dict(zip(linecrf.STATS, v)) for v in values]
    assert chars.tolist() == [6, 11, 6]
    assert lines[0]["words"] == 2 and lines[0]["symbols_a_word"] == 0.5 and lines[0]["marks_a_word"] == 0.5 and lines[0]["ends_a_sentence"] == 1
    assert lines[1]["echoes"] == pytest.approx(5 / 6) and lines[1]["capitals"] == 1 and lines[1]["seen_before"] == pytest.approx(2 / 3)
    assert (lines[0]["repeats_a_line"], lines[2]["repeats_a_line"]) == (0, 1)


def bad(rng, n):
    return " ".join(rng.choice(("BUY!!", "NOW!!", "| menu |", "$$$ win", "go go go go")) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng, rows = random.Random(8), []
    for i in range(400):
        good = i % 4 > 0
        lines = [(prose if good else bad)(rng, rng.randrange(6, 40)) for _ in range(rng.randrange(1, 8))]
        if not good and i % 8 == 0:
            lines = [prose(rng, 12), *lines]  # a clean line above
        rows.append((i, "\n".join(lines), int(good)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string").repartition(3)
    marks = [(i, g) for i, _, g in rows if i % 2] + [(i, g) for i, _, g in rows if i % 2 == 0] + [(None, 1), (1, None), (9999, 0)]
    return docs, spark.createDataFrame(marks, "doc_id long, quality int"), rows


def test_held_out_accuracy_and_clean_lines(spark, labelled):
    docs, labels, rows = labelled
    model = linecrf.fit(docs, labels.where("doc_id % 5 > 0"))
    got = {r.doc_id: r for r in linecrf.score(docs, model).collect()}
    right = [(got[i].score >= 0.3) == bool(g) for i, _, g in rows if i % 5 == 0]
    assert sum(right) / len(right) > 0.97
    first = [got[i].lines[0].good for i, t, g in rows if not g and i % 8 == 0 and "\n" in t]
    rest = [x.good for i, t, g in rows if not g and i % 8 == 0 for x in got[i].lines[1:]]
    assert np.mean(first) > 0.5 > 0.2 > np.mean(rest)
    kept = linecrf.clean(docs, model)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {"x"}
    assert 280 <= kept.count() <= 320
    again = linecrf.fit(docs.repartition(7), labels.where("doc_id % 5 > 0").repartition(5))
    assert (again.weights == model.weights).all() and (again.pairs == model.pairs).all()


def test_edges(spark, docs, no_docs, labelled):
    _, labels, _ = labelled
    none = linecrf.fit(docs, labels.limit(0))
    assert {r.score for r in linecrf.score(docs, none, keep=["doc_id"]).collect()} == {0.5}
    model = linecrf.fit(docs, labels)
    got = {r.doc_id: r for r in linecrf.score(docs, model).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    blank = [r.score for r in got.values() if not (r.text or "").strip()]
    assert len(blank) > 3 and len(set(blank)) == 1
    assert linecrf.score(no_docs, model).count() == 0
    assert 0 <= model.score(b"word " * 200_000)[2] <= 1 and 0 <= model.score(b"x\n" * 50_000)[2] <= 1
    both = labels.unionByName(labels.withColumn("quality", F.lit(0)))
    assert linecrf.fit(docs, both.where("quality = 0")).score(b"anything at all")[2] < 0.5
