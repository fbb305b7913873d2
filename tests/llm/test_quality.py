import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= set(range(i, i + 8))
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), dup, len(hit)


def test_statistics_match_brute_force(docs, texts):
    got = {r.doc_id: r for r in quality.statistics(docs, keep=["doc_id"]).collect()}
    for i, text in enumerate(texts):
        if len(text or "") > 20_000:
            continue
        n = brute(text)
        assert tuple(got[i][c] for c in quality.STATS) == n
        assert got[i].base_failed == (n[0] < 20 or 100 * n[5] > 30 * n[0])


@pytest.mark.parametrize("p,dims,value", [(0.95, 5, 11.0705), (0.5, 2, 1.3863), (0.999, 7, 24.3219)])
def test_chi_square(p, dims, value):
    assert quality.chi_square_quantile(p, dims) == pytest.approx(value, abs=1e-3)


@pytest.fixture(scope="module")
def stats(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g, (lang, source) in enumerate([("en", "a"), ("en", None), ("de", "a")]):
        for i in range(400 if g < 2 else 30):
            n = int(np.exp(rng.normal(5.5 + g, 0.6))) + 20
            odd = g < 2 and i < 60
            rows.append((g * 1000 + i, lang, source, n, int(n * (5.2 + rng.normal(0, 0.2))), n * 2 if odd else 0, max(1, n // 12), 0, n // 4 if odd else 0, False))
    rows.append((9999, "en", "a", 0, 0, 0, 0, 0, 0, True))
    return spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean")


def brute_fit(frame):
    """The same concentration steps on one group, in plain numpy."""
    x = frame[[f"x{i}" for i in range(quality.DIMS)]].to_numpy(float)
    floors = np.square(np.array(quality.FLOORS, float))

    def estimate(rows, scale):
        return rows.mean(0), np.cov(rows.T, bias=True) * scale + np.diag(floors)

    def quantile(column, q):
        steps = np.sort(np.floor(column / 20))
        return steps[int(np.ceil(q * len(steps))) - 1] * 20 + 10

    mid = np.array([quantile(c, 0.5) for c in x.T])
    sd = np.array([(quantile(c, 0.75) - quantile(c, 0.25)) / 1.349 for c in x.T])
    best = None
    for mean, cov in ((mid, np.diag(sd**2 + floors)), estimate(x, 1.0)):
        for _ in range(quality.STEPS):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            bins = np.floor(np.log(np.maximum(d, 1e-6)) * 32)
            limit = np.sort(bins)[int(np.ceil(len(x) * quality.SUPPORT)) - 1]
            mean, cov = estimate(x[bins <= limit], quality.CONSISTENCY)
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = (det, mean, cov)
    return best


def test_estimates_match_brute_force(stats):
    model = {(r.lang, r.source): r for r in quality.fit(stats).collect()}
    assert set(model) == {("en", "a"), ("en", None)}
    for (lang, source), row in model.items():
        group = stats.where(~F.col("base_failed") & F.col("lang").eqNullSafe(lang) & F.col("source").eqNullSafe(source)).select(*quality.vector()).toPandas()
        det, mean, cov = brute_fit(group)
        assert row.log_det == pytest.approx(det, rel=1e-9)
        np.testing.assert_allclose(row["mean"], mean, rtol=1e-9)
        np.testing.assert_allclose(np.array(row.precision).reshape(quality.DIMS, -1), np.linalg.inv(cov), rtol=1e-6)


def test_verdicts(stats):
    judged = {r.doc_id: r for r in quality.judge(stats, quality.fit(stats)).collect()}
    for i, row in judged.items():
        odd = i < 2000 and i % 1000 < 60
        assert row.kept == (not row.base_failed and not odd), (i, row)
    assert judged[2000].distance is None and not judged[9999].kept


def test_small_groups_are_judged_by_language_or_all(spark, stats):
    """Groups of 20 rows: of a language with an estimate, of a small language, and of rows the base rules reject."""
    new = []
    for g, (lang, source) in enumerate([("en", "small"), ("fr", "a")]):
        for i in range(20):
            odd = i < 3
            n = 200 + 20 * i
            new.append((20_000 + g * 1000 + i, lang, source, n, int(n * 5.2), n * 2 if odd else 0, n // 12, 0, n // 4 if odd else 0, False))
    new.append((29_999, "it", None, 0, 0, 0, 0, 0, 0, True))
    both = stats.unionByName(spark.createDataFrame(new, stats.schema))
    model = {(r.lang, r.source): r for r in quality.estimates(both).collect()}
    assert set(model) == {("en", "a"), ("en", None), ("de", "a"), ("en", "small"), ("fr", "a"), ("it", None)}
    vector = both.where(~F.col("base_failed")).select("lang", *quality.vector()).toPandas()
    for key, rows in ((("en", "small"), vector[vector.lang == "en"]), (("de", "a"), vector), (("fr", "a"), vector)):
        det, mean, _ = brute_fit(rows)
        assert model[key]["rows"] == len(rows) and model[key].log_det == pytest.approx(det, rel=1e-9)
        np.testing.assert_allclose(model[key]["mean"], mean, rtol=1e-9)
    for row in quality.judge(both, quality.estimates(both)).collect():
        odd = row.doc_id % 1000 < (3 if row.doc_id >= 20_000 else 60) and not 2000 <= row.doc_id < 9999
        assert row.distance is not None and row.kept == (not row.base_failed and not odd), row


def test_clean_and_empty(docs, no_docs):
    plain = docs.drop("n_words")
    kept = quality.clean(plain)
    assert kept.columns == plain.columns and 0 < kept.count() < plain.count()
    assert quality.clean(no_docs).count() == 0
