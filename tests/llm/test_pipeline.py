import numpy as np
import public_tokenizers as P

import corpus_pipeline
from lodeline.llm import bpe, decontam, pii, quality, simhash
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_simhash import brute_components, brute_print


def test_run_matches_brute_force(spark, docs, texts, tmp_path):
    sf = str(tmp_path)
    plain = docs.drop("n_words")
    plain.write.parquet(f"{sf}/documents.parquet")
    items = [(1, texts[20]), (2, texts[21])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}

    left = {r.doc_id: r for r in plain.collect()}
    stats = quality.statistics(plain)
    assert quality.fit(stats).count() <= 4
    left = {r.doc_id: left[r.doc_id] for r in quality.judge(stats, quality.fit(stats)).where("kept").collect()}
    component = brute_components({i: brute_print(r.text) for i, r in left.items()})
    left = {i: r for i, r in left.items() if component[i] == i}
    left = {i: r for i, r in left.items() if not brute_hits(r.text, items, 10)[1]}
    assert set(got) == set(left) and 0 < len(left) < len(texts)
    encoding = bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    weights = pii.fit(spark.createDataFrame([(r.text,) for r in left.values()], "text string"))["weights"]
    for i, row in left.items():
        masked = pii.masked(row.text, pii.spans_of(row.text, weights)[1])
        assert np.frombuffer(got[i].ids, "<u4").tolist() == encoding.encode_ordinary(masked)
        assert got[i].round_trip and got[i].n_tokens * 4 == len(got[i].ids)


def test_stages_keep_columns(docs, spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    plain = docs.drop("n_words")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, plain, sf).columns == plain.columns, name
