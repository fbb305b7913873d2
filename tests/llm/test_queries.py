"""Every registered query, digests included, against a plain version on small tables; and columns with awkward names."""

import base64
import hashlib
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lodeline.llm import decontam, linecrf, queries, quality, quotes
from tests.llm import test_decontam, test_lexical, test_periodic, test_pii, test_quality, test_simhash


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def sf(spark, docs, texts, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs.drop("n_words").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, f"http://x/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(1, texts[20]), (2, texts[21]), (11, "alpha beta")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 5 > 1), 0) for i in range(0, len(texts), 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    talk = [(c, t, "user", f"message {c} of turn {t} says hello.\nIt has number {10 * c + t} on line two") for c in range(5) for t in range(4)]
    spark.createDataFrame([*talk, (7, 0, "user", None), (None, 1, None, "x")], "conv_id int, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


def test_op1(spark, sf, texts):
    got = {r.page_id: r for r in queries.op1_warc_revisits(spark, sf).collect()}
    first = {}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        first.setdefault(data, i)
        row = got[i]
        assert row.payload_bytes == len(data) and row.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (row.record_type, row.refers_to) == (("response", None) if first[data] == i else ("revisit", first[data]))


def test_op2(spark, sf, texts):
    prints = {i: test_simhash.brute_print(t) for i, t in enumerate(texts)}
    component = test_simhash.brute_components(prints)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op2_simhash_near_dedup(spark, sf).collect()} == {(i, f"{p:016x}", component[i]) for i, p in prints.items()}


def test_op3(spark, sf):
    got = {(r.conv_id, r.turn): r for r in queries.op3_quotation_linking(spark, sf).collect()}
    assert len(got) == 22
    for c in range(5):
        for t in range(4):
            row = got[c, t]
            assert (row.parent_conv, row.parent_turn, row.root_turn, row.depth) == ((c, t - 1, 0, t) if t else (None, None, 0, 0))
            assert row.text == f"message {c} of turn {t} says hello.\nIt has number {10 * c + t} on line two"
            assert row.n_quotes == min(t, 2)


def test_op4(spark, sf, texts):
    for row in queries.op4_quality_rules(spark, sf).collect():
        text = texts[row.doc_id] or ""
        if len(text) <= 20_000:
            n = test_quality.brute(text)
            assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (*n[:3], *n[4:])
            assert row.base_failed == (n[0] < 20 or 100 * n[5] > 30 * n[0]) and not (row.kept and row.base_failed)


def test_op5(spark, sf, texts):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    for row in sorted(queries.op5_seekable_token_files(spark, sf).collect()):
        ids = np.array([*library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op6(spark, sf, texts):
    got = {r.doc_id: r.n_bytes for r in queries.op6_size_tiered_compaction(spark, sf).collect()}
    assert got == {i: None if t is None else len(t.encode()) for i, t in enumerate(texts)}


def test_op7(spark, sf, texts):
    for row in queries.op7_pii_weak_supervision(spark, sf).collect():
        spans = test_pii.brute(texts[row.doc_id])
        base = [f"{queries.pii.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert row.base_sha256 == sha(",".join(base).encode())
        assert set(base) <= set(row.spans.split(",")) and [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]


def test_op8(spark, sf, texts):
    items = [(1, texts[20]), (2, texts[21]), (11, "alpha beta")]
    for row in queries.op8_benchmark_decontamination(spark, sf).collect():
        n, hit, found = test_decontam.brute(texts[row.doc_id], items, 10)
        assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (n, hit, len(found), hit > 0)
        assert row.items_sha256 == sha(",".join(sorted(map(str, found))).encode())


def test_op10(spark, sf, texts):
    encoding = queries.bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for row in queries.op10_byte_level_bpe(spark, sf).collect():
        text = texts[row.doc_id] or ""
        ids = encoding.encode_ordinary(text)
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text.encode()))


def test_op11(spark, sf, texts):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = test_periodic.planted_words(i, text)
        if len(words) > 1500:
            continue
        runs = test_periodic.brute(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        row = got[i]
        assert row.n_runs == len(runs)
        assert (row.start, row.length, row.period, row.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert row.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode())
        assert row.collapsed_sha256 == sha(" ".join(test_periodic.brute_collapsed(words, runs)).encode())


def test_op12(spark, sf, texts):
    items = [(1, texts[20]), (2, texts[21]), (11, "alpha beta")]
    assert test_lexical.rows_of(queries.op12_ranked_search(spark, sf)) == test_lexical.brute(list(enumerate(texts)), items, 50)


def test_op13(spark, sf, texts):
    got = {r.doc_id: r for r in queries.op13_line_crf_quality(spark, sf).collect()}
    assert len(got) == len(texts)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = linecrf.fit(docs, labels.where(F.col("doc_id").isin([i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5])))
    for i, text in enumerate(texts):
        row = got[i]
        assert row.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and row.predicted == int(row.score >= 0.3)
        assert row.score == pytest.approx(model.score((text or "").encode())[2], abs=1e-12)


AWKWARD = ("mean", "x0", "precision", "distance", "kept", "n_words", "base_failed", "hit_spans", "hit_items", "bin", "row", "__has", "has", "cites", "conv", "turn_no", "spans")


def test_columns_with_clashing_names_stay(spark, docs):
    wide = docs.drop("n_words").where("doc_id < 60").select("*", *(F.lit(f"my {c}").alias(c) for c in AWKWARD if c != "__has"))
    items = spark.createDataFrame([(1, "no such words anywhere in these texts at all today")], "item_id long, text string")
    for cleaned in (quality.clean(wide), decontam.clean(wide, items)):
        assert cleaned.columns == wide.columns
        row = cleaned.first()
        assert all(row[c] == f"my {c}" for c in AWKWARD if c != "__has")
    talk = spark.createDataFrame([(1, 0, "one two three four", "a", "b", "c", "d")], "conv_id long, turn long, text string, has string, cites string, conv string, turn_no string")
    assert quotes.conversations(talk).first()[3:7] == ("a", "b", "c", "d")


def test_replies_quote_two_levels(spark):
    talk = spark.createDataFrame([(1, 0, "a\nb"), (1, 1, "c"), (1, 2, "d"), (2, 5, "e"), (1, 3, None)], "conv_id long, turn long, text string")
    got = {(r.conv_id, r.turn): r.text for r in quotes.replies(talk).collect()}
    assert got == {(1, 0): "a\nb", (1, 1): "> a\n> b\n\nc", (1, 2): "> > a\n> > b\n> c\n\nd", (2, 5): "e", (1, 3): None}


def test_sql_gives_the_same_rows(spark, sf):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet/*.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = getattr(queries, name)(spark, sf)
        want = con.sql(sql)
        order = [want.columns.index(c) for c in got.columns]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall()), name
