import zlib

import numpy as np
import public_tokenizers as P
import pytest
import zstandard

from lodeline.llm import seekable, storage

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def folder(spark, docs):
    path = storage.new_dir(spark, "tokens-test")
    seekable.write(docs, path, PATH, end_id=2)
    return path


def test_encoder_matches_library(texts, library):
    encoder = seekable.Encoder(PATH, 2)
    for text in [*texts, "<|endoftext|> x", " lead", "trail ", "a  b", "a \n b", "x y z", "ſ ǅ ʰ", "it's  'll", "a  b  c"]:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text or ""), "<u2").tolist() == want, text


def test_every_latin_character_in_every_position(library):
    encoder = seekable.Encoder(PATH, 2)
    frames = ("{}", "a{}b", " {} ", "1{}2", ".{}.", "\n{}\n", "{0}{0} x", "'{}", " {}a", "a {} 1", "  {}  ")
    for code in range(0x252):
        for frame in frames:
            text = frame.format(chr(code))
            assert np.frombuffer(encoder.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, (code, frame)


def test_special_tokens_and_long_texts_match_library(library):
    encoder = seekable.Encoder(PATH, 2)
    assert 50256 in np.frombuffer(encoder.encode("a <|endoftext|> b"), "<u2")
    for text in ("<|endoftext|>", "x <|endoftext|><|endoftext|>y", "one two, three.\n" * 20_000, "né \u4e2d\u6587 x " * 9_000, "a" * 200_000):
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_rows_match_brute_force(spark, folder, texts, library):
    got = sorted(seekable.read(spark, folder).collect())
    start = 0
    for i, (row, text) in enumerate(zip(got, texts, strict=True)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_lookup_reads_single_documents(folder, texts, library):
    found = seekable.lookup(folder, {3, 60})
    assert {k: v.tolist() for k, v in found.items()} == {k: [*library.encode(texts[k], add_special_tokens=False).ids, 2] for k in (3, 60)}


def test_damage_is_noticed(folder):
    entry = seekable.manifest(folder)[0]
    fs, path = storage.open_fs(f"{folder}/{entry['file']}")
    data = bytearray(fs.open_input_file(path).read())
    whole = zstandard.ZstdDecompressor().stream_reader(bytes(data), read_across_frames=True).read()
    assert len(whole) > entry["tokens"] * 2
    reader = seekable.Reader(f"{folder}/{entry['file']}")
    data[int(reader.at[0]) + int(reader.frames[0][0]) - 2] ^= 0xFF
    with fs.open_output_stream(path + ".bad", compression=None) as out:
        out.write(bytes(data))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        seekable.Reader(f"{folder}/{entry['file']}.bad").tokens(0)


def test_null_ids_ties_and_empty(spark, no_docs):
    df = spark.createDataFrame([(None, "x"), (4, "a b"), (4, "a b"), (1, None)], "doc_id long, text string")
    path = storage.new_dir(spark, "tokens-test")
    seekable.write(df, path, PATH, end_id=2)
    rows = sorted(seekable.read(spark, path).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(None, 2), (1, 1), (4, 3), (4, 3)]
    path = storage.new_dir(spark, "tokens-test")
    assert seekable.write(no_docs, path, PATH, end_id=2) == [] and seekable.read(spark, path).count() == 0
