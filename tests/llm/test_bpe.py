import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest

from lodeline.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_matches_library_and_round_trips(docs, library):
    made = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert set(docs.columns) | {"ids", "decoded"} == set(made.columns)
    for row in made.collect():
        text = row.text or ""
        assert np.frombuffer(row.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()


def test_pieces_give_the_whole(library):
    text = "".join(f" word{i} 12 {'x' * (i % 7)}'ll  two\n\n {i}" for i in range(400))
    parts = list(bpe.pieces(text, 50))
    assert len(parts) > 20 and "".join(parts) == text
    assert [i for p in parts for i in library.encode_ordinary(p)] == library.encode_ordinary(text)


def test_long_text_is_cut(library):
    text = "some words and numbers 1234 " * 6000
    assert len(text) > bpe.LONG_TEXT
    assert np.frombuffer(bpe.encode_text(library, text), "<u4").tolist() == library.encode_ordinary(text)


def test_no_cut_in_a_run_without_blanks():
    assert list(bpe.pieces("a" * 200, 50)) == ["a" * 200]


def test_clashing_column_and_empty_table(docs, no_docs):
    clash = docs.withColumnRenamed("n_words", "ids")
    assert bpe.encode(clash, RANKS, P.PATTERN).schema["ids"].dataType.typeName() == "binary"
    assert bpe.encode(no_docs, RANKS, P.PATTERN).count() == 0
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(bpe.encode_text(None, None)).hexdigest()
