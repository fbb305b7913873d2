"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

``encode`` adds a binary column of token ids (little-endian unsigned 32-bit
integers), ``decode`` turns such a column back into raw bytes. Both are
row-local: one Arrow pass over the partition, no shuffle, nothing kept beyond
the batch in hand.

Long texts are cut where a cut can't change the result: before a single space
between two ASCII letters or digits. No match of a pattern of the usual kind
(an optional leading space and a run of one character class) spans such a
place, so the ids of the pieces, put together, are those of the whole.

Edge cases: a null text counts as empty; an empty text has no ids (zero
bytes); other columns pass through untouched, and an input column with the name
of the output column is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from .storage import sliced

#: Characters beyond which a text is encoded in pieces.
LONG_TEXT = 1 << 16
_SAFE = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")


@lru_cache(maxsize=4)
def load(rank_path: str, pattern: str):
    """The encoding of a rank file, once per Python process."""
    import tiktoken

    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut at safe places only."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(encoding, text: str | None) -> bytes:
    if not text:
        return b""
    if len(text) <= LONG_TEXT:
        return np.asarray(encoding.encode_ordinary(text), dtype="<u4").tobytes()
    return b"".join(np.asarray(encoding.encode_ordinary(p), dtype="<u4").tobytes() for p in pieces(text))


def decode_ids(encoding, ids: bytes | None) -> bytes:
    return encoding.decode_bytes(np.frombuffer(ids or b"", dtype="<u4").tolist())


def _with_columns(df: DataFrame, added: pa.Schema, function, gone: tuple[str, ...] = ()) -> DataFrame:
    """Appends the columns ``added``, whose values ``function(batch)`` makes, in one Arrow pass."""
    places = [i for i, field in enumerate(df.schema.names) if field not in (*added.names, *gone)]
    schema = T.StructType([*(df.schema.fields[i] for i in places), *from_arrow_schema(added).fields])

    def run(batches):
        for batch in sliced(batches):
            made = [pa.array(values, field.type) for values, field in zip(function(batch), added)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), *made], names=schema.names)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col``: the ids of the whole text, as the library gives without special tokens."""
    place = df.schema.names.index(text_col)

    def run(batch):
        encoding = load(rank_path, pattern)
        return [[encode_text(encoding, text) for text in batch.column(place).to_pylist()]]

    return _with_columns(df, pa.schema([(ids_col, pa.binary())]), run)


def decode(df: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``: the raw bytes that the ids stand for (null ids: no bytes)."""
    place = df.schema.names.index(ids_col)

    def run(batch):
        encoding = load(rank_path, pattern)
        return [[decode_ids(encoding, ids) for ids in batch.column(place).to_pylist()]]

    return _with_columns(df, pa.schema([(out_col, pa.binary())]), run)


def round_trip(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", same_col: str = "round_trip") -> DataFrame:
    """``df`` without its texts: their ids, and whether decoding these gives the texts' bytes. One pass, so a worker holds one encoding."""
    place = df.schema.names.index(text_col)

    def run(batch):
        encoding = load(rank_path, pattern)
        texts = batch.column(place).to_pylist()
        ids = [encode_text(encoding, text) for text in texts]
        return ids, [decode_ids(encoding, i) == (text or "").encode() for i, text in zip(ids, texts)]

    return _with_columns(df, pa.schema([(ids_col, pa.binary()), (same_col, pa.bool_())]), run, (text_col,))
