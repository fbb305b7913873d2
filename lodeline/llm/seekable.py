"""Token ids in binary files of independent zstandard frames with a trailing seek table.

File format. One zstandard frame per document (its ids as little-endian unsigned
integers of 2 or 4 bytes), one more for the directory (document ids), then the
seek table as a skippable frame laid out by the public zstandard seekable
format: compressed size, decompressed size and checksum (low 32 bits of XXH64 of
the decompressed bytes) for each frame, then their number, a descriptor byte and
a magic number. Any zstandard tool can decompress the file; a reader that wants
some documents reads the tail, then those frames alone.

``write`` range-partitions documents by id, encodes them where they land and
streams one file per partition; memory holds one batch and twenty bytes a
document. ``manifest.json`` lists the files with the number of tokens before
each (its size is that of the list of partitions). ``read`` verifies every
checksum. A file appears under its name only when whole, and a task that runs
twice writes the same bytes, so lost executors cost only their own work.

Encoding uses the tokenizers library. A text of the Latin blocks is cut into the
library's pre-tokens, whose ids its model gives and a bounded cache keeps; other
texts are cut before single spaces between two non-blank characters, where no
pre-token can span, and the pieces left to the library. Very long texts are worked
through in parts, cut at such places. A text with a special token spelled out goes
through the library whole, which gives that token's id.

Edge cases: a null or empty text is a document with only the end id; documents
without an id come first; documents that share an id keep the order of their
texts' hashes; an empty table writes a manifest without files; extra columns are
ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import drop, new_dir, open_fs, parts, publish, table

# Fixed values of the zstandard seekable format.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 1 << 7
LEVEL = 1
#: Pre-tokens whose ids a Python process keeps, and the longest of them.
CACHE, KEPT = 400_000, 64
#: Characters of a text that are cut up at a time.
LONG_TEXT = 1 << 16
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: What the byte-level pre-tokenizer cuts a text of these characters into; other texts are left to the library.
_LATIN = re.compile("[\\x00-\\x1b\\x20-\u024f]*")


def _pre_tokens() -> re.Pattern:
    """The pre-tokenizer's pattern for these characters; plain sets, letters first, are what the engine scans fastest."""
    named = lambda kind: "".join(re.escape(c) for c in map(chr, range(0x250)) if re.fullmatch(kind, c))
    letters, numbers, others = named(r"[^\W\d_²³¹¼½¾]"), named(r"[\d²³¹¼½¾]"), named(r"[^\s\w²³¹¼½¾]|_")
    return re.compile(rf" ?[{letters}]+| ?[{numbers}]+|'(?:[st]|re|ve|m|ll|d)| ?[{others}]+|\s+(?!\S)|\s+")


_PRE = _pre_tokens()


class Encoder:
    """Ids of whole texts, as the tokenizer gives them when it adds no special tokens.

    A special token that a text spells out is one id, as in the library's plain call.
    """

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind, self.width = ("<u2", 2) if width == 2 else ("<u4", 4)
        self.packed = [i.to_bytes(self.width, "little") for i in range(self.tokenizer.get_vocab_size())]
        mapped = ByteLevel(add_prefix_space=False, use_regex=False)
        # The byte alphabet of the pre-tokenizer, from the library itself.
        self.letters = str.maketrans({chr(i): mapped.pre_tokenize_str(chr(i))[0][0] for i in range(0x250)})
        self.cache: dict[str, bytes] = {}

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def merged(self, word: str) -> bytes:
        """The ids of one pre-token."""
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(word.translate(self.letters))])

    def known(self, pieces: list[str], make) -> bytes:
        """The ids of pieces in a row, from the cache or by ``make``."""
        cache = self.cache
        found = list(map(cache.get, pieces))
        if None in found:
            if len(cache) > CACHE:
                cache.clear()
            for i, ids in enumerate(found):
                if ids is None:
                    piece = pieces[i]
                    if (ids := cache.get(piece)) is None:
                        ids = make(piece)
                        if len(piece) <= KEPT:
                            cache[piece] = ids
                    found[i] = ids
        return b"".join(found)

    def part(self, text: str) -> bytes:
        if _LATIN.fullmatch(text):
            return self.known(_PRE.findall(text), self.merged)
        head, *rest = _CUT.split(text)
        return self.library(head) + self.known([" " + r for r in rest], self.library)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.library(text)
        out, at = [], 0
        while len(text) - at > LONG_TEXT and (cut := _CUT.search(text, at + LONG_TEXT)):
            out.append(self.part(text[at : cut.start()]))
            at = cut.start()
        return b"".join([*out, self.part(text[at:])])


@lru_cache(maxsize=2)
def encoder(path: str, width: int) -> Encoder:
    return Encoder(path, width)


class Writer:
    """Streams one file."""

    def __init__(self, uri: str, width: int):
        self.uri, self.width = uri, width
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.private = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.private, compression=None)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=True)
        self.ids: list[int | None] = []
        self.tokens, self.entries = 0, []

    def _frame(self, data: bytes) -> None:
        packed = self.pack.compress(data)
        self.entries.append(struct.pack("<III", len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.out.write(packed)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._frame(ids)
        self.ids.append(doc_id)
        self.tokens += len(ids) // self.width

    def close(self) -> None:
        known = np.array([i is not None for i in self.ids], np.uint8).tobytes()
        values = np.array([i or 0 for i in self.ids], "<i8").tobytes()
        self._frame(struct.pack("<BQ", self.width, len(self.ids)) + known + values)
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.private, self.path)


class Reader:
    """Random access to one file by document number."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        self.unpack = zstandard.ZstdDecompressor()
        size = self.file.size()
        count, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or not descriptor & CHECKSUMS:
            raise ValueError(f"{uri}: no seek table")
        raw = self.file.read_at(count * 12, size - 9 - count * 12)
        self.frames = np.frombuffer(raw, "<u4").reshape(count, 3).astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.frames[:, 0])))
        head = self.frame(count - 1)
        self.width, self.docs = struct.unpack_from("<BQ", head)
        known = np.frombuffer(head, np.uint8, self.docs, 9)
        values = np.frombuffer(head, "<i8", self.docs, 9 + self.docs)
        self.ids = [int(v) if k else None for k, v in zip(known, values)]
        self.starts = np.concatenate(([0], np.cumsum(self.frames[: self.docs, 1] // self.width)))

    def frame(self, k: int) -> bytes:
        packed, size, checksum = self.frames[k]
        data = self.unpack.decompress(self.file.read_at(int(packed), int(self.at[k])), max_output_size=int(size)) if size else b""
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} fails its checksum")
        return data

    def tokens(self, k: int) -> np.ndarray:
        """The ids of document number ``k``; decompresses that frame only."""
        return np.frombuffer(self.frame(k), "<u2" if self.width == 2 else "<u4").astype("<u4")

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes the files and the manifest; returns the manifest's entries."""
    spark = docs.sparkSession
    ordered = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).repartitionByRange(parts(spark), F.col("i").asc_nulls_first()).sortWithinPartitions(F.col("i").asc_nulls_first(), F.xxhash64("t"))

    def run(batches):
        writer, part = None, TaskContext.get().partitionId()
        end = np.array([end_id], "<u2" if width == 2 else "<u4").tobytes()
        encode = encoder(tokenizer_path, width).encode
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                writer = writer or Writer(f"{folder}/part-{part:06d}.zst", width)
                writer.add(doc_id, encode(text.as_py() or "") + end)
        if writer:
            writer.close()
            row = {"part": [part], "docs": [len(writer.ids)], "tokens": [writer.tokens]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([(k, pa.int64()) for k in row]))

    path = new_dir(spark, "seekable")
    rows = sorted(table(ordered.mapInArrow(run, "part long, docs long, tokens long"), "", path).collect())
    drop(spark, path)
    entries, before = [], 0
    for row in rows:
        entries.append({"part": row.part, "file": f"part-{row.part:06d}.zst", "docs": row.docs, "tokens": row.tokens, "start": before})
        before += row.tokens
    publish(f"{folder}/manifest.json", json.dumps(entries).encode())
    return entries


def manifest(folder: str) -> list[dict]:
    fs, path = open_fs(f"{folder}/manifest.json")
    with fs.open_input_stream(path) as lines:
        return json.loads(lines.read())


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of every file: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), ids_crc32."""
    entries = manifest(folder)
    schema = "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long"
    if not entries:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(e["part"], e["file"], e["start"]) for e in entries], "part long, file string, start long")
    placed = listed.repartitionByRange(len(entries), "part")

    def run(batches):
        names = ["doc_id", "start", "n_tokens", "ids", "ids_crc32"]
        for batch in batches:
            for file, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                reader = Reader(f"{folder}/{file}")
                for low in range(0, reader.docs, 500):
                    span = range(low, min(low + 500, reader.docs))
                    data = [reader.tokens(k).tobytes() for k in span]
                    columns = [[reader.ids[k] for k in span], [base + int(reader.starts[k]) for k in span], [len(d) // 4 for d in data], data, [zlib.crc32(d) for d in data]]
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
                reader.close()

    return placed.mapInArrow(run, schema)


def lookup(folder: str, doc_ids: set[int]) -> dict[int, np.ndarray]:
    """The ids of some documents: reads the tails of files and the requested frames alone."""
    found = {}
    for entry in manifest(folder):
        reader = Reader(f"{folder}/{entry['file']}")
        found |= {i: reader.tokens(k) for k, i in enumerate(reader.ids) if i in doc_ids}
        reader.close()
    return found
