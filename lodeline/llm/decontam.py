"""Benchmark decontamination with a broadcast set of normalised n-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.
A benchmark item gives its windows of ``n`` consecutive words, or one window of
all its words if it has fewer. ``scan`` finds every window in every document
and reports the words that an occurrence covers.

The set is broadcast, so its size is bounded: items are taken in blocks of at
most ``block_bytes`` of text, one scan per block; between two scans the result
so far is written to the shared folder and the broadcast is released. A larger
benchmark costs more scans, never more memory. There is no shuffle; hits are compared as whole word sequences, so a hash
collision can't make one.

Edge cases: a null or empty text has no words and is never contaminated; items
without words or without an id are no items; items that share an id count
once; repeated documents are judged one by one; input columns named like an
output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import private, sliced, table

#: Lower-cases A-Z, keeps digits, letters and all bytes of other characters, blanks the rest.
_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
#: Words looked at together; bounds the memory that one long text takes.
CHUNK_WORDS = 1 << 17
OUTPUTS = ("n_words", "hit_spans", "hit_items")
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def windows_of(items: Iterable[tuple[int, bytes | None]], n: int) -> dict[int, dict[bytes, set[int]]]:
    """Window length -> window -> ids of the items that have it."""
    found: dict[int, dict[bytes, set[int]]] = {}
    for item, text in items:
        words = words_of(text)
        if item is None or not words:
            continue
        size = min(n, len(words))
        for at in range(len(words) - size + 1):
            found.setdefault(size, {}).setdefault(b" ".join(words[at : at + size]), set()).add(item)
    return found


def hits_of(words: list[bytes], windows: dict[int, dict[bytes, set[int]]]) -> list[tuple[int, int, set[int]]]:
    """Every occurrence: first word, word after the last, items."""
    found = []
    for size, known in windows.items():
        step = CHUNK_WORDS
        for base in range(0, max(0, len(words) - size + 1), step):
            part = words[base : base + step + size - 1]
            text = b" ".join(part)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
            starts = np.concatenate(([0], ends[: len(part) - size] + 1)).tolist()
            seen = [text[a:b] for a, b in zip(starts, ends[size - 1 :].tolist())]
            if not known.keys().isdisjoint(seen):
                found += [(base + i, base + i + size, known[w]) for i, w in enumerate(seen) if w in known]
    return found


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of word ranges, as disjoint ranges in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The benchmark in blocks of about ``block_bytes``, one at a time on the driver."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t")).where("i is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    count = int(total // block_bytes) + 1
    for k in range(count):
        block = items if count == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k)
        yield k == 0, k == count - 1, [(row.i, bytes(row.t)) for row in block.toLocalIterator()]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: list[str] | None = None,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, hit_spans (disjoint word ranges) and hit_items.

    ``block_bytes`` bounds what is broadcast: windows of a block take about ten times that.
    """
    sc = docs.sparkSession.sparkContext
    names = [c for c in (keep if keep is not None else docs.columns) if c not in OUTPUTS]
    fields = [docs.schema[c] for c in names]
    out_fields = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", _SPANS), T.StructField("hit_items", T.ArrayType(T.LongType()))]
    carry = text_col not in names
    source = docs.select(*names, *([text_col] if carry else []))
    result = source
    for first, last, items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        block = sc.broadcast(windows_of(items, n))
        carried = source.schema.fields if carry and not last else fields
        out_names = [f.name for f in carried]

        def run(batches, block=block, first=first, out_names=out_names):
            types = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64())]
            for batch in sliced(batches):
                columns: list[list] = [[], [], []]
                texts = batch.column(batch.schema.names.index(text_col)).cast(pa.binary()).to_pylist()
                before = None if first else [batch.column(batch.schema.names.index(c)).to_pylist() for c in OUTPUTS]
                for i, text in enumerate(texts):
                    words = words_of(text)
                    hits = hits_of(words, block.value)
                    spans, items = [(a, b) for a, b, _ in hits], set().union(*(x for *_, x in hits))
                    if before is not None:
                        spans += [(s["start"], s["end"]) for s in before[1][i]]
                        items |= set(before[2][i])
                    for column, value in zip(columns, (len(words), [{"start": a, "end": b} for a, b in merged(spans)], sorted(items))):
                        column.append(value)
                kept = [batch.column(batch.schema.names.index(c)) for c in out_names]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, columns, types)], names=[*out_names, *OUTPUTS])

        result = result.mapInArrow(run, T.StructType([*carried, *out_fields]))
        if not last:
            result = table(result, "decontam")
            block.unpersist()
    return result


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The report: one row per document."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    items = F.array_sort(F.transform("hit_items", lambda i: i.cast("string")))
    return scanned.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated documents, with its own columns."""
    hidden, names = private(docs)
    options["text_col"] = names[options.get("text_col", "text")]
    return scan(hidden, benchmark, **options).where(F.size("hit_spans") == 0).select(*names.values()).toDF(*names)
