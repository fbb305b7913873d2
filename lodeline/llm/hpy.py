"""Hierarchical Pitman-Yor language model, sampled by Gibbs sweeps over partitions of dishes.

The model. A token is a customer of the restaurant of its context (the word
before it) and eats its word. Each restaurant follows a Chinese-restaurant process
with discount and strength; who opens a table there becomes a customer of the
parent, the restaurant all contexts share, whose parent is uniform over the
known words and one unknown. Every context that occurs has a restaurant of its own.
Sweeps go on from the seating of the sweep before and reseat every dish given its totals;
after ``SWEEPS`` of them, predictive probabilities are averaged over ``SAMPLES``
seatings. A customer opens a table in proportion to (strength + discount *
tables) * parent probability, or joins one in proportion to customers -
discount * tables; beyond 32 customers of a dish they are drawn in blocks of a
sixteenth of those already seated.

How it scales. Tokens go once to the partition of their dish (dishes that are
frequent words are dealt by context, so no partition owns a hot word), as
compressed arrays sorted by word, and come back once as probabilities for their
documents. A sweep reads pair counts only, not tokens. Its customers and tables
a context are sent to the partition of the context, summed there, and sent back
to the partitions that have the context, as compressed arrays; the seating lies in
a table from sweep to sweep. Totals of the frequent dishes go along in these messages, a slice of them to
each partition of contexts; the driver gets their sums alone: O(``CONTEXTS``) numbers a sweep. A share makes
a row for each partition of contexts and one more; there is such a partition for ``CONTEXT_TOKENS`` training tokens
at most, however many shuffle partitions the session has. Nothing that grows with the vocabulary is collected
or broadcast. Seeds depend on partition and sweep, so a task that runs again
makes the same draws.

Tokens: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, then one end. Words are known
by their 64-bit hash. Edge cases: a null or empty text is the end alone; a null
doc_id is scored and learnt from like the id of empty text; repeated rows count
as often as they occur; very long texts are packed by themselves; an empty table gives an
empty result; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, new_dir, parts, table

#: Words are dealt by context, and their totals known to the driver, from this share of the training tokens on.
CONTEXTS = 1 << 14
#: Error of that share, as a part of it.
SLACK = 8
SWEEPS, SAMPLES, ROUNDS = 3, 3, 2
STRENGTH = 1.0
FOLDS, HELD_OUT = 7, 2
#: Tokens that a share of the dishes aims at, training tokens that a partition of contexts has at least, and most of these partitions.
SHARE_TOKENS, CONTEXT_TOKENS, CONTEXT_PARTS = 1 << 22, 1 << 19, 1 << 12
#: Tokens and documents that a task packs together, and packs for each shuffle partition.
PACK_TOKENS, PACK_DOCS, SPREAD = 1 << 21, 60_000, 4
#: Marks the key of a context that is no frequent word.
RARE = np.uint64(1 << 63)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


class _Ids(dict):
    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<3sQ", a.dtype.str.encode(), len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(_planes(a, len(a), a.itemsize).tobytes() for a in arrays))


def _planes(a: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """First bytes of all numbers, then second bytes and so on, which compress better; and back, with the sides exchanged."""
    return np.ascontiguousarray(np.frombuffer(a.tobytes(), np.uint8).reshape(rows, columns).T)


def _unsqueeze(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    kinds = [struct.unpack_from("<3sQ", data, 1 + 11 * k) for k in range(data[0])]
    out, at = [], 1 + 11 * len(kinds)
    for kind, n in kinds:
        width = np.dtype(kind.decode()).itemsize
        out.append(np.frombuffer(_planes(np.frombuffer(data, np.uint8, n * width, at), width, n).tobytes(), kind.decode()))
        at += n * width
    return out


# ---- frequent words ----------------------------------------------------------------------------------------------------


def frequent_words(docs: DataFrame, id_col: str, text_col: str) -> tuple[list[bytes], int]:
    """The words with at least one in CONTEXTS of the training tokens, give or take one in SLACK of that, and the number of these tokens."""
    most = 4 * SLACK * CONTEXTS

    def run(batches):
        seen, total = Counter(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not held_out(doc_id):
                    words = words_of(text)
                    total += len(words) + 1
                    seen.update(words)
                    if len(seen) > 2 * most:  # Misra-Gries: what is taken off each count stays below total / most
                        floor = sorted(seen.values(), reverse=True)[most]
                        seen = Counter({w: c - floor for w, c in seen.items() if c > floor})
        rows = [(w, c) for w, c in seen.items() if c * SLACK * CONTEXTS >= total] + [(None, total)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.int64())], names=["word", "n"])

    path = new_dir(docs.sparkSession, "words")
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, "word binary, n long")
    counts = table(rows.groupBy("word").agg(F.sum("n").alias("n")), "", path)
    total = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    # No more than CONTEXTS words can have this share.
    found = counts.where("word is not null").where(F.col("n") * CONTEXTS >= F.lit(total)).select("word").collect()
    drop(docs.sparkSession, path)
    return sorted(bytes(r.word) for r in found), total


# ---- tokens to the partitions of their dishes --------------------------------------------------------------------


def _deal(mixed: np.ndarray, n: int) -> np.ndarray:
    """A number below ``n`` for each hash."""
    return (((mixed ^ (mixed >> np.uint64(29))) * _MIX) >> np.uint64(20)) % np.uint64(n)


class _Packer:
    def __init__(self, hot: dict[bytes, int], shares: int, first_batch: int):
        self.hot, self.shares, self.batch = hot, np.uint64(shares), first_batch
        self.clear()

    def clear(self) -> None:
        self.vocabulary, self.tokens, self.sizes, self.ids = _Ids(), [], [], []

    def add(self, doc_id: int | None, text: bytes | None) -> bool:
        words = words_of(text)
        self.tokens.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words)))
        self.sizes.append(len(words) + 1)
        self.ids.append(doc_id)
        self.size = sum(self.sizes) if len(self.sizes) == 1 else self.size + len(words) + 1
        return self.size >= PACK_TOKENS or len(self.ids) >= PACK_DOCS

    def rows(self):
        """(share, batch, kind, payload): a directory (kind 1) and the tokens of each share of the dishes (kind 0)."""
        if not self.ids:
            return
        n, end, bos = len(self.ids), len(self.vocabulary), len(self.hot)
        sizes = np.array(self.sizes)
        held = np.array([held_out(i) for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], "<i8")
        known = np.array([i is not None for i in self.ids], np.uint8)
        yield int(self.batch % int(self.shares)), self.batch, 1, _squeeze(ids, known, held.astype(np.uint8), sizes.astype("<u4"))
        words = list(self.vocabulary)
        hashes = np.array([*(xxhash.xxh64_intdigest(w) for w in words), 0], np.uint64)
        hot = np.array([*(self.hot.get(w, -1) for w in words), bos], np.int64)
        doc = np.repeat(np.arange(n), sizes)
        last = np.cumsum(sizes) - 1
        token = np.full(len(doc), end)
        inner = np.ones(len(doc), bool)
        inner[last] = False
        token[inner] = np.concatenate(self.tokens)
        context = np.empty(len(doc), np.int64)
        context[1:] = token[:-1]
        context[last - sizes + 1] = end
        keys = np.where(hot >= 0, hot.astype(np.uint64), hashes | RARE)
        order = np.argsort((token.astype(np.uint64) << np.uint64(32)) | context.astype(np.uint64), kind="stable")
        token, context, doc = token[order], context[order], doc[order]
        mixed = hashes[token]
        dealt = hot[token] >= 0
        mixed[dealt] = np.where(hot[context[dealt]] < 0, np.uint64(0), mixed[dealt]) + keys[context[dealt]] * _MIX
        share = _deal(mixed, int(self.shares))
        order = np.argsort(share.astype(np.uint32), kind="stable")
        share, token, context, doc = share[order], token[order], context[order], doc[order]
        cuts = np.append(np.flatnonzero(np.append(True, share[1:] != share[:-1])), len(share))
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = token[a:b]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            there, at = np.unique(context[a:b], return_inverse=True)
            at = (at << 1 | held[doc[a:b]]).astype("<u4")
            payload = _squeeze(hashes[own[first]].astype("<u8"), hot[own[first]].astype("<i2"), np.diff(np.append(first, b - a)).astype("<u4"), at, doc[a:b].astype("<u2"), keys[there].astype("<u8"))
            yield int(share[a]), self.batch, 0, payload

    def take(self):
        yield from self.rows()
        self.batch += 1
        self.clear()


_PACKED = pa.schema([("share", pa.int32()), ("batch", pa.int64()), ("kind", pa.int8()), ("payload", pa.binary())])


def _pack(hot, shares: int):
    def run(batches):
        packer = _Packer(hot.value, shares, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if packer.add(doc_id, text.as_py()):
                    for row in packer.take():
                        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _PACKED)], schema=_PACKED)
        for row in packer.take():
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _PACKED)], schema=_PACKED)

    return run


def _gather(share: int, batches: list[int], payloads: list[bytes], count: int) -> tuple:
    """All tokens of a share as pairs of dish and context with their training counts, the tokens of each pair, and the contexts' keys by their partition."""
    blobs = [_unsqueeze(p) for p in payloads]
    word = np.concatenate([np.repeat(b[0], b[2]) for b in blobs])
    hot = np.concatenate([np.repeat(b[1], b[2]) for b in blobs])
    keys, at = np.unique(np.concatenate([b[5] for b in blobs]), return_inverse=True)
    order = np.argsort(_deal(keys, count), kind="stable")
    place = np.empty(len(keys), "<u4")
    place[order] = np.arange(len(keys))
    keys, at = keys[order], place[at]
    context = np.concatenate([part[b[3] >> 1] for part, b in zip(np.split(at, np.cumsum([len(b[5]) for b in blobs])[:-1]), blobs)])
    train = np.concatenate([b[3] & 1 == 0 for b in blobs])
    doc = np.concatenate([b[4] for b in blobs])
    source = np.repeat(np.arange(len(blobs), dtype=np.uint32), [len(b[3]) for b in blobs])
    del blobs
    dishes, first, dish = np.unique(word, return_index=True, return_inverse=True)
    key = (dish.astype(np.uint64) << np.uint64(32)) | context
    order = np.argsort(key, kind="stable")
    key, source, doc, train = key[order], source[order], doc[order], train[order]
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    total = np.diff(np.append(cut, len(key)))
    count = np.add.reduceat(train.astype(np.int64), cut)
    pair_dish, pair_context = (key[cut] >> np.uint64(32)).astype("<u4"), (key[cut] & np.uint64(0xFFFFFFFF)).astype("<u4")
    # By batch, then pair: what goes back to a batch lies together.
    pair = np.repeat(np.arange(len(cut), dtype="<u4"), total)
    back = np.argsort(source, kind="stable")
    sizes = np.bincount(source, minlength=len(batches)).astype("<u4")
    pairs = _squeeze(hot[first].astype("<i2"), np.diff(pair_dish, prepend=np.uint32(0)).astype("<u4"), pair_context, count.astype("<u4"))
    return share, pairs, _squeeze(np.array(batches, "<i8"), sizes, np.diff(pair[back].astype("<i8"), prepend=0).astype("<i4"), doc[back]), _squeeze(keys)


_SHARE = pa.schema([("share", pa.int32()), ("batch", pa.int64()), ("pairs", pa.binary()), ("tokens", pa.binary()), ("contexts", pa.binary())])


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return _rows(schema, [values])


def _regroup(count: int):
    """Rows sorted by share and kind: directories pass through, the tokens of a share become one row."""

    def gathered(share, held):
        s, pairs, tokens, contexts = _gather(share, [x for x, _ in held], [y for _, y in held], count)
        return _row(_SHARE, s, None, pairs, tokens, contexts)

    def run(batches):
        share, held = None, []
        for batch in batches:
            for s, b, kind, payload in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and s != share:
                    yield gathered(share, held)
                    held = []
                share = s
                if kind == 1:
                    yield _row(_SHARE, None, b, None, payload, None)
                else:
                    held.append((b, payload))
        if held:
            yield gathered(share, held)

    return run


# ---- seating -----------------------------------------------------------------------------------------------------


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers came in; ``weight`` is the pull of a new table."""
    tables = (customers > 0).astype(np.int64)
    order = np.flatnonzero(customers > 1)
    order = order[np.argsort(-customers[order], kind="stable")]
    c, w, t, seated = customers[order], weight[order], np.ones(len(order)), 1
    alive = len(order)
    while alive:
        block = max(1, seated // 16) if seated >= 32 else 1
        opens = w[:alive] / (w[:alive] + seated - discount * t[:alive])
        if block == 1:
            t[:alive] += rng.random(alive) < opens
        else:
            t[:alive] += rng.binomial(np.minimum(block, c[:alive] - seated), opens)
        seated += block
        alive = int(np.searchsorted(-c, -seated, side="left"))
    tables[order] = t.astype(np.int64)
    return tables


class Pairs:
    """The pairs of a share, and its part of the restaurants."""

    def __init__(self, blob: bytes):
        self.hot, dish, self.context, count = _unsqueeze(blob)
        self.dish, self.count = np.cumsum(dish.astype(np.int64)), count.astype(np.int64)
        self.served, self.context_at = self.count, self.context.astype(np.int64)
        self.total = np.bincount(self.dish, self.count, minlength=len(self.hot)).astype(np.int64)
        self.rare = self.hot < 0

    def parents(self, tables: np.ndarray) -> np.ndarray:
        """Customers of the shared restaurant: one for each table."""
        return np.bincount(self.dish, tables, minlength=len(self.hot)).astype(np.int64)

    def reseat(self, g: dict, rng: np.random.Generator, tables: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tables of pairs, customers and tables in the shared restaurant, and probabilities there."""
        tables = (self.served > 0).astype(np.int64) if tables is None else tables
        for _ in range(ROUNDS):
            customers = self.parents(tables)
            pull = (STRENGTH + g["d1"] * g["T1"]) * g["root"]
            shared = seat(np.where(self.rare, customers, 0), np.full(len(self.hot), pull), g["d1"], rng)
            p = (customers - g["d1"] * shared + pull) / (STRENGTH + g["C1"])
            p = np.where(self.rare, p, g["P1"][np.maximum(self.hot, 0)])
            tables = seat(self.served, (STRENGTH + g["d2"] * g["TT"][self.context_at]) * p[self.dish], g["d2"], rng)
        return tables, self.parents(tables), shared, p

    def predict(self, g: dict, tables: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probability of each pair's dish in its context."""
        shared, at = p[self.dish], self.context_at
        return (self.served - g["d2"] * tables + (STRENGTH + g["d2"] * g["TT"][at]) * shared) / (STRENGTH + g["CT"][at])

    def scalars(self, customers: np.ndarray, shared: np.ndarray) -> list[float]:
        """Numbers to be summed over all shares."""
        r = self.rare
        return [float(v) for v in (self.total.sum(), (self.total[r] > 0).sum(), customers[r].sum(), shared[r].sum(), (self.served == 1).sum(), (self.served == 2).sum(), (customers[r] == 1).sum(), (customers[r] == 2).sum())]

    def frequent(self, customers: np.ndarray, size: int, count: int) -> dict[int, bytes]:
        """Index, customers and tokens of frequent dishes in ``count`` slices of the ``size`` there are, to be summed by index over all shares."""
        at = np.flatnonzero(~self.rare)
        at = at[np.argsort(self.hot[at], kind="stable")]
        part = self.hot[at].astype(np.int64) * count // size
        slices = np.split(at, np.flatnonzero(part[1:] != part[:-1]) + 1) if len(at) else ()
        return {int(self.hot[own[0]]) * count // size: _squeeze(self.hot[own].astype("<u2"), customers[own].astype("<u8"), self.total[own].astype("<u8")) for own in slices}


#: Rows of a share in the order in which they are read: what it has, then what the partitions of its contexts answer, then its tokens.
PAIRS, KEYS, SEATED, TOKENS = -3, -2, -1, (1 << 31) - 1
_PART = "share int, part int, payload binary"
#: What a sweep makes: messages to partitions of contexts, with a slice of the frequent dishes' totals, and the seating, with sums.
TO_CONTEXTS, SEATING = range(2)
_SWEPT = pa.schema([("share", pa.int32()), ("part", pa.int32()), ("payload", pa.binary()), ("kind", pa.int8()), ("frequent", pa.binary()), ("sums", pa.list_(pa.float64()))])


def _by_share(batches):
    """Share and its payloads by part, from rows sorted by both."""
    share, held = None, {}
    for batch in batches:
        for s, part, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if s != share and held:
                yield share, held
                held = {}
            share = s
            held[part] = payload
    if held:
        yield share, held


def _here(g: dict, held: dict[int, bytes]) -> dict:
    """``g`` with customers and tables of the share's own contexts."""
    answers = [_unsqueeze(held[part]) for part in sorted(held) if 0 <= part < TOKENS]
    return {**g, "CT": np.concatenate([a[0] for a in answers]).astype(float), "TT": np.concatenate([a[1] for a in answers]).astype(float)}


def _sweep(g, sweep: int, size: int, count: int):
    """Shares -> their totals, messages to the partitions of their contexts, and the seating."""

    def run(batches):
        for share, held in _by_share(batches):
            pairs, (keys,) = Pairs(held[PAIRS]), _unsqueeze(held[KEYS])
            if g is None:
                tables = (pairs.served > 0).astype(np.int64)
                customers = pairs.parents(tables)
                shared = (customers > 0).astype(np.int64)
            else:
                seated = _unsqueeze(held[SEATED])[0].astype(np.int64)
                tables, customers, shared, _ = pairs.reseat(_here(g.value, held), np.random.default_rng((share, sweep)), seated)
            frequent = pairs.frequent(customers, size, count)
            served, opened = (np.bincount(pairs.context_at, x, minlength=len(keys)).astype("<u4") for x in (pairs.served, tables))
            cuts = np.searchsorted(_deal(keys, count), np.arange(count + 1, dtype=np.uint64))
            sent = {part: _squeeze(keys[a:b], served[a:b], opened[a:b]) for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b}
            yield _rows(_SWEPT, [(share, part, sent.get(part), TO_CONTEXTS, frequent.get(part), None) for part in sorted(sent.keys() | frequent.keys())] + [(share, SEATED, _squeeze(tables.astype("<u4")), SEATING, None, pairs.scalars(customers, shared))])

    return run


def _answer(batches):
    """Messages sorted by part -> to each share the sums over all shares, in the order of its contexts."""
    schema = pa.schema(list(_SWEPT)[:3])

    def summed(part, held):
        messages = [_unsqueeze(p) for _, p in held]
        keys, at = np.unique(np.concatenate([m[0] for m in messages]), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([m[i] for m in messages]), minlength=len(keys)).astype("<u8") for i in (1, 2)]
        answers = [(share, part, own) for (share, _), own in zip(held, np.split(at, np.cumsum([len(m[0]) for m in messages])[:-1]))]
        for low in range(0, len(answers), 64):
            yield _rows(schema, [(share, part, _squeeze(*(x[own] for x in sums))) for share, part, own in answers[low : low + 64]])

    part, held = None, []
    for batch in batches:
        for share, p, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if p != part and held:
                yield from summed(part, held)
                held = []
            part = p
            held.append((share, payload))
    if held:
        yield from summed(part, held)


def _summed(size: int, count: int):
    """Slices of the frequent dishes' totals sorted by part -> a row per part with their sums."""
    schema = pa.schema([("part", pa.int32()), ("payload", pa.binary())])

    def run(batches):
        now, low, sums = None, 0, None

        def row():
            at = np.flatnonzero(sums[2])
            return _row(schema, now, _squeeze((low + at).astype("<u2"), sums[0][at], sums[1][at]))

        for batch in batches:
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != now:
                    if sums is not None:
                        yield row()
                    now, low = part, -(-part * size // count)
                    sums = np.zeros((3, -(-(part + 1) * size // count) - low), "<u8")
                index, customers, total = _unsqueeze(payload.as_py())
                at = index.astype(int) - low
                sums[0, at] += customers
                sums[1, at] += total
                sums[2, at] = 1
        if sums is not None:
            yield row()

    return run


def _swept(rows: DataFrame, g, sweep: int, size: int, count: int, path: str) -> tuple[dict[int, np.ndarray], DataFrame]:
    """Totals for the driver after a sweep, and rows of the next one besides pairs and keys."""
    made = table(rows.mapInArrow(_sweep(g, sweep, size, count), f"{_PART}, kind byte, frequent binary, sums array<double>"), "", path, compression="none")
    out = {k: np.zeros(size) for k in (2, 3)}
    slices = made.where("frequent is not null").select("part", "frequent").repartition("part").sortWithinPartitions("part")
    for r in slices.mapInArrow(_summed(size, count), "part int, payload binary").collect():  # at most CONTEXTS dishes in all
        index, customers, total = _unsqueeze(r.payload)
        out[2][index], out[3][index] = customers, total
    sums = made.where(f"kind = {SEATING}").agg(*(F.sum(F.col("sums")[i]) for i in range(8))).first()
    out[4] = np.array([v or 0.0 for v in sums])
    sent = made.where(f"kind = {TO_CONTEXTS} and payload is not null").select("share", "part", "payload").repartition(count, "part").sortWithinPartitions("part", "share")
    return out, made.where(f"kind = {SEATING}").select("share", "part", "payload").unionByName(sent.mapInArrow(_answer, _PART))


def _restaurants(s: dict[int, np.ndarray], sweep: int, last: dict | None) -> dict:
    """Totals as the next sweep needs them; the driver seats the shared restaurant's frequent dishes."""
    tokens, rare, customers, tables, one, two, one1, two1 = s[4]
    known = rare + (s[3] > 0).sum()
    d2 = last["d2"] if last else min(0.95, max(0.05, one / max(1.0, one + 2 * two)))
    d1 = last["d1"] if last else min(0.95, max(0.05, one1 / max(1.0, one1 + 2 * two1)))
    root = 1 / (known + 1)
    hot = s[2].astype(np.int64)
    pull = (STRENGTH + d1 * (last["T1"] if last else tables)) * root
    seated = seat(hot, np.full(len(hot), pull), d1, np.random.default_rng((1 << 40, sweep)))
    c1, t1 = customers + hot.sum(), tables + seated.sum()
    p1 = (hot - d1 * seated + (STRENGTH + d1 * t1) * root) / (STRENGTH + c1)
    return {"d1": d1, "d2": d2, "T1": t1, "C1": c1, "root": root, "P1": p1, "TT": s.get(1), "CT": s.get(0), "N": tokens, "V": known, "hot": s[3]}


# ---- scores ------------------------------------------------------------------------------------------------------


def _scored(g):
    """Shares -> for each batch a row with the tokens' documents and, by pair, probability and count."""

    def run(batches):
        for share, held in _by_share(batches):
            pairs, rng, mean = Pairs(held[PAIRS]), np.random.default_rng((share, 1 << 20)), 0.0
            here, tables = _here(g.value, held), _unsqueeze(held[SEATED])[0].astype(np.int64)
            for _ in range(SAMPLES):
                tables, _, _, p = pairs.reseat(here, rng, tables)
                mean = mean + pairs.predict(here, tables, p) / SAMPLES
            score = np.log10(mean).astype("<f4")
            count = np.where(pairs.rare, pairs.total, g.value["hot"][np.maximum(pairs.hot, 0)]).astype("<i8")[pairs.dish]
            ids, sizes, step, doc = _unsqueeze(held[TOKENS])
            pair, at = np.cumsum(step.astype(np.int64)), 0
            made = []
            for size in sizes.tolist():
                own = pair[at : at + size]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                made.append(_squeeze(score[own[first]], count[own[first]], np.diff(np.append(first, size)).astype("<u4"), doc[at : at + size]))
                at += size
            for low in range(0, len(made), 64):
                part = made[low : low + 64]
                yield pa.RecordBatch.from_arrays([pa.array(ids[low : low + 64], pa.int64()), pa.array([share] * len(part), pa.int32()), pa.array(part, pa.binary())], names=["batch", "share", "payload"])

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _totalled(g):
    """Rows sorted by batch, its directory first -> a row per document."""

    def finish(directory, score, base, known):
        ids, there, held, sizes = directory
        columns = [pa.array([int(i) if k else None for i, k in zip(ids, there)], pa.int64()), held.astype(bool), sizes.astype(np.int64), known.astype(np.int64), np.full(len(ids), int(g.value["N"])), base, score]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT)], schema=_RESULT)

    def run(batches):
        state = None
        top = np.log10(g.value["N"] + g.value["V"] + 1)
        for batch in batches:
            for share, payload in zip(batch.column(1).to_pylist(), batch.column(2)):
                if share < 0:
                    if state:
                        yield finish(*state)
                    directory = _unsqueeze(payload.as_py())
                    state = (directory, *(np.zeros(len(directory[0])) for _ in range(3)))
                    continue
                score, count, sizes, doc = _unsqueeze(payload.as_py())
                n = len(state[1])
                for total, values in zip(state[1:], (score.astype(float), np.log10(count + 1.0) - top, (count > 0).astype(float))):
                    total += np.bincount(doc, np.repeat(values, sizes), minlength=n)
        if state:
            yield finish(*state)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    frequent, tokens = frequent_words(docs, id_col, text_col)
    hot = {w: i for i, w in enumerate(frequent)}
    count = max(parts(spark), tokens // SHARE_TOKENS + 1)  # a share is one cell of a table on its way, so shares are kept small
    size = len(hot) + 1
    packed = source.mapInArrow(_pack(sc.broadcast(hot), count * SPREAD), "share int, batch long, kind byte, payload binary")
    placed = packed.repartition(count, "share").sortWithinPartitions("share", "kind", "batch")
    dealt = min(max(1, count // SPREAD), tokens // CONTEXT_TOKENS + 1, CONTEXT_PARTS)  # partitions of contexts: each answers each share, so there are fewer of them
    shares = table(placed.mapInArrow(_regroup(dealt), "share int, batch long, pairs binary, tokens binary, contexts binary"), "dishes", compression="none")
    whole = shares.where("share is not null")
    part = lambda number, name: whole.select("share", F.lit(number).alias("part"), F.col(name).alias("payload"))
    fixed = part(PAIRS, "pairs").unionByName(part(KEYS, "contexts"))
    arranged = lambda rows: rows.repartition(count, "share").sortWithinPartitions("share", "part")
    path = new_dir(spark, "seating")
    sums, state = _swept(arranged(fixed), None, 0, size, dealt, path)
    g = _restaurants(sums, 0, None)
    for sweep in range(1, SWEEPS + 1):
        old, path = path, new_dir(spark, "seating")
        sums, state = _swept(arranged(fixed.unionByName(state)), sc.broadcast(g), sweep, size, dealt, path)
        g = _restaurants(sums, sweep, g)
        drop(spark, old)
    g = sc.broadcast(g)
    scored = arranged(part(PAIRS, "pairs").unionByName(part(TOKENS, "tokens")).unionByName(state)).mapInArrow(_scored(g), "batch long, share int, payload binary")
    directories = shares.where("share is null").select("batch", F.lit(-1).alias("share"), F.col("tokens").alias("payload"))
    together = scored.unionByName(directories).repartition(count, "batch").sortWithinPartitions("batch", "share")
    return together.mapInArrow(_totalled(g), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
