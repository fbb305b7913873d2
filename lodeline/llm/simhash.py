"""SimHash near-duplicates with a Gray-order hierarchical index.

A text is lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; each run of
four words, joined by spaces, is hashed by XXH64 (seed 42). A bit of the 64-bit
fingerprint is 1 if it is set in over half the hashes. Fingerprints that differ
in at most four bits are linked; a component is named by its smallest doc_id.

How it scales. Equal fingerprints are one node (a partial aggregation, so
thousands of exact copies cost one row a task). Six blocks of bits, any two of
which are left untouched by four differences, deal the distinct fingerprints to
15 families of groups: fifteen small rows a fingerprint, linear in the input,
and a group holds what agrees in 21 bits or more. Groups of over ``GROUP`` fingerprints are
dealt again by blocks of the bits they don't share yet, until no task holds more. Within a group, fingerprints
lie in Gray order, and ``Index`` factors the bits that neighbours share into
upper nodes; a search adds up differences on the way down and prunes a whole
subtree once they exceed four, or takes it whole once they can't. Subtrees already
in the searcher's component are skipped, so a large group of near copies costs no
all-pairs comparison, and each group yields a spanning forest - fewer links
than members. Components are found without the driver (``graph``).

Edge cases: a null or empty text has fingerprint zero and is linked like any
other; texts of one to three words have a single shingle; rows without a doc_id
get a fingerprint, link nothing and have no component; repeated rows fall
together; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .storage import drop, new_dir, parts, sliced, table

SEED, SHINGLE, DIFFERENCES = 42, 4, 4
#: Blocks of bits; four differences leave at least two of the six untouched.
BLOCKS = 6
#: Children of a node, codes that search a large group at a time, and rows whose groups share an index.
FAN, QUERIES, ROWS = 16, 256, 4096
#: Distinct fingerprints of one group that a task may hold.
GROUP = 1 << 20
#: Words hashed together; bounds the memory that one long text takes.
CHUNK_WORDS = 1 << 17
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE = np.arange(8, dtype=np.int64) * 256


def hashes(data: bytes) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    found, digest = [], xxhash.xxh64_intdigest
    for base in range(0, len(words) - SHINGLE + 1, CHUNK_WORDS):
        part = words[base : base + CHUNK_WORDS + SHINGLE - 1]
        text = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[: len(part) - SHINGLE] + 1)).tolist()
        found.append(np.array([digest(text[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64))
    return np.concatenate(found)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint, unsigned."""
    h = hashes((text or "").encode())
    if not len(h):
        return 0
    by_byte = np.bincount((h.astype("<u8").view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048).reshape(8, 256)
    ones = 2 * (by_byte @ _BITS) > len(h)
    return int(np.packbits(ones.ravel(), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with fp, the fingerprint as a signed long."""
    names = [c for c in (keep if keep is not None else df.columns) if c != "fp"]
    source = df.select(*names, *([] if text_col in names else [text_col]))
    place = source.columns.index(text_col)

    def run(batches):
        for batch in sliced(batches):
            made = np.array([fingerprint(t) for t in batch.column(place).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(made, pa.int64())], names=[*names, "fp"])

    return source.mapInArrow(run, T.StructType([*(df.schema[c] for c in names), T.StructField("fp", T.LongType())]))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def families(mask: int = 0) -> list[int]:
    """``mask`` (a signed 64-bit number) with each two of the six blocks of its free bits: 15 masks."""
    free = [i for i in range(64) if not mask >> i & 1]
    blocks = [sum(1 << int(i) for i in part) for part in np.array_split(free, BLOCKS)]
    return [_signed((mask | a | b) & (1 << 64) - 1) for a, b in combinations(blocks, 2)]


def gray_rank(code: Column) -> Column:
    """Position of a code in Gray order, shifted so that signed comparison follows it."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def roots(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """The smallest node reachable from each of n nodes over links a-b (and what ``parent`` already joins)."""
    parent = np.arange(n) if parent is None else parent
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


class Index:
    """Codes of one or more groups, each in Gray order; a tree a group.

    An upper node holds the bits that all codes below it share. ``levels[0]`` is the
    codes themselves, the last level has a root a group. A node keeps only the shared bits that
    its parent doesn't already have, so differences add up on the way down.
    """

    def __init__(self, codes: np.ndarray, groups: np.ndarray | None = None):
        """``groups``: where each group begins."""
        self.codes, self.levels, n = codes, [], len(codes)
        offset = np.zeros(1, np.int64) if groups is None else groups
        size = np.diff(np.append(offset, n))
        self.group = np.repeat(np.arange(len(offset)), size)
        start, mask, pattern, low, high = np.arange(n), np.full(n, ~np.uint64(0)), codes, codes, codes
        self.levels.append({"start": start, "mask": mask, "pattern": pattern, "first": None})
        while size.max() > 1:
            fewer = -(-size // FAN)
            above = np.cumsum(fewer) - fewer
            first = np.repeat(offset, fewer) + FAN * (np.arange(fewer.sum()) - np.repeat(above, fewer))
            low, high, start = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first), start[first]
            mask = ~(low ^ high)
            below = self.levels[-1]
            below["own"] = below["mask"] & ~np.repeat(mask, np.diff(np.append(first, len(below["mask"]))))
            self.levels.append({"start": start, "mask": mask, "pattern": low & mask, "first": first})
            offset, size = above, fewer
        self.levels[-1]["own"] = self.levels[-1]["mask"]
        for level in self.levels:
            level["end"] = np.append(level["start"][1:], n)
            level["free"] = 64 - np.bitwise_count(level["mask"]).astype(np.int64)
        self.most = int(np.bincount(self.group).max())

    def joined(self, most: int = DIFFERENCES) -> np.ndarray:
        """For each code the first code of its component under links of at most ``most`` differing bits within its group."""
        n, parent = len(self.codes), np.arange(len(self.codes))
        step = QUERIES if self.most > QUERIES else n
        for begin in range(0, n, step):
            query = np.arange(begin, min(begin + step, n))
            node, added = self.group[query], np.zeros(len(query), np.int64)
            a, b = [], []
            for depth in range(len(self.levels) - 1, -1, -1):
                level = self.levels[depth]
                added = added + np.bitwise_count((self.codes[query] ^ level["pattern"][node]) & level["own"][node])
                # What lies before the query has searched for it already.
                alive = (added <= most) & (level["end"][node] > query + 1)
                low, high = np.minimum.reduceat(parent, level["start"]), np.maximum.reduceat(parent, level["start"])
                alive &= ~((low[node] == high[node]) & (low[node] == parent[query]))
                query, node, added = query[alive], node[alive], added[alive]
                whole = added + level["free"][node] <= most
                if whole.any():
                    a.append(query[whole])
                    b.append(level["start"][node[whole]])
                    for k in np.unique(node[whole]) if depth else ():
                        inner = np.arange(level["start"][k] + 1, level["end"][k])
                        a.append(inner)
                        b.append(np.full(len(inner), level["start"][k]))
                    query, node, added = query[~whole], node[~whole], added[~whole]
                if depth:
                    last = np.append(level["first"][1:], len(self.levels[depth - 1]["start"]))
                    child = (level["first"][node][:, None] + np.arange(FAN)).ravel()
                    there = child < np.repeat(last[node], FAN)
                    query, added = np.repeat(query, FAN)[there], np.repeat(added, FAN)[there]
                    node = child[there]
            if a:
                parent = roots(n, np.concatenate(a), np.concatenate(b), parent)
        return parent


def _links(family: np.ndarray, key: np.ndarray, code: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of each whole group in rows sorted by (family, key, Gray rank)."""
    first = np.flatnonzero(np.append(True, (family[1:] != family[:-1]) | (key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(code)))
    shared = np.repeat(size > 1, size)  # what is alone in its group has no partner there
    code, node, size = code[shared], node[shared], size[size > 1]
    if not len(code):
        return node, node
    first = np.cumsum(size) - size
    cuts = np.flatnonzero(np.append(True, first[1:] // ROWS != first[:-1] // ROWS))
    a, b = [], []
    for low, high in zip(cuts, np.append(cuts[1:], len(first))):
        start, end = first[low], first[high - 1] + size[high - 1]
        parent = Index(code[start:end], first[low:high] - start).joined()
        inner = np.flatnonzero(parent != np.arange(end - start))
        a.append(node[start + inner])
        b.append(node[start + parent[inner]])
    return np.concatenate(a), np.concatenate(b)


def _search(batches):
    """Streams sorted rows; a group may span batches and is held until it ends."""
    held: list[tuple[np.ndarray, ...]] = []
    out = lambda links: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], names=["a", "b"])
    for batch in batches:
        rows = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(rows[0]):
            continue
        last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = last[-1] + 1 if len(last) else 0
        same = held and held[-1][0][-1] == rows[0][0] and held[-1][1][-1] == rows[1][0]
        if cut or not same:
            whole = [np.concatenate(x) for x in zip(*held, tuple(c[:cut] for c in rows))]
            if len(whole[0]):
                yield out(_links(whole[0], whole[1], whole[2].view(np.uint64), whole[3]))
            held = []
        held.append(tuple(c[cut:] for c in rows))
    if held:
        whole = [np.concatenate(x) for x in zip(*held)]
        yield out(_links(whole[0], whole[1], whole[2].view(np.uint64), whole[3]))


def _dealt(rows: DataFrame, below: Column) -> DataFrame:
    """(family, key, fp, node): ``rows`` once for each mask of the array ``below``."""
    each = rows.select(F.explode(below).alias("family"), "fp", "node")
    return each.select("family", F.col("fp").bitwiseAND(F.col("family")).alias("key"), "fp", "node")


def _hot(rows: DataFrame) -> DataFrame:
    """The groups that are too large for a task, with masks that deal them by the bits in which they vary."""
    sizes = rows.groupBy("family", "key").agg(F.count(F.lit(1)).alias("n"), F.bit_and("fp").alias("low"), F.bit_or("fp").alias("high")).where(F.col("n") > GROUP)

    def run(frames):
        for frame in frames:
            varying = (frame["low"] ^ frame["high"]).tolist()
            yield frame[["family", "key"]].assign(below=[families(_signed(~v & (1 << 64) - 1)) for v in varying])

    return table(sizes.mapInPandas(run, "family long, key long, below array<long>"), "hot")


def links(distinct: DataFrame) -> DataFrame:
    """``distinct`` (fp, node) -> links (a, b) between nodes, a spanning forest of each group."""
    rows, done = _dealt(distinct, F.array(*map(F.lit, families()))), []
    if distinct.count() > GROUP:  # no group can have more than there are
        # Each round fixes a third of the bits in which a hot group varies, so few rounds are needed.
        while not (hot := _hot(rows)).isEmpty():
            done.append(rows.join(hot, ["family", "key"], "left_anti"))
            rows = _dealt(rows.join(hot, ["family", "key"]), F.col("below"))
    rows = reduce(DataFrame.unionByName, [*done, rows])
    placed = rows.repartition(parts(distinct.sparkSession), "family", "key").sortWithinPartitions("family", "key", gray_rank(F.col("fp")))
    return placed.mapInArrow(_search, "a long, b long")


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    paths = [new_dir(spark, "simhash") for _ in range(3)]
    printed = table(fingerprints(docs.select(id_col, text_col), text_col, [id_col]), "", paths[0])
    distinct = table(printed.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(F.col(id_col).cast("long")).alias("node")), "", paths[1])
    found = components(links(distinct))
    named = distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    result = printed.join(table(named, "", paths[2]), "fp", "left")
    return result.select(id_col, "fp", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less all but the smallest doc_id of each component; rows without an id stay."""
    extra = cluster(docs, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(table(extra, "extra"), id_col, "left_anti").select(*docs.columns)
