"""Periodic runs of words, by a suffix automaton with ordered sets of end positions.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends; ``find`` reports those of at least ``min_length``
words and ``min_exponent`` periods and the text without the repeats
(``collapsed``: every word that a run holds after its first period is dropped).

Method. The states of a text's suffix automaton stand for sets of end
positions; going from the longest state to the shortest, each state's set is
merged into that of its suffix link, the smaller into the larger. Two positions
that become neighbours there end two copies of the state's longest string,
``length`` words long. If their distance isn't above that, the copies touch: a square, whose
period is the distance. The copies can't be longer to the left (the state would
be another one), so the square starts at the run's first word, and the one whose
two copies are followed by different words ends at its last: that square is extended to the whole run.
A distance that is a multiple of the smallest period gives the same stretch, of
which the least period is kept.

The automaton is built over the stretches of a text that can hold a run at all:
every word of a run lies in a window of ``(min_length + 5) // 3`` words
(rounded down to a power of two) that the run holds twice. Stretches that hold
no such window twice lose nothing by being left out; texts without repeats never get an
automaton.

How it scales. Row-local: one Arrow pass, no shuffle, batches in slices. A text
of n words takes O(n log n) steps and, where it repeats itself, some 700 bytes a
word; positions are kept in blocks, so that an insertion moves at most
``2 * LOAD`` of them however large the set is.

Edge cases: a null, empty or blank text has no words and no runs; the collapsed
text is the remaining words joined by one space (null for a null text);
very long texts are worked through whole; repeated rows are each judged by
themselves; an empty table gives an empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import private, sliced

MIN_LENGTH, MIN_EXPONENT = 24, 3
#: Positions in a block of an ordered set.
LOAD = 512
OUTPUTS = ("n_words", "runs", "collapsed")
_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_ARROW_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

Run = tuple[int, int, int]


class Ends:
    """An ordered set of end positions, in blocks."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, first: int):
        self.blocks, self.firsts, self.size = [[first]], [first], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Inserts ``x`` and returns its neighbours."""
        blocks = self.blocks
        k = max(0, bisect_right(self.firsts, x) - 1)
        block = blocks[k]
        at = bisect_right(block, x)
        before = block[at - 1] if at else None  # only the first block takes positions before its first
        after = block[at] if at < len(block) else blocks[k + 1][0] if k + 1 < len(blocks) else None
        block.insert(at, x)
        if not at:
            self.firsts[k] = x
        if len(block) > 2 * LOAD:
            blocks[k : k + 1] = [block[:LOAD], block[LOAD:]]
            self.firsts.insert(k + 1, block[LOAD])
        self.size += 1
        return before, after


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length of the longest string, suffix link and own end position (-1: a copied state) of every state."""
    steps: list[dict[int, int]] = [{}]
    length, link, end = [0], [-1], [-1]
    last = 0
    for i, c in enumerate(ids):
        state = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        end.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = state
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[p] + 1 != length[q]:
                copy = len(steps)
                steps.append(steps[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = q = copy
            link[state] = q
        last = state
    return length, link, end


def runs_of(ids: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[Run]:
    """(start, length, smallest period) of every maximal run of ``ids``, by start, then period."""
    length, link, end = automaton(ids)
    ends: list[Ends | None] = [None if e < 0 else Ends(e) for e in end]
    least: dict[tuple[int, int], int] = {}
    n, more = len(ids), min_exponent - 1

    def seed(a: int | None, b: int | None, long: int) -> None:
        if a is None or b is None or (b - a) * more > long:
            return
        period = b - a
        whole = long + period
        if whole >= min_length and (b + 1 == n or ids[a + 1] != ids[b + 1]):
            place = (a - long + 1, whole)
            least[place] = min(period, least.get(place, period))

    for state in np.argsort(-np.array(length), kind="stable").tolist():
        parent = link[state]
        if parent <= 0:
            continue
        mine, theirs = ends[state], ends[parent]
        ends[state] = None
        if theirs is None:
            ends[parent] = mine
            continue
        if mine.size > theirs.size:
            mine, theirs = theirs, mine
        long, previous = length[parent], -1
        for x in mine:
            before, after = theirs.add(x)
            if before != previous:  # neighbours of the set that x comes from met in a longer state
                seed(before, x, long)
            seed(x, after, long)
            previous = x
        ends[parent] = theirs
    return sorted((start, whole, period) for (start, whole), period in least.items())


def _same_windows(ids: np.ndarray, window: int) -> np.ndarray:
    """For each window of ``window`` (a power of two) ids, a number that equal windows share."""
    rank, step = ids, 1
    while step < window:
        rank = np.unique(rank[:-step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1]
        step *= 2
    return rank


def stretches(ids: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int]]:
    """Disjoint ranges outside of which no run has a word: each of its windows is in it twice."""
    window = 1 << (((min_length + 5) // 3).bit_length() - 1) if min_exponent >= 3 else 1
    if len(ids) < max(min_length, window):
        return []
    rank = _same_windows(ids, window)
    first = np.arange(len(rank))
    part = np.zeros(len(ids), np.int64)  # the stretch of each word, -1: none
    held = len(ids)
    while held:
        ok = (part[first] >= 0) & (part[first] == part[first + window - 1])
        key = part[first[ok]] * (len(rank) + 1) + rank[ok]
        _, where, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = first[ok][count[where] > 1]
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + window, -1)
        covered = np.cumsum(edge)[:-1] > 0
        new = np.ones(len(ids), bool)
        new[1:] = (covered[1:] != covered[:-1]) | (part[1:] != part[:-1])
        number = np.cumsum(new) - 1
        keep = covered & (np.bincount(number)[number] >= min_length)
        part = np.where(keep, number, -1)
        now = int(keep.sum())
        if now == 0 or now > 0.9 * held:
            break
        held = now
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    return [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:]) if part[a] >= 0]


def _numbered(words: list[bytes]) -> np.ndarray:
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))


def runs_of_words(words: list[bytes], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[Run]:
    """The runs of a text, by start, then period."""
    if len(words) < min_length:
        return []
    ids, found = _numbered(words), []
    for low, high in stretches(ids, min_length, min_exponent):
        found += [(low + start, whole, period) for start, whole, period in runs_of(ids[low:high].tolist(), min_length, min_exponent)]
    return found


def collapsed_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, whole, period in runs:
        edge[start + period] += 1
        edge[start + whole] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


def find(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """The columns ``keep`` (all by default) with n_words, ``runs`` (start, length, period in words) and ``collapsed``."""
    names = [c for c in (keep if keep is not None else df.columns) if c not in OUTPUTS]
    source = df.select(*names, *([] if text_col in names else [text_col]))
    place = source.columns.index(text_col)
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])

    def run(batches):
        for batch in sliced(batches):
            counts, runs, texts = [], [], []
            for text in batch.column(place).cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                found = runs_of_words(words, min_length, min_exponent)
                counts.append(len(words))
                runs.append([{"start": a, "length": b, "period": c} for a, b, c in found])
                texts.append(None if text is None else b" ".join(collapsed_words(words, found)))
            made = [pa.array(counts, pa.int64()), pa.array(runs, _ARROW_RUNS), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *made], names=schema.names)

    return source.mapInArrow(run, schema)


def clean(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``df`` with the texts collapsed where they have runs, other texts and columns as they were."""
    hidden, names = private(df)
    found = find(hidden, names[text_col], **options)
    return found.select(*(F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col(n)).alias(c) if c == text_col else F.col(n).alias(c) for c, n in names.items()))


def planted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` in which a tenth of the texts, chosen by the id's crc32, repeats a stretch from some word to the end."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n, g = F.size("__words"), F.floor(h / 10)
    hidden = df.withColumn("__words", words).withColumn("__a", F.when(n > 0, g % n).cast("int"))
    period = (F.lit(1) + F.floor((n - F.col("__a")) / (3 + g % 8))).cast("int")
    unit = F.slice("__words", F.col("__a") + 1, F.col("__p"))
    times = F.ceil((n - F.col("__a")) / F.col("__p")).cast("int")
    made = F.slice(F.concat(F.slice("__words", F.lit(1), F.col("__a")), F.flatten(F.array_repeat(unit, times))), F.lit(1), n)
    return hidden.withColumn("__p", period).withColumn(text_col, F.coalesce(F.array_join(F.when(F.col("__p") > 0, made), " "), F.col(text_col))).drop("__words", "__a", "__p")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The report: one row per document, with the run of the greatest exponent and digests of all runs and of the collapsed text."""

    def better(a, b):
        # runs are in order of start and period, so an equal exponent leaves the first in place
        mine, theirs = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(mine >= theirs, a).otherwise(b)

    top = F.reduce(F.slice("runs", 2, 1 << 30), F.get("runs", F.lit(0)), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    return found.withColumn("__top", top).select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"__top.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * __top.length) div __top.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.coalesce(F.col("collapsed"), F.lit("")).cast("binary"), 256).alias("collapsed_sha256"),
    )
