"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line with a word is good or bad. A line is described by ``STATS`` in
buckets, its own and those of the lines before and after; the chain adds a weight for each
pair of neighbouring labels. A text's score is the mean of its lines' marginal
probabilities of being good (forward-backward), weighted by their lengths.

Training. Labels are those of documents, so lines start with their document's.
A first fit, without the chain and the neighbours, tells which lines of bad documents look
good by themselves (a copied notice, a clean first paragraph); these are relabelled, all but the worst
of a document, and the chain is fitted to the result: penalised likelihood, full gradients
from forward-backward, Adam steps.

How it scales. Learning takes about ``SAMPLE`` documents of each label, chosen by a
hash of their id among all labelled ones, whose ids (some ``2 * SAMPLE``) are broadcast (documents of more than ``MOST_LINES``
lines are left out of learning only); their bucket numbers, not texts, go to the
driver. Scoring is one Arrow pass without shuffle over whole texts; the model is
a few hundred numbers.

Edge cases: a text without a word (null, empty, blank) is scored as one empty
line; very long texts and lines are read whole; labels without an id or a value
are passed over, an id labelled both ways counts as bad; with no labels the
score is 0.5; repeated rows are scored each by itself, equal texts equally; an empty table
gives an empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import private, sliced

SAMPLE, MOST_LINES = 6000, 2000
#: Bounds between the buckets of each statistic of a line.
STATS: dict[str, tuple[float, ...]] = {
    "words": (0.5, 1.5, 3.5, 7.5, 15.5, 31.5, 63.5, 127.5),
    "word_bytes": (2, 3, 4, 5, 6, 7, 8, 10, 15, 30),
    "symbols_a_word": (1e-9, 0.02, 0.1, 0.3, 0.6, 1.0, 2.0),
    "capitals": (1e-9, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 0.9),
    "digits": (1e-9, 0.01, 0.03, 0.1, 0.3),
    "marks_a_word": (1e-9, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8, 1.5),
    "stops_a_word": (1e-9, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8),
    "echoes": (1e-9, 0.01, 0.05, 0.1, 0.2, 0.4, 0.8),
    "distinct": (0.1, 0.2, 0.3, 0.45, 0.6, 0.75, 0.9, 0.999),
    "seen_before": (1e-9, 0.02, 0.1, 0.3, 0.6, 0.9),
    "repeats_a_line": (0.5,),
    "ends_a_sentence": (0.5,),
}
_BOUNDS = [np.array(b) for b in STATS.values()]
_SIZES = [len(b) + 1 for b in _BOUNDS]
#: Where each statistic's buckets begin; a line has them for itself, the line before and the line after.
_STARTS = np.concatenate(([0], np.cumsum(_SIZES)[:-1]))
OWN = sum(_SIZES)
#: Further features: no line before, none after, and a constant.
FIRST, LAST, ALWAYS = 3 * OWN, 3 * OWN + 1, 3 * OWN + 2
N_FEATURES = 3 * OWN + 3
_SYMBOLS, _DIGITS, _MARKS, _STOPS = b"#*$%&|<>{}[]=\\_~^@+", b"0123456789", b"!?", b".,;:"
_CAPITALS, _LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_ENDS = (b".", b"!", b"?", b":", b'"')
OUTPUTS = ("lines", "score")
_LINES = T.ArrayType(T.StructType([T.StructField("chars", T.LongType()), T.StructField("good", T.DoubleType())]))


def measures(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``STATS`` of every line with a word, and the lines' lengths in code points."""
    lines = [(line, words) for line in (text or b"").split(b"\n") if (words := line.split())]
    values, chars = np.zeros((max(1, len(lines)), len(STATS))), np.ones(max(1, len(lines)), np.int64)
    seen_lines: set[bytes] = set()
    seen: set[tuple] = set()
    for at, (line, words) in enumerate(lines):
        n, count = len(words), lambda letters: len(line) - len(line.translate(None, letters))  # noqa: B023
        body = sum(map(len, words))
        capitals, digits = count(_CAPITALS), count(_DIGITS)
        windows = list(zip(words, words[1:], words[2:], words[3:]))
        before = len(seen)
        seen.update(windows)
        values[at] = (
            n,
            body / n,
            count(_SYMBOLS) / n,
            capitals / max(1, capitals + count(_LETTERS)),
            digits / body,
            count(_MARKS) / n,
            count(_STOPS) / n,
            sum(map(bytes.__eq__, words, words[1:])) / n,
            len(set(words)) / n if n <= 64 else len(set(words[:64])) / 64,
            1 - (len(seen) - before) / len(windows) if windows else 0,
            line in seen_lines,
            line.rstrip().endswith(_ENDS),
        )
        seen_lines.add(line)
        chars[at] = len(line.decode("utf-8", "replace"))
    return values, chars


def features(values: np.ndarray) -> np.ndarray:
    """Numbers of the active features, one row a line: own buckets, those before and after, and the edges."""
    own = np.stack([start + np.searchsorted(bounds, values[:, i], side="right") for i, (start, bounds) in enumerate(zip(_STARTS, _BOUNDS))], axis=1)
    before, after = np.roll(own, 1, axis=0) + OWN, np.roll(own, -1, axis=0) + 2 * OWN
    before[0], after[-1] = FIRST, LAST
    return np.concatenate((own, before, after, np.full((len(own), 1), ALWAYS)), axis=1)


def _own(rows: np.ndarray) -> np.ndarray:
    """Features of the lines without those of their neighbours."""
    return np.concatenate((rows[:, : len(STATS)], rows[:, -1:]), axis=1)


@dataclass
class Model:
    """``weights`` of the features (log odds of good), and of the pairs of neighbouring labels (0 bad, 1 good)."""

    weights: np.ndarray
    pairs: np.ndarray

    def marginals(self, rows: np.ndarray) -> np.ndarray:
        """Each line's probability of being good."""
        odds = self._odds(rows).tolist()
        (bb, bg), (gb, gg) = np.exp(self.pairs - self.pairs.max()).tolist()
        ahead, behind, bad, good = [], [1.0] * len(odds), 0.5, 0.5
        for i, (b, g) in enumerate(odds):
            if i:
                bad, good = bad * bb + good * gb, bad * bg + good * gg
            bad, good = bad * b, good * g
            bad, good = bad / (bad + good), good / (bad + good)
            ahead.append((bad, good))
        bad = good = 1.0
        for i in range(len(odds) - 1, -1, -1):
            behind[i] = ahead[i][1] * good / (ahead[i][0] * bad + ahead[i][1] * good)
            bad, good = bad * odds[i][0], good * odds[i][1]
            bad, good = bb * bad + bg * good, gb * bad + gg * good
            bad, good = bad / (bad + good), good / (bad + good)
        return np.array(behind)

    def _odds(self, rows: np.ndarray) -> np.ndarray:
        good = 1 / (1 + np.exp(-np.clip(self.weights[rows].sum(1), -30, 30)))
        return np.stack((1 - good, good), axis=1)

    def score(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, float]:
        """Lengths of the lines, their marginals, and the text's score."""
        values, chars = measures(text)
        good = self.marginals(features(values))
        return chars, good, min(1.0, max(0.0, float(good @ chars) / float(chars.sum())))


class _Chains:
    """Sampled documents side by side, the longest first: line ``t`` of all documents that have one is a range of rows."""

    def __init__(self, documents: list[np.ndarray]):
        self.order = sorted(range(len(documents)), key=lambda d: -len(documents[d]))
        sizes = np.array([len(documents[d]) for d in self.order])
        self.alive = [int((sizes > t).sum()) for t in range(sizes[0])]
        self.edges = np.concatenate(([0], np.cumsum(self.alive)))
        self.rows = np.concatenate([[documents[d][t] for d in self.order[:n]] for t, n in enumerate(self.alive)])

    def lay(self, values: list[np.ndarray]) -> np.ndarray:
        """Values a line of each document, in the order of ``rows``."""
        return np.concatenate([[values[d][t] for d in self.order[:n]] for t, n in enumerate(self.alive)])

    def expected(self, odds: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of good by line, and the expected numbers of label pairs."""
        step = np.exp(pairs - pairs.max())
        ahead, behind = np.empty_like(odds), np.ones_like(odds)
        for t, n in enumerate(self.alive):
            here = slice(self.edges[t], self.edges[t] + n)
            came = ahead[self.edges[t - 1] : self.edges[t - 1] + n] @ step if t else 1.0
            ahead[here] = came * odds[here]
            ahead[here] /= ahead[here].sum(1, keepdims=True)
        counts = np.zeros((2, 2))
        for t in range(len(self.alive) - 2, -1, -1):
            n = self.alive[t + 1]
            here, there = slice(self.edges[t], self.edges[t] + n), slice(self.edges[t + 1], self.edges[t + 1] + n)
            onward = odds[there] * behind[there]
            both = ahead[here][:, :, None] * step * onward[:, None, :]
            counts += (both / both.sum((1, 2), keepdims=True)).sum(0)
            behind[here] = onward @ step.T
            behind[here] /= behind[here].sum(1, keepdims=True)
        marginal = ahead * behind
        return marginal[:, 1] / marginal.sum(1), counts


def _fit(chains: _Chains, good: np.ndarray, cost: np.ndarray, chained: bool, steps: int, penalty: float) -> Model:
    """Adam on the penalised likelihood; ``cost`` weighs lines, so that both labels count alike."""
    model, n = Model(np.zeros(N_FEATURES), np.zeros((2, 2))), len(good)
    seen = np.zeros((2, 2))
    for t in range(len(chains.alive) - 1):
        m = chains.alive[t + 1]
        np.add.at(seen, (good[chains.edges[t] : chains.edges[t] + m].astype(int), good[chains.edges[t + 1] : chains.edges[t + 1] + m].astype(int)), 1)
    moments = [np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)]
    rows = chains.rows if chained else _own(chains.rows)
    for step in range(1, steps + 1):
        odds = model._odds(rows)
        marginal, counts = chains.expected(odds, model.pairs) if chained else (odds[:, 1], seen)
        missing = np.bincount(rows.ravel(), np.repeat((good - marginal) * cost, rows.shape[1]), N_FEATURES) / n - penalty * model.weights
        gradient = np.concatenate((missing, ((seen - counts) / n - penalty * model.pairs).ravel() * chained))
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        model.weights += move[:N_FEATURES]
        model.pairs += move[N_FEATURES:].reshape(2, 2)
    return model


def learn(documents: list[np.ndarray], good: list[int], steps: int = 120, penalty: float = 1e-4) -> Model:
    """A model from the features of documents and their labels."""
    if not documents:
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)))
    chains = _Chains(documents)
    labels = [np.full(len(d), float(g)) for d, g in zip(documents, good)]

    def balanced() -> tuple[np.ndarray, np.ndarray]:
        laid = chains.lay(labels)
        share = np.clip(laid.mean(), 1e-3, 1 - 1e-3)
        return laid, np.where(laid > 0, 0.5 / share, 0.5 / (1 - share))

    alone = _fit(chains, *balanced(), chained=False, steps=steps, penalty=penalty)
    for rows, label in zip(documents, labels):
        if not label[0]:
            own = alone._odds(_own(rows))[:, 1]
            label[:] = own >= 0.5
            label[own.argmin()] = 0
    return _fit(chains, *balanced(), chained=True, steps=steps, penalty=penalty)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model learned from about ``sample`` documents of each label (0 bad, 1 good)."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("good")).where("id is not null and good is not null").groupBy("id").agg(F.min("good").alias("good"))
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    totals = {r.good: r["count"] for r in marked.groupBy("good").count().collect()}
    if not totals:
        return learn([], [])
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    chosen = F.lit(False)
    for label, total in totals.items():
        chosen |= (F.col("good") == label) & (place < sample / total)

    def run(batches):
        for batch in sliced(batches):
            ids, good, rows = [], [], []
            for doc_id, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                values, _ = measures(text)
                if len(values) <= MOST_LINES:
                    ids.append(doc_id)
                    good.append(label)
                    rows.append(features(values).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(good, pa.int32()), pa.array(rows, pa.binary())], names=["id", "good", "rows"])

    found = held.join(F.broadcast(marked.where(chosen)), "id").select(F.col("id").cast("long"), "good", "text").mapInArrow(run, "id long, good int, rows binary").collect()
    found.sort(key=lambda r: (r.id, bytes(r.rows)))
    width = 3 * len(STATS) + 1
    return learn([np.frombuffer(r.rows, "<u2").astype(np.int64).reshape(-1, width) for r in found], [int(r.good > 0) for r in found])


def score(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with ``lines`` (length, probability of being good) and ``score``."""
    names = [c for c in (keep if keep is not None else df.columns) if c not in OUTPUTS]
    source = df.select(*names, *([] if text_col in names else [text_col]))
    place = source.columns.index(text_col)
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField("lines", _LINES), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in sliced(batches):
            edges, chars, good, scores = [0], [], [], []
            for text in batch.column(place).cast(pa.binary()).to_pylist():
                lengths, marginals, value = model.score(text)
                chars.append(lengths)
                good.append(marginals)
                scores.append(value)
                edges.append(edges[-1] + len(lengths))
            lines = pa.StructArray.from_arrays([pa.array(np.concatenate(chars)), pa.array(np.concatenate(good))], ["chars", "good"])
            made = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), lines), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *made], names=schema.names)

    return source.mapInArrow(run, schema)


def clean(df: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """``df`` without the documents that score below ``least``, with its own columns."""
    hidden, names = private(df)
    return score(hidden, model, names[text_col]).where(F.col("score") >= least).select(*names.values()).toDF(*names)
