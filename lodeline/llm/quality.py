"""Quality rules: base statistics and robust multivariate outliers.

``statistics`` measures every whole text (one Arrow pass). ``fit`` estimates, for
each (lang, source), location and scatter of the transformed statistics by the
minimum covariance determinant (``estimates`` adds those of groups too small for
one of their own): concentration steps keep the ``SUPPORT`` share
of rows that lie closest under the current estimate and re-estimate from them,
from two deterministic starts (quartiles per statistic; all rows), and the
smaller determinant wins. ``judge`` rejects rows by squared Mahalanobis distance.

How it scales. The rows stay where they are: a concentration step counts rows
in bins of log distance, finds each group's threshold bin from those counts, and
sums moments up to it. Both aggregations combine before the shuffle, so a hot
source sends a few hundred counts per task. Transformed statistics are whole
numbers (thousandths), so sums don't depend on the order of rows. Estimates are
broadcast only up to ``BROADCAST_GROUPS`` groups; beyond, they are joined by
shuffle, where adaptive execution splits a hot group.

Fixed choices: scatter gets a floor per statistic (most texts have no repeated
line at all, which would make it singular); rows that the base rules reject don't
enter an estimate; a group of fewer than ``MIN_ROWS`` other rows takes the estimate
made from all rows of its language, or, if these are fewer than ``MIN_ROWS`` too,
from all rows there are, so that every row is judged by a distance.

Edge cases: a null or empty text has zero words and fails the base rules; null
lang or source form a group of their own; repeated rows count as often as they
occur; an empty table gives an empty result; very long texts are measured whole; input columns named like an output
column of ``statistics`` or ``judge`` are replaced there; ``clean`` returns every column as it was.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import drop, new_dir, private, sliced, table

STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 8
#: Share of a group's rows that the estimate is made from, and the concentration steps.
SUPPORT, STEPS, MIN_ROWS = 0.75, 6, 60
#: Least standard deviation of each transformed statistic, in thousandths.
FLOORS = (300, 200, 80, 150, 150)
DIMS = len(FLOORS)
#: A clean row of a normal group is rejected once in so many.
ONE_IN = 1e9
BROADCAST_GROUPS = 20_000
GROUP = ("lang", "source")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` (a power of two) words that occur twice or more."""
    if len(words) <= window:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    step = 1
    while step < window:  # ranks of windows twice as long, from pairs of ranks
        rank = np.unique(rank[:-step] * (rank.max() + 1) + rank[step:], return_inverse=True)[1]
        step *= 2
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(twice)] += twice
    edge[window : window + len(twice)] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The values of ``STATS`` for one text."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - (len(data) - len(data.translate(None, BLANKS))),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def statistics(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with ``STATS`` and ``base_failed``."""
    names = [c for c in (keep if keep is not None else df.columns) if c not in STATS]
    source = df.select(*names, *([] if text_col in names else [text_col]))
    place = source.columns.index(text_col)
    schema = T.StructType([*(df.schema[c] for c in names), *(T.StructField(c, T.LongType()) for c in STATS)])

    def run(batches):
        for batch in sliced(batches):
            rows = [measure(text) for text in batch.column(place).to_pylist()]
            made = [pa.array([row[i] for row in rows], pa.int64()) for i in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *made], names=schema.names)

    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return source.mapInArrow(run, schema).withColumn("base_failed", failed)


def vector() -> list[Column]:
    """The transformed statistics in thousandths, of rows with at least one word."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    values = [
        F.log1p("n_words"),
        F.col("word_chars") / F.greatest("n_words", F.lit(1)),
        share("n_symbols", "n_words"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
    ]
    return [F.round(v * 1000).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


def chi_square_below(x: float, dims: int) -> float:
    """P(chi-square with ``dims`` degrees of freedom <= x), by the series of the incomplete gamma function."""
    a, x = dims / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-17:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a))) if x > 0 else 0.0


def chi_square_quantile(p: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_below(middle, dims) < p else (low, middle)
    return high


#: Makes the scatter of the closest SUPPORT share that of the whole, for normal rows.
CONSISTENCY = SUPPORT / chi_square_below(chi_square_quantile(SUPPORT, DIMS), DIMS + 2)
CUTOFF = chi_square_quantile(1 - 1 / ONE_IN, DIMS)


def distance() -> Column:
    """Squared Mahalanobis distance from columns x*, mean and precision."""
    d = [F.col(f"x{i}") - F.col("mean")[i] for i in range(DIMS)]
    terms = [d[i] * d[j] * F.col("precision")[i * DIMS + j] * (1 if i == j else 2) for i in range(DIMS) for j in range(i, DIMS)]
    return reduce(lambda a, b: a + b, terms)


def _bin() -> Column:
    return F.floor(F.log(F.greatest(distance(), F.lit(1e-6))) * 32).cast("int")


def _estimate(moments: DataFrame) -> DataFrame:
    """Mean, precision and log determinant from the moments of each group; a row per group, no shuffle."""
    schema = T.StructType([*(moments.schema[c] for c in (*GROUP, "start", "rows")), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("mean", "precision")), T.StructField("log_det", T.DoubleType())])

    def run(frames):
        for frame in frames:
            out = frame[[*GROUP, "start", "rows"]].copy()
            means, precisions, dets = [], [], []
            for row in frame.itertuples(index=False):
                n = max(row.kept, 1)
                mean = np.array([getattr(row, f"s{i}") for i in range(DIMS)], float) / n
                scatter = np.zeros((DIMS, DIMS))
                for i in range(DIMS):
                    for j in range(i, DIMS):
                        scatter[i, j] = scatter[j, i] = getattr(row, f"s{i}_{j}") / n - mean[i] * mean[j]
                scatter = scatter * row.scale + np.diag(np.square(FLOORS))
                means.append(mean.tolist())
                precisions.append(np.linalg.inv(scatter).ravel().tolist())
                dets.append(float(np.linalg.slogdet(scatter)[1]))
            yield out.assign(mean=means, precision=precisions, log_det=dets)

    return moments.mapInPandas(run, schema)


def _with(rows: DataFrame, groups: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their group; null keys match."""
    right = groups.withColumnsRenamed({c: f"_{c}" for c in GROUP})
    on = reduce(lambda a, b: a & b, (rows[c].eqNullSafe(right[f"_{c}"]) for c in GROUP))
    return rows.join(F.broadcast(right) if few else right, on, how).drop(*(f"_{c}" for c in GROUP))


def _moments() -> list[Column]:
    x = [F.col(f"x{i}") for i in range(DIMS)]
    return [F.count(F.lit(1)).alias("kept"), *(F.sum(x[i]).alias(f"s{i}") for i in range(DIMS)), *(F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(DIMS) for j in range(i, DIMS))]


def fit(stats: DataFrame, least: int = MIN_ROWS) -> DataFrame:
    """Per group of ``least`` rows or more: lang, source, rows, mean, precision, log_det. ``stats`` has GROUP, STATS and base_failed."""
    spark = stats.sparkSession
    rows = stats.where(~F.col("base_failed")).select(*GROUP, *vector())
    sizes = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("rows"), *_moments()).where(F.col("rows") >= least)
    paths = [new_dir(spark, "mcd")]
    sizes = table(sizes, "", paths[-1])
    few = sizes.count() <= BROADCAST_GROUPS

    # Start 0: median and quartile range of each statistic, by exact counts of its values in steps of 0.02.
    values = rows.select(*GROUP, F.posexplode(F.array(*(F.floor(F.col(f"x{i}") / 20) for i in range(DIMS)))).alias("dim", "step"))
    by_dim = Window.partitionBy(*GROUP, "dim")
    run_up = F.sum("n").over(by_dim.orderBy("step")) / F.sum("n").over(by_dim)
    counted = values.groupBy(*GROUP, "dim", "step").agg(F.count(F.lit(1)).alias("n")).withColumn("share", run_up)
    at = lambda q: F.min(F.when(F.col("share") >= q, F.col("step") * 20 + 10))
    quartiles = counted.groupBy(*GROUP, "dim").agg(at(0.5).alias("q2"), ((at(0.75) - at(0.25)) / 1.349).alias("sd"))
    wide = quartiles.groupBy(*GROUP).agg(*(F.max(F.when(F.col("dim") == i, F.col(c))).alias(f"{c}{i}") for i in range(DIMS) for c in ("q2", "sd")))
    spread = lambda i: 1 / (F.col(f"sd{i}") * F.col(f"sd{i}") + FLOORS[i] ** 2)
    first = _with(wide, sizes.select(*GROUP, "rows"), few).select(
        *GROUP,
        F.lit(0).alias("start"),
        "rows",
        F.array(*(F.col(f"q2{i}").cast("double") for i in range(DIMS))).alias("mean"),
        F.array(*(spread(i) if i == j else F.lit(0.0) for i in range(DIMS) for j in range(DIMS))).alias("precision"),
        F.lit(0.0).alias("log_det"),
    )
    second = _estimate(sizes.select(*GROUP, F.lit(1).alias("start"), "rows", F.lit(1.0).alias("scale"), *[c for c in sizes.columns if c == "kept" or c[0] == "s" and c not in GROUP]))
    paths.append(new_dir(spark, "mcd"))
    now = table(first.unionByName(second), "", paths[-1])

    for _ in range(STEPS):
        placed = _with(rows, now.select(*GROUP, "start", "rows", "mean", "precision"), few).withColumn("bin", _bin())
        key = [*GROUP, "start"]
        counts = placed.groupBy(*key, "rows", "bin").agg(F.count(F.lit(1)).alias("n"))
        below = F.sum("n").over(Window.partitionBy(*key).orderBy("bin"))
        limit = counts.withColumn("below", below).where(F.col("below") >= F.ceil(F.col("rows") * SUPPORT)).groupBy(*key, "rows").agg(F.min("bin").alias("limit"))
        limited = _with(now.select(*key, "mean", "precision"), limit.withColumnRenamed("start", "_start"), few).where(F.col("start") == F.col("_start")).drop("_start")
        inside = _with(rows, limited, few).where(_bin() <= F.col("limit"))
        moments = inside.groupBy(*key, "rows").agg(*_moments()).withColumn("scale", F.lit(CONSISTENCY))
        paths.append(new_dir(spark, "mcd"))
        now = table(_estimate(moments), "", paths[-1])
    best = now.groupBy(*GROUP).agg(F.min_by(F.struct("rows", "mean", "precision", "log_det"), F.struct("log_det", "start")).alias("best"))
    result = table(best.select(*GROUP, "best.*"), "mcd")
    drop(spark, *paths)
    return result


def estimates(stats: DataFrame) -> DataFrame:
    """``fit``, and a row for each smaller group with the estimate of its language or else of all rows."""
    spark = stats.sparkSession
    null = {c: F.lit(None).cast(stats.schema[c].dataType) for c in GROUP}
    model = fit(stats)
    path = new_dir(spark, "mcd")
    small = table(_with(stats.select(*GROUP).distinct(), model.select(*GROUP), model.count() <= BROADCAST_GROUPS, "left_anti"), "", path)
    if small.isEmpty():
        drop(spark, path)
        return model
    values = [c for c in model.columns if c not in GROUP]
    by_language = fit(stats.withColumn("source", null["source"]))
    every = fit(stats.withColumns(null), 1).select(F.struct(*values).alias("every"))
    pool = by_language.select(F.col("lang").alias("_lang"), F.struct(*values).alias("pool"))
    pool = F.broadcast(pool) if by_language.count() <= BROADCAST_GROUPS else pool
    found = small.join(pool, small["lang"].eqNullSafe(pool["_lang"]), "left").join(F.broadcast(every))  # one row, none if the base rules reject all
    result = table(model.unionByName(found.select(*GROUP, F.coalesce("pool", "every").alias("best")).select(*GROUP, "best.*")), "mcd")
    drop(spark, path)
    return result


def judge(stats: DataFrame, model: DataFrame) -> DataFrame:
    """``stats`` with distance (null without an estimate) and kept."""
    names = [c for c in stats.columns if c not in ("distance", "kept")]
    few = model.count() <= BROADCAST_GROUPS
    # The rows travel as one column, so that theirs may have any names.
    packed = stats.select(F.struct(*names).alias("row"), *GROUP, "base_failed", *vector())
    placed = _with(packed, model.select(*GROUP, "mean", "precision"), few, "left").withColumn("distance", distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return placed.select("row.*", "distance", kept.alias("kept"))


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with their own columns.

    Texts are measured twice (for the estimates and for the verdicts), which
    costs less than shuffling them to join verdicts by id, and treats rows that
    share an id each by its own text.
    """
    model = estimates(table(statistics(docs, text_col, list(GROUP)), "quality"))
    hidden, names = private(docs)
    own = hidden.select("*", *(F.col(names[c]).alias(c) for c in GROUP))
    judged = judge(statistics(own, names[text_col]), model)
    return judged.where("kept").select(*names.values()).toDF(*names)
