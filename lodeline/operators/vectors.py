"""Inverted-file index of vectors: nearest neighbours of many queries, exact or by probing a few cells.

``fit`` places cell centres by k-means on a bounded sample. ``build`` assigns every
row to its nearest centre and writes the rows in blocks, one folder a cell, so
that a search reads the cells it needs. ``search`` deals the queries to
their ``probes`` nearest cells and multiplies blocks of queries with blocks of
rows; each pair of blocks passes on the ``limit`` best rows of a query.

With ``exact``, a second round looks into every further cell that can hold a
closer row: a row of a cell is no nearer than the centre's distance less
the cell's radius. The result is then that of a full scan, whatever the probes.

How it scales. The assignment is one Arrow pass with the centres (at most
``MOST_CELLS``) in the closure. Rows are shuffled once, by cell and a part of it
(``BLOCK`` rows a part), so a hot cell is many tasks. Queries and rows meet in a join
by cell of their blocks; neither is collected or broadcast unless Spark finds
it small. What reaches the driver: the sample, one row a cell.

Edge cases: rows and queries without a vector or an id are left out; equal distances go
by id; a table of fewer rows than cells has fewer cells; an empty table has
an empty index and no neighbours; ids are whole numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.tables import cut, new_dir

SAMPLE, MOST_CELLS, BLOCK = 20_000, 4096, 4096
#: Of the score 1 / (1 + distance), the decimals that count.
DECIMALS = 9
_BLOCKS = "cell int, part int, n int, radius double, ids binary, vectors binary"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` and ``b``; near zero to rounding."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _named(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).where("id is not null and size(embedding) > 0")


def fit(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = 10) -> np.ndarray:
    """Centres: k-means on about ``sample`` rows chosen by a hash of the id; the square root of the number of rows by default."""
    rows = _named(vectors)
    total = rows.count()
    if not total:
        return np.zeros((0, 0), np.float32)
    place = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
    held = rows.where(place < sample / total).orderBy("id") if total > sample else rows.orderBy("id")
    points = np.array([r.embedding for r in held.collect()], np.float32)
    cells = min(MOST_CELLS, len(points), cells or max(1, math.isqrt(total)))
    rng = np.random.default_rng(5)
    centres = points[np.sort(rng.choice(len(points), cells, replace=False))].astype(np.float64)
    for _ in range(rounds):
        near = _squares(points, centres).argmin(1)
        counts = np.bincount(near, minlength=cells)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres.astype(np.float32)


def _dealt(vectors: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """cell, away (distance of its centre), id, embedding: each row once for each of its ``probes`` nearest cells."""
    most = min(probes, len(centres))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            away = np.sqrt(_squares(_matrix(batch.column(1)), centres))
            near = np.argsort(away, axis=1, kind="stable")[:, :most] if most > 1 else away.argmin(1)[:, None]
            take = np.repeat(np.arange(batch.num_rows), most)
            yield pa.RecordBatch.from_arrays(
                [pa.array(near.ravel(), pa.int32()), pa.array(away[take, near.ravel()]), batch.column(0).take(pa.array(take)), batch.column(1).take(pa.array(take))],
                names=["cell", "away", "id", "embedding"],
            )

    return _named(vectors).mapInArrow(run, "cell int, away double, id long, embedding array<float>")


def _blocks(dealt: DataFrame) -> DataFrame:
    """Rows packed by cell and part; a part has about ``BLOCK`` rows."""
    sizes = F.broadcast(dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")))  # at most MOST_CELLS rows
    parted = dealt.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")

    def pack(key, rows):
        at, edges = [], np.flatnonzero(np.diff(key, prepend=-1, append=-1))
        for low, high in zip(edges[:-1], edges[1:]):
            some = rows.slice(int(low), int(high - low))
            ids = some.column("id").to_numpy(zero_copy_only=False).astype("<i8")
            radius = float(some.column("away").to_numpy(zero_copy_only=False).max())
            at.append((some.column("cell")[0].as_py(), some.column("part")[0].as_py(), len(ids), radius, ids.tobytes(), _matrix(some.column("embedding").combine_chunks()).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*at), (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary()))], names=["cell", "part", "n", "radius", "ids", "vectors"])

    def run(batches):
        # Rows are sorted by (cell, part): all but the last part of what is held are whole.
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = held.column("cell").to_numpy().astype(np.int64) << 32 | held.column("part").to_numpy()
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if whole:
                yield pack(key[:whole], held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield pack(held.column("cell").to_numpy().astype(np.int64) << 32 | held.column("part").to_numpy(), held)

    return parted.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(run, _BLOCKS)


def build(vectors: DataFrame, centres: np.ndarray, path: str | None = None) -> DataFrame:
    """The index: blocks of rows below one folder a cell."""
    spark, path = vectors.sparkSession, path or new_dir(vectors.sparkSession, "vectors")
    if not len(centres):
        return spark.createDataFrame([], _BLOCKS)
    made = _blocks(cut(_dealt(vectors, centres, 1), "cells"))
    made.write.partitionBy("cell").parquet(path)
    return spark.read.schema(made.schema).parquet(path).select(*made.columns)


def _best(found: DataFrame, limit: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= limit)


def _met(index: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """query, id, distance, score: of every block of rows the best for each query of its cell."""
    asked = queries.select("cell", F.col("ids").alias("asked"), F.col("vectors").alias("wanted"))
    cells = [r.cell for r in asked.select("cell").distinct().collect()]  # at most MOST_CELLS
    pairs = index.where(F.col("cell").isin(cells)).select("cell", "ids", "vectors").join(asked, "cell").drop("cell")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, rows, asked, wanted = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in zip(range(4), ("<i8", "<f4", "<i8", "<f4")))
                rows, wanted = rows.reshape(len(ids), -1).astype(np.float64), wanted.reshape(len(asked), -1).astype(np.float64)
                for low in range(0, len(asked), 256):
                    yield _pairs(ids, rows, asked[low : low + 256], wanted[low : low + 256], limit)

    return pairs.mapInArrow(run, "query long, id long, distance double, score double")


def _pairs(ids: np.ndarray, rows: np.ndarray, asked: np.ndarray, wanted: np.ndarray, limit: int) -> pa.RecordBatch:
    columns: list[list[np.ndarray]] = [[], [], [], []]
    squares = _squares(wanted, rows)
    for q, near in enumerate(squares):
        if len(ids) > limit:
            bar = np.partition(near, limit - 1)[limit - 1]
            some = np.flatnonzero(near <= bar + 1e-6 * (1 + bar))  # what rounding could put among the first
        else:
            some = np.arange(len(ids))
        distance = np.sqrt(((rows[some] - wanted[q]) ** 2).sum(1))
        score = np.round(1 / (1 + distance), DECIMALS)
        first = np.lexsort((ids[some], -score))[:limit]
        for column, values in zip(columns, (np.full(len(first), asked[q]), ids[some][first], distance[first], score[first])):
            column.append(values)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["query", "id", "distance", "score"])


def search(index: DataFrame, centres: np.ndarray, queries: DataFrame, limit: int = 30, probes: int = 8, exact: bool = True) -> DataFrame:
    """query, id, score, rank: the nearest rows of every query (id, embedding)."""
    if not len(centres):
        return index.sparkSession.createDataFrame([], "query long, id long, score double, rank int")
    found = _best(_met(index, _blocks(_dealt(queries, centres, probes)), limit), limit)
    if exact:
        found = cut(found, "near")
        found = _best(found.drop("rank").unionByName(_met(index, _blocks(_further(index, centres, queries, found, limit, probes)), limit)), limit)
    return found.select("query", "id", "score", F.col("rank").cast("int").alias("rank"))


def _further(index: DataFrame, centres: np.ndarray, queries: DataFrame, found: DataFrame, limit: int, probes: int) -> DataFrame:
    """Queries dealt to the cells beyond their first ``probes`` that can hold a row as near as the last one found."""
    radius = np.full(len(centres), -np.inf)  # a cell without rows is never looked into
    for r in index.groupBy("cell").agg(F.max("radius").alias("radius")).collect():
        radius[r.cell] = r.radius
    bars = found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("bar"))
    asked = _named(queries).join(bars, F.col("id") == F.col("query"), "left").select("id", "embedding", F.when(F.col("n") >= limit, F.col("bar")).otherwise(F.lit(float("inf"))).alias("bar"))
    most = min(probes, len(centres))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            away = np.sqrt(_squares(_matrix(batch.column(1)), centres))
            bar = batch.column(2).to_numpy(zero_copy_only=False)
            worth = away - radius[None, :] <= (bar + 1e-6 * (1 + bar))[:, None]
            worth &= np.isfinite(radius)[None, :]
            seen = np.argsort(away, axis=1, kind="stable")[:, :most] if most > 1 else away.argmin(1)[:, None]
            np.put_along_axis(worth, seen, False, axis=1)
            q, cell = np.nonzero(worth)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(away[q, cell]), batch.column(0).take(pa.array(q)), batch.column(1).take(pa.array(q))], names=["cell", "away", "id", "embedding"])

    return asked.mapInArrow(run, "cell int, away double, id long, embedding array<float>")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours that ``found`` has."""
    row = exact.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left").agg(F.count("hit") / F.count(F.lit(1))).first()
    return 1.0 if row[0] is None else float(row[0])
