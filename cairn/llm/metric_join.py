"""Operator 5. Exact near-duplicates of embeddings: a metric range join.

Vectors are scaled to length 1, so that a cosine of at least ``COSINE`` is a Euclidean distance of at most ``r = sqrt(2 - 2 COSINE)``.
Pivots, the vectors of the least seeded hash, cut the space into cells: a vector's home is its nearest pivot's. It is also copied to every other cell
that may hold a partner: by the triangle inequality not those whose pivot is farther from it than the cell's radius plus ``r``, nor those
beyond whose boundary, ``(d(x, q)^2 - d(x, p)^2) / (2 d(p, q))`` away, it lies farther than ``r``. Each cell joins its residents with
all vectors in it, apart from the others. A pair is emitted in the home of its lesser id, so once. A cell of
many residents is cut into parts that each see the whole cell.

The query gives a row a vector: its number of links, that is of other vectors at the threshold, all of which it meets at home, and its class, the least id
that links lead to. Equal vectors are folded into one that stands for them by their number; links are summed up where vectors meet, and no pairs leave a task.
``near_pairs`` gives the pairs themselves.

The pivots grow as the square root of the table, and are what is broadcast: 40 MB for 4 * 10^11 vectors of 64 elements. In many dimensions near boundaries are everywhere: for vectors
without structure nearly all are copied to most cells, which is the price of an exact answer.

Defined results: of pairs: vectors that are null, empty, of another length than the most frequent one, of zero length or with a null or non-finite element have
no partner; null ids are left out; an id is never its own partner, of repeated rows of an id each vector pairs (distinct pairs at their greatest cosine);
equal vectors have cosine 1; cosines are compared at 9 decimals. Extra columns are ignored; an empty table gives no pairs. Of classes the same, but an id with several
vectors has a row of each, which link to each other if near and else may be of two classes of this least id; vectors without partners are classes of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import narrowed, written
from cairn.llm.graph import TALLIES, link_classes, link_classes_sql, weighed

COSINE = 0.95
#: There are as many pivots as the root of the vectors by this; residents of a cell's part.
PER_PIVOT, PART = 64.0, 4096
#: Distances of a batch's vectors to pivots that are held at once.
BLOCK = 1 << 20
#: Vectors of a cell that one part of its residents meets at a time, so that a task's memory does not grow with the cell.
MEMBERS = 16384
SEED = "cairn-pivot-1"
_SLACK = 1e-6


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """A written table ``id, v, key`` of the usable vectors at length 1, in double, and a hash of them as given."""
    v = narrowed(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.xxhash64("embedding").alias("key")).where("id is not null and size(v) > 0")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    dim = v.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    v = v.join(F.broadcast(dim.select("dim")), F.size("v") == F.col("dim")).withColumn("norm", norm).where("norm > 0")  # one row
    return written(v.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"), "key"), "unit")


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _met(units: DataFrame, cosine: float, join: Callable, schema: str) -> DataFrame:
    """What ``join`` gives of the parts of all cells, with ``units(id, v, ...)``."""
    r = math.sqrt(max(0.0, 2 - 2 * cosine)) + _SLACK
    spark = units.sparkSession
    n = units.count()
    k = max(1, math.ceil(math.sqrt(n / PER_PIVOT)))
    chosen = units.orderBy(F.md5(F.concat(F.lit(SEED), F.col("id").cast("string"))), "id", "v").limit(k).toPandas()  # the pivots
    pivots = np.stack(chosen.v.map(np.asarray)) if len(chosen) else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(pivots)
    step = max(1, BLOCK // len(pivots))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                d = _distances(_matrix(batch.column(1).slice(lo, step)), shared.value)
                at = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(at)), at])], ["cell", "d"])

    cells = units.mapInArrow(home, "cell int, d double").groupBy("cell").agg(F.max("d").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # a row a pivot
    radius, parts = np.full(len(pivots), -np.inf), np.ones(len(pivots), np.int64)
    for c in cells:
        radius[c.cell], parts[c.cell] = c.radius, -(-c.n // PART)
    bounds = spark.sparkContext.broadcast((radius, parts))

    def reached(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, cell and own cell of every stay of a batch's vectors."""
        pivots, (radius, _) = shared.value, bounds.value
        row, cell, home = [], [], []
        for lo in range(0, batch.num_rows, step):
            d = _distances(_matrix(batch.column(1).slice(lo, step)), pivots)
            rows = np.arange(len(d))
            own = d.argmin(axis=1)
            nearest = d[rows, own]
            apart = np.maximum(_distances(pivots[own], pivots), 1e-12)
            reach = (d <= radius + r) & ((d * d - nearest[:, None] ** 2) / (2 * apart) <= r)
            reach[rows, own] = True
            i, c = np.nonzero(reach)
            row.append(i + lo)
            cell.append(c)
            home.append(own)
        return np.concatenate(row), np.concatenate(cell), np.concatenate(home)

    def crowd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            if batch.num_rows:
                n += np.bincount(reached(batch)[1], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)).astype(np.int32)), pa.array(n)], ["cell", "n"])

    runs = np.ones(len(pivots), np.int64)
    for c in units.mapInArrow(crowd, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row a pivot
        runs[c.cell] = max(1, -(-c.n // MEMBERS))
    crowds = spark.sparkContext.broadcast(runs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, runs = bounds.value[1], crowds.value
        for batch in batches:
            if not batch.num_rows:
                continue
            row, cell, own = reached(batch)
            turn = np.random.default_rng(0).integers(0, 1 << 30, len(row))
            home = cell == own[row]
            # a member of one run meets every part of the residents, a resident of one part every run
            for resident, at, many, few in ((False, np.arange(len(row)), parts, runs), (True, np.flatnonzero(home), runs, parts)):
                count = many[cell[at]]
                again = np.repeat(at, count)
                each = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
                fixed = turn[again] % few[cell[again]]
                part, run = (fixed, each) if resident else (each, fixed)
                take = pa.array(row[again])
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), *(pa.array(x.astype(np.int32)) for x in (cell[again], part, run)), pa.array(np.full(len(again), resident))], [*batch.schema.names, "cell", "part", "run", "resident"])

    given = ", ".join(f"{c} {t}" for c, t in units.dtypes)
    return units.mapInArrow(place, f"{given}, cell int, part int, run int, resident boolean").groupBy("cell", "part", "run").applyInArrow(join, schema)


def _near(rows: pa.Table, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of residents, of the vectors that are near them, and their cosines."""
    v = _matrix(rows.column("v"))
    mine = rows.column("resident").to_numpy(zero_copy_only=False)
    own, others = np.flatnonzero(mine), np.flatnonzero(~mine)
    w = v[others]
    step = max(1, (1 << 20) // max(len(others), 1))
    for i in range(0, len(own), step):
        at = own[i : i + step]
        s = v[at] @ w.T
        a, b = np.nonzero(s >= cosine - 1e-8)
        near = np.round(s[a, b], 9)
        good = near >= cosine
        yield at[a[good]], others[b[good]], near[good]


def near_pairs(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_a < vec_b, cosine`` for all pairs of vectors at the threshold."""

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        ids, out = rows.column("id").to_numpy(), []
        for a, b, near in _near(rows, cosine):
            less = ids[a] < ids[b]
            out.append((ids[a[less]], ids[b[less]], near[less]))
        a, b, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3
        return pa.table({"vec_a": a.astype(np.int64), "vec_b": b.astype(np.int64), "cosine": s.astype(np.float64)})

    pairs = _met(unit_vectors(vectors).select("id", "v"), cosine, join, "vec_a long, vec_b long, cosine double")
    return pairs.groupBy("vec_a", "vec_b").agg(F.round(F.max("cosine"), 6).alias("cosine"))


def near_classes(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The query's result: ``vec_id, class_id, n_links`` of every vector, the least id that links lead to and the number of vectors at the threshold."""

    def tally(key: tuple, rows: pa.Table) -> pa.Table:
        ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
        who, node = np.unique(ids, return_inverse=True)
        label, flag, links = np.arange(len(who)), np.zeros(len(who), bool), np.zeros(len(who), np.int64)
        for a, b, _ in _near(rows, cosine):
            other = ids[a] != ids[b]
            a, b = a[other], b[other]
            np.add.at(links, node[a], n[b])
            cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else []
            for k, to in zip(node[a[cut]], np.split(node[b], cut[1:]), strict=True) if len(a) else ():
                if (label[to] != label[k]).any():
                    least = min(label[k], label[to].min())
                    flag[label[to]] = flag[label[k]] = True
                    label[flag[label]] = least
                    flag[:] = False
        some = np.flatnonzero((links > 0) | (label != np.arange(len(who))))
        return pa.table({"fp": who[some], "links": links[some], "root": who[label[some]], "whole": np.zeros(len(some), bool)})

    units = unit_vectors(vectors)
    folded = units.groupBy("v").agg(F.collect_set(F.struct("id", "key")).alias("docs"))
    folded = written(folded.select(F.monotonically_increasing_id().alias("fp"), "v", "docs"), "folded")
    members, weights = weighed(folded.select("fp", F.explode("docs").alias("d")).select("fp", "d.id", "d.key"))
    tallies = written(_met(written(folded.select(F.col("fp").alias("id"), "v", F.size("docs").cast("long").alias("n")), "distinct"), cosine, tally, TALLIES), "tallies")
    every = narrowed(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("id"), F.xxhash64("embedding").alias("key"))
    return link_classes(every, members, weights, tallies).withColumnRenamed("id", "vec_id")


#: Cosine of the query that shows the join on tables without near copies.
LOOSE = 0.45


def sql(cosine: float) -> str:
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine
FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.v, b.v), 9) >= {cosine}"""


SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS d, vec_id, embedding::DOUBLE[] AS v FROM (SELECT DISTINCT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL)),
p AS MATERIALIZED (SELECT a.d AS a, b.d AS b FROM d a JOIN d b ON a.d < b.d WHERE round(list_cosine_similarity(a.v, b.v), 9) >= {COSINE}),
{link_classes_sql("vec_id")}"""
