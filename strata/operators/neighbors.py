"""Nearest neighbours by cosine (C7); within a candidate budget see ``quantized``.

Exact search for queries that fit a broadcast: the vectors stay in their scan
partitions; each task multiplies its Arrow batches with the query matrix, keeps
a running top k per query and gives out only that.

Larger query tables go through cells: vectors are
grouped around centroids, a query visits only cells that can hold one of its k
nearest (bounds from the triangle inequality), and both sides meet by an equi-join on (cell, shard).
A large cell is cut into shards, so no task holds more than SHARD_ROWS vectors.
Pairs of query and vector exist only inside the matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strata.constants import SCORE_DECIMALS
from strata.functions.vector import as_double, unit
from strata.operators.corpus import check_vector_dims
from strata.sizing import Size, fits, measure, shuffle_width
from strata.storage import settle

MOST_CELLS = 16_384  # centroids a task holds
SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
MATRIX_CELLS = 4_000_000  # scores held at once in a task
# Angles this close may belong to cosines that are equal after rounding.
_SLACK = 2e-4
# Spark cuts row_number() <= k to k rows per task before the shuffle up to this k.
_PARTIAL_LIMIT = 1000


def top_k(df: DataFrame, key: str, order: list[Column], k: int, spread: str) -> DataFrame:
    """First ``k`` rows per key with their ``rank``, cut inside each task first.

    Up to 1000 rows Spark does the early cut itself. Beyond, ranks are first
    taken per (key, hash of ``spread``), so that a hot key is ranked by many tasks.
    """
    if k > _PARTIAL_LIMIT:
        salt = F.pmod(F.xxhash64(spread), F.lit(shuffle_width(df.sparkSession)))
        early = Window.partitionBy(key, salt).orderBy(*order)
        df = df.withColumn("_early", F.row_number().over(early)).filter(F.col("_early") <= k)
        df = df.drop("_early")
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


# --- helpers inside tasks -----------------------------------------------------


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def stack(column: pa.Array) -> np.ndarray:
    """Arrow list column -> float64 matrix; all vectors must have one width."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(flat) // max(1, len(column))
    if len(column) and not (pa.compute.list_value_length(column).to_numpy() == width).all():
        raise ValueError("vectors of different width")
    return flat.reshape(len(column), width)


def rounded(values: np.ndarray) -> np.ndarray:
    """Rounded like ``functions.vector.keep``: halves away from zero."""
    scale = 10.0**SCORE_DECIMALS
    return np.copysign(np.floor(np.abs(values) * scale + 0.5) / scale, values)


def of_width(docs: DataFrame, vector: str, width: int) -> DataFrame:
    """A10 before a search: the job fails with a message at a vector of another width."""
    return check_vector_dims(docs, width, vector)


def cosines(docs: np.ndarray, queries: np.ndarray, clamped: bool) -> np.ndarray:
    if docs.shape[1] != queries.shape[1]:
        raise ValueError(f"query width {queries.shape[1]}, stored width {docs.shape[1]}")
    cos = rounded(docs @ queries.T) + 0.0
    return np.clip(cos, 0.0, 1.0) if clamped else cos


def slices(batch: pa.RecordBatch, n_queries: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose score matrix stays small."""
    step = max(1, MATRIX_CELLS // max(1, n_queries))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _keys(ids: np.ndarray) -> np.ndarray:
    """Ids as sort keys of their own type: numbers as numbers, text by code point."""
    if ids.dtype != object:
        return ids
    some = next((i for i in ids if i is not None), None)
    if isinstance(some, str):  # a missing id comes first, as in Spark's order
        return np.array(["" if i is None else i for i in ids.tolist()])
    return np.array(ids.tolist())


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by (score descending, id)."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= floor
        scores, ids = scores[near], ids[near]
    order = np.lexsort((_keys(ids), -scores))[:k]
    return scores[order], ids[order]


class Running:
    """The k best (score, id) seen so far for each of some queries."""

    def __init__(self, query_ids: list, k: int):
        self.query_ids, self.k = query_ids, k
        self.held: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(query_ids)
        self.floor = np.full(len(query_ids), -np.inf)  # the k-th best score held

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` has one row per id and one column per query."""
        if not len(ids):
            return
        least = self.floor
        if len(ids) > self.k:  # the k-th best of the block bounds what it can add
            least = np.maximum(least, np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k])
        near = (scores >= least) & (scores > -np.inf)
        for j in np.flatnonzero(near.any(axis=0)).tolist():
            column, names = scores[near[:, j], j], ids[near[:, j]]
            old = self.held[j]
            if old is not None:
                column, names = np.concatenate([old[0], column]), np.concatenate([old[1], names])
            best = self.held[j] = _best(column, names, self.k)
            if len(best[0]) == self.k:
                self.floor[j] = best[0][-1]

    def add_over(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """`add` for sums not yet rounded, of which those above zero count: only what may reach the best is rounded."""
        near = scores > np.maximum(self.floor - 10.0 ** (1 - SCORE_DECIMALS), 0)
        found = np.flatnonzero(near.any(axis=1))
        if len(found):
            scores = scores[found]
            self.add(np.where(near[found], rounded(scores), -np.inf), ids[found])

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for query_id, best in zip(self.query_ids, self.held, strict=True):
            if best is not None:
                found = np.isfinite(best[0])  # -inf marks what does not match at all
                columns = [[query_id] * int(found.sum()), list(best[1][found]), best[0][found]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
                )


def found_schema(queries: DataFrame, docs: DataFrame, id_col: str, score: str) -> T.StructType:
    """(query_id, id, score) with the types of both sides."""
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField(score, T.DoubleType()),
        ]
    )


def query_matrix(queries: DataFrame) -> tuple[list, np.ndarray] | None:
    """Ids and unit vectors of a query table that was measured to fit a broadcast."""
    rows = searchable(queries, "query_id", "query_vector").collect()
    if not rows:
        return None
    vectors = np.array([r["vector"] for r in rows], dtype=np.float64)
    return [r["query_id"] for r in rows], unit_rows(vectors)


# --- exact search in place ----------------------------------------------------


def searchable(docs: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vector) of rows whose vector has a direction."""
    return docs.select(id_col, F.col(vector).alias("vector")).filter(
        F.exists("vector", lambda x: x != 0)
    )


def _scan_search(docs: DataFrame, queries: DataFrame, k: int, id_col: str, clamped: bool) -> DataFrame:
    """(query_id, id, cos): k candidates per query and task. ``queries`` was measured."""
    asked = query_matrix(queries)
    schema = found_schema(queries, docs, id_col, "cos")
    arrow = to_arrow_schema(schema)
    if asked is None:
        return docs.sparkSession.createDataFrame([], schema)
    side = docs.sparkSession.sparkContext.broadcast(asked)
    docs = of_width(docs, "vector", asked[1].shape[1])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = side.value
        best = Running(query_ids, k)
        for batch in batches:
            for part in slices(batch, len(query_ids)):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                best.add(cosines(unit_rows(stack(part.column(1))), q, clamped), ids)
        yield from best.batches(arrow)

    return searchable(docs, id_col, "vector").mapInArrow(search, schema)


# --- cells ----------------------------------------------------------------------


@dataclass(frozen=True)
class Cells:
    """Centroids, at most ``n_cells`` of them, held like a trained model."""

    centroids: np.ndarray


def cell_number(docs: DataFrame) -> int:
    """Cells that grow with the corpus: the square root of its vectors, as long as tasks can hold them."""
    return max(1, min(MOST_CELLS, round(docs.count() ** 0.5)))


def seed_cells(docs: DataFrame, n_cells: int | None = None, id_col: str = "doc_id") -> Cells:
    """Centroids picked by hash order of the ids: no training."""
    rows = searchable(docs, id_col, "vector")
    order = F.md5(F.col(id_col).cast("string"))
    ids = rows.select(id_col).orderBy(order, id_col).limit(n_cells or cell_number(rows))  # ids alone are sorted
    picked = sorted(rows.join(F.broadcast(ids), id_col, "left_semi").withColumn("_o", order).collect(), key=lambda r: (r["_o"], r[id_col]))
    return Cells(unit_rows(np.array([r["vector"] for r in picked], dtype=np.float64).reshape(len(picked), -1)))


def kmeans_cells(docs: DataFrame, n_cells: int | None = None, id_col: str = "doc_id", seed: int = 42) -> Cells:
    """Centroids trained by MLlib on unit vectors."""
    n_cells = n_cells or cell_number(searchable(docs, id_col, "vector"))
    points = searchable(docs, id_col, "vector").select(
        array_to_vector(unit(as_double(F.col("vector")))).alias("features")
    )
    centers = np.array(KMeans(k=n_cells, seed=seed, maxIter=10, initSteps=2).fit(points).clusterCenters())
    return Cells(unit_rows(centers[np.linalg.norm(centers, axis=1) > 0]))


def assign_cells(docs: DataFrame, cells: Cells, id_col: str = "doc_id") -> DataFrame:
    """(id, vector, cell, cos): every vector with its nearest centroid. Stored with
    ``partitionBy("cell")`` this is the index; a search reads only its cells."""
    side = docs.sparkSession.sparkContext.broadcast(cells.centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cos = unit_rows(stack(batch.column(1))) @ side.value.T
                cell = cos.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(cell.astype(np.int32)),
                        pa.array(cos[np.arange(len(cell)), cell]),
                    ],
                    names=[id_col, "vector", "cell", "cos"],
                )

    source = searchable(docs, id_col, "vector")
    kinds = [source.schema[c].dataType.simpleString() for c in (id_col, "vector")]
    return source.mapInArrow(place, f"{id_col} {kinds[0]}, vector {kinds[1]}, cell int, cos double")


def _angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1.0, 1.0))


def cells_to_visit(
    q: np.ndarray, centroids: np.ndarray, n: np.ndarray, radius: np.ndarray, k: int
) -> list[np.ndarray]:
    """Cells each query has to look into.

    A vector of a cell is at most the cell's radius
    away from the centroid. The cells whose farthest possible vector is nearest
    and that together hold k vectors give a limit for the k-th best angle;
    cells whose nearest possible vector is beyond it are left out. Cosines are
    cut at 0, so a limit of a right angle or more leaves nothing out.
    """
    angle = _angle(q @ centroids.T)
    visits = []
    for row in angle:
        farthest = np.minimum(np.pi, row + radius)
        order = np.argsort(farthest, kind="stable")
        enough = np.searchsorted(np.cumsum(n[order]), k)
        limit = farthest[order[enough]] if enough < len(order) else np.pi
        if limit >= np.pi / 2 - _SLACK:
            limit = np.pi
        visits.append(np.flatnonzero((row - radius <= limit + _SLACK) & (n > 0)))
    return visits


def _cell_search(
    placed: DataFrame, queries: DataFrame, cells: Cells, size: Size, k: int,
    id_col: str, clamped: bool,
) -> DataFrame:
    """(query_id, id, cos): k candidates per query, cell and shard."""
    spark = placed.sparkSession
    stats = {r["cell"]: r for r in placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("cos").alias("min_cos")
    ).collect()}
    count = len(cells.centroids)
    n = np.array([stats[c]["n"] if c in stats else 0 for c in range(count)])
    radius = _angle(np.array([stats[c]["min_cos"] if c in stats else 1.0 for c in range(count)]))
    shards = np.maximum(1, -(-n // SHARD_ROWS))
    blocks = max(1, -(-size.rows // BLOCK_QUERIES))
    side = spark.sparkContext.broadcast((cells.centroids, n, radius))
    qid_type = queries.schema["query_id"].dataType.simpleString()

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, n_, radius_ = side.value
        for pdf in batches:
            if len(pdf):
                q = unit_rows(np.array(pdf["vector"].tolist(), dtype=np.float64))
                where = cells_to_visit(q, centroids, n_, radius_, k)
                yield pd.DataFrame({"query_id": pdf["query_id"], "q": pdf["vector"], "cells": [c.tolist() for c in where]})

    asked = searchable(queries, "query_id", "query_vector")
    kind = asked.schema["vector"].dataType.simpleString()
    pieces = F.get(F.lit([int(s) for s in shards]), F.col("cell"))
    routed = asked.mapInPandas(route, f"query_id {qid_type}, q {kind}, cells array<int>")
    routed = routed.select("query_id", "q", F.explode("cells").alias("cell"))
    routed = routed.withColumn("shard", F.explode(F.sequence(F.lit(0), pieces - 1))).withColumn(
        "block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    )
    visited = routed.select("cell").distinct()  # at most one row per cell
    docs = placed.drop("cos").join(F.broadcast(visited), "cell", "left_semi")
    docs = docs.withColumn("shard", F.pmod(F.xxhash64(id_col), pieces).cast("int"))
    docs = docs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], id_col: [], "cos": []}
        if len(left) and len(right):
            u = unit_rows(np.array(left["vector"].tolist(), dtype=np.float64))
            q = unit_rows(np.array(right["q"].tolist(), dtype=np.float64))
            cos, ids = cosines(u, q, clamped), left[id_col].to_numpy()
            for j, query_id in enumerate(right["query_id"]):
                scores, names = _best(cos[:, j], ids, k)
                out["query_id"] += [query_id] * len(scores)
                out[id_col] += list(names)
                out["cos"] += list(scores)
        return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in out.items()})

    key = ["cell", "shard", "block"]
    return docs.groupBy(*key).cogroup(routed.groupBy(*key)).applyInPandas(
        meet, found_schema(queries, placed, id_col, "cos")
    )


# --- search ----------------------------------------------------------------------


def knn(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    cells: Cells | None = None,
    id_col: str = "doc_id",
    size: Size | None = None,
    clamped: bool = False,
) -> DataFrame:
    """(query_id, id, rank, cos, sim, score): the k nearest vectors of each query.

    ``score`` is (1 + cos) / 2, ``sim`` the cosine cut to [0, 1]. Order: cosine
    (``sim`` when ``clamped``, then ``cos`` holds the cut value too), then id.
    """
    if size is None:
        size = measure(queries.select("query_id", "query_vector"))
    if cells is None and fits(docs.sparkSession, size):
        found = _scan_search(docs, queries, k, id_col, clamped)
    else:
        cells = cells or seed_cells(docs, id_col=id_col)
        placed = settle(assign_cells(docs, cells, id_col))
        found = _cell_search(placed, queries, cells, size, k, id_col, clamped)
    best = top_k(found, "query_id", [F.col("cos").desc(), F.col(id_col)], k, id_col)
    return best.withColumn(
        "sim", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("cos")))
    ).withColumn("score", (1 + F.col("cos")) / 2)


def knn_exact(docs: DataFrame, queries: DataFrame, k: int = 10, **options) -> DataFrame:
    """Exact top k by cosine, over every row that has a vector."""
    return knn(docs, queries, k, **options)


def recall(approx: DataFrame, exact: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(query_id, k, found, recall) of an approximate result against the exact one."""
    hit = approx.select("query_id", id_col, F.lit(1).alias("hit"))
    return (
        exact.select("query_id", id_col)
        .join(hit, ["query_id", id_col], "left")
        .groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("k"), F.count("hit").alias("found"))
        .withColumn("recall", F.col("found") / F.col("k"))
    )
