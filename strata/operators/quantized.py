"""Approximate neighbours within a candidate budget (C8), by product quantisation.

A unit vector is cut into subspaces of a few dimensions, and each part is replaced by the number of the nearest
of at most 256 centroids: a code of one byte a subspace. A search looks the inner products of a query's parts with
all centroids up in a table, adds them by the codes of every document, and keeps the best `num_candidates`; only
these are read as vectors and ranked exactly. So all documents take part, whatever their number, at a sixteenth of
the bytes (64 floats against 16 codes), and a filter holds before the candidates are cut: filter the code table.

The codebooks are fitted per subspace, each in a task of its own, on a sample of about `SAMPLE` vectors picked by a
hash of the id; every row is coded. Query tables that fit a broadcast are looked up where the codes lie; larger ones
meet the codes by an equi-join on (shard, block), so a task holds a block of queries and a shard of codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strata.functions.vector import as_double, clamp01, dot, keep, unit
from strata.operators.neighbors import (
    BLOCK_QUERIES, Running, found_schema, of_width, query_matrix, rounded, searchable, slices, stack, top_k, unit_rows,
)
from strata.sizing import Size, fits, hint_if, measure
from strata.storage import settle

SUBSPACES = 16
CENTROIDS = 256  # a code is one byte
#: Vectors that the codebooks are fitted on, about; every vector is coded.
SAMPLE = 16_384
ROUNDS = 12
CANDIDATES = 100
SHARD_CODES = 65_536


@dataclass(frozen=True)
class Codebooks:
    """Centroids (subspace, code, dimension) for vectors of ``width``; the last part may be filled up with zeros."""

    centroids: np.ndarray
    width: int

    def parts(self, units: np.ndarray) -> np.ndarray:
        """(row, subspace, dimension)."""
        if units.shape[1] != self.width:
            raise ValueError(f"vector width {units.shape[1]}, codebooks for {self.width}")
        m, _, d = self.centroids.shape
        return np.pad(units, ((0, 0), (0, m * d - self.width))).reshape(len(units), m, d)

    def codes(self, units: np.ndarray) -> np.ndarray:
        parts = self.parts(units)
        out = np.empty(parts.shape[:2], np.uint8)
        for j, book in enumerate(self.centroids):
            out[:, j] = _nearest(parts[:, j], book)
        return out

    def products(self, units: np.ndarray) -> np.ndarray:
        """Inner products (subspace, code, query) of the queries' parts with all centroids."""
        return np.einsum("qmd,mcd->mcq", self.parts(units), self.centroids)


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (points @ book.T - (book * book).sum(axis=1) / 2).argmax(axis=1)


def _fitted(points: np.ndarray, centroids: int, rounds: int) -> np.ndarray:
    """Lloyd's rounds from points spread over the sample; a centroid without points stays."""
    start = np.unique(points, axis=0)
    book = start[np.linspace(0, len(start) - 1, min(centroids, len(start))).astype(int)]
    for _ in range(rounds):
        code = _nearest(points, book)
        n = np.bincount(code, minlength=len(book))
        sums = np.stack([np.bincount(code, points[:, i], len(book)) for i in range(points.shape[1])], axis=1)
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
    return book


def train_codebooks(
    docs: DataFrame, subspaces: int = SUBSPACES, centroids: int = CENTROIDS, sample: int = SAMPLE, id_col: str = "doc_id",
    vector: str = "vector",
) -> Codebooks:
    """Codebooks from a sample of about ``sample`` vectors, one task a subspace. The same ids give the same ones."""
    if not 0 < centroids <= CENTROIDS:
        raise ValueError("a code is one byte: 1 to 256 centroids")
    rows = searchable(docs, id_col, vector)
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n:
        raise ValueError("no vectors to fit codebooks on")
    rows = of_width(rows, "vector", width)
    subspaces = min(subspaces, width)
    dims = -(-width // subspaces)
    if n > sample:
        rows = rows.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    whole = F.concat(unit(F.col("vector")), F.array_repeat(F.lit(0.0), subspaces * dims - width))
    cut = F.transform(F.sequence(F.lit(0), F.lit(subspaces - 1)), lambda j: F.slice(whole, j * dims + 1, F.lit(dims)))
    parts = rows.select(F.col(id_col).cast("string").alias("id"), F.posexplode(cut).alias("part", "x"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.array(pdf.sort_values("id")["x"].tolist(), np.float64)
        book = _fitted(points, centroids, ROUNDS)
        return pd.DataFrame({"part": int(pdf["part"].iloc[0]), "code": range(len(book)), "x": book.tolist()})

    found = parts.groupBy("part").applyInPandas(fit, "part int, code int, x array<double>").collect()  # subspaces x centroids
    books = np.full((subspaces, max(r["code"] for r in found) + 1, dims), np.inf)
    for r in found:
        books[r["part"], r["code"]] = r["x"]
    filled = np.where(np.isinf(books), books[:, :1], books)  # books of fewer centroids repeat their first
    return Codebooks(filled, width)


def encode(docs: DataFrame, books: Codebooks, id_col: str = "doc_id", vector: str = "vector", keep_columns: tuple[str, ...] = ()) -> DataFrame:
    """(id, code, kept columns) for every vector that has a direction: the index. Kept columns are there to filter by."""
    side = docs.sparkSession.sparkContext.broadcast(books)
    rows = docs.select(id_col, F.col(vector).alias("vector"), *keep_columns).filter(F.exists("vector", lambda x: x != 0))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = side.value.codes(unit_rows(stack(batch.column(1))))
            column = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), column, *batch.columns[2:]], names=[id_col, "code", *keep_columns])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{id_col}` {kinds[id_col]}", "code binary", *[f"`{c}` {kinds[c]}" for c in keep_columns]])
    return rows.mapInArrow(code, schema)


def _approx(codes: pa.Array, products: np.ndarray) -> np.ndarray:
    """Sums of looked-up inner products, a row per document and a column per query."""
    m = products.shape[0]
    code = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), m)
    out = np.zeros((len(codes), products.shape[2]))
    for j in range(m):
        out += products[j][code[:, j]]
    return rounded(out)


def _scan_codes(codes: DataFrame, queries: DataFrame, books: Codebooks, n: int, id_col: str) -> DataFrame:
    schema = found_schema(queries, codes, id_col, "approx")
    asked = query_matrix(queries)
    if asked is None:
        return codes.sparkSession.createDataFrame([], schema)
    side = codes.sparkSession.sparkContext.broadcast((asked[0], books.products(asked[1])))
    arrow = to_arrow_schema(schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, products = side.value
        best = Running(query_ids, n)
        for batch in batches:
            for part in slices(batch, len(query_ids)):
                best.add(_approx(part.column(1), products), part.column(0).to_numpy(zero_copy_only=False))
        yield from best.batches(arrow)

    return codes.select(id_col, "code").mapInArrow(search, schema)


def _meet_codes(codes: DataFrame, queries: DataFrame, books: Codebooks, n: int, id_col: str, size: Size) -> DataFrame:
    """The same for any number of queries: shards of codes meet blocks of queries."""
    schema = found_schema(queries, codes, id_col, "approx")
    shards, blocks = max(1, -(-codes.count() // SHARD_CODES)), max(1, -(-size.rows // BLOCK_QUERIES))
    side = codes.sparkSession.sparkContext.broadcast(books)

    def dealt(df: DataFrame, key: str, own: str, parts: int, other: str, copies: int) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    left = dealt(codes.select(id_col, "code"), id_col, "shard", shards, "block", blocks)
    asked = dealt(searchable(queries, "query_id", "query_vector"), "query_id", "block", blocks, "shard", shards)

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        best = Running(b["query_id"].tolist(), n)
        out: list[pd.DataFrame] = []
        if len(a) and len(b):
            products = side.value.products(unit_rows(np.array(b["vector"].tolist(), np.float64)))
            for at in range(0, len(a), 4096):
                part = a.iloc[at : at + 4096]
                best.add(_approx(pa.array(part["code"].tolist(), pa.binary()), products), part[id_col].to_numpy())
            for query_id, held in zip(best.query_ids, best.held, strict=True):
                out.append(pd.DataFrame({"query_id": query_id, id_col: held[1], "approx": held[0]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query_id", id_col, "approx")})

    key = ["shard", "block"]
    return left.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(meet, schema)


def candidates(
    codes: DataFrame, queries: DataFrame, books: Codebooks, num_candidates: int = CANDIDATES, id_col: str = "doc_id",
    size: Size | None = None,
) -> DataFrame:
    """(query_id, id, approx): the ``num_candidates`` best rows of the code table for each query."""
    size = size or measure(queries.select("query_id", "query_vector"))
    tables = 1 + books.centroids.shape[0] * books.centroids.shape[1] // books.width  # a query's products against its vector
    if fits(codes.sparkSession, size, tables):
        found = _scan_codes(codes, queries, books, num_candidates, id_col)
    else:
        found = _meet_codes(codes, queries, books, num_candidates, id_col, size)
    order = [F.col("approx").desc(), F.col(id_col)]
    return top_k(found, "query_id", order, num_candidates, id_col).drop("rank")


def knn_quantized(
    docs: DataFrame, codes: DataFrame, queries: DataFrame, books: Codebooks, k: int = 10, num_candidates: int = CANDIDATES,
    id_col: str = "doc_id", vector: str = "vector", size: Size | None = None, clamped: bool = False,
) -> DataFrame:
    """(query_id, id, rank, cos, sim, score) of the k nearest among ``num_candidates`` of the code table.

    ``codes`` is ``docs`` coded (`encode`), filtered as wanted; of ``docs`` only the candidates' vectors are used, and
    they are not shuffled while the candidates fit a broadcast (measured). Ties are ordered by id;
    ``clamped`` cuts cosines to [0, 1] first.
    """
    if num_candidates < k:
        raise ValueError("num_candidates must be at least k")
    near = settle(candidates(codes, queries, books, num_candidates, id_col, size).select("query_id", id_col))
    wanted = near.select(id_col).distinct()
    vectors = docs.select(id_col, F.col(vector).alias("vector"))
    vectors = vectors.join(hint_if(wanted, fits(docs.sparkSession, measure(wanted))), id_col, "left_semi")
    asked = searchable(queries, "query_id", "query_vector").select("query_id", unit(as_double(F.col("vector"))).alias("q"))
    met = near.join(vectors, id_col).join(hint_if(asked, fits(docs.sparkSession, measure(asked))), "query_id")
    cos = keep(dot(unit(as_double(F.col("vector"))), F.col("q")))
    exact = met.select("query_id", id_col, (clamp01(cos) if clamped else cos).alias("cos"))
    best = top_k(exact, "query_id", [F.col("cos").desc(), F.col(id_col)], k, id_col)
    return best.withColumn("sim", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("cos")))).withColumn("score", (1 + F.col("cos")) / 2)
