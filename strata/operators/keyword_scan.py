"""Keyword scores in place, for query sides that were measured to fit a broadcast.

Spark cuts the texts into tokens; a task looks a batch of token lists up among the
query terms, turns it into a matrix of term weights and multiplies that with the
(slot x query) matrix. So the documents are not shuffled, no row per (query,
document) is ever made, and only the top k per task and query leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields, replace
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strata import constants as K
from strata.operators.lexical import QuerySide, bm25_match, doc_tokens, query_side
from strata.operators.neighbors import MATRIX_CELLS, Running, found_schema, rounded, top_k
from strata.operators.term_scan import TermScan, token_slices

# Largest (slot x query) matrix a task holds; beyond it rows are joined instead.
SIDE_CELLS = 8_000_000


@dataclass(frozen=True)
class KeywordMatrix:
    query_ids: list
    weights: np.ndarray  # slots x queries
    terms: list[str]  # distinct terms of all slots
    first: np.ndarray  # per term: where its slots start in ``slots``
    count: np.ndarray  # per term: number of its slots
    slots: np.ndarray
    avgdl: float
    k1: float
    b: float

    @cached_property
    def scan(self) -> TermScan:
        return TermScan(self.terms)

    @property
    def most_rows(self) -> int:
        """Documents whose scores are computed at once."""
        return max(1, MATRIX_CELLS // max(1, *self.weights.shape))

    def shared(self) -> dict:
        """Plain fields for a broadcast: executors need not have this package to read them."""
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def for_queries(self, query_ids: list) -> KeywordMatrix:
        """The same slots with one column per given query (0 for unknown ones)."""
        weights = np.zeros((len(self.weights), len(query_ids)))
        place = pd.Index(query_ids).get_indexer(pd.Index(self.query_ids))
        weights[:, place[place >= 0]] = self.weights[:, place >= 0]
        return replace(self, query_ids=query_ids, weights=weights)

    def scores(self, tokens: pa.Array, dl: np.ndarray) -> np.ndarray:
        """BM25 of every list of terms (row) for every query (column), with the documents' lengths;
        0 where nothing matches."""
        n, n_slots = len(tokens), len(self.weights)
        row, term = self.scan.occurrences(tokens)
        copies = self.count[term]
        inside = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        slot = self.slots[np.repeat(self.first[term], copies) + inside]
        key = np.repeat(row, copies) * n_slots + slot
        if n * n_slots <= MATRIX_CELLS:
            counts = np.bincount(key, minlength=n * n_slots)
            key = np.flatnonzero(counts)
            tf = counts[key]
        else:
            key, tf = np.unique(key, return_counts=True)
        at, slot = key // n_slots, key % n_slots
        used, column = np.unique(slot, return_inverse=True)
        part = np.zeros((n, len(used)))
        part[at, column] = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl[at] / self.avgdl))
        return part @ self.weights[used]


def keyword_matrix(side: QuerySide, k1: float = K.BM25_K1, b: float = K.BM25_B) -> KeywordMatrix | None:
    """The query side as a matrix; None when it is too large for one, or empty."""
    if not side.small:
        return None
    rows = side.weighed.collect()  # measured
    slots = {s: i for i, s in enumerate(sorted({r["slot"] for r in rows}))}
    ids = {q: j for j, q in enumerate(sorted({r["query_id"] for r in rows}))}
    if not rows or len(slots) * len(ids) > SIDE_CELLS:
        return None
    weights = np.zeros((len(slots), len(ids)))
    for r in rows:
        weights[slots[r["slot"]], ids[r["query_id"]]] = r["weight"]
    if side.plain:
        pairs = [(s, i) for s, i in slots.items()]
    else:
        pairs = sorted((r["term"], slots[r["slot"]]) for r in side.members.collect() if r["slot"] in slots)
    terms, first, count = np.unique([t for t, _ in pairs], return_index=True, return_counts=True)
    return KeywordMatrix(
        list(ids), weights, terms.tolist(), first, count, np.array([i for _, i in pairs]), rows[0]["avgdl"], k1, b
    )


def bm25_top(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    k1: float = K.BM25_K1,
    b: float = K.BM25_B,
    field: str = "text",
    analyzer: str = "standard",
    synonyms: DataFrame | None = None,
    small: bool | None = None,
    among: DataFrame | None = None,
    side: QuerySide | None = None,
) -> DataFrame:
    """(query_id, doc_id, rank, kw): the ``k`` best keyword hits of each query.

    The same rows as ranking :func:`bm25_match`, which is the way of large query
    tables; small ones are scored in place.
    """
    side = side or query_side(docs, queries, field, analyzer, synonyms, small)
    matrix = keyword_matrix(side, k1, b)
    if matrix is None:
        found = bm25_match(docs, queries, k1, b, field, analyzer, synonyms, among=among, side=side, best=k)
    else:
        schema = found_schema(queries, docs, "doc_id", "kw")
        arrow = to_arrow_schema(schema)
        shared = docs.sparkSession.sparkContext.broadcast(matrix.shared())

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = KeywordMatrix(**shared.value)
            best = Running(m.query_ids, k)
            for batch in batches:
                for part in token_slices(batch, "toks", m.most_rows):
                    ids, toks, dl = part.columns
                    kw = m.scores(toks, dl.to_numpy())
                    kept = np.where(kw > 0, rounded(kw), -np.inf)
                    best.add(kept, ids.to_numpy(zero_copy_only=False))
            yield from best.batches(arrow)

        scored = doc_tokens(docs if among is None else among, field, analyzer)
        found = scored.select("doc_id", "toks", F.greatest("dl", F.lit(0)).alias("dl")).mapInArrow(search, schema)
    return top_k(found, "query_id", [F.col("kw").desc(), F.col("doc_id")], k, "doc_id")


def match_totals(
    docs: DataFrame,
    queries: DataFrame,
    field: str = "text",
    analyzer: str = "standard",
    synonyms: DataFrame | None = None,
    small: bool | None = None,
    among: DataFrame | None = None,
    side: QuerySide | None = None,
) -> DataFrame:
    """(query_id, total): how many documents share a term with each query.

    In place for small query tables: a task counts and gives one row per query, no row per
    (query, document) is made.
    """
    side = side or query_side(docs, queries, field, analyzer, synonyms, small)
    matrix = keyword_matrix(side)
    if matrix is None:
        found = bm25_match(docs, queries, field=field, analyzer=analyzer, synonyms=synonyms, among=among, side=side)
        return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    shared = docs.sparkSession.sparkContext.broadcast(matrix.shared())
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("total", T.LongType())])
    arrow = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = KeywordMatrix(**shared.value)
        total = np.zeros(len(m.query_ids), np.int64)
        for batch in batches:
            for part in token_slices(batch, "toks", m.most_rows):
                toks, dl = part.columns
                total += (m.scores(toks, dl.to_numpy()) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(m.query_ids, arrow[0].type), pa.array(total, arrow[1].type)], schema=arrow)

    scored = doc_tokens(docs if among is None else among, field, analyzer)
    counted = scored.select("toks", F.greatest("dl", F.lit(0)).alias("dl")).mapInArrow(count, schema)
    return counted.groupBy("query_id").agg(F.sum("total").alias("total"))
