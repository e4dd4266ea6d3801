"""Fusion of the keyword leg and the vector leg."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strata import constants as K
from strata.functions.score import normalize_keyword
from strata.functions.vector import clamp01, dot, keep, unit
from strata.operators.keyword_scan import KeywordMatrix
from strata.operators.lexical import doc_tokens
from strata.operators.neighbors import (
    Running,
    cosines,
    found_schema,
    of_width,
    query_matrix,
    rounded,
    stack,
    top_k,
    unit_rows,
)
from strata.operators.term_scan import token_slices
from strata.sizing import hint_if


def check_weights(vector_weight: float, keyword_weight: float) -> None:
    if vector_weight < 0 or keyword_weight < 0:
        raise ValueError("weights must not be negative")
    if vector_weight + keyword_weight <= 0:
        raise ValueError("one weight must be positive")


def similarity_of(pairs: DataFrame, docs: DataFrame, queries: DataFrame, small: bool) -> DataFrame:
    """Cosine, cut to [0, 1], for given (query_id, doc_id) pairs.

    Pairs whose document has no vector (or is not in ``docs``) drop out. On
    inputs partitioned by document the join moves nothing.
    """
    vectors = docs.select("doc_id", unit(F.col("vector")).alias("u")).filter("u is not null")
    asked = queries.select("query_id", unit(F.col("query_vector")).alias("q")).filter("q is not null")
    met = pairs.join(vectors, "doc_id").join(hint_if(asked, small), "query_id")
    return met.withColumn("sim", clamp01(keep(dot(F.col("u"), F.col("q"))))).drop("u", "q")


def fuse_weighted(
    matches: DataFrame,
    nearest: DataFrame,
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    small: bool,
    vector_weight: float = K.CLI_DEFAULTS["vector_weight"],
    keyword_weight: float = K.CLI_DEFAULTS["keyword_weight"],
    mode: str = "saturation",
    kw_sat: float = K.CLI_DEFAULTS["kw_sat"],
    kw_log_cap: float = K.KW_LOG_CAP,
) -> DataFrame:
    """Top ``k`` of w_vec * sim + w_kw * norm(kw) over all ``docs``.

    ``matches`` (query_id, doc_id, kw) are the keyword hits, ``nearest``
    (query_id, doc_id, sim) the k nearest documents by cut cosine. With weights
    that are not negative a document in neither set is behind k others, so the
    two sets together hold the exact answer.
    """
    check_weights(vector_weight, keyword_weight)
    order = [F.col("score").desc(), F.col("doc_id")]
    kw_norm = normalize_keyword(F.col("kw"), mode, kw_sat, kw_log_cap)
    score = vector_weight * F.col("sim") + keyword_weight * kw_norm
    columns = ["query_id", "doc_id", "sim", "kw", "score"]
    # Cut the keyword hits to k per query where they are; only then mix in the
    # neighbours. A neighbour that is also a keyword hit scores at least as much there.
    scored = similarity_of(matches, docs, queries, small).withColumn("score", score)
    scored = top_k(scored.select(*columns), "query_id", order, k, "doc_id").drop("rank")
    alone = nearest.withColumn("kw", F.lit(0.0)).withColumn("score", score).select(*columns)
    both = scored.unionByName(alone).groupBy("query_id", "doc_id").agg(
        F.max("sim").alias("sim"), F.max("kw").alias("kw"), F.max("score").alias("score")
    )
    return top_k(both, "query_id", order, k, "doc_id")


def fuse_best(
    best: DataFrame,
    nearest: DataFrame,
    k: int,
    vector_weight: float = K.CLI_DEFAULTS["vector_weight"],
) -> DataFrame:
    """`fuse_weighted` where tasks have scored the keyword hits: ``best`` (query_id, doc_id, score) holds the ``k`` first at least."""
    order = [F.col("score").desc(), F.col("doc_id")]
    scored = top_k(best, "query_id", order, k, "doc_id").drop("rank")
    alone = nearest.select("query_id", "doc_id", (vector_weight * F.col("sim")).alias("score"))
    both = scored.unionByName(alone).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return top_k(both, "query_id", order, k, "doc_id")


def blend_of(vector_weight: float, keyword_weight: float, mode: str, kw_sat: float, kw_log_cap: float) -> Callable:
    """The weighted score of arrays of cosines and keyword scores, as tasks compute it."""
    check_weights(vector_weight, keyword_weight)
    normalize_keyword(F.lit(0.0), mode, kw_sat, kw_log_cap)  # checks the parameters
    scale = {
        "raw": lambda kw: kw,
        "saturation": lambda kw: kw / (kw + kw_sat),
        "log1p": lambda kw: np.minimum(1.0, rounded(np.log1p(kw)) / kw_log_cap),
    }[mode]
    return lambda sim, kw: vector_weight * sim + keyword_weight * scale(kw)


def fuse_weighted_scan(
    matrix: KeywordMatrix,
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    vector_weight: float = K.CLI_DEFAULTS["vector_weight"],
    keyword_weight: float = K.CLI_DEFAULTS["keyword_weight"],
    mode: str = "saturation",
    kw_sat: float = K.CLI_DEFAULTS["kw_sat"],
    kw_log_cap: float = K.KW_LOG_CAP,
    field: str = "text",
    analyzer: str = "standard",
) -> DataFrame:
    """D8 as it is defined, for a query table that fits a broadcast: every document
    with a vector is scored for every query, in place.

    A task turns a batch of vectors and token lists into two matrices of scores and
    keeps a running top ``k`` per query; the documents are not shuffled.
    """
    blend = blend_of(vector_weight, keyword_weight, mode, kw_sat, kw_log_cap)
    schema = found_schema(queries, docs, "doc_id", "score")
    arrow = to_arrow_schema(schema)
    asked = query_matrix(queries)
    if asked is None:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast((*asked, matrix.for_queries(asked[0]).shared()))
    found = doc_tokens(of_width(docs, "vector", asked[1].shape[1]), field, analyzer, (), "vector")
    rows = found.filter(F.exists("vector", lambda x: x != 0)).select(
        "doc_id", "vector", "toks", F.greatest("dl", F.lit(0)).alias("dl")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q, fields = shared.value
        m = KeywordMatrix(**fields)
        best = Running(query_ids, k)
        for batch in batches:
            for part in token_slices(batch, "toks", m.most_rows):
                ids, vectors, toks, dl = part.columns
                kw = np.maximum(0.0, rounded(m.scores(toks, dl.to_numpy())))
                sim = cosines(unit_rows(stack(vectors)), q, True)
                best.add(blend(sim, kw), ids.to_numpy(zero_copy_only=False))
        yield from best.batches(arrow)

    found = rows.mapInArrow(search, schema)
    return top_k(found, "query_id", [F.col("score").desc(), F.col("doc_id")], k, "doc_id")


def fuse_rrf(keyword: DataFrame, nearest: DataFrame, k: int, constant: int = K.RRF_CONSTANT) -> DataFrame:
    """Reciprocal ranks summed over two ranked legs, top ``k``.

    Both legs are (query_id, doc_id, rank), already cut to their windows.
    """
    columns = ["query_id", "doc_id", "rank"]
    legs = keyword.select(*columns).unionByName(nearest.select(*columns))
    fused = legs.groupBy("query_id", "doc_id").agg(
        F.sum(1.0 / (constant + F.col("rank"))).alias("score")
    )
    return top_k(fused, "query_id", [F.col("score").desc(), F.col("doc_id")], k, "doc_id")
