"""Hybrid search as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata import constants as K
from strata.functions.text import strip
from strata.operators.fusion import blend_of, check_weights, fuse_best, fuse_rrf, fuse_weighted, fuse_weighted_scan
from strata.operators.hits import attach_documents, format_hits
from strata.operators.keyword_scan import bm25_top, keyword_matrix
from strata.operators.lexical import Index, bm25_match, by_document, chunks_only, has_vector, indexed_side, query_side
from strata.operators.neighbors import Cells, knn, top_k
from strata.operators.quantized import Codebooks, encode, knn_quantized, train_codebooks
from strata.operators.rerank import rerank_by_density, rerank_flag
from strata.sizing import Size, fits, hint_if, measure

_HIT_BYTES = 160  # one hit row without its text


@dataclass(frozen=True)
class SearchOptions:
    """The keyword arguments of one search; ``None`` for rerank means automatic."""

    mode: str = "weighted"  # or "rrf"
    k: int = K.SEARCH_K
    vector_weight: float = K.CLI_DEFAULTS["vector_weight"]
    keyword_weight: float = K.CLI_DEFAULTS["keyword_weight"]
    keyword_norm: str = "saturation"
    kw_sat: float = K.CLI_DEFAULTS["kw_sat"]
    kw_log_cap: float = K.KW_LOG_CAP
    rrf_window: int = K.RRF_WINDOW
    rrf_constant: int = K.RRF_CONSTANT
    name_rerank: bool | None = None
    rerank_pool: int = K.RERANK_POOL
    rerank_blend: float = K.RERANK_BLEND
    match_field: str = "text"
    analyzer: str = "standard"
    num_candidates: int | None = None  # budget of an approximate vector leg; None: exact

    def __post_init__(self) -> None:
        if self.mode not in ("weighted", "rrf"):
            raise ValueError("mode must be weighted or rrf")
        if min(self.k, self.rerank_pool, self.rrf_window) < 1:
            raise ValueError("k, rerank_pool and rrf_window must be at least 1")
        if self.mode == "weighted":
            check_weights(self.vector_weight, self.keyword_weight)


def checked_queries(queries: DataFrame) -> DataFrame:
    """Queries with a blank text fail the job that reads them."""
    message = F.concat(F.lit("blank query "), F.col("query_id").cast("string"))
    text = F.when(strip(F.col("query_text")) == "", F.raise_error(message).cast("string")).otherwise(
        F.col("query_text")
    )
    return queries.withColumn("query_text", text)


def _coded(chunks: DataFrame) -> tuple[DataFrame, Codebooks]:
    books = train_codebooks(has_vector(chunks))
    return encode(has_vector(chunks), books, keep_columns=("doc_kind",)), books


def hybrid_hits(
    corpus: DataFrame,
    queries: DataFrame,
    options: SearchOptions = SearchOptions(),
    synonyms: DataFrame | None = None,
    cells: Cells | None = None,
    partitioned: bool = False,
    index: Index | None = None,
    coded: tuple[DataFrame, Codebooks] | None = None,
) -> DataFrame:
    """(query_id, doc_id, rank, score, query_text, text, chapter_id, chunk_index).

    A small query table is scored where the documents are. For a large one,
    ``corpus`` rows are shuffled once by document unless ``partitioned`` says
    they already are (a table bucketed by ``doc_id``). Statistics cover the
    whole corpus (with ``index``, what a stored index holds; its texts are then not read for the
    keyword leg); with ``num_candidates`` the vector leg ranks as many rows of the code table
    ``coded`` (with ``doc_kind``; made on the spot if not given). Hits are chunks only, and need a vector in weighted mode.
    Per query, a reranked search fetches max(k, pool) hits, others ``k``.
    """
    o = options
    spark = corpus.sparkSession
    size = measure(queries)
    small = fits(spark, size)
    asked = checked_queries(queries).withColumn("_rerank", rerank_flag(F.col("query_text"), o.name_rerank))
    most = o.k if o.name_rerank is False else max(o.k, o.rerank_pool)
    fetch = F.when(F.col("_rerank"), max(o.k, o.rerank_pool)).otherwise(o.k)
    flags = asked.select("query_id", "query_text", "_rerank", fetch.alias("_fetch"))

    chunks = chunks_only(corpus)
    # A token row takes at most 40 times the bytes of its text; measured only when that may not fit.
    few_terms = True if synonyms is None and fits(spark, size, copies=40) else None
    text = {"field": o.match_field, "analyzer": o.analyzer}

    def nearest_chunks() -> DataFrame:
        clamped = o.mode == "weighted"
        if o.num_candidates is None:
            return knn(has_vector(chunks), queries, most, cells=cells, size=size, clamped=clamped)
        codes, books = coded or _coded(chunks)
        budget = max(most, o.num_candidates)
        return knn_quantized(
            has_vector(chunks), chunks_only(codes), queries, books, most, budget, size=size, clamped=clamped
        )

    if o.mode == "weighted":
        blend = (o.vector_weight, o.keyword_weight, o.keyword_norm, o.kw_sat, o.kw_log_cap)
        if index is not None:
            side, matrix = indexed_side(index, queries, o.analyzer, synonyms), None
        else:
            side = query_side(corpus, queries, **text, synonyms=synonyms, small=few_terms)
            matrix = keyword_matrix(side) if small and o.num_candidates is None else None
        if matrix is not None:
            fused = fuse_weighted_scan(matrix, has_vector(chunks), queries, most, *blend, **text)
        elif index is not None:
            scored = (has_vector(chunks), queries, blend_of(*blend))
            best = bm25_match(None, queries, side=side, index=index, best=most, blended=scored)
            fused = fuse_best(best, nearest_chunks(), most, o.vector_weight)
        else:
            docs = corpus if partitioned else by_document(corpus)
            eligible = has_vector(chunks_only(docs))
            matches = bm25_match(docs, queries, **text, synonyms=synonyms, among=eligible, side=side)
            fused = fuse_weighted(matches, nearest_chunks(), eligible, queries, most, small, *blend)
    else:
        window = max(o.rrf_window, most)
        if index is not None:
            found = bm25_match(None, queries, analyzer=o.analyzer, synonyms=synonyms, among=chunks, index=index, best=window)
            keyword = top_k(found, "query_id", [F.col("kw").desc(), F.col("doc_id")], window, "doc_id")
        else:
            keyword = bm25_top(
                corpus, queries, window, **text, synonyms=synonyms, small=few_terms, among=chunks
            )
        limits = hint_if(flags.select("query_id", "_fetch"), small)
        keyword = keyword.join(limits, "query_id").filter(
            F.col("rank") <= F.greatest(F.lit(o.rrf_window), F.col("_fetch"))
        )
        nearest = nearest_chunks().join(limits, "query_id").filter(F.col("rank") <= F.col("_fetch"))
        fused = fuse_rrf(keyword, nearest, most, o.rrf_constant)

    hits = fused.select("query_id", "doc_id", "rank", "score").join(hint_if(flags, small), "query_id")
    hits = hits.filter(F.col("rank") <= F.col("_fetch")).drop("_fetch")
    few = fits(spark, Size(size.rows * most, size.rows * most * _HIT_BYTES + size.bytes * most))
    columns = list(dict.fromkeys(["text", o.match_field, "chapter_id", "chunk_index"]))
    hits = attach_documents(hits, corpus, columns, few)
    field = o.match_field
    if hits.schema[field].dataType.typeName() == "array":
        field = "_shown"
        hits = hits.withColumn(field, F.array_join(o.match_field, " "))
    hits = rerank_by_density(hits, o.k, o.rerank_pool, o.rerank_blend, field, flag="_rerank")
    return hits.drop("_rerank", "_shown")


def hybrid_search(
    corpus: DataFrame,
    queries: DataFrame,
    options: SearchOptions = SearchOptions(),
    display_field: str = "text",
    **inputs,
) -> DataFrame:
    """D10 + D15: formatted hits of every query."""
    return format_hits(hybrid_hits(corpus, queries, options, **inputs), field=display_field)
