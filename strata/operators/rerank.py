"""Second stage by term density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata import constants as K
from strata.functions.score import auto_rerank, term_density
from strata.functions.text import strip


def rerank_flag(query: Column, explicit: bool | None = None) -> Column:
    """An explicit setting wins, else short queries are reranked."""
    return auto_rerank(query) if explicit is None else F.lit(explicit)


def rerank_by_density(
    hits: DataFrame,
    k: int,
    pool: int = K.RERANK_POOL,
    blend: float = K.RERANK_BLEND,
    field: str = "text",
    flag: str | None = None,
) -> DataFrame:
    """Hits (query_id, query_text, doc_id, rank, score, <field>) -> top ``k``.

    The first max(k, pool) hits take part; the new score replaces the old one
    and the old rank breaks ties. Where the column ``flag`` is false, and for
    blank queries, hits keep score and order. Hits per query are bounded by the
    search that made them, so one window per query is small.
    """
    density = term_density(F.col("query_text"), F.coalesce(F.col(field), F.lit("")))
    base = F.coalesce(F.col("score"), F.lit(0.0))
    combined = F.when(base > 0, base * (1 + blend * density)).otherwise(density)
    active = strip(F.col("query_text")) != ""
    if flag is not None:
        active = active & F.col(flag)
    pooled = hits.filter(F.col("rank") <= max(k, pool)).withColumn("_active", active)
    pooled = pooled.withColumn("score", F.when(F.col("_active"), combined).otherwise(F.col("score")))
    order = Window.partitionBy("query_id").orderBy(
        F.when(F.col("_active"), F.col("score")).desc(), F.col("rank")
    )
    return (
        pooled.withColumn("_new", F.row_number().over(order))
        .filter(F.col("_new") <= k)
        .withColumn("rank", F.col("_new"))
        .drop("_new", "_active")
    )
