"""Hit lists (D15, D16, D19). A hit list holds at most the searched ``k`` rows per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata import constants as K
from strata.functions.text import null_if_blank
from strata.sizing import hint_if

HIT_COLUMNS = ["query_id", "doc_id", "rank", "score", "text", "text_truncated", "chapter_id", "chunk_index"]


def attach_documents(hits: DataFrame, corpus: DataFrame, columns: list[str], small: bool) -> DataFrame:
    """Bring document columns to the hits; a small hit list goes to the documents,
    so that the texts of the corpus are not shuffled for a few rows."""
    docs = corpus.select("doc_id", *[c for c in columns if c in corpus.columns])
    for name, kind in (("chapter_id", "string"), ("chunk_index", "int")):
        if name in columns and name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    return docs.join(hint_if(hits, small), "doc_id")


def _score_order():
    return [F.coalesce(F.col("score"), F.lit(0.0)).desc(), F.col("rank")]


def format_hits(hits: DataFrame, max_text: int = K.HIT_TEXT_CHARS, field: str = "text") -> DataFrame:
    """Text cut with a flag, order by score (null = 0, old rank breaks ties), new ranks."""
    shown = F.coalesce(F.col(field), F.lit(""))
    order = Window.partitionBy("query_id").orderBy(*_score_order())
    return (
        hits.withColumn("_rank", F.row_number().over(order))
        .withColumn("text_truncated", F.length(shown) > max_text)
        .withColumn("text", F.left(shown, F.lit(max_text)))
        .withColumn("rank", F.col("_rank"))
        .select(*HIT_COLUMNS)
    )


def hit_counts(queries: DataFrame, total: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, total, returned) for every query, also for those without hits.
    ``total`` (query_id, total) comes from ``match_totals``."""
    returned = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"))
    return (
        queries.select("query_id")
        .join(total, "query_id", "left")
        .join(returned, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("returned", F.lit(0)).alias("returned"),
        )
    )


def collapse_by_chapter(hits: DataFrame) -> DataFrame:
    """The best hit per chapter (the earlier one wins ties) with ``merged_from``;
    hits without chapter stay alone; new ranks.

    Hits of one chapter are merged by an aggregate, map-side first. Among equal
    scores, chapters come in order of their first hit, then hits without one.
    """
    named = null_if_blank(F.col("chapter_id")).isNotNull()
    key = F.when(named, F.concat(F.lit("c"), F.col("chapter_id"))).otherwise(
        F.concat(F.lit("d"), F.col("rank").cast("string"))
    )
    keep = [c for c in hits.columns if c != "query_id"]
    score = F.coalesce(F.col("score"), F.lit(0.0))
    best = (
        hits.withColumn("_key", key)
        .withColumn("_named", named)
        .groupBy("query_id", "_key", "_named")
        .agg(
            F.max_by(F.struct(*keep), F.struct(score, -F.col("rank"))).alias("h"),
            F.count(F.lit(1)).alias("merged_from"),
            F.min("rank").alias("_first"),
        )
    )
    flat = best.select("query_id", "h.*", "merged_from", "_first", "_named")
    order = Window.partitionBy("query_id").orderBy(score.desc(), F.col("_named").desc(), "_first")
    return flat.withColumn("rank", F.row_number().over(order)).drop("_first", "_named")


def collapse_report(hits: DataFrame, collapsed: DataFrame) -> DataFrame:
    """(query_id, raw_count, deduped_count, removed_count)."""
    raw = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("raw_count"))
    kept = collapsed.groupBy("query_id").agg(F.count(F.lit(1)).alias("deduped_count"))
    return raw.join(kept, "query_id").withColumn(
        "removed_count", F.col("raw_count") - F.col("deduped_count")
    )


def enrich_hits(hits: DataFrame, chapters: DataFrame) -> DataFrame:
    """Every hit with its chapter as a struct (null where there is none)."""
    fields = [c for c in chapters.columns if c != "chapter_id"]
    packed = chapters.select(
        F.col("chapter_id").alias("_chapter"),
        F.struct(F.col("chapter_id"), *fields).alias("chapter"),
    )
    key = null_if_blank(F.col("chapter_id"))
    return hits.join(packed, key == F.col("_chapter"), "left").drop("_chapter")


def wanted_chapters(hits: DataFrame) -> DataFrame:
    """Distinct chapters of a hit list."""
    key = null_if_blank(F.col("chapter_id"))
    return hits.select(key.alias("chapter_id")).filter("chapter_id is not null").distinct()
