"""Chapter summaries: what is still to write, and the finished rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata import constants as K
from strata.functions import text as X
from strata.operators.prepare import chapter_base_id


def summary_prompt(chapter_id: Column, title: Column, text: Column, target_chars: int) -> Column:
    body = F.when(
        F.length(text) > K.SUMMARY_INPUT_CHARS,
        F.concat(F.left(text, F.lit(K.SUMMARY_INPUT_CHARS)), F.lit(K.SUMMARY_INPUT_CUT)),
    ).otherwise(text)
    return F.concat(
        F.lit("章节 ID："), chapter_id, F.lit("\n章节标题："),
        F.when(title != "", title).otherwise(K.SUMMARY_UNKNOWN_TITLE),
        F.lit("\n\n## 该回原文\n\n"), body,
        F.lit(f"\n\n请写 {target_chars} 字以内的章回摘要。"),
    )


def summary_worklist(
    chapters: DataFrame, done: DataFrame | None = None, target_chars: int = K.SUMMARY_TARGET_CHARS
) -> DataFrame:
    """(chapter_id, title, messages) for chapters without a summary yet."""
    ordinal = F.col("ordinal") if "ordinal" in chapters.columns else F.lit(None).cast("int")
    text = X.strip(F.col("text"))
    rows = chapters.select(
        chapter_base_id(F.col("doc_id"), ordinal).alias("chapter_id"), text.alias("text")
    )
    if done is not None:
        finished = done.select(X.null_if_blank(F.col("chapter_id")).alias("chapter_id"))
        rows = rows.join(finished, "chapter_id", "left_anti")
    rows = rows.withColumn("title", X.chapter_title(F.col("text")))
    user = summary_prompt(F.col("chapter_id"), F.col("title"), F.col("text"), max(100, target_chars))
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(K.SUMMARY_SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
    return rows.select("chapter_id", "title", messages.alias("messages"))


def summary_rows(finished: DataFrame) -> DataFrame:
    """(chapter_id, title, summary) -> corpus rows; blank summaries are dropped."""
    return finished.filter(X.present(F.col("summary"))).select(
        F.concat("chapter_id", F.lit("_summary")).alias("doc_id"),
        X.strip(F.col("summary")).alias("text"),
        "chapter_id",
        F.lit(K.KIND_SUMMARY).alias("doc_kind"),
        F.col("title").alias("chapter_title"),
        F.lit(K.SUMMARY_CHUNK_INDEX).alias("chunk_index"),
    )
