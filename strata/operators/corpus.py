"""Corpus table operators: upsert, merge of kinds, counts, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata import constants as K
from strata.functions.text import present


def latest_per_id(log: DataFrame, order: tuple[str, ...] = ("batch", "pos")) -> DataFrame:
    """The row written last for every ``doc_id``.

    An aggregate, not a window: each map task keeps one row per id before the
    shuffle, so an id that was written very often costs one row per task.
    """
    keep = [c for c in log.columns if c != "doc_id" and c not in order]
    last = F.max_by(F.struct(*keep), F.struct(*order)).alias("row")
    return log.groupBy("doc_id").agg(last).select("doc_id", "row.*")


def upsert_corpus(
    stored: DataFrame | None, batches: DataFrame, recreate: bool = False
) -> DataFrame:
    """Stored rows overlaid with ``batches`` (``batch``, ``pos`` give the order)."""
    if recreate or stored is None:
        return latest_per_id(batches)
    old = stored.withColumn("batch", F.lit(-1).cast("long")).withColumn("pos", F.lit(0).cast("long"))
    new = batches.withColumn("batch", F.col("batch").cast("long")).withColumn(
        "pos", F.col("pos").cast("long")
    )
    return latest_per_id(old.unionByName(new, allowMissingColumns=True))


def kind_or_chunk() -> Column:
    return F.coalesce(F.col("doc_kind"), F.lit(K.KIND_CHUNK))


def merge_doc_kinds(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Append chapter summaries; an absent kind is written as ``chunk``."""
    for name, df in (("chunks", chunks), ("summaries", summaries)):
        if "chapter_id" not in df.columns:
            raise ValueError(f"{name} need the chunk fields (chapter_id, chunk_index, ...)")
    if "doc_kind" not in chunks.columns:
        chunks = chunks.withColumn("doc_kind", F.lit(None).cast("string"))
    return chunks.unionByName(summaries, allowMissingColumns=True).withColumn(
        "doc_kind", kind_or_chunk()
    )


def count_by_kind(corpus: DataFrame) -> DataFrame:
    """Rows that are summaries against all others (absent kind = chunk)."""
    kind = F.when(kind_or_chunk() == K.KIND_SUMMARY, K.KIND_SUMMARY).otherwise(K.KIND_CHUNK)
    return corpus.groupBy(kind.alias("doc_kind")).agg(F.count(F.lit(1)).alias("n_docs"))


def validate_corpus(corpus: DataFrame) -> DataFrame:
    """One pass of counts: rows, rows without text, rows with a blank id."""
    return corpus.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(~present(F.col("text"))).alias("n_without_text"),
        F.count_if(F.col("doc_id").isNotNull() & ~present(F.col("doc_id"))).alias("n_blank_id"),
    )


def require_valid(corpus: DataFrame) -> int:
    """A9 strict: number of documents, or an error when a rule is broken."""
    row = validate_corpus(corpus).first()
    if row["n_without_text"] or row["n_blank_id"]:
        raise ValueError(f"invalid corpus: {row.asDict()}")
    return row["n_docs"]


def vector_dims(df: DataFrame, column: str = "vector") -> DataFrame:
    """A10: how many rows carry which vector width (null = no vector)."""
    width = F.when(F.col(column).isNotNull(), F.size(column))
    return df.groupBy(width.alias("dims")).agg(F.count(F.lit(1)).alias("n_rows"))


def check_vector_dims(df: DataFrame, dims: int, column: str = "vector") -> DataFrame:
    """A10 strict: the same rows; the job fails at a vector of another width."""
    wrong = F.col(column).isNotNull() & (F.size(column) != dims)
    message = F.concat(F.lit(f"{column}: expected {dims} dims, found "), F.size(column).cast("string"))
    kind = df.schema[column].dataType
    return df.withColumn(
        column, F.when(wrong, F.raise_error(message).cast(kind)).otherwise(F.col(column))
    )


def same_dims(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """A10: widths present on the query side and not on the corpus side (empty = fine)."""
    stored = vector_dims(corpus, "vector").filter("dims is not null")
    asked = vector_dims(queries, "query_vector").filter("dims is not null")
    return asked.join(stored, "dims", "left_anti")
