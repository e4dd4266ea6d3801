"""Operator inputs derived from the given tables (whole tables, whole texts).

A chapter is a run of 20 documents, so chapters grow in number with the data,
not in size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.text import tokens
from strata.operators.corpus import merge_doc_kinds
from strata.operators.summaries import summary_rows
from strata.sizing import widen

CHAPTER_DOCS = 20
ENDS = ".!?"
TITLE = r"([^\n.!?]{1,60}[.!?])"


_WIDE = {"documents": "doc_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return widen(df, _WIDE[name]) if name in _WIDE else df


def chapter_of(doc_id):
    return F.format_string("chapter_%04d", F.floor(doc_id / CHAPTER_DOCS) + 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: ``doc_kind`` null for odd ids, ``chunk`` for even ones."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        "text",
        chapter_of(F.col("doc_id")).alias("chapter_id"),
        (F.col("doc_id") % CHAPTER_DOCS).cast("int").alias("chunk_index"),
        F.when(F.col("doc_id") % 2 == 0, "chunk").alias("doc_kind"),
        F.lit(None).cast("string").alias("chapter_title"),
    )


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins for written summaries: the first answer of conversation n belongs to
    chapter 2n; every third one has a title of its own."""
    turns = table(spark, sf_dir, "conversations").filter("turn = 1")
    rows = turns.select(
        F.format_string("chapter_%04d", F.col("conv_id") * 2).alias("chapter_id"),
        F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Part "), F.col("conv_id").cast("string"))).alias("title"),
        F.col("text").alias("summary"),
    )
    return summary_rows(rows)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("doc_id"), F.col("embedding").alias("vector"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and summaries; vectors where the embeddings table has the id."""
    rows = documents(spark, sf_dir).unionByName(summaries(spark, sf_dir), allowMissingColumns=True)
    return rows.join(vectors(spark, sf_dir), "doc_id", "left")


def merged_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_doc_kinds(documents(spark, sf_dir), summaries(spark, sf_dir))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with the vector of the same number, if there is one."""
    b = table(spark, sf_dir, "benchmark")
    e = table(spark, sf_dir, "embeddings")
    return b.join(e, b.item_id == e.vec_id, "left").select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("query_text"),
        F.col("embedding").alias("query_vector"),
    )


def short_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last token of each benchmark item: some short enough for automatic reranking."""
    q = queries(spark, sf_dir)
    last = F.element_at(tokens(F.col("query_text")), F.lit(-1))
    return q.select("query_id", last.alias("query_text"), "query_vector")


def chat_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user turn of each conversation."""
    users = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return users.groupBy(F.col("conv_id").alias("query_id")).agg(
        F.max_by("text", "turn").alias("query_text")
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a raw book: before each third line a heading, before each
    fifth a section header and after each seventh an end line are put in."""
    d = table(spark, sf_dir, "documents")
    put = lambda cond, text: F.when(cond, text).otherwise(F.lit(""))
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(
            put(i % 3 == 2, F.concat(F.lit("正文 "), i.cast("string"), F.lit("\n"))),
            put(i % 5 == 1, F.concat(F.lit("分节阅读 "), i.cast("string"), F.lit("\n"))),
            line,
            put(i % 7 == 6, F.lit("\n------------")),
        ),
    )
    return d.select(F.col("doc_id").alias("book_id"), F.array_join(lines, "\n").alias("text"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name list from the data: the last token of each benchmark item."""
    last = F.element_at(tokens(F.col("text")), F.lit(-1))
    return table(spark, sf_dir, "benchmark").select(last.alias("character")).filter(
        F.length("character") >= 2
    ).distinct()


def synonym_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per benchmark item: its first two tokens are equivalent; every fifth
    rule is one-way, and every third one sets the first two, as one term, against the third."""
    t = tokens(F.col("text"))
    b = table(spark, sf_dir, "benchmark")
    arrow = F.when(F.col("item_id") % 5 == 0, " => ").otherwise(", ")
    pair = F.concat(F.get(t, F.lit(0)), arrow, F.get(t, F.lit(1)))
    run = F.concat(F.get(t, F.lit(0)), F.lit(" "), F.get(t, F.lit(1)), arrow, F.get(t, F.lit(2)))
    return b.select(
        F.col("item_id").alias("rule_id"), F.coalesce(F.when(F.col("item_id") % 3 == 0, run), pair).alias("line")
    )


def word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, vector): every token of the benchmark with one of the given vectors, by its hash."""
    e = table(spark, sf_dir, "embeddings")
    t = table(spark, sf_dir, "benchmark").select(F.explode(tokens(F.col("text"))).alias("word")).distinct()
    hashed = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long")
    numbered = t.select("word", (hashed % F.lit(max(1, e.count()))).alias("vec_id"))
    return numbered.join(e, "vec_id").select("word", F.col("embedding").alias("vector"))
