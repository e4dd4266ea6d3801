"""Chapters put together from chunk rows, and chapter summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata import constants as K
from strata.functions import text as X
from strata.operators.lexical import chunks_only, summaries_only
from strata.storage import settle

# A chapter heavier than this comes in several rows ("volumes").
VOLUME_CHARS = 16_000_000
# A row that shows a chapter holds this much of its text at least.
ROW_CHARS = 64_000_000
_ROW_CHARS = 64  # weight of a row besides its text
_INDEX_BLOCK = 1024


def _parts(corpus: DataFrame, wanted: DataFrame | None) -> DataFrame:
    parts = chunks_only(corpus).select(
        X.null_if_blank(F.col("chapter_id")).alias("chapter_id"),
        F.col("chunk_index").cast("long").alias("chunk_index"),
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
    ).filter("chapter_id is not null")
    return parts if wanted is None else parts.join(wanted, "chapter_id", "left_semi")


def _one_row(parts: DataFrame) -> DataFrame:
    """Chapters of bounded weight: order, join and title inside one row.

    A part without index takes its arrival position, counted after the indexed
    parts; equal positions keep arrival order.
    """
    arrived = F.array_sort(
        F.collect_list(
            F.struct(F.col("chunk_index").isNull().alias("late"), "chunk_index", "doc_id", "text")
        )
    )
    placed = F.array_sort(
        F.transform(
            "arrived",
            lambda p, i: F.struct(
                F.coalesce(p["chunk_index"], i.cast("long")).alias("at"), i.alias("i"), p["text"].alias("text")
            ),
        )
    )
    texts = F.filter(F.transform(placed, lambda p: p["text"]), lambda t: t != "")
    return (
        parts.groupBy("chapter_id")
        .agg(arrived.alias("arrived"))
        .select("chapter_id", texts.alias("texts"))
        .select(
            "chapter_id",
            X.chapter_title(F.get("texts", F.lit(0))).alias("title"),
            X.strip(F.array_join("texts", "\n")).alias("full_text"),
            F.size("texts").cast("long").alias("chunk_count"),
            F.lit(0).alias("volume"),
            F.lit(1).cast("long").alias("volumes"),
        )
    )


def _in_volumes(parts: DataFrame, heavy: DataFrame, volume_chars: int) -> DataFrame:
    """Heavy chapters, cut into volumes without gathering a chapter in one task.

    Parts are counted per block of positions (and, for parts without index, per
    hash block of their id); running totals over the small block tables give
    every part its position and every block its volume.
    """
    rows = parts.join(heavy.select("chapter_id", "n_indexed"), "chapter_id")
    digest = F.md5("doc_id")
    late = rows.filter("chunk_index is null").withColumn("digest", digest).withColumn(
        "part", F.substring("digest", 1, 3)
    )
    earlier = Window.partitionBy("chapter_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        late.groupBy("chapter_id", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("chapter_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("chapter_id", "part").orderBy("digest", "doc_id")
    late = (
        late.join(bases, ["chapter_id", "part"])
        .withColumn("at", F.col("n_indexed") + F.col("base") + F.row_number().over(within) - 1)
        .select("chapter_id", "at", F.lit(True).alias("late"), "doc_id", "text")
    )
    known = rows.filter("chunk_index is not null").select(
        "chapter_id", F.col("chunk_index").alias("at"), F.lit(False).alias("late"), "doc_id", "text"
    )
    placed = known.unionByName(late).withColumn("block", F.floor(F.col("at") / _INDEX_BLOCK))
    running = Window.partitionBy("chapter_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        placed.groupBy("chapter_id", "block")
        .agg(F.sum(F.length("text") + _ROW_CHARS).alias("weight"))
        .select(
            "chapter_id",
            "block",
            F.floor(F.coalesce(F.sum("weight").over(running), F.lit(0)) / volume_chars).alias("volume"),
        )
    )
    texts = F.filter(
        F.transform(
            F.array_sort(F.collect_list(F.struct("at", "late", "doc_id", "text"))), lambda p: p["text"]
        ),
        lambda t: t != "",
    )
    chapter = Window.partitionBy("chapter_id")
    in_order = chapter.orderBy("volume")
    volumes = (
        placed.join(blocks, ["chapter_id", "block"])
        .groupBy("chapter_id", "volume")
        .agg(texts.alias("texts"))
        .filter(F.size("texts") > 0)
    )
    ws = F.lit(K.WHITESPACE)
    joined = F.array_join("texts", "\n")
    return volumes.select(
        "chapter_id",
        F.first(X.chapter_title(F.get("texts", F.lit(0)))).over(in_order).alias("title"),
        joined.alias("full_text"),
        F.sum(F.size("texts")).over(chapter).alias("chunk_count"),
        (F.row_number().over(in_order) - 1).alias("volume"),
        F.count(F.lit(1)).over(chapter).alias("volumes"),
    ).withColumn(
        "full_text", F.when(F.col("volume") == 0, F.ltrim(F.col("full_text"), ws)).otherwise(F.col("full_text"))
    ).withColumn(
        "full_text",
        F.when(F.col("volume") == F.col("volumes") - 1, F.rtrim(F.col("full_text"), ws)).otherwise(F.col("full_text")),
    )


def assemble_chapters(
    corpus: DataFrame, wanted: DataFrame | None = None, volume_chars: int = VOLUME_CHARS
) -> DataFrame:
    """(chapter_id, chapter_number, title, full_text, chunk_count, volume, volumes).

    One row per chapter with all its parts in order. A chapter beyond
    ``volume_chars`` comes as consecutive volumes; joined by a line feed they
    are the whole text. ``wanted`` (chapter_id) restricts the chapters.

    The weights of the chapters are measured first; only when one is too heavy
    are such chapters taken out and assembled in pieces.
    """
    parts = _parts(corpus, wanted)
    weights = parts.groupBy("chapter_id").agg(
        F.sum(F.length("text") + _ROW_CHARS).alias("weight"), F.count("chunk_index").alias("n_indexed")
    )
    most = weights.agg(F.max("weight")).first()[0]
    if most is None or most <= volume_chars:
        rows = _one_row(parts)
    else:
        heavy = settle(weights.filter(F.col("weight") > volume_chars))
        light = parts.join(heavy, "chapter_id", "left_anti")
        rows = _one_row(light).unionByName(_in_volumes(parts, heavy, volume_chars))
    return rows.select(
        "chapter_id",
        X.chapter_number(F.col("chapter_id")).alias("chapter_number"),
        "title",
        "full_text",
        "chunk_count",
        "volume",
        "volumes",
    )


def whole_chapters(chapters: DataFrame, row_chars: int = ROW_CHARS) -> DataFrame:
    """One row per chapter: its volumes joined, with ``total_chars`` of the whole text.

    A row holds at least ``row_chars`` characters of a longer chapter (rows cannot grow
    without bound); the rest stays in the volumes of ``chapters``. Places come from the
    lengths alone, so only volumes that a row holds are moved.
    """
    sized = chapters.select("chapter_id", "volume", F.length("full_text").cast("long").alias("n")).filter("volume >= 0")
    total = sized.groupBy("chapter_id").agg((F.sum("n") + F.count(F.lit(1)) - 1).alias("total_chars"))
    earlier = Window.partitionBy("chapter_id").orderBy("volume").rowsBetween(Window.unboundedPreceding, -1)
    held = sized.withColumn("before", F.coalesce(F.sum(F.col("n") + 1).over(earlier), F.lit(0)))
    held = held.filter(F.col("before") < row_chars).select("chapter_id", "volume")
    several = chapters.filter("volumes > 1")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("volume", "full_text"))), lambda v: v["full_text"])
    joined = (
        several.join(held, ["chapter_id", "volume"], "left_semi")
        .groupBy("chapter_id")
        .agg(
            F.first("chapter_number").alias("chapter_number"),
            F.first("title").alias("title"),
            F.array_join(texts, "\n").alias("full_text"),
            F.first("chunk_count").alias("chunk_count"),
        )
        .join(total, "chapter_id")
    )
    names = ["chapter_id", "chapter_number", "title", "full_text", "chunk_count", "total_chars"]
    single = chapters.filter("volumes = 1").withColumn("total_chars", F.length("full_text").cast("long"))
    return single.select(*names).unionByName(joined.select(*names))


def lookup_summaries(corpus: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(chapter_id, title, summary), the first non-blank summary per chapter by id;
    without a stored title the title is taken from the summary. An aggregate, so
    many summaries of one chapter are reduced before the shuffle."""
    title = X.null_if_blank(F.col("chapter_title"))
    rows = summaries_only(corpus).select(
        X.null_if_blank(F.col("chapter_id")).alias("chapter_id"),
        "doc_id",
        title.alias("title"),
        X.null_if_blank(F.col("text")).alias("summary"),
    ).filter("chapter_id is not null and summary is not null")
    if wanted is not None:
        rows = rows.join(wanted, "chapter_id", "left_semi")
    first = rows.groupBy("chapter_id").agg(F.min_by(F.struct("title", "summary"), "doc_id").alias("s"))
    return first.select(
        "chapter_id",
        F.coalesce(F.col("s.title"), X.chapter_title(F.col("s.summary"))).alias("title"),
        F.col("s.summary").alias("summary"),
    )
