"""Context building (E1-E9). Inputs are hit lists, so a query has few rows here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata import constants as K
from strata.functions import text as X
from strata.functions.score import chapter_score

UNIT_COLUMNS = [
    "query_id", "kind", "text", "chapter_id", "title", "score", "hit_count", "rank",
    "chunk_index", "doc_id", "slot", "total_chars",
]


def _score() -> Column:
    return F.coalesce(F.col("score"), F.lit(0.0))


def score_chapters(hits: DataFrame, chapter_k: int = K.CONTEXT_TOP_K, alpha: float = K.CHAPTER_ALPHA) -> DataFrame:
    """(query_id, chapter_id, score, hit_count, best, slot), the top chapters per query.

    ``best`` is the chapter's best hit; equal chapter scores go by first hit.
    """
    named = hits.withColumn("chapter_id", X.null_if_blank(F.col("chapter_id"))).filter("chapter_id is not null")
    best = F.max_by(
        F.struct("doc_id", "rank", "chunk_index", "text"), F.struct(_score(), -F.col("rank"))
    )
    grouped = named.groupBy("query_id", "chapter_id").agg(
        F.max(_score()).alias("top"),
        F.count(F.lit(1)).alias("hit_count"),
        best.alias("best"),
        F.min("rank").alias("first"),
    )
    scored = grouped.withColumn("score", chapter_score(F.col("top"), F.col("hit_count"), alpha))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "first")
    return (
        scored.withColumn("slot", F.row_number().over(order))
        .filter(F.col("slot") <= chapter_k)
        .select("query_id", "chapter_id", "score", "hit_count", "best", "slot")
    )


def _with_total(df: DataFrame, text: str) -> DataFrame:
    """``total_chars`` of rows that hold their whole text."""
    return df if "total_chars" in df.columns else df.withColumn("total_chars", F.length(text).cast("long"))


def select_context_units(
    chosen: DataFrame,
    summaries: DataFrame | None,
    chapters: DataFrame,
    multi_hit_threshold: int = K.MULTI_HIT_THRESHOLD,
) -> DataFrame:
    """Per chosen chapter its summary, else the whole chapter when hit often
    enough, else its best chunk. A blank best chunk gives no unit.

    ``summaries`` None switches summaries off; ``chapters`` has one row per chapter
    (``whole_chapters``). ``total_chars`` counts the whole text, also where a row holds
    only the beginning of a very long chapter.
    """
    units = chosen
    if summaries is None:
        units = units.withColumn("summary", F.lit(None).cast("string")).withColumn(
            "summary_title", F.lit(None).cast("string")
        )
    else:
        named = summaries.select("chapter_id", "summary", F.col("title").alias("summary_title"))
        units = units.join(named, "chapter_id", "left")
    whole = _with_total(chapters, "full_text").select("chapter_id", "full_text", F.col("title").alias("chapter_title"), "total_chars")
    units = units.join(whole, "chapter_id", "left")
    chunk = X.null_if_blank(F.col("best.text"))
    use_whole = (F.col("hit_count") >= multi_hit_threshold) & X.present(F.col("full_text"))
    kind = (
        F.when(X.present(F.col("summary")), K.KIND_SUMMARY)
        .when(use_whole, K.KIND_CHAPTER)
        .when(chunk.isNotNull(), K.KIND_CHUNK)
    )
    units = units.withColumn("kind", kind).filter("kind is not null")
    of = F.col("kind")
    text = (
        F.when(of == K.KIND_SUMMARY, X.strip(F.col("summary")))
        .when(of == K.KIND_CHAPTER, X.strip(F.col("full_text")))
        .otherwise(chunk)
    )
    beyond = F.when(of == K.KIND_CHAPTER, F.col("total_chars") - F.length("full_text")).otherwise(0)
    return units.select(
        "query_id",
        "kind",
        text.alias("text"),
        "chapter_id",
        F.when(of == K.KIND_SUMMARY, X.null_if_blank(F.col("summary_title")))
        .when(of == K.KIND_CHAPTER, X.null_if_blank(F.col("chapter_title")))
        .alias("title"),
        "score",
        "hit_count",
        F.col("best.rank").alias("rank"),
        F.when(of == K.KIND_CHUNK, F.col("best.chunk_index")).alias("chunk_index"),
        F.when(of == K.KIND_CHUNK, F.col("best.doc_id")).alias("doc_id"),
        "slot",
        (F.length(text) + beyond).alias("total_chars"),
    )


def fill_orphans(hits: DataFrame, units: DataFrame, chapter_k: int = K.CONTEXT_TOP_K) -> DataFrame:
    """Units plus hits without chapter, by score, up to ``chapter_k`` per query."""
    text = X.null_if_blank(F.col("text"))
    loose = hits.filter(X.null_if_blank(F.col("chapter_id")).isNull()).filter(text.isNotNull())
    order = Window.partitionBy("query_id").orderBy(_score().desc(), "rank")
    loose = loose.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= chapter_k)
    used = units.groupBy("query_id").agg(F.count(F.lit(1)).alias("used"))
    fill = (
        loose.join(used, "query_id", "left")
        .filter(F.col("place") <= chapter_k - F.coalesce("used", F.lit(0)))
        .select(
            "query_id",
            F.lit(K.KIND_CHUNK).alias("kind"),
            text.alias("text"),
            F.lit(None).cast("string").alias("chapter_id"),
            F.lit(None).cast("string").alias("title"),
            _score().alias("score"),
            F.lit(1).cast("long").alias("hit_count"),
            "rank",
            "chunk_index",
            "doc_id",
            (F.col("place") + chapter_k).alias("slot"),
            F.length(text).cast("long").alias("total_chars"),
        )
    )
    return units.select(*UNIT_COLUMNS).unionByName(fill)


def order_units(units: DataFrame) -> DataFrame:
    """``ref``: summaries, then chapters, then chunks; by score inside a kind."""
    kind = F.col("kind")
    rank = F.when(kind == K.KIND_SUMMARY, 0).when(kind == K.KIND_CHAPTER, 1).otherwise(2)
    order = Window.partitionBy("query_id").orderBy(rank, F.col("score").desc(), "slot")
    return units.filter(X.present(F.col("text"))).withColumn("ref", F.row_number().over(order))


def _header(*bits: Column) -> Column:
    return F.concat_ws(" ", F.concat(F.lit("["), F.col("ref").cast("string"), F.lit("]")), *bits)


def _tag(name: str, value: Column, when: Column | None = None) -> Column:
    told = F.concat(F.lit(f"{name}="), value.cast("string"))
    return told if when is None else F.when(when, told)


def _budget(df: DataFrame, size: Column) -> DataFrame:
    """``used``: characters of all blocks before this one."""
    before = Window.partitionBy("query_id").orderBy("ref").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("used", F.coalesce(F.sum(size).over(before), F.lit(0)))


def pack_context(ordered: DataFrame, max_chars: int = K.CONTEXT_MAX_CHARS) -> DataFrame:
    """E5: the sources that fit one shared budget, with the block each contributes.

    Blocks are taken in order of ``ref``. The first that does not fit is cut
    when enough room is left; nothing follows it. So a running total of full
    block lengths decides every row at once.
    """
    kind = F.col("kind")
    long_kind = kind.isin(K.KIND_CHAPTER, K.KIND_SUMMARY)
    header = F.concat(
        _header(
            _tag("chapter_id", F.col("chapter_id")),
            _tag("title", F.col("title"), long_kind & (F.col("title") != "")),
            F.when(kind == K.KIND_SUMMARY, F.lit("kind=chapter_summary")),
            _tag("chunk", F.col("chunk_index"), kind == K.KIND_CHUNK),
            _tag("id", F.col("doc_id")),
        ),
        F.lit("\n"),
    )
    suffix = (
        F.when(kind == K.KIND_SUMMARY, K.CUT_SUMMARY)
        .when(kind == K.KIND_CHAPTER, K.CUT_CHAPTER)
        .otherwise(K.CUT_CHUNK)
    )
    df = _with_total(ordered, "text").withColumn("_beyond", F.col("total_chars") - F.length("text"))
    df = df.withColumn("text", X.strip(F.col("text"))).withColumn("_header", header)
    df = df.withColumn("_full", F.concat("_header", "text", F.lit("\n")))
    size = F.length("_full") + F.col("_beyond")
    df = _budget(df, size)
    remain = max_chars - F.col("used")
    fits = size <= remain
    body = (remain - F.length("_header") - F.length(suffix)).cast("int")
    room = F.when(long_kind, K.ROOM_LONG).otherwise(K.ROOM_SHORT)
    cut = ~fits & (remain >= room) & (body >= K.MIN_BODY)
    shown = F.when(fits, F.col("text")).otherwise(F.left("text", body))
    df = df.withColumn("text_truncated", ~fits).filter((fits & (F.lit(max_chars) > 0)) | cut)
    df = df.withColumn("text_for_llm", shown)
    block = F.when(fits, F.col("_full")).otherwise(F.concat("_header", "text_for_llm", suffix))
    cap = F.when(long_kind, K.PREVIEW_LONG).otherwise(K.PREVIEW_SHORT)
    clipped = F.concat(
        F.left("text", cap), F.when(F.length("text") > cap, K.ELLIPSIS).otherwise("")
    )
    return df.select(
        "query_id", "ref", "doc_id", "rank", "score", "chapter_id", "chunk_index",
        F.col("kind").alias("source_kind"),
        F.col("title").alias("chapter_title"),
        "hit_count", "text", "text_for_llm", "text_truncated",
        (F.length("text") + F.col("_beyond")).alias("text_total_chars"),
        clipped.alias("text_preview"),
        block.alias("block"),
    )


def pack_context_hits(hits: DataFrame, max_chars: int = K.CONTEXT_MAX_CHARS) -> DataFrame:
    """The older packing of plain hits: ``ref`` is the place in the hit list
    (blank hits keep theirs), and the cut mark comes on top of the budget."""
    df = hits.withColumn("ref", F.col("rank")).withColumn("text", X.strip(F.col("text")))
    df = df.filter(X.present(F.col("text")))
    header = _header(
        _tag("id", F.col("doc_id")),
        _tag("chapter_id", F.col("chapter_id")),
        _tag("chunk", F.col("chunk_index")),
    )
    full = F.concat(header, F.lit("\n"), F.col("text"), F.lit("\n"))
    df = _budget(df.withColumn("_full", full), F.length("_full"))
    remain = (max_chars - F.col("used")).cast("int")
    fits = F.length("_full") <= remain
    block = F.when(fits, F.col("_full")).otherwise(
        F.concat(F.left("_full", remain), F.lit(K.CUT_CHUNK))
    )
    return df.filter((fits | (remain >= K.ROOM_SHORT)) & (F.lit(max_chars) > 0)).select(
        "query_id", "ref", "doc_id", "rank", "score", "chapter_id", "chunk_index",
        X.preview(F.col("text"), K.PREVIEW_SHORT).alias("text_preview"),
        block.alias("block"),
    )


def join_blocks(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, query_text, context, n_sources), one row per query, '' without sources."""
    blocks = F.transform(
        F.array_sort(F.collect_list(F.struct("ref", "block"))), lambda b: b["block"]
    )
    packed = sources.groupBy("query_id").agg(
        X.strip(F.array_join(blocks, "\n")).alias("context"), F.count(F.lit(1)).alias("n_sources")
    )
    return (
        queries.select("query_id", "query_text")
        .join(packed, "query_id", "left")
        .select(
            "query_id",
            "query_text",
            F.coalesce("context", F.lit("")).alias("context"),
            F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
        )
    )


def enrich_sources(sources: DataFrame, chapters: DataFrame) -> DataFrame:
    """Attach the chapter; a ``chapter`` source shows the whole chapter text."""
    packed = _with_total(chapters, "full_text").select(
        F.col("chapter_id").alias("_chapter"),
        F.struct("chapter_id", "chapter_number", "title", "full_text", "chunk_count", "total_chars").alias("chapter"),
    )
    joined = sources.join(packed, X.strip(F.col("chapter_id")) == F.col("_chapter"), "left").drop("_chapter")
    full = X.null_if_blank(F.col("chapter.full_text"))
    whole = full.isNotNull() & (F.col("source_kind") == K.KIND_CHAPTER)
    title = F.when(full.isNotNull(), X.null_if_blank(F.col("chapter.title")))
    return (
        joined.withColumn("chapter_title", F.coalesce(title, "chapter_title"))
        .withColumn("text", F.when(whole, full).otherwise(F.col("text")))
        .withColumn("text_total_chars", F.when(whole, F.col("chapter.total_chars")).otherwise(F.length("text")))
        .withColumn(
            "text_preview",
            F.when(whole, X.preview(F.col("text"), K.PREVIEW_LONG)).otherwise(F.col("text_preview")),
        )
    )


def build_messages(contexts: DataFrame, system_prompt: str = K.SYSTEM_PROMPT) -> DataFrame:
    """``messages`` = system and user message with the fixed headings."""
    user = F.concat(
        F.lit(K.USER_CONTEXT_HEAD), "context", F.lit(K.USER_QUESTION_HEAD),
        X.strip(F.col("query_text")), F.lit(K.USER_TAIL),
    )
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return contexts.withColumn(
        "messages",
        F.array(message("system", F.lit(system_prompt.strip())), message("user", user)),
    )


def empty_context_answer(contexts: DataFrame) -> DataFrame:
    """A blank context gets the fixed answer and needs no generation."""
    has = X.present(F.col("context"))
    return contexts.withColumn("needs_generation", has).withColumn(
        "answer", F.when(~has, K.EMPTY_CONTEXT_ANSWER)
    )
