"""Exact dedup by deterministic block naming (operator 10).

A text without white space is cut into blocks of a fixed size. Distinct blocks are sorted
and get integer names; then adjacent names are paired, distinct pairs get names again, and so
on until one name is left per document. Two documents have the same last name after the same
number of rounds if and only if their texts are equal: names are given to contents, not to
hashes. A digest only carries a block to its name, and digests that meet several contents are
told apart by the content itself.

Cases: null and empty texts are equal texts; a null id sorts last; repeated rows are separate
rows of a group; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.tables import SPACE, column, remove, text_of, written

BLOCK_CHARS = 16384


def short_digest(block: Column) -> Column:
    return F.unhex(F.substring(F.sha2(block, 256), 1, 32))


def _blocks(text: Column, size: int) -> Column:
    """Consecutive blocks of `size` code points; an empty text is one empty block."""
    many = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(many)


def _numbered(distinct: DataFrame, *keys: str) -> DataFrame:
    """Integer names: rank within the sorted partition, behind the partition's number."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _block_names(texts: DataFrame, size: int, digest: Callable[[Column], Column]) -> DataFrame:
    blocks = texts.select(F.explode(_blocks(F.col("norm"), size)).alias("block"))
    distinct = blocks.select(digest(F.col("block")).alias("digest"), "block").distinct()
    return _numbered(distinct, "digest", "block")


def identities(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    digest: Callable[[Column], Column] = short_digest,
) -> DataFrame:
    """One row per input row: its id, ``n_chars`` of the original text, ``text_sha256`` of the
    normalised one, a row number ``uid``, and the identity (``level``, ``name``)."""
    original = text_of(docs, text_col)
    texts = docs.select(
        column(docs, id_col).alias("doc_id"),
        F.length(original).cast("long").alias("n_chars"),
        F.regexp_replace(original, f"{SPACE}+", "").alias("norm"),
    )
    digests = F.transform(_blocks(F.col("norm"), block_chars), digest)
    rows = texts.select(
        "doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256"), digests.alias("digests")
    ).withColumn("uid", F.monotonically_increasing_id())
    rows = written(rows, "naming-rows")

    names = written(_block_names(texts, block_chars, digest), "naming-blocks")
    clash = names.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    parts = rows.select("uid", F.size("digests").alias("n"), F.posexplode("digests").alias("pos", "digest"))
    if clash:  # a digest of several contents: carry the blocks themselves to their names
        return identities(docs, id_col, text_col, block_chars, lambda block: block)
    parts = parts.join(names.select("digest", "name"), "digest")
    parts = written(parts.select("uid", "n", "pos", "name"), "naming-parts")

    done, level, spent = [], 0, []
    while True:
        done.append(parts.filter("n = 1").select("uid", F.lit(level).alias("level"), "name"))
        longest = parts.agg(F.max("n")).first()[0]
        if not longest or longest <= 1:
            break
        pairs = (
            parts.filter("n > 1")
            .groupBy("uid", (F.col("pos") / 2).cast("int").alias("pos"))
            .agg(
                F.first("n").alias("n"),
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            )
        )
        pairs = written(pairs, "naming-pairs")
        names = written(_numbered(pairs.select("left", "right").distinct(), "left", "right"), "naming-names")
        named = pairs.join(names, ["left", "right"]).select(
            "uid", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name"
        )
        parts, level = written(named, "naming-parts"), level + 1
        spent += [pairs, names]
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    out = written(rows.drop("digests").join(found, "uid"), "naming-identities")
    remove(rows, *spent)
    return out


def _first_row() -> Column:
    """Order in which a group prefers its rows: longest original, then smallest id."""
    return F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "uid")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``doc_id``, ``keep_id`` (the row of its group that stays: most code
    points in the original text, then smallest id), ``group_size``, ``kept``, ``text_sha256``."""
    rows = identities(docs, id_col, text_col, **options)
    groups = (
        rows.groupBy("level", "name")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(_first_row()).alias("best"))
        .filter("group_size > 1")
        .select("level", "name", "group_size", "best.uid", F.col("best.doc_id").alias("keep_id"))
        .withColumnRenamed("uid", "keep_uid")
    )
    groups = written(groups, "naming-groups")
    single = F.col("group_size").isNull()
    return rows.join(groups, ["level", "name"], "left").select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one row of each group of equal texts, all columns kept.

    Rows that repeat id and text are one row in the result.
    """
    kept = exact_groups(docs, id_col, text_col, **options).filter("kept")
    kept = written(kept.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")), "naming-kept")
    sha = F.sha2(F.regexp_replace(text_of(docs, text_col), f"{SPACE}+", ""), 256)
    found = docs.join(kept, column(docs, id_col).eqNullSafe(kept["_id"]) & (sha == kept["_sha"]), "left_semi")
    ids = docs.groupBy(column(docs, id_col).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    if not ids.filter("n > 1").limit(1).count():
        return found
    key = F.struct(column(found, id_col), F.sha2(F.regexp_replace(text_of(found, text_col), f"{SPACE}+", ""), 256))
    packed = found.select(
        key.alias("key"),
        F.length(text_of(found, text_col)).alias("n"),
        F.struct(*[column(found, c) for c in found.columns]).alias("row"),
    )
    best = packed.groupBy("key").agg(F.max_by("row", "n").alias("row"))
    return best.select(*[F.col("row")[c].alias(c) for c in found.columns])
