"""Mixing sources to target weights by systematic sampling (operator 3), DataFrame functions only.

A source's documents stand in the order of size and id. Each document of a source is expected
in ``target / source_size`` copies; the prefix sums of these numbers, moved by one random offset
per source, are cut at the integers, and a document is emitted once per integer that its stretch
crosses. Because the order is by size, the words taken differ from the target by no more than
the size of the longest document.

Ranks within a source come from a range partitioning: the rank in the sorted partition plus the
rows of the source in the partitions before. So a source of any share of the rows is spread over
many tasks, and only (partition, source) counts meet.

Cases: null and empty texts have size 0 and take 0 words; a null source is the last source; a
source of size 0 has target 0 and no copies; repeated rows are documents of their own; an empty
table gives an empty result; `copy` replaces a column of that name, all other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strata.llm.tables import WORD, column, free_names, text_of, written
from strata.sizing import shuffle_width

CYCLE = 3
MOST_COPIES = 3
SEED = "mix"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, cycle: int = CYCLE, most: int = MOST_COPIES) -> DataFrame:
    """Target words per source of (``source``, ``source_size``), a row per source.

    Sources in code point order, null last, weigh 1 to `cycle`, repeating. Shares follow the weights;
    a share above `most` times the source's size stops there and the excess goes to the others by
    weight. In the order of ``most * size / weight`` the sources that stop come first, so one
    running sum finds them. Windows run over the table of sources alone.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name))
    weighed = ranked.select(
        "source",
        "source_size",
        "rank",
        ((F.col("rank") - 1) % cycle + 1).cast("double").alias("weight"),
        (F.col("source_size") * most).cast("double").alias("cap"),
    )
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = weighed.withColumn("level", level)
    stops = F.col("cap") <= F.col("level") * F.col("weight")
    free = levels.withColumn("free", F.when(~stops, F.col("level")))
    water = F.first("free", ignorenulls=True).over(whole)
    return free.select(
        "source",
        "source_size",
        F.when(stops, F.col("cap")).otherwise(F.least(F.col("cap"), water * F.col("weight"))).alias("target"),
        offset(F.col("rank")).alias("offset"),
    )


def offset(rank: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) by the source's rank and the seed."""
    text = F.md5(F.concat(F.lit(f"{seed}/"), rank.cast("string")))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("double") / 4294967296.0


def systematic_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: ``doc_id``, ``size``, ``source``, ``source_size``, ``target``, ``copies``."""
    spark = docs.sparkSession
    rows = docs.select(
        column(docs, id_col).alias("doc_id"),
        n_words(text_of(docs, text_col)).alias("size"),
        column(docs, source_col).cast("string").alias("source"),
        F.monotonically_increasing_id().alias("uid"),
    )
    rows = written(rows, "mix-rows")
    keys = [F.col("source").isNull(), "source", "size", F.col("doc_id").isNull(), "doc_id", "uid"]
    ordered = rows.repartitionByRange(shuffle_width(spark), *keys).sortWithinPartitions(*keys)
    ordered = written(ordered.withColumn("line", F.monotonically_increasing_id()), "mix-ordered")
    part = F.shiftright("line", 33).alias("part")
    blocks = ordered.groupBy(part, "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.min("line").alias("first_line")
    )
    blocks = written(blocks, "mix-blocks")
    earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    sources = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")))
    plan = starts.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
    plan = plan.select("part", F.col("b.source").alias("_source"), "before", "first_line", "source_size", "target", "offset")
    plan = written(plan, "mix-plan")
    found = ordered.withColumn("part", part).alias("o").join(
        plan.alias("p"), (F.col("o.part") == F.col("p.part")) & F.col("o.source").eqNullSafe(F.col("p._source"))
    )
    rank = F.col("line") - F.col("first_line") + F.col("before")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor((rank + 1) * expected + F.col("offset")) - F.floor(rank * expected + F.col("offset"))
    return found.select("doc_id", "size", "source", "source_size", "target", "uid", crossed.cast("long").alias("copies"))


def mixed_words(docs: DataFrame, **columns: str) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` words per input row."""
    found = systematic_copies(docs, **columns)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document once per integer crossed, numbered by ``copy`` from 0."""
    found = systematic_copies(docs, id_col, text_col, source_col)
    own = free_names(docs, "id", "size", "source", "rows", "copies", "share")
    name, size, source, rows, copies, shared = own
    plan = found.groupBy(F.col("doc_id").alias(name), F.col("size").alias(size), F.col("source").alias(source)).agg(
        F.count(F.lit(1)).alias(rows), F.sum("copies").alias(copies)
    )
    plan = written(plan.filter(F.col(copies) > 0), "mix-copies")
    same = (
        column(docs, id_col).eqNullSafe(plan[name])
        & (n_words(text_of(docs, text_col)) == plan[size])
        & column(docs, source_col).cast("string").eqNullSafe(plan[source])
    )
    joined = docs.drop("copy").join(plan, same)
    turn = F.lit(1)
    if plan.filter(F.col(rows) > 1).limit(1).count():  # rows that repeat id, size and source share the copies
        order = W.partitionBy(name, size, source).orderBy(F.xxhash64(text_of(docs, text_col)))
        turn = F.row_number().over(order)
    share = F.floor(F.col(copies) / F.col(rows)) + F.when(turn <= F.col(copies) % F.col(rows), 1).otherwise(0)
    kept = joined.withColumn(shared, share.cast("int")).filter(F.col(shared) > 0)
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(shared) - 1))).drop(*own)
