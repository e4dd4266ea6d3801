"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.tables import remove, sized, written


def _pairs(a: Column, b: Column) -> Column:
    return F.struct(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def roots(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(``node``, ``root``) for every node of ``links`` (columns ``a``, ``b``, integers): the root is
    the smallest node of the component. Each star takes the least neighbour by an aggregate and
    joins it back to a written table, so a node with very many links is split over tasks. ``rows``
    says how many links there are at most, if that is known."""
    edges = links.filter("a <> b").select(_pairs(F.col("a"), F.col("b")).alias("p")).select("p.u", "p.v").distinct()
    edges = written(edges if rows is None else sized(edges, rows), "links")
    state = _state(edges)
    while state[0]:
        n = 2 * state[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(sized(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), n), "links-least")
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(sized(large.distinct(), n), "links-large")
        down = written(sized(large.groupBy("u").agg(F.min("v").alias("m")), n), "links-down")
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p"))
        after = written(sized(small.select("p.u", "p.v").filter("u <> v").distinct(), n), "links")
        now = _state(after)
        remove(edges, least, large, down)
        edges = after
        if now == state:
            break
        state = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
