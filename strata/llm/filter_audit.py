"""Filter interaction audit by higher-order SQL folds (operator 13).

Five filters, each a failure condition of a document, can be applied in 120 orders. What an order removes
where follows from the set of filters that a document fails, its mask. So the documents are counted by
(part, mask) first: at most 32 cells a part, however many documents it has. Each cell then folds across the
array of orders, a literal that every task has: ``transform`` over the orders, and in each an ``aggregate``
over its five filters that carries the filters so far and appends one struct a step. That gives 600 structs
weighted by the cell's counts; the cells of a part are merged by elementwise sums. No document meets an
order, and only cells are shuffled to the merge.

Identical texts: the smallest id of each text is an aggregate over a digest (SHA-256) of the text, so a
group of any size leaves one row a map task. The rows meet those ids, and the labels, by joins on the id,
which no group of copies makes hot.

Cases: a null text is empty (and fails A alone, unless it is a copy); a null part is the empty string; a null
id is not larger than another, so its row does not fail E, and has no labels; rows that repeat an id count
each, the one id is not smaller than itself; several labels of an id count if one of them is set; documents
without labels are neither good nor toxic; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.tables import WORD, column, growing, text_of, written

FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in permutations(FILTERS)]
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
LEAST_WORDS = 200
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
ZEROS = "struct<" + ",".join(f"{name}:bigint" for name in COUNTS) + ">"


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    found = F.transform(
        F.array(words), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("kinds"))
    )[0]
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = {
        "A": found["words"] < LEAST_WORDS,
        "B": 100 * found["kinds"].cast("long") < 50 * found["words"].cast("long"),
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }
    return sum((F.when(bad, BIT[name]).otherwise(0) for name, bad in fails.items()), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(``part``, ``mask``, ``n``, ``good``, ``toxic``): documents by the set of filters that they fail."""
    text = text_of(docs, text_col)
    rows = docs.select(
        column(docs, id_col).alias("id"),
        F.coalesce(column(docs, part_col).cast("string"), F.lit("")).alias("part"),
        text_mask(text).alias("fails"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    rows = written(rows, "audit-rows")
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).select("id", "digest", F.lit(True).alias("is_first"))
    first = written(first, "audit-first")
    known = labels.groupBy(column(labels, "doc_id").alias("id")).agg(
        F.max(F.coalesce(column(labels, "quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(column(labels, "toxic") == 1, F.lit(False))).alias("toxic"),
    )
    met = rows.join(growing(known), "id", "left").join(growing(first), ["id", "digest"], "left")
    copy = F.col("is_first").isNull() & F.col("id").isNotNull()
    mask = F.col("fails") + F.when(copy, BIT["E"]).otherwise(0)
    return met.groupBy("part", mask.alias("mask")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce("good", F.lit(False))).alias("good"),
        F.count_if(F.coalesce("toxic", F.lit(False))).alias("toxic"),
    )


def _orders() -> Column:
    """The order array: for each order the bits of its filters."""
    return F.array(*[F.array(*[F.lit(BIT[f]) for f in order]) for order in ORDERS])


def fold(cell: Column) -> Column:
    """600 structs, five for each order: what the documents of a cell add to each step."""

    def step(earlier: Column, bit: Column) -> Column:
        fails = cell["mask"].bitwiseAND(bit) != 0
        here = cell["mask"].bitwiseAND(earlier) == 0
        removed = fails & here
        counts = {
            "kept": (here & ~fails, "n"),
            "removed": (removed, "n"),
            "redundant": (fails & ~here, "n"),
            "unique_fails": (cell["mask"] == bit, "n"),
            "good_lost": (removed, "good"),
            "toxic_lost": (removed, "toxic"),
        }
        return F.struct(*[F.when(cond, cell[weight]).otherwise(F.lit(0).cast("long")).alias(name) for name, (cond, weight) in counts.items()])

    def one_order(order: Column) -> Column:
        start = F.struct(F.lit(0).alias("earlier"), F.array().cast(f"array<{ZEROS}>").alias("steps"))
        return F.aggregate(
            order,
            start,
            lambda acc, bit: F.struct(
                acc["earlier"].bitwiseOR(bit).alias("earlier"),
                F.concat(acc["steps"], F.array(step(acc["earlier"], bit)).cast(f"array<{ZEROS}>")).alias("steps"),
            ),
            lambda acc: acc["steps"],
        )

    return F.flatten(F.transform(_orders(), one_order))


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS]))


def interactions(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """A row for each part, ``filter_order`` and ``step`` (1 to 5): documents of the part that are ``kept`` after
    the step, ``removed`` by it, ``redundant`` (failing its filter, removed earlier), ``unique_fails`` (failing its
    filter only), ``good_lost`` and ``toxic_lost`` (removed and so labelled), and ``shapley``: what its filter
    removes, summed over all orders."""
    counted = cells(docs, labels, **columns)
    zeros = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS]), 5 * len(ORDERS))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    merged = parts.select("part", F.aggregate("cells", zeros, lambda acc, cell: _added(acc, fold(cell))).alias("steps"))
    letters = F.split(F.lit("".join(ORDERS)), "")
    removed = {
        f: F.aggregate(
            F.zip_with("steps", letters, lambda s, letter: F.when(letter == f, s["removed"]).otherwise(0)),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        )
        for f in FILTERS
    }
    merged = merged.select("part", "steps", F.array(*[removed[f] for f in FILTERS]).alias("shapley"))
    rows = merged.select("part", "shapley", F.posexplode("steps").alias("pos", "s"))
    order = F.substring(F.lit("".join(ORDERS)), (F.col("pos") - F.col("pos") % 5 + 1).cast("int"), F.lit(5))
    step = (F.col("pos") % 5 + 1).cast("int")
    letter = F.substring(F.lit("".join(ORDERS)), (F.col("pos") + 1).cast("int"), F.lit(1))
    return rows.select(
        "part",
        order.alias("filter_order"),
        step.alias("step"),
        *[F.col("s")[c].alias(c) for c in COUNTS],
        F.get("shapley", F.ascii(letter) - F.lit(ord("A"))).alias("shapley"),
    )
