"""Entities (F1-F3): profiles, neighbours, names that occur together."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata import constants as K
from strata.functions import text as X
from strata.operators.neighbors import knn_exact, top_k
from strata.operators.vectors import hashing_embed
from strata.sizing import fits, hint_if, measure, shuffle_width

#: Bytes of an automaton for each byte of its names, about.
_NODE_BYTES = 4


class NameAutomaton:
    """A trie of names with failure links: one pass over a text finds all names in it, however many there are and
    however they overlap."""

    def __init__(self, names: list[str]):
        self.empty = "" in names  # is in every text
        self.machine = ahocorasick.Automaton()
        for name in names:
            if name:
                self.machine.add_word(name, name)
        self.any = len(self.machine) > 0
        if self.any:
            self.machine.make_automaton()

    def names_in(self, text: str) -> list[str]:
        found = {name for _, name in self.machine.iter(text)} if self.any else set()
        return sorted(found | {""} if self.empty else found)


def mentions(docs: DataFrame, names: DataFrame, small: bool | None = None) -> DataFrame:
    """``docs`` columns but the text, plus ``character``, for every text that contains the name.

    A list that fits a broadcast (measured) goes to the tasks as an automaton; a text is read once, in
    Arrow batches. A longer one meets by an equi-join the distinct runs of characters of its names' lengths;
    the texts themselves are not in these rows.
    """
    size = measure(names)
    if small is None:
        small = fits(docs.sparkSession, size, _NODE_BYTES)
    if small:
        listed = sorted(r["character"] for r in names.select("character").distinct().collect() if r["character"] is not None)
        shared = docs.sparkSession.sparkContext.broadcast(listed)

        @F.arrow_udf("array<string>")
        def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            machine = NameAutomaton(shared.value)
            for texts in batches:
                yield pa.array([None if t is None else machine.names_in(t) for t in texts.to_pylist()], pa.list_(pa.string()))

        rows = docs.withColumn("_found", found(F.col("text"))).drop("text")
        return rows.withColumn("character", F.explode_outer("_found")).drop("_found").filter("character is not null")
    lengths = [r[0] for r in names.select(F.length("character")).distinct().collect()]  # a few small numbers
    grams = [F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths if n]
    if not grams:
        return docs.drop("text").withColumn("character", F.lit("")).limit(0)
    rows = docs.withColumn("character", F.explode(F.array_distinct(F.concat(*grams)))).drop("text")
    return rows.join(names.select("character").distinct(), "character")


def entity_profiles(corpus: DataFrame, names: DataFrame, max_chars: int = K.PROFILE_CHARS) -> DataFrame:
    """(character, profile_text) from the texts that name the character, in
    corpus order, up to ``max_chars`` characters (the last text is cut).

    Only lengths are ordered, never the texts. A name that occurs everywhere is
    first cut per (name, hash of id): a text behind ``max_chars`` characters of
    its own shard is behind as many in the whole order, so what is left per name
    is bounded, and the final order is exact.
    """
    docs = corpus.select(
        "doc_id", X.strip(F.coalesce("text", F.lit(""))).alias("text"), "chapter_id", "chunk_index"
    ).filter("text <> ''")
    found = mentions(docs.withColumn("chars", F.length("text").cast("long")), names)
    order = ["chapter_id", "chunk_index", "doc_id"]
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shuffle_width(corpus.sparkSession)))

    def before(*keys):
        window = Window.partitionBy("character", *keys).orderBy(*order)
        total = F.sum("chars").over(window.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(total, F.lit(0))

    kept = found.withColumn("_before", before(shard)).filter(F.col("_before") < max_chars)
    kept = kept.withColumn("_before", before()).filter(F.col("_before") < max_chars)
    room = F.least(F.col("chars"), max_chars - F.col("_before")).cast("int")
    pieces = kept.withColumn("room", room).select("character", "doc_id", "_before", "room")
    texts = pieces.join(docs.select("doc_id", "text"), "doc_id").select(
        "character", "_before", F.left("text", F.col("room")).alias("piece")
    )
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("_before", "piece"))), lambda p: p["piece"]
    )
    return texts.groupBy("character").agg(
        X.strip(F.array_join(ordered, K.PROFILE_JOIN)).alias("profile_text")
    )


def entity_table(profiles: DataFrame, dims: int = 64) -> DataFrame:
    """Entities (character, profile_text, vector) with the hashing encoder."""
    vectors = hashing_embed(profiles, "character", "profile_text", "vector", dims)
    return profiles.join(vectors, "character")


def entity_neighbors(entities: DataFrame, queries: DataFrame, k: int = K.SEARCH_K, **options) -> DataFrame:
    """F2: (query_id, character, rank, score) nearest entities of each query vector."""
    found = knn_exact(entities, queries, k, id_col="character", **options)
    return found.select("query_id", "character", "rank", "score")


def cooccurring_names(
    hits: DataFrame,
    names: DataFrame,
    first_hits: int = K.NAME_HITS,
    top: int = K.NAME_TOP,
    token_column: str | None = None,
) -> DataFrame:
    """(query_id, character, n, rank) names in the first hits of each query.

    Tokens of two or more characters that stand in the name list are counted;
    the query and its first two characters are left out. ``token_column`` names
    an array of tokens made by a caller's own tagger.
    """
    near = hits.filter(F.col("rank") <= first_hits)
    toks = F.col(token_column) if token_column else X.tokens(F.col("text"))
    query = F.lower(X.strip(F.col("query_text")))
    words = near.select("query_id", query.alias("q"), F.explode(toks).alias("token")).filter(
        (F.length("token") >= 2)
        & (F.col("token") != F.col("q"))
        & (F.col("token") != F.left("q", F.lit(2)))
    )
    listed = names.select("character", F.lower("character").alias("token")).dropDuplicates(["token"])
    small = fits(hits.sparkSession, measure(names), 2)
    counts = (
        words.join(hint_if(listed, small), "token")
        .groupBy("query_id", "character")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_k(counts, "query_id", [F.col("n").desc(), F.col("character")], top, "character")
