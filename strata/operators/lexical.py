"""Full-text operators (D1-D6): postings, BM25, query-side synonyms, kind filters.

:func:`bm25_match` gives all matches. Postings stay partitioned by document, the
query terms (measured, then broadcast) come to them, and the sum per (query,
document) needs no further shuffle (see ``keyword_scan`` for the top k alone). A hot term is therefore spread like its
documents. A corpus read from a table bucketed by ``doc_id`` is not shuffled at
all; otherwise :func:`by_document` shuffles it once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import constants as K
from strata.functions import score as S
from strata.functions.text import tokens
from strata.functions.vector import keep
from strata.operators.posting_scan import best_matches
from strata.operators.term_scan import GAP, TermScan, token_slices
from strata.packed import deal
from strata.sizing import fits, hint_if, measure, shuffle_width
from strata.storage import settle

_ALL_DOCS = ""  # pseudo-term that every document has once; tokens are never empty


def by_document(corpus: DataFrame) -> DataFrame:
    """Hash-partition by ``doc_id``: one shuffle that all document-keyed steps share."""
    return corpus.repartition(shuffle_width(corpus.sparkSession), "doc_id")


# --- kind filters -----------------------------------------------------------


def is_chunk() -> Column:
    """Kind ``chunk`` or no kind at all."""
    return F.coalesce(F.col("doc_kind") == K.KIND_CHUNK, F.lit(True))


def chunks_only(corpus: DataFrame) -> DataFrame:
    """D4."""
    return corpus.filter(is_chunk())


def summaries_only(corpus: DataFrame) -> DataFrame:
    """D5."""
    return corpus.filter(F.col("doc_kind") == K.KIND_SUMMARY)


def has_vector(corpus: DataFrame, column: str = "vector") -> DataFrame:
    """D6."""
    return corpus.filter(F.col(column).isNotNull())


# --- postings ---------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """The full-text index as three tables."""

    postings: DataFrame  # doc_id, term, tf, dl
    doc_len: DataFrame  # doc_id, dl
    term_stats: DataFrame  # term, df
    buckets: int = 0  # of the stored postings, 0 when they are not stored
    lengths: tuple[int, ...] = ()  # runs of tokens that are terms as well
    totals: DataFrame | None = None  # n_docs, total_dl of documents with tokens, where they are stored
    signed: DataFrame | None = None  # the rows with a ``sign`` of which ``postings`` are the sums, if that is what is stored


def runs_of(toks: Column, length: int) -> Column:
    """Every run of ``length`` tokens as one term."""
    run = lambda i: F.array_join(F.slice(toks, i + 1, length), GAP)
    none = F.array().cast("array<string>")
    return F.when(F.size(toks) >= length, F.transform(F.sequence(F.lit(0), F.size(toks) - length), run)).otherwise(none)


def with_runs(toks: Column, lengths: tuple[int, ...]) -> Column:
    """Tokens, and behind them the runs of the given lengths."""
    return F.concat(toks, *[runs_of(toks, n) for n in lengths]) if lengths else toks


def doc_tokens(
    corpus: DataFrame, field: str = "text", analyzer: str = "standard", lengths: tuple[int, ...] = (), *keep_columns: str
) -> DataFrame:
    """(doc_id, toks, dl); a field that already holds a token array is taken as it is.

    ``lengths`` adds runs of tokens to ``toks``, for synonyms of several tokens; the
    document's length ``dl`` counts single tokens.
    """
    kind = corpus.schema[field].dataType.typeName()
    toks = F.col(field) if kind == "array" else tokens(F.col(field), analyzer)
    rows = corpus.select("doc_id", *keep_columns, toks.alias("toks")).withColumn("dl", F.size("toks"))
    return rows.withColumn("toks", with_runs(F.col("toks"), lengths)) if lengths else rows


def build_postings(
    corpus: DataFrame,
    field: str = "text",
    analyzer: str = "standard",
    vocabulary: DataFrame | None = None,
    lengths: tuple[int, ...] = (),
) -> DataFrame:
    """(doc_id, term, tf, dl). On a corpus partitioned by document: no shuffle.

    ``vocabulary`` (term; small) keeps only its terms, before they are counted.
    The outer explode keeps the optimizer from testing ``size(tokens) > 0`` down
    in the scan, which would tokenise every text twice.
    """
    toks = (
        doc_tokens(corpus, field, analyzer, lengths)
        .select("doc_id", "dl", F.explode_outer("toks").alias("term"))
        .filter("term is not null")
    )
    if vocabulary is not None:
        toks = toks.join(F.broadcast(vocabulary), "term", "left_semi")
    return (
        toks.groupBy("doc_id", "dl", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
        .select("doc_id", "term", "tf", "dl")
    )


def counted_postings(corpus: DataFrame, field: str = "text", analyzer: str = "standard", lengths: tuple[int, ...] = ()) -> DataFrame:
    """The rows of `build_postings` for a corpus with one row a document: counted where the texts are, whatever the partitioning."""
    rows = doc_tokens(corpus, field, analyzer, lengths).select("doc_id", "dl", "toks")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in token_slices(batch, "toks"):
                ids, dl, toks = part.columns
                coded = toks.flatten().dictionary_encode()
                row = np.repeat(np.arange(len(ids)), toks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                width = max(1, len(coded.dictionary))
                key, tf = np.unique((row * width + code)[code >= 0], return_counts=True)
                at = pa.array(key // width)
                found = [ids.take(at), coded.dictionary.take(pa.array(key % width)), pa.array(tf.astype(np.int64)), dl.take(at)]
                yield pa.RecordBatch.from_arrays(found, names=["doc_id", "term", "tf", "dl"])

    kind = corpus.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, term string, tf long, dl int")


def build_index(
    corpus: DataFrame, field: str = "text", analyzer: str = "standard", lengths: tuple[int, ...] = ()
) -> Index:
    """D1 for a corpus partitioned by document; ``lengths`` indexes runs of tokens as well."""
    postings = build_postings(corpus, field, analyzer, lengths=lengths)
    doc_len = doc_tokens(corpus, field, analyzer).select("doc_id", "dl")
    stats = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return Index(postings, doc_len, stats, lengths=lengths)


INDEX_BUCKETS = 64


def _term_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def by_bucket(postings: DataFrame, buckets: int) -> DataFrame:
    """Postings dealt out for their folders; a document's rows of a folder meet in one task."""
    width = shuffle_width(postings.sparkSession)
    spread = max(1, width // buckets)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int")
    lanes = min(width, buckets * spread)
    return deal(postings.withColumn("_lane", F.pmod(F.col("bucket") * spread + part, F.lit(lanes))), lanes, "_lane")


def write_index(index: Index, path: str, buckets: int = INDEX_BUCKETS) -> None:
    """Store the three tables, postings in folders by a hash of the term: a search reads the
    folders of its terms and no text. Several tasks write a folder, so a frequent term is not
    one task's work. The texts are tokenised once: lengths and frequencies come from the
    written postings (a document without tokens has none, and takes no part in a search)."""
    spark = index.postings.sparkSession
    placed = index.postings.withColumn("bucket", _term_bucket(buckets))
    by_bucket(placed, buckets).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/postings")
    stored.groupBy("doc_id").agg(F.first("dl").alias("dl")).write.mode("overwrite").parquet(f"{path}/doc_len")
    frequencies = stored.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    frequencies.write.mode("overwrite").parquet(f"{path}/term_stats")
    about = spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(list(index.lengths)).cast("array<int>").alias("lengths"))
    about.write.mode("overwrite").parquet(f"{path}/about")


def read_index(spark: SparkSession, path: str) -> Index:
    """A stored index; the number of folders and the lengths of its runs come with it."""
    tables = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "doc_len", "term_stats"))
    about = spark.read.parquet(f"{path}/about").first()
    return Index(*tables, buckets=about["buckets"], lengths=tuple(about["lengths"]))


# --- query side -------------------------------------------------------------


def query_tokens(queries: DataFrame, analyzer: str = "standard", rules: Rules | None = None) -> DataFrame:
    """(query_id, term): the tokens of each query; a sequence of tokens that a synonym
    rule names is one term (from the left, longest first, without overlap)."""
    toks = queries.select("query_id", tokens(F.col("query_text"), analyzer).alias("toks"))
    if rules is None or max(rules.lengths, default=1) == 1:
        return toks.select("query_id", F.explode("toks").alias("term"))

    def places(n: int) -> Column:
        return F.transform(runs_of(F.col("toks"), n), lambda t, i: F.struct(i.alias("at"), F.lit(-n).alias("less"), t.alias("term")))

    named = rules.members.select("term").distinct()
    spans = toks.select("query_id", F.inline(F.concat(*[places(n) for n in rules.lengths])))
    spans = spans.join(named, "term", "left_semi")
    begun = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<at:int,less:int,term:string>>").alias("taken"))
    take = lambda acc, s: F.when(
        s["at"] >= acc["next"],
        F.struct((s["at"] - s["less"]).alias("next"), F.array_append(acc["taken"], s).alias("taken")),
    ).otherwise(acc)
    found = spans.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "less", "term"))).alias("spans"))
    found = found.select("query_id", F.aggregate("spans", begun, take)["taken"].alias("taken"))
    taken = F.coalesce("taken", F.array().cast("array<struct<at:int,less:int,term:string>>"))
    covered = lambda i: F.exists(taken, lambda s: (i >= s["at"]) & (i < s["at"] - s["less"]))
    single = F.filter(F.transform("toks", lambda t, i: F.when(~covered(i), t)), lambda t: t.isNotNull())
    joined = toks.join(found, "query_id", "left")
    return joined.select("query_id", F.explode(F.concat(F.transform(taken, lambda s: s["term"]), single)).alias("term"))


def query_terms(queries: DataFrame, analyzer: str = "standard", rules: Rules | None = None) -> DataFrame:
    """(query_id, slot, qtf): one slot per distinct query term."""
    toks = query_tokens(queries, analyzer, rules).withColumnRenamed("term", "slot")
    return toks.groupBy("query_id", "slot").agg(F.count(F.lit(1)).alias("qtf"))


@dataclass(frozen=True)
class Rules:
    """Synonym rules in the form in which they are looked up."""

    members: DataFrame  # term, member
    lengths: tuple[int, ...]  # numbers of tokens of the terms and members


def synonym_members(rules: DataFrame, analyzer: str = "standard") -> DataFrame:
    """(term, member): what a query term stands for, from (rule_id, side, pos, term).

    Terms are analysed like the query; several tokens are one term, joined by ``GAP``.
    """
    toks = tokens(F.col("term"), analyzer)
    named = rules.withColumn("_t", toks).filter(F.size("_t") > 0).select(
        "rule_id", "side", F.array_join("_t", GAP).alias("term")
    )

    def pairs(left: str, right: str) -> DataFrame:
        a = named.filter(F.col("side") == left).select("rule_id", "term")
        b = named.filter(F.col("side") == right).select("rule_id", F.col("term").alias("member"))
        return a.join(b, "rule_id").select("term", "member")

    return pairs("both", "both").unionByName(pairs("from", "to")).distinct()


def synonym_lookup(rules: DataFrame, analyzer: str = "standard") -> Rules:
    """The rules with the lengths of their terms (a few small numbers)."""
    members = settle(synonym_members(rules, analyzer))  # read by several steps
    both = members.select(F.explode(F.array("term", "member")).alias("t"))
    lengths = both.select(F.size(F.split("t", GAP)).alias("n")).distinct().collect()
    return Rules(members, tuple(sorted(r["n"] for r in lengths)))


def expand_synonyms(slots: DataFrame, rules: Rules) -> DataFrame:
    """D3: (slot, term): the members of each query term's rules, or the term itself.

    All members of a slot are scored as one term; a member of several tokens counts
    where they follow one another. The stored text is never expanded.
    """
    members = rules.members.withColumnRenamed("term", "slot")
    found = slots.join(members, "slot", "left")
    return found.select("slot", F.coalesce("member", "slot").alias("term")).distinct()


# --- BM25 -------------------------------------------------------------------


def term_counts(docs: DataFrame, terms: list[str], field: str = "text", analyzer: str = "standard") -> DataFrame:
    """(term, df, total_dl) of the given terms, and of the pseudo-term of all documents with tokens.
    A task looks them up in its batches and gives out a row per term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = shared.value
        scan = TermScan(named)
        df, docs_seen, tokens_seen = np.zeros(len(named), np.int64), 0, 0
        for batch in batches:
            for part in token_slices(batch, "toks"):
                row, term = scan.occurrences(part.column(0))
                df += np.bincount(np.unique(row * len(named) + term) % len(named), minlength=len(named)) if len(row) else 0
                sizes = part.column(0).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                docs_seen, tokens_seen = docs_seen + int((sizes > 0).sum()), tokens_seen + int(sizes.sum())
        seen = np.flatnonzero(df)
        columns = [[named[i] for i in seen] + [_ALL_DOCS], [*df[seen].tolist(), docs_seen], [0] * len(seen) + [tokens_seen]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["term", "df", "total_dl"]
        )

    found = doc_tokens(docs, field, analyzer).select("toks").mapInArrow(count, "term string, df long, total_dl long")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total_dl").alias("total_dl")).filter("df > 0")


def slot_stats(
    docs: DataFrame,
    members: DataFrame,
    small: bool,
    field: str = "text",
    analyzer: str = "standard",
    lengths: tuple[int, ...] = (),
) -> DataFrame:
    """(slot, df, n_docs, avgdl) over all of ``docs``; a slot's df is the largest of its members.

    Document frequencies are counted for the query terms only; the number of
    documents and their total length come in the same pass as one pseudo-term.
    """
    looked_up = members.withColumn("term", F.explode(F.array("term", F.lit(_ALL_DOCS))))
    if small:
        terms = sorted(r["term"] for r in members.select("term").distinct().collect())  # measured
        stats = term_counts(docs, terms, field, analyzer)
    else:  # first the sums, so that a term of all documents meets the query terms as one row
        once = F.when(F.col("dl") > 0, F.array_append(F.array_distinct("toks"), F.lit(_ALL_DOCS)))
        seen = doc_tokens(docs, field, analyzer, lengths).select("dl", F.explode_outer(once).alias("term"))
        asked = looked_up.select("term").distinct()
        if fits(docs.sparkSession, measure(asked)):
            seen = seen.join(F.broadcast(asked), "term", "left_semi")
        sums = [F.count(F.lit(1)).alias("df"), F.sum("dl").alias("total_dl")]
        stats = seen.filter("term is not null").groupBy("term").agg(*sums)
    word = F.col("term") != _ALL_DOCS
    by_slot = (
        stats.join(hint_if(looked_up, small), "term")
        .groupBy("slot")
        .agg(
            F.max(F.when(word, F.col("df"))).alias("df"),
            F.max(F.when(~word, F.col("df"))).alias("n_docs"),
            F.max(F.when(~word, F.col("total_dl") / F.col("df"))).alias("avgdl"),
        )
    )
    return by_slot.filter("df is not null")


HOT_KEY_DOCS = 1_000_000


def _meet(rows: DataFrame, side: DataFrame, key: str, small: bool) -> DataFrame:
    """Document rows joined with the query-side rows of the same ``key``.

    Broadcast for a small query side. Otherwise a shuffle on the key, where the
    rows of a frequent key (``df`` of the query side) are cut into shards by
    document hash, about HOT_KEY_DOCS rows each, and its query rows are repeated
    per shard.
    """
    if small:
        return rows.join(F.broadcast(side.drop("df")), key)
    shards = F.greatest(F.lit(1), F.ceil(F.col("df") / HOT_KEY_DOCS)).cast("int")
    asked = side.withColumn("shards", shards)
    hot = asked.filter("shards > 1").groupBy(key).agg(F.max("shards").alias("cut"))
    spread = rows.join(hot, key, "left").withColumn(
        "shard", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("cut")).cast("int"), F.lit(0))
    )
    of_key = asked.join(hot, key, "left").withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.coalesce("cut", F.lit(1)) - 1))
    )
    return spread.drop("cut").join(of_key.drop("cut", "shards", "df"), [key, "shard"]).drop("shard")


@dataclass(frozen=True)
class QuerySide:
    """What the queries bring to the documents."""

    members: DataFrame  # slot, term
    stats: DataFrame  # slot, df, n_docs, avgdl
    weighed: DataFrame  # query_id, slot, weight, avgdl, df
    small: bool  # measured to fit a broadcast
    plain: bool  # no synonyms: every slot is its own term
    lengths: tuple[int, ...] = ()  # runs of tokens that are terms as well


def query_side(
    docs: DataFrame,
    queries: DataFrame,
    field: str = "text",
    analyzer: str = "standard",
    synonyms: DataFrame | None = None,
    small: bool | None = None,
) -> QuerySide:
    """Slots, their members and their weights from statistics over all of ``docs``."""
    rules = None if synonyms is None else synonym_lookup(synonyms, analyzer)
    terms = query_terms(queries, analyzer, rules)
    slots = terms.select("slot").distinct()
    if rules is None:
        members, lengths = slots.withColumn("term", F.col("slot")), ()
    else:
        terms = settle(terms)
        members = settle(expand_synonyms(terms.select("slot").distinct(), rules))
        lengths = tuple(n for n in rules.lengths if n > 1)
    if small is None:
        # Raw tokens bound the terms and need no shuffle to measure.
        small = fits(docs.sparkSession, measure(query_tokens(queries, analyzer)), copies=4)
        if synonyms is not None:
            small = small and fits(docs.sparkSession, measure(members), copies=4)
    stats = slot_stats(docs, members, small, field, analyzer, lengths)
    weighed = terms.join(stats, "slot").select(
        "query_id", "slot", (F.col("qtf") * S.idf(F.col("n_docs"), F.col("df"))).alias("weight"), "avgdl", "df"
    )
    return QuerySide(members, stats, weighed, small, synonyms is None, lengths)


def indexed_side(index: Index, queries: DataFrame, analyzer: str = "standard", synonyms: DataFrame | None = None) -> QuerySide:
    """The query side with the statistics of a stored index: no text is read. Synonym terms of
    several tokens must be among the runs that the index holds."""
    spark = queries.sparkSession
    rules = None if synonyms is None else synonym_lookup(synonyms, analyzer)
    missing = [] if rules is None else [n for n in rules.lengths if n > 1 and n not in index.lengths]
    if missing:
        raise ValueError(f"the rules have terms of {missing} tokens, which the index does not hold: build it with lengths={missing}")
    terms = query_terms(queries, analyzer, rules)
    terms = terms if rules is None else settle(terms)
    slots = terms.select("slot").distinct()
    members = slots.withColumn("term", F.col("slot")) if rules is None else settle(expand_synonyms(slots, rules))
    small = fits(spark, measure(members), copies=4)
    if index.totals is None:
        docs, length = index.doc_len.filter("dl > 0").agg(F.count(F.lit(1)), F.avg("dl")).first()
    else:
        docs, tokens_in_all = index.totals.first()
        length = tokens_in_all / docs if docs else None
    found = index.term_stats.join(hint_if(members, small), "term").groupBy("slot").agg(F.max("df").alias("df"))
    stats = found.select("slot", "df", F.lit(docs).alias("n_docs"), F.lit(length or 1.0).alias("avgdl"))
    weighed = terms.join(stats, "slot").select(
        "query_id", "slot", (F.col("qtf") * S.idf(F.col("n_docs"), F.col("df"))).alias("weight"), "avgdl", "df"
    )
    lengths = () if rules is None else tuple(n for n in rules.lengths if n > 1)
    return QuerySide(members, stats, weighed, small, rules is None, lengths)


def stored_postings(index: Index, side: QuerySide, signed: bool = False) -> DataFrame:
    """Postings of the query side's terms; of a small query side only their folders are read."""
    postings = index.signed if signed else index.postings
    if not side.small:
        return postings
    wanted = side.members.select("term").distinct()
    if index.buckets:
        folders = wanted.select(_term_bucket(index.buckets).alias("b")).distinct().collect()
        postings = postings.filter(F.col("bucket").isin([r["b"] for r in folders]))
    return postings.join(F.broadcast(wanted), "term", "left_semi")


def bm25_match(
    docs: DataFrame | None,
    queries: DataFrame,
    k1: float = K.BM25_K1,
    b: float = K.BM25_B,
    field: str = "text",
    analyzer: str = "standard",
    synonyms: DataFrame | None = None,
    small: bool | None = None,
    among: DataFrame | None = None,
    side: QuerySide | None = None,
    index: Index | None = None,
    best: int | None = None,
    blended: tuple[DataFrame, DataFrame, Callable] | None = None,
) -> DataFrame:
    """(query_id, doc_id, kw) for every document sharing a query term; with ``best`` at least
    the ``best`` first of each query, without a row per (query, document). ``blended`` (documents, queries, blend) has those first
    by ``posting_scan``'s blend of cosine and keyword score, as ``score``.

    ``docs`` is the corpus (partitioned by document, see :func:`by_document`);
    statistics are over all its rows, scores are given for the rows of ``among``
    (a filtered ``docs``) only. With synonyms the members of a slot are first
    added up per document, whatever the number of queries that use the slot. With a stored
    ``index`` (and its :func:`indexed_side`) no text is read, and ``among`` is left to the caller, but for ``best``.
    """
    if index is not None:
        side = side or indexed_side(index, queries, analyzer, synonyms)
        signed = best is not None and side.plain and index.signed is not None  # then the search adds them up
        postings = stored_postings(index, side, signed).select("doc_id", "term", "tf", "dl", *["sign"] * signed)
        if best is not None and among is not None:
            postings = postings.join(among.select("doc_id"), "doc_id", "left_semi")
    else:
        side = side or query_side(docs, queries, field, analyzer, synonyms, small)
        scored = docs if among is None else among
        asked = side.members.select("term").distinct()
        vocabulary = asked if side.small or fits(docs.sparkSession, measure(asked)) else None
        postings = build_postings(scored, field, analyzer, vocabulary, side.lengths)
    if side.plain:
        postings = postings.withColumnRenamed("term", "slot")
    else:
        sized = side.members if side.small else side.members.join(side.stats.select("slot", "df"), "slot")
        postings = (
            _meet(postings, sized, "term", side.small)
            .groupBy("doc_id", "dl", "slot")
            .agg(F.sum("tf").alias("tf"))
        )
    if best is not None:
        return best_matches(postings, side.weighed, best, k1, b, *(blended or ()))
    hit = _meet(postings, side.weighed, "slot", side.small)
    part = S.bm25(F.col("weight"), F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return hit.groupBy("query_id", "doc_id").agg(keep(F.sum(part)).alias("kw"))
