"""Registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import attention_lm, block_naming, chosen_path, filter_audit, language, licences, mixing, packing, page_text, spelling, surrogates, templates, warc
from strata.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


#: Key of the registered query; a user passes a secret one.
SURROGATE_KEY = b"registered query"


@query
def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surrogates.with_surrogates(table(spark, sf_dir, "documents"), SURROGATE_KEY)
    counts = F.transform(F.array_sort(F.map_entries("entities")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return found.select("doc_id", "text", F.array_join(counts, " ").alias("entities"))


@query
def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back as chunk rows, one row per record."""
    manifest = warc.archive_pages(table(spark, sf_dir, "pages"))
    return warc.record_table(warc.read_archives(manifest)).select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query
def op3_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(table(spark, sf_dir, "documents"))


@query
def op4_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_texts(table(spark, sf_dir, "documents"))


@query
def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_groups(table(spark, sf_dir, "documents"))


@query
def op7_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.learnt_and_identified(table(spark, sf_dir, "documents"))


@query
def op8_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.recognise(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.array_join("sentence_ids", " ").alias("sentence_ids"),
        F.array_join("licences", " ").alias("licences"),
    )


@query
def op9_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, a row per document and item."""
    found = templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


@query
def op10_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_groups(table(spark, sf_dir, "documents"))


@query
def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
