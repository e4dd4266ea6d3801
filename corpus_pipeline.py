"""A corpus pipeline of five operators: each stage works on all rows its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and gives a DataFrame, which
is written as Parquet and read again as the docs of the next one. All but the last give the
columns of their docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import block_naming, chosen_path, language, mixing, templates
from strata.llm.tables import table, written

NEAR_PERCENT = 80
#: The cosine of unrelated vectors has this inverse square root as its deviation; five of them are not chance.
LEAST_COSINE = 5 / language.DIMS**0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that resemble no language of the labelled ones beyond chance, or have no letter."""
    places = [f"c{i}" for i in range(len(docs.columns))]  # no column of the documents has the name of an added one
    found = language.identify(docs.toDF(*places), language.profiles(docs), places[docs.columns.index("text")])
    kept = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_COSINE))
    return kept.select(*places).toDF(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space."""
    return block_naming.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles, similarity 0.8 or more, hold together."""
    return chosen_path.one_of_each(docs, NEAR_PERCENT)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item, re-parameterised ones included."""
    return templates.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights ask for, numbered by ``copy``."""
    return mixing.mix(docs)


STAGES = [
    ("language", known_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

#: No counterpart: SQL does not express the learnt and the recursive stages; tests/llm compares
#: the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
