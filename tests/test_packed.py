"""Shuffles of packed rows, and postings counted where the texts are."""

import pytest
from pyspark.sql import functions as F

from strata import packed as P
from strata.operators import index_batches as IB
from strata.operators import lexical as L

KINDS = "doc_id string, term string, tf long, x double, v array<double>, to int"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("rows, size", [(250_000, 1 << 24), (3, 1 << 24), (250_000, 1)])
def test_dealt_rows_are_the_same_and_together(spark, monkeypatch, rows, size):
    monkeypatch.setattr(P, "PIECE_ROWS", rows)
    monkeypatch.setattr(P, "PIECE_BYTES", size)
    made = [(f"d{i % 7}" if i % 5 else None, "red" if i % 3 else None, i, i / 3, [float(i), 0.5] if i % 4 else None, i % 3) for i in range(50)]
    df = spark.createDataFrame(made, KINDS).repartition(4)
    dealt = P.deal(df, 4, "to")
    assert dealt.schema == df.drop("to").schema and rows_of(dealt) == rows_of(df.drop("to"))
    at = dealt.withColumn("at", F.spark_partition_id())
    assert {(r.tf % 3, r["at"]) for r in at.collect()} == {(0, 0), (1, 1), (2, 2)}
    assert P.deal(df.filter("to > 9"), 4, "to").count() == 0


def test_packed_rows_are_a_quarter_of_their_text(spark):
    df = spark.range(100_000).select(F.concat(F.lit("document "), F.floor(F.col("id") / 100).cast("string")).alias("doc_id"),
                                     F.concat(F.lit("word "), (F.col("id") * 7919 % 1000).cast("string")).alias("term"), (F.col("id") % 3).alias("to"))
    size = P.pieces(df, "to").agg(F.sum(F.length("piece"))).first()[0]
    assert 4 * size < df.agg(F.sum(F.length("doc_id") + F.length("term"))).first()[0]


def test_postings_of_one_row_a_document_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([("a", "red fox red"), ("b", ""), ("c", None), ("d", "fox " * 40 + "hen"), (None, "owl")], "doc_id string, text string")
    got = L.counted_postings(docs, lengths=(2,))
    assert rows_of(got) == rows_of(L.build_postings(docs, lengths=(2,)))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_batch_with_repeated_ids_has_their_sums(spark, tmp_path):
    docs = spark.createDataFrame([("a", "red fox"), ("a", "red fox"), ("b", "hen")], "doc_id string, text string")
    IB.add_batch(docs, str(tmp_path / "index"), 0)
    IB.add_batch(docs.filter("doc_id = 'b'"), str(tmp_path / "index"), 1)
    index = IB.open_index(spark, str(tmp_path / "index"))
    assert rows_of(index.postings.select("doc_id", "term", "tf", "dl")) == [("a", "fox", 2, 2), ("a", "red", 2, 2), ("b", "hen", 1, 1)]
    asked = spark.createDataFrame([(1, "red hen")], "query_id int, query_text string")
    every, best = L.bm25_match(None, asked, index=index), L.bm25_match(None, asked, index=index, best=2)
    assert rows_of(every) == rows_of(best) and every.count() == 2
