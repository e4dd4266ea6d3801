"""Vector operators: fixed payloads, rejects, user encoders."""

import json

import pytest
from pyspark.sql import functions as F

from strata.functions.vector import cosine_clamped, l2_normalize
from strata.operators import corpus as A
from strata.operators import vectors as V


def parse(spark, *bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "response_id int, body string")
    out = {}
    for r in V.parse_embedding_responses(df).orderBy("response_id", "pos").collect():
        out.setdefault(r.response_id, []).append(r.vector)
    return [out.get(i, []) for i in range(len(bodies))]


def test_response_shapes(spark):
    a = {"inference_results": [{"predicted_value": [0.1, 0.2, 0.3]}, {"predicted_value": [1.0, 0.0, 0.0]}]}
    b = {"text_embedding": [{"embedding": [0.5, 0.5]}, {"embedding": [2.0, 3.0]}]}
    mixed = {"inference_results": [3, {"predicted_value": [], "embedding": [1, 2]}, {"predicted_value": ["x"]}]}
    both = {"inference_results": [{"other": 1}], "text_embedding": [{"predicted_value": [4]}]}
    got = parse(spark, *map(json.dumps, (a, b, mixed, both)), "[]", "nope", json.dumps({"text_embedding": 5}))
    assert got == [
        [[0.1, 0.2, 0.3], [1.0, 0.0, 0.0]],
        [[0.5, 0.5], [2.0, 3.0]],
        [[1.0, 2.0]],
        [[4.0]],
        [],
        [],
        [],
    ]


def test_normalize_and_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([], [])], "a array<double>, b array<double>")
    rows = df.select(l2_normalize(F.col("a")).alias("n"), cosine_clamped(F.col("a"), F.col("b")).alias("c")).collect()
    assert rows[0].n == [0.6, 0.8] and abs(rows[0].c - 0.96) < 1e-12
    assert rows[1].n == [0.0, 0.0] and rows[1].c is None
    assert rows[2].n == []


def test_expression_rejects(spark):
    terms = spark.createDataFrame(
        [(1, "a", 1), (1, "b", -1), (2, "a", -1), (3, "x", 1), (4, "a", 1), (4, "a", -1)],
        "expr_id int, term string, sign int",
    )
    vectors = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [0.0, 1.0])], "term string, vector array<double>")
    found, rejects = V.vector_expression(terms, vectors)
    assert [(r.expr_id, r.vector) for r in found.collect()] == [(1, [1.0, 0.0])]
    assert {r.expr_id: r.reason for r in rejects.collect()} == {2: "no plus term", 3: "unknown term", 4: "zero vector"}


def test_user_encoder(spark):
    class LengthEncoder:
        def encode_passages(self, texts, *, batch_size):
            assert len(texts) <= batch_size
            return [[float(len(t)), 1.0] for t in texts]

        def encode_queries(self, texts, *, batch_size):
            return [[float(len(t)), 2.0] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string")
    by = lambda kind: {r.id: r.vector for r in V.embed(df, LengthEncoder, kind, batch_size=1).collect()}
    assert by("passage") == {1: [3.0, 1.0], 2: [0.0, 1.0]}
    assert by("query") == {1: [3.0, 2.0], 2: [0.0, 2.0]}
    texts = df.select(V.with_prefix(F.col("text"), "passage").alias("t")).collect()
    assert [r.t for r in texts] == ["passage: abc", "passage: "]


def test_hashing_encoder_keeps_empty_texts(spark):
    df = spark.createDataFrame([("a", "x y"), ("b", ""), ("c", None)], "doc_id string, text string")
    got = {r.doc_id: r.vector for r in V.hashing_embed(df, "doc_id", dims=8).collect()}
    assert set(got) == {"a", "b", "c"} and got["b"] == [0.0] * 8 and len(got["a"]) == 8


def test_vector_widths(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "doc_id string, vector array<float>")
    assert A.check_vector_dims(df, 2).count() == 2
    with pytest.raises(Exception, match="expected 3 dims"):
        A.check_vector_dims(df, 3).collect()
    asked = spark.createDataFrame([(1, [1.0])], "query_id int, query_vector array<float>")
    assert [r.dims for r in A.same_dims(asked, df).collect()] == [1]
