"""Approximate neighbours by product quantisation."""

import numpy as np
import pytest

from strata.operators import quantized as PQ
from strata.sizing import Size

RNG = np.random.default_rng(5)
MANY = Size(5000, 1 << 40)  # measured as too large for a broadcast


@pytest.fixture(scope="module")
def spread(spark):
    """900 vectors of 13 numbers without clusters, a tenth of them copies of one; some without a direction."""
    v = RNG.normal(size=(900, 13))
    v[:90] = v[0]
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v)] + [(2000, None, 0), (2001, [0.0] * 13, 0), (2002, [], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, vector array<double>, kind int").repartition(5)
    q = np.vstack([v[0], RNG.normal(size=(11, 13))])
    asked = [(i, x.tolist()) for i, x in enumerate(q)] + [(99, None)]
    return docs, spark.createDataFrame(asked, "query_id int, query_vector array<double>"), v, q


def brute(v, q, k, ids):
    out = []
    for j, x in enumerate(q):
        cos = np.round(v[ids] @ x / np.linalg.norm(v[ids], axis=1) / np.linalg.norm(x), 9)
        out += [(j, r + 1, d) for r, (_, d) in enumerate(sorted(zip(-cos, ids))[:k])]
    return out


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"]) for r in df.collect())


def test_codes_are_those_of_the_nearest_centroids(spread):
    docs, _, v, _ = spread
    books = PQ.train_codebooks(docs, subspaces=4, centroids=30)
    assert books.centroids.shape == (4, 30, 4) and books.width == 13
    got = {r.doc_id: list(r.code) for r in PQ.encode(docs, books).collect()}
    assert sorted(got) == list(range(900))
    units = np.pad(v / np.linalg.norm(v, axis=1, keepdims=True), ((0, 0), (0, 3))).reshape(900, 4, 4)
    for i in range(0, 900, 37):
        want = [int(((units[i, j] - books.centroids[j]) ** 2).sum(axis=1).argmin()) for j in range(4)]
        assert got[i] == want


def test_training_lowers_the_error_and_reruns_agree(spread):
    docs, _, v, _ = spread
    units = np.pad(v / np.linalg.norm(v, axis=1, keepdims=True), ((0, 0), (0, 3)))

    def error(books):
        parts = books.centroids[np.arange(4)[None], books.codes(units[:, :13])]
        return ((parts.reshape(900, 16) - units) ** 2).sum()

    trained = PQ.train_codebooks(docs, subspaces=4, centroids=30)
    again = PQ.train_codebooks(docs.repartition(3), subspaces=4, centroids=30)
    assert np.allclose(trained.centroids, again.centroids)
    points = units.reshape(900, 4, 4)
    untrained = PQ.Codebooks(np.stack([PQ._fitted(points[:, j], 30, 0) for j in range(4)]), 13)
    assert error(trained) < 0.8 * error(untrained)


@pytest.mark.parametrize("size", [None, MANY])
def test_candidates_are_the_best_by_codes(spread, monkeypatch, size):
    """Both ways, shards and blocks of a few rows, against sums over the centroids."""
    monkeypatch.setattr(PQ, "SHARD_CODES", 250)
    monkeypatch.setattr(PQ, "BLOCK_QUERIES", 1000)
    docs, queries, v, q = spread
    books = PQ.train_codebooks(docs, subspaces=4, centroids=30)
    codes = PQ.encode(docs, books)
    got = sorted((r.query_id, r.doc_id) for r in PQ.candidates(codes, queries, books, 40, size=size).collect())
    near = books.centroids[np.arange(4)[None], books.codes(v / np.linalg.norm(v, axis=1, keepdims=True))].reshape(900, 16)
    want = []
    for j, x in enumerate(q):
        approx = np.round(near @ np.pad(x / np.linalg.norm(x), (0, 3)), 9)
        want += [(j, d) for _, d in sorted(zip(-approx, range(900)))[:40]]
    assert got == sorted(want)


@pytest.mark.parametrize("size", [None, MANY])
def test_enough_candidates_give_the_exact_result(spread, size):
    docs, queries, v, q = spread
    books = PQ.train_codebooks(docs, subspaces=3, centroids=8)
    got = rows(PQ.knn_quantized(docs, PQ.encode(docs, books), queries, books, 7, 900, size=size))
    assert got == brute(v, q, 7, list(range(900)))


def test_a_filter_holds_before_the_candidates_are_cut(spread):
    docs, queries, v, q = spread
    books = PQ.train_codebooks(docs)
    codes = PQ.encode(docs, books, keep_columns=("kind",)).filter("kind = 1")
    near = PQ.knn_quantized(docs, codes, queries, books, 10, 60)
    want = brute(v, q, 10, list(range(1, 900, 3)))
    assert len(rows(near)) == len(want) and len(set(rows(near)) & set(want)) >= 0.9 * len(want)


def test_a_sample_is_enough_to_fit_and_everything_is_coded(spread):
    docs, *_ = spread
    books = PQ.train_codebooks(docs, subspaces=4, centroids=16, sample=200)
    assert PQ.encode(docs, books).count() == 900


def test_misfits_are_errors(spark, spread):
    docs, queries, *_ = spread
    books = PQ.train_codebooks(docs, subspaces=4, centroids=8)
    codes = PQ.encode(docs, books)
    with pytest.raises(ValueError):
        PQ.knn_quantized(docs, codes, queries, books, 10, 5)
    narrow = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, query_vector array<double>")
    with pytest.raises(ValueError, match="width"):
        PQ.knn_quantized(docs, codes, narrow, books, 5)
    with pytest.raises(ValueError, match="no vectors"):
        PQ.train_codebooks(docs.filter("doc_id >= 2000"))
    none = queries.filter("query_id = 99")
    assert PQ.knn_quantized(docs, codes, none, books, 5).count() == 0
    assert PQ.knn_quantized(docs, codes.limit(0), queries, books, 5).count() == 0
