"""The weighted search over a stored index scores matches in tasks."""

import random

import pytest
from pyspark.sql import functions as F

from strata.operators import fusion as FU
from strata.operators import lexical as L
from strata.operators import posting_scan as PS

WORDS = ["the", "of", "cat", "dog", "sun", "moon"]


@pytest.mark.parametrize("groups, block", [(1_000_000, 256), (3, 2)])
@pytest.mark.parametrize("mode", ["raw", "saturation", "log1p"])
def test_blended_matches_are_the_first_of_the_weighted_fusion(spark, tmp_path, monkeypatch, groups, block, mode):
    monkeypatch.setattr(PS, "GROUP_ROWS", groups)
    monkeypatch.setattr(PS, "BLOCK_QUERIES", block)
    rng = random.Random(3)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    docs = [(f"d{i:03d}", " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 12))), vector() if i % 4 else None) for i in range(90)]
    docs += [docs[1], ("d002", docs[2][1], vector()), ("zero", "cat", [0.0] * 4), (None, "cat dog", vector())]  # repeated and missing ids
    asked = [(i, f"{WORDS[i % 6]} {WORDS[i % 5]} unseen", vector()) for i in range(8)]
    asked += [asked[1], (2, "sun", vector()), (20, "cat", None), (None, "dog", vector()), (21, "absent", vector())]
    corpus = spark.createDataFrame(docs, "doc_id string, text string, vector array<double>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id int, query_text string, query_vector array<double>")
    L.write_index(L.build_index(L.by_document(corpus.select("doc_id", "text"))), str(tmp_path / "index"))
    index, held = L.read_index(spark, str(tmp_path / "index")), corpus.filter("vector is not null")
    blend = (0.6, 0.4, mode, 5.0, 3.0)
    none = spark.createDataFrame([], "query_id int, doc_id string, sim double")
    want = FU.fuse_weighted(L.bm25_match(None, queries, index=index), none, held, queries, 4, True, *blend)
    best = L.bm25_match(None, queries, index=index, best=4, blended=(held, queries, FU.blend_of(*blend)))
    got = FU.fuse_best(best, none, 4, blend[0])
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id, pytest.approx(r.score, abs=1e-9)) for r in df.collect())
    assert [(q, n, d) for q, n, d, _ in key(got)] == [(q, n, d) for q, n, d, _ in key(want)] and len(key(got)) > 20
    assert {(r.query_id, r.doc_id): r.score for r in got.collect()} == pytest.approx({(r.query_id, r.doc_id): r.score for r in want.collect()}, abs=1e-8)
    pairs = L.bm25_match(None, queries, index=index).count()
    assert best.count() <= 8 * len(asked) * 4 and (groups < 10 or best.filter(F.col("query_id") == 1).count() < pairs)
