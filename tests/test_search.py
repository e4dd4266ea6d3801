"""Search operators: brute force, hot groups, and the two ways of each join."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.functions.score import auto_rerank, normalize_keyword, term_density
from strata.operators import lexical as L
from strata.operators import neighbors as N
from strata.operators import posting_scan as PS
from strata.operators.fusion import fuse_rrf, fuse_weighted, fuse_weighted_scan
from strata.operators.keyword_scan import bm25_top, keyword_matrix, match_totals
from strata.operators.hits import collapse_by_chapter, format_hits
from strata.plans.hybrid import SearchOptions, hybrid_search
from strata.sources.term_files import parse_synonym_rules
from workload.queries import REGISTRY

RNG = np.random.default_rng(7)


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def clustered(spark):
    """600 vectors around 5 centres; a third are copies of one vector."""
    centres = RNG.normal(size=(5, 8))
    v = centres[RNG.integers(0, 5, 600)] + 0.15 * RNG.normal(size=(600, 8))
    v[:200] = v[0]
    docs = spark.createDataFrame([(f"d{i:03d}", x.tolist()) for i, x in enumerate(v)], "doc_id string, vector array<double>")
    q = centres[[0, 1, 2, 3]] + 0.1 * RNG.normal(size=(4, 8))
    q[0] = v[0]
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id int, query_vector array<double>")
    return docs.repartition(5), queries, v, q


def brute(v, q, k):
    out = []
    for j, x in enumerate(q):
        cos = np.round(v @ x / np.linalg.norm(v, axis=1) / np.linalg.norm(x), 9)
        best = sorted((-c, f"d{i:03d}") for i, c in enumerate(cos))[:k]
        out += [(j, r + 1, d) for r, (_, d) in enumerate(best)]
    return out


@pytest.mark.parametrize("k", [1, 7, 250])
def test_exact_search_both_ways(clustered, monkeypatch, k):
    docs, queries, v, q = clustered
    want = brute(v, q, k)
    assert rows_of(N.knn_exact(docs, queries, k), "query_id", "rank", "doc_id") == want
    monkeypatch.setattr(N, "SHARD_ROWS", 64)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 2)
    cells = N.seed_cells(docs, 12)
    assert rows_of(N.knn_exact(docs, queries, k, cells=cells), "query_id", "rank", "doc_id") == want


def test_cells_are_left_out_only_when_safe():
    centroids = np.eye(3)
    q = np.array([[1.0, 0.05, 0.0]])
    q /= np.linalg.norm(q)
    n, radius = np.array([5, 5, 5]), np.array([0.1, 0.1, 0.1])
    assert list(N.cells_to_visit(q, centroids, n, radius, 3)[0]) == [0]
    assert list(N.cells_to_visit(q, centroids, n, radius, 6)[0]) == [0, 1, 2]


def test_top_k_beyond_the_early_limit(spark):
    df = spark.range(5000).select(F.lit(1).alias("q"), F.col("id").cast("string").alias("d"), (F.col("id") * 7 % 5000).alias("s"))
    got = rows_of(N.top_k(df, "q", [F.col("s").desc()], 1500, "d"), "rank", "s")
    assert got == [(r, 5000 - r) for r in range(1, 1501)]


WORDS = ["the", "of", "cat", "dog", "sun", "moon", "刘", "x1"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    docs = [("d%03d" % i, " ".join(["the"] * 3 + [rng.choice(WORDS) for _ in range(rng.randint(1, 30))])) for i in range(120)]
    docs += [("e1", ""), ("e2", None), ("e3", "nothing shared")]
    queries = [(1, "the Cat the"), (2, "moon dog zebra"), (3, "刘"), (4, "unseen")]
    frame = spark.createDataFrame(docs, "doc_id string, text string")
    return L.by_document(frame), spark.createDataFrame(queries, "query_id int, query_text string"), docs, queries


def loop_bm25(docs, queries, expand=lambda t: [t]):
    toks = {d: [w.lower() for w in (t or "").split()] for d, t in docs}
    toks = {d: t for d, t in toks.items() if t}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    count = lambda t, m: sum(t[i : i + len(m.split())] == m.split() for i in range(len(t)))
    out = {}
    for q, text in queries:
        for w in text.lower().split():
            df = {m: sum(count(t, m) > 0 for t in toks.values()) for m in expand(w)}
            members = [m for m in df if df[m]]
            if not members:
                continue
            top = max(df[m] for m in members)
            for d, t in toks.items():
                tf = sum(count(t, m) for m in set(members))
                if tf:
                    part = math.log(1 + (n - top + 0.5) / (top + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
                    out[q, d] = out.get((q, d), 0) + part
    return {k: round(v, 9) for k, v in out.items()}


def matched(df):
    return {(r.query_id, r.doc_id): r.kw for r in df.collect()}


def test_bm25_matches_the_loop_both_ways(texts, monkeypatch):
    docs, queries, raw, asked = texts
    want = loop_bm25(raw, asked)
    assert matched(L.bm25_match(docs, queries)) == pytest.approx(want, abs=1e-8)
    monkeypatch.setattr(L, "HOT_KEY_DOCS", 10)
    assert matched(L.bm25_match(docs, queries, small=False)) == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("small", [None, False])
def test_top_keyword_hits_both_ways(spark, texts, small):
    docs, queries, raw, asked = texts
    rules = parse_synonym_rules(spark.createDataFrame([(1, "cat, sun")], "rule_id int, line string"))
    for synonyms, table in ((None, {}), (rules, {"cat": ["cat", "sun"]})):
        scores = loop_bm25(raw, asked, lambda t, table=table: table.get(t, [t]))
        want = []
        for q in (1, 2, 3, 4):
            best = sorted((-v, d) for (j, d), v in scores.items() if j == q)[:5]
            want += [(q, r + 1, d) for r, (_, d) in enumerate(best)]
        got = bm25_top(docs, queries, 5, synonyms=synonyms, small=small)
        assert rows_of(got, "query_id", "rank", "doc_id") == want


@pytest.mark.parametrize("groups, block", [(400_000, 256), (3, 2)])
def test_best_matches_are_the_first_of_all_matches(spark, texts, monkeypatch, groups, block):
    """Postings meet the queries in blocks and groups, without a row per (query, document); a missing id is one document."""
    monkeypatch.setattr(PS, "GROUP_ROWS", groups)
    monkeypatch.setattr(PS, "BLOCK_QUERIES", block)
    docs, queries, raw, asked = texts
    docs = docs.unionByName(spark.createDataFrame([(None, "the moon dog dog"), ("d001", "cat dog")], "doc_id string, text string"))
    rules = parse_synonym_rules(spark.createDataFrame([(1, "cat, sun"), (2, "moon => the, x1")], "rule_id int, line string"))
    order = [F.col("kw").desc(), F.col("doc_id")]
    for options in ({}, {"synonyms": rules}):
        for small in (None, False):
            every = N.top_k(L.bm25_match(docs, queries, small=small, **options), "query_id", order, 5, "doc_id")
            best = L.bm25_match(docs, queries, small=small, best=5, **options)
            got = N.top_k(best, "query_id", order, 5, "doc_id")
            key = lambda df: sorted((r.query_id, r["rank"], str(r.doc_id), r.kw) for r in df.collect())
            assert key(got) == key(every) and len(key(got)) == 15
            assert best.count() <= 5 * 3 * 8  # of each query and task, not of each document


def test_searches_by_index_give_the_best_only(spark, texts, tmp_path):
    docs, queries, raw, asked = texts
    L.write_index(L.build_index(docs), str(tmp_path / "index"))
    among = docs.filter("doc_id < 'd050'")
    index = L.read_index(spark, str(tmp_path / "index"))
    best = L.bm25_match(None, queries, index=index, among=among, best=4)
    got = N.top_k(best, "query_id", [F.col("kw").desc(), F.col("doc_id")], 4, "doc_id")
    scores = loop_bm25(raw, asked)
    want = []
    for q in (1, 2, 3, 4):
        first = sorted((-v, d) for (j, d), v in scores.items() if j == q and d < "d050")[:4]
        want += [(q, r + 1, d) for r, (_, d) in enumerate(first)]
    assert rows_of(got, "query_id", "rank", "doc_id") == want


def test_chat_search_asks_every_conversation(spark):
    sf = "/root/testdata/sf0.001"
    found = {r.query_id for r in REGISTRY["bm25_chat"](spark, sf).select("query_id").distinct().collect()}
    users = spark.read.parquet(f"{sf}/conversations.parquet").filter("role = 'user'")
    assert found == {r.conv_id for r in users.select("conv_id").distinct().collect()} and len(found) > 1


def test_counts_and_hits_share_a_query_side(texts):
    docs, queries, *_ = texts
    side = L.query_side(docs, queries)
    for run in (lambda **o: match_totals(docs, queries, **o), lambda **o: bm25_top(docs, queries, 3, **o)):
        assert sorted(map(tuple, run(side=side).collect())) == sorted(map(tuple, run().collect()))


def test_totals_both_ways(texts):
    docs, queries, raw, asked = texts
    want = {}
    for query, _ in loop_bm25(raw, asked):
        want[query] = want.get(query, 0) + 1
    for small in (None, False):
        assert {r.query_id: r.total for r in match_totals(docs, queries, small=small).collect() if r.total} == want


def test_statistics_cover_documents_that_are_not_scored(texts):
    docs, queries, raw, asked = texts
    want = {k: v for k, v in loop_bm25(raw, asked).items() if k[1] < "d050"}
    got = matched(L.bm25_match(docs, queries, among=docs.filter("doc_id < 'd050'")))
    assert got == pytest.approx(want, abs=1e-8)


def test_synonyms_expand_the_query_only(spark, texts):
    docs, queries, raw, asked = texts
    lines = [(1, "cat, sun"), (2, "# no"), (3, "moon => of, x1"), (4, "zebra, the dog")]
    rules = parse_synonym_rules(spark.createDataFrame(lines, "rule_id int, line string"))
    table = {"cat": ["cat", "sun"], "moon": ["of", "x1"], "zebra": ["zebra", "the dog"]}
    want = loop_bm25(raw, asked, lambda t: table.get(t, [t]))
    assert matched(L.bm25_match(docs, queries, synonyms=rules)) == pytest.approx(want, abs=1e-8)
    assert matched(L.bm25_match(docs, queries, synonyms=rules, small=False)) == pytest.approx(want, abs=1e-8)
    top = bm25_top(docs, queries, 400, synonyms=rules)
    assert {(r.query_id, r.doc_id): r.kw for r in top.collect()} == pytest.approx(want, abs=1e-8)


def test_rules_of_several_tokens_find_each_other(spark):
    """Names written with several ideographs are sequences of tokens."""
    lines = [(1, "孔明, 诸葛亮, 卧龙"), (2, "a b c, x"), (3, "a b => y z")]
    rules = parse_synonym_rules(spark.createDataFrame(lines, "rule_id int, line string"))
    docs = spark.createDataFrame([("d1", "诸葛亮来"), ("d2", "孔 明"), ("d3", "明孔"), ("d4", "y z y z"), ("d5", "z y")], "doc_id string, text string")
    queries = spark.createDataFrame([(1, "孔明"), (2, "a b"), (3, "a b c"), (4, "卧龙 明")], "query_id int, query_text string")
    for small in (None, False):
        found = {(r.query_id, r.doc_id) for r in L.bm25_match(docs, queries, synonyms=rules, small=small).collect()}
        assert found == {(1, "d1"), (1, "d2"), (2, "d4"), (4, "d1"), (4, "d2"), (4, "d3")}
    terms = {(r.query_id, r.term) for r in L.query_tokens(queries, rules=L.synonym_lookup(rules)).collect()}
    assert terms == {(1, "孔\x1f明"), (2, "a\x1fb"), (3, "a\x1fb\x1fc"), (4, "卧\x1f龙"), (4, "明")}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ties_go_by_the_type_of_the_id(spark, kind):
    docs = spark.range(1, 31).select(
        F.col("id").cast(kind).alias("doc_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"), F.lit("same text").alias("text")
    ).repartition(5)
    queries = spark.createDataFrame([(1, "same", [2.0, 1.0])], "query_id int, query_text string, query_vector array<double>")
    want = [1, 2, 3] if kind == "long" else ["1", "10", "11"]
    plain = N.knn_exact(docs, queries, 3)
    cells = N.knn_exact(docs, queries, 3, cells=N.seed_cells(docs, 4))
    keyword = [bm25_top(docs, queries, 3, small=small) for small in (None, False)]
    for found in (plain, cells, *keyword):
        assert [r.doc_id for r in found.orderBy("rank").collect()] == want


def test_weights_and_widths_are_checked_before_the_search(spark):
    for weights in ((-1.0, 1.0), (0.0, 0.0)):
        with pytest.raises(ValueError):
            SearchOptions(vector_weight=weights[0], keyword_weight=weights[1])
    docs = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "doc_id string, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<double>")
    with pytest.raises(Exception, match="expected 2 dims, found 1"):
        N.knn_exact(docs, queries, 1).collect()


def test_written_index_holds_the_statistics(spark, texts, tmp_path):
    docs, *_ = texts
    index = L.build_index(docs)
    L.write_index(index, str(tmp_path / "index"))
    stats = spark.read.parquet(str(tmp_path / "index" / "term_stats"))
    assert rows_of(stats, "term", "df") == rows_of(index.term_stats, "term", "df")


@pytest.fixture(scope="module")
def small_corpus(spark, texts):
    docs, queries, raw, _ = texts
    v = {d: RNG.normal(size=6).tolist() for d, _ in raw if d != "d007"}
    rows = [(d, t, v.get(d), f"chapter_{i // 10:04d}", i % 10, "chapter_summary" if i % 11 == 10 else None) for i, (d, t) in enumerate(raw)]
    corpus = spark.createDataFrame(
        rows, "doc_id string, text string, vector array<float>, chapter_id string, chunk_index int, doc_kind string"
    )
    asked = queries.withColumn("query_vector", F.array(*[F.sin(F.col("query_id") * i).cast("float") for i in range(1, 7)]))
    return corpus, asked


@pytest.mark.parametrize("mode", ["raw", "saturation", "log1p"])
def test_pruned_fusion_is_exact(small_corpus, mode):
    corpus, queries = small_corpus
    docs = L.by_document(corpus)
    eligible = L.has_vector(L.chunks_only(docs))
    matches = L.bm25_match(docs, queries, among=eligible)
    nearest = N.knn(eligible, queries, 8, clamped=True)
    pruned = fuse_weighted(matches, nearest, eligible, queries, 8, True, mode=mode)
    matrix = keyword_matrix(L.query_side(docs, queries))
    full = fuse_weighted_scan(matrix, eligible, queries, 8, mode=mode)
    assert rows_of(pruned, "query_id", "rank", "doc_id", "score") == rows_of(full, "query_id", "rank", "doc_id", "score")
    assert full.count() == 32


def test_hybrid_search_excludes_summaries_and_reranks_names(small_corpus):
    corpus, queries = small_corpus
    for mode in ("weighted", "rrf"):
        auto = hybrid_search(corpus, queries, SearchOptions(mode=mode, k=5))
        kinds = auto.join(corpus.select("doc_id", "doc_kind"), "doc_id").filter("doc_kind is not null")
        assert kinds.count() == 0
        plain = rows_of(hybrid_search(corpus, queries, SearchOptions(mode=mode, k=5, name_rerank=False)), "query_id", "rank", "doc_id")
        mixed = rows_of(auto, "query_id", "rank", "doc_id")
        # Only query 3 is a short text; the others keep their order.
        assert [r for r in mixed if r[0] != 3] == [r for r in plain if r[0] != 3]


def test_blank_queries_are_rejected(small_corpus):
    corpus, queries = small_corpus
    blank = queries.withColumn("query_text", F.lit(" "))
    with pytest.raises(Exception, match="blank query"):
        hybrid_search(corpus, blank).collect()


def test_rrf_rewards_both_legs(spark):
    schema = "query_id int, doc_id string, rank int"
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], schema)
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], schema)
    got = [(r.doc_id, r.score) for r in fuse_rrf(a, b, 3).orderBy("rank").collect()]
    assert got == [("y", 1 / 62 + 1 / 61), ("x", 1 / 61), ("z", 1 / 62)]


def test_score_functions(spark):
    row = spark.range(1).select(
        normalize_keyword(F.lit(-2.0)), normalize_keyword(F.lit(5.0), "raw"), normalize_keyword(F.lit(1e9), "log1p"),
        term_density(F.lit(" aa "), F.lit("aaaa b")), term_density(F.lit("zz"), F.lit("a")), term_density(F.lit(""), F.lit("a")),
        auto_rerank(F.lit("刘备")), auto_rerank(F.lit("a b")), auto_rerank(F.lit("abcde")), auto_rerank(F.lit(" ")),
    ).first()
    assert row[0] == 0.0 and row[1] == 5.0 and row[2] == 1.0
    assert row[3] == pytest.approx(math.log(3) + 4.0) and row[4] == 0.0 and row[5] == 0.0
    assert list(row[6:]) == [True, False, False, False]


def test_hits_are_formatted_and_collapsed(spark):
    rows = [(1, "a", 1, 0.5, "x" * 5000, "c1", 0), (1, "b", 2, 0.9, None, "c1", 1), (1, "c", 3, None, "t", " ", 2), (1, "d", 4, 0.9, "t", None, 3)]
    hits = spark.createDataFrame(rows, "query_id int, doc_id string, rank int, score double, text string, chapter_id string, chunk_index int")
    shown = format_hits(hits).orderBy("rank").collect()
    assert [(r.doc_id, len(r.text), r.text_truncated) for r in shown] == [("b", 0, False), ("d", 1, False), ("a", 4000, True), ("c", 1, False)]
    merged = collapse_by_chapter(hits).orderBy("rank").collect()
    assert [(r.doc_id, r.merged_from) for r in merged] == [("b", 2), ("d", 1), ("c", 1)]
