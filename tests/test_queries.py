"""Every registered query against its DuckDB counterpart, and checks of the plans."""

import pytest
from check import compare, connect

import __spark_entry__ as entry
from workload.oracle import ORACLE
from workload.queries import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, con, name):
    assert compare(spark, con, SF, REGISTRY[name], ORACLE[name]).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(ORACLE)))
def test_query_without_counterpart_runs(spark, name):
    assert REGISTRY[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "query_id", "doc_id", "rank", "score", "text", "text_truncated", "chapter_id", "chunk_index",
    ]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(spark, name):
    return REGISTRY[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["bm25_top10", "hybrid_rrf", "knn_top10"])
def test_top_k_is_cut_before_the_shuffle(spark, name):
    assert "Partial" in [line for line in plan(spark, name).split("\n") if "WindowGroupLimit" in line][-1]


@pytest.mark.parametrize(
    "name", ["bm25_top10", "hybrid_weighted_saturation", "hybrid_rrf", "knn_top10", "entity_profiles", "chapters_assembled"]
)
def test_no_cross_product(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["chunks", "noise_dropped", "sentences", "chapters_by_heading", "sections_marked"])
def test_text_preparation_does_not_shuffle(spark, name):
    """The one exchange spreads the single test file over the cores."""
    assert plan(spark, name).count("Exchange") <= 1


@pytest.mark.parametrize("name", ["bm25_top10", "hybrid_weighted_saturation"])
def test_small_query_tables_do_not_move_documents(spark, name):
    """No exchange by document but the one that spreads the single test file over the cores."""
    moved = [line for line in plan(spark, name).split("\n") if "Exchange hashpartitioning(doc_id" in line]
    assert not [line for line in moved if "ENSURE_REQUIREMENTS" in line]


def test_fifty_candidates_find_nine_in_ten(spark):
    """A fortieth of the vectors is read for each query."""
    recalls = [r.recall for r in entry.queries()["knn_recall"](spark, "/root/testdata/sf0.1").collect()]
    assert len(recalls) == 200 and sum(recalls) >= 0.98 * len(recalls) and min(recalls) >= 0.7
