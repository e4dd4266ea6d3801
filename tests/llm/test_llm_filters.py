"""Operator 13: filter interactions, against documents taken one by one through every order."""

import re
from collections import Counter, defaultdict
from itertools import permutations

from llm_cases import EDGE, docs
from pyspark.sql import functions as F

from strata.llm import filter_audit
from strata.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(rows):
    """(part, failed filters, id) of each row, by the contract's words."""
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    for doc_id, text, _, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": any(c in t for c in "#$%&*|"),
            "E": doc_id is not None and doc_id > first[t],
        }
        yield source or "", {f for f, bad in fails.items() if bad}, doc_id


def expected(rows, good, toxic):
    counts, parts = defaultdict(Counter), set()
    for part, fails, doc_id in failures(rows):
        parts.add(part)
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                c = counts[part, order, step]
                removed = not gone and f in fails
                c["redundant"] += gone and f in fails
                c["removed"] += removed
                c["good_lost"] += removed and doc_id in good
                c["toxic_lost"] += removed and doc_id in toxic
                c["unique_fails"] += fails == {f}
                gone = gone or removed
                c["kept"] += not gone
                counts[part, f]["shapley"] += removed
    return {
        (p, o, s, *[counts[p, o, s][c] for c in COLUMNS[3:-1]], counts[p, o[s - 1]]["shapley"])
        for p in parts for o in map("".join, permutations("ABCDE")) for s in range(1, 6)
    }


def result(df):
    assert df.columns == COLUMNS
    return [tuple(r) for r in df.collect()]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, digest string, mask int")


def test_query_matches_documents_taken_one_by_one(spark):
    rows = [(r.doc_id, r.text, None, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    known = spark.read.parquet(f"{SF}/labels.parquet").collect()
    want = expected(rows, {r.doc_id for r in known if r.quality == 1}, {r.doc_id for r in known if r.toxic == 1})
    got = result(REGISTRY["op13_filter_audit"](spark, SF))
    assert len(got) == len(want) and set(got) == want and any(r[3] for r in got)


def test_edge_cases_copies_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(250))
    rows = EDGE + [
        (20, long, "en", "hot"), (21, long, "en", "hot"), (22, long, "en", ""), (23, long, "en", None), (None, long, "en", "hot"),
        (20, long, "en", "hot"), (24, long.upper(), "en", "hot"), (25, long + " #", "en", "hot"), (26, "X# " * 300, "en", "hot"),
    ]
    known = [(21, 1, 0, "x", 1), (24, 1, 1, "x", 1), (24, 0, None, "x", 1), (26, None, 1, "x", 1), (None, 1, 1, "x", 1), (4, 1, 0, "x", 1), (99, 1, 1, "x", 1)]
    table = docs(spark, rows).withColumn("part", F.lit("p")).withColumn("mask", F.lit("m")).withColumn("id", F.lit("i")).withColumn("digest", F.lit(1))
    got = result(filter_audit.interactions(table, labels(spark, known)))
    assert len(got) == len(set(got)) and set(got) == expected(rows, {21, 24, 4}, {24, 26})


def test_empty_tables(spark):
    assert filter_audit.interactions(docs(spark, []), labels(spark, [])).count() == 0
    got = result(filter_audit.interactions(docs(spark, [(1, None, None, None)]), labels(spark, [])))
    assert set(got) == expected([(1, None, None, None)], set(), set()) and len(got) == 600


def test_only_cells_meet_the_orders(spark):
    """No more than 32 cells a part go into the fold, and there is no cross product and no Python."""
    table = docs(spark, EDGE)
    assert filter_audit.cells(table, labels(spark, [])).groupBy("part").count().agg(F.max("count")).first()[0] <= 32
    plan = filter_audit.interactions(table, labels(spark, []))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Cartesian", "NestedLoop", "Python", "Arrow"))
