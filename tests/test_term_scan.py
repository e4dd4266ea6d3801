"""Terms of several tokens in token lists, against all runs of tokens."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from strata.operators import lexical as L
from strata.operators import term_scan as TS
from strata.operators.term_scan import GAP, TermScan


def brute(rows, terms):
    found = Counter()
    for i, tokens in enumerate(rows):
        tokens = tokens or []
        for no, term in enumerate(terms):
            part = term.split(GAP)
            found[i, no] += sum(tokens[at : at + len(part)] == part for at in range(len(tokens)))
    return +found


def test_overlapping_terms_are_all_found():
    rng = random.Random(2)
    for _ in range(60):
        terms = sorted({GAP.join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 12))})
        rows = [rng.choices("abcd", k=rng.randint(0, 15)) for _ in range(8)] + [None, []]
        row, term = TermScan(terms).occurrences(pa.array(rows, pa.list_(pa.string())))
        assert Counter(zip(row.tolist(), term.tolist())) == brute(rows, terms)


def test_a_term_does_not_reach_into_the_next_row():
    row, _ = TermScan(["a" + GAP + "b"]).occurrences(pa.array([["x", "a"], ["b"], ["a", "b"]]))
    assert row.tolist() == [2]


def test_sliced_batches_and_no_terms():
    rows = pa.array([["a"], ["b", "a"], ["a", "a"]])
    row, term = TermScan(["a"]).occurrences(rows.slice(1, 2))
    assert row.tolist() == [0, 1, 1] and term.tolist() == [0, 0, 0]
    assert len(TermScan([]).occurrences(rows)[0]) == 0
    assert len(TermScan(["z"]).occurrences(rows)[0]) == 0


def test_batches_are_cut_by_their_tokens(monkeypatch):
    """A task looks up a bounded number of tokens at once, however long the texts of a batch are."""
    monkeypatch.setattr(TS, "SCAN_TOKENS", 5)
    rows = [["a"] * n for n in (2, 3, 1, 9, 0, 1)] + [None, [], ["a"] * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(rows, pa.list_(pa.string()))], ["id", "toks"])
    for most in (None, 2):
        parts = list(TS.token_slices(batch, "toks", most))
        assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(9))
        assert all(p.num_rows == 1 or sum(len(t or []) for t in p.column("toks").to_pylist()) <= 5 for p in parts)
        assert most is None or max(p.num_rows for p in parts) == 2
    assert list(TS.token_slices(batch.slice(0, 0), "toks")) == []


def test_counts_of_terms_are_those_of_the_documents(spark):
    rows = [("a", "red fox red fox"), ("b", "fox red"), ("c", None), ("d", ""), ("e", "red fox")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = {r.term: (r.df, r.total_dl) for r in L.term_counts(docs, ["fox", "red" + GAP + "fox", "owl"]).collect()}
    assert got == {"fox": (3, 0), "red" + GAP + "fox": (2, 0), "": (3, 8)}
    assert L.term_counts(docs.limit(0), ["fox"]).count() == 0


def test_both_ways_give_the_same_statistics(spark):
    docs = spark.createDataFrame([("a", "x y z"), ("b", "y z y z"), ("c", "z")], "doc_id string, text string")
    members = spark.createDataFrame([("y", "y"), ("y", "z" + GAP + "y"), ("q", "q")], "slot string, term string")
    both = [sorted(map(tuple, L.slot_stats(docs, members, small, lengths=(2,)).select("slot", "df", "n_docs", F.round("avgdl", 9)).collect())) for small in (True, False)]
    assert both[0] == both[1] == [("y", 2, 3, round(8 / 3, 9))]
