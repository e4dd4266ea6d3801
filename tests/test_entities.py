"""Entities and words."""

import random

from pyspark.sql import functions as F

from strata.operators import entities as EN
from strata.operators import words as WD

NAMES = ["刘备", "张", "张飞", "备关", "关", "ab", "never"]


def corpus(spark):
    rng = random.Random(6)
    rows = [
        (f"d{i:03d}", " " + "".join(rng.choice("刘备张飞关ab ,") for _ in range(rng.randint(0, 40))), f"c{i % 7}", i)
        for i in range(300)
    ]
    return rows, spark.createDataFrame(rows, "doc_id string, text string, chapter_id string, chunk_index int").repartition(5)


def loop_profiles(rows, limit):
    out = {}
    for d, text, c, i in sorted(rows, key=lambda r: (r[2], r[3], r[0])):
        text = text.strip()
        for n in NAMES:
            used = sum(map(len, out.get(n, [])))
            if text and n in text and used < limit:
                out.setdefault(n, []).append(text[: limit - used])
    return {n: "\n\n".join(p).strip() for n, p in out.items()}


def test_profiles_both_ways(spark, monkeypatch):
    rows, docs = corpus(spark)
    names = spark.createDataFrame([(n,) for n in NAMES], "character string")
    for limit in (90, 100_000):
        want = loop_profiles(rows, limit)
        for small in (True, False):
            monkeypatch.setattr(EN.mentions, "__defaults__", (small,))
            got = {r.character: r.profile_text for r in EN.entity_profiles(docs, names, limit).collect()}
            assert got == want


def test_names_in_texts_for_short_and_long_lists(spark):
    """Ten, five hundred and fifty thousand names; many overlap, some lie inside others."""
    rows, docs = corpus(spark)
    rng = random.Random(8)
    for n in (10, 500, 50_000):
        names = {"".join(rng.choice("刘备张飞关ab,xyz") for _ in range(rng.randint(1, 6))) for _ in range(n)}
        table = spark.createDataFrame([(x,) for x in [*names, None]], "character string")
        got = {(r.doc_id, r.character) for r in EN.mentions(docs, table).collect()}
        texts = [(d, t) for d, t, *_ in rows]
        pieces = {d: {t[i : i + k] for k in range(1, 7) for i in range(len(t) - k + 1)} for d, t in texts}
        assert got == {(d, x) for d in pieces for x in pieces[d] & names}


def test_automaton_cases():
    found = EN.NameAutomaton(["he", "she", "hers", "a b", "é", ""]).names_in
    assert found("ushers a b") == ["", "a b", "he", "hers", "she"] and found("") == [""]
    assert EN.NameAutomaton([]).names_in("text") == []


def test_cooccurring_names(spark):
    hits = spark.createDataFrame(
        [(1, "ab q", 1, "Ab cd ef ef x"), (1, "ab q", 2, "ef cd zz"), (1, "ab q", 13, "cd")],
        "query_id int, query_text string, rank int, text string",
    )
    names = spark.createDataFrame([("ab",), ("cd",), ("ef",), ("x",), ("gone",)], "character string")
    got = [(r.character, r.n, r["rank"]) for r in EN.cooccurring_names(hits, names).collect()]
    assert got == [("ef", 3, 1), ("cd", 2, 2)]
    tagged = hits.withColumn("mine", F.array(F.lit("gone")))
    assert [(r.character, r.n) for r in EN.cooccurring_names(tagged, names, token_column="mine").collect()] == [("gone", 2)]


def test_word_analogy_leaves_inputs_out(spark):
    words = spark.createDataFrame(
        [("king", [1.0, 1.0]), ("man", [1.0, 0.0]), ("queen", [0.1, 1.0]), ("tree", [-1.0, 0.2])], "word string, vector array<double>"
    )
    terms = spark.createDataFrame([(1, "king", 1), (1, "man", -1), (2, "nope", 1)], "expr_id int, word string, sign int")
    found, rejects = WD.word_analogy(words, terms, top=2)
    assert [(r.word, r["rank"]) for r in found.orderBy("rank").collect()] == [("queen", 1), ("tree", 2)]
    assert [(r.expr_id, r.reason) for r in rejects.collect()] == [(2, "unknown term")]


def test_word2vec_learns_neighbours(spark):
    rows = [(["aa", "bb", "cc"] * 4, ) if i % 2 else (["xx", "yy", "zz", "k"] * 4, ) for i in range(200)]
    docs = spark.createDataFrame(rows, "text_tokens array<string>")
    model = WD.train_word2vec(docs, vector_size=16, partitions=2)
    vectors = WD.word_vectors(model)
    assert {r.word for r in vectors.collect()} == {"aa", "bb", "cc", "xx", "yy", "zz"}
    assert vectors.select(F.size("vector")).first()[0] == 16
