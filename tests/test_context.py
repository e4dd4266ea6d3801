"""Context building against greedy loops; chapters in volumes."""

import random

from pyspark.sql import functions as F

from strata import constants as K
from strata.operators import context as C
from strata.operators.chapters import assemble_chapters, lookup_summaries, whole_chapters
from strata.operators.summaries import summary_rows, summary_worklist
from strata.plans.answers import build_answers, context_units, hits_with_chapters

SUFFIX = {"chapter_summary": K.CUT_SUMMARY, "chapter": K.CUT_CHAPTER, "chunk": K.CUT_CHUNK}


def greedy(units, limit):
    used, out = 0, []
    for ref, (kind, text, title) in enumerate(units, start=1):
        tag = f" title={title}" if kind != "chunk" else ""
        tag += " kind=chapter_summary" if kind == "chapter_summary" else ""
        header = f"[{ref}] chapter_id=c{tag}\n"
        block = f"{header}{text}\n"
        if used + len(block) > limit:
            room = limit - used
            body = room - len(header) - len(SUFFIX[kind])
            if room < (80 if kind == "chunk" else 120) or body < 60:
                break
            out.append((ref, True, header + text[:body] + SUFFIX[kind]))
            break
        out.append((ref, False, block))
        used += len(block)
    return out


def test_packing_matches_the_greedy_loop(spark):
    rng = random.Random(4)
    lists, rows = {}, []
    for q in range(300):
        kinds = sorted(rng.choices(["chapter_summary", "chapter", "chunk"], k=rng.randint(0, 5)), key=list(SUFFIX).index)
        lists[q] = [(k, "t" * rng.choice([1, 30, 60, 100, 200, 400]), "T") for k in kinds]
        rows += [(q, k, t, "c", title, -float(i), 1, 1, None, None, i) for i, (k, t, title) in enumerate(lists[q])]
    schema = ("query_id int, kind string, text string, chapter_id string, title string, score double, hit_count int, "
              "rank int, chunk_index int, doc_id string, slot int")
    ordered = C.order_units(spark.createDataFrame(rows, schema))
    for limit in (0, 150, 400, 700):
        got = {}
        for r in C.pack_context(ordered, limit).orderBy("query_id", "ref").collect():
            got.setdefault(r.query_id, []).append((r.ref, r.text_truncated, r.block))
            assert r.text_total_chars == len(r.text) and r.text.startswith(r.text_for_llm)
        for q, units in lists.items():
            assert got.get(q, []) == (greedy(units, limit) if limit else [])


def test_older_packing_cuts_beyond_the_budget(spark):
    rows = [(1, f"d{i}", i, 1.0, t, None, None) for i, t in enumerate(["a" * 100, " ", "b" * 300, "c"], start=1)]
    hits = spark.createDataFrame(rows, "query_id int, doc_id string, rank int, score double, text string, chapter_id string, chunk_index int")
    got = C.pack_context_hits(hits, 250).orderBy("ref").collect()
    first = "[1] id=d1\n" + "a" * 100 + "\n"
    second = ("[3] id=d3\n" + "b" * 300 + "\n")[: 250 - len(first)] + K.CUT_CHUNK
    assert [(r.ref, r.block) for r in got] == [(1, first), (3, second)]
    assert C.pack_context_hits(hits, 0).count() == 0


def loop_chapter(parts):
    indexed = sorted((p for p in parts if p[1] is not None), key=lambda p: (p[1], p[0]))
    late = sorted(p for p in parts if p[1] is None)
    placed = [(p[1], i, p[2]) for i, p in enumerate(indexed)]
    placed += [(len(indexed) + i, len(indexed) + i, p[2]) for i, p in enumerate(late)]
    return [t for _, _, t in sorted(placed) if t]


def chapter_rows(spark, seed=5):
    rng, rows = random.Random(seed), []
    for c in range(6):
        for i in range(rng.randint(1, 40)):
            index = None if c % 2 and rng.random() < 0.2 else i * (1 + c)
            rows.append((f"c{c}_{i:03d}", rng.choice(["", "x", "long text " * 3, "句。"]), f" chapter_{c:04d}", index, None))
    schema = "doc_id string, text string, chapter_id string, chunk_index int, doc_kind string"
    return rows, spark.createDataFrame(rows, schema).repartition(4)


def test_chapters_match_the_loop(spark):
    rows, corpus = chapter_rows(spark)
    for r in assemble_chapters(corpus).collect():
        want = loop_chapter([(d, i, t) for d, t, c, i, _ in rows if c.strip() == r.chapter_id])
        assert r.full_text == "\n".join(want).strip() and r.chunk_count == len(want)


def test_volumes_hold_the_whole_chapter(spark):
    """A chapter too heavy for one row comes in several; nothing is lost or moved."""
    rows = [(f"d{i:05d}", f"part {i}", "chapter_0001", i, None) for i in range(5000)]
    rows += [(f"n{i}", f"late {i}", "chapter_0001", None, None) for i in range(40)]
    rows += [("s", "small", "chapter_0002", 0, None)]
    corpus = spark.createDataFrame(rows, "doc_id string, text string, chapter_id string, chunk_index int, doc_kind string")
    got = assemble_chapters(corpus.repartition(6), volume_chars=100_000).orderBy("chapter_id", "volume").collect()
    big = [r for r in got if r.chapter_id == "chapter_0001"]
    assert len(big) > 2 and [r.volume for r in big] == list(range(len(big)))
    assert {r.volumes for r in big} == {len(big)} and {r.chunk_count for r in big} == {5040}
    lines = "\n".join(r.full_text for r in big).split("\n")
    assert lines[:5000] == [f"part {i}" for i in range(5000)]
    assert sorted(lines[5000:]) == sorted(f"late {i}" for i in range(40))
    assert [r.full_text for r in got if r.chapter_id == "chapter_0002"] == ["small"]


def test_volumes_reach_hits_contexts_and_answers(spark):
    """Chapters cut into many volumes give the same hits, units and answers as whole ones."""
    rows = [(f"c{c}_{i:02d}", f"chapter {c} part {i} " + "text " * (i % 7), f"chapter_{c:04d}", i * 2000, None) for c in (1, 2) for i in range(30)]
    schema = "doc_id string, text string, chapter_id string, chunk_index int, doc_kind string"
    corpus = spark.createDataFrame(rows, schema).withColumn("chapter_title", F.lit(None).cast("string"))
    found = [(1, f"c{c}_{i:02d}", r, 1.0 / r, f"chapter {c} part {i}", False, f"chapter_{c:04d}", i) for r, (c, i) in enumerate([(1, 3), (1, 4), (2, 5)], 1)]
    hits = spark.createDataFrame(
        found, "query_id int, doc_id string, rank int, score double, text string, text_truncated boolean, chapter_id string, chunk_index int"
    )
    queries = spark.createDataFrame([(1, "part")], "query_id int, query_text string")
    results = []
    for chars in (200, 16_000_000):
        enriched, _ = hits_with_chapters(corpus, hits, volume_chars=chars)
        units, _ = context_units(corpus, hits, volume_chars=chars)
        answers = build_answers(corpus, queries, hits, 700, volume_chars=chars)
        results.append([[r.asDict(True) for r in df.orderBy(*keys).collect()] for df, *keys in (
            (enriched, "rank"), (units, "ref"), (answers.sources, "ref"), (answers.contexts, "query_id"),
        )])
    assert results[0] == results[1]
    chapter = results[0][0][0]["chapter"]
    assert chapter["full_text"].count("\n") == 29 and chapter["total_chars"] == len(chapter["full_text"])
    assert results[0][2][0]["text_total_chars"] == len(chapter["full_text"])
    volumes = assemble_chapters(corpus, volume_chars=200)
    assert volumes.filter("volumes > 3").count() > 6
    part = whole_chapters(volumes, row_chars=50).filter("chapter_id = 'chapter_0001'").first()
    assert part.total_chars == chapter["total_chars"] and chapter["full_text"].startswith(part.full_text)
    assert 50 <= len(part.full_text) < part.total_chars


def test_summaries(spark):
    done = spark.createDataFrame(
        [("chapter_0001", "T", " s1 "), ("chapter_0002", None, " ")], "chapter_id string, title string, summary string"
    )
    rows = summary_rows(done)
    assert [(r.doc_id, r.text, r.chunk_index) for r in rows.collect()] == [("chapter_0001_summary", "s1", -1)]
    assert [(r.title, r.summary) for r in lookup_summaries(rows).collect()] == [("T", "s1")]
    chapters = spark.createDataFrame([("chapter_0001", "a"), (None, "第一回 b" + "x" * 13000)], "doc_id string, text string")
    work = summary_worklist(chapters.withColumn("ordinal", F.lit(7)), rows, 10).collect()
    assert [r.chapter_id for r in work] == ["chapter_0007"]
    prompt = work[0].messages[1].content
    assert K.SUMMARY_INPUT_CUT in prompt and "请写 100 字以内" in prompt


def test_orphans_fill_up(spark):
    rows = [(1, f"d{i}", i, 1.0 / i, "t" if i != 3 else " ", "c" if i == 1 else None, i) for i in range(1, 6)]
    rows += [(2, "z", 1, 1.0, "z", None, 0)]
    hits = spark.createDataFrame(rows, "query_id int, doc_id string, rank int, score double, text string, chapter_id string, chunk_index int")
    chapters = spark.createDataFrame([("c", "whole", "T")], "chapter_id string, full_text string, title string")
    units = C.select_context_units(C.score_chapters(hits, 3), None, chapters, multi_hit_threshold=1)
    filled = C.order_units(C.fill_orphans(hits, units, 3)).orderBy("query_id", "ref").collect()
    assert [(r.query_id, r.kind, r.doc_id) for r in filled] == [
        (1, "chapter", None), (1, "chunk", "d2"), (1, "chunk", "d4"), (2, "chunk", "z"),
    ]


def test_messages_and_empty_answer(spark):
    contexts = spark.createDataFrame([(1, " q ", "ctx"), (2, "q", " ")], "query_id int, query_text string, context string")
    rows = C.empty_context_answer(C.build_messages(contexts)).orderBy("query_id").collect()
    assert rows[0].messages[0].content == K.SYSTEM_PROMPT
    assert rows[0].messages[1].content == "## 参考资料\n\nctx\n\n## 用户问题\n\nq\n\n请根据参考资料回答用户问题。"
    assert rows[0].needs_generation and rows[0].answer is None
    assert not rows[1].needs_generation and rows[1].answer == K.EMPTY_CONTEXT_ANSWER
