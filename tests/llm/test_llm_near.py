"""Operators 6 and 9 and the pipeline, against brute force."""

import random
from collections import Counter

import pytest
from llm_cases import EDGE, PASSAGE, docs
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import chosen_path, templates
from strata.llm.components import roots
from strata.llm.tables import table, written

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_groups(rows, percent):
    """Component names and set sizes by comparing all pairs."""
    sets = [shingles(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and group[i] != group[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = Counter()
    for k, (i, *_) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if group[m] == group[k] and rows[m][0] is not None]
        name = min(ids) if ids and sets[k] else i
        out[i, len(sets[k]), name, i == name] += 1
    return out


def near_rows(n=260, seed=3):
    """Chains of edited copies, a common passage, and unrelated texts."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        else:
            text = " ".join(rng.choices(vocabulary, k=rng.randrange(30, 90)))
            if rng.random() < 0.4:
                text = PASSAGE + " " + text
        rows.append((1000 - i, text, "en", "a"))
    return rows


@pytest.mark.parametrize("options", [{}, {"limit": 6, "block": 3, "trees": (2, 10)}])
def test_components_equal_those_of_all_pairs(spark, options):
    rows = near_rows() + EDGE
    found = chosen_path.near_groups(docs(spark, rows), 85, **options).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == brute_groups(rows, 85)


def test_near_groups_of_nothing(spark):
    assert chosen_path.near_groups(docs(spark, [])).count() == 0
    one = chosen_path.one_of_each(docs(spark, EDGE[:4]))
    assert sorted(r.doc_id for r in one.collect()) == [1, 4]


def test_roots_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    found = {r.node: r.root for r in roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert roots(spark.createDataFrame([], "a long, b long")).count() == 0


# --- templates -------------------------------------------------------------------------

ITEM = "Alice had 12 apples and gave 5 apples to Bob before walking 3 km home with the remaining apples in a basket"
ITEMS = [(1, ITEM), (2, "seven wise owls watch from"), (3, "too few"), (4, None), (5, ""), (6, "1 2 3 4 5 6 7 8"), (6, "1 2 3 4 5 6 7 8")]


def items(spark, rows=None):
    return spark.createDataFrame([(*r, "x") for r in (rows if rows is not None else ITEMS)], "item_id long, text string, doc_id string")


def test_reparameterised_items_are_found_and_wrong_slots_are_not(spark):
    other = ITEM.replace("Alice", "Carla").replace("Bob", "Dimitri").replace("12", "40").replace("5", "9").replace("3 km", "8 miles")
    twice = "We saw 3 cats chase 3 dogs around 4 old red barns until the very late evening came and all went home"
    rows = EDGE + [
        (20, "Intro words. " + other + " and more text.", "en", "a"),
        (21, "\n".join(ITEM.split()), "en", "a"),
        (22, twice.replace("3 cats", "6 cats").replace("3 dogs", "7 dogs"), "en", "a"),
        (23, twice.replace("3", "6"), "en", "a"),
        (24, "1 2 3 4 5 6 7 8 9", "en", "a"),
        (25, "too few", "en", "a"),
        (26, ITEM + " " + ITEM, "en", "a"),
    ]
    found = templates.leaks(docs(spark, rows), items(spark, [*ITEMS, (7, twice)])).collect()
    pairs = Counter((r.doc_id, r.item_id) for r in found)
    assert pairs == Counter({(20, 1): 1, (21, 1): 1, (26, 1): 1, (23, 7): 1, (25, 3): 1, **{(i, 2): 1 for i in (1, 2, 3)}})
    assert {r.doc_id: r.changed for r in found}[20] and not {r.doc_id: r.changed for r in found}[21]
    kept = templates.without_leaks(docs(spark, rows), items(spark, [*ITEMS, (7, twice)]))
    assert kept.columns == docs(spark, []).columns
    assert kept.count() == len(rows) - 8


def test_items_full_of_numbers_are_found(spark):
    short, long = "What is 48 / 6 + 7?", "What is the value of 3 + 4 * 5 - 6 / 2 + 18?"
    sums, tail = "Compute 12 * 7 - 30 + 4 * 5.", "ran 5 km in 20 minutes, 10 km in 45 minutes and 15 km in 70 minutes"
    first = "3 4 5 6 7 8 9 are all of the numbers"
    wanted = dict(enumerate([short, long, sums, "Alice " + tail, "Sum 2 + 2", first], 1))
    rows = [(i, f"Some words stand here. {text} And others follow it there.", "en", "a") for i, text in wanted.items()]
    rows += [
        (12, "Before. What is the value of 9 + 8 * 7 - 6 / 5 + 44? After.", "en", "a"),
        (14, "Then Carla ran 6 km in 21 minutes, 11 km in 46 minutes and 16 km in 71 minutes", "en", "a"),
        (21, "What is 49 / 6 + 7? Compute 12 * 7 - 31 + 4 * 5. Sum 2 + 3", "en", "a"),
        (22, " ".join(map(str, range(3000))) + " 12 7 30 4 5", "en", "a"),
        (23, "What is the value of 9 + 8 * 8 - 6 / 5 + 44?", "en", "a"),
    ]
    found = templates.leaks(docs(spark, rows), items(spark, list(wanted.items()))).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {*((i, i) for i in wanted), (12, 2), (14, 4)}
    assert all(r.covered >= 0.8 * r.item_tokens for r in found)


def test_templates_of_empty_tables(spark):
    assert templates.leaks(docs(spark, EDGE), items(spark, [])).count() == 0
    assert templates.leaks(docs(spark, []), items(spark)).count() == 0


# --- pipeline -----------------------------------------------------------------------------


def plain(text):
    return " ".join(templates._EDGES.sub("", w).lower() for w in (text or "").split() if templates._EDGES.sub("", w))


def test_stages_against_brute_force(spark):
    stages = dict(corpus_pipeline.STAGES)
    start = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in start.collect()}
    for name in ("language", "exact_dedup", "near_dedup", "decontamination"):
        out = written(stages[name](spark, start, SF), "test-stage")
        assert out.columns == start.columns
        kept = {r.doc_id for r in out.collect()}
        assert out.count() == len(kept)
        if name == "language":
            assert kept == {i for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}
        elif name == "exact_dedup":
            texts = Counter("".join((rows[i].text or "").split()) for i in kept)
            assert max(texts.values()) == 1 and len(texts) == len({"".join((r.text or "").split()) for r in rows.values()})
        elif name == "near_dedup":
            groups = brute_groups([(i, r.text) for i, r in rows.items()], corpus_pipeline.NEAR_PERCENT)
            assert kept == {i for i, _, name_of, own in groups if own}
        else:
            wanted = [f" {plain(r.text)} " for r in table(spark, SF, "benchmark").collect()]
            assert kept == {i for i, r in rows.items() if not any(w in f" {plain(r.text)} " for w in wanted)}
        rows = {i: rows[i] for i in kept}
        start = out
    mixed = stages["mixing"](spark, start, SF)
    assert set(mixed.columns) == {*start.columns, "copy"} and mixed.filter(F.col("copy") > 2).count() == 0


CLASHES = "_id _sha _hash _size _source _rows _copies _share _late _text_hash lang_pred score key hash rep cls comp copies none".split()


def test_stages_keep_extra_columns(spark):
    start = docs(spark, EDGE).withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, start, SF), "test-stage")
        assert set(out.columns) == {*start.columns, *(["copy"] if name == "mixing" else [])}
        rows = out.collect()
        assert rows
        for r in rows:
            of = "-" if r.doc_id is None else str(r.doc_id)
            assert [r[c] for c in CLASHES] == [f"{c} of {of}" for c in CLASHES], name
        start = out


def test_near_copies_that_repeat_an_id_leave_one_row(spark):
    rows = [(1, PASSAGE, "en", "a"), (1, PASSAGE + " and then", "en", "a"), (1, PASSAGE, "en", "b"), (1, "quite another text about the sea and boats", "en", "a")]
    rows += [(2, PASSAGE + " and", "en", "a"), (3, None, "en", "a"), (3, None, "en", "a"), (3, "", "en", "a")]
    kept = chosen_path.one_of_each(docs(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 1, 3, 3, 3]
    assert sum((r.text or "").startswith("quite") for r in kept) == 1


def test_texts_in_no_learnt_language_go(spark):
    rng = random.Random(4)
    strange = []
    for low, size in ((0x430, 32), (0x4E00, 8000), (0xE01, 46), (97, 26)):
        for n in (20, 100, 400):
            words = ["".join(chr(low + rng.randrange(size)) for _ in range(rng.randrange(2, 9))) for _ in range(n)]
            strange.append(" ".join(words))
    start = table(spark, "/root/testdata/sf0.01", "documents")
    plants = [(-1 - i, text) for i, text in enumerate(strange)]
    planted = spark.createDataFrame(plants, "doc_id long, text string")
    out = corpus_pipeline.known_language(spark, start.unionByName(planted, allowMissingColumns=True), SF)
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    assert not [i for i in kept if i < 0]
    lost = [r.text for r in start.collect() if r.doc_id not in kept and any(c.isalpha() for c in r.text or "")]
    assert len(lost) <= 5 and max(map(len, lost)) < 20
