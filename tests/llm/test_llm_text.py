"""Operators 1, 4, 5 and 7."""

import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import EDGE, LONG, docs
from pyspark.sql import functions as F

from strata.llm import attention_lm, language, page_text, surrogates
from strata.llm.shingles import words_of
from strata.llm.tables import table

SF = "/root/testdata/sf0.001"
KEY = b"test key"


# --- surrogates ---------------------------------------------------------------------


def test_permutations_have_no_equal_results():
    pairs = itertools.product(range(10), range(3), range(7))
    made = [tuple(surrogates.permute(list(p), [10, 3, 7], KEY, "t")) for p in pairs]
    assert len(set(made)) == 210 and all(a < 10 and b < 3 and c < 7 for a, b, c in made)


@settings(max_examples=60, deadline=None)
@given(st.text("0123456789", min_size=15, max_size=15), st.integers(0, 9))
def test_check_digits_stay_right_or_wrong(payload, last):
    card = surrogates.surrogate("card", payload + str(last), KEY)
    right = surrogates.luhn_digit(payload) == last
    assert (surrogates.luhn_digit(card[:-1]) == int(card[-1])) == right and len(card) == 16


TEXT = (
    "Mail jo.doe7@acme.co.uk, JO.DOE7@ACME.CO.UK or x@mail3.example.com; call +1 (017) 555-7713 or +10175557713 or +49 30 901820. "
    'Card 4111 1111 1111 1111, 4111111111111111; host 10.20.30.40; SSN 123-45-6789; token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"; '
    "IBAN DE89 3704 0044 0532 0130 00. Mrs. Maria Lopez met Dr. John Smith. Ms Lopez left. Госпожа Иванова и Сергей Петров."
)


def test_surrogates_keep_kind_format_gender_and_coreference():
    made, counts = surrogates.rewrite(TEXT, KEY, {})
    assert counts == {"email": 3, "phone": 3, "card": 2, "ipv4": 1, "ssn": 1, "secret": 1, "iban": 1, "given": 3, "family": 5}
    for f in surrogates.find(TEXT):
        assert TEXT[f.start : f.end] not in made
    emails = re.findall(r"[\w.]+@[\w.]+\w", made)
    assert emails[0].upper() == emails[1] and emails[0].endswith(".uk.example") and emails[2].endswith(".example.com")
    phones = re.findall(r"\+1 \(\d{3}\) 555-\d{4}|\+1\d{3}555\d{4}|\+49 \d\d \d{6}", made)
    assert len(phones) == 3 and re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1])
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", made)
    assert cards[0].replace(" ", "") == cards[1] and surrogates.luhn_digit(cards[1][:-1]) == int(cards[1][-1])
    iban = re.search(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", made)[0].replace(" ", "")
    assert surrogates.iban_rest(iban) == 1
    assert all(0 <= int(x) < 256 for x in re.search(r"host ([\d.]+);", made)[1].split("."))
    assert re.search(r'token = "[0-9a-f]{40}"', made) and re.search(r"SSN \d{3}-\d\d-\d{4}", made)
    she, family = re.search(r"Mrs\. (\w+) (\w+) met", made).groups()
    assert f"Ms {family} left" in made and she.endswith(("na", "ra", "lia", "sa"))
    assert re.search(r"Dr\. \w+(?:n|rd|s|ld) \w+\.", made) and re.search(r"Госпожа [А-Я][а-я]+ и [А-Я][а-я]+ [А-Я][а-я]+\.", made)
    assert surrogates.find("Version 2.0. Section 4.0. In 2020, 12 34, Sir, token: nothing") == []


def narrow(todo, key, attempt):
    """Surrogates of addresses from eight strings per attempt: they must collide."""
    made = F.concat(F.lit(f"{attempt}-"), F.pmod(F.xxhash64("value"), F.lit(8)).cast("string"))
    return surrogates._tried(todo, key, attempt).withColumn("made", F.when(F.col("kind") == "ipv4", made).otherwise(F.col("made")))


def test_collisions_are_settled_and_both_ways_agree(spark):
    rows = EDGE + [(100 + i, f"host 10.0.{i % 60}.7 and 10.0.3.7", "en", "a") for i in range(200)]
    frame = docs(spark, rows).withColumn("entities", F.lit("clash")).withColumns({c: F.lit(c) for c in ("hash", "late", "_late", "_text_hash")})
    known = surrogates.entities(frame)
    late = surrogates.later_attempts(known, KEY, narrow)
    given_to = {(r.kind, r.value): r.attempt for r in late.collect()}
    made = Counter()
    for r in known.filter("kind = 'ipv4'").collect():
        attempt = given_to.get((r.kind, r.value), 0)
        made[attempt, spark.range(1).select(F.pmod(F.xxhash64(F.lit(r.value)), F.lit(8))).first()[0]] += 1
    assert len(made) == 60 and max(made.values()) == 1 and given_to
    one, other = (surrogates.with_surrogates(frame, KEY, broadcast=b, make=narrow) for b in (True, False))
    extra = ["hash", "late", "_late", "_text_hash"]
    assert one.columns == other.columns == [*docs(spark, []).columns, *extra, "entities"]
    assert {tuple(r) for x in (one, other) for r in x.select(extra).collect()} == {tuple(extra)}
    texts = [Counter((r.doc_id, r.text) for r in x.collect()) for x in (one, other)]
    assert texts[0] == texts[1]
    unchanged = {(i, t) for i, t, *_ in EDGE}
    assert unchanged <= set(texts[0])
    assert surrogates.with_surrogates(docs(spark, []), KEY).count() == 0


def test_a_name_has_one_surrogate_whatever_its_title_tells(spark):
    rows = [(1, "Dr Alex Kim spoke.", "en", "a"), (2, "Mr Alex Kim spoke.", "en", "a"), (3, "Dr Robin Kim spoke.", "en", "a")]
    rows += [(4, "Ms Robin Fox spoke.", "en", "a"), (5, "Mr Robin Fox spoke.", "en", "a")]
    for way in (True, False):
        made = {r.doc_id: r.text.split() for r in surrogates.with_surrogates(docs(spark, rows), KEY, broadcast=way).collect()}
        assert made[1][1:] == made[2][1:] and made[1][1] != "Alex" and made[1][2] == made[3][2]
        assert len({made[i][1] for i in (3, 4, 5)}) == 3  # two persons of that name: a mention without gender is neither


def test_surrogates_of_a_table_are_distinct_and_none_is_real(spark):
    words = table(spark, SF, "documents").select("doc_id", "text")
    known = surrogates.entities(words)
    told = {(r.kind, r.value): r.used for r in surrogates.told_genders(known).collect()}
    real = {(r.kind, r.value) for r in known.collect()}
    own = known.join(surrogates.told_genders(known).select("kind", "value"), ["kind", "value"], "left_anti")
    late = {(r.kind, r.value): r.attempt for r in surrogates.later_attempts(own, KEY).collect()}
    pool = lambda kind: "name-" + kind.split("-")[-1] if "-" in kind else kind
    made = {}
    for kind, value in real - set(told):
        made.setdefault((pool(kind), surrogates.surrogate(kind, value, KEY, late.get((kind, value), 0))), []).append((kind, value))
    assert len(made) > 10 and all(len(v) == 1 for v in made.values())
    crowds = Counter((k, surrogates.shape(k, v)) for k, v in real)
    roomy = {k for (k, v) in made for kind, value in made[k, v] if crowds[kind, surrogates.shape(kind, value)] * 16 <= surrogates.domain_size(kind, value)}
    assert not {m for m in made if m[0] in roomy} & {(pool(k), v) for k, v in real}
    settled = {e: (e[0], n) for e, n in late.items()} | {(k, v): (used, late.get((used, v), 0)) for (k, v), used in told.items()}
    found = {(r.doc_id, r.text) for r in surrogates.with_surrogates(words, KEY).collect()}
    assert found == {(r.doc_id, surrogates.rewrite(r.text, KEY, settled)[0] if r.text else r.text) for r in words.collect()}


def test_no_colliding_surrogate_is_given_out(spark):
    known = spark.createDataFrame([("ipv4", f"10.0.0.{i}") for i in range(3)], "kind string, value string")

    def same(todo, key, attempt):
        return surrogates._tried(todo, key, attempt).withColumn("made", F.lit("1.1.1.1"))

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(surrogates, "MAX_ATTEMPTS", 3)
        with pytest.raises(RuntimeError, match="without a surrogate"):
            surrogates.later_attempts(known, KEY, same)


def test_a_full_shape_stays_with_its_permutation(spark):
    values = [("ssn", f"00{i}-00-000{j}") for i in range(10) for j in range(10)] + [("phone", "+15550001234")]
    known = spark.createDataFrame(values, "kind string, value string")

    def small(todo, key, attempt):
        return surrogates._tried(todo, key, attempt).withColumn("room", F.lit(200.0))

    assert surrogates.later_attempts(known, KEY, small).count() == 0


def test_names_found_once_are_replaced_at_every_mention():
    text = "Maria Lopez arrived. Lopez said LOPEZ. Mr Alex Kim sat, and Alex Kim's dog; Alexander did not. Mrs.\nAnna\n Weber left.\nWeber, Dr Wu\nThe end. The rest."
    made, counts = surrogates.rewrite(text, KEY, {})
    assert counts == {"given": 4, "family": 8}
    for name in ("Maria", "Lopez", "LOPEZ", "Kim", "Anna", "Weber", "Wu"):
        assert name not in made
    lopez = re.match(r"\w+ (\w+) arrived\. (\w+) said (\w+)\.", made).groups()
    assert lopez[0] == lopez[1] and lopez[0].upper() == lopez[2]
    assert re.search(r"Mr (\w+ \w+) sat, and \1's dog; Alexander did not", made)
    assert re.search(r"Mrs\.\n\w+\n (\w+) left\.\n\1, Dr \w+\nThe end\. The rest\.", made)
    assert surrogates.find("Anna\nThe house. The garden.") == []


def test_compressed_addresses_are_found():
    wanted = ["2001:db8::1", "fe80::1ff:fe23:4567:890a", "::1", "2001:DB8::", "2001:db8:0:0:0:0:2:1"]
    for address in wanted:
        assert [(f.kind, f.value) for f in surrogates.find(f"host {address}, up.")] == [("ipv6", address.lower())]
        made = surrogates.rewrite(f"host {address}/64", KEY, {})[0]
        assert re.sub("[0-9a-fA-F]", "0", made) == re.sub("[0-9a-fA-F]", "0", f"host {address}/64")
    assert [f.kind for f in surrogates.find("::ffff:10.1.2.3")] == ["ipv4"]
    for other in ("std::vector2", "at 10:30:15", "a::b", "x ::2y", "1:2:3:4:5:6:7:8::9"):
        assert surrogates.find(other) == []


# --- pages -----------------------------------------------------------------------------


def cut_cost(costs, edges, kept):
    own = sum(max(c, 0) for c, k in zip(costs, kept) if not k) + sum(max(-c, 0) for c, k in zip(costs, kept) if k)
    return own + sum(w for a, b, w in edges if kept[a] != kept[b])


def test_minimum_cut_against_all_labellings():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 9)
        costs = [rng.choice([0, rng.uniform(-3, 3)]) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        best = min(cut_cost(costs, edges, k) for k in itertools.product([True, False], repeat=n))
        assert math.isclose(cut_cost(costs, edges, page_text.min_cut(costs, edges)), best, abs_tol=1e-6)


PAGE = """<!DOCTYPE html><html><head><title>Site</title><script>var a = "</p><p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/x">News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to serve you better.</p></div><!-- <p>hidden</p> -->
<article class="post"><h1>Title &amp; more</h1><p>First  paragraph,&nbsp;with <b>bold</b>ness and
a <a href="y">link</a>.<br>Second line.<p>Unclosed paragraph &eacute;nd.<ul><li>Item one of the list</li><li>Item two.</li></ul>
<div class="ad"><p>Buy now, it is cheap!</p></div><form><p>Your name</p><input value="v"></form>
<section id="comments"><p>Nice article, thank you very much, I liked it.</p></section></article>
<aside><p>Related: another article that you may like.</p></aside><footer>&copy; 2020 Somebody</footer></body></html>"""
MAIN = "Title & more First paragraph, with boldness and a link. Second line. Unclosed paragraph énd. Item one of the list Item two."


def test_main_text_of_a_page():
    assert page_text.main_text(PAGE, page_text.PRIOR) == MAIN
    assert page_text.main_text(PAGE.replace("article", "div"), page_text.PRIOR) == MAIN
    cut = PAGE[: PAGE.index("<form>")]
    assert page_text.main_text(cut, page_text.PRIOR) == MAIN
    for none in (None, "", "<p>", "<!-- open", "<script>x", "<nav>Menu</nav>"):
        assert page_text.main_text(none, page_text.PRIOR) == ""


def test_attributes_end_as_the_standard_says():
    text = "It is a fine day in the old town, and the boats go out to sea again, one after the other."
    for tag in ("data-x=don't", "title='a > b'", 'class="a', "a=1/b='", 'x = "y>z" checked', '"', "==", "class=\n'text' id=a>"):
        page = f"<article><p {tag}>{text}</p><p>Don't go there, they said; it is a long way, and the weather will not hold.</p></article>"
        made = page_text.main_text(page, page_text.PRIOR)
        assert "Don't go" in made and "<" not in made and text[10:] in made, (tag, made)
    page = f"<article><script data-x='a>b'>no</script x='>'><p>{text}</p></article>"
    assert page_text.main_text(page, page_text.PRIOR) == text
    assert page_text.blocks("<div title='class=nav'><p>one</p></div>")[1][0] == page_text.blocks("<div><p>one</p></div>")[1][0]


def test_extract_on_tables(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (2, "u", "", "x"), (3, "u", "<article><p>" + LONG + "</article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = page_text.extract(pages)
    assert found.columns == ["page_id", "url", "text"]
    assert Counter((r.page_id, r.text) for r in found.collect()) == Counter({(1, MAIN): 2, (None, ""): 1, (2, ""): 1, (3, LONG): 1})
    assert page_text.extract(pages.limit(0)).count() == 0


def test_pages_of_the_tables_are_read_without_their_markup(spark):
    pages = table(spark, SF, "pages")
    weights = page_text.train(pages, "page_id", "html")
    plain = [r.html for r in pages.collect()]
    bare = [re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", h).replace(' class="ad"', "") for h in plain]
    same = sum(page_text.main_text(a, weights) == page_text.main_text(b, weights) for a, b in zip(plain, bare))
    assert same >= 0.95 * len(plain)


# --- language ------------------------------------------------------------------------------


def test_held_out_accuracy_and_undetermined(spark):
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    found = language.learnt_and_identified(documents).collect()
    truth = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_cases(spark):
    frame = docs(spark, EDGE)
    found = language.learnt_and_identified(frame)
    rows = found.collect()
    assert len(rows) == len(EDGE)
    assert Counter(r.doc_id for r in rows if r.lang_pred == "und") == Counter([4, 5, 6, 12])
    assert language.learnt_and_identified(docs(spark, [])).count() == 0
    unlearnt = language.identify(frame.withColumn("score", F.lit("x")), {})
    assert {(r.lang_pred, r.score) for r in unlearnt.collect()} == {("und", 0.0)}


def test_pieces_add_up_to_the_text(monkeypatch):
    text = "Größe über alles, мир и 漢字 test " * 40
    letters = language.Letters(64)
    whole = language.bundles([text], np.zeros(1, int), 1, letters, float)
    low = text.lower()
    naive = np.zeros(64)
    for i, c in enumerate(low):
        if c.isalpha():
            left, right = ((ord(low[j]) if 0 <= j < len(low) and low[j].isalpha() else 0) for j in (i - 1, i + 1))
            naive += np.roll(letters[left], 2).astype(int) * np.roll(letters[ord(c)], 1) * letters[right]
    assert np.array_equal(naive, whole[0])
    monkeypatch.setattr(language, "PIECE_CHARS", 37)
    parts = language.pieces(text)
    assert "".join(parts) == text and len(parts) > 10
    for size in (7, 1 << 14):
        monkeypatch.setattr(language, "SLICE", size)
        made = language.bundles(parts, np.arange(len(parts)), len(parts), letters, float)
        assert np.array_equal(made.sum(0), whole[0])


def test_memory_does_not_grow_with_distinct_trigrams():
    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA0, 200_000)))
    tracemalloc.start()
    language.bundles([text], np.zeros(1, int), 1, language.Letters(language.DIMS), np.float64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6


# --- language model ----------------------------------------------------------------------------


def random_views(lengths, seed=0):
    rng = np.random.default_rng(seed)
    n = int(sum(lengths))
    ids, levels = rng.integers(0, 300, n), rng.integers(0, 9, n)
    by_word, by_pair = (rng.random(n).astype(np.float32) * 0.1 for _ in range(2))
    return ids, attention_lm.views(ids, by_word, by_pair, levels, np.array(lengths), 999)[0]


def test_each_token_is_scored_once():
    ids, w = random_views([100, 1, 24, 25, 32, 33, 249])
    assert w.counted.sum() == len(ids) and sorted(w.targets[w.counted]) == sorted(ids)


def test_gradient_against_differences():
    _, w = random_views([90, 1, 33])
    model = attention_lm.Attention.start()
    for name in model.names:
        setattr(model, name, getattr(model, name).astype(np.float64))
    slopes, flat = attention_lm.gradient(model, w, 1e-5)[1].flat(), model.flat()
    at = np.cumsum([0] + [getattr(model, n).size for n in model.names])
    for start, end in zip(at, at[1:]):
        i = start + int(np.argmax(np.abs(slopes[start:end])))
        losses = []
        for sign in (1, -1):
            moved = flat.copy()
            moved[i] += sign * 1e-4
            parts, place = [], 0
            for n in model.names:
                size = getattr(model, n).size
                parts.append(moved[place : place + size].reshape(getattr(model, n).shape))
                place += size
            losses.append(attention_lm.gradient(attention_lm.Attention(*parts), w, 1e-5)[0])
        assert math.isclose((losses[0] - losses[1]) / 2e-4, slopes[i], rel_tol=0.02, abs_tol=1e-7)


def test_later_ids_do_not_change_earlier_probabilities():
    _, w = random_views([30])
    model = attention_lm.Attention.start()
    before = attention_lm.forward(model, w, 1e-5)[0]
    w.inputs[:, 20:] = 7
    w.before[:, 21:] = 7
    assert np.allclose(before[:, :20], attention_lm.forward(model, w, 1e-5)[0][:, :20])


def test_probabilities_position_by_position_and_only_halves_that_count():
    """Every target against loops over what it sees; no weight is computed for a half whose positions do not count."""
    lengths, even = [1, 47, 48, 49, 96, 97, 250], 1e-5
    rng = np.random.default_rng(3)
    n = sum(lengths)
    ids, levels = rng.integers(0, 40, n), rng.integers(0, 9, n)
    by_word, by_pair = (rng.random(n).astype(np.float32) * 0.1 for _ in range(2))
    w, _ = attention_lm.views(ids, by_word, by_pair, levels, np.array(lengths), 999)
    model, half = attention_lm.Attention.start(), attention_lm.STRIDE
    model.gate += rng.standard_normal(model.gate.shape).astype(np.float32)
    model.distance += rng.standard_normal(model.distance.shape).astype(np.float32)
    p, seen = attention_lm.forward(model, w, even)
    found, expected, begun = iter(p[w.counted]), [], 0
    for length in lengths:
        text = [999, 999, *ids[begun : begun + length].tolist()]  # the input of place i is text[i + 1], the id before it text[i]
        for i in range(length):
            sees = range(max(0, (i // half - 1) * half), i + 1)
            query = model.query[text[i + 1]].astype(float)
            weight = [math.exp(query @ model.key[text[j]] / math.sqrt(attention_lm.DIM) + model.distance[i - j]) for j in sees]
            total = sum(weight) + math.exp(model.empty[0])
            context = sum(x * model.value[text[j + 1]].astype(float) for x, j in zip(weight, sees)) / total
            copied = sum(x for x, j in zip(weight, sees) if text[j + 1] == text[i + 2]) / total
            level = levels[begun + i - 1] if i else attention_lm.LEVELS - 1
            gates = np.exp(context @ model.mix + model.gate[text[i + 1]] + model.level[level])
            expected.append(gates @ [by_word[begun + i], by_pair[begun + i], copied, even] / gates.sum())
        begun += length
    assert np.allclose(list(found), expected, rtol=1e-4)
    assert sum(s.weights.size for s in seen) <= sum(-(-n // half) for n in lengths) * half * attention_lm.WINDOW


def test_blocks_hold_each_id_once_and_windows_are_as_before():
    """Blocks are filled up to their width only; the first two blocks of a text are one window, each later one adds one."""
    lengths, half = [1, 48, 49, 96, 97, 250], attention_lm.STRIDE
    _, w = random_views(lengths)
    assert w.inputs.size == w.targets.size == w.by_word.size == sum(-(-n // half) for n in lengths) * half
    assert w.window.tolist() == [0, 1, 2, 2, 3, 3, 4, 4, 5, 6, 6, 7, 8, 9, 10]
    steps = list(attention_lm._steps(w))
    assert sum(len(s.counted) for s in steps) == len(w.text) and sum(s.counted.sum() for s in steps) == sum(lengths)


def test_a_step_moves_what_it_met_by_the_scaled_slopes():
    _, w = random_views([90, 1, 33, 300])
    model = attention_lm.Attention.start()
    slopes, moved = attention_lm.gradient(model, w, 1e-5)[1], attention_lm.local_steps(model, w, 1e-5)
    assert len(list(attention_lm._steps(w))) == 1
    for name in model.names:
        by = getattr(slopes, name)
        assert np.allclose(getattr(moved, name), getattr(model, name) - 0.3 * by / np.sqrt(1e-8 + by**2), atol=1e-4), name


def some_tables():
    """Tables with the words a0 to a299 as top words and even chances for ids."""
    with open(attention_lm.TOKENIZER, "rb") as source:
        file = source.read()
    size = attention_lm.Vocabulary(file).size
    top = {f"a{i}".encode(): 1 << max(0, 12 - i) for i in range(300)}
    words = pa.table({"word": pa.array(list(top), pa.binary()), "c": list(top.values())})
    none, flat = np.zeros(0), np.full(size, 1 / size)
    nodes = np.zeros(0, np.uint64), none, none, none
    return attention_lm.Tables(file, sum(top.values()), 300, words, *nodes, flat, flat, flat * 0 + 0.1, flat, np.zeros(0, np.int64), none, flat * 0 + 1)


def test_frequent_words_stay_looked_up_and_streams_do_not_change():
    """Past the bound only words of one batch go; a worker's next task finds what the one before looked up."""
    held = some_tables()
    words, plain = held.words(left_out=1), attention_lm.Words(held, 1)
    words.shrink_at, learned, learn = 200, [], words._learn
    words._learn = lambda fresh: (learned.extend(fresh), learn(fresh))
    often = [f"a{i}".encode() for i in range(20)]
    for part in range(30):
        batch = [*often, *(f"b{part}x{i}".encode() for i in range(20)), b""]
        opens = np.array([0, 7])
        for a, b in zip(words.stream(words.of(batch), opens), plain.stream(plain.of(batch), opens)):
            assert np.array_equal(a, b)
    assert all(learned.count(w) == 1 for w in often) and len(words.codes) < len(plain.codes) == 621
    assert held.words(left_out=1) is words and held.words() is not words and held.words() is held.words()
    codes = held.words().of([b"a3", b"b"])
    base = held.words().base[codes]
    assert base[0] == math.log10((512 + 0.1) / held.room) and math.isnan(base[1])


def test_words_of_a_column_are_those_of_its_texts(monkeypatch):
    texts = [None, "", " \n", "Ab\x0bÄB  c\u00a0d\x1ce ", "x", *(t for _, t, *_ in EDGE), "\ty z\r"]
    texts = [*texts, *(f"{i} b " * 9 for i in range(40))]
    expected = [[*words_of(t), attention_lm.END] for t in texts]
    for rows, words in ((500, 100_000), (7, 60), (1, 1)):
        monkeypatch.setattr(attention_lm, "CUT_TEXTS", rows)
        monkeypatch.setattr(attention_lm, "BATCH_WORDS", words)
        parts = [[[w.encode() for w in found] for found in part.to_pylist()] for part in attention_lm._cut(pa.array(texts, pa.string()))]
        assert [found for part in parts for found in part] == expected
        assert all(sum(map(len, part)) >= words > sum(map(len, part[:-1])) for part in parts[:-1])


def test_scores_against_brute_force(spark):
    """Base scores and counts exactly; on held-out texts the model beats single subword ids by far."""
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    found = {r.doc_id: r for r in attention_lm.score_texts(documents, top_words=500).collect()}
    seen = Counter()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 10:
            seen.update(text.encode().lower().split())
            seen[b""] += 1
    total, room = sum(seen.values()), sum(seen.values()) + 0.1 * (len(seen) + 1)
    with open(attention_lm.TOKENIZER, "rb") as source:
        vocabulary = attention_lm.Vocabulary(source.read())
    single = Counter()
    for word, n in seen.items():
        for x in vocabulary.ids(word):
            single[x] += n
    many = sum(single.values()) + 0.1 * vocabulary.size
    model = plain = 0.0
    for i, text in rows:
        tokens = [*text.encode().lower().split(), b""]
        r = found[i]
        assert math.isclose(r.base_score, sum(math.log10((seen[t] + 0.1) / room) for t in tokens), rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(seen[t] > 0 for t in tokens), total)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0) and r.score < 0
        if r.held_out:
            model += r.score
            plain += sum(math.log10((single[x] + 0.1) / many) for t in tokens for x in vocabulary.ids(t))
    assert model > 0.9 * plain


@pytest.mark.parametrize("rows", [EDGE, []])
def test_score_cases(spark, rows):
    found = attention_lm.score_texts(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in found) == Counter((i, len((t or "").split()) + 1) for i, t, *_ in rows)
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in found)
    again = {(r.doc_id, r.n_tokens): r.score for r in found}
    assert len({round(s, 6) for (i, n), s in again.items() if n == 1}) <= 1


def test_every_training_text_trains_in_wide_windows_from_equal_weights():
    assert attention_lm.ROUNDS >= attention_lm.SHARE and 2 * attention_lm.STRIDE <= attention_lm.WINDOW
    assert not attention_lm.Attention.start().gate.any()


def test_held_out_texts_score_at_least_the_base(spark):
    found = attention_lm.score_texts(table(spark, "/root/testdata/sf0.1", "documents")).filter("held_out")
    model, base = found.agg(F.sum("score"), F.sum("base_score")).first()
    assert model >= base
