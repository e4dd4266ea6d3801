"""Operator 12: spelling variants."""

import random
import re
import zlib
from collections import Counter

import pytest
from llm_cases import EDGE, docs

from strata.llm import spelling
from strata.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def counted(rows):
    """Words by the contract's own text: a run at a time."""
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    """One edit apart, by trying every edit."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    by_start = {}
    for w in words:  # two near words share their first or last two letters, or (one dropped in front) almost
        by_start.setdefault(len(w), []).append(w)
    out = set()
    for w in words:
        beside = [x for d in (-1, 0, 1) for x in by_start.get(len(w) + d, []) if near(w, x)]
        best = min(beside, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 2 * words[w] else None
        out.add((w, words[w], len(beside), form, words[form] if form else None))
    return out


def with_roots(rows):
    form = {r[0]: r[3] for r in rows}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(*r, root(r[0])) for r in rows}


def result(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = with_roots(brute(counted(rows)))
    got = result(REGISTRY["op12_spelling"](spark, SF))
    assert got == want and any(r[3] for r in got)


@pytest.mark.parametrize("most_pairs", [1, 50, 4096])
def test_crowded_chunks_are_refined_without_loss(spark, most_pairs):
    """Few letters, so that chunks are shared by very many words."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(700)]
    words += [w[:-1] + "z" for w in words[:100]] + ["a" * 30, "a" * 29, "a" * 31, "b" + "a" * 29]
    rows = [(i, " ".join(rng.choices(words, k=200))) for i in range(60)] + [(None, "aaaaa bbbbb " * 3)]
    want = with_roots(brute(counted(rows)))
    got = result(spelling.variants(docs(spark, [(i, t, "en", "s") for i, t in rows]), most_pairs=most_pairs))
    assert got == want and max(r[2] for r in got) > 5


def test_runs_letters_and_edge_cases(spark):
    assert spelling.text_words("1", "Été×StraßeŸnaïveté—FOOBARBAZ") .keys() <= {
        "Été×straße".encode("latin-1"), "naïveté".encode("latin-1"), b"foobarbaz"
    } | {w[:i] + w[i + 1 :] for w in [b"foobarbaz", "naïveté".encode("latin-1")] for i in range(9)}
    table = docs(spark, EDGE)
    rows = [(r.doc_id, r.text) for r in table.collect()]
    assert result(spelling.variants(table)) == with_roots(brute(counted(rows)))
    assert spelling.variants(docs(spark, [])).count() == 0
    assert spelling.variants(docs(spark, [(1, None, "en", "a"), (2, "", "en", "a")])).count() == 0
