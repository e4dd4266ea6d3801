"""Operators 2, 3, 8, 10 and the registry."""

import hashlib
import math
import re
import textwrap
from collections import Counter, defaultdict

import pytest
from check import compare, connect
from llm_cases import DOCS, EDGE, LONG, docs
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strata.llm import block_naming, licences, mixing, warc
from strata.llm.oracle import ORACLE
from strata.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in entry.queries() if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, name):
    assert compare(spark, connect(SF), SF, REGISTRY[name], ORACLE[name]).startswith("ok")


# --- block naming ---------------------------------------------------------------


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("options", [{}, {"block_chars": 7}, {"block_chars": 5, "digest": lambda b: F.substring(F.md5(b), 1, 1)}])
def test_exact_groups_are_those_of_equal_texts(spark, options):
    rows = [r for r in EDGE if r[1] is None or len(r[1]) < 10_000 or options.get("block_chars", 9) > 6]
    found = block_naming.exact_groups(docs(spark, rows), **options).collect()
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[squeezed(text)].append((-len(text or ""), i is None, i))
    want = Counter()
    for i, text, *_ in rows:
        members = groups[squeezed(text)]
        want[i, min(members)[2], len(members), hashlib.sha256(squeezed(text).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == want
    assert sum(r.kept for r in found) == len(groups)


def test_drop_copies_keeps_one_row_of_a_group(spark):
    kept = block_naming.drop_copies(docs(spark, EDGE))
    assert kept.columns == [f.name for f in DOCS]
    texts = [squeezed(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({squeezed(t) for _, t, *_ in EDGE})
    assert block_naming.drop_copies(docs(spark, [])).count() == 0


# --- mixing ------------------------------------------------------------------------


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    free, left = set(names), float(sum(sizes.values()))
    while free and left > 1e-9:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] >= 3 * sizes[s]}
        if not over:
            target |= {s: share * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_and_copies(spark):
    rows = EDGE + [(100 + i, "w " * (i % 40 + 1), "en", f"s{i % 5}" if i % 3 else "hot") for i in range(600)]
    found = mixing.systematic_copies(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += size_of(text)
    target = water(sizes)
    taken, longest = Counter(), Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], abs_tol=1e-6)
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        longest[r.source] = max(longest[r.source], r.size)
    for source in sizes:
        assert abs(taken[source] - target[source]) <= longest[source] + 1e-6
    again = mixing.systematic_copies(docs(spark, rows).repartition(7)).collect()
    assert Counter((r.doc_id, r.size, r.copies) for r in again if r.doc_id) == Counter((r.doc_id, r.size, r.copies) for r in found if r.doc_id)


def test_mix_emits_a_row_per_copy(spark):
    own = ["_id", "_share", "_size", "_source", "_copies", "_rows", "id", "rows", "share", "copies"]
    table = docs(spark, EDGE).withColumns({c: F.lit(c) for c in own})
    plan = Counter()
    for r in mixing.systematic_copies(table).collect():
        plan[r.doc_id, r.size] += r.copies
    mixed = mixing.mix(table)
    assert mixed.columns == [*table.columns, "copy"]
    assert {tuple(r) for r in mixed.select(own).collect()} == {tuple(own)}
    assert Counter((r.doc_id, size_of(r.text)) for r in mixed.collect()) == Counter({k: v for k, v in plan.items() if v})
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mixed_words(docs(spark, [])).count() == 0


# --- WARC --------------------------------------------------------------------------


PAGES = [(1, "http://a/1", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://a/\r\n3", None), (4, "http://a/4", ""),
         (5, "u", "é" * 5000), (5, "u", "é" * 5000), (None, "u", "<p>same</p>"), (6, "u", LONG)]


@pytest.mark.parametrize("least", [0, 12])
def test_archives_read_back_chunk_by_chunk(spark, tmp_path, least):
    pages = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, payload string")
    manifest = warc.archive_pages(pages, chunk_bytes=1000, min_revisit=least, folder=f"file:{tmp_path}/w{least}")
    chunks = warc.read_archives(manifest, chunk_bytes=900).collect()
    records = defaultdict(list)
    for c in chunks:
        records[c.file, c.record_at].append(c)
    assert len(records) == len(PAGES)
    whole = {i: (h or "").encode() for i, _, h in PAGES}
    seen = Counter()
    for parts in records.values():
        parts.sort(key=lambda c: c.chunk_no)
        page = int(parts[0].page_id) if parts[0].page_id else None
        seen[page] += 1
        digest = hashlib.sha1()
        for c in parts:
            assert len(c.data) <= 900
            digest.update(bytes(c.data))
            assert c.running_digest == warc.base32(digest.digest())
        assert [c.last for c in parts] == [False] * (len(parts) - 1) + [True]
        data = b"".join(bytes(c.data) for c in parts)
        assert parts[0].declared_bytes == len(whole[page])
        assert parts[0].declared_digest == warc.base32(hashlib.sha1(whole[page]).digest())
        if parts[0].record_type == "response":
            assert data == whole[page]
        else:
            assert data == b"" and whole[int(parts[0].refers_to)] == whole[page]
    assert seen == Counter(i for i, *_ in PAGES)
    revisits = {c.page_id for c in chunks if c.record_type == "revisit"}
    assert revisits == ({"2", "4", None} if least == 0 else set())


def test_no_pages_no_archives(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    manifest = warc.archive_pages(none, folder=f"file:{tmp_path}/none")
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0


# --- licences ------------------------------------------------------------------------


def test_ordered_rules_take_the_longest_text(spark):
    mit = " ".join(licences.SENTENCES[k][0] for k in ("mit-grant", "mit-notice", "mit-as-is", "mit-liability"))
    bsd = "\n".join(licences.SENTENCES[k][0] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 Somebody\n" + mit, "en", "a"),
        (2, bsd, "en", "a"),
        (3, bsd + "\n" + licences.SENTENCES["bsd-endorse"][0], "en", "a"),
        (14, "Some text. RELEASED*** under the MIT%%% License.&&& More text\nAll rights reserved.", "en", "a"),
        (15, "This sentence says licensed under the MIT License.", "en", "a"),
    ]
    found = {r.doc_id: r for r in licences.recognise(docs(spark, rows + EDGE[3:6])).collect()}
    assert found[1].licences == ["MIT"] and found[1].sentence_ids[0] == "mit-ref"
    assert found[2].licences == ["BSD-2-Clause"] and found[3].licences == ["BSD-3-Clause"]
    assert found[14].licences == ["MIT", "LicenseRef-all-rights-reserved"]
    assert found[15].licences == [] and found[4].licences == [] and found[6].sentence_ids == []
    assert licences.recognise(docs(spark, [])).count() == 0


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * "])
def test_wrapped_texts_are_the_same_licences(spark, mark):
    texts = {
        "MIT": ["MIT License", "Copyright (c) 2020 Somebody", *(licences.SENTENCES[k][0] for k in ("mit-grant", "mit-notice"))],
        "BSD-3-Clause": [licences.SENTENCES[k][0] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")],
        "Apache-2.0": [licences.SENTENCES["apache-2-ref"][1], "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0"],
        "GPL-3.0-or-later": [licences.SENTENCES[k][0] for k in ("gpl-3-later", "gpl-hope", "gpl-details")],
    }
    texts["MIT"].append(" ".join(licences.SENTENCES[k][0] for k in ("mit-as-is", "mit-liability")))
    rows = []
    for i, (name, parts) in enumerate(texts.items()):
        lines = [line for part in parts for line in [*(textwrap.wrap(part, 78) if "\n" not in part else part.split("\n")), ""]]
        rows.append((i, "\n".join(mark + line for line in lines), name, "a"))
    found = {r.doc_id: r for r in licences.recognise(docs(spark, rows)).collect()}
    for i, (name, parts) in enumerate(texts.items()):
        assert found[i].licences == [name] and len(found[i].sentence_ids) == len(parts)
