"""DuckDB counterparts of the registered queries that SQL can express."""

from __future__ import annotations

from strata.llm import licences

ORACLE: dict[str, str] = {}

ORACLE["op2_warc_chunks"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x,
         min(page_id) OVER (PARTITION BY sha1(h)) AS lowest
  FROM p
)
SELECT page_id, payload_bytes,
       array_to_string([
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST(('0x' || substr(x, CAST((i // 4) * 5 + 1 AS INTEGER), 5)) AS BIGINT)
             >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)
         FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = lowest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = lowest THEN NULL ELSE lowest END AS refers_to
FROM d
"""

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

#: Targets and copies over a table `{docs}`; `{columns}` of it are carried along.
MIX = r"""
sizes AS (
  SELECT *, {words} AS size FROM {docs}
), per_source AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS total FROM sizes GROUP BY source
), ranked AS (
  SELECT source, total, row_number() OVER (ORDER BY source IS NULL, source) AS r FROM per_source
), weighed AS (
  SELECT source, total, r, CAST((r - 1) % 3 + 1 AS DOUBLE) AS w, 3 * total AS cap FROM ranked
), levels AS (
  SELECT *, (sum(total) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM weighed
), water AS (
  SELECT min(lv) FILTER (cap > lv * w) AS most FROM (
    SELECT *, row_number() OVER (ORDER BY cap / w, r) AS o FROM levels
  ) WHERE o = (SELECT min(o) FROM (SELECT cap, lv, w, row_number() OVER (ORDER BY cap / w, r) AS o FROM levels) WHERE cap > lv * w)
), goal AS (
  SELECT source, total,
    CASE WHEN cap <= lv * w THEN cap ELSE least(cap, most * w) END AS target,
    CAST(CAST(('0x' || substr(md5('mix/' || CAST(r AS VARCHAR)), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0 AS off
  FROM levels, water
), ordered AS (
  SELECT s.*, CAST(g.total AS BIGINT) AS source_size, g.target, g.off,
    CASE WHEN g.total > 0 THEN g.target / g.total ELSE 0 END AS e,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS LAST) - 1 AS k
  FROM sizes s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
), copied AS (
  SELECT *, CAST(floor((k + 1) * e + off) - floor(k * e + off) AS BIGINT) AS copies FROM ordered
)
"""

ORACLE["op3_systematic_mix"] = (
    "WITH " + MIX.format(words=WORDS, docs="documents") + "SELECT doc_id, size, source_size, target, size * copies AS taken FROM copied"
)


def _licence_sql() -> str:
    known = licences.known_sentences()
    table = ", ".join(f"('{s}', '{key}')" for s, key in known.items())
    matched = "array_to_string(['[' || s || ']' FOR s IN ids], '')"
    for licence, rule in licences.RULES:
        matched = f"regexp_replace({matched}, '{licences.rule_pattern(rule)}', '<{licence}>', 'g')"
    return rf"""
WITH cut AS (
  SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(lower(coalesce(text, '')),
    '[.!?][^a-z0-9\s]*\s+|[\n\r]+', chr(10), 'g'), '[^a-z0-9\n]+', ' ', 'g'), ' ?\n ?') AS parts
  FROM documents
), known(sentence, id) AS (VALUES {table}
), numbered AS (
  SELECT doc_id, unnest(parts) AS sentence, unnest(range(len(parts))) AS pos FROM cut
), hits AS (
  SELECT doc_id, list(id ORDER BY pos) AS ids FROM numbered JOIN known ON trim(numbered.sentence) = known.sentence GROUP BY doc_id
), all_docs AS (
  SELECT d.doc_id, coalesce(h.ids, []) AS ids FROM documents d LEFT JOIN hits h USING (doc_id)
)
SELECT doc_id, array_to_string(ids, ' ') AS sentence_ids,
       array_to_string(regexp_extract_all({matched}, '<([^>]+)>', 1), ' ') AS licences
FROM all_docs
"""


ORACLE["op8_licence_rules"] = _licence_sql()

ORACLE["op10_block_naming"] = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k
  FROM documents
), w AS (
  SELECT doc_id, sha256(k) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY k ORDER BY n_chars DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY k) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM w
"""

ORACLE["op13_filter_audit"] = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), fails AS (
  SELECT doc_id, part,
         len(w) < 200 AS a,
         100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM words
), flagged AS (
  SELECT f.*, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM fails f LEFT JOIN (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
  ) l USING (doc_id)
), masks AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
                      CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS m,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM flagged GROUP BY ALL
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier
  FROM orders, range(1, 6) r(step)
), counted AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN len(list_intersect(string_split(m, ''), string_split(concat(earlier, f), ''))) = 0 OR m = '' THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN contains(m, f) AND (earlier = '' OR len(list_intersect(string_split(m, ''), string_split(earlier, ''))) = 0) THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN contains(m, f) AND earlier <> '' AND len(list_intersect(string_split(m, ''), string_split(earlier, ''))) > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN m = f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN contains(m, f) AND (earlier = '' OR len(list_intersect(string_split(m, ''), string_split(earlier, ''))) = 0) THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN contains(m, f) AND (earlier = '' OR len(list_intersect(string_split(m, ''), string_split(earlier, ''))) = 0) THEN toxic ELSE 0 END) AS toxic_lost
  FROM masks, steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""
