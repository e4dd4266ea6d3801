"""DuckDB counterparts of the registered queries, on the same tables.

Written as plain relational SQL: full cross products, recursive walks and
window sums where the Spark side prunes, folds or packs.
"""

from __future__ import annotations

from strata import constants as K


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = lit(K.WHITESPACE)


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def tok(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


LINES = r"regexp_split_to_array(text, '\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
NL = "chr(10)"
TITLE_RE = lit(K.TITLE_PATTERN)


def title(x: str) -> str:
    t = trim(f"coalesce({x}, '')")
    found = f"regexp_extract({t}, {TITLE_RE}, 1)"
    return (
        f"CASE WHEN {found} <> '' THEN {trim(found)} "
        f"ELSE left({trim(f'split_part({t}, {NL}, 1)')}, 120) END"
    )


def number(x: str) -> str:
    return f"try_cast(nullif(regexp_extract({trim(x)}, '(?i)^chapter_([0-9]+)$', 1), '') AS INT)"


def preview(x: str, n: int) -> str:
    return f"left({x}, {n}) || CASE WHEN length({x}) > {n} THEN '…' ELSE '' END"


# --- shared tables -----------------------------------------------------------

DOCS = """docs AS (
  SELECT doc_id::VARCHAR AS doc_id, text, printf('chapter_%04d', doc_id // 20 + 1) AS chapter_id,
    (doc_id % 20)::INT AS chunk_index, CASE WHEN doc_id % 2 = 0 THEN 'chunk' END AS doc_kind,
    NULL::VARCHAR AS chapter_title
  FROM documents)"""
SUMM = f"""summ AS (
  SELECT printf('chapter_%04d', conv_id * 2) || '_summary' AS doc_id, {trim('text')} AS text,
    printf('chapter_%04d', conv_id * 2) AS chapter_id, -1 AS chunk_index,
    'chapter_summary' AS doc_kind, CASE WHEN conv_id % 3 = 0 THEN 'Part ' || conv_id END AS chapter_title
  FROM conversations WHERE turn = 1 AND {trim('text')} <> '')"""
CORPUS = f"""{DOCS}, {SUMM}, corpus AS (
  SELECT c.*, e.embedding::DOUBLE[] AS vector
  FROM (SELECT * FROM docs UNION ALL SELECT * FROM summ) c
  LEFT JOIN embeddings e ON c.doc_id = e.vec_id::VARCHAR)"""
QUERIES = """queries AS (
  SELECT item_id AS query_id, text AS query_text, embedding::DOUBLE[] AS query_vector
  FROM benchmark LEFT JOIN embeddings ON item_id = vec_id)"""
SHORT = f"""queries AS (
  SELECT item_id AS query_id, {tok('text')}[-1] AS query_text, embedding::DOUBLE[] AS query_vector
  FROM benchmark LEFT JOIN embeddings ON item_id = vec_id)"""
CHAT = """queries AS (
  SELECT conv_id AS query_id, arg_max(text, turn) AS query_text
  FROM conversations WHERE role = 'user' GROUP BY conv_id)"""
NAMES = f"""names AS (
  SELECT DISTINCT character FROM (SELECT {tok('text')}[-1] AS character FROM benchmark)
  WHERE length(character) >= 2)"""
TF = f"""tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM corpus)
  GROUP BY doc_id, term),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
PART = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"
BM = f"""{TF}, qt AS (SELECT query_id, unnest({tok('query_text')}) AS term FROM queries),
bm AS (
  SELECT query_id, doc_id, round(sum({PART}), 9) AS kw
  FROM qt JOIN dfs USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st
  GROUP BY query_id, doc_id)"""
BM_TOP = """SELECT * FROM (
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY kw DESC, doc_id) AS rank,
    kw AS score FROM bm) WHERE rank <= 10"""
COS = "round(list_cosine_similarity(vector, query_vector), 9)"
CHUNK = "(doc_kind = 'chunk' OR doc_kind IS NULL)"


def norm(mode: str, sat: float = 15.0) -> str:
    kw = "greatest(coalesce(kw, 0), 0)"
    return {
        "raw": kw,
        "saturation": f"{kw} / ({kw} + {sat})",
        "log1p": f"least(1.0, round(ln(1 + {kw}), 9) / 10.0)",
    }[mode]


def weighted(mode: str = "saturation", wv: float = 0.7, wk: float = 0.3, sat: float = 15.0, name: str = "fused") -> str:
    return f"""{name} AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT q.query_id, q.query_text, c.doc_id, c.text, c.chapter_id, c.chunk_index,
      {wv} * least(1.0, greatest(0.0, {COS})) + {wk} * ({norm(mode, sat)}) AS score
    FROM queries q CROSS JOIN corpus c LEFT JOIN bm ON bm.query_id = q.query_id AND bm.doc_id = c.doc_id
    WHERE vector IS NOT NULL AND query_vector IS NOT NULL AND {CHUNK}))"""


def rrf(k_near: int) -> str:
    return f"""kwleg AS (
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY kw DESC, doc_id) AS r
  FROM bm JOIN corpus USING (doc_id) WHERE {CHUNK}),
vleg AS (
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY {COS} DESC, doc_id) AS r
  FROM queries CROSS JOIN corpus WHERE vector IS NOT NULL AND query_vector IS NOT NULL AND {CHUNK}),
fused AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT query_id, doc_id, coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) AS score
    FROM (SELECT * FROM kwleg WHERE r <= 50) a FULL JOIN (SELECT * FROM vleg WHERE r <= {k_near}) b
    USING (query_id, doc_id)))"""


DENSITY = f"""(CASE WHEN len(string_split(text, {trim('query_text')})) > 1
  THEN round(ln(len(string_split(text, {trim('query_text')}))), 9)
    + least((len(string_split(text, {trim('query_text')})) - 1) / (length(text) / 200.0), 4.0)
  ELSE 0 END)"""


def reranked(active: str) -> str:
    return f"""SELECT query_id, doc_id, rank, score FROM (
  SELECT query_id, doc_id, new_score AS score, row_number() OVER (
      PARTITION BY query_id ORDER BY CASE WHEN active THEN new_score END DESC, rank) AS rank
  FROM (SELECT *, CASE WHEN active THEN CASE WHEN score > 0 THEN score * (1 + 0.35 * d) ELSE d END
      ELSE score END AS new_score
    FROM (SELECT *, {active} AS active, {DENSITY} AS d FROM fused) WHERE rank <= CASE WHEN active THEN 50 ELSE 10 END)
) WHERE rank <= 10"""


BASE = f"{CORPUS}, {QUERIES}, {BM}"
# The formatted hit list of 20 that the context queries start from.
HITS = f"""{BASE}, {weighted()}, hits AS (
  SELECT query_id, query_text, doc_id, rank, score, left(text, 4000) AS text, length(text) > 4000 AS text_truncated,
    chapter_id, chunk_index FROM fused WHERE rank <= 20)"""
LOOSE = f"""{HITS}, loose AS (
  SELECT * EXCLUDE (chapter_id), CASE WHEN doc_id::INT % 3 <> 0 THEN chapter_id END AS chapter_id FROM hits)"""
CHAPTERS = f"""chapters AS (
  SELECT chapter_id, {number('chapter_id')} AS chapter_number,
    {title("first(text ORDER BY chunk_index, doc_id)")} AS title,
    {trim(f"string_agg(text, {NL} ORDER BY chunk_index, doc_id)")} AS full_text, count(*) AS chunk_count
  FROM corpus WHERE {CHUNK} AND text <> '' GROUP BY chapter_id)"""
LOOKUP = f"""lookup AS (
  SELECT chapter_id, coalesce(nullif({trim('chapter_title')}, ''), {title('text')}) AS title, text AS summary
  FROM corpus WHERE doc_kind = 'chapter_summary')"""


def chapter_scores(hits: str, k: int) -> str:
    return f"""chosen AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank) AS slot FROM (
    SELECT query_id, chapter_id, max(score) * (1 + 0.3 * round(ln(1 + count(*)), 9)) AS score,
      count(*) AS hit_count, first(doc_id ORDER BY score DESC, rank) AS best_doc,
      first(rank ORDER BY score DESC, rank) AS best_rank, first(chunk_index ORDER BY score DESC, rank) AS best_index,
      first(text ORDER BY score DESC, rank) AS best_text, min(rank) AS first_rank
    FROM {hits} WHERE chapter_id IS NOT NULL GROUP BY query_id, chapter_id)) WHERE slot <= {k})"""


def units(hits: str, k: int, use_summaries: bool = True) -> str:
    look = "lookup" if use_summaries else "(SELECT * FROM lookup WHERE false)"
    return f"""{CHAPTERS}, {LOOKUP}, {chapter_scores(hits, k)},
picked AS (
  SELECT query_id, CASE WHEN l.summary IS NOT NULL THEN 'chapter_summary'
      WHEN hit_count >= 2 AND full_text <> '' THEN 'chapter' ELSE 'chunk' END AS kind,
    CASE WHEN l.summary IS NOT NULL THEN l.summary WHEN hit_count >= 2 AND full_text <> '' THEN full_text
      ELSE {trim('best_text')} END AS text, c.chapter_id,
    CASE WHEN l.summary IS NOT NULL THEN nullif({trim('l.title')}, '')
      WHEN hit_count >= 2 AND full_text <> '' THEN nullif({trim('h.title')}, '') END AS title,
    score, hit_count, best_rank AS rank,
    CASE WHEN l.summary IS NULL AND hit_count < 2 THEN best_index END AS chunk_index,
    CASE WHEN l.summary IS NULL AND hit_count < 2 THEN best_doc END AS doc_id, slot
  FROM chosen c LEFT JOIN {look} l ON l.chapter_id = c.chapter_id LEFT JOIN chapters h ON h.chapter_id = c.chapter_id),
orphans AS (
  SELECT query_id, 'chunk' AS kind, {trim('text')} AS text, NULL AS chapter_id, NULL AS title, score,
    1 AS hit_count, rank, chunk_index, doc_id,
    1000 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS slot
  FROM {hits} WHERE chapter_id IS NULL AND {trim('text')} <> ''),
both_units AS (
  SELECT * FROM picked UNION ALL
  SELECT o.* FROM orphans o LEFT JOIN (SELECT query_id, count(*) AS used FROM picked GROUP BY query_id) p USING (query_id)
  WHERE o.slot - 1000 <= {k} - coalesce(used, 0)),
units AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY
    CASE kind WHEN 'chapter_summary' THEN 0 WHEN 'chapter' THEN 1 ELSE 2 END, score DESC, slot) AS ref
  FROM both_units WHERE text <> '')"""


UNIT_OUT = """SELECT query_id, ref, kind, text, chapter_id, title, score, hit_count, rank,
  chunk_index, doc_id FROM units"""


def packed(max_chars: int) -> str:
    """Walk over the units of each query with the used budget as state."""
    suffix = (
        f"CASE kind WHEN 'chapter_summary' THEN {lit(K.CUT_SUMMARY)} "
        f"WHEN 'chapter' THEN {lit(K.CUT_CHAPTER)} ELSE {lit(K.CUT_CHUNK)} END"
    )
    header = f"""'[' || ref || ']' || coalesce(' chapter_id=' || chapter_id, '')
      || CASE WHEN kind <> 'chunk' AND title <> '' THEN ' title=' || title ELSE '' END
      || CASE WHEN kind = 'chapter_summary' THEN ' kind=chapter_summary' ELSE '' END
      || CASE WHEN kind = 'chunk' AND chunk_index IS NOT NULL THEN ' chunk=' || chunk_index ELSE '' END
      || coalesce(' id=' || doc_id, '') || {NL}"""
    return f"""headed AS (
  SELECT *, {header} AS header, {suffix} AS suffix FROM units),
blocks AS (SELECT *, header || text || {NL} AS block_full FROM headed),
walk AS (
  SELECT *, 0 AS before, least(length(block_full), {max_chars} + 1) AS used FROM blocks WHERE ref = 1
  UNION ALL
  SELECT b.*, w.used, least(w.used + length(b.block_full), {max_chars} + 1)
  FROM walk w JOIN blocks b ON b.query_id = w.query_id AND b.ref = w.ref + 1 WHERE w.used <= {max_chars}),
judged AS (
  SELECT *, before + length(block_full) > {max_chars} AS text_truncated, {max_chars} - before AS remain,
    {max_chars} - before - length(header) - length(suffix) AS body FROM walk),
packed AS (
  SELECT *, CASE WHEN text_truncated THEN left(text, body) ELSE text END AS text_for_llm,
    CASE WHEN text_truncated THEN header || left(text, body) || suffix ELSE block_full END AS block
  FROM judged WHERE NOT text_truncated OR (body >= 60 AND remain >= CASE kind WHEN 'chunk' THEN 80 ELSE 120 END))"""


def context(max_chars: int) -> str:
    return f"""{HITS}, {units('hits', 5)}, {packed(max_chars)}"""


def joined(max_chars: int, k: int) -> str:
    return f"""WITH RECURSIVE {HITS}, {units('hits', k)}, {packed(max_chars)}, ctx AS (
  SELECT q.query_id, q.query_text, coalesce(p.context, '') AS context, coalesce(p.n, 0) AS n_sources
  FROM queries q LEFT JOIN (SELECT query_id, {trim(f"string_agg(block, {NL} ORDER BY ref)")} AS context, count(*) AS n
    FROM packed GROUP BY query_id) p USING (query_id))"""


def hit_blocks(max_chars: int) -> str:
    header = f"""'[' || rank || '] id=' || doc_id || coalesce(' chapter_id=' || chapter_id, '')
      || coalesce(' chunk=' || chunk_index, '') || {NL}"""
    return f"""full_blocks AS (
  SELECT * EXCLUDE (text), {trim('text')} AS text, {header} || {trim('text')} || {NL} AS full_block,
    row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM hits WHERE {trim('text')} <> ''),
hwalk AS (
  SELECT *, 0 AS before, length(full_block) AS used FROM full_blocks WHERE n = 1
  UNION ALL
  SELECT b.*, w.used, w.used + length(b.full_block)
  FROM hwalk w JOIN full_blocks b ON b.query_id = w.query_id AND b.n = w.n + 1 WHERE w.used <= {max_chars}),
hpacked AS (
  SELECT *, CASE WHEN used <= {max_chars} THEN full_block
    ELSE left(full_block, ({max_chars} - before)::INT) || {lit(K.CUT_CHUNK)} END AS block
  FROM hwalk WHERE used <= {max_chars} OR {max_chars} - before >= 80)"""


SENTENCES = f"""list_filter(list_transform(regexp_extract_all({trim('text')}, '[^.!?]*[.!?]|[^.!?]+'),
  lambda s: {trim('s')}), lambda s: s <> '')"""


def chunk_rows(lo: int, hi: int, overlap: int) -> str:
    """Walk over the pieces of each document, counting chunks; then glue."""
    opens = f"(w.held = 0 OR w.held + length(p.piece) > {hi})"
    size = f"CASE WHEN {opens} THEN length(p.piece) ELSE w.held + length(p.piece) END"
    shown = trim(f"coalesce(right(lag(text) OVER (PARTITION BY doc_id ORDER BY c), {overlap}), '') || text")
    return f"""WITH RECURSIVE {DOCS}, cut AS (
  SELECT doc_id, flatten(list_transform({SENTENCES},
    lambda s: regexp_extract_all(s, '(?s).{{1,{hi}}}'))) AS l FROM docs),
pieces AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM cut),
walk AS (
  SELECT doc_id, i, piece, 1 AS c, CASE WHEN length(piece) >= {lo} THEN 0 ELSE length(piece) END AS held
  FROM pieces WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.i, p.piece, CASE WHEN {opens} THEN w.c + 1 ELSE w.c END,
    CASE WHEN {size} >= {lo} THEN 0 ELSE {size} END
  FROM walk w JOIN pieces p ON p.doc_id = w.doc_id AND p.i = w.i + 1),
glued AS (SELECT doc_id, c, {trim("string_agg(piece, '' ORDER BY i)")} AS text FROM walk GROUP BY doc_id, c),
ranked AS (
  SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY c) AS c,
    count(*) OVER (PARTITION BY doc_id) AS n FROM glued WHERE text <> ''),
merged AS (
  SELECT doc_id, least(c, CASE WHEN n >= 2 AND last_len < {max(1, lo // 2)} THEN n - 1 ELSE n END) AS c, c AS old, text
  FROM (SELECT *, first(length(text)) OVER (PARTITION BY doc_id ORDER BY c DESC) AS last_len FROM ranked)),
chunks AS (SELECT doc_id, c, {trim("string_agg(text, '' ORDER BY old)")} AS text FROM merged GROUP BY doc_id, c),
shown AS (SELECT doc_id, c, {shown if overlap else 'text'} AS text FROM chunks)
SELECT doc_id || printf('_c%03d', c) AS doc_id, text, doc_id AS chapter_id, c - 1 AS chunk_index FROM shown"""


BOOKS = f"""books AS (
  SELECT doc_id AS book_id, array_to_string(list_transform(string_split(text, {NL}), lambda l, i:
    CASE WHEN (i - 1) % 3 = 2 THEN '正文 ' || (i - 1) || {NL} ELSE '' END
    || CASE WHEN (i - 1) % 5 = 1 THEN '分节阅读 ' || (i - 1) || {NL} ELSE '' END
    || l || CASE WHEN (i - 1) % 7 = 6 THEN {NL} || '------------' ELSE '' END), {NL}) AS text
  FROM documents)"""
NOISE = rf"^[{K.INLINE_SPACE_CLASS}]*(?:-{{2,}}[{K.INLINE_SPACE_CLASS}]*|分节阅读.+)$"


def re2(pattern: str) -> str:
    r"""Java escapes to RE2 escapes: \uXXXX -> \x{XXXX}."""
    import re

    return re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", pattern)


CLEAN = f"""{BOOKS}, clean AS (
  SELECT book_id, list_filter({LINES}, lambda l: NOT regexp_matches(l, {lit(re2(NOISE))})) AS l FROM books)"""
BOOK_LINES = f"""{BOOKS}, raw_lines AS (SELECT book_id, {LINES} AS l FROM books),
ln AS (SELECT book_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM raw_lines)"""

_HEX = "('0x' || substr(md5(t), {0}, {1}))::BIGINT"
UPSERT = """SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 5 = 0 THEN 'v2 ' || text
  WHEN doc_id % 3 = 0 THEN text || ' (rev)' ELSE text END AS text FROM documents"""


def dims(key: str, vector: str, source: str) -> str:
    return f"""SELECT {key}, unnest(generate_series(0, len({vector}) - 1)) AS dim,
  round(unnest({vector}), 6) AS x FROM {source}"""


RESPONSES = """g AS (SELECT vec_id // 8 AS response_id, vec_id % 8 AS pos, embedding::DOUBLE[] AS v FROM embeddings)"""

# Per item a rule of two terms: tokens 1 and 2, or (every third) tokens 1 and 2 as one term against token 3.
RULES = f"""toks AS (SELECT item_id, {tok('text')} AS t FROM benchmark),
rl AS (SELECT item_id, CASE WHEN item_id % 3 = 0 AND len(t) > 2 THEN t[1] || chr(31) || t[2] ELSE t[1] END AS a,
  CASE WHEN item_id % 3 = 0 AND len(t) > 2 THEN t[3] ELSE t[2] END AS b FROM toks)"""

ORACLE: dict[str, str] = {
    "corpus_jsonl": f"""WITH {DOCS}, {SUMM}
SELECT doc_id, {trim('text')} AS text, chapter_id, chunk_index, coalesce(doc_kind, 'chunk') AS doc_kind, chapter_title
FROM (SELECT * FROM docs UNION ALL SELECT * FROM summ) WHERE {trim('text')} <> ''""",
    "corpus_jsonl_rejects": f"""SELECT CASE WHEN reason = 'ok' THEN id END AS doc_id,
  CASE WHEN reason = 'ok' THEN ci END AS chunk_index, CASE WHEN reason = 'ok' THEN chars ELSE 0 END AS chars, reason
FROM (SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 10 = 7 THEN 12 END AS ci, length({trim('text')}) AS chars,
  CASE doc_id % 10 WHEN 1 THEN 'no text' WHEN 3 THEN 'not json' WHEN 5 THEN 'bad chunk_index' WHEN 9 THEN 'not an object'
    ELSE 'ok' END AS reason FROM documents)""",
    "corpus_lines": f"""WITH cut AS (
  SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r]') AS l FROM documents),
ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM cut),
num AS (SELECT doc_id % 16 AS part, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id, i) AS no, line FROM ln)
SELECT part::VARCHAR AS part, no::VARCHAR AS doc_id, {trim('line')} AS text FROM num WHERE {trim('line')} <> ''""",
    "term_list": "SELECT DISTINCT source AS character FROM documents WHERE doc_id % 4 <> 0",
    "synonym_rules": f"""WITH {RULES},
numbered AS (SELECT *, row_number() OVER (ORDER BY item_id) AS rule_id FROM rl)
SELECT rule_id, CASE WHEN item_id % 5 <> 0 THEN 'both' WHEN p = 0 THEN 'from' ELSE 'to' END AS side,
  CASE WHEN item_id % 5 <> 0 THEN p ELSE 0 END AS pos, replace(CASE p WHEN 0 THEN a ELSE b END, chr(31), ' ') AS term
FROM numbered, (VALUES (0), (1)) v(p) WHERE CASE p WHEN 0 THEN a ELSE b END IS NOT NULL""",
    "corpus_upsert": UPSERT,
    "corpus_table": f"""SELECT doc_id, text, CASE WHEN doc_id::BIGINT % 5 = 0 THEN 'late' END AS chapter_id FROM ({UPSERT})""",
    "ingest_stream": f"SELECT doc_id, {trim('text')} AS text FROM ({UPSERT})",
    "merged_kinds": f"""WITH {DOCS}, {SUMM}
SELECT doc_id, coalesce(doc_kind, 'chunk') AS doc_kind, chapter_id, chunk_index, chapter_title,
  coalesce(doc_kind, 'chunk') = 'chunk' AS is_chunk
FROM (SELECT * FROM docs UNION ALL SELECT * FROM summ)""",
    "kind_counts": f"""WITH {CORPUS}
SELECT coalesce(doc_kind, 'chunk') AS doc_kind, count(*) AS n_docs FROM corpus GROUP BY 1""",
    "corpus_validation": f"""WITH {CORPUS}
SELECT count(*) AS n_docs, count(*) FILTER ({trim("coalesce(text, '')")} = '') AS n_without_text,
  count(*) FILTER ({trim('doc_id')} = '') AS n_blank_id FROM corpus""",
    "vector_dims": f"WITH {CORPUS} SELECT len(vector) AS dims, count(*) AS n_rows FROM corpus GROUP BY 1",
    "noise_dropped": f"WITH {CLEAN} SELECT book_id, array_to_string(l, {NL}) AS text FROM clean",
    "chapters_by_heading": f"""WITH {CLEAN}, ln AS (
  SELECT book_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM clean),
isl AS (SELECT *, sum((line = '正文' OR line LIKE '正文 %')::INT) OVER (PARTITION BY book_id ORDER BY i) AS g FROM ln),
parts AS (SELECT book_id, g, {trim(f"string_agg(line, {NL} ORDER BY i)")} AS text, max(max(g)) OVER (PARTITION BY book_id) AS top
  FROM isl GROUP BY book_id, g),
pre AS (SELECT book_id, text AS preamble FROM parts WHERE g = 0 AND top > 0 AND text <> '')
SELECT book_id, printf('chapter_%04d', ordinal) AS doc_id, ordinal, text FROM (
  SELECT book_id, greatest(g, 1)::INT AS ordinal,
    CASE WHEN g = 1 AND preamble IS NOT NULL THEN preamble || {NL} || {NL} || text ELSE text END AS text
  FROM parts LEFT JOIN pre USING (book_id) WHERE (g > 0 OR top = 0) AND text <> '')""",
    "sections_marked": f"""WITH {BOOK_LINES},
m AS (SELECT *, regexp_extract(line, '^分节阅读\\s*([0-9]+)\\s*$', 1) AS no, {trim('line')} = '------------' AS is_end FROM ln),
sp AS (SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY book_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM m),
h AS (SELECT book_id, g, min(i) AS start, first(no ORDER BY i) AS no FROM sp WHERE no <> '' GROUP BY book_id, g),
sec AS (SELECT book_id, g, h.no, {trim(f"string_agg(line, {NL} ORDER BY i)")} AS text
  FROM sp JOIN h USING (book_id, g) WHERE i >= start AND NOT is_end GROUP BY book_id, g, h.no),
num AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY g) AS ordinal FROM sec),
pre AS (SELECT book_id, {trim(f"string_agg(line, {NL} ORDER BY i)")} AS preamble
  FROM ln JOIN (SELECT book_id, min(start) AS s FROM h GROUP BY book_id) USING (book_id) WHERE i < s GROUP BY book_id)
SELECT book_id, printf('sanguo_section_%03d', no::BIGINT) AS doc_id, ordinal, no::BIGINT AS section_no,
  CASE WHEN ordinal = 1 AND coalesce(preamble, '') <> '' THEN preamble || {NL} || {NL} || text ELSE text END AS text
FROM num LEFT JOIN pre USING (book_id)""",
    "sentences": f"""WITH {DOCS}, s AS (SELECT doc_id, {SENTENCES} AS l FROM docs)
SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS sentence FROM s""",
    "hard_pieces": f"""WITH {DOCS}, s AS (SELECT doc_id, flatten(list_transform({SENTENCES},
  lambda s: list_transform(generate_series(0, (length(s) - 1) // 40), lambda j: s[j * 40 + 1 : j * 40 + 40]))) AS l FROM docs)
SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS piece FROM s""",
    "chunks": chunk_rows(300, 800, 0),
    "chunks_overlap": chunk_rows(60, 120, 25),
    "tokens": f"""WITH {DOCS}, t AS (SELECT doc_id, list_filter({tok('text')}, lambda w: length(w) >= 2) AS l FROM docs)
SELECT doc_id, len(l) AS n_tokens, array_to_string(l, ' ') AS joined FROM t""",
    "chapter_titles": f"""WITH {DOCS}
SELECT doc_id, {title('text')} AS title, {title("'x 第十2回 ' || text")} AS marked_title,
  {number('chapter_id')} AS chapter_number FROM docs""",
    "embed_hash": f"""WITH {DOCS}, w AS (SELECT doc_id, unnest({tok('text')}) AS t FROM docs),
s AS (SELECT doc_id, {_HEX.format(1, 8)} % 64 AS dim, sum(CASE WHEN {_HEX.format(9, 1)} % 2 = 0 THEN 1 ELSE -1 END) AS x
  FROM w GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM s GROUP BY 1)
SELECT d.doc_id, g.dim, round(CASE WHEN coalesce(norm, 0) > 0 THEN coalesce(x, 0) / norm ELSE 0 END, 6) + 0.0 AS x
FROM docs d CROSS JOIN (SELECT unnest(generate_series(0, 63)) AS dim) g
LEFT JOIN s ON s.doc_id = d.doc_id AND s.dim = g.dim LEFT JOIN n ON n.doc_id = d.doc_id""",
    "l2_normalized": """WITH u AS (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS dim,
  unnest(embedding)::DOUBLE * vec_id AS x FROM embeddings),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM u GROUP BY 1)
SELECT vec_id, dim, round(CASE WHEN norm > 0 THEN x / norm ELSE 0 END, 6) + 0.0 AS x FROM u JOIN n USING (vec_id)""",
    "batch_merge": """WITH sizes AS (SELECT vec_id // 8 AS batch_id, count(*) AS n FROM embeddings GROUP BY 1),
got AS (SELECT vec_id // 8 AS batch_id, vec_id % 8 + CASE WHEN vec_id % 13 = 0 THEN 8 ELSE 0 END AS idx, 0 AS pos,
    embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 11 <> 0
  UNION ALL SELECT vec_id // 8, vec_id % 8, 1, list_transform(embedding::DOUBLE[], lambda x: -x) FROM embeddings WHERE vec_id % 17 = 3),
ok AS (SELECT batch_id, idx, arg_max(v, pos) AS v FROM got JOIN sizes USING (batch_id) WHERE idx < n GROUP BY 1, 2),
want AS (SELECT batch_id, unnest(generate_series(0, n - 1)) AS idx FROM sizes)
SELECT batch_id, idx, unnest(generate_series(0, len(v) - 1)) AS dim, round(unnest(v), 6) + 0.0 AS x, 'ok' AS status FROM ok
UNION ALL SELECT batch_id, idx, NULL, NULL, 'missing index' FROM want ANTI JOIN ok USING (batch_id, idx)
UNION ALL SELECT DISTINCT batch_id, idx, NULL, NULL, 'index out of range' FROM got JOIN sizes USING (batch_id) WHERE idx >= n""",
    "embedding_responses": f"""WITH {RESPONSES}
SELECT response_id, pos, unnest(generate_series(0, len(v) - 1)) AS dim, round(unnest(v), 6) + 0.0 AS x
FROM g WHERE response_id % 5 <> 4""",
    "embedding_response_gaps": f"""WITH {RESPONSES}
SELECT response_id, count(*) AS n_inputs, 0 AS n_vectors FROM g WHERE response_id % 5 = 4 GROUP BY 1""",
    "vector_expr_top10": """WITH parts AS (
  SELECT b.item_id AS query_id, unnest(generate_series(1, len(embedding))) AS dim, unnest(embedding)::DOUBLE * s AS x
  FROM benchmark b, (VALUES (0, 1), (1, 1), (2, -1)) o(o, s), embeddings e WHERE e.vec_id = b.item_id + o.o),
v AS (SELECT query_id, list(x ORDER BY dim) AS qv FROM (SELECT query_id, dim, sum(x) AS x FROM parts GROUP BY 1, 2)
  GROUP BY 1 HAVING max(abs(x)) > 0),
full3 AS (SELECT query_id FROM parts WHERE dim = 1 GROUP BY 1 HAVING count(*) = 3)
SELECT * FROM (SELECT query_id, vec_id::VARCHAR AS doc_id,
  row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id::VARCHAR) AS rank, (1 + cos) / 2 AS score
  FROM (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], qv), 9) AS cos
    FROM v JOIN full3 USING (query_id) CROSS JOIN embeddings)) WHERE rank <= 10""",
    "knn_top10": f"""WITH {QUERIES}
SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, doc_id) AS rank,
  (1 + cos) / 2 AS score, least(1.0, greatest(0.0, cos)) AS sim
  FROM (SELECT query_id, vec_id::VARCHAR AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], query_vector), 9) AS cos
    FROM queries CROSS JOIN embeddings WHERE query_vector IS NOT NULL)) WHERE rank <= 10""",
    "knn_ties": f"""WITH {QUERIES}
SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, doc_id) AS rank,
  (1 + cos) / 2 AS score FROM (SELECT query_id, e.vec_id AS doc_id,
    round(list_cosine_similarity(f.embedding::DOUBLE[], query_vector), 9) AS cos
    FROM queries CROSS JOIN embeddings e JOIN embeddings f ON f.vec_id = e.vec_id - e.vec_id % 4
    WHERE query_vector IS NOT NULL)) WHERE rank <= 10""",
    "knn_filtered": f"""WITH {CORPUS}, {QUERIES}
SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, doc_id) AS rank,
  (1 + cos) / 2 AS score FROM (SELECT query_id, doc_id, {COS} AS cos
    FROM queries CROSS JOIN corpus WHERE vector IS NOT NULL AND query_vector IS NOT NULL AND {CHUNK})) WHERE rank <= 5""",
    "postings_stats": f"""WITH {CORPUS}, {TF}
SELECT term, count(*) AS df, sum(tf) AS cf, max(tf) AS max_tf, sum(dl) AS dl_sum FROM tf JOIN dl USING (doc_id) GROUP BY term""",
    "bm25_top10": f"WITH {BASE} {BM_TOP}",
    "bm25_chat": f"WITH {CORPUS}, {CHAT}, {BM} {BM_TOP}",
    "bm25_synonyms": f"""WITH RECURSIVE {CORPUS}, {QUERIES}, {TF}, {RULES},
mem AS (
  SELECT a AS term, a AS member FROM rl WHERE item_id % 5 <> 0 UNION SELECT a, b FROM rl WHERE item_id % 5 <> 0 AND b IS NOT NULL
  UNION SELECT b, a FROM rl WHERE item_id % 5 <> 0 AND b IS NOT NULL UNION SELECT b, b FROM rl WHERE item_id % 5 <> 0 AND b IS NOT NULL
  UNION SELECT a, b FROM rl WHERE item_id % 5 = 0 AND b IS NOT NULL),
named AS (SELECT DISTINCT term FROM mem),
asked AS (SELECT query_id, {tok('query_text')} AS t FROM queries),
walk AS (
  SELECT query_id, t, 1 AS i, NULL::VARCHAR AS slot FROM asked
  UNION ALL
  SELECT query_id, t, CASE WHEN pair THEN i + 2 ELSE i + 1 END, CASE WHEN pair THEN t[i] || chr(31) || t[i + 1] ELSE t[i] END
  FROM (SELECT *, i < len(t) AND (t[i] || chr(31) || t[i + 1]) IN (SELECT term FROM named) AS pair FROM walk) WHERE i <= len(t)),
qt AS (SELECT query_id, slot, count(*) AS qtf FROM walk WHERE slot IS NOT NULL GROUP BY 1, 2),
ex AS (SELECT DISTINCT query_id, slot, qtf, coalesce(member, slot) AS term FROM qt LEFT JOIN mem ON mem.term = slot),
dt AS (SELECT doc_id, {tok('text')} AS t FROM corpus),
two AS (SELECT doc_id, t[i] || chr(31) || t[i + 1] AS term, count(*) AS tf
  FROM (SELECT doc_id, t, unnest(generate_series(1, len(t) - 1)) AS i FROM dt)
  WHERE t[i] || chr(31) || t[i + 1] IN (SELECT term FROM ex) GROUP BY 1, 2),
tfs AS (SELECT doc_id, term, tf FROM tf UNION ALL SELECT doc_id, term, tf FROM two),
dfs2 AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
sl AS (SELECT query_id, slot, max(df) AS df FROM ex JOIN dfs2 USING (term) GROUP BY 1, 2),
per AS (SELECT query_id, doc_id, slot, any_value(qtf) AS qtf, sum(tf) AS tf FROM ex JOIN tfs USING (term) GROUP BY 1, 2, 3),
bm AS (SELECT query_id, doc_id, round(sum(qtf * {PART}), 9) AS kw
  FROM per JOIN sl USING (query_id, slot) JOIN dl USING (doc_id), st GROUP BY 1, 2)
{BM_TOP}""",
    "hybrid_weighted_raw": f"""WITH {BASE}, {weighted('raw')}
SELECT query_id, doc_id, rank, score FROM fused WHERE rank <= 10""",
    "hybrid_weighted_saturation": f"""WITH {BASE}, {weighted()}
SELECT query_id, doc_id, rank, score FROM fused WHERE rank <= 10""",
    "hybrid_weighted_log1p": f"""WITH {BASE}, {weighted('log1p', 0.85, 0.15, 25.0)}
SELECT query_id, doc_id, rank, score FROM fused WHERE rank <= 10""",
    "hybrid_rrf": f"""WITH {BASE}, {rrf(10)}
SELECT query_id, doc_id, rank, score FROM fused WHERE rank <= 10""",
    "hybrid_rerank": f"""WITH {CORPUS}, {SHORT}, {BM}, {weighted()}
{reranked(f"length({trim('query_text')}) <= 4 AND NOT contains(query_text, ' ')")}""",
    "hybrid_rrf_rerank": f"""WITH {CORPUS}, {SHORT}, {BM}, {rrf(50).replace("fused AS (", "fused0 AS (", 1)},
fused AS (SELECT f.*, query_text, text FROM fused0 f JOIN queries USING (query_id) JOIN corpus USING (doc_id))
{reranked('true')}""",
    "rerank_flags": f"""WITH a AS (SELECT item_id AS query_id, text AS query_text FROM benchmark),
b AS (SELECT query_id, {tok('query_text')}[-1] AS query_text FROM a), {CHAT}
SELECT *, {trim('query_text')} <> '' AND length({trim('query_text')}) <= 4
  AND {trim('query_text')} NOT LIKE '% %' AND NOT contains({trim('query_text')}, chr(9)) AS rerank
FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM queries)""",
    "hits_formatted": f"""WITH {HITS}
SELECT query_id, doc_id, rank, score, text, text_truncated, chapter_id, chunk_index FROM hits""",
    "hit_counts": f"""WITH {BASE} SELECT query_id, count(doc_id) AS total, least(count(doc_id), 10) AS returned
FROM queries LEFT JOIN bm USING (query_id) GROUP BY query_id""",
    "hits_collapsed": f"""WITH {LOOSE}, g AS (
  SELECT *, coalesce(chapter_id, 'hit ' || rank) AS key FROM loose),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, rank) AS pos,
    count(*) OVER (PARTITION BY query_id, key) AS merged_from, min(rank) OVER (PARTITION BY query_id, key) AS first_rank FROM g)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chapter_id IS NULL, first_rank) AS rank,
  chapter_id, merged_from, score FROM b WHERE pos = 1""",
    "collapse_report": f"""WITH {LOOSE}
SELECT query_id, count(*) AS raw_count, count(DISTINCT coalesce(chapter_id, 'hit ' || rank)) AS deduped_count,
  count(*) - count(DISTINCT coalesce(chapter_id, 'hit ' || rank)) AS removed_count FROM loose GROUP BY query_id""",
    "chapters_assembled": f"""WITH {CORPUS}, p AS (
  SELECT chapter_id, doc_id, text, CASE WHEN chunk_index % 4 <> 3 THEN chunk_index END AS ci FROM corpus WHERE {CHUNK}),
a AS (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY ci NULLS LAST, doc_id) - 1 AS arrival FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY coalesce(ci, arrival), arrival) AS pos FROM a WHERE text <> '')
SELECT chapter_id, {number('chapter_id')} AS chapter_number, {title("first(text ORDER BY pos)")} AS title,
  {trim(f"string_agg(text, {NL} ORDER BY pos)")} AS full_text, count(*) AS chunk_count, 0 AS volume, 1 AS volumes
FROM o GROUP BY chapter_id""",
    "summaries_lookup": f"WITH {CORPUS}, {LOOKUP} SELECT * FROM lookup",
    "hits_enriched": f"""WITH {LOOSE}, {CHAPTERS}
SELECT query_id, rank, doc_id, chapter_number, title, chunk_count, length(full_text) AS chars, md5(full_text) AS text_md5
FROM loose LEFT JOIN chapters USING (chapter_id)""",
    "chapter_scores": f"""WITH {LOOSE}, {chapter_scores('loose', 5)}
SELECT query_id, chapter_id, score, hit_count, best_doc, slot FROM chosen""",
    "context_units_ordered": f"WITH {HITS}, {units('hits', 5)} {UNIT_OUT}",
    "context_orphans": f"""WITH {LOOSE}, few AS (
  SELECT * EXCLUDE (chapter_id), CASE WHEN rank <= 3 THEN chapter_id END AS chapter_id FROM loose),
{units('few', 6, False)} {UNIT_OUT}""",
    "context_sources": f"""WITH RECURSIVE {context(12000)}
SELECT query_id, ref, doc_id, rank, score, p.chapter_id, chunk_index, kind AS source_kind,
  CASE WHEN coalesce(full_text, '') <> '' THEN coalesce(nullif({trim('c.title')}, ''), p.title) ELSE p.title END AS chapter_title,
  hit_count, text, text_for_llm, text_truncated, length(text) AS text_total_chars,
  CASE WHEN kind = 'chunk' THEN {preview('text', 240)} ELSE {preview('text', 4000)} END AS text_preview,
  chunk_count AS chapter_chunks, md5(full_text) AS chapter_md5
FROM packed p LEFT JOIN chapters c ON c.chapter_id = p.chapter_id""",
    "contexts": f"{joined(4000, 5)} SELECT query_id, context, n_sources FROM ctx",
    "context_hits": f"""WITH RECURSIVE {HITS}, {hit_blocks(6000)}
SELECT query_id, rank AS ref, doc_id, rank, score, chapter_id, chunk_index,
  {preview('text', 240)} AS text_preview, block FROM hpacked""",
    "messages": f"""{joined(12000, 3)}
SELECT query_id, 0 AS pos, 'system' AS role, {lit(K.SYSTEM_PROMPT)} AS content FROM ctx
UNION ALL SELECT query_id, 1, 'user', {lit(K.USER_CONTEXT_HEAD)} || context || {lit(K.USER_QUESTION_HEAD)}
  || {trim('query_text')} || {lit(K.USER_TAIL)} FROM ctx""",
    "empty_answers": f"""WITH RECURSIVE {HITS}, {hit_blocks(12000)},
n AS (SELECT query_id, count(*) AS n FROM hpacked GROUP BY 1),
chat AS (SELECT DISTINCT conv_id AS query_id FROM conversations WHERE role = 'user')
SELECT query_id, n IS NOT NULL AS needs_generation, CASE WHEN n IS NULL THEN {lit(K.EMPTY_CONTEXT_ANSWER)} END AS answer,
  coalesce(n, 0) AS n_sources FROM chat LEFT JOIN n USING (query_id)""",
    "summary_worklist": f"""WITH {CORPUS}, {CHAPTERS}
SELECT chapter_id, title, '章节 ID：' || chapter_id || {NL} || '章节标题：'
  || CASE WHEN title <> '' THEN title ELSE '（未知）' END || {NL} || {NL} || '## 该回原文' || {NL} || {NL}
  || CASE WHEN length(full_text) > 12000 THEN left(full_text, 12000) || {lit(K.SUMMARY_INPUT_CUT)} ELSE full_text END
  || {NL} || {NL} || '请写 500 字以内的章回摘要。' AS prompt
FROM chapters ANTI JOIN summ USING (chapter_id)""",
    "summary_rows": f"WITH {SUMM} SELECT doc_id, text, chapter_id, doc_kind, chapter_title, chunk_index FROM summ",
    "entity_profiles": f"""WITH {DOCS}, {NAMES}, f AS (
  SELECT character, {trim('text')} AS text, chapter_id, chunk_index, doc_id
  FROM names CROSS JOIN docs WHERE contains(text, character)),
c AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY character ORDER BY chapter_id, chunk_index, doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT character, {trim(f"string_agg(left(text, (28000 - before)::INT), {NL} || {NL} ORDER BY before)")} AS profile_text
FROM c WHERE before < 28000 GROUP BY character""",
    "cooccurring_names": f"""WITH {CORPUS}, {QUERIES}, {NAMES}, near AS (
  SELECT query_id, query_text, text, row_number() OVER (PARTITION BY query_id ORDER BY {COS} DESC, doc_id) AS rank
  FROM queries CROSS JOIN corpus WHERE vector IS NOT NULL AND query_vector IS NOT NULL AND {CHUNK}),
w AS (SELECT query_id, lower({trim('query_text')}) AS q, unnest({tok('text')}) AS token FROM near WHERE rank <= 12),
c AS (SELECT query_id, character, count(*) AS n FROM w JOIN names ON lower(character) = token
  WHERE length(token) >= 2 AND token <> q AND token <> left(q, 2) GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, character) AS rank FROM c) WHERE rank <= 25""",
    "word2vec": f"""SELECT word, {K.W2V_SIZE} AS dims FROM (SELECT unnest({tok('text')}) AS word FROM documents)
WHERE length(word) >= 2 GROUP BY word HAVING count(*) >= {K.W2V_MIN_COUNT}""",
    "word_analogy": f"""WITH toks AS (SELECT item_id AS expr_id, {tok('text')} AS t FROM benchmark),
words AS (SELECT word, embedding::DOUBLE[] AS v FROM (SELECT DISTINCT unnest(t) AS word FROM toks)
  JOIN embeddings ON vec_id = {_HEX.format(1, 8).replace('md5(t)', 'md5(word)')} % (SELECT count(*) FROM embeddings)),
terms AS (SELECT expr_id, t[p] AS word, CASE p WHEN 3 THEN -1 ELSE 1 END AS sign FROM toks, (VALUES (1), (2), (3)) x(p) WHERE t[p] IS NOT NULL),
parts AS (SELECT expr_id, unnest(generate_series(1, len(v))) AS dim,
    unnest(v) / sqrt(list_sum(list_transform(v, lambda y: y * y))) * sign AS x FROM terms JOIN words USING (word)),
sums AS (SELECT expr_id, list(x ORDER BY dim) AS q FROM (SELECT expr_id, dim, sum(x) AS x FROM parts GROUP BY 1, 2)
  GROUP BY 1 HAVING max(abs(x)) > 1e-9),
c AS (SELECT expr_id, word, round(list_cosine_similarity(v, q), 9) AS score FROM sums CROSS JOIN words
  WHERE NOT EXISTS (SELECT 1 FROM terms WHERE terms.expr_id = sums.expr_id AND terms.word = words.word))
SELECT * FROM (SELECT expr_id, word, row_number() OVER (PARTITION BY expr_id ORDER BY score DESC, word) AS rank, score FROM c)
WHERE rank <= {K.ANALOGY_TOP}""",
}
ORACLE["knn_cells"] = ORACLE["knn_top10"].replace("SELECT * FROM (SELECT query_id", "SELECT query_id, doc_id, rank, score FROM (SELECT query_id", 1)
ORACLE["bm25_joined"] = ORACLE["bm25_token_column"] = ORACLE["bm25_indexed"] = ORACLE["bm25_top10"]
ORACLE["hybrid_indexed"] = ORACLE["hybrid_weighted_saturation"]
ORACLE["hybrid_rrf_indexed"] = ORACLE["hybrid_rrf"]
ORACLE["entity_neighbors"] = f"""WITH {DOCS}, {NAMES}, f AS (
  SELECT character, {trim('text')} AS text, chapter_id, chunk_index, doc_id
  FROM names CROSS JOIN docs WHERE contains(text, character)),
c AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY character ORDER BY chapter_id, chunk_index, doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f),
p AS (SELECT character AS k, string_agg(left(text, (2000 - before)::INT), {NL} || {NL} ORDER BY before) AS text
  FROM c WHERE before < 2000 GROUP BY character
  UNION ALL SELECT 'q' || item_id || ' ', text FROM benchmark),
w AS (SELECT k, unnest({tok('text')}) AS t FROM p),
s AS (SELECT k, {_HEX.format(1, 8)} % 64 AS dim, sum(CASE WHEN {_HEX.format(9, 1)} % 2 = 0 THEN 1 ELSE -1 END) AS x FROM w GROUP BY 1, 2),
n AS (SELECT k, sqrt(sum(x * x)) AS norm FROM s GROUP BY 1 HAVING norm > 0),
cosines AS (SELECT b.item_id AS query_id, m.character, round(coalesce(sum(qs.x * es.x), 0) / (any_value(qn.norm) * any_value(en.norm)), 9) AS cos
  FROM benchmark b JOIN n qn ON qn.k = 'q' || b.item_id || ' ' CROSS JOIN (SELECT DISTINCT character FROM c) m JOIN n en ON en.k = m.character
  JOIN s qs ON qs.k = qn.k LEFT JOIN s es ON es.k = en.k AND es.dim = qs.dim GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, character, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, character) AS rank,
  (1 + cos) / 2 AS score FROM cosines) WHERE rank <= 5"""
# On the given tables a budget of a hundred candidates finds all of the nearest.
ORACLE["knn_approx"] = ORACLE["knn_cells"]
ORACLE["knn_approx_filtered"] = ORACLE["knn_filtered"]
ORACLE["hybrid_rrf_approx"] = ORACLE["hybrid_rrf"]
ORACLE["bm25_indexed_synonyms"] = ORACLE["bm25_synonyms"]
ORACLE["bm25_upserted"] = f"WITH corpus AS ({UPSERT}), {QUERIES}, {BM} {BM_TOP}"
ORACLE["discovered_terms"] = f"""WITH t AS (SELECT {tok("coalesce(text, '')")} AS w FROM documents),
g AS (
  SELECT n, array_to_string(w[i : i + n - 1], ' ') AS run, CASE WHEN i > 1 THEN w[i - 1] ELSE '' END AS l,
    CASE WHEN i + n <= len(w) THEN w[i + n] ELSE '' END AS r
  FROM (SELECT w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM t, (VALUES (1), (2), (3)) ns(n) WHERE len(w) >= n)),
c AS (SELECT n, run, count(*) AS c, ln(count(*) / sum(count(*)) OVER (PARTITION BY n)) AS p FROM g GROUP BY n, run),
f AS (SELECT n, run, c, p, string_split(run, ' ') AS w FROM c WHERE n > 1 AND c >= 10),
cuts AS (SELECT *, unnest(generate_series(1, n - 1)) AS k FROM f),
coh AS (
  SELECT cuts.n, cuts.run, cuts.c, round(min(cuts.p - a.p - b.p), 6) AS cohesion FROM cuts
  JOIN c a ON a.run = array_to_string(w[1 : k], ' ') JOIN c b ON b.run = array_to_string(w[k + 1 : cuts.n], ' ')
  GROUP BY 1, 2, 3 HAVING cohesion >= 1.0),
le AS (SELECT run, round(greatest(0.0, ln(sum(c)) - sum(c * ln(c)) / sum(c)), 6) AS e
  FROM (SELECT run, l, count(*) AS c FROM g WHERE n > 1 GROUP BY run, l) GROUP BY run),
re AS (SELECT run, round(greatest(0.0, ln(sum(c)) - sum(c * ln(c)) / sum(c)), 6) AS e
  FROM (SELECT run, r, count(*) AS c FROM g WHERE n > 1 GROUP BY run, r) GROUP BY run)
SELECT run AS term, n AS n_tokens, c AS count, cohesion, le.e AS left_entropy, re.e AS right_entropy
FROM coh JOIN le USING (run) JOIN re USING (run) WHERE le.e >= 1.0 AND re.e >= 1.0"""
ORACLE["ingest_indexed"] = ORACLE["bm25_upserted"]
ORACLE["word_model"] = f"""SELECT word, count(*) AS n, {K.W2V_SIZE} AS dims, true AS is_trained
FROM (SELECT unnest({tok('text')}) AS word FROM documents)
WHERE length(word) >= 2 GROUP BY word HAVING count(*) >= {K.W2V_MIN_COUNT}"""
