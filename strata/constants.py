"""Fixed values shared by the operators (formats, patterns, defaults, prompts)."""

# --- document kinds (fixed values) ---
KIND_CHUNK = "chunk"
KIND_SUMMARY = "chapter_summary"
KIND_CHAPTER = "chapter"
SUMMARY_CHUNK_INDEX = -1

# --- characters treated as white space when stripping (fixed values) ---
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regular-expression class body (without brackets).
WHITESPACE_CLASS = (
    r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
)
# White space that can stand inside one line.
INLINE_SPACE_CLASS = r"\t\x1F \xA0\u1680\u2000-\u200A\u202F\u205F\u3000"
# Line boundaries (CR LF counts as one).
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"

# --- raw book patterns (fixed values) ---
SENTENCE_ENDS = "。！？…"
NOISE_SECTION_TITLE = "分节阅读"
HEADING_MARK = "正文"
SECTION_MARK = "分节阅读"
SECTION_END = "------------"
SECTION_ID_FORMAT = "sanguo_section_%03d"
CHAPTER_ID_PREFIX = "chapter_"
TITLE_PATTERN = r"(第[零一二三四五六七八九十百千万\p{Nd}]+回[^\n。！？]{0,80})"
TITLE_FALLBACK_CHARS = 120

# --- chunking defaults (fixed values) ---
MIN_CHARS = 300
MAX_CHARS = 800

# --- vectors (fixed values) ---
PASSAGE_PREFIX = "passage: "
QUERY_PREFIX = "query: "

# --- BM25 (published defaults) ---
BM25_K1 = 1.2
BM25_B = 0.75

# --- hybrid search defaults (fixed values): command line and service ---
CLI_DEFAULTS = {"vector_weight": 0.7, "keyword_weight": 0.3, "kw_sat": 15.0}
SERVICE_DEFAULTS = {"vector_weight": 0.85, "keyword_weight": 0.15, "kw_sat": 25.0}
KW_LOG_CAP = 10.0
SEARCH_K = 10
RRF_CONSTANT = 60
RRF_WINDOW = 50
RERANK_POOL = 50
RERANK_BLEND = 0.35
AUTO_RERANK_CHARS = 4
HIT_TEXT_CHARS = 4000

# --- context defaults (fixed values) ---
CONTEXT_TOP_K = 3
CONTEXT_FETCH_K = 20
MULTI_HIT_THRESHOLD = 2
CHAPTER_ALPHA = 0.3
CONTEXT_MAX_CHARS = 12000
PREVIEW_LONG = 4000
PREVIEW_SHORT = 240
ROOM_LONG = 120
ROOM_SHORT = 80
MIN_BODY = 60
ELLIPSIS = "…"
CUT_CHAPTER = "\n…（整章正文已因上下文长度上限截断，可调大 max_chars）\n"
CUT_SUMMARY = "\n…（章回摘要已因上下文长度上限截断）\n"
CUT_CHUNK = "\n…（片段已截断）\n"
SYSTEM_PROMPT = """你是基于《三国演义》语料库的问答助手。请仅根据用户提供的「参考资料」回答问题。
若资料不足以回答，请明确说明「资料中未找到相关信息」，不要编造情节或人物关系。
回答请使用中文，条理清晰；在引用原文依据时，可在句末用 [编号] 标注来源（编号对应参考资料中的 [1]、[2] 等）。"""
USER_CONTEXT_HEAD = "## 参考资料\n\n"
USER_QUESTION_HEAD = "\n\n## 用户问题\n\n"
USER_TAIL = "\n\n请根据参考资料回答用户问题。"
EMPTY_CONTEXT_ANSWER = "资料中未找到相关信息，无法根据语料回答该问题。"

# --- chapter summaries (fixed values) ---
SUMMARY_INPUT_CHARS = 12000
SUMMARY_INPUT_CUT = "\n…（原文已截断供摘要）"
SUMMARY_TARGET_CHARS = 500
SUMMARY_SYSTEM_PROMPT = """你是《三国演义》章回摘要助手。请仅根据用户给出的该回原文写摘要。
要求：中文；300～500 字；概括主要人物、事件与结局；不要编造原文没有的情节；不要输出标题以外的多余格式。"""
SUMMARY_UNKNOWN_TITLE = "（未知）"

# --- entities and words (fixed values) ---
PROFILE_CHARS = 28000
PROFILE_JOIN = "\n\n"
NAME_HITS = 12
NAME_TOP = 25
W2V_SIZE = 128
W2V_WINDOW = 5
W2V_MIN_COUNT = 2
W2V_EPOCHS = 8
W2V_SEED = 42
ANALOGY_TOP = 15

# Cosines, BM25 sums and logarithms are kept to this many decimals, so that equal
# documents tie whatever the order in which a distributed sum was taken. What is
# computed from them (weighted sums, blends) is not rounded again.
SCORE_DECIMALS = 9
