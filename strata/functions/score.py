"""Column functions on scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata import constants as K
from strata.functions.text import count_of, strip
from strata.functions.vector import keep

KEYWORD_MODES = ("raw", "saturation", "log1p")


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25(weight: Column, tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def normalize_keyword(
    kw: Column,
    mode: str = "saturation",
    kw_sat: float = K.CLI_DEFAULTS["kw_sat"],
    kw_log_cap: float = K.KW_LOG_CAP,
) -> Column:
    """Bring a BM25 score near the scale of a cosine; negative scores count as 0."""
    if kw_sat <= 0 or kw_log_cap <= 0:
        raise ValueError("kw_sat and kw_log_cap must be positive")
    kw = F.greatest(kw, F.lit(0.0))
    if mode == "raw":
        return kw
    if mode == "saturation":
        return kw / (kw + kw_sat)
    if mode == "log1p":
        return F.least(F.lit(1.0), keep(F.log1p(kw)) / kw_log_cap)
    raise ValueError(f"keyword mode must be one of {KEYWORD_MODES}")


def term_density(query: Column, text: Column) -> Column:
    """ln(1 + tf) + min(4, tf per 200 characters); 0 when the query is absent."""
    needle = strip(query)
    tf = F.when(
        (needle != "") & (F.length(text) > 0), count_of(needle, text)
    ).otherwise(0)
    dense = tf / (F.greatest(F.length(text), F.lit(1)) / 200.0)
    return F.when(tf > 0, keep(F.log1p(tf)) + F.least(dense, F.lit(4.0))).otherwise(0.0)


def auto_rerank(query: Column, max_chars: int = K.AUTO_RERANK_CHARS) -> Column:
    """Short queries without space or tab are taken for names."""
    q = strip(query)
    return (q != "") & ~q.contains(" ") & ~q.contains("\t") & (F.length(q) <= max_chars)


def chapter_score(max_score: Column, hits: Column, alpha: float) -> Column:
    return max_score * (1 + alpha * keep(F.log1p(hits)))
