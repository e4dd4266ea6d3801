"""From formatted hits to prompt tables (3.3): units, packed context, messages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from strata import constants as K
from strata.operators import context as C
from strata.operators.chapters import VOLUME_CHARS, assemble_chapters, lookup_summaries, whole_chapters
from strata.operators.hits import enrich_hits, wanted_chapters
from strata.storage import settle


@dataclass(frozen=True)
class Answers:
    sources: DataFrame  # one row per query and source
    contexts: DataFrame  # one row per query: context, messages, answer


def context_units(
    corpus: DataFrame,
    hits: DataFrame,
    top_k: int = K.CONTEXT_TOP_K,
    multi_hit_threshold: int = K.MULTI_HIT_THRESHOLD,
    alpha: float = K.CHAPTER_ALPHA,
    use_summaries: bool = True,
    volume_chars: int = VOLUME_CHARS,
) -> tuple[DataFrame, DataFrame]:
    """(units with ``ref``, chapters of the chosen ids): E1 to E4.

    What several steps read is settled: the hit list, and the chapters' texts, which
    are assembled once.
    """
    hits = settle(hits)
    chosen = C.score_chapters(hits, top_k, alpha)
    wanted = chosen.select("chapter_id").distinct()
    chapters = settle(whole_chapters(assemble_chapters(corpus, wanted, volume_chars)))
    summaries = lookup_summaries(corpus, wanted) if use_summaries else None
    units = C.select_context_units(chosen, summaries, chapters, multi_hit_threshold)
    return C.order_units(C.fill_orphans(hits, units, top_k)), chapters


def hits_with_chapters(
    corpus: DataFrame, hits: DataFrame, volume_chars: int = VOLUME_CHARS
) -> tuple[DataFrame, DataFrame]:
    """(hits with their chapter as a struct, the distinct chapters)."""
    hits = settle(hits)
    wanted = wanted_chapters(hits)
    chapters = settle(whole_chapters(assemble_chapters(corpus, wanted, volume_chars)))
    return enrich_hits(hits, chapters), chapters


def build_answers(
    corpus: DataFrame,
    queries: DataFrame,
    hits: DataFrame,
    max_chars: int = K.CONTEXT_MAX_CHARS,
    system_prompt: str = K.SYSTEM_PROMPT,
    **selection,
) -> Answers:
    """E1 to E9 for every query of ``queries``."""
    units, chapters = context_units(corpus, hits, **selection)
    packed = C.pack_context(units, max_chars)
    contexts = C.join_blocks(queries, packed)
    contexts = C.empty_context_answer(C.build_messages(contexts, system_prompt))
    return Answers(C.enrich_sources(packed.drop("block"), chapters), contexts)
