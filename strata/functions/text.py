"""Column functions on text: all native expressions, no shuffle, no Python rows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata import constants as K

# One token per Han or Hiragana character, otherwise runs of letters and digits.
_SINGLE = r"\p{IsHan}\p{IsHiragana}"
_STANDARD_TOKEN = rf"[{_SINGLE}]|[[\p{{L}}\p{{N}}]&&[^{_SINGLE}]]+"


def strip(col: Column) -> Column:
    """Strip Unicode white space at both ends."""
    return F.btrim(col, F.lit(K.WHITESPACE))


def present(col: Column) -> Column:
    """True when the text is neither null nor blank."""
    return F.coalesce(strip(col) != "", F.lit(False))


def null_if_blank(col: Column) -> Column:
    stripped = strip(col)
    return F.when(stripped != "", stripped)


def lines(col: Column) -> Column:
    return F.split(col, K.LINE_BREAK)


def tokens(col: Column, analyzer: str = "standard") -> Column:
    """``standard``: lower-cased words, one token per ideograph.
    ``whitespace``: the text cut at white space, case kept (for text that a
    dictionary segmenter has already joined with spaces)."""
    if analyzer == "standard":
        return F.regexp_extract_all(F.lower(col), F.lit(_STANDARD_TOKEN), F.lit(0))
    if analyzer == "whitespace":
        return F.regexp_extract_all(col, F.lit(f"[^{K.WHITESPACE_CLASS}]+"), F.lit(0))
    raise ValueError(f"unknown analyzer {analyzer!r}")


def sentences(col: Column, ends: str = K.SENTENCE_ENDS) -> Column:
    """Cut after each end character; pieces stripped, blanks dropped, tail kept."""
    cls = "".join(re.escape(c) for c in ends)
    pieces = F.regexp_extract_all(strip(col), F.lit(f"[^{cls}]*[{cls}]|[^{cls}]+"), F.lit(0))
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def hard_split(segments: Column, max_chars: int) -> Column:
    """Cut every segment longer than ``max_chars`` into pieces of that length."""
    cut = F.transform(
        segments,
        lambda s: F.when(F.length(s) <= max_chars, F.array(s)).otherwise(
            F.regexp_extract_all(s, F.lit(f"(?s).{{1,{max_chars}}}"), F.lit(0))
        ),
    )
    return F.flatten(cut)


# Segments are folded in blocks, so that growing the result array stays cheap
# for whole books (a plain fold copies the result once per segment).
_FOLD_BLOCK = 256
_FOLD_STATE = "struct<starts:array<int>,held:int>"


def _chunk_starts(lengths: Column, min_chars: int, max_chars: int) -> Column:
    """Positions (from 0) of the segments that open a chunk."""

    def step(state: Column, i: Column) -> Column:
        size = F.get(lengths, i)
        opens = (state["held"] == 0) | (state["held"] + size > max_chars)
        held = F.when(opens, size).otherwise(state["held"] + size)
        return F.struct(
            F.when(opens, F.array_append(state["starts"], i))
            .otherwise(state["starts"])
            .alias("starts"),
            F.when(held >= min_chars, F.lit(0)).otherwise(held).alias("held"),
        )

    def empty(held: Column) -> Column:
        return F.struct(
            F.array().cast("array<int>").alias("starts"), held.alias("held")
        ).cast(_FOLD_STATE)

    def block(state: Column, first: Column) -> Column:
        last = F.least(first + (_FOLD_BLOCK - 1), F.size(lengths) - 1)
        part = F.aggregate(
            F.sequence(first, last), empty(state["held"]), lambda s, i: step(s, i).cast(_FOLD_STATE)
        )
        return F.transform(
            F.array(part),
            lambda p: F.struct(
                F.concat(state["starts"], p["starts"]).alias("starts"), p["held"].alias("held")
            ).cast(_FOLD_STATE),
        )[0]

    blocks = F.when(
        F.size(lengths) > 0, F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(_FOLD_BLOCK))
    ).otherwise(F.array().cast("array<int>"))
    return F.aggregate(blocks, empty(F.lit(0)), block)["starts"]


def pack_chunks(segments: Column, min_chars: int, max_chars: int) -> Column:
    """Greedy packing of segments into chunks of ``min_chars`` to ``max_chars``.

    A chunk closes when the next segment would exceed ``max_chars`` or once it
    holds ``min_chars``. A last chunk shorter than half of ``min_chars`` joins
    the one before it.
    """
    if min_chars <= 0 or max_chars < min_chars:
        raise ValueError("need 0 < min_chars <= max_chars")

    def build(parts: Column) -> Column:
        starts = F.transform(
            F.array(F.transform(parts, lambda p: F.length(p))),
            lambda lengths: _chunk_starts(lengths, min_chars, max_chars),
        )
        return F.transform(
            starts,
            lambda at: F.filter(
                F.transform(
                    at,
                    lambda first, i: strip(
                        F.array_join(
                            F.slice(
                                parts,
                                first + 1,
                                F.coalesce(F.get(at, i + 1), F.size(parts)) - first,
                            ),
                            "",
                        )
                    ),
                ),
                lambda chunk: chunk != "",
            ),
        )[0]

    def merge_tail(chunks: Column) -> Column:
        n = F.size(chunks)
        short = (n >= 2) & (F.length(F.element_at(chunks, F.lit(-1))) < max(1, min_chars // 2))
        joined = strip(
            F.concat(F.get(chunks, n - 2), F.get(chunks, n - 1))
        )
        return F.when(
            short, F.array_append(F.slice(chunks, F.lit(1), F.greatest(n - 2, F.lit(0))), joined)
        ).otherwise(chunks)

    # array-of-one + transform binds an intermediate value to a name.
    return F.transform(
        F.transform(F.array(hard_split(segments, max_chars)), build),
        lambda chunks: F.when(F.size(chunks) >= 2, merge_tail(chunks)).otherwise(chunks),
    )[0]


def overlap(chunks: Column, overlap_chars: int) -> Column:
    """Prefix each chunk with the last characters of the chunk before it."""
    if overlap_chars <= 0:
        return chunks
    return F.transform(
        F.array(chunks),
        lambda cs: F.transform(
            cs,
            lambda c, i: F.when(i == 0, c).otherwise(
                strip(F.concat(F.right(F.get(cs, i - 1), F.lit(overlap_chars)), c))
            ),
        ),
    )[0]


def chapter_title(col: Column, pattern: str = K.TITLE_PATTERN) -> Column:
    """First match of the title pattern, else the first line cut to 120 characters."""
    text = strip(F.coalesce(col, F.lit("")))
    found = F.regexp_extract(text, pattern, 1)
    first = strip(F.substring_index(text, "\n", 1))
    return F.when(found != "", strip(found)).otherwise(F.left(first, F.lit(K.TITLE_FALLBACK_CHARS)))


def chapter_number(col: Column) -> Column:
    """``chapter_0012`` -> 12, anything else -> null."""
    digits = F.regexp_extract(strip(F.coalesce(col, F.lit(""))), r"(?i)^chapter_([0-9]+)$", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def chapter_id(number: Column, prefix: str = K.CHAPTER_ID_PREFIX) -> Column:
    return F.format_string(prefix + "%04d", number)


def preview(col: Column, chars: int) -> Column:
    return F.concat(
        F.left(col, F.lit(chars)), F.when(F.length(col) > chars, K.ELLIPSIS).otherwise("")
    )


def count_of(needle: Column, text: Column) -> Column:
    """Non-overlapping occurrences of a non-empty needle."""
    gone = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return (gone / F.length(needle)).cast("long")
