"""Language identification by hyperdimensional profiles (operator 7).

Every letter has a random vector of +1 and -1. A trigram (a letter with its neighbours, where the
outside of a word is a blank) is bound from the vectors of its parts, each rotated by its place;
a text bundles, that is adds, its trigrams, and a language bundles its training texts. A text is
compared with the languages by cosine. Letter vectors are drawn from a seed and the code point, so
tasks need no common table and every script is covered.

Bundling is linear: training adds up trigram counts in each task and binds them once; only one
vector per language and task is aggregated. Texts are multiplied in batches of bounded size; a
longer text goes in pieces cut at white space, whose vectors add up to that of the whole. Trigrams
are bound `SLICE` at a time, so memory does not grow with the number of distinct ones.

Cases: null texts and texts without a letter are ``und`` with score 0; without any training text all
are; languages that tie are taken in code point order; a null language is not learnt from; repeated
rows are rows of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.tables import bound_batches, column, crc_mod, map_arrow

DIMS = 1024
SEED = 7
PIECE_CHARS = 1 << 19
BATCH_CHARS = 1 << 20
BATCH_TEXTS = 512
SLICE = 1 << 14
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2


class Letters(dict):
    """The vector of a letter by its code point; 0 is the blank."""

    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, code: int) -> np.ndarray:
        bits = np.random.Generator(np.random.Philox(key=[SEED, code])).integers(0, 2, self.dims, dtype=np.int8)
        vector = self[code] = bits * np.int8(2) - np.int8(1)
        return vector


def pieces(text: str) -> list[str]:
    """Pieces of bounded length, cut at white space where there is any."""
    out, start = [], 0
    while len(text) - start > PIECE_CHARS:
        end = start + PIECE_CHARS
        space = max(text.rfind(c, start, end) for c in " \n\t")
        end = space + 1 if space > start else end
        out.append(text[start:end])
        start = end
    return out + [text[start:]]


def trigrams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams (rows of three code points), and the text and the trigram's number of every place."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\0".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros((0, 3), np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    present = np.flatnonzero(np.bincount(codes))
    letters = np.array([c for c in present.tolist() if chr(c).isalpha()], np.int64)
    number = np.zeros(int(present[-1]) + 1, np.int64)
    number[letters] = np.arange(1, len(letters) + 1)
    symbols = np.zeros(len(codes) + 2, np.int64)
    symbols[1:-1] = number[codes]
    at = np.flatnonzero(symbols)
    base = len(letters) + 1
    trigrams = (symbols[at - 1] * base + symbols[at]) * base + symbols[at + 1]
    owner = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])[at - 1] if len(at) else at
    if base**3 <= 1 << 24:
        distinct = np.flatnonzero(np.bincount(trigrams, minlength=1))
        where = np.zeros(base**3, np.int64)
        where[distinct] = np.arange(len(distinct))
        place = where[trigrams]
        distinct = distinct if len(at) else distinct[:0]
    else:
        distinct, place = np.unique(trigrams, return_inverse=True)
    parts = np.concatenate([[0], letters])
    triples = np.stack([parts[distinct // (base * base)], parts[distinct // base % base], parts[distinct % base]], axis=1)
    return triples, owner, place


def bound(triples: np.ndarray, letters: Letters) -> np.ndarray:
    """A row per trigram: the letters' vectors rotated by their place and multiplied."""
    out = np.ones((len(triples), letters.dims), np.int8)
    for place in range(3):
        codes, which = np.unique(triples[:, place], return_inverse=True)
        vectors = np.stack([letters[int(c)] for c in codes]) if len(codes) else out
        out *= np.roll(vectors, 2 - place, axis=1)[which]
    return out


def bundles(texts: list[str], rows: np.ndarray, n_rows: int, letters: Letters, kind: type) -> np.ndarray:
    """The sum of the trigrams' vectors over the texts of each row."""
    triples, owner, place = trigrams_of(texts)
    owner = rows[owner]
    out = np.zeros((n_rows, letters.dims), kind)
    if len(triples) > SLICE:
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
    for start in range(0, len(triples), SLICE):
        size = min(SLICE, len(triples) - start)
        low, high = (0, len(place)) if size == len(triples) else np.searchsorted(place, [start, start + size])
        counts = np.bincount(owner[low:high] * size + place[low:high] - start, minlength=n_rows * size)
        out += counts.reshape(n_rows, size).astype(kind) @ bound(triples[start : start + size], letters).astype(kind)
    return out


def _batches(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Lines and pieces of texts, by bounded batches."""
    lines, parts, size = [], [], 0
    for line, text in enumerate(texts):
        for piece in pieces(text or ""):
            if parts and (size + len(piece) > BATCH_CHARS or len(parts) >= BATCH_TEXTS):
                yield lines, parts
                lines, parts, size = [], [], 0
            lines.append(line)
            parts.append(piece)
            size += len(piece)
    if parts:
        yield lines, parts


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = DIMS) -> dict[str, np.ndarray]:
    """Language to the bundle of all its texts. What comes to the driver has `dims` numbers per
    language, however many texts there are."""
    bound_batches(docs.sparkSession)
    source = docs.select(column(docs, lang_col).cast("string").alias("lang"), column(docs, text_col).cast("string").alias("text"))
    source = source.filter("lang is not null and text is not null")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(dims), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lines, parts in _batches(batch.column("text").to_pylist()):
                names = sorted({langs[i] for i in lines})
                rows = np.array([names.index(langs[i]) for i in lines])
                for name, vector in zip(names, bundles(parts, rows, len(names), letters, np.float64)):
                    sums[name] = sums.get(name, 0) + vector
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})

    parts = source.mapInArrow(bundle, "lang string, vector array<double>")
    sums = parts.select("lang", F.posexplode("vector")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    found: dict[str, np.ndarray] = {}
    for row in sums.collect():
        found.setdefault(row["lang"], np.zeros(dims))[row["pos"]] = row["x"]
    return dict(sorted(found.items()))


def identify(
    docs: DataFrame, languages: dict[str, np.ndarray], text_col: str = "text", dims: int = DIMS
) -> DataFrame:
    """The documents with ``lang_pred`` and ``score`` (the cosine, 0 where it is negative) added.

    Added columns replace columns of the same name.
    """
    bound_batches(docs.sparkSession)
    names = list(languages)
    table = np.stack([v / max(np.linalg.norm(v), 1e-300) for v in languages.values()]) if names else np.zeros((0, dims))
    kept = docs.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(dims)
        for batch in batches:
            vectors: dict[int, np.ndarray] = {}
            best = [UNKNOWN] * batch.num_rows
            scores = np.zeros(batch.num_rows)

            def settle(lines) -> None:
                for line in lines:
                    vector = vectors.pop(line)
                    norm = np.linalg.norm(vector)
                    if norm and names:
                        cosines = np.round(table @ vector / norm, 9)
                        first = int(np.argmax(cosines))
                        best[line], scores[line] = names[first], min(max(float(cosines[first]), 0.0), 1.0)

            for lines, parts in _batches(batch.column(batch.schema.get_field_index(text_col)).to_pylist()):
                made = bundles(parts, np.arange(len(parts)), len(parts), letters, np.float32)
                settle([line for line in vectors if line < lines[0]])
                for line, vector in zip(lines, made):
                    vectors[line] = vectors[line] + vector if line in vectors else vector.astype(np.float64)
            settle(list(vectors))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best, pa.string()), pa.array(scores)], [f.name for f in schema.fields]
            )

    return map_arrow(kept, predict, schema)


def learnt_and_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` per row; learnt from the rows not held out."""
    fold = crc_mod(column(docs, id_col), FOLDS)
    languages = profiles(docs.filter(fold != HELD_OUT), text_col, lang_col)
    source = docs.select(
        column(docs, id_col).alias("doc_id"),
        (fold == HELD_OUT).alias("held_out"),
        column(docs, text_col).cast("string").alias("text"),
    )
    return identify(source, languages).drop("text")
