"""Spelling variant grouping by asymmetric q-chunks (operator 12).

Words are counted first: a task cuts its texts into runs of letters and sums what a word gets before anything
is shuffled, so a frequent word is one row a map task.

Near words (one inserted, deleted or replaced code point) are met by asymmetric q-chunks. The shorter word, of
length n, contributes two disjoint chunks of n // 2 code points, at its start and at its end; one edit leaves at
least one of them whole. The other word, of length n or n + 1, contributes its positional grams of that size.
A chunk before the edit stays at its place, one behind it moves by the difference of the lengths, at most one:
of all positional grams those at these places can meet a chunk, the others are not emitted. Chunks and grams
are joined on (n, place, gram), and a pair that meets is verified by its edit distance.

Frequent chunks ("un.." in a vocabulary of a billion words) would make pairs without end. So the chunk and gram
rows of each key are counted first; a key that promises more than `MOST_PAIRS` pairs is not joined, but refined:
the part of the word that is not yet covered contributes two chunks again, against grams of the same part,
and the key grows by them. The edit lies in that part, so it again leaves one of the two whole. A part of one code
point is not refined: words that agree in all the others are near. So every near pair is met, at every size, and
a row meets at most about sqrt(MOST_PAIRS) others more than it has near ones.

Forms point to a word that is at least twice as frequent, so chains have no cycles and at most log2(n) links;
roots are found by pointer doubling.

Cases: null and empty texts have no words; a null id counts as the empty text in the checksum; repeated rows count
each; of equally frequent near words the first in code-point order is the form; a table without such words gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.tables import bound_batches, column, growing, map_arrow, remove, text_of, written

LEAST_LENGTH = 5
LEAST_COUNT = 3
#: Of the runs of a document, those whose checksum this divides lose one code point.
DROPPED = 97
#: Candidates of a key (chunk rows times gram rows) from which it is refined.
MOST_PAIRS = 4096
#: Different words that a task sums up before it gives them out.
HELD_WORDS = 500_000

#: Each letter of `[A-Za-z\\u00C0-\\u00FF]` in Latin-1 to itself, A-Z lowered, all else to a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def text_words(doc_id: str, text: str) -> dict[bytes, int]:
    """Words of a text in Latin-1 with their occurrences. A character outside Latin-1 ends a run."""
    found: dict[bytes, int] = {}
    start = zlib.crc32(doc_id.encode() + b":")
    for run, n in Counter(text.encode("latin-1", "replace").translate(LETTERS).split(b" ")).items():
        if len(run) < LEAST_LENGTH:
            continue
        mark = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if mark % DROPPED == 0:
            at = mark % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        found[run] = found.get(run, 0) + n
    return found


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, int] = {}

    def out() -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in held], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for word, n in text_words(doc_id, text.as_py()).items():
                held[word] = held.get(word, 0) + n
            if len(held) >= HELD_WORDS:
                yield out()
                held.clear()
    if held:
        yield out()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``word``, ``n``): words of at least `LEAST_LENGTH` code points and `LEAST_COUNT` occurrences."""
    bound_batches(docs.sparkSession, 1 << 24)
    texts = docs.select(F.coalesce(column(docs, id_col).cast("string"), F.lit("")).alias("id"), text_of(docs, text_col).alias("text"))
    counted = map_arrow(texts, _count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


# --- near words -----------------------------------------------------------------


def _split(rows: DataFrame, shift: Column) -> DataFrame:
    """Rows of both chunks, or of the grams at their places, of the part (``lo``, ``hi``) of the shorter word that
    is not yet covered. A gram of the longer word behind the edit lies ``shift`` further."""
    q = ((F.col("hi") - F.col("lo")) / 2).cast("int")
    places = F.array(
        F.struct(F.lit(0).alias("side"), F.col("lo").alias("at"), (F.col("lo") + q).alias("lo"), F.col("hi").alias("hi")),
        F.struct(F.lit(1).alias("side"), (F.col("hi") - q + shift).alias("at"), F.col("lo").alias("lo"), (F.col("hi") - q).alias("hi")),
    )
    met = rows.select("word", "n", "long", "key", q.alias("q"), F.explode(places).alias("p"))
    key = F.xxhash64("key", F.col("p.side"), F.col("p.hi") - F.col("p.lo"), F.substring(F.col("word"), F.col("p.at") + 1, F.col("q")))
    return met.select("word", "n", "long", key.alias("key"), F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"))


def near_pairs(words: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(``a``, ``n_a``, ``b``, ``n_b``): the pairs of words at edit distance one, each once. ``words`` is a written
    table of different words (``word``, ``n``)."""
    size = F.length("word")
    chunk = words.select("word", "n", F.lit(0).alias("long"), F.xxhash64(size).alias("key"), F.lit(0).alias("lo"), size.alias("hi"))
    longer = F.explode(F.array(F.lit(0), F.lit(1)))
    gram = words.select("word", "n", longer.alias("long"))
    gram = gram.select("word", "n", "long", F.xxhash64(size - F.col("long")).alias("key"), F.lit(0).alias("lo"), (size - F.col("long")).alias("hi"))
    found, spent = None, []
    while True:
        rows = _split(chunk, F.lit(0)).withColumn("is_chunk", F.lit(True)).unionByName(
            _split(gram, F.col("long")).withColumn("is_chunk", F.lit(False))
        )
        rows = written(rows, "spelling-grams")
        keys = rows.groupBy("key").agg(F.count_if("is_chunk").alias("chunks"), F.count_if(~F.col("is_chunk")).alias("grams"))
        keys = keys.filter("chunks > 0 and grams > 1").select("key", (F.col("chunks") * F.col("grams") > most_pairs).alias("many"))
        keys = written(keys, "spelling-keys")
        met = written(rows.join(growing(keys), "key"), "spelling-met")
        refined = met.filter("many and hi - lo > 1").drop("many")
        joined = met.filter("not many or hi - lo <= 1")
        a = joined.filter("is_chunk").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
        b = joined.filter("not is_chunk").select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "long")
        pairs = a.join(growing(b), "key").filter("(long = 1 or a < b) and levenshtein(a, b, 1) = 1")
        pairs = written(pairs.select("a", "n_a", "b", "n_b"), "spelling-pairs")
        found = pairs if found is None else found.unionByName(pairs)
        spent += [rows, keys]
        if not refined.limit(1).count():
            break
        chunk, gram = refined.filter("is_chunk"), refined.filter("not is_chunk")
    out = written(found.distinct(), "spelling-near")
    remove(*spent)
    return out


# --- forms and roots --------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """(``word``, ``root``) of words that have a form, by pointer doubling."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("above"))
        after = at.join(growing(up), "root", "left")
        after = written(after.select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "spelling-roots")
        remove(at)
        at = after
        if not at.filter("moved").limit(1).count():
            return at.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """A row per word: ``word``, ``n``, ``n_near`` (its near words), ``form`` (the most frequent of them, if at least
    twice as frequent as the word) with ``form_n``, and ``root``, the last word that forms lead to."""
    words = written(word_counts(docs, id_col, text_col), "spelling-words")
    pairs = near_pairs(words, most_pairs)
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("n"), best.alias("best"))
    strong = -F.col("best.less") >= 2 * F.col("n")
    near = near.select(
        "word", "n_near", F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")
    )
    near = written(near, "spelling-forms")
    roots = _roots(near.filter("form is not null"))
    out = words.join(growing(near), "word", "left").join(growing(roots), "word", "left")
    return out.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")
    )
