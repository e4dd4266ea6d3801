"""Benchmark decontamination by template canonicalisation (operator 9).

A text becomes a sequence of template tokens: words in lower case without punctuation at their
ends, numbers as <number>, units after a number as <unit>, and names (capitalised words inside a
sentence, a run of them as one) as <name>. Windows of `width` template tokens of documents meet
those of benchmark items in a hash join. A window with fewer than three words besides placeholders
would meet too much: it grows over further tokens, to the left and to the right, until it has three.
Items that have fewer words at all ("What is 48 / 6 + 7?") are met by windows with the values
behind their placeholders, grown until they have one word: such an item is found where its own
values stand. Windows of a document and an item that lie on one
diagonal (same difference of positions) are one placement; there the values behind the
placeholders must agree with one another: equal values of the item stand for equal values in the
document and different ones for different ones. A document holds an item if the placements
that agree cover at least `share` of the item's template tokens, whatever numbers and names it uses.

The documents are not shuffled: a bit filter of bounded size, made of the items' window hashes,
lets through the windows that may meet an item, and only these are joined. The filter only saves
work: whatever it lets through by chance finds no partner in the join.

Cases: null and empty texts and items hold nothing; items shorter than `width` have windows of
their own length, with three words (all, if it is shorter) or their values; items without a word
(numbers or names alone) are never found; rows that repeat id and text give one result row; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.shingles import MEMO_WORDS, MIX, mixed, windows
from strata.llm.tables import bound_batches, column, written

WIDTH = 5
SHARE = 0.8
WORDS_NEEDED = 3
FILTER_BITS = 1 << 22

# Units and number words.
UNITS = (
    "kg g mg lb lbs oz km m cm mm mi ft in yd mile miles meter meters metre metres inch inches foot feet yard yards "
    "kilogram kilograms gram grams pound pounds ounce ounces liter liters litre litres l ml gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur gbp mph kph km/h degrees percent %"
).split()
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()

_NUMBER = re.compile(r"[^\w]*\d[\d.,:/-]*(?:st|nd|rd|th|%)?$")
_QUANTITY = re.compile(r"\d[\d.,]*(?:" + "|".join(sorted((re.escape(u) for u in UNITS), key=len, reverse=True)) + r")$")
_COUNTING, _MEASURES = frozenset(NUMBER_WORDS), frozenset(UNITS)
_MARKS_AROUND = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")

WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
_MARKS = [0] + [xxhash.xxh3_64_intdigest(m) >> 4 << 4 for m in ("<number>", "<name>", "<unit>")]

FIELDS = "pos int, width int, hash long, slots array<long>"


class Tokens(dict):
    """A raw token as an integer: hash of its word above four bits: 1 capitalised, 2 ends a
    sentence, 4 number, 8 unit. Tokens without a letter or digit have hash 0."""

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        core = raw.strip(_MARKS_AROUND)
        word = core.decode("utf-8", "replace")
        if word.isalpha():
            tail = raw[len(raw.rstrip(_MARKS_AROUND)) :]
            flags = 2 if tail and (b"." in tail or b"!" in tail or b"?" in tail or b":" in tail) else 0
        else:
            token = raw.decode("utf-8", "replace")
            word = _EDGES.sub("", token)
            tail = token[token.rfind(word) + len(word) :] if word else token
            flags = 2 if any(c in ".!?:" for c in tail) else 0
        value = 0
        if word:
            low = word.lower()
            value = xxhash.xxh3_64_intdigest(low) >> 4 << 4 or 16
            if low in _COUNTING or (not word.isalpha() and (_NUMBER.match(low) or _QUANTITY.match(low))):
                flags |= 4
            else:
                flags |= word[0].isupper() and word[1:].islower()
                flags |= 8 * (low in _MEASURES)
        self[raw] = value | flags
        return value | flags


def canonical(text: str | None, memo: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Template tokens of a text, and for each the value behind a placeholder (0 for a word)."""
    raw = text.encode("utf-8", "surrogatepass").replace(b"\n", b".\n").split() if text else []
    packed = np.fromiter(map(memo.__getitem__, raw), np.uint64, len(raw))
    value, flags = packed & ~np.uint64(15), (packed & np.uint64(15)).astype(np.int8)
    starts = np.ones(len(raw), bool)
    starts[1:] = flags[:-1] & 2 > 0
    kept = value > 0
    starts = starts | np.concatenate([[False], ~kept[:-1]]) if len(raw) else starts
    value, flags, starts = value[kept], flags[kept], starts[kept]
    kind = np.zeros(len(value), np.int8)
    kind[(flags & 1 > 0) & ~starts] = NAME
    number = flags & 4 > 0
    kind[number] = NUMBER
    after = np.zeros(len(value), bool)
    after[1:] = number[:-1]
    kind[(flags & 8 > 0) & after] = UNIT
    again = np.zeros(len(value), bool)
    again[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME)
    value, kind = value[~again], kind[~again]
    marks = np.array(_MARKS, np.uint64)
    return np.where(kind == WORD, value, marks[kind]), np.where(kind == WORD, np.uint64(0), value)


_BACK = np.uint64(pow(int(MIX), -1, 1 << 64))
_EXACT = np.uint64(0x5851F42D4C957F2D)


def _spans(words: np.ndarray, width: int, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what the windows with fewer than `needed` words grow to: to the left up to
    the word that is needed, and to the right. `words` tells which tokens are words."""
    before = np.concatenate([[0], np.cumsum(words)])
    poor = np.flatnonzero(before[width:] - before[:-width] < needed)
    place = np.flatnonzero(words)
    left = poor[before[poor + width] >= needed]
    right = poor[before[-1] - before[poor] >= needed]
    starts = np.concatenate([place[before[left + width] - needed], right])
    ends = np.concatenate([left + width, place[before[right] + needed - 1] + 1])
    return starts, ends


def _grown(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of tokens, from the sums of tokens times powers."""
    first, last = int(starts.min()), int(ends.max())
    powers = np.full(last - first, MIX)
    powers[0] = 1
    back = np.full(last - first, _BACK)
    back[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((tokens[first:last] + np.uint64(1)) * np.cumprod(powers))])
    return mixed((sums[ends - first] - sums[starts - first]) * np.cumprod(back)[starts - first])


def _windows(template: np.ndarray, slots: np.ndarray, width: int, full: bool, exact: bool, longest: int) -> Iterator[tuple]:
    """Starts, ends and hashes of the windows with enough words, `full` ones grown up to `longest`
    tokens; and, where `exact`, of those with fewer words but one, by their values."""
    if len(template) < width:
        return
    needed = min(WORDS_NEEDED, width)
    words = slots == 0
    before = np.concatenate([[0], np.cumsum(words)])
    number = before[width:] - before[:-width]
    rich = np.flatnonzero(number >= needed)
    if len(rich):
        yield rich, rich + width, windows(template, width)[rich]
    if len(rich) == len(number):
        return
    values = np.where(words, template, slots ^ _EXACT)
    for tokens, least, wanted in ((template, needed, full), (values, 1, exact)):
        spans = [_spans(words, width, least)] if wanted and full else []
        if tokens is values and exact:
            few = np.flatnonzero((number >= 1) & (number < needed))
            spans.append((few, few + width))
        starts, ends = (np.concatenate(x) for x in zip(*spans)) if spans else (rich[:0], rich[:0])
        near = ends - starts <= longest
        if near.any():
            yield starts[near], ends[near], _grown(tokens, starts[near], ends[near])


def _emit(schema: T.StructType, batch: pa.RecordBatch, text_col: str, choose) -> pa.RecordBatch:
    """Window rows of a batch; `choose` gives the windows of a text's template."""
    memo = choose.memo
    lines, at, width_of, hash_of, slot_of = [], [], [], [], []
    for line, text in enumerate(batch.column(text_col).to_pylist()):
        template, slots = canonical(text, memo)
        for starts, ends, hashes in choose.windows(template, slots):
            found = np.flatnonzero(choose.wanted(hashes))
            if len(found):
                starts, ends = starts[found], ends[found]
                lines += [line] * len(found)
                at += starts.tolist()
                width_of += (ends - starts).tolist()
                hash_of.append(hashes[found])
                slot_of += [slots[i:j].astype(np.int64).tolist() for i, j in zip(starts.tolist(), ends.tolist())]
    take = pa.array(lines, pa.int64())
    keys = [batch.column(f.name).take(take) for f in schema.fields if f.name in batch.schema.names]
    made = [
        pa.array(at, pa.int32()),
        pa.array(width_of, pa.int32()),
        pa.array(np.concatenate(hash_of).view(np.int64) if hash_of else [], pa.int64()),
        pa.array(slot_of, pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(keys + made, [f.name for f in schema.fields])


class _OfItems:
    """All windows of an item: of `width` tokens or grown ones, or one of all tokens if there are fewer;
    by values where the item has too few words."""

    def __init__(self, width: int):
        self.width, self.memo = width, Tokens()

    def windows(self, template: np.ndarray, slots: np.ndarray) -> Iterator[tuple]:
        n = len(template)
        if n:
            width = min(self.width, n)
            few = int((slots == 0).sum()) < min(WORDS_NEEDED, width)
            yield from _windows(template, slots, width, n >= self.width, few, n)

    def wanted(self, hashes: np.ndarray) -> np.ndarray:
        return np.ones(len(hashes), bool)


class _OfDocuments:
    """Windows like the items' that the filter lets through."""

    def __init__(self, width: int, lengths: list[int], bits: np.ndarray):
        self.width, self.lengths, self.bits, self.memo = width, lengths, bits, Tokens()
        self.longest = max(lengths, default=0)

    def windows(self, template: np.ndarray, slots: np.ndarray) -> Iterator[tuple]:
        for width in self.lengths:
            if width <= self.width:
                yield from _windows(template, slots, width, width == self.width, True, self.longest)
        if self.longest > self.width and self.width not in self.lengths:
            yield from _windows(template, slots, self.width, True, True, self.longest)

    def wanted(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & np.uint64(len(self.bits) * 8 - 1)
        return self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0


def _window_table(df: DataFrame, text_col: str, make) -> DataFrame:
    fields = [f for f in df.schema.fields if f.name != text_col]
    schema = T.StructType([*fields, *T._parse_datatype_string(FIELDS).fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = make()
        for batch in batches:
            yield _emit(schema, batch, text_col, choose)

    return df.mapInArrow(cut, schema)


def _filter(items: DataFrame) -> np.ndarray:
    """Bits set at the items' window hashes; its size is bounded whatever the number of items."""
    place = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in items.select(place.alias("p")).distinct().toLocalIterator():
        bits[row["p"] >> 3] |= 1 << (row["p"] & 7)
    return bits


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    share: float = SHARE,
) -> DataFrame:
    """A row per document and item that it holds: ``doc_id``, ``text_hash`` (of the document),
    ``item_id``, ``covered`` and ``item_tokens`` (template tokens), ``changed`` (whether numbers, names
    or units differ from the item's)."""
    bound_batches(docs.sparkSession)
    wanted = benchmark.select(
        column(benchmark, item_col).alias("item_id"), column(benchmark, item_text_col).cast("string").alias("text")
    )
    items = _window_table(wanted, "text", lambda: _OfItems(width)).distinct()
    items = written(items, "template-items")
    lengths = sorted(r[0] for r in items.select("width").distinct().collect())
    bits = docs.sparkSession.sparkContext.broadcast(_filter(items))
    text = column(docs, text_col).cast("string")
    source = docs.select(column(docs, id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    hits = _window_table(source, "text", lambda: _OfDocuments(width, lengths, bits.value))
    hits = written(hits, "template-hits")

    sizes = written(_sizes(wanted), "template-sizes")
    parts = items.select("item_id", F.col("pos").alias("item_pos"), "width", "hash", F.col("slots").alias("item_slots"))
    met = hits.join(parts, ["hash", "width"])
    pairs = F.filter(F.arrays_zip("item_slots", "slots"), lambda p: p["slots"] != 0)
    placed = met.select(
        "doc_id", "text_hash", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal"),
        F.sequence("item_pos", F.col("item_pos") + F.col("width") - 1).alias("tokens"), pairs.alias("pairs"),
    )
    one = placed.groupBy("doc_id", "text_hash", "item_id", "diagonal").agg(
        F.array_distinct(F.flatten(F.collect_set("tokens"))).alias("tokens"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    distinct = [F.size(F.array_distinct(F.col(f"pairs.{side}"))) for side in ("item_slots", "slots")]
    agree = one.filter((distinct[0] == F.size("pairs")) & (distinct[1] == F.size("pairs")))
    whole = agree.groupBy("doc_id", "text_hash", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("tokens")))).alias("covered"),
        F.max(F.exists("pairs", lambda p: p["item_slots"] != p["slots"])).alias("changed"),
    )
    found = whole.join(sizes, "item_id").filter(F.col("covered") >= share * F.col("item_tokens"))
    return found.select("doc_id", "text_hash", "item_id", "covered", "item_tokens", "changed")


def _sizes(items: DataFrame) -> DataFrame:
    fields = T.StructType([items.schema["item_id"], T.StructField("item_tokens", T.IntegerType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Tokens()
        for batch in batches:
            sizes = [len(canonical(text, memo)[0]) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(sizes, pa.int32())], ["item_id", "item_tokens"])

    return items.mapInArrow(count, fields).groupBy("item_id").agg(F.max("item_tokens").alias("item_tokens"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no item, all columns kept."""
    held = leaks(docs, benchmark, id_col, text_col, **options)
    held = written(held.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "template-held")
    text = column(docs, text_col).cast("string")
    return docs.join(held, column(docs, id_col).eqNullSafe(held["_id"]) & (F.xxhash64(text) == held["_hash"]), "left_anti")
