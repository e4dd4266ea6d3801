"""Best-fit packing by bulk-synchronous rounds (operator 11).

Documents become token ids and are cut into pieces of at most the capacity; then only (id, length) of the pieces
moves. Best fit decreasing goes from long to short, so the rounds take one octave of lengths each: pieces of
over half a sequence open one each, and every following octave fills what the ones before have left.

A round matches the octave's pieces with the open gaps by two sweeps:

1. Pieces and gaps are range-sorted by size, longest first, a gap before a piece of its size, so each task has a
   range of both. It sweeps them once: every piece goes to its successor, the smallest gap of the range that
   holds it, and the rest of the gap is a smaller gap from then on. Pieces are taken by rank, which settles who
   gets a gap that several want.
2. What is left of a range meets gaps of longer ranges: any of them holds any piece that is left. The driver has
   the counts of each range (a row per task, none per piece) and hands them out by rank: a range's pieces get the
   least longer gaps that are still free, as many as surely take all of them. Each range with pieces left is one
   group, sorted and swept again; pieces whose group has no gap left open sequences, longest first.

Then the gaps are updated (a written table) and the next octave follows. Equal lengths are no hot key: ranges are
cut within a length by id. A sweep holds the gaps of its range, by size; it streams the pieces.

Cases: null and empty texts are the closing id alone, so each document has a piece; a very long text is cut into
pieces, the memory of its task grows by its ids; repeated rows and null ids are packed as rows of their own; ties go
by row number; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.tables import bound_batches, column, growing, map_arrow, remove, text_of, written

CAPACITY = 4096
CLOSING = 1
TOKENIZER = "word_bpe_49k.json"
#: Ids of words between blanks that a task remembers; longer words are not remembered.
MEMO_WORDS, MEMO_BYTES = 400_000, 64
#: Pieces and gaps of one task of a sweep, and the most tasks.
ROWS, MOST_TASKS = 20_000, 20_000
#: The last octaves go together.
LEAST_OCTAVE = 64

PIECES = "uid long, doc_id long, piece int, start long, length int, ids_crc32 long"


# --- token ids -------------------------------------------------------------------


def _byte_letters() -> dict[int, str]:
    """The letters that stand for UTF-8 bytes in a byte-level vocabulary: printable Latin-1 for itself, the other
    bytes in order from U+0100 on (fixed values)."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(0x100 + i) for i, b in enumerate(others)}


class WordIds(dict):
    """Ids, as little-endian bytes, of what stands between blanks. No token reaches over a blank: the tokenizer drops
    them before it looks for pairs, so a text's ids are those of its words in order. Nor does one reach out of a
    run of letters, a digit or a run of signs, so new words of ASCII and Latin-1 letters, which no
    normalising changes but for their case, are put together from known runs. Of a full memory the words
    met since the last time it was full stay at hand."""

    #: How the tokenizer cuts a lower-cased text, for these characters.
    RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    LETTERS = _byte_letters()

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.older: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.older_runs: dict[str, bytes] = {}

    def run(self, text: str) -> bytes:
        value = self.runs.get(text)
        if value is None:
            value = self.older_runs.get(text)
            if value is None:
                letters = text if text.isascii() else text.encode().decode("latin-1").translate(self.LETTERS)
                value = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            if len(self.runs) >= MEMO_WORDS:
                self.older_runs, self.runs = self.runs, {}
            self.runs[text] = value
        return value

    def __missing__(self, word: bytes) -> bytes:
        value = self.older.get(word)
        if value is None:
            text = word.decode()
            if len(word) <= MEMO_BYTES and self.PLAIN.fullmatch(text) and "<|" not in text:  # special tokens stay whole
                value = b"".join(map(self.run, self.RUNS.findall(text.lower())))
            else:
                value = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The words of a worker, which it keeps over its tasks."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def _tokenizer_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """A row per piece: a row number ``uid``, ``doc_id``, ``piece``, ``start``, ``length`` and ``ids_crc32``."""
    bound_batches(docs.sparkSession, 1 << 24)
    closing = array("I", [CLOSING]).tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(_tokenizer_path(tokenizer))
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[tuple] = []
            for row, text in enumerate(batch.column(1)):
                ids = words.of(text.as_py()) + closing
                for at in range(0, len(ids), 4 * capacity):
                    part = ids[at : at + 4 * capacity]
                    out.append((uid, row, at // (4 * capacity), at // 4, len(part) // 4, zlib.crc32(part)))
                    uid += 1
            uids, rows, *rest = zip(*out, strict=True) if out else [[]] * 6
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [pa.array(uids, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                arrays + [pa.array(c, k) for c, k in zip(rest, kinds, strict=True)],
                names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(column(docs, id_col).alias("id"), text_of(docs, text_col).alias("text"))
    return map_arrow(texts, cut, PIECES.replace("doc_id long", f"doc_id {kind}"))


# --- sweeps ------------------------------------------------------------------------

#: What a sweep gives out: a placed piece, a piece that is left, a gap that holds every later piece, another gap.
PLACED, LEFT, FREE, SMALL = range(4)
SWEPT = "what int, part int, pos int, id long, seq long, size int, offset int"


class Gaps:
    """Open sequences by their gap; the smallest gap that holds a length is found in a bit set of the sizes."""

    def __init__(self, capacity: int):
        self.capacity, self.by_size, self.sizes = capacity, [[] for _ in range(capacity + 1)], 0

    def add(self, seq: int, gap: int) -> None:
        if gap:
            self.by_size[gap].append(seq)
            self.sizes |= 1 << gap

    def place(self, length: int) -> tuple[int, int] | None:
        """(sequence, place there) for a piece, whose gap shrinks; None if no gap holds it."""
        fit = self.sizes >> length
        if not fit:
            return None
        gap = length + (fit & -fit).bit_length() - 1
        here = self.by_size[gap]
        seq = here.pop()
        if not here:
            self.sizes ^= 1 << gap
        self.add(seq, gap - length)
        return seq, self.capacity - gap

    def rest(self) -> Iterator[tuple[int, int]]:
        """(sequence, gap), largest first."""
        for gap in range(self.capacity, 0, -1):
            for seq in self.by_size[gap]:
                yield seq, gap


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = [c.split()[0] for c in SWEPT.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _range_sweep(capacity: int):
    """Sweep over a task's range of pieces and gaps, sorted by size, largest first."""

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, gaps, left, least = TaskContext.get().partitionId(), Gaps(capacity), 0, capacity
        for batch in batches:
            out = []
            for size, is_piece, uid in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                least = size
                if not is_piece:
                    gaps.add(uid, size)
                elif at := gaps.place(size):
                    out.append((PLACED, part, 0, uid, at[0], size, at[1]))
                else:
                    out.append((LEFT, part, left, uid, None, size, None))
                    left += 1
            yield _batch(out)
        # a gap of at least the smallest size here holds whatever later ranges have
        yield _batch([(FREE if gap >= least else SMALL, part, i, None, seq, gap, None) for i, (seq, gap) in enumerate(gaps.rest())])

    return sweep


def _group_sweep(capacity: int):
    """Sweep over groups, each with its gaps before its pieces; a piece without a gap opens a sequence."""

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gaps = None, Gaps(capacity)

        def rest() -> pa.RecordBatch:
            return _batch([(SMALL, now, 0, None, seq, gap, None) for seq, gap in gaps.rest()])

        for batch in batches:
            out = []
            for group, is_piece, size, uid in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if group != now:
                    if now is not None:
                        yield rest()
                    now, gaps = group, Gaps(capacity)
                if not is_piece:
                    gaps.add(uid, size)
                    continue
                at = gaps.place(size)
                if at is None:
                    gaps.add(uid, capacity - size)
                    at = uid, 0
                out.append((PLACED, group, 0, uid, at[0], size, at[1]))
            yield _batch(out)
        if now is not None:
            yield rest()

    return sweep


def _handed_out(ranges: list) -> dict[int, list[tuple[int, int, int]]]:
    """For each range that keeps free gaps, longest range first: (from, to, group), positions of gaps that go to the
    range named by the group. Free gaps lie on a stack, the least on top; the pieces left of a range take from
    it until the gaps, each filled with pieces of the range's longest length, take them all."""
    stack: list[list[int]] = []
    given: dict[int, list[tuple[int, int, int]]] = {}
    for r in ranges:
        need = r["left"]
        while need > 0 and stack:
            part, end, least = stack[-1]
            each = least // r["longest"]
            take = min(end, -(-need // each))
            given.setdefault(part, []).append((end - take, end, r["part"]))
            need -= take * each
            stack[-1][1] -= take
            if not stack[-1][1]:
                stack.pop()
        if r["free"]:
            stack.append([r["part"], r["free"], r["least"]])
    return given


def _tasks(rows: int) -> int:
    return max(1, min(MOST_TASKS, -(-rows // ROWS)))


def _octaves(capacity: int) -> list[tuple[int, int]]:
    """(above, up to) lengths, from half the capacity down; the shortest lengths are one octave."""
    out, high = [], capacity // 2
    while high > max(1, capacity * LEAST_OCTAVE // CAPACITY):
        out.append((high // 2, high))
        high //= 2
    return [*out, (0, high)]


def _round(lengths: DataFrame, n: int, gaps: DataFrame, n_gaps: int, low: int, capacity: int) -> tuple[list[DataFrame], DataFrame]:
    """Place all pieces of an octave (``lengths``, n of them): placements and the gaps from then on."""
    pieces_in = lengths.select(F.col("length").alias("size"), F.lit(True).alias("is_piece"), "uid")
    gaps_in = gaps.filter(F.col("size") > low).select("size", F.lit(False).alias("is_piece"), F.col("seq").alias("uid"))
    order = [F.col("size").desc(), F.col("is_piece"), F.col("uid")]
    dealt = pieces_in.unionByName(gaps_in).repartitionByRange(_tasks(n + n_gaps), *order).sortWithinPartitions(*order)
    swept = written(dealt.mapInArrow(_range_sweep(capacity), SWEPT), "packing-range")
    kind = F.col("what")
    ranges = swept.groupBy("part").agg(
        F.count_if(kind == LEFT).alias("left"),
        F.max(F.when(kind == LEFT, F.col("size"))).alias("longest"),
        F.count_if(kind == FREE).alias("free"),
        F.min(F.when(kind == FREE, F.col("size"))).alias("least"),
    )
    ranges = sorted(ranges.collect(), key=lambda r: r["part"])  # a row per task
    given = _handed_out(ranges)

    def tag(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, pos = (batch.column(c).to_numpy() for c in ("part", "pos"))
            group = np.where(batch.column("what").to_numpy() == LEFT, part, -1)
            free = batch.column("what").to_numpy() == FREE
            for p in set(part[free].tolist()) & given.keys():
                here = np.flatnonzero(free & (part == p))
                bounds = sorted(given[p])
                at = np.searchsorted([b[0] for b in bounds], pos[here], side="right") - 1
                inside = (at >= 0) & (pos[here] < np.array([b[1] for b in bounds])[at])
                group[here[inside]] = np.array([b[2] for b in bounds])[at[inside]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group, pa.int32())], names=[*batch.schema.names, "grp"])

    placed = [swept.filter(kind == PLACED)]
    unused = gaps.filter(F.col("size") <= low)
    if any(r["left"] for r in ranges):
        swept = swept.filter(kind != PLACED).mapInArrow(tag, SWEPT + ", grp int")
        swept = written(swept, "packing-groups")
        rows = swept.filter("grp >= 0").select(
            "grp", (kind == LEFT).alias("is_piece"), "size", F.coalesce("id", "seq").alias("uid")
        )
        many = sum(r["left"] for r in ranges) + sum(b - a for x in given.values() for a, b, _ in x)
        order = ["grp", "is_piece", F.col("size").desc(), "uid"]
        rows = rows.repartition(_tasks(many), "grp").sortWithinPartitions(*order)
        grouped = written(rows.mapInArrow(_group_sweep(capacity), SWEPT), "packing-swept")
        placed.append(grouped.filter(kind == PLACED))
        unused = unused.unionByName(grouped.filter(kind == SMALL).select("seq", "size"))
        swept = swept.filter("grp < 0")
    unused = unused.unionByName(swept.filter(kind.isin(FREE, SMALL)).select("seq", "size"))
    return placed, written(unused, "packing-gaps")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """A row per piece: ``doc_id``, ``piece``, ``start`` (the document's ids before it), ``length``, ``ids_crc32``, and
    where it lies: ``sequence_id`` and ``offset``."""
    cut = written(pieces(docs, id_col, text_col, capacity, tokenizer), "packing-pieces")
    octaves = _octaves(capacity)
    octave = sum((F.when(F.col("length") <= high, 1).otherwise(0) for _, high in octaves), F.lit(0))
    counts = dict(cut.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("n")).collect())
    half = capacity // 2
    opened = cut.filter(F.col("length") > half)
    placed = [opened.select("uid", F.col("uid").alias("sequence_id"), F.lit(0).alias("offset"))]
    gaps = opened.filter(F.col("length") < capacity).select(F.col("uid").alias("seq"), (capacity - F.col("length")).alias("size"))
    gaps = written(gaps, "packing-gaps")
    for i, (low, high) in enumerate(octaves):
        if not (n := counts.get(i + 1)):
            continue
        lengths = cut.filter((F.col("length") > low) & (F.col("length") <= high))
        found, after = _round(lengths, n, gaps, gaps.filter(F.col("size") > low).count(), low, capacity)
        placed += [f.select(F.col("id").alias("uid"), F.col("seq").alias("sequence_id"), "offset") for f in found]
        remove(gaps)
        gaps = after
    where = placed[0]
    for more in placed[1:]:
        where = where.unionByName(more)
    out = cut.join(growing(where), "uid")
    return out.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset")
    )
