"""The best documents of each query from postings, for query tables of any size.

Postings (a row per document and term) are dealt out by a hash of the document, in packed pieces, and meet the weights of the
queries as matrix products inside a task, so no row per (query, document) or (query, document, term) is ever made. A task has its
documents in PARTS that it reads one after the other, all rows of a document in one.
The weights come into the same tasks by the same shuffle, ahead of the postings; beyond GROUP_ROWS of them the queries are cut into
groups, and only then postings are copied, once a group. Only the top k per task and query leaves a task.

Terms that many documents and queries of a product share are multiplied as a dense matrix, the others pair by pair. With
vectors of documents and queries, which travel in the same way, a pair's score is what ``blend`` makes of its cosine and BM25 (D8).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strata.functions.vector import unit
from strata.operators.neighbors import MATRIX_CELLS, Running, cosines, found_schema, rounded, stack
from strata.packed import pieces, unpacked
from strata.sizing import shuffle_width
from strata.storage import settle

#: Rows (query, slot, weight) that a task holds at most, beside those of one query.
GROUP_ROWS = 1_000_000
#: Queries of one matrix product.
BLOCK_QUERIES = 256
#: Parts of a task's documents: it holds the rows of one.
PARTS = 16
_WEIGHT, _ASKED, _POSTING, _VECTOR = range(4)


class _Block:
    """The weights of some queries, in the order of the slots."""

    def __init__(self, names: list, slot: np.ndarray, column: np.ndarray, weight: np.ndarray, k: int, vectors: np.ndarray | None):
        order = np.argsort(slot, kind="stable")
        self.used, self.first, self.count = np.unique(slot[order], return_index=True, return_counts=True)
        self.column, self.weight = column[order], weight[order]
        self.best, self.vectors = Running(names, k), vectors

    def scores(self, n: int, at: np.ndarray, here: np.ndarray, value: np.ndarray) -> np.ndarray:
        """BM25 of ``n`` documents (row) for every query (column), from entries (document, number in ``used``, value)."""
        width = len(self.best.query_ids)
        often = np.bincount(here, minlength=len(self.used)) * self.count > n
        hot = np.flatnonzero(often)
        place = np.full(len(self.used), -1)
        place[hot] = np.arange(len(hot))
        dense = often[here]
        matrix = np.bincount(at[dense] * len(hot) + place[here[dense]], value[dense], n * len(hot)).reshape(n, len(hot))
        entries = _spread(self.first[hot], self.count[hot])
        weights = np.zeros((len(hot), width))
        weights[np.repeat(np.arange(len(hot)), self.count[hot]), self.column[entries]] = self.weight[entries]
        kw = matrix @ weights
        flat, (at, here, value) = kw.reshape(-1), (x[~dense] for x in (at, here, value))
        ends = np.cumsum(self.count[here])
        a = 0
        while a < len(here):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MATRIX_CELLS, side="right")))
            copies = self.count[here[a:b]]
            entries = _spread(self.first[here[a:b]], copies)
            np.add.at(flat, np.repeat(at[a:b] * width, copies) + self.column[entries], np.repeat(value[a:b], copies) * self.weight[entries])
            a = b
        return kw


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run, ``count`` of them."""
    return np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)


class Board:
    """The weights of some queries, and the best documents for each of them so far."""

    def __init__(self, named: pa.Table, held: pa.Table | None, k: int, k1: float, b: float, blend: Callable | None = None):
        column = lambda name: named.column(name).combine_chunks()
        queries = column("query_id").dictionary_encode(null_encoding="encode")
        slots = column("slot").dictionary_encode()
        self.slots, ids = slots.dictionary, queries.dictionary.to_pylist()
        query, slot, weight = queries.indices.to_numpy(), slots.indices.to_numpy(), column("weight").to_numpy()
        self.avgdl, self.k1, self.b, self.blend = column("avgdl")[0].as_py(), k1, b, blend
        of, vectors = np.arange(len(ids)), None
        if blend is not None:  # a column for each vector of a query that has weights
            of = pa.compute.index_in(held.column("query_id").combine_chunks(), value_set=queries.dictionary).fill_null(-1).to_numpy()
            vectors = stack(held.column("vector").combine_chunks().filter(pa.array(of >= 0)))
            of = of[of >= 0]
        order = np.argsort(query, kind="stable")
        query, slot, weight = query[order], slot[order], weight[order]
        first, ends = (np.searchsorted(query, np.arange(len(ids)), side=side) for side in ("left", "right"))
        self.blocks = []
        for at in range(0, len(of), BLOCK_QUERIES):
            mine = of[at : at + BLOCK_QUERIES]
            count = ends[mine] - first[mine]
            entries = _spread(first[mine], count)
            local = np.repeat(np.arange(len(mine)), count)
            names, near = [ids[i] for i in mine.tolist()], None if vectors is None else vectors[at : at + BLOCK_QUERIES]
            self.blocks.append(_Block(names, slot[entries], local, weight[entries], k, near))

    def add(self, rows: pa.Table, held: pa.Table | None) -> None:
        """Postings of whole documents, in any order, and the documents' vectors."""
        coded = rows.column("doc_id").combine_chunks().dictionary_encode(null_encoding="encode")
        ids, doc = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        code = pa.compute.index_in(rows.column("slot").combine_chunks(), value_set=self.slots).fill_null(-1).to_numpy()
        order = np.argsort(doc, kind="stable")
        order = order[code[order] >= 0]
        at, code, tf, dl = doc[order], code[order], *(rows.column(c).to_numpy()[order] for c in ("tf", "dl"))
        if "sign" in rows.column_names:
            at, code, tf, dl = _standing(at, code, tf, dl, rows.column("sign").to_numpy()[order], len(self.slots))
        part = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / self.avgdl))
        vectors = None
        if self.blend is not None:
            if held is None:
                return
            owner = pa.compute.index_in(held.column("doc_id").combine_chunks(), value_set=coded.dictionary).fill_null(-1).to_numpy()
            order = np.argsort(owner, kind="stable")
            order = order[owner[order] >= 0]
            owner, vectors = owner[order], stack(held.column("vector").combine_chunks().take(pa.array(order)))
        for block in self.blocks:
            local = np.full(len(self.slots), -1)
            local[block.used] = np.arange(len(block.used))
            here = local[code]
            on = here >= 0
            docs, here, value = at[on], here[on], part[on]
            step = max(1, MATRIX_CELLS // max(1, len(block.used), len(block.best.query_ids)))
            for a in range(0, len(ids), step):
                n = min(step, len(ids) - a)
                i, j = np.searchsorted(docs, (a, a + n))
                if i == j:
                    continue
                kw = block.scores(n, docs[i:j] - a, here[i:j], value[i:j])
                if vectors is None:
                    block.best.add_over(kw, ids[a : a + n])
                else:
                    u, v = np.searchsorted(owner, (a, a + n))
                    self.blended(block, kw, ids, a, owner[u:v], vectors[u:v])

    def blended(self, block: _Block, kw: np.ndarray, ids: np.ndarray, a: int, owner: np.ndarray, vectors: np.ndarray) -> None:
        """The documents with a vector, a row for each of their vectors."""
        if not len(owner):
            return
        kw = rounded(kw[owner - a])
        score = self.blend(cosines(vectors, block.vectors, True), kw)
        block.best.add(np.where(kw > 0, score, -np.inf), ids[owner])

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for block in self.blocks:
            yield from block.best.batches(schema)


def _standing(at: np.ndarray, code: np.ndarray, tf: np.ndarray, dl: np.ndarray, sign: np.ndarray, slots: int) -> tuple:
    """The sums of signed postings per (document, slot) whose signs add up to one at least, in order of the document."""
    key = at.astype(np.int64) * slots + code
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(x[order], first) if len(first) else x for x in (sign.astype(np.int64), tf * sign, dl.astype(np.int64) * sign)]
    on, key = sums[0] > 0, key[order][first]
    return key[on] // slots, key[on] % slots, sums[1][on], sums[2][on]


def _scanner(k: int, k1: float, b: float, schema: pa.Schema, blend: Callable | None) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        board = now = None

        def table(kind: int) -> pa.Table | None:
            found = held.pop(kind, None)
            return pa.Table.from_batches(found) if found else None

        def flush() -> None:
            nonlocal board
            rows, vectors = table(_POSTING), table(_VECTOR)
            if rows is None:
                return
            if board is None and (named := table(_WEIGHT)) is not None and ((asked := table(_ASKED)) is not None or blend is None):
                board = Board(named, asked if blend is not None else None, k, k1, b, blend)
            if board is not None:
                board.add(rows, vectors)

        for batch in batches:
            for part, kind, piece in zip(*(batch.column(c) for c in ("part", "kind", "piece"))):
                if part.as_py() != now:
                    flush()
                    now = part.as_py()
                held.setdefault(kind.as_py(), []).append(unpacked(piece.as_py()))
        flush()
        if board is not None:
            yield from board.batches(schema)

    return scan


def best_matches(
    postings: DataFrame, weighed: DataFrame, k: int, k1: float, b: float, docs: DataFrame | None = None,
    queries: DataFrame | None = None, blend: Callable | None = None,
) -> DataFrame:
    """(query_id, doc_id, kw): for each query and task the ``k`` best documents of ``postings`` (doc_id, slot, tf, dl;
    a slot once for a document and length, or with a ``sign`` the rows of which those are the sums) by ``weighed`` (query_id, slot,
    weight, avgdl). With ``docs`` (doc_id, vector), ``queries`` (query_id, query_vector) and ``blend`` the best by ``blend(cosine, kw)`` of the
    documents that match and have a vector, which is then the column ``score``."""
    spark = postings.sparkSession
    weighed = settle(weighed.select("query_id", "slot", "weight", "avgdl"))
    groups = max(1, -(-weighed.count() // GROUP_ROWS))
    shards = max(1, -(-shuffle_width(spark) // groups))  # the weights are copied once a shard, the postings once a group
    signed = ["sign"] if "sign" in postings.columns else []
    group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(shards * PARTS)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))

    def asked(rows: DataFrame, kind: int) -> DataFrame:
        """Packed by group, and then copied once a shard."""
        packed = pieces(rows.withColumn("_to", group), "_to").select("to", "piece", every.alias("shard"))
        return packed.select((F.col("to") * shards + F.col("shard")).alias("lane"), F.lit(-1).alias("part"), F.lit(kind).alias("kind"), "piece")

    def held(rows: DataFrame, kind: int) -> DataFrame:
        packed = pieces(rows.withColumn("_to", place), "_to").select("to", "piece", copies.alias("group"))
        lane = F.col("group") * shards + F.expr(f"to div {PARTS}").cast("int")
        return packed.select(lane.alias("lane"), (F.col("to") % PARTS).alias("part"), F.lit(kind).alias("kind"), "piece")

    rows = asked(weighed, _WEIGHT).unionByName(held(postings.select("doc_id", "slot", "tf", "dl", *signed), _POSTING))
    if blend is not None:
        of = lambda df, key, vector: df.select(key, unit(F.col(vector)).alias("vector")).filter(f"vector is not null and {key} is not null")
        rows = rows.unionByName(asked(of(queries, "query_id", "query_vector"), _ASKED)).unionByName(held(of(docs, "doc_id", "vector"), _VECTOR))
    schema = found_schema(weighed, postings, "doc_id", "kw" if blend is None else "score")
    lanes = rows.repartitionById(groups * shards, F.col("lane")).sortWithinPartitions("part", "kind")
    return lanes.mapInArrow(_scanner(k, k1, b, to_arrow_schema(schema), blend), schema)
