"""A shuffle whose rows travel as compressed columns.

Spark's shuffle moves a row in a format of eight bytes a field and more, which a block compression shrinks little where a row
is an id, a word and a count. `deal` cuts what a task has for a target partition into pieces, and each travels as one binary: an
Arrow batch whose strings are numbered and whose buffers are compressed. Rows arrive in the order of their pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and bytes that a task gathers before it cuts them into pieces.
PIECE_ROWS = 250_000
PIECE_BYTES = 16 << 20
#: Rows that leave a task at once.
BATCH_ROWS = 20_000


def _packed(rows: pa.Table) -> bytes:
    """The rows of one partition: strings numbered where that pays."""
    columns = []
    for column in rows.columns:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if pa.types.is_string(column.type):
            coded = column.dictionary_encode()
            column = coded if 2 * len(coded.dictionary) < len(column) else column
        columns.append(column)
    batch = pa.RecordBatch.from_arrays(columns, names=rows.column_names)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(piece: bytes) -> pa.RecordBatch:
    """The rows of a piece."""
    with pa.ipc.open_stream(piece) as stream:
        batch = stream.read_next_batch()
    columns = [c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in batch.columns]
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def pieces(df: DataFrame, to: str) -> DataFrame:
    """(to, piece): the rows of ``df`` packed by the column ``to``, an integer, where they are."""

    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        target = table.column(to).to_numpy().astype(np.int32)
        order = np.argsort(target, kind="stable")
        table, target = table.drop_columns([to]).take(pa.array(order)), target[order]
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(target)]):
            piece = _packed(table.slice(a, b - a).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([int(target[a])], pa.int32()), pa.array([piece], pa.binary())], names=["to", "piece"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= PIECE_ROWS or size >= PIECE_BYTES:
                yield from cut(held)
                held, rows, size = [], 0, 0
        if held:
            yield from cut(held)

    return df.mapInArrow(pack, "to int, piece binary")


def deal(df: DataFrame, partitions: int, to: str) -> DataFrame:
    """The rows of ``df`` without the column ``to``, a number from 0 that says to which of the ``partitions`` each goes."""
    schema = T.StructType([f for f in df.schema.fields if f.name != to])
    arrow = to_arrow_schema(schema)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.column(0):
                rows = unpacked(piece.as_py())
                rows = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(rows.columns, arrow, strict=True)], schema=arrow)
                for at in range(0, rows.num_rows, BATCH_ROWS):
                    yield rows.slice(at, BATCH_ROWS)

    return pieces(df, to).repartitionById(partitions, F.col("to")).select("piece").mapInArrow(unpack, schema)
