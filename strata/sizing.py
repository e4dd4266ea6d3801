"""Measured sizes: a side is broadcast only after its bytes were counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Size:
    rows: int
    bytes: int


def _column_bytes(field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        item = 32 if isinstance(field.dataType.elementType, T.StringType) else 8
        return F.greatest(F.size(col), F.lit(0)) * item + 24
    return F.lit(16)


def measure(df: DataFrame) -> Size:
    """Rows and approximate bytes of a DataFrame, by one aggregate job."""
    row = sum((_column_bytes(f).cast("long") for f in df.schema.fields), F.lit(0).cast("long"))
    out = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row), F.lit(0)).alias("b")).first()
    return Size(int(out["n"]), int(out["b"]))


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes the session allows for a broadcast side (0 when switched off)."""
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").strip().lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = raw.rstrip("b")
    factor = units.get(text[-1:], 1)
    number = int(text[:-1]) if factor > 1 else int(text)
    return max(0, number * factor)


def fits(spark: SparkSession, size: Size, copies: int = 1) -> bool:
    return size.bytes * copies <= broadcast_limit(spark)


def hint_if(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast hint only for a side whose size was proven small."""
    return F.broadcast(df) if small else df


def widen(df: DataFrame, key: str) -> DataFrame:
    """Spread a table of few files over the cores before heavy work on its rows;
    a table with enough files stays as it is scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session: the salt width for hot keys."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
