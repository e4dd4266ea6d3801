"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.storage import fresh_dir

#: White space of the contracts: blank and the five control characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there, and a
    join against it starts from a plain scan, which adaptive execution can split."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sized(df: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """A table of a known number of small rows in as many partitions as these rows need: rounds
    over few rows do not start a task for every shuffle partition."""
    return df.coalesce(max(1, -(-rows // per_task)))


def growing(df: DataFrame) -> DataFrame:
    """A join side that grows with the input: it is shuffled at every size, never broadcast."""
    return df.hint("merge")


def remove(*tables: DataFrame) -> None:
    """Delete tables made by `written` that nothing needs any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession, size: int = 1 << 25) -> None:
    """Bound the bytes of the batches that go to Python workers, unless the session does so."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) > size:
        spark.conf.set(key, str(size))


def map_arrow(df: DataFrame, function: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """`mapInArrow` for columns of any name, dots included."""
    names = df.columns

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(batch.rename_columns(names) for batch in batches)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str) -> Column:
    """A column by its plain name, dots included."""
    return df[f"`{name}`"]


def text_of(df: DataFrame, name: str = "text") -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(column(df, name).cast("string"), F.lit(""))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as it takes to differ from all columns."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
