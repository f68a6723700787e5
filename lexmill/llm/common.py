"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (binds pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one worker holds at a time when it works through an Arrow batch.
CHARS_AT_ONCE = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, where the session names none (tests), a local folder is made
    and set, so that later calls use the same one. A cluster without it is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "lexmill.shared.dir", None
    )
    if not conf:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("lexmill.shared.dir", conf)
    return conf.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that only one operator needs; ``drop`` deletes those it names, or all."""

    def __init__(self) -> None:
        self.held: list[tuple[DataFrame, str]] = []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(df.sparkSession, label)
        df.write.parquet(path)
        table = df.sparkSession.read.schema(df.schema).parquet(path)
        self.held.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        going = [(t, path) for t, path in self.held if not tables or any(t is x for x in tables)]
        self.held = [x for x in self.held if x not in going]
        for table, path in going:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names; whatever else ``df`` carries cannot clash."""
    return df.select(*(F.col(f"`{src}`").alias(dst) for dst, src in columns.items()))


def filled(column: Column) -> Column:
    """Null texts count as empty ones."""
    return F.coalesce(column.cast("string"), F.lit(""))


def slabs(batch: pa.RecordBatch, text: str, chars: int = CHARS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Cuts an Arrow batch between rows so that each piece holds about ``chars`` bytes of text."""
    lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
    start, held = 0, 0
    for row, n in enumerate(lengths):
        if held and held + n > chars:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def by_slabs(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slabs(batch, text)


def crc_fold(id_column: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds
