"""Passages from a stream of new files: an extension beyond batch loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import passages_of, with_words


def stream_passages(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long, loaded timestamp") -> DataFrame:
    """Document files of a folder as they come, as passages with words; an id that comes again within a day is dropped."""
    docs = spark.readStream.schema(schema).parquet(folder)
    fresh = docs.withColumn("loaded", F.coalesce("loaded", F.current_timestamp())).withWatermark("loaded", "1 day").dropDuplicatesWithinWatermark(["doc_id"])
    return with_words(passages_of(fresh))


def store(passages: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there and stops; exactly once by way of the checkpoint."""
    return passages.writeStream.format("parquet").partitionBy("source").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
