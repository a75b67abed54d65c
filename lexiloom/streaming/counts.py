"""Structured streams over growing corpora: gram counts, and windowed counts of events as an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytestrings import utf8
from ..operators.grams import gram_counts


def document_stream(spark: SparkSession, folder: str, files_at_once: int = 4) -> DataFrame:
    """A stream of the Parquet files of a folder; back-pressure by files a trigger."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def streaming_gram_counts(docs: DataFrame, length: int, text: str = "text") -> DataFrame:
    """Running gram counts of a stream; the state is one row for each distinct gram."""
    return gram_counts(docs.select(utf8(F.coalesce(F.col(text), F.lit(""))).alias("data")), [length])


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Process all files that are there and return the result table."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Extension: counts and sums of events by window and kind, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
