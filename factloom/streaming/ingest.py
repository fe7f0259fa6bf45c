"""Incremental ingest: a file stream whose checkpoint remembers what was done, and keyed replacement of its output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.chunking import chunks
from factloom.sources.tables import scratch


def ingest_pages(spark: SparkSession, source: str, target: str, checkpoint: str, most: int) -> None:
    """Cuts the pages of files not seen before into chunks and adds them to ``target``.

    Each micro-batch writes to a folder of its own number, overwriting it, so that a batch repeated after a failure
    leaves its chunks once. The run ends when all files present are done.
    """
    schema = spark.read.parquet(source).schema
    # A pattern, as a stream takes a single file only by one; it stands for a folder of files as well.
    pattern = f"{source[:-1]}[{source[-1]}]"

    def write(batch: DataFrame, number: int) -> None:
        pages = batch.withColumn("page_number", F.lit(1))
        chunks(pages, "doc_id", "page_number", "text", most).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(pattern)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingested_chunks(spark: SparkSession, source: str, most: int) -> DataFrame:
    """The chunks of all pages under ``source`` after two runs of the stream, the second of which finds nothing new."""
    target, checkpoint = scratch(spark, "chunks"), scratch(spark, "stream")
    for _ in range(2):
        ingest_pages(spark, source, target, checkpoint, most)
    return spark.read.parquet(target).drop("batch")
