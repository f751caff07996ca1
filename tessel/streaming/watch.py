"""Beyond the batch build: a streaming source of changed files that keeps an index up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessel.plans.build import Index
from tessel.sources.files import scan


def watch(spark: SparkSession, roots: list[str], folder: str, checkpoint: str) -> StreamingQuery:
    """Run the incremental build for every batch of new files; each batch re-hashes and replaces whole modules."""
    index = Index(spark, folder)
    stream = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{py,xml,csv,js}")
    stream = stream.schema("path string, modificationTime timestamp, length long, content binary").load(roots[0]).select("path")

    def handle(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            index.build(scan(spark, roots))

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event counts per window and type, late rows beyond the watermark left out; works on batches and streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
