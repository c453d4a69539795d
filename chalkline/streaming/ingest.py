"""Incremental ingest: new files of papers become normalized chunks, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.operators import chunking
from chalkline.plans import build


def chunk_stream(papers: DataFrame, key: str = "arxiv_id", body: str = "body") -> DataFrame:
    """Stateless, so it is the same plan for a stream and for a batch."""
    return build.normalized(chunking.chunks(chunking.sections(papers, key, body), key))


def ingest(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, key: str = "arxiv_id", body: str = "body", prepare=None):
    """Process whatever files are new under source (a folder or a pattern) and stop. prepare(rows) makes key and body of other columns. A restart
    resumes from the checkpoint; the file sink commits each batch once."""
    papers = spark.readStream.schema(schema).parquet(source)
    out = chunk_stream(prepare(papers) if prepare else papers, key, body)
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(chunks: DataFrame, key: str = "chunk_id", time: str = "ingested_at", delay: str = "7 days") -> DataFrame:
    """First delivery of each chunk within the delay; state older than the watermark is dropped."""
    return chunks.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def late_counts(chunks: DataFrame, time: str = "ingested_at", delay: str = "7 days", window: str = "1 day") -> DataFrame:
    """Chunks a day by arrival, closed when the watermark has passed."""
    return chunks.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "n")
