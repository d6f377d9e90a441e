"""Extensions for streams: document ingestion, expiring duplicates, counts over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def document_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def ingest(stream: DataFrame, table_path: str, checkpoint: str, key: str, seq: str):
    """Append each micro-batch to a table and keep only the newest row of each key in a batch; restartable."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), seq).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{table_path}/batch={number}")  # a repeated batch overwrites itself

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_within(stream: DataFrame, keys: list[str], time: str, ttl: str = "1 hour") -> DataFrame:
    """First event of each key; a key is forgotten once it is older than the ttl."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark(keys)


def tumbling_counts(events: DataFrame, time: str, width: str, by: str) -> DataFrame:
    """(start, by, n, total): works on tables and, with a watermark, on streams."""
    source = events.withWatermark(time, width) if events.isStreaming else events
    return source.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
