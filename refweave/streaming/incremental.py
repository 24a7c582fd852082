"""Labelling mentions as they arrive.

Each micro-batch joins the representations known so far; a mention whose
representation is known takes its label, another founds one of its own. A batch
delivered again writes the same rows under the same batch number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def label_batch(batch: DataFrame, known: DataFrame) -> DataFrame:
    """(mentionid, repid, label) of a batch (mentionid, repid) against (repid, label)."""
    first = batch.where("repid is not null").dropDuplicates(["mentionid"])
    return first.join(known, "repid", "left").select("mentionid", "repid", F.coalesce("label", F.concat(F.lit("s_"), F.col("repid"))).alias("label"))


def label_stream(spark: SparkSession, source: DataFrame, known_path: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """Starts labelling a stream of (mentionid, repid) against the table at known_path."""

    def write(batch: DataFrame, number: int) -> None:
        label_batch(batch, spark.read.parquet(known_path)).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted_by_window(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events per type and window, late ones admitted up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
