"""Structured Streaming forms of the batch operators: same rules, state bounded by watermarks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, key: list, ts: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark; later rows are dropped."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def sessions(stream: DataFrame, key: str, ts: str, tolerance: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(key, start, end, n) of sessions; rows just the tolerance apart are together."""
    g = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, tolerance))
    return g.agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n")).drop("session_window")


def buckets(stream: DataFrame, key: str, ts: str, span: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """(key, slot, n) of tumbling windows."""
    g = stream.withWatermark(ts, late).groupBy(key, F.window(ts, span))
    return g.agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("slot"), "n")


def overwrite_days(stream: DataFrame, path: str, checkpoint: str):
    """Writes each batch's days anew: a batch that is run again leaves the same files."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
