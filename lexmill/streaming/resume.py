"""Incremental runs: micro-batches that leave out what is done, and windowed summaries of a stream of events."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def process_new(stream: DataFrame, keys: Sequence[str], out: str, work: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Runs work on the rows of each micro-batch whose keys aren't in `out` yet, and appends the result there.

    A batch that is run again writes to its own folder batch=<id> again, so that nothing is counted twice.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        fresh = df.dropDuplicates(list(keys))
        jvm = spark._jvm.org.apache.hadoop.fs.Path(out)
        if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
            done = spark.read.parquet(out).where(F.col("batch") != number).select(*keys)
            fresh = fresh.join(done, list(keys), "left_anti")
        work(fresh).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str, by: Sequence[str], value: str, window: str, late: str) -> DataFrame:
    """Counts and means by time window; rows later than `late` are dropped once a window has been given out."""
    w = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "mean")


def first_seen(events: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
