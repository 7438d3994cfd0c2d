"""Structured streams of call and job events."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def once_per_call(events: DataFrame, time: str = "ts", key: str = "call_id", late: str = "1 hour") -> DataFrame:
    """Each key once; its state is kept for as long as an event may be late."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, time: str, group: str, value: str, window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling (or sliding) windows; a window is given out once its time and lateness are over."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    out = events.withWatermark(time, late).groupBy(w.alias("w"), group).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n", "total")


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(w.alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def fan_out(events: DataFrame, checkpoint: str, *sinks: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Each micro-batch goes to every sink; a batch is cached while they write."""

    def write(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            for sink in sinks:
                sink(df, batch)
        finally:
            df.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_table(df: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
    """Appends to a Parquet table, all that is there now."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
