"""Event streams: counts, throttled notifications, files as a stream, and idempotent sends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream over a Parquet file, or over the files of a folder, with the schema of ``like``."""
    path = path.rstrip("/")
    return spark.readStream.schema(like.schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a glob, which may name a file too


def counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def windowed_counts(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts by event time with a bound on lateness."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """What is available now, into Parquet files."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def send_once(stream: DataFrame, target: str, checkpoint: str, key: str) -> None:
    """Each key's row once, also after a restart: a batch leaves out what the target already holds, and its own folder is overwritten."""

    def send(batch: DataFrame, batch_id: int) -> None:
        spark, out = batch.sparkSession, f"{target}/batch={batch_id}"
        new = batch.dropDuplicates([key])
        if batch_id:
            sent = spark.read.option("basePath", target).parquet(target).where(F.col("batch") < batch_id).select(key)
            new = new.join(sent, key, "left_anti")
        new.write.mode("overwrite").parquet(out)

    stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _sent(times: list[int], interval_ms: int, last: int | None) -> tuple[list[bool], int | None]:
    out = []
    for t in times:
        send = last is None or t - last >= interval_ms
        out.append(send)
        last = t if send else last
    return out, last


def throttled(events: DataFrame, interval_ms: int) -> DataFrame:
    """Events (event_id, event_type, channel, ts_ms) that a notification goes out for: at least ``interval_ms`` after the last one sent
    of the same channel type and event.

    The rule depends on the last *sent* event, so it is a scan in time order. Time is cut into spans at gaps of at least the interval:
    the first event after such a gap is always sent, so spans are independent and each is scanned by itself.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("channel", "event_type").orderBy("ts_ms", "event_id")
    gap = F.col("ts_ms") - F.lag("ts_ms").over(w)
    spans = events.withColumn("_new", (gap.isNull() | (gap >= interval_ms)).cast("int")).withColumn("span", F.sum("_new").over(w))

    names = ["event_id", "event_type", "channel", "ts_ms"]

    def scan(batches):
        now, last = None, None
        for rows in batches:
            sent = []
            for key in rows[["channel", "event_type", "span", "ts_ms"]].itertuples(index=False):
                if key[:3] != now:
                    now, last = key[:3], None
                (send,), last = _sent([key[3]], interval_ms, last)
                sent.append(send)
            yield rows.loc[sent, names]

    dealt = spans.repartition("channel", "event_type", "span").sortWithinPartitions("channel", "event_type", "span", "ts_ms", "event_id")
    return dealt.select(*names, "span").mapInPandas(scan, "event_id long, event_type string, channel string, ts_ms long")  # rows stream


def throttled_stream(events: DataFrame, interval_ms: int) -> DataFrame:
    """The same on a stream: the time last sent is the state of each (channel, event_type)."""

    def scan(key, batches, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(batches).sort_values(["ts_ms", "event_id"])
        keep, last = _sent(rows["ts_ms"].tolist(), interval_ms, last)
        if last is not None:
            state.update((last,))
        yield rows[keep][["event_id", "event_type", "channel", "ts_ms"]]

    return events.groupBy("channel", "event_type").applyInPandasWithState(scan, "event_id long, event_type string, channel string, ts_ms long", "last long", "append", "NoTimeout")


def modified_since(files: DataFrame, when: str, column: str = "ts") -> DataFrame:
    """Files changed since a time, which counts from the start of its second, as file times may be whole seconds."""
    return files.where(F.col(column) >= F.date_trunc("second", F.lit(when).cast("timestamp")))


def watch(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """New files of a folder as a stream of (path, modificationTime, length)."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime", "length")


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a folder's files as they come."""
    return spark.readStream.text(folder).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))
