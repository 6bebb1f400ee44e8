"""Structured Streaming over the append-only prediction log (extension: the
reference has no streaming code; this keeps the dashboard counters live).

Files land in a folder (one per day); ``readStream`` picks them up, a 1-day
watermark bounds late data and state, and a daily tumbling window counts predictions per
severity.  Each batch writes the windows it changed, keyed by its epoch; readers take the
newest count of a window, and epochs are compacted into one table from time to time.  The sink is Parquet folders; no row passes
through the driver.
"""
from __future__ import annotations

from threading import Event
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

HISTORY_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("state", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("severity", T.StringType()),
])


def land_daily_files(hist: DataFrame, path: str) -> str:
    """Write the history as one folder per day (the stream's input)."""
    hist.withColumn("day", F.to_date("created_at")).write.mode("overwrite").partitionBy("day").parquet(path)
    return path


def severity_counts_stream(spark: SparkSession, source: str, watermark: str = "1 day", files_per_batch: int | None = None) -> DataFrame:
    """Streaming DataFrame: counts per (day window, severity) with a watermark."""
    schema = T.StructType(list(HISTORY_SCHEMA.fields) + [T.StructField("day", T.DateType())])
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    ts = F.col("created_at").cast("timestamp")
    return (reader.parquet(source).withColumn("ts", ts).withWatermark("ts", watermark)
                  .groupBy(F.window("ts", "1 day"), "severity").agg(F.count(F.lit(1)).alias("n")))


#: Epochs between two compactions of the sink.
COMPACT_EVERY = 10


class Run(NamedTuple):
    """What a run has done: batches, and rows dropped because they came behind the watermark."""
    batches: int
    dropped_rows: int


def run_counts(stream_df: DataFrame, sink: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> Run:
    """Process everything available, then stop.  Update mode: a batch writes only the windows it changed, into the
    folder of its epoch (a repeated batch overwrites just that), and state of windows behind the watermark is dropped.  Every
    ``compact_every`` epochs the newest count of every window goes into one table, ``base=<epoch>``, and what it replaces is deleted."""
    spark = stream_df.sparkSession

    def write(batch: DataFrame, epoch: int):
        batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
        if epoch % compact_every == compact_every - 1:
            compact(spark, sink, epoch)

    seen = _Progress()
    spark.streams.addListener(seen)
    try:
        q = (stream_df.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
        seen.over.wait(60)  # events come a little later
    finally:
        spark.streams.removeListener(seen)
    return Run(*seen.of.get(str(q.runId), (0, 0)))


class _Progress(StreamingQueryListener):
    """Batches and dropped rows of each run (a query itself keeps its last hundred batches only)."""

    def __init__(self):
        self.of, self.over = {}, Event()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        batches, dropped = self.of.get(str(p.runId), (0, 0))
        self.of[str(p.runId)] = (batches + 1, dropped + sum(o.numRowsDroppedByWatermark for o in p.stateOperators))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if str(event.runId) in self.of:
            self.over.set()


def run_available_now(stream_df: DataFrame, sink: str, checkpoint: str) -> str:
    run_counts(stream_df, sink, checkpoint)
    return sink


def _folders(spark: SparkSession, sink: str) -> tuple[dict[int, str], dict[int, str]]:
    """Finished folders of the sink by number: (bases, epochs)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(sink)
    fs = top.getFileSystem(conf)
    found = {"base": {}, "epoch": {}}
    for status in fs.listStatus(top):
        kind, _, number = status.getPath().getName().partition("=")
        if kind in found and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[kind][int(number)] = status.getPath().toString()
    return found["base"], found["epoch"]


def live_folders(spark: SparkSession, sink: str) -> list[tuple[int, str]]:
    """(epoch, folder) of what holds the newest counts: the last base and the epochs after it."""
    bases, epochs = _folders(spark, sink)
    last = max(bases, default=-1)
    return [(b, bases[b]) for b in bases if b == last] + sorted((e, p) for e, p in epochs.items() if e > last)


def _newest(spark: SparkSession, folders: list[tuple[int, str]]) -> DataFrame:
    rows = None
    for number, folder in folders:
        part = spark.read.parquet(folder).select("window", "severity", "n", F.lit(number).alias("epoch"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("window", "severity").agg(F.max_by("n", "epoch").alias("n"))


def compact(spark: SparkSession, sink: str, epoch: int) -> None:
    """Newest counts up to ``epoch`` into ``base=<epoch>``; the epochs and bases before it are deleted, but not the base just
    replaced, which a reader may have open.  Repeated, it writes the same rows again."""
    bases, epochs = _folders(spark, sink)
    last = max((b for b in bases if b < epoch), default=-1)
    before = [(b, bases[b]) for b in bases if b == last] + [(e, p) for e, p in epochs.items() if last < e <= epoch]
    _newest(spark, before).coalesce(1).write.mode("overwrite").parquet(f"{sink}/base={epoch}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in [*(p for b, p in bases.items() if b < last), *(p for e, p in epochs.items() if e <= last)]:
        p = jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(conf).delete(p, True)


def read_counts(spark: SparkSession, sink: str) -> DataFrame:
    """window, severity, n: the newest count of every window, from the last base and the epochs after it."""
    return _newest(spark, live_folders(spark, sink))
