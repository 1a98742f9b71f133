"""The day-partitioned Parquet store: append, read, retention and compaction; and copies to several sinks."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftflow.frame import LogFrame


def append(df: DataFrame, path: str, files_per_day: int = 8) -> None:
    """Rows of one stream share a file of their day, in the order of time, so min and max of row groups prune by both.

    A day's rows are spread over files_per_day tasks by stream; a stream that outgrows a task is split by AQE.
    """
    spread = df.repartition("_day", F.pmod(F.xxhash64("_stream_id"), F.lit(files_per_day)))
    spread.sortWithinPartitions("_day", "_stream_id", "_time").write.mode("append").partitionBy("_day").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> LogFrame:
    """The store as a log; a filter on _time also prunes the days' folders."""
    df = spark.read.parquet(path)
    return LogFrame(df.withColumn("_day", F.col("_day").cast("date")), (), "fields", "_day")


def _days(spark: SparkSession, path: str) -> list[tuple[date, object, int]]:
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = []
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if name.startswith("_day=") and name[5:] != "__HIVE_DEFAULT_PARTITION__":
            out.append((date.fromisoformat(name[5:]), s.getPath(), fs.getContentSummary(s.getPath()).getLength()))
    return sorted(out, key=lambda x: x[0])


def retain(spark: SparkSession, path: str, today: date, days: int | None = None, max_bytes: int | None = None) -> list[date]:
    """Deletes days older than `days`, then the oldest ones while the store is over max_bytes; the last two days always stay."""
    found, gone = _days(spark, path), []
    total = sum(n for _, _, n in found)
    for d, p, n in found:
        old = days is not None and d < today - timedelta(days=days)
        large = max_bytes is not None and total > max_bytes and d < today - timedelta(days=1)
        if old or large:
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
            total -= n
            gone.append(d)
    return gone


def compact(spark: SparkSession, path: str, day: date, target: str, files: int = 1) -> None:
    """A day's rows in `files` files of a new folder, sorted by stream and time."""
    df = spark.read.parquet(path).where(F.col("_day") == F.lit(day))
    df.repartitionByRange(files, "_stream_id", "_time").sortWithinPartitions("_stream_id", "_time").write.partitionBy("_day").option("compression", "zstd").parquet(target)


def replicate(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """A streaming query that gives each micro-batch to every sink; a batch that one of them failed comes again to all."""

    def each(df: DataFrame, epoch: int) -> None:
        df = df.persist()
        try:
            for sink in sinks:
                sink(df, epoch)
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def generated(spark: SparkSession, rows: int, start: str = "2024-01-01T00:00:00Z", step_ms: int = 1000, streams: int = 4) -> DataFrame:
    """A load of made rows with fields of every kind, for tests at scale."""
    i = F.col("id")
    h = F.xxhash64(i)
    pick = lambda k, n: F.pmod(F.xxhash64(i, F.lit(k)), F.lit(n))
    return spark.range(rows).select(
        F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + i * step_ms * 1000).alias("_time"),
        F.concat(F.lit("message for the stream "), pick(0, streams).cast("string"), F.lit(" and worker "), pick(1, 8).cast("string"), F.lit("; ip="), F.concat_ws(".", *[pick(k, 256).cast("string") for k in (2, 3, 4, 5)])).alias("_msg"),
        F.concat(F.lit("host_"), pick(0, streams).cast("string")).alias("host"),
        pick(1, 8).cast("string").alias("worker_id"),
        F.lit("some value").alias("const_0"),
        F.concat(F.lit("value_"), i.cast("string")).alias("var_0"),
        F.element_at(F.array(*[F.lit(x) for x in "debug info warn error fatal ERROR FATAL INFO".split()]), (pick(6, 8) + 1).cast("int")).alias("dict_0"),
        pick(7, 256).alias("u8_0"),
        pick(8, 65536).alias("u16_0"),
        pick(9, 2**32).alias("u32_0"),
        h.alias("i64_0"),
        (pick(10, 10**6) / 1000.0).alias("float_0"),
        F.concat_ws(".", *[pick(k, 256).cast("string") for k in (11, 12, 13, 14)]).alias("ip_0"),
        F.date_format(F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + i * 1000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp_0"),
        F.to_json(F.struct(F.concat(F.lit("k"), pick(15, 5).cast("string")).alias("foo"), pick(16, 100).alias("bar"))).alias("json_0"),
    )
