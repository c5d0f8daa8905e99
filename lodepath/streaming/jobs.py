"""Streaming jobs. The reference has no lateness rule; the watermarks here are an addition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HUB = "device string, recv timestamp, type string, t bigint, level string, cat string, msg string, mode string, x double, y double"


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).parquet(path)


def reading_rates(stream: DataFrame, time: str, channel: str, lateness: str = "10 seconds", size: str = "2 seconds", slide: str = "1 second") -> DataFrame:
    """Rows and distinct (approximate, as streams count) tags by sliding window and channel."""
    w = stream.withWatermark(time, lateness)
    return w.groupBy(F.window(time, size, slide), channel).agg(F.count("*").alias("n"), F.approx_count_distinct("tag").alias("tags"), F.avg("value").alias("mean"))


def latest(stream: DataFrame, key: str, time: str) -> DataFrame:
    """The newest row of each key (update or complete mode)."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*[c for c in stream.columns if c != key]), time).alias("last")).select(key, "last.*")


def once(stream: DataFrame, keys: list[str], time: str, lateness: str = "1 minute") -> DataFrame:
    """Rows without those sent again after a reconnect."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def write_chunks(stream: DataFrame, path: str, checkpoint: str, every: str = "30 seconds"):
    """Log lines as JSON by day and device, a file a trigger."""
    by_day = stream.where("type = 'log'").withColumn("day", F.date_format("recv", "yyyy-MM-dd"))
    return by_day.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day", "device").trigger(processingTime=every)


def run_to_end(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """All that is there, as a table in `folder` (a shared one), beside the stream's state.

    Waits until the stream has ended, however long it takes; if it fails, so does this. Each batch is a folder of its own by its
    number, so a batch that is run again replaces itself; in complete mode the last batch is the whole result. With the
    same folder a later call goes on where this one ended."""
    rows = f"{folder}/rows"

    def keep(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/batch={k}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    spark = stream.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(rows)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):  # no batch had a row
        return spark.createDataFrame([], stream.schema)
    got = spark.read.schema(StructType(stream.schema.fields).add("batch", "long")).parquet(rows)
    if mode == "complete":
        got = got.where(F.col("batch") == got.agg(F.max("batch")).first()[0])
    return got.drop("batch")
