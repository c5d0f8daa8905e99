"""The driver's tables in the roles of sensor data, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor rows: user_id is the session, t (ms) the time, event_type the channel, value the reading, k a second coordinate."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("event_id", "user_id", "event_type", "value", F.floor(us / 1000).alias("t"), F.get_json_object("props", "$.k").cast("int").alias("k"))


#: A WITH clause that gives the same rows in DuckDB.
EV = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS t, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense samples for grids: session = supplier group, x = quantity (m), y = discount (percent), value = price in hundreds."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_suppkey") % 4).alias("session"), (F.col("l_quantity") * 10).alias("x"), F.round(F.col("l_discount") * 1000, 3).alias("y"),
        (F.col("l_extendedprice") / 1000).alias("b"), "l_orderkey", "l_linenumber",
    )


SAMPLES = "smp AS (SELECT l_suppkey % 4 AS session, l_quantity * 10 AS x, round(l_discount * 1000, 3) AS y, l_extendedprice / 1000 AS b, l_orderkey, l_linenumber FROM lineitem)"


def r6(c):
    """Rounded to 6 places, so that sums in another order are equal."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode (tests) and an error elsewhere."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    return "file://" + tempfile.mkdtemp(prefix="lodepath-")
