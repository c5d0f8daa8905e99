"""Session plumbing shared by the corpus operators: tables, shared storage, workers' import path."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; its path may be one that only Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers that Spark starts on this host import the package (clusters use --py-files)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; one of our own where that is unset in local mode (tests), an error elsewhere."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="lodepath-")
        shared_dir.own = got
    return got.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended before; its folder goes with it
            return


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: the plan starts anew, and lost executors cost nothing.

    What was shuffled for it goes from the executors' disks at once, not only when the driver happens to collect its
    garbage. The files go when the driver's Python process ends."""
    spark = df.sparkSession
    if not _written:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/lodepath-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes what cut() wrote for df, once no later plan reads it."""
    for path in df.inputFiles()[:1]:
        top = path.rsplit("/", 1)[0]
        if "/lodepath-" in top:
            spark = df.sparkSession
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def hold_out(key: str, mod: int, remainder: int):
    """True for rows whose crc32(key as text) leaves that remainder."""
    return (F.crc32(F.col(key).cast("string")) % mod == remainder)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
