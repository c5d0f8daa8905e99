"""State that grows with a stream and can be resumed: tables that are folded batch by batch, each batch exactly once.

After batch k every table is in a folder `after=k`, written as a whole from the one before and the batch. A batch that is run
again (its number was not yet committed) finds its folders there, or writes them anew from the one before, which is kept until the next
batch is done. So whenever the stream is stopped, the state is that of a whole number of batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodepath.operators import grids

#: For a table: what a batch adds, and how rows of the table and of what is added become the table.
Fold = tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        """Batches after which the table is there as a whole."""
        top = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(top):
            return []
        found = [s.getPath() for s in self._fs.listStatus(top)]
        return sorted(int(p.getName().removeprefix("after=")) for p in found if p.getName().startswith("after=") and self._fs.exists(self._path(f"{p}/_SUCCESS")))

    def table(self, name: str) -> DataFrame | None:
        """The newest whole version."""
        seen = self.versions(name)
        return self.spark.read.parquet(f"{self.folder}/{name}/after={seen[-1]}") if seen else None

    def apply(self, batch: DataFrame, k: int, folds: dict[str, Fold]) -> None:
        for name, (part, merge) in folds.items():
            seen = self.versions(name)
            if k in seen:
                continue
            before = [v for v in seen if v < k]
            rows = part(batch)
            if before:
                rows = self.spark.read.parquet(f"{self.folder}/{name}/after={before[-1]}").unionByName(rows)
            merge(rows).write.mode("overwrite").parquet(f"{self.folder}/{name}/after={k}")
            for old in before[:-1]:
                self._fs.delete(self._path(f"{self.folder}/{name}/after={old}"), True)


def run(stream: DataFrame, ledger: Ledger, checkpoint: str, folds: dict[str, Fold]):
    """Folds all that is there and waits for it."""
    q = stream.writeStream.foreachBatch(lambda batch, k: ledger.apply(batch, k, folds)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def map_state(cell: float) -> dict[str, Fold]:
    """What a map is built from, of samples (session, x, y, value, tag, rssi): its grid, where tags were heard, and its sessions.

    Sums of tags are kept as (n, weight, weighted x and y), weight being 10 ** (rssi / 20)."""
    from pyspark.sql import functions as F

    at = lambda b: b.where("value is not null").withColumns({"row": F.floor(F.col("y") / cell), "col": F.floor(F.col("x") / cell)})
    weight = F.pow(F.lit(10.0), F.col("rssi") / 20)
    heard = lambda b: b.where("tag is not null and rssi < 0").withColumn("w", weight).groupBy("tag").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum(F.col("w") * F.col("y")).alias("wy"))
    return {
        "grid": (lambda b: grids.aggregate(at(b), ["row", "col"], ["value"]), lambda rows: grids.merge(rows, ["row", "col"], ["value"])),
        "tags": (heard, lambda rows: rows.groupBy("tag").agg(*[F.sum(c).alias(c) for c in ("n", "w", "wx", "wy")])),
        "sessions": (lambda b: b.where("session is not null").select("session").distinct(), lambda rows: rows.distinct()),
    }
