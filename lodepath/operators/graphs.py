"""Graph operators on edge tables."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(v, root) of every vertex of edges (a, b), of any type that has an order: least labels spread over edges, with a jump to the label's label each round.

    Ends when no label changes; raises if that takes more than most_rounds. Plans are cut by a reliable checkpoint each round, where a checkpoint folder is set."""
    both = edges.select("a", "b").unionAll(edges.select("b", "a")).distinct().persist()
    now = both.select(F.col("a").alias("v")).distinct().withColumn("root", F.col("v"))
    mark = None
    for k in count():
        if k == most_rounds:
            raise RuntimeError(f"not settled after {most_rounds} rounds")
        low = both.join(now, both.b == now.v).groupBy("a").agg(F.min("root").alias("low"))
        step = now.join(low, now.v == low.a, "left").select("v", F.least("root", F.coalesce("low", "root")).alias("root"))
        jump = step.select(F.col("v").alias("_v"), F.col("root").alias("_r"))
        after = step.join(jump, F.col("root") == F.col("_v"), "left").select("v", F.least("root", F.coalesce("_r", "root")).alias("root"))
        after = checkpointed(after)
        seen = after.agg(F.expr("sum(cast(xxhash64(v, root) as decimal(38, 0)))")).first()[0]
        now = after
        if seen == mark:
            break
        mark = seen
    both.unpersist()
    return now


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its plan cut: written to the checkpoint folder, which is made where none is set (local runs)."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="lodepath-"))
    return df.checkpoint()


def shortest_paths(edges: DataFrame, sources: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(src, v, dist) from every source over undirected edges (a, b, w): rounds of relaxation until nothing is shorter.

    Raises if that takes more than most_rounds, or if a weight is below 0 (distances would fall for ever)."""
    both = edges.select("a", "b", "w").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.min("w").alias("w")).persist()
    if both.where("w < 0").limit(1).count():
        raise ValueError("weights must not be below 0")
    now = sources.select("src", F.col("src").alias("v"), F.lit(0.0).alias("dist"))
    mark = None
    for k in count():
        if k == most_rounds:
            raise RuntimeError(f"not settled after {most_rounds} rounds")
        step = now.join(both, now.v == both.a).select("src", F.col("b").alias("v"), (F.col("dist") + F.col("w")).alias("dist"))
        now = checkpointed(now.unionAll(step).groupBy("src", "v").agg(F.min("dist").alias("dist")))
        seen = tuple(now.agg(F.count("*"), F.expr("sum(cast(xxhash64(src, v, dist) as decimal(38, 0)))")).first())
        if seen == mark:
            break
        mark = seen
    both.unpersist()
    return now


def node_merge(points: DataFrame, cell: float) -> DataFrame:
    """points (pid, x, y) with `node`: the least pid of those connected by steps of at most `cell`."""
    from lodepath.operators.spatial import pairs_within

    near = pairs_within(points, [], "pid", "x", "y", cell, []).select(F.col("a_pid").alias("a"), F.col("b_pid").alias("b"))
    root = components(near)
    return points.join(root, points.pid == root.v, "left").select("pid", "x", "y", F.coalesce("root", "pid").alias("node"))


def segment_graph(segments: DataFrame, sid: str, cell: float, tolerance: float) -> DataFrame:
    """Edges (segment, x1, y1, x2, y2, w) of segments cut at their ends and where others cross them."""
    from pyspark.sql import Window

    from lodepath.operators.spatial import crossings

    c = crossings(segments, sid, cell, tolerance)
    cuts = c.select(F.col("a").alias("segment"), "t").unionAll(c.select(F.col("b").alias("segment"), F.col("u").alias("t")))
    ends = segments.select(F.col(sid).alias("segment"), F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    all_cuts = cuts.unionAll(ends).join(segments.withColumnRenamed(sid, "segment"), "segment").withColumn("s", F.col("t") * F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    w = Window.partitionBy("segment").orderBy("s")
    apart = all_cuts.withColumn("_p", F.lag("s").over(w)).where(F.col("_p").isNull() | (F.col("s") - F.col("_p") > tolerance))
    at = apart.withColumn("x", F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax"))).withColumn("y", F.col("ay") + F.col("t") * (F.col("by") - F.col("ay")))
    nxt = at.select("segment", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"), F.col("s").alias("s1"), F.lead("s").over(w).alias("s2"))
    return nxt.where(F.col("x2").isNotNull()).select("segment", "x1", "y1", "x2", "y2", (F.col("s2") - F.col("s1")).alias("w"))
