"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodepath.llm.common import cut, drop


def component_table(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b), root being the smallest vertex of its component.

    Both columns are bigint; loops, repeated and reversed edges do no harm; nulls are left out. An empty
    table gives an empty table. Every round is a pre-aggregated minimum by vertex and a join; nothing comes
    to the driver but a count and a checksum, and each round, and the result, is written to the shared folder; drop() it after use.
    """
    now = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m"))
        .distinct()
    )
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(v, m) as decimal(38, 0)))")).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
        both = now.unionAll(now.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("low"))
        large = (
            both.join(least, "v").where("m > v").select(F.col("m").alias("v"), F.least("low", "v").alias("m")).where("v <> m").distinct()
        )
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        star = large.join(low, "v")
        after = cut(
            star.where("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))
            .unionAll(low.select("v", F.col("low").alias("m")))
            .distinct()
        )
        drop(now)
        now = after
    out = cut(now.select("v", F.col("m").alias("root")).unionAll(now.select(F.col("m").alias("v"), F.col("m").alias("root")).distinct()))
    drop(now)
    return out
