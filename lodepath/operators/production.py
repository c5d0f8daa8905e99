"""The production map: sessions are aligned in level, checked against each other, and fused, as a job whose stages can be resumed.

solved_offsets() finds each session's level from what pairs of sessions measured in the same cells: a weighted least-squares
problem over a graph of sessions. It is solved where the edges lie, by conjugate gradients: a round is one join of the edges with the
search direction and two sums by component, so no matrix is built and nothing but the largest residual comes to the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodepath.operators import alignment, fusion
from lodepath.operators.graphs import checkpointed, components

#: Cells of a strong edge, of a weak one, its widest deviation and its weight.
STRONG, WEAK, WEAK_MAD, WEAK_WEIGHT = 20, 4, 4.0, 0.5


def labelled(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, root) of all vertices (v) under edges (a, b): those without an edge are their own root."""
    root = components(edges)
    return vertices.join(root, "v", "left").select("v", F.coalesce("root", "v").alias("root"))


def used_edges(links: DataFrame, vertices: DataFrame) -> DataFrame:
    """(a, b, med, w) of links (a, b, n, med, mad): strong ones, and weak ones that join different strong components."""
    strong = links.where(F.col("n") >= STRONG)
    base = checkpointed(labelled(strong, vertices))
    weak = links.where((F.col("n") >= WEAK) & (F.col("n") < STRONG) & (F.col("mad") <= WEAK_MAD))
    weak = weak.join(base.select(F.col("v").alias("a"), F.col("root").alias("_ra")), "a").join(base.select(F.col("v").alias("b"), F.col("root").alias("_rb")), "b").where("_ra <> _rb")
    w = F.sqrt(F.col("n"))
    return strong.select("a", "b", "med", w.alias("w")).unionAll(weak.select("a", "b", "med", (WEAK_WEIGHT * w).alias("w")))


def conjugate_gradients(edges: DataFrame, nodes: DataFrame, tolerance: float = 1e-10, most_rounds: int | None = None) -> DataFrame:
    """(v, component, x) with the least sum of w^2 (x_b - x_a - med)^2 over edges (a, b, med, w), and x = 0 where nodes (v, component, fixed) are fixed.

    All components are solved side by side, each with its own step length, preconditioned by the diagonal. Ends when every
    component's residual is below the tolerance of its first one, and raises if that takes more than most_rounds (twice the nodes at least by
    default, where exact arithmetic needs no more than once the nodes)."""
    e = edges.where("a <> b").select("a", "b", "med", (F.col("w") * F.col("w")).alias("w2"))
    both = checkpointed(e.select(F.col("a").alias("v"), F.col("b").alias("o"), "w2", (-F.col("med") * F.col("w2")).alias("pull")).unionAll(e.select(F.col("b").alias("v"), F.col("a").alias("o"), "w2", (F.col("med") * F.col("w2")).alias("pull"))))
    start = nodes.where("not fixed").join(both.groupBy("v").agg(F.sum("w2").alias("diag"), F.sum("pull").alias("r")), "v")
    now = checkpointed(start.select("v", "component", "diag", F.lit(0.0).alias("x"), "r", (F.col("r") / F.col("diag")).alias("p")))
    links = checkpointed(both.select("v", "o", "w2"))
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    first = checkpointed(now.groupBy("component").agg(F.sum(F.col("r") * F.col("r") / F.col("diag")).alias("rz0")))
    rounds = most_rounds or 2 * now.count() + 20
    for k in range(rounds + 1):
        near = links.join(now.select(F.col("v").alias("o"), F.col("p").alias("_po")), "o").groupBy("v").agg(F.sum(F.col("w2") * F.col("_po")).alias("_s"))
        step = now.join(near, "v", "left").withColumn("ap", F.col("diag") * F.col("p") - F.coalesce("_s", F.lit(0.0)))
        step = checkpointed(step)
        sums = step.groupBy("component").agg(F.sum(F.col("r") * F.col("r") / F.col("diag")).alias("rz"), dot("p", "ap").alias("pap")).join(first, "component")
        if not sums.where((F.col("rz") > tolerance * tolerance * F.col("rz0")) & (F.col("pap") > 0)).limit(1).count():
            break
        if k == rounds:
            raise RuntimeError(f"not settled after {rounds} rounds")
        alpha = F.coalesce(F.try_divide("rz", "pap"), F.lit(0.0))
        step = step.join(sums.select("component", "rz", alpha.alias("alpha")), "component").withColumns({"x": F.col("x") + F.col("alpha") * F.col("p"), "r": F.col("r") - F.col("alpha") * F.col("ap")})
        after = step.groupBy("component").agg(F.try_divide(F.sum(F.col("r") * F.col("r") / F.col("diag")), F.first("rz")).alias("beta"))
        step = step.join(after, "component").withColumn("p", F.col("r") / F.col("diag") + F.coalesce("beta", F.lit(0.0)) * F.col("p"))
        now = checkpointed(step.select("v", "component", "diag", "x", "r", "p"))
    return nodes.join(now.select("v", "x"), "v", "left").select("v", "component", F.coalesce("x", F.lit(0.0)).alias("x"))


def solved_offsets(cells: DataFrame, session: str, cell: list[str], value: str) -> DataFrame:
    """(session, component, offset) of cells (session, cell, value), one row a session and cell.

    Components are numbered from 0 by their number of cells, the largest first; the session of most cells in each has offset 0.
    Sessions that share too few cells with others are components of their own. Offsets are what to take from a session's values."""
    from pyspark.sql import Window

    sizes = checkpointed(cells.groupBy(F.col(session).alias("v")).agg(F.count("*").alias("size")))
    links = checkpointed(fusion.edges(cells, session, cell, value))
    used = checkpointed(used_edges(links, sizes.select("v")))
    root = labelled(used, sizes.select("v")).join(sizes, "v")
    order = root.groupBy("root").agg(F.sum("size").alias("total"), F.min("v").alias("first"))
    rank = order.withColumn("component", (F.row_number().over(Window.orderBy(F.desc("total"), "first")) - 1).cast("int")).select("root", "component")
    fixed = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("size"), "v")) == 1
    nodes = checkpointed(root.join(rank, "root").withColumn("fixed", fixed).select("v", "component", "fixed"))
    x = conjugate_gradients(used, nodes)
    return x.select(F.col("v").alias(session), "component", F.col("x").alias("offset"))


class Job:
    """Stages written to a shared folder, each once: a job that was stopped goes on behind its last whole stage.

    A stage is known by its name, its parameters and the stages before it, so changed parameters don't meet old results. Spark's writer commits a
    stage's folder as a whole (its _SUCCESS file), and `manifest` lists the stages with their rows."""

    def __init__(self, spark: SparkSession, folder: str, inputs: str):
        self.spark, self.folder, self.mark, self.manifest = spark, folder.rstrip("/"), inputs, []

    def there(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def stage(self, name: str, make: Callable[[], DataFrame], **parameters) -> DataFrame:
        self.mark = hashlib.sha256(json.dumps([self.mark, name, parameters], sort_keys=True).encode()).hexdigest()
        path = f"{self.folder}/{name}-{self.mark[:16]}"
        fresh = not self.there(path)
        if fresh:
            make().write.mode("overwrite").parquet(path)
        self.manifest.append({"stage": name, "path": path, "resumed": not fresh, "parameters": parameters})
        return self.spark.read.parquet(path)


def gridded(samples: DataFrame, cell: float) -> DataFrame:
    """(session, row, col, n, mean, m2) of samples (session, x, y, value)."""
    at = samples.where("value is not null").select("session", F.floor(F.col("y") / cell).alias("row"), F.floor(F.col("x") / cell).alias("col"), F.col("value").cast("double").alias("value"))
    one = at.groupBy("session", "row", "col").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.var_pop("value") * F.count("*"), F.lit(0.0)).alias("m2"))
    return one


def others_error(samples: DataFrame, cells: DataFrame, cell: float) -> DataFrame:
    """samples with `error`: how far a value is from what all other sessions measured in its cell; null where none did.

    The others' mean is the whole cell's sum without the session's own, so no pairs of sessions are made."""
    whole = cells.groupBy("row", "col").agg(F.sum(F.col("n") * F.col("mean")).alias("_s"), F.sum("n").alias("_n"))
    own = cells.select("session", "row", "col", (F.col("n") * F.col("mean")).alias("_os"), F.col("n").alias("_on"))
    rest = own.join(whole, ["row", "col"]).where("_n > _on").select("session", "row", "col", ((F.col("_s") - F.col("_os")) / (F.col("_n") - F.col("_on"))).alias("_others"))
    s = samples.withColumn("row", F.floor(F.col("y") / cell)).withColumn("col", F.floor(F.col("x") / cell))
    return s.join(rest, ["session", "row", "col"], "left").withColumn("error", F.abs(F.col("value") - F.col("_others"))).drop("_others", "row", "col")


def production(spark: SparkSession, samples: DataFrame, folder: str, inputs: str, cell: float = 50.0, window_ms: int = 10_000, most_error: float = 8.0, reject_share: float = 0.5) -> tuple[dict[str, DataFrame], list[dict]]:
    """({'offsets', 'verdicts', 'field', 'excluded'}, manifest) of samples (session, t, x, y, value): fuse, check, fuse again, keep the main component.

    1. Sessions are gridded and their levels aligned. 2. Windows of a session whose values lie far from what the others measured are
    dropped with one window on each side; sessions that lose more than reject_share are left out. 3. What is left is gridded and
    aligned anew. 4. The field is that of component 0; sessions of others are `excluded`. `inputs` names the samples (say, path and version): with the same name and
    folder a stopped job is resumed. Samples lacking a session, time, place or value are left out."""
    job = Job(spark, folder, inputs)
    whole = samples.where("session is not null and t is not null and x is not null and y is not null and value is not null").select("session", F.col("t").cast("bigint").alias("t"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "value")])
    level = lambda s, o: s.join(o.select("session", "offset"), "session").withColumn("value", F.col("value") - F.col("offset")).drop("offset")
    cells = job.stage("cells", lambda: gridded(whole, cell), cell=cell)
    first = job.stage("levels", lambda: solved_offsets(cells, "session", ["row", "col"], "mean"))
    flat = level(whole, first)
    checked = job.stage("errors", lambda: others_error(flat, gridded(flat, cell), cell).select("session", "t", "error"))
    gate = lambda: fusion.quality_gate(checked, ["session"], "t", "error", window_ms, most_error, 1, reject_share)
    spans = job.stage("spans", lambda: gate()[0], window_ms=window_ms, most_error=most_error)
    verdicts = job.stage("verdicts", lambda: gate()[1], reject_share=reject_share)
    good = whole.join(verdicts.where("kept").select("session"), "session")
    kept = job.stage("kept", lambda: alignment.within(good, spans.select("session", F.col("start_ms").alias("s0"), (F.col("end_ms") - 1).alias("s1")), ["session"], "t", "s0", "s1", window_ms, "left_anti"))
    cells2 = job.stage("cells_kept", lambda: gridded(kept, cell))
    offsets = job.stage("offsets", lambda: solved_offsets(cells2, "session", ["row", "col"], "mean"))
    main = offsets.where("component = 0")
    fused = level(kept.select("session", "t", "x", "y", "value"), main).withColumn("session", F.lit(0))
    field = job.stage("field", lambda: gridded(fused, cell).drop("session"))
    return {"offsets": offsets, "verdicts": verdicts, "field": field, "excluded": offsets.where("component > 0").select("session")}, job.manifest
