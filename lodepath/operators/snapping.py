"""Places snapped to aisles, and many places put into a graph of aisles at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodepath.functions import scalars as sc
from lodepath.operators.graphs import checkpointed
from lodepath.operators.sequences import carried
from lodepath.operators.spatial import dealt, hashed, line_cells

LINE = ("ax", "ay", "bx", "by")


def widest(*frames: DataFrame) -> float:
    """The diagonal of the box around all x, y of the frames; 0 for none."""
    points = None
    for f in frames:
        p = f.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        points = p if points is None else points.unionAll(p)
    r = points.agg(*[f(c) for c in ("x", "y") for f in (F.min, F.max)]).first()
    return math.hypot(r[1] - r[0], r[3] - r[2]) if r[0] is not None else 0.0


def tips(lines: DataFrame) -> DataFrame:
    return lines.select(F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p")).select("p.x", "p.y")


def foot(x: Column, y: Column) -> Column:
    """How far along a line (0 to 1) the nearest place to (x, y) is."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((x - F.col("ax")) * dx + (y - F.col("ay")) * dy, dx * dx + dy * dy))), F.lit(0.0))


def different(points: DataFrame) -> DataFrame:
    """The places (x, y) of points, each once, with a number `_p`, over all cores."""
    each = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null").distinct()
    return checkpointed(dealt(each, "x", "y").withColumn("_p", F.monotonically_increasing_id()))


def unlike(lines: DataFrame, lid: str) -> DataFrame:
    """Of lines between the same ends the one of the smallest id: it wins all ties against the others."""
    each = lines.select(lid, *[F.col(c).cast("double").alias(c) for c in LINE]).where("ax + ay + bx + by is not null").groupBy(*LINE).agg(F.min(lid).alias(lid))
    return checkpointed(dealt(each, lid))


def nearest_line(points: DataFrame, lines: DataFrame, pid: str, lid: str, reach: float = 200.0) -> DataFrame:
    """pid, lid, t (along the line, 0 to 1), distance of the line nearest to each point, however far; ties to the smaller lid.

    Lines send themselves to the cells within a reach; places that find none look again with twice the reach. The more lines there
    are, the shorter is the first reach. Points on one place look once, and lines between the same ends are one."""
    lines, rest = unlike(lines, lid), different(points)
    far, out = widest(rest, tips(lines)), None
    reach = max(reach / 64, min(reach, 2 * far / math.sqrt(lines.count() or 1)))
    places = rest
    while True:
        near = line_cells(lines, F.lit(reach), reach).join(hashed(rest, "x", "y", reach).withColumnsRenamed({"_gx": "_cx", "_gy": "_cy"}), ["_cx", "_cy"])
        near = near.withColumn("distance", sc.segment_distance(F.col("x"), F.col("y"), *map(F.col, LINE))).where(F.col("distance") <= reach)
        best = near.groupBy("_p").agg(F.min(F.struct("distance", lid, foot(F.col("x"), F.col("y")).alias("t"))).alias("b"))
        best = checkpointed(best.select("_p", f"b.{lid}", "b.t", "b.distance"))
        out = best if out is None else out.unionAll(best)
        rest = checkpointed(rest.join(best.select("_p"), "_p", "left_anti"))
        if reach > far or rest.isEmpty():
            return points.select(pid, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(places.join(out, "_p"), ["x", "y"]).select(pid, lid, "t", "distance")
        reach *= 2


def first_hits(rays: DataFrame, lines: DataFrame, rid: str, lid: str, cell: float = 400.0) -> DataFrame:
    """rid, lid, distance: the line that a ray (x, y, dx, dy of unit length, reach) meets first; ties to the smaller lid.

    Rays go out a cell's side at first, shorter the more lines there are; those that met none go on four times as far, by cells as wide."""
    lines, rest, out = unlike(lines, lid), checkpointed(dealt(rays.select(rid, "x", "y", "dx", "dy", "reach"), rid)), None
    cell = max(cell / 64, min(cell, 2 * widest(tips(lines)) / math.sqrt(lines.count() or 1)))
    while True:
        go = F.least(F.col("reach"), F.lit(cell))
        r = line_cells(rest.withColumns({"ax": F.col("x"), "ay": F.col("y"), "bx": F.col("x") + F.col("dx") * go, "by": F.col("y") + F.col("dy") * go}), F.lit(0.0), cell).select(rid, "x", "y", "dx", "dy", go.alias("go"), "_cx", "_cy")
        both = r.join(line_cells(lines, F.lit(0.0), cell).select(lid, *LINE, "_cx", "_cy"), ["_cx", "_cy"]).withColumns({"ex": F.col("bx") - F.col("ax"), "ey": F.col("by") - F.col("ay")})
        across = F.col("dx") * F.col("ey") - F.col("dy") * F.col("ex")
        qx, qy = F.col("ax") - F.col("x"), F.col("ay") - F.col("y")
        t, u = F.try_divide(qx * F.col("ey") - qy * F.col("ex"), across), F.try_divide(qx * F.col("dy") - qy * F.col("dx"), across)
        hit = both.where(F.abs(across) > 1e-12 * F.greatest(F.hypot("ex", "ey"), F.lit(1.0))).withColumn("t", F.greatest(t, F.lit(0.0))).where((t >= -1e-9) & (u >= -1e-9) & (u <= 1 + 1e-9) & (t <= F.col("go")))
        best = checkpointed(hit.groupBy(rid).agg(F.min(F.struct(F.col("t").alias("distance"), lid)).alias("b")).select(rid, f"b.{lid}", "b.distance"))
        out = best if out is None else out.unionAll(best)
        rest = checkpointed(rest.where(F.col("reach") > cell).join(best.select(rid), rid, "left_anti"))
        if rest.isEmpty():
            return out
        cell *= 4


def snapped(points: DataFrame, shelves: DataFrame, aisles: DataFrame, margin: float = 30.0) -> DataFrame:
    """pid, aisle, x, y, t: where a shopper for each place stands. points: pid, x, y; shelves: shelf, x, y, w, h, turn; aisles: aisle, ax, ay, bx, by.

    A place on a shelf (grown by the margin; of several the smallest) belongs to the aisle that its long sides face: rays go out both ways
    along the short axis, and the first aisle met on the nearer side is it, even if one behind the shelf's end is nearer. Other places,
    and those whose rays meet nothing, go to the nearest aisle. The place on the aisle is the foot of the perpendicular. Points on one
    place are snapped once, and equal shelves are one."""
    pts = different(points)
    cell = 100.0
    s = shelves.where("w > 0 and h > 0").groupBy(F.col("x").alias("sx"), F.col("y").alias("sy"), "w", "h", F.radians("turn").alias("r")).agg(F.min("shelf").alias("shelf"))
    # numbers in the order of choice: the smallest shelf is a minimum of numbers
    s = checkpointed(s.orderBy(F.col("w") * F.col("h"), "shelf").withColumn("_n", F.monotonically_increasing_id()))
    ex, ey = (F.abs(f("r")) * (F.col("w") / 2 + margin) + F.abs(g("r")) * (F.col("h") / 2 + margin) for f, g in ((F.cos, F.sin), (F.sin, F.cos)))
    span = lambda c, e: F.sequence(F.floor((F.col(c) - e) / cell), F.floor((F.col(c) + e) / cell))
    box = dealt(s, "_n").withColumns({"_c": F.cos("r"), "_s": F.sin("r"), "_w": F.col("w") / 2 + margin, "_h": F.col("h") / 2 + margin}).withColumn("_gx", F.explode(span("sx", ex))).withColumn("_gy", F.explode(span("sy", ey))).drop("shelf", "w", "h", "r")
    on = hashed(pts, "x", "y", cell).join(box, ["_gx", "_gy"])
    u, v = (F.expr("(x - sx) * _c + (y - sy) * _s"), F.expr("-(x - sx) * _s + (y - sy) * _c"))
    on = on.where((F.abs(u) <= F.col("_w")) & (F.abs(v) <= F.col("_h")))
    on = on.groupBy("_p", "x", "y").agg(F.min("_n").alias("_n")).join(s, "_n").select("_p", "x", "y", "w", "h", "r")
    wide = F.col("w") >= F.col("h")
    nx, ny = F.when(wide, -F.sin("r")).otherwise(F.cos("r")), F.when(wide, F.cos("r")).otherwise(F.sin("r"))
    far = widest(pts, tips(aisles)) + 1
    both = F.explode(F.array(F.lit(1.0), F.lit(-1.0)))
    rays = on.select("_p", "x", "y", nx.alias("nx"), ny.alias("ny")).withColumn("side", both).select(F.struct("_p", "side").alias("ray"), "x", "y", (F.col("nx") * F.col("side")).alias("dx"), (F.col("ny") * F.col("side")).alias("dy"), F.lit(far).alias("reach"))
    hit = first_hits(rays, aisles, "ray", "aisle").groupBy(F.col("ray._p").alias("_p")).agg(F.min(F.struct("distance", (-F.col("ray.side")).alias("side"), "aisle")).alias("b")).select("_p", "b.aisle")
    faced = checkpointed(hit.join(pts, "_p").join(aisles, "aisle").withColumn("t", foot(F.col("x"), F.col("y"))).select("_p", "aisle", "t"))
    rest = nearest_line(pts.join(faced, "_p", "left_anti").withColumnRenamed("_p", "_q"), aisles, "_q", "aisle").select(F.col("_q").alias("_p"), "aisle", "t")
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("t")
    got = checkpointed(pts.join(faced.unionAll(rest), "_p").join(aisles, "aisle").select(F.col("x").alias("_x"), F.col("y").alias("_y"), "aisle", at("ax", "bx").alias("x"), at("ay", "by").alias("y"), "t"))
    return points.select("pid", F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y")).join(got, ["_x", "_y"]).select("pid", "aisle", "x", "y", "t")


def apart(places: DataFrame, tolerance: float) -> DataFrame:
    """edge, s of places along edges kept in order: each more than the tolerance behind the last one kept."""

    def fold(last, arrays):
        import numpy as np

        kept = []
        for s in arrays[0]:
            if last is None or s - last > tolerance:
                last = s
                kept.append(s)
        return last, {"s": np.array(kept, dtype=float)}

    return carried(places, ["edge"], ["s"], "s double", None, fold)


def inserted(points: DataFrame, nodes: DataFrame, edges: DataFrame, tolerance: float = 30.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places, nodes, edges) of a graph after all points (pid, x, y) are put into it: places are pid, node; new nodes are called `edge:part`.

    nodes: node string, x, y; edges: edge, a, b (nodes), ax, ay, bx, by. A point within the tolerance of a node is that node, and so is one
    whose foot on the nearest edge is. All other feet of an edge cut it in one step: they are kept in order along the edge, those within
    the tolerance of the one kept before are that node, and the edge becomes one edge a gap."""
    near = lambda p: hashed(p, "x", "y", tolerance)
    around = F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))

    def at_node(p: DataFrame) -> DataFrame:
        look = near(p).withColumn("_i", around).withColumn("_j", around).withColumns({"_gx": F.col("_gx") + F.col("_i"), "_gy": F.col("_gy") + F.col("_j")}).drop("_i", "_j")
        n = hashed(nodes.groupBy("x", "y").agg(F.min("node").alias("node")), "x", "y", tolerance).select("_gx", "_gy", "node", F.col("x").alias("nx"), F.col("y").alias("ny"))
        d = F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny"))
        return look.join(n, ["_gx", "_gy"]).withColumn("_d", d).where(F.col("_d") <= tolerance).groupBy("pid").agg(F.min(F.struct("_d", "node")).alias("b")).select("pid", "b.node")

    pts = points.select("pid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    first = checkpointed(at_node(pts))
    line = edges.select("edge", *LINE)
    feet = nearest_line(pts.join(first, "pid", "left_anti"), line, "pid", "edge").join(line, "edge")
    place = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("t")
    feet = checkpointed(feet.select("pid", "edge", place("ax", "bx").alias("x"), place("ay", "by").alias("y"), (F.col("t") * F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("s")))
    second = checkpointed(at_node(feet))
    feet = feet.join(second, "pid", "left_anti")
    kept = checkpointed(apart(feet.select("edge", "s").distinct(), tolerance).join(feet.groupBy("edge", "s").agg(F.first("x").alias("x"), F.first("y").alias("y")), ["edge", "s"]))
    order = Window.partitionBy("edge").orderBy("s")
    kept = kept.withColumn("node", F.concat(F.col("edge").cast("string"), F.lit(":"), F.row_number().over(order)))
    steps = feet.select("pid", "edge", "s", F.lit(None).cast("string").alias("node")).unionAll(kept.select(F.lit(None).cast(dict(points.dtypes)["pid"]).alias("pid"), "edge", "s", "node"))
    third = steps.withColumn("node", F.last("node", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))).where("pid is not null").select("pid", "node")
    cuts = kept.select("edge", "s", "node", "x", "y").unionAll(edges.join(kept.select("edge").distinct(), "edge", "left_semi").select("edge", F.explode(F.array(F.struct(F.lit(-1.0).alias("s"), F.col("a").alias("node"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.lit(1e300).alias("s"), F.col("b").alias("node"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("e")).select("edge", "e.*"))
    lead = lambda c: F.lead(c).over(order)
    parts = cuts.select(F.concat(F.col("edge").cast("string"), F.lit("/"), F.row_number().over(order)).alias("edge"), F.col("node").alias("a"), lead("node").alias("b"), F.col("x").alias("ax"), F.col("y").alias("ay"), lead("x").alias("bx"), lead("y").alias("by")).where("b is not null")
    whole = edges.join(kept.select("edge").distinct(), "edge", "left_anti").select(F.col("edge").cast("string").alias("edge"), "a", "b", *LINE)
    return first.unionAll(second).unionAll(third), nodes.select("node", "x", "y").unionAll(kept.select("node", "x", "y")), whole.unionAll(parts)
