"""Survey zones: corridors cut to pieces and dealt to zones that one walk covers, how far each is, and where to go next."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodepath.functions import scalars as sc
from lodepath.operators.graphs import checkpointed
from lodepath.operators.spatial import hashed, line_cells


def lanes(corridors: DataFrame, radius: float = 40.0, wide: float = 100.0) -> DataFrame:
    """map, corridor, side, ax, ay, bx, by of the lines to walk: both sides of a wide corridor (and the middle of a very wide one), else the middle.

    corridors: map, corridor, ax, ay, bx, by, width; those of 150 cm or less, or narrower than 50 cm, have none."""
    c = corridors.withColumn("len", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).where("len > 150 and width >= 50")
    off = F.col("width") / 2 - radius
    lane = lambda o, side: F.struct(o.cast("double").alias("o"), F.lit(side).alias("side"))
    middle, both = lane(F.lit(0.0), 0), [lane(off, 1), lane(-off, -1)]
    every = F.when(F.col("width") > 4 * radius, F.array(*both, middle)).otherwise(F.array(*both))
    c = c.withColumn("_l", F.explode(F.when(F.col("width") > wide, every).otherwise(F.array(middle))))
    nx, ny = -(F.col("by") - F.col("ay")) / F.col("len") * F.col("_l.o"), (F.col("bx") - F.col("ax")) / F.col("len") * F.col("_l.o")
    return c.select("map", "corridor", F.col("_l.side").alias("side"), (F.col("ax") + nx).alias("ax"), (F.col("ay") + ny).alias("ay"), (F.col("bx") + nx).alias("bx"), (F.col("by") + ny).alias("by"))


def pieces(corridors: DataFrame, radius: float = 40.0, piece: float = 1500.0) -> DataFrame:
    """map, corridor, k, t0, t1, ax, ay, bx, by, cx, cy, w: corridors with lanes in equal pieces of at most `piece`.

    w is the length of a piece's lanes in whole thousandths of a cm, so that sums don't depend on their order."""
    n_lanes = lanes(corridors, radius).groupBy("map", "corridor").agg(F.count("*").alias("nl"))
    n = F.greatest(F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / piece), F.lit(1)).cast("int")
    p = corridors.join(n_lanes, ["map", "corridor"]).withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    p = p.withColumns({"t0": F.col("k") / F.col("n"), "t1": (F.col("k") + 1) / F.col("n"), "w": F.round(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / F.col("n") * F.col("nl") * 1000).cast("bigint")})
    at = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * F.col(t)
    p = p.withColumns({"px": at("ax", "bx", "t0"), "py": at("ay", "by", "t0"), "qx": at("ax", "bx", "t1"), "qy": at("ay", "by", "t1")})
    return p.select("map", "corridor", "k", "t0", "t1", F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("qx").alias("bx"), F.col("qy").alias("by"), ((F.col("px") + F.col("qx")) / 2).alias("cx"), ((F.col("py") + F.col("qy")) / 2).alias("cy"), "w")


def zoned(pieces: DataFrame, target: float = 120_000.0) -> DataFrame:
    """pieces with `zone`: halves of halves by length of lanes, until none is much over the target; zones are numbered 1, 2, ... by rows of 10 m, then by x.

    All zones of all maps are halved in one step: sizes and spans by a grouped sum, the cut by a running sum along the
    longer span (a sorted window, which need not fit in memory). There are as many steps as the deepest map has levels."""
    rows = checkpointed(pieces.withColumn("path", F.lit("")))
    key = ["map", "path"]
    while True:
        size = rows.groupBy(*key).agg(F.sum("w").alias("total"), F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(f"s{c}") for c in ("cx", "cy")])
        size = checkpointed(size.where((F.col("total") > target * 1.15 * 1000) & (F.col("n") > 1)))
        if size.isEmpty():
            break
        parts = F.ceil(F.col("total") / (target * 1000))
        big = rows.join(size, key).withColumn("_at", F.when(F.col("scx") >= F.col("scy"), F.col("cx")).otherwise(F.col("cy")))
        order = Window.partitionBy(*key).orderBy("_at", "corridor", "k")
        big = big.withColumn("_sum", F.sum("w").over(order)).withColumn("_i", F.row_number().over(order))
        far = F.min(F.when(F.col("_sum") >= F.col("total") * F.floor(parts / 2) / parts, F.col("_i"))).over(Window.partitionBy(*key))
        cut = F.greatest(F.lit(1), F.least(F.coalesce(far, F.lit(1)), F.col("n") - 1))
        halved = big.withColumn("path", F.concat("path", F.when(F.col("_i") <= cut, "0").otherwise("1"))).select(rows.columns)
        rows = checkpointed(rows.join(size, key, "left_anti").select(rows.columns).unionAll(halved))
    order = Window.partitionBy("map").orderBy((F.col("y") / 1000).cast("bigint"), "x", "path")
    mean = lambda c: F.sum(F.col(c) * F.col("w")) / F.greatest(F.sum("w"), F.lit(1000))
    number = rows.groupBy(*key).agg(mean("cx").alias("x"), mean("cy").alias("y")).withColumn("zone", F.row_number().over(order)).select(*key, "zone")
    return rows.join(number, key).drop("path")


def zone_table(zoned: DataFrame) -> DataFrame:
    """map, zone, n_pieces, lane_cm, x, y (its middle, by length of lanes)."""
    mean = lambda c: F.sum(F.col(c) * F.col("w")) / F.greatest(F.sum("w"), F.lit(1000))
    return zoned.groupBy("map", "zone").agg(F.count("*").alias("n_pieces"), (F.sum("w") / 1000).alias("lane_cm"), mean("cx").alias("x"), mean("cy").alias("y"))


def status(zoned: DataFrame, lanes: DataFrame, cells: DataFrame, cell: float, done: float = 0.85) -> DataFrame:
    """map, zone, total, remaining (cm of lanes), fraction, done. cells: map, row, col, passes of the cells that are to be painted.

    Lanes are cut as the pieces are; each has a sample every 50 cm, of which those in cells without a pass remain."""
    at = lambda a, b, t: F.col(f"l.{a}") + (F.col(f"l.{b}") - F.col(f"l.{a}")) * F.col(t)
    l = zoned.select("map", "corridor", "zone", "k", "t0", "t1").join(lanes.alias("l"), ["map", "corridor"])
    l = l.select("map", "zone", "corridor", "k", "side", *[at(f"a{c}", f"b{c}", t).alias(f"{p}{c}") for c in "xy" for p, t in (("p", "t0"), ("q", "t1"))])
    l = l.withColumn("len", F.hypot(F.col("qx") - F.col("px"), F.col("qy") - F.col("py"))).withColumn("n", F.greatest((F.col("len") / 50).cast("int"), F.lit(1)))
    s = l.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n")))).withColumn("t", F.col("i") / F.col("n"))
    s = s.withColumns({"x": F.col("px") + (F.col("qx") - F.col("px")) * F.col("t"), "y": F.col("py") + (F.col("qy") - F.col("py")) * F.col("t")})
    s = s.select("map", "zone", "len", "n", (F.col("x") / cell).cast("bigint").alias("col"), (F.col("y") / cell).cast("bigint").alias("row"))
    free = cells.where("passes = 0").select("map", "row", "col")
    left = s.join(free, ["map", "row", "col"]).groupBy("map", "zone").agg(F.sum(F.col("len") / (F.col("n") + 1)).alias("remaining"))
    out = l.groupBy("map", "zone").agg(F.sum("len").alias("total")).join(left, ["map", "zone"], "left").withColumn("remaining", F.coalesce("remaining", F.lit(0.0)))
    out = out.withColumn("fraction", F.coalesce(1 - F.try_divide("remaining", "total"), F.lit(1.0)))
    return out.select("map", "zone", "total", "remaining", "fraction", (F.col("fraction") >= done).alias("done"))


def entries(zoned: DataFrame, cells: DataFrame, cell: float, stride: int = 2) -> DataFrame:
    """map, zone, x, y, distance: of the painted cells (of every `stride`-th row and column) the one nearest to a zone; ties to the smaller row, then column.

    Zones look within a reach of their pieces by an equi-join of cells; those that found none look twice as far."""
    at = lambda c: (F.col(c) + 0.5) * cell
    sites = checkpointed(cells.where(f"passes > 0 and row % {stride} = 0 and col % {stride} = 0").select("map", "row", "col", at("col").alias("x"), at("row").alias("y")))
    rest = checkpointed(zoned.select("map", "zone", "ax", "ay", "bx", "by").join(sites.select("map").distinct(), "map", "left_semi"))
    c = ("x", "y")
    ends = [sites.select("map", *c)] + [rest.select("map", F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y")) for e in "ab"]
    span = ends[0].unionAll(ends[1]).unionAll(ends[2]).agg(*[f(k) for k in c for f in (F.min, F.max)]).first()
    widest, reach, out = math.hypot(span[1] - span[0], span[3] - span[2]) if span[0] is not None else 0.0, 8 * cell, None
    while True:
        near = line_cells(rest, F.lit(reach), reach).join(hashed(sites, "x", "y", reach).withColumnsRenamed({"_gx": "_cx", "_gy": "_cy"}), ["map", "_cx", "_cy"])
        d = sc.segment_distance(F.col("x"), F.col("y"), *[F.col(k) for k in ("ax", "ay", "bx", "by")])
        best = near.withColumn("distance", d).where(F.col("distance") <= reach).groupBy("map", "zone").agg(F.min(F.struct("distance", "row", "col", "x", "y")).alias("b"))
        best = checkpointed(best.select("map", "zone", "b.x", "b.y", "b.distance"))
        out = best if out is None else out.unionAll(best)
        rest = checkpointed(rest.join(best, ["map", "zone"], "left_anti"))
        if reach > widest or rest.isEmpty():
            return out
        reach *= 2


def next_zone(status: DataFrame, zones: DataFrame, entries: DataFrame, at: DataFrame, started: float = 0.15) -> DataFrame:
    """map, zone to survey next, null if all are done. at: map, x, y of the surveyor, where known.

    What has been started is finished first, the farthest along; else the nearest to what is painted (entries); where nothing is,
    the zone whose middle is nearest to the surveyor, or else the first."""
    todo = status.where("not done").join(zones.select("map", "zone", "x", "y"), ["map", "zone"]).join(entries.select("map", "zone", "distance"), ["map", "zone"], "left").join(at.select("map", F.col("x").alias("_x"), F.col("y").alias("_y")), "map", "left")
    begun = F.max(F.struct(F.when(F.col("fraction") >= started, F.col("fraction")).alias("f"), (-F.col("zone")).alias("z")))
    near = F.min(F.when(F.col("distance").isNotNull(), F.struct("distance", "zone")))
    here = F.min(F.when(F.col("_x").isNotNull(), F.struct(F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")).alias("d"), F.col("zone"))))
    got = todo.groupBy("map").agg(begun.alias("_b"), near.alias("_n"), here.alias("_h"), F.min("zone").alias("_f"))
    pick: Column = F.when(F.col("_b.f").isNotNull(), -F.col("_b.z")).otherwise(F.coalesce("_n.zone", "_h.zone", "_f"))
    return status.select("map").distinct().join(got.select("map", pick.alias("zone")), "map", "left")
