"""Spatial joins by grid hashing: each point looks into its own cell and those around it, so that a distance join is an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodepath.functions import scalars as sc


def hashed(df: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    return df.withColumn("_gx", F.floor(F.col(x) / cell)).withColumn("_gy", F.floor(F.col(y) / cell))


def spread(df: DataFrame, x: str, y: str, cell: float, reach: int = 1) -> DataFrame:
    """df repeated for the (2 reach + 1)^2 cells around each point."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    out = hashed(df, x, y, cell).withColumn("_dx", F.explode(span)).withColumn("_dy", F.explode(span))
    return out.withColumn("_gx", F.col("_gx") + F.col("_dx")).withColumn("_gy", F.col("_gy") + F.col("_dy")).drop("_dx", "_dy")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over at least two tasks a core, by the keys: a small file is one task's, however much work its rows are."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def line_cells(df: DataFrame, reach: Column, cell: float) -> DataFrame:
    """df (ax, ay, bx, by) once for each cell (_cx, _cy) that comes within reach of the segment: cells of its steps, grown."""
    n = F.greatest(F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / cell), F.lit(1)).cast("int")
    r = F.ceil((reach + cell / 2) / cell).cast("int")
    span = F.sequence(-r, r)
    at = lambda a, b, t: F.floor((F.col(a) + (F.col(b) - F.col(a)) * t) / cell)
    steps = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(at("ax", "bx", k / n).alias("i"), at("ay", "by", k / n).alias("j")))
    grown = F.transform(steps, lambda p: F.flatten(F.transform(span, lambda u: F.transform(span, lambda v: (p["i"] + u) * 4294967296 + p["j"] + v))))  # one number a cell: distinct by hashes, not all against all
    low = F.pmod(F.col("_c") + 2147483648, F.lit(4294967296)) - 2147483648
    return df.withColumn("_c", F.explode(F.array_distinct(F.flatten(grown)))).withColumn("_cx", F.shiftright(F.col("_c") - low, 32)).withColumn("_cy", low).drop("_c")


def pairs_within(df: DataFrame, by: list[str], pid: str, x: str, y: str, radius: float, values: list[str], where: Column | None = None) -> DataFrame:
    """by and a_/b_ columns of pairs a < b (by pid) at most `radius` apart. `where` may use a_ and b_ columns."""
    cols = [pid, x, y, *values]
    a = spread(df, x, y, radius).select(*by, "_gx", "_gy", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = hashed(df, x, y, radius).select(*by, "_gx", "_gy", *[F.col(c).alias(f"b_{c}") for c in cols])
    near = F.hypot(F.col(f"a_{x}") - F.col(f"b_{x}"), F.col(f"a_{y}") - F.col(f"b_{y}")) <= radius
    out = a.join(b, [*by, "_gx", "_gy"]).where((F.col(f"a_{pid}") < F.col(f"b_{pid}")) & near)
    return (out if where is None else out.where(where)).drop("_gx", "_gy")


def revisits(df: DataFrame, by: list[str], time: str, x: str, y: str, value: str, radius: float, apart: float) -> DataFrame:
    """by, diff: |difference| of values of two visits within `radius` and at least `apart` in time."""
    out = pairs_within(df, by, time, x, y, radius, [value], F.col(f"b_{time}") - F.col(f"a_{time}") >= apart)
    return out.select(*by, F.col(f"a_{time}").alias("t_a"), F.col(f"b_{time}").alias("t_b"), F.abs(F.col(f"a_{value}") - F.col(f"b_{value}")).alias("diff"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over at least two tasks a core, by the keys: a small file is one task's, however much work its rows are."""
    n = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, *keys)


def nearest_places(px, py, sx, sy, radius: float, most: int = 1_000_000):
    """(site, distance) of the site nearest to each point within the radius, -1 for none; the later of equally near ones. Arrays; at most `most` pairs at once.

    Sites are sorted by cells that hold about one each. What lies within a cell's side is nearest for sure; points that found
    none so look again with cells of twice the side, up to the radius."""
    import numpy as np

    best, at = np.full(len(px), np.inf), np.full(len(px), -1)
    if not len(px) or not len(sx):
        return at, best
    x0, y0 = sx.min(), sy.min()
    cell = min(radius, max(radius / 4096, ((sx.max() - x0) * (sy.max() - y0) / len(sx)) ** 0.5))
    todo = np.arange(len(px))
    while len(todo):
        side = cell * (1 + 1e-9)
        iy = np.floor((sy - y0) / side).astype(np.int64)
        wide, top = iy.max() + 6, np.floor((sx.max() - x0) / side)
        key = np.floor((sx - x0) / side).astype(np.int64) * wide + iy + 2
        order = np.argsort(key, kind="stable")
        key = key[order]
        gx, gy = np.clip(np.floor((px[todo] - x0) / side), -2, top + 2).astype(np.int64), np.clip(np.floor((py[todo] - y0) / side), -2, iy.max() + 2).astype(np.int64)
        mid = ((gx[:, None] + np.array([-1, 0, 1])) * wide) + gy[:, None] + 2
        low, high = np.searchsorted(key, mid - 1, "left"), np.searchsorted(key, mid + 1, "right")
        n = (high - low).sum(axis=1)
        some = np.flatnonzero(n)
        ends = np.cumsum(n[some])
        k = 0
        while k < len(some):
            z = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most, "right")))
            one = some[k:z]
            m = (high[one] - low[one]).ravel()
            site = order[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[one].ravel(), m)]
            own, head = np.repeat(todo[one], n[one]), np.cumsum(n[one]) - n[one]
            d = np.sqrt((px[own] - sx[site]) ** 2 + (py[own] - sy[site]) ** 2)
            least = np.minimum.reduceat(d, head)
            best[todo[one]], at[todo[one]] = least, np.maximum.reduceat(np.where(d == np.repeat(least, n[one]), site, -1), head)
            k = z
        if cell >= radius:
            break
        todo = todo[best[todo] > cell]
        cell = min(2 * cell, radius)
    at[best > radius] = -1
    return at, best


def nearest(points: DataFrame, sites: DataFrame, by: list[str], pid: str, sid: str, x: str, y: str, radius: float, most: int = 200_000) -> DataFrame:
    """by, pid, sid, distance of each point's nearest site within the radius (ties to the larger sid); others left out. Rows of one pid are one point in several places.

    Of sites on one place the one of the largest sid counts. Points meet sites by squares of four radii: a point goes to one square, a site also to
    those it is within a radius of. Squares of more than about `most` points are cut into parts. A square's points look through its sites
    by cells as wide as the sites are apart there (nearest_places), so work grows little with how many sites are within the radius."""
    kinds = {f.name: f.dataType for f in points.schema.fields} | {sid: sites.schema[sid].dataType}
    schema = T.StructType([*[T.StructField(c, kinds[c]) for c in (*by, pid, sid)], T.StructField("distance", T.DoubleType())])
    whole = lambda df, c: df.select(*by, c, *[F.col(k).cast("double").alias(n) for k, n in ((x, "_x"), (y, "_y"))]).where(" and ".join(["abs(_x) < double('inf') and abs(_y) < double('inf')", *[f"`{k}` is not null" for k in by]]))
    square = 4 * radius
    p = hashed(whole(points, pid), "_x", "_y", square)
    fullest = p.groupBy(*by, "_gx", "_gy").count().agg(F.max("count")).first()[0] or 0
    parts = -(-fullest // most) or 1
    p = p.withColumn("_part", F.pmod(F.xxhash64(pid), F.lit(parts)).cast("int"))
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius * 1.001) / square), F.floor((F.col(c) + radius * 1.001) / square)))
    s = whole(sites, sid).groupBy(*by, "_x", "_y").agg(F.max(sid).alias("_sid"))
    s = s.withColumn("_gx", span("_x")).withColumn("_gy", span("_y")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        right = right.take(pc.sort_indices(right.column("_sid")))
        at, d = nearest_places(*[t.column(c).to_numpy() for t in (left, right) for c in ("_x", "_y")], radius)
        hit = pa.array((at >= 0).nonzero()[0])
        columns = [left.column(c).take(hit) for c in (*by, pid)]
        return pa.table([*columns, right.column("_sid").take(pa.array(at[at >= 0])), pa.array(d[at >= 0])], names=schema.names)

    keys = [*by, "_gx", "_gy", "_part"]
    got = p.groupBy(*keys).cogroup(s.groupBy(*keys)).applyInArrow(run, schema)
    return got.groupBy(*by, pid).agg(F.max(F.struct((-F.col("distance")).alias("d"), F.col(sid).alias("s"))).alias("_b")).select(*by, pid, F.col("_b.s").alias(sid), (-F.col("_b.d")).alias("distance"))


def contain(points: DataFrame, polygons: DataFrame, pid: str, x: str, y: str, ring: str, order: str, cell: float) -> DataFrame:
    """pid with the columns of the first polygon (by `order`) that holds the point: candidates by the cells of each bounding box."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    boxes = polygons.withColumn("_gx", F.explode(F.sequence(F.floor(F.array_min(xs) / cell), F.floor(F.array_max(xs) / cell))))
    boxes = boxes.withColumn("_gy", F.explode(F.sequence(F.floor(F.array_min(ys) / cell), F.floor(F.array_max(ys) / cell))))
    hit = hashed(points, x, y, cell).join(boxes, ["_gx", "_gy"]).where(sc.inside(F.col(ring), F.col(x), F.col(y)))
    return hit.groupBy(pid).agg(F.min_by(F.struct(*polygons.columns), order).alias("_p")).select(pid, "_p.*")


def nearest_segment(points: DataFrame, segments: DataFrame, pid: str, x: str, y: str, sid: str, reach: float, heading: str | None = None, gate: float | None = None) -> DataFrame:
    """pid, sid, distance of the nearest segment (ax, ay, bx, by) within `reach`; with a gate, of those whose line is within that angle of the heading."""
    cell = reach
    lo = lambda a, b: F.floor((F.least(a, b) - reach) / cell)
    hi = lambda a, b: F.floor((F.greatest(a, b) + reach) / cell)
    s = segments.withColumn("_gx", F.explode(F.sequence(lo("ax", "bx"), hi("ax", "bx")))).withColumn("_gy", F.explode(F.sequence(lo("ay", "by"), hi("ay", "by"))))
    both = hashed(points, x, y, cell).join(s, ["_gx", "_gy"]).withColumn("_d", sc.segment_distance(F.col(x), F.col(y), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    keep = F.col("_d") <= reach
    if gate is not None:
        keep = keep & (sc.line_angle(F.atan2(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")), F.col(heading)) <= gate)
    return both.where(keep).groupBy(pid).agg(F.min_by(sid, F.struct("_d", sid)).alias(sid), F.min("_d").alias("distance"))


def ray_hits(rays: DataFrame, segments: DataFrame, rid: str, cell: float) -> DataFrame:
    """rid, distance: the nearest segment (ax, ay, bx, by) that a ray (x, y, dx, dy of unit length, reach) meets within its reach.

    Rays are cut into points half a cell apart, which look for segments in their own cell and those around it."""
    r = rays.withColumn("_k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("reach") * 2 / cell).cast("int"))))
    r = r.withColumn("_px", F.col("x") + F.col("dx") * F.col("_k") * cell / 2).withColumn("_py", F.col("y") + F.col("dy") * F.col("_k") * cell / 2)
    r = spread(r, "_px", "_py", cell).select(rid, "x", "y", "dx", "dy", "reach", "_gx", "_gy").distinct()
    n = F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) * 2 / cell).cast("int")
    s = segments.withColumn("_n", F.greatest(n, F.lit(1))).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    s = s.withColumn("_gx", F.floor((F.col("ax") + (F.col("bx") - F.col("ax")) * F.col("_k") / F.col("_n")) / cell)).withColumn("_gy", F.floor((F.col("ay") + (F.col("by") - F.col("ay")) * F.col("_k") / F.col("_n")) / cell))
    s = s.select("ax", "ay", "bx", "by", "_gx", "_gy").distinct()
    ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    den = F.col("dx") * ey - F.col("dy") * ex
    t = F.try_divide((F.col("ax") - F.col("x")) * ey - (F.col("ay") - F.col("y")) * ex, den)
    u = F.try_divide((F.col("ax") - F.col("x")) * F.col("dy") - (F.col("ay") - F.col("y")) * F.col("dx"), den)
    return r.join(s, ["_gx", "_gy"]).withColumn("_den", den).where("abs(_den) > 1e-12").withColumn("_t", t).withColumn("_u", u).where("_t >= 0 and _t <= reach and _u >= 0 and _u <= 1").groupBy(rid).agg(F.min("_t").alias("distance"))


def crossings(segments: DataFrame, sid: str, cell: float, tolerance: float) -> DataFrame:
    """a, b, x, y: where two segments meet (or miss each other by at most the tolerance at an end), a < b."""
    lo = lambda a, b: F.floor((F.least(a, b) - tolerance) / cell)
    hi = lambda a, b: F.floor((F.greatest(a, b) + tolerance) / cell)
    s = segments.withColumn("_gx", F.explode(F.sequence(lo("ax", "bx"), hi("ax", "bx")))).withColumn("_gy", F.explode(F.sequence(lo("ay", "by"), hi("ay", "by"))))
    a = s.select("_gx", "_gy", F.col(sid).alias("a"), *[F.col(c).alias(f"p{c}") for c in ("ax", "ay", "bx", "by")])
    b = s.select("_gx", "_gy", F.col(sid).alias("b"), *[F.col(c).alias(f"q{c}") for c in ("ax", "ay", "bx", "by")])
    both = a.join(b, ["_gx", "_gy"]).where("a < b").drop("_gx", "_gy").distinct()
    px, py, qx, qy = F.expr("pbx - pax"), F.expr("pby - pay"), F.expr("qbx - qax"), F.expr("qby - qay")
    den = px * qy - py * qx
    t = F.try_divide((F.col("qax") - F.col("pax")) * qy - (F.col("qay") - F.col("pay")) * qx, den)
    u = F.try_divide((F.col("qax") - F.col("pax")) * py - (F.col("qay") - F.col("pay")) * px, den)
    lp, lq = F.hypot(px, py), F.hypot(qx, qy)
    met = both.withColumn("_den", den).where("abs(_den) > 1e-9").withColumn("t", t).withColumn("u", u).withColumn("_lp", lp).withColumn("_lq", lq)
    met = met.where((F.col("t") * F.col("_lp")).between(-tolerance, F.col("_lp") + tolerance) & (F.col("u") * F.col("_lq")).between(-tolerance, F.col("_lq") + tolerance))
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "t"))
    return met.select("a", "b", (F.col("pax") + at * (F.col("pbx") - F.col("pax"))).alias("x"), (F.col("pay") + at * (F.col("pby") - F.col("pay"))).alias("y"), at.alias("t"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "u")).alias("u"))


def rigid_fit(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, theta, tx, ty, rms of the rigid motion that takes (x, y) nearest to (u, v): closed form from sums, one aggregation."""
    n = F.count("*")
    mx, my, mu, mv = F.avg("x"), F.avg("y"), F.avg("u"), F.avg("v")
    dot = F.sum(F.col("x") * F.col("u") + F.col("y") * F.col("v")) - n * (mx * mu + my * mv)
    cross = F.sum(F.col("x") * F.col("v") - F.col("y") * F.col("u")) - n * (mx * mv - my * mu)
    size = F.sum(F.col("x") ** 2 + F.col("y") ** 2 + F.col("u") ** 2 + F.col("v") ** 2) - n * (mx * mx + my * my + mu * mu + mv * mv)
    out = pairs.groupBy(*by).agg(n.alias("n"), mx.alias("mx"), my.alias("my"), mu.alias("mu"), mv.alias("mv"), F.atan2(cross, dot).alias("theta"), (size - 2 * F.hypot(dot, cross)).alias("_e"))
    c, s = F.cos("theta"), F.sin("theta")
    return out.select(*by, "n", "theta", (F.col("mu") - c * F.col("mx") + s * F.col("my")).alias("tx"), (F.col("mv") - s * F.col("mx") - c * F.col("my")).alias("ty"), F.sqrt(F.greatest(F.col("_e"), F.lit(0.0)) / F.col("n")).alias("rms"))


def lattice_best(ranges: DataFrame, by: list[str], step: float, reach: float) -> DataFrame:
    """by, x, y, cost: the lattice point near the tags of a fix (x, y, r each) whose distances fit the ranges best (least squared excess)."""
    box = ranges.groupBy(*by).agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    seq = lambda c: F.explode(F.sequence(F.floor((F.col(f"lo{c}") - reach) / step), F.ceil((F.col(f"hi{c}") + reach) / step)))
    grid = box.withColumn("_i", seq("x")).withColumn("_j", seq("y")).select(*by, (F.col("_i") * step).alias("gx"), (F.col("_j") * step).alias("gy"))
    over = F.greatest(F.hypot(F.col("gx") - F.col("x"), F.col("gy") - F.col("y")) - F.col("r"), F.lit(0.0))
    cost = grid.join(ranges, by).groupBy(*by, "gx", "gy").agg(F.sum(over * over).alias("cost"))
    best = F.row_number().over(Window.partitionBy(*by).orderBy("cost", "gx", "gy"))
    return cost.withColumn("_r", best).where("_r = 1").select(*by, F.col("gx").alias("x"), F.col("gy").alias("y"), "cost")


def segment_gap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Distance of two segments (ax, ay, bx, by) that don't cross: the least of the four ends' distances."""
    ends = [sc.segment_distance(a[0], a[1], *b), sc.segment_distance(a[2], a[3], *b), sc.segment_distance(b[0], b[1], *a), sc.segment_distance(b[2], b[3], *a)]
    return F.least(*ends)


def adjacent(edges: DataFrame, uid: str, reach: float) -> DataFrame:
    """a, b, gap of units (edges: uid, ax, ay, bx, by) whose outlines come within `reach`, a < b."""
    lo = lambda p, q: F.floor((F.least(p, q) - reach) / (reach * 4))
    hi = lambda p, q: F.floor((F.greatest(p, q) + reach) / (reach * 4))
    e = edges.withColumn("_gx", F.explode(F.sequence(lo("ax", "bx"), hi("ax", "bx")))).withColumn("_gy", F.explode(F.sequence(lo("ay", "by"), hi("ay", "by"))))
    c = ("ax", "ay", "bx", "by")
    p = e.select("_gx", "_gy", F.col(uid).alias("a"), *[F.col(x).alias(f"p{x}") for x in c])
    q = e.select("_gx", "_gy", F.col(uid).alias("b"), *[F.col(x).alias(f"q{x}") for x in c])
    gap = segment_gap(tuple(F.col(f"p{x}") for x in c), tuple(F.col(f"q{x}") for x in c))
    return p.join(q, ["_gx", "_gy"]).where("a < b").withColumn("_d", gap).where(F.col("_d") <= reach).groupBy("a", "b").agg(F.min("_d").alias("gap"))


def parallels(corridors: DataFrame, cid: str, angle: float, share: float, most: int) -> DataFrame:
    """a, b of corridors (cid, heading, length) whose lines are within an angle and whose lengths are within a share; the first `most` (the report's own limit).

    Lengths are binned by the share, so that only neighbouring bins meet."""
    import math

    b = F.floor(F.log("length") / -math.log(1 - share))
    x = corridors.withColumn("_b", b)
    p = x.withColumn("_b", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1))).select("_b", F.col(cid).alias("a"), F.col("heading").alias("ha"), F.col("length").alias("la"))
    q = x.select("_b", F.col(cid).alias("b"), F.col("heading").alias("hb"), F.col("length").alias("lb"))
    near = F.abs(F.col("la") - F.col("lb")) <= share * F.greatest("la", "lb")
    return p.join(q, "_b").where((F.col("a") < F.col("b")) & near & (sc.line_angle(F.col("ha"), F.col("hb")) <= angle)).select("a", "b").orderBy("a", "b").limit(most)
