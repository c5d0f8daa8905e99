"""Scanned meshes against a map's shelves: how high shelves are, and how far they stand from where the map has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodepath.operators.spatial import hashed, nearest

#: Vertices that a shelf or face needs, cm around a shelf, cm from the track; heights in m.
LEAST, AROUND, NEAR_TRACK = 30, 80.0, 600.0


def placed(vertices: DataFrame, track: DataFrame, by: list[str], vid: str, tid: str, reach: float = 300.0) -> DataFrame:
    """by, vid, tid of the track point (by, tid, x, y) nearest to each vertex (by, vid, x, y) within reach; vertices far from the track go."""
    return nearest(vertices, track, by, vid, tid, "x", "y", reach).select(*by, vid, tid)


def binned_quantiles(values: DataFrame, by: list[str], value: str, bin_size: float, wanted: dict) -> DataFrame:
    """by, n, and for each name of wanted the value at a place: a function of the column n to a rank from 0, may be a half.

    Values are counted by bins first, within each task and then by key, so a key sends one row a bin however many values it has; a result
    is the middle of its bin, off by half a bin at most. A half rank is the mean of both neighbours."""
    bins = values.groupBy(*by, F.floor(F.col(value) / bin_size).alias("_bin")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    ranked = bins.withColumn("n", F.sum("_c").over(w)).withColumn("_end", F.sum("_c").over(w.orderBy("_bin"))).withColumn("_at", (F.col("_bin") + 0.5) * bin_size)
    holds = lambda r: (F.col("_end") > r) & (F.col("_end") - F.col("_c") <= r)
    pick = lambda r: F.max(F.when(holds(r), F.col("_at")))
    out = [((pick(F.floor(rank(F.col("n")))) + pick(F.ceil(rank(F.col("n"))))) / 2).alias(name) for name, rank in wanted.items()]
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *out)


def shelf_heights(vertices: DataFrame, shelves: DataFrame, track: DataFrame, bin_size: float = 0.1, least: int = LEAST) -> DataFrame:
    """code, points, top (m), shift (cm), dx, dy (cm), faces of the shelves that the scan tells something about.

    vertices: x, y (cm), h (m over the floor); shelves: code, x, y (middle), w, h (cm), turn (degrees); track: x, y. Only shelves within
    600 cm of the track count. Vertices and shelves meet by 1 m buckets. top is the 95 % height of what is on the shelf, 20 cm to 3.5 m up; a
    face's offset the median of what is 40 cm behind to 80 cm before a long side, 40 cm to 1.6 m up; shift the mean of both faces' (positive
    towards the short axis). One pass over vertices counts all three in bins of bin_size cm, so results are off by half of that at most."""
    near = hashed(track.where("x is not null and y is not null"), "x", "y", NEAR_TRACK).select("_gx", "_gy", F.col("x").alias("_tx"), F.col("y").alias("_ty"))
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    s = hashed(shelves, "x", "y", NEAR_TRACK).withColumn("_gx", F.explode(F.transform(around, lambda k: F.col("_gx") + k))).withColumn("_gy", F.explode(F.transform(around, lambda k: F.col("_gy") + k)))
    s = shelves.join(s.join(near, ["_gx", "_gy"]).where(F.hypot(F.col("_tx") - F.col("x"), F.col("_ty") - F.col("y")) <= NEAR_TRACK).select("code").distinct(), "code", "left_semi")
    ext = F.greatest("w", "h") / 2 + AROUND
    span = lambda c: F.sequence(F.floor((F.col(c) - ext) / 100), F.floor((F.col(c) + ext) / 100))
    b = s.withColumn("_bx", F.explode(span("x"))).withColumn("_by", F.explode(span("y"))).select("code", F.col("x").alias("_sx"), F.col("y").alias("_sy"), F.col("w").alias("_w"), F.col("h").alias("_h"), F.radians("turn").alias("_a"), "_bx", "_by")
    v = vertices.select("x", "y", F.col("h").alias("z"), F.floor(F.col("x") / 100).alias("_bx"), F.floor(F.col("y") / 100).alias("_by")).join(b, ["_bx", "_by"])
    v = v.withColumns({"_u": F.expr("(x - _sx) * cos(_a) + (y - _sy) * sin(_a)"), "_v": F.expr("-(x - _sx) * sin(_a) + (y - _sy) * cos(_a)")})
    long_u = F.col("_w") >= F.col("_h")
    along, across = F.when(long_u, F.col("_u")).otherwise(F.col("_v")), F.when(long_u, F.col("_v")).otherwise(F.col("_u"))
    on = (F.abs("_u") <= F.col("_w") / 2) & (F.abs("_v") <= F.col("_h") / 2) & F.col("z").between(0.2, 3.5)

    def face(sign: int) -> Column:
        d = sign * across - F.least("_w", "_h") / 2
        seen = (F.abs(along) <= F.greatest("_w", "_h") / 2 - 10) & F.col("z").between(0.4, 1.6) & d.between(-40, 80)
        return F.when(seen, F.struct(F.lit({1: "plus", -1: "minus"}[sign]).alias("what"), d.alias("value")))

    rows = F.array(F.struct(F.lit("all").alias("what"), F.lit(0.0).alias("value")), F.when(on, F.struct(F.lit("top").alias("what"), (F.col("z") * 100).alias("value"))), face(1), face(-1))
    each = v.select("code", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("code", "r.what", "r.value")
    q = binned_quantiles(each, ["code", "what"], "value", bin_size, {"p95": lambda n: F.floor(n * 0.95), "mid": lambda n: (n - 1) / 2})
    of = lambda what, c: F.max(F.when((F.col("what") == what) & (F.col("n") >= least), F.col(c)))
    one = q.groupBy("code").agg(of("all", "n").alias("points"), (of("top", "p95") / 100).alias("top"), of("plus", "mid").alias("_p"), (-of("minus", "mid")).alias("_m"))
    shift = F.when(F.col("_p").isNotNull() & F.col("_m").isNotNull(), (F.col("_p") + F.col("_m")) / 2).otherwise(F.coalesce("_p", "_m"))
    one = one.where("points is not null").withColumn("shift", shift).where("top is not null or shift is not null").join(s.select("code", "w", "h", F.radians("turn").alias("_a")), "code")
    short = lambda u, v: F.when(F.col("w") >= F.col("h"), u).otherwise(v)
    return one.select(
        "code", "points", "top", "shift", (F.col("shift") * short(-F.sin("_a"), F.cos("_a"))).alias("dx"), (F.col("shift") * short(F.cos("_a"), F.sin("_a"))).alias("dy"),
        (F.col("_p").isNotNull().cast("int") + F.col("_m").isNotNull().cast("int")).alias("faces"),
    )
