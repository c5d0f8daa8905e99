"""Magnetic grids: aggregation, merging, filling, sampling, coverage; multi-session fusion; radio fingerprints."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodepath.functions import scalars as sc
from lodepath.operators import fusion, grids, radio, spatial
from lodepath.plans.common import EV, SAMPLES, events, r6, samples, table
from lodepath.plans.registry import query

CELL = 50.0
CELLS = "c AS (SELECT session, CAST(least(floor(y / 10), 10) AS BIGINT) AS row, CAST(least(floor(x / 50), 10) AS BIGINT) AS col, b FROM smp WHERE x >= 0 AND x <= 550 AND y >= 0 AND y <= 110)"


def cells(spark, d):
    s = samples(spark, d).where(grids.in_bounds(F.col("x"), F.col("y"), 550, 110))
    return s.select("session", grids.cell_of(F.col("y"), 10, 11).alias("row"), grids.cell_of(F.col("x"), CELL, 11).alias("col"), "b")


@query("grid_welford", f"WITH {SAMPLES}, {CELLS} SELECT row, col, count(*) AS n, round(avg(b), 6) AS mean, round(CASE WHEN count(*) > 1 THEN greatest(stddev_samp(b), 0.5) ELSE 0 END, 6) AS sigma FROM c GROUP BY ALL HAVING count(*) >= 5")
def grid_welford(spark, d):
    g = grids.aggregate(cells(spark, d), ["row", "col"], ["b"]).where("n >= 5")
    return g.select("row", "col", "n", r6("mean_b").alias("mean"), r6(grids.sigma(F.col("n"), F.col("m2_b"))).alias("sigma"))


@query("grid_merge", f"WITH {SAMPLES}, {CELLS} SELECT row, col, count(*) AS n, round(avg(b), 9) AS mean, round(var_pop(b) * count(*), 3) AS m2 FROM c GROUP BY ALL")
def grid_merge(spark, d):
    """Each session's partial grid, merged; the oracle aggregates all samples at once."""
    parts = grids.aggregate(cells(spark, d), ["session", "row", "col"], ["b"])
    g = grids.merge(parts, ["row", "col"], ["b"])
    return g.select("row", "col", "n", F.round("mean_b", 9).alias("mean"), F.round("m2_b", 3).alias("m2"))  # to 9 places: means of few samples end in a 5 at the seventh


HEAL = """a AS (SELECT row, col, count(*) AS sn, avg(b) AS sm, stddev_samp(b) AS ss FROM c WHERE session < 2 GROUP BY ALL), l AS (SELECT row, col, count(*) AS ln, avg(b) AS lm, stddev_samp(b) AS ls FROM c WHERE session >= 2 GROUP BY ALL),
j AS (SELECT coalesce(a.row, l.row) AS row, coalesce(a.col, l.col) AS col, sn, sm, ss, ln, lm, ls, least(ln * 0.3, sn * 0.5) AS w FROM a FULL JOIN l ON a.row = l.row AND a.col = l.col), k AS (SELECT *, CASE WHEN sn IS NULL AND ln >= 8 THEN 'fill' WHEN sn IS NULL THEN 'none' WHEN ln IS NULL OR w < 0.5 THEN 'keep' WHEN abs(lm - sm) > 8 THEN 'conflict' ELSE 'merge' END AS action FROM j)
SELECT row, col, coalesce(sn, ln) AS n, action, round(CASE action WHEN 'fill' THEN lm WHEN 'merge' THEN (sn * sm + w * lm) / (sn + w) ELSE sm END, 9) AS mean, round(CASE action WHEN 'fill' THEN 1.5 * greatest(ls, 0.5) ELSE CASE WHEN sn > 1 THEN greatest(ss, 0.5) ELSE 0 END END, 5) AS sigma FROM k WHERE action <> 'none'"""
#: Cells so narrow that the lattice of samples leaves every third or so without one.
FINE = "c AS (SELECT session, CAST(least(floor(y / 10), 10) AS BIGINT) AS row, CAST(floor(x / 7) AS BIGINT) AS col, b FROM smp)"
WIDE = 72


def fine_cells(spark, d):
    return samples(spark, d).select("session", grids.cell_of(F.col("y"), 10, 11).alias("row"), F.floor(F.col("x") / 7).alias("col"), "b")


def healed(c):
    """The first two sessions are the survey, the others live."""
    a, b = grids.aggregate(c.where("session < 2"), ["row", "col"], ["b"]), grids.aggregate(c.where("session >= 2"), ["row", "col"], ["b"])
    return grids.merge_capped(a, b, ["row", "col"], "b").select("row", "col", "n", "action", F.round("mean", 9).alias("mean"), F.round("sigma", 5).alias("sigma"))


@query("grid_heal", f"WITH {SAMPLES}, {FINE}, {HEAL}")
def grid_heal(spark, d):
    return healed(fine_cells(spark, d))


@query("grid_heal_all", f"WITH {SAMPLES}, {CELLS}, {HEAL}")
def grid_heal_all(spark, d):
    return healed(cells(spark, d))


MEANS = "g AS (SELECT row, col, avg(b) AS v, count(*) AS n FROM c GROUP BY ALL)"


def means(spark, d, fine=True):
    c = fine_cells(spark, d) if fine else cells(spark, d)
    return c.groupBy("row", "col").agg(F.avg("b").alias("v"), F.count("*").alias("n"))


def both(name, sql):
    """Registers a query over the fine grid and, as name_all, over the coarse one; sql(columns, width of a cell) is what follows the means."""

    def keep(f):
        query(name, f"WITH {EV}, {SAMPLES}, {FINE}, {MEANS}, {sql(WIDE, 7)}")(partial(f, fine=True))
        query(f"{name}_all", f"WITH {EV}, {SAMPLES}, {CELLS}, {MEANS}, {sql(11, 50)}")(partial(f, fine=False))
        return f

    return keep


@both("grid_idw_fill", lambda wide, _: f"""t AS (SELECT r AS row, k AS col FROM (SELECT unnest(range(11)) AS r), (SELECT unnest(range({wide})) AS k)), h AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.row = t.row AND g.col = t.col)), p AS (SELECT h.row, h.col, 50 * sqrt(pow(h.row - g.row, 2) + pow(h.col - g.col, 2)) AS dist, v FROM h JOIN g ON abs(h.row - g.row) <= 3 AND abs(h.col - g.col) <= 3)
SELECT row, col, round(sum(v / (dist * dist)) / sum(1 / (dist * dist)), 6) AS filled, round(min(dist), 6) AS nearest FROM p WHERE dist <= 150 GROUP BY ALL""")
def grid_idw_fill(spark, d, fine):
    side = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    t = spark.range(1).select(side(11).alias("row")).withColumn("col", side(WIDE if fine else 11))
    return grids.fill_idw(means(spark, d, fine), t, [], "v", 50.0, 150.0).select("row", "col", r6("filled").alias("filled"), r6("nearest").alias("nearest"))


@both("grid_bilinear", lambda wide, step: f"""p AS (SELECT event_id, least(greatest(value / {step} - 0.5, 0), {wide - 1}) AS cx, least(greatest(k / 10.0 - 0.5, 0), 10) AS cy FROM ev), q AS (SELECT *, CAST(least(floor(cx), {wide - 2}) AS BIGINT) AS c0, CAST(least(floor(cy), 9) AS BIGINT) AS r0 FROM p),
s AS (SELECT event_id, r0 + dr AS row, c0 + dc AS col, CASE dr WHEN 1 THEN cy - r0 ELSE 1 - (cy - r0) END * CASE dc WHEN 1 THEN cx - c0 ELSE 1 - (cx - c0) END AS w FROM q, (SELECT unnest([0, 1]) AS dr), (SELECT unnest([0, 1]) AS dc))
SELECT event_id, round(CASE WHEN sum(CASE WHEN v IS NULL THEN 0 ELSE w END) >= 0.25 THEN sum(w * v) / sum(CASE WHEN v IS NULL THEN 0 ELSE w END) END, 9) AS value FROM s LEFT JOIN g USING (row, col) GROUP BY event_id""")
def grid_bilinear(spark, d, fine):
    """Points are scaled so that both axes have cells of 50."""
    p = events(spark, d).select("event_id", (F.col("value") * (50 / 7 if fine else 1)).alias("x"), (F.col("k") * 5.0).alias("y"))
    return grids.sample_bilinear(p, means(spark, d, fine), [], "event_id", "v", 50.0, 11, WIDE if fine else 11).select("event_id", F.round("value", 9).alias("value"))


@both("grid_blur", lambda *_: "b AS (SELECT 1) SELECT a.row, a.col, round(sum(exp(-(pow(a.row - o.row, 2) + pow(a.col - o.col, 2)) / 2.0) * o.v) / sum(exp(-(pow(a.row - o.row, 2) + pow(a.col - o.col, 2)) / 2.0)), 6) AS blurred FROM g a JOIN g o ON abs(a.row - o.row) <= 2 AND abs(a.col - o.col) <= 2 GROUP BY ALL")
def grid_blur(spark, d, fine):
    return grids.blur(means(spark, d, fine), [], "v", 1.0, 2).select("row", "col", r6("blurred").alias("blurred"))


@both("grid_dilation", lambda *_: "s AS (SELECT unnest(range(-2, 3)) AS dr) SELECT DISTINCT row + dr AS row, col + dc AS col FROM g, s, (SELECT unnest(range(-2, 3)) AS dc) WHERE v > 40 AND dr * dr + dc * dc <= 4")
def grid_dilation(spark, d, fine):
    return grids.grow(means(spark, d, fine).where("v > 40"), [], 2)


@both("raster_runs", lambda *_: """a AS (SELECT row, min(col) AS c0, max(col) AS c1 FROM (SELECT row, col, col - row_number() OVER (PARTITION BY row ORDER BY col) AS q FROM g) GROUP BY row, q)
SELECT c0, c1, min(row) AS r0, max(row) AS r1 FROM (SELECT *, row - row_number() OVER (PARTITION BY c0, c1 ORDER BY row) AS h FROM a) GROUP BY c0, c1, h""")
def raster_runs(spark, d, fine):
    return grids.runs(means(spark, d, fine), [])


@query("change_detection", f"WITH {EV}, g AS (SELECT user_id, avg(value - 250) AS mean, count(*) AS n, max_by(k, (t, event_id)) AS s FROM ev GROUP BY user_id) SELECT user_id, n, round(mean, 6) AS mean FROM g WHERE n >= 8 AND abs(mean) >= greatest(2, s)")
def change_detection(spark, d):
    e = events(spark, d).select("user_id", (F.col("value") - 250).alias("r"), F.col("k").cast("double").alias("s"), F.struct("t", "event_id").alias("o"))
    return grids.change_blocks(e, ["user_id"], "r", "s", "o").select("user_id", "n", r6("mean").alias("mean"))


@both("corridor_coverage", lambda *_: "p AS (SELECT k AS corridor, r AS point FROM (SELECT unnest(range(12)) AS k), (SELECT unnest(range(14)) AS r)), h AS (SELECT corridor, point, max(CASE WHEN g.n >= 100 THEN 1 ELSE 0 END) AS ok FROM p LEFT JOIN g ON g.row = point AND abs(g.col - corridor) <= 1 GROUP BY ALL) SELECT corridor, round(avg(ok), 6) AS covered FROM h GROUP BY corridor")
def corridor_coverage(spark, d, fine):
    p = spark.range(12).select(F.col("id").alias("corridor"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(13).cast("bigint"))).alias("point"))
    p = p.select("corridor", "point", F.col("point").alias("row"), F.col("corridor").alias("col"), F.lit(0).alias("across_row"), F.lit(1).alias("across_col"))
    return grids.coverage(p, means(spark, d, fine), ["corridor"], 100).select("corridor", r6("covered").alias("covered"))


@query("session_offsets", f"""WITH {SAMPLES}, {CELLS}, g AS (SELECT session, row, col, avg(b + session * 3) AS v, count(*) AS n FROM c GROUP BY ALL HAVING count(*) >= 5), p AS (SELECT a.session AS a, b.session AS b, b.v - a.v AS dv FROM g a JOIN g b ON a.row = b.row AND a.col = b.col AND a.session < b.session), m AS (SELECT a, b, median(dv) AS med, count(*) AS n FROM p GROUP BY ALL)
SELECT m.a, m.b, m.n, round(med, 6) AS med, round(median(abs(dv - med)), 6) AS mad FROM p JOIN m USING (a, b) GROUP BY ALL""")
def session_offsets(spark, d):
    """Edges between sessions: median difference over common cells, their number, median absolute deviation."""
    g = cells(spark, d).groupBy("session", "row", "col").agg(F.avg(F.col("b") + F.col("session") * 3).alias("v"), F.count("*").alias("n")).where("n >= 5")
    return fusion.edges(g, "session", ["row", "col"], "v").select("a", "b", "n", r6("med").alias("med"), r6("mad").alias("mad"))


@query("rigid_fit", f"WITH {EV}, p AS (SELECT user_id, value AS x, CAST(k AS DOUBLE) AS y, value * cos(0.3) - k * sin(0.3) + 10 AS u, value * sin(0.3) + k * cos(0.3) - 20 AS v FROM ev), s AS (SELECT user_id, count(*) AS n, atan2(covar_pop(x, v) - covar_pop(y, u), covar_pop(x, u) + covar_pop(y, v)) AS th, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM p GROUP BY user_id) SELECT user_id, n, round(th, 6) AS theta, round(mu - (cos(th) * mx - sin(th) * my), 4) AS tx, round(mv - (sin(th) * mx + cos(th) * my), 4) AS ty FROM s")
def rigid_fit(spark, d):
    """A known motion is recovered from its pairs."""
    import math

    c, s = math.cos(0.3), math.sin(0.3)
    x, y = F.col("value"), F.col("k").cast("double")
    p = events(spark, d).select("user_id", x.alias("x"), y.alias("y"), (x * c - y * s + 10).alias("u"), (x * s + y * c - 20).alias("v"))
    return spatial.rigid_fit(p, ["user_id"]).select("user_id", "n", r6("theta").alias("theta"), F.round("tx", 4).alias("tx"), F.round("ty", 4).alias("ty"))


@query("tag_range_fix", f"""WITH {EV}, r AS (SELECT user_id, value / 10 AS x, k / 2.0 AS y, 5.0 + k % 10 AS r FROM ev), b AS (SELECT user_id, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM r GROUP BY user_id), i AS (SELECT user_id, unnest(range(CAST(floor((lx - 5) / 5) AS BIGINT), CAST(ceil((hx + 5) / 5) AS BIGINT) + 1)) * 5.0 AS gx FROM b), j AS (SELECT user_id, unnest(range(CAST(floor((ly - 5) / 5) AS BIGINT), CAST(ceil((hy + 5) / 5) AS BIGINT) + 1)) * 5.0 AS gy FROM b),
c AS (SELECT i.user_id, gx, gy, sum(pow(greatest(sqrt(pow(gx - x, 2) + pow(gy - y, 2)) - r, 0), 2)) AS cost FROM i JOIN j USING (user_id) JOIN r ON r.user_id = i.user_id GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cost, gx, gy) AS n FROM c) SELECT user_id, gx AS x, gy AS y, round(cost, 4) AS cost FROM k WHERE n = 1""")
def tag_range_fix(spark, d):
    r = events(spark, d).select("user_id", (F.col("value") / 10).alias("x"), (F.col("k") / 2).alias("y"), (F.lit(5.0) + F.col("k") % 10).alias("r"))
    return spatial.lattice_best(r, ["user_id"], 5.0, 5.0).select("user_id", "x", "y", F.round("cost", 4).alias("cost"))


def posterior_sql(place):
    """Observations of all users against the prints of places."""
    return f"""WITH {EV}, o AS (SELECT user_id AS oid, k % 20 AS tag, -avg(value) / 5 AS rssi FROM ev GROUP BY ALL), r AS (SELECT {place} AS pid, k % 20 AS tag, min(-value / 5) AS low, max(-value / 5) AS high FROM ev GROUP BY ALL),
s AS (SELECT oid, pid, sum(-0.5 * pow(greatest(low - rssi, rssi - high, 0) / 6, 2)) AS s, count(*) AS n FROM o JOIN r USING (tag) GROUP BY ALL), l AS (SELECT s.oid, s.pid, s - 0.5 * (nr - n) - 0.25 * (no - n) AS ll FROM s JOIN (SELECT oid, count(*) AS no FROM o GROUP BY oid) USING (oid) JOIN (SELECT pid, count(*) AS nr FROM r GROUP BY pid) USING (pid)), e AS (SELECT *, exp(ll - max(ll) OVER (PARTITION BY oid)) AS e FROM l)
SELECT oid, pid, round(ll, 9) AS ll, round(e / sum(e) OVER (PARTITION BY oid), 6) AS p FROM e"""


def posterior(e, place, every=False):
    o = e.groupBy(F.col("user_id").alias("oid"), (F.col("k") % 20).alias("tag")).agg((-F.avg("value") / 5).alias("rssi"))
    r = e.groupBy(place.alias("pid"), (F.col("k") % 20).alias("tag")).agg(F.min(-F.col("value") / 5).alias("low"), F.max(-F.col("value") / 5).alias("high"))
    got = radio.posteriors(o, r, "oid", "pid", "tag", 0.5, 0.25) if every else radio.softmax(radio.log_likelihood(o, r, "oid", "pid", "tag", 0.5, 0.25), ["oid"], "ll")
    return got.select("oid", "pid", F.round("ll", 9).alias("ll"), r6("p").alias("p"))


@query("fingerprint_posterior", posterior_sql("k // 4"))
def fingerprint_posterior(spark, d):
    """All users against 25 places."""
    return posterior(events(spark, d), F.floor(F.col("k") / 4))


@query("fingerprint_posterior_all", posterior_sql("user_id"))
def fingerprint_posterior_all(spark, d):
    """All users as observations against all users' prints, block by block; every pair is a row, so work is users squared."""
    return posterior(events(spark, d), F.col("user_id"), every=True)


@query("point_jaccard", f"WITH {EV}, s AS (SELECT user_id, event_type, list_distinct(list(k)) AS s FROM ev GROUP BY ALL) SELECT a.user_id, len(list_intersect(a.s, b.s)) AS common, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view'")
def point_jaccard(spark, d):
    s = events(spark, d).groupBy("user_id", "event_type").agg(F.collect_set("k").alias("s"))
    a, b = s.where("event_type = 'click'").select("user_id", F.col("s").alias("a")), s.where("event_type = 'view'").select("user_id", F.col("s").alias("b"))
    return a.join(b, "user_id").select("user_id", F.size(F.array_intersect("a", "b")).cast("bigint").alias("common"), r6(radio.jaccard(F.col("a"), F.col("b"))).alias("jaccard"))


@query("magnetic_features", f"WITH {EV}, m AS (SELECT event_id, value / 10 AS mx, k / 3.0 AS my, 20.0 AS mz, 0.1 * (k % 5) AS ux, 0.2 AS uy, 9.7 AS uz FROM ev), f AS (SELECT event_id, sqrt(mx * mx + my * my + mz * mz) AS b, (mx * ux + my * uy + mz * uz) / sqrt(ux * ux + uy * uy + uz * uz) AS bz FROM m) SELECT event_id, round(b, 6) AS total, round(bz, 6) AS vertical, round(sqrt(greatest(b * b - bz * bz, 0)), 6) AS horizontal FROM f WHERE b > 1 AND b < 200")
def magnetic_features(spark, d):
    e = events(spark, d)
    f = sc.magnetic_feature(F.col("value") / 10, F.col("k") / 3, F.lit(20.0), 0.1 * (F.col("k") % 5), F.lit(0.2), F.lit(9.7))
    return e.select("event_id", *[c.alias(n) for c, n in zip(f, ("b", "v", "h"), strict=True)]).where(sc.plausible_field(F.col("b"))).select("event_id", r6("b").alias("total"), r6("v").alias("vertical"), r6("h").alias("horizontal"))


@query("drop_reasons", f"WITH {EV}, r AS (SELECT user_id, CASE WHEN value < 20 THEN 'weak' WHEN k % 7 = 0 THEN 'limited tracking' WHEN k > 95 THEN 'outside' END AS reason FROM ev) SELECT user_id, coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY ALL")
def drop_reasons(spark, d):
    """The first failing rule of a list names the reason."""
    return fusion.reasons(events(spark, d), [("weak", F.col("value") < 20), ("limited tracking", F.col("k") % 7 == 0), ("outside", F.col("k") > 95)]).groupBy("user_id", "reason").agg(F.count("*").alias("n"))


@query("stationary_filter", f"""WITH {EV}, one AS (SELECT user_id, t, max(value) AS x, max(k) AS y FROM ev GROUP BY ALL), s AS (SELECT *, t - 86400000 AS t0 FROM one), j AS (SELECT s.user_id, s.t, s.x, s.y, one.t AS pt, one.x AS px, one.y AS py FROM s ASOF LEFT JOIN one ON s.user_id = one.user_id AND s.t0 >= one.t)
SELECT user_id, t, pt IS NULL OR sqrt(pow(x - px, 2) + pow(y - py, 2)) / ((t - pt) / 86400000.0) >= 60 AS moving FROM j""")
def stationary_filter(spark, d):
    """Speed since the last row at least a day before; rows without one are kept (`keep_unknown`)."""
    one = events(spark, d).groupBy("user_id", "t").agg(F.max("value").alias("x"), F.max("k").alias("y"))
    return fusion.moving(one, ["user_id"], "t", "x", "y", 86_400_000, 60.0 / 86_400_000, keep_unknown=True).select("user_id", "t", "moving")


@query("paint_passes", f"""WITH {EV}, one AS (SELECT user_id, t, max(value) AS x, max(k) AS y FROM ev GROUP BY ALL), s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS st FROM one WINDOW w AS (PARTITION BY user_id ORDER BY t)), p AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY t) AS path, CAST(floor(x / 50) AS BIGINT) AS cell FROM s), g AS (SELECT cell, CASE WHEN path - lag(path) OVER (PARTITION BY user_id, cell ORDER BY t) < 300 THEN 0 ELSE 1 END AS new FROM p)
SELECT cell, least(CAST(sum(new) AS BIGINT), 255) AS passes FROM g GROUP BY cell""")
def paint_passes(spark, d):
    """Passes by cell: a new one only after a stretch of path."""
    from lodepath.operators.sequences import path_length

    one = events(spark, d).groupBy("user_id", "t").agg(F.max("value").alias("x"), F.max("k").alias("y"))
    p = path_length(one, ["user_id"], "t", "x", "y").withColumn("cell", F.floor(F.col("x") / 50))
    gap = F.col("path") - F.lag("path").over(Window.partitionBy("user_id", "cell").orderBy("t"))
    return p.withColumn("new", F.when(gap < 300, 0).otherwise(1)).groupBy("cell").agg(F.least(F.sum("new"), F.lit(255)).alias("passes"))

