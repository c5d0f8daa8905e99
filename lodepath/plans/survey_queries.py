"""Survey checks over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodepath.operators import survey as sv
from lodepath.plans.common import EV, events, r6, table
from lodepath.plans.coverage_queries import BINS, CORRIDORS, STEPS, corridors, walked
from lodepath.plans.registry import query

WALLS = "w AS (SELECT s_suppkey AS wall, s_nationkey % 2 AS map, (s_suppkey * 37 % 500) * 1.0 AS ax, (s_suppkey * 53 % 400) * 1.0 AS ay, ax + 200 * cos(radians(s_suppkey % 24 * 15 + 3.7)) AS bx, ay + 200 * sin(radians(s_suppkey % 24 * 15 + 3.7)) AS by_ FROM supplier)"


def segments(df, sid, key, length, turn, mx, my, extra):
    """Segments that start on a lattice and turn with the key."""
    k = F.col(key)
    ax, ay, a = (k * mx % 500) * 1.0, (k * my % 400) * 1.0, F.radians(turn)
    return df.select(k.alias(sid), extra.alias("map"), ax.alias("ax"), ay.alias("ay"), (ax + length * F.cos(a)).alias("bx"), (ay + length * F.sin(a)).alias("by"))


def walls(spark, d):
    return segments(table(spark, d, "supplier"), "wall", "s_suppkey", F.lit(200.0), F.col("s_suppkey") % 24 * 15 + 3.7, 37, 53, F.col("s_nationkey") % 2)


@query("steady_start", f"""WITH {EV}, one AS (SELECT user_id, t, max(value) AS x, max(k) * 5.0 AS y, min(k) * 10.0 AS spread FROM ev GROUP BY ALL), g AS (SELECT *, sum(CAST(NOT coalesce(spread <= 400, false) AS INT)) OVER (PARTITION BY user_id ORDER BY t) AS bad FROM one),
f AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER v, 2) + pow(y - lag(y) OVER v, 2)) > 150 OR bad <> lag(bad) OVER v, true) AS new FROM g WHERE spread <= 400 AND x IS NOT NULL AND y IS NOT NULL WINDOW v AS (PARTITION BY user_id ORDER BY t)), r AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY t) AS run FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY t) AS n FROM r)
SELECT user_id, min(t) AS t, min_by(x, t) AS x, min_by(y, t) AS y FROM n WHERE n = 3 GROUP BY user_id""")
def steady_start(spark, d):
    one = events(spark, d).groupBy("user_id", "t").agg(F.max("value").alias("x"), (F.max("k") * 5.0).alias("y"), (F.min("k") * 10.0).alias("spread"))
    return sv.steady_start(one, ["user_id"], "t", "x", "y", "spread", near=150.0)


@query("pull_backs")
def pull_backs(spark, d):
    """Each event is a tick; its state can't be told in SQL but row by row."""
    return sv.pull_backs(events(spark, d).groupBy("user_id", "t").agg((F.max("k") / 100).alias("agreement"), (F.max("value") * 10).alias("off")), ["user_id"], "t", "agreement", "off", least=0.8, streak=2)


@query("nearest_unfinished", f"""WITH {EV}, {CORRIDORS}, {STEPS}, {BINS}, l AS (SELECT *, sqrt(pow(q_x - p_x, 2) + pow(q_y - p_y, 2)) AS len FROM cor), e AS (SELECT *, unnest(range(greatest(CAST(ceil(len / 100) AS BIGINT), 1))) AS bin FROM l),
m AS (SELECT corridor, e.bin, p_x + (q_x - p_x) * least((e.bin + 0.5) * 100 / len, 1) AS sx, p_y + (q_y - p_y) * least((e.bin + 0.5) * 100 / len, 1) AS sy, coalesce(forward + backward, 0) = 1 AS one_way FROM e LEFT JOIN bins USING (corridor, bin) WHERE coalesce(forward + backward, 0) < 2),
p AS (SELECT c_custkey, (c_custkey * 7919 % 100003) / 200.0 AS x, (c_custkey * 104729 % 100003) / 180.0 AS y FROM customer), j AS (SELECT c_custkey, corridor, bin, one_way, sqrt(pow(x - sx, 2) + pow(y - sy, 2)) AS dist, row_number() OVER (PARTITION BY c_custkey ORDER BY round(sqrt(pow(x - sx, 2) + pow(y - sy, 2)), 6), corridor, bin) AS n FROM p, m)
SELECT c_custkey, corridor, bin, one_way, round(dist / 100, 6) AS distance_m FROM j WHERE n = 1""")
def nearest_unfinished(spark, d):
    p = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 7919 % 100003 / 200.0).alias("x"), (F.col("c_custkey") * 104729 % 100003 / 180.0).alias("y"))
    got = sv.nearest_of(p, sv.unfinished(walked(spark, d), corridors(spark, d)), "c_custkey", ["corridor", "bin", "one_way"])
    return got.select("c_custkey", "corridor", "bin", "one_way", r6(F.col("distance") / 100).alias("distance_m"))


@query("linked_coverage", """WITH c AS (SELECT s_suppkey AS corridor, (s_suppkey * 37 % 500) * 10.0 AS ax, (s_suppkey * 53 % 400) * 10.0 AS ay, ax + 700 * cos(radians(s_suppkey % 24 * 15 + 3.7)) AS bx, ay + 700 * sin(radians(s_suppkey % 24 * 15 + 3.7)) AS by_ FROM supplier),
b AS (SELECT DISTINCT l_suppkey AS corridor, CAST(l_quantity AS BIGINT) % 7 AS bin FROM lineitem WHERE l_discount >= 0.05 AND (l_suppkey + CAST(l_quantity AS BIGINT)) % 3 <> 0), r0 AS (SELECT *, bin - row_number() OVER (PARTITION BY corridor ORDER BY bin) AS g FROM b), r AS (SELECT corridor, g, min(bin) AS lo, max(bin) AS hi FROM r0 GROUP BY ALL),
p AS (SELECT a.corridor AS a, b.corridor AS b, a.ax AS pax, a.ay AS pay, b.ax AS qax, b.ay AS qay, a.bx - a.ax AS ux, a.by_ - a.ay AS uy, b.bx - b.ax AS vx, b.by_ - b.ay AS vy, b.ax - a.ax AS rx, b.ay - a.ay AS ry, ux * vy - uy * vx AS den FROM c a JOIN c b ON a.corridor < b.corridor WHERE abs((a.bx - a.ax) * (b.by_ - b.ay) - (a.by_ - a.ay) * (b.bx - b.ax)) >= 0.05 * 700 * 700),
q AS (SELECT *, greatest(0, least(1, (rx * vy - ry * vx) / den)) AS t, greatest(0, least(1, (rx * uy - ry * ux) / den)) AS w FROM p), j AS (SELECT a, b, t * 700 AS at_a, w * 700 AS at_b FROM q WHERE sqrt(pow(pax + ux * t - qax - vx * w, 2) + pow(pay + uy * t - qay - vy * w, 2)) <= 80),
e AS (SELECT x.corridor AS ca, x.lo AS la, y.corridor AS cb, y.lo AS lb FROM j JOIN r x ON x.corridor = a AND x.lo <= floor((at_a + 150) / 100) AND x.hi >= floor((at_a - 150) / 100) JOIN r y ON y.corridor = b AND y.lo <= floor((at_b + 150) / 100) AND y.hi >= floor((at_b - 150) / 100)), k AS (SELECT ca AS corridor, la AS lo FROM e UNION SELECT cb, lb FROM e)
SELECT r0.corridor, r0.bin, k.lo IS NOT NULL AS linked FROM r0 JOIN r USING (corridor, g) LEFT JOIN k ON k.corridor = r.corridor AND k.lo = r.lo""")
def linked_coverage(spark, d):
    k = F.col("s_suppkey")
    ax, ay, a = (k * 37 % 500) * 10.0, (k * 53 % 400) * 10.0, F.radians(k % 24 * 15 + 3.7)
    c = table(spark, d, "supplier").select(k.alias("corridor"), ax.alias("ax"), ay.alias("ay"), (ax + 700 * F.cos(a)).alias("bx"), (ay + 700 * F.sin(a)).alias("by"))
    q = F.col("l_quantity").cast("bigint")
    done = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("corridor"), (q % 7).alias("bin")).agg(F.max((F.col("l_discount") >= 0.05) & ((F.col("l_suppkey") + q) % 3 != 0)).alias("done"))
    return sv.linked_coverage(done, c)


@query("wall_agreement", f"""WITH {WALLS}, n AS (SELECT c_custkey AS wall, c_nationkey % 2 AS map, (c_custkey * 41 % 500) * 1.0 AS ax, (c_custkey * 59 % 400) * 1.0 AS ay, 60.0 + c_custkey % 90 AS len, radians(c_custkey % 12 * 15) AS ang, greatest(CAST(floor((60.5 + c_custkey % 90) / 20) AS BIGINT), 1) AS n FROM customer), s AS (SELECT *, unnest(range(n)) AS k FROM n),
p AS (SELECT wall, map, k, (len + 0.5) / n AS h, ang, ax + (len + 0.5) * cos(ang) * (k + 0.5) / n AS x, ay + (len + 0.5) * sin(ang) * (k + 0.5) / n AS y FROM s),
j AS (SELECT p.wall, p.map, k, h, abs((x - ax) * (by_ - ay) - (y - ay) * (bx - ax)) / 200 AS off FROM p JOIN w ON p.map = w.map WHERE least(abs(degrees(ang) - (w.wall % 24 * 15 + 3.7)) % 180, 180 - abs(degrees(ang) - (w.wall % 24 * 15 + 3.7)) % 180) <= 10 AND ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / 200 BETWEEN -10 AND 210),
b AS (SELECT wall, map, k, h, min(off) AS off FROM j GROUP BY ALL HAVING min(off) <= 30), g AS (SELECT map, sum(h) AS overlap, sum(off * h) / sum(h) AS mean, max(off) AS worst FROM b GROUP BY map)
SELECT map, round(coalesce(overlap, 0), 6) AS overlap, round(mean, 6) AS mean, round(worst, 6) AS worst FROM (SELECT DISTINCT map FROM n) LEFT JOIN g USING (map)""")
def wall_agreement(spark, d):
    k = F.col("c_custkey")
    new = segments(table(spark, d, "customer"), "wall", "c_custkey", 60.5 + k % 90, k % 12 * 15, 41, 59, F.col("c_nationkey") % 2)
    return sv.wall_agreement(new, walls(spark, d), ["map"], "wall").select("map", *[r6(c).alias(c) for c in ("overlap", "mean", "worst")])


@query("wall_clearance", f"""WITH {WALLS}, p AS (SELECT c_nationkey AS session, c_custkey AS pid, (c_custkey * 7919 % 100003) / 200.0 AS x, (c_custkey * 104729 % 100003) / 250.0 AS y, radians(c_custkey % 7 * 50 + 1.3) AS a, 40.0 + c_custkey % 71 AS l, 30.0 + c_custkey % 83 AS r FROM customer),
d AS (SELECT session, pid, x, y, 'a' AS side, sin(a) AS dx, -cos(a) AS dy FROM p UNION ALL SELECT session, pid, x, y, 'b', -sin(a), cos(a) FROM p),
h AS (SELECT session, pid, side, ((ax - x) * (by_ - ay) - (ay - y) * (bx - ax)) / (dx * (by_ - ay) - dy * (bx - ax)) AS t, ((ax - x) * dy - (ay - y) * dx) / (dx * (by_ - ay) - dy * (bx - ax)) AS u FROM d, w WHERE abs(dx * (by_ - ay) - dy * (bx - ax)) > 1e-9),
m AS (SELECT session, pid, min(t) FILTER (side = 'a') AS ma, min(t) FILTER (side = 'b') AS mb FROM h WHERE t > 1 AND t <= 800 AND u BETWEEN 0 AND 1 GROUP BY ALL), j AS (SELECT session, pid, l, r, ma, mb FROM p JOIN m USING (session, pid) WHERE ma IS NOT NULL AND mb IS NOT NULL), s AS (SELECT session, CASE WHEN count(*) >= 3 AND covar_pop(l - r, ma - mb) < 0 THEN -1 ELSE 1 END AS sign FROM j GROUP BY session),
o AS (SELECT session, pid, l, r, CASE WHEN sign > 0 THEN ma ELSE mb END AS lm, CASE WHEN sign > 0 THEN mb ELSE ma END AS rm FROM j JOIN s USING (session))
SELECT session, pid, round(lm, 6) AS left_map, round(rm, 6) AS right_map, round(lm + rm - l - r, 6) AS width_diff, round((lm - rm) / 2 - (l - r) / 2, 6) AS lateral_err FROM o""")
def wall_clearance(spark, d):
    k = F.col("c_custkey")
    a = F.radians(k % 7 * 50 + 1.3)
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("session"), k.alias("pid"), (k * 7919 % 100003 / 200.0).alias("x"), (k * 104729 % 100003 / 250.0).alias("y"), F.cos(a).alias("dx"), F.sin(a).alias("dy"), (40.0 + k % 71).alias("left"), (30.0 + k % 83).alias("right"))
    got = sv.wall_clearance(rows, walls(spark, d), ["session"], "pid")
    return got.select("session", "pid", *[r6(c).alias(c) for c in ("left_map", "right_map", "width_diff", "lateral_err")])
