"""Coverage, inputs and bias checks over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodepath.operators import coverage as cv
from lodepath.plans.common import EV, events, r6, table
from lodepath.plans.registry import query

CORRIDORS = "cor AS (SELECT n_nationkey AS corridor, 0.0 AS p_x, n_nationkey * 20.0 AS p_y, 430.0 AS q_x, n_nationkey * 20.0 + 15 AS q_y, 20.0 AS width FROM nation)"
STEPS = "one AS (SELECT user_id, t, max(value) AS x, max(k) * 5.0 AS y FROM ev GROUP BY ALL), st AS (SELECT x, y, x - lag(x, 3) OVER w AS dx, y - lag(y, 3) OVER w AS dy FROM one WINDOW w AS (PARTITION BY user_id ORDER BY t))"
BINS = """pr AS (SELECT *, q_x - p_x AS ux, q_y - p_y AS uy, ((x - p_x) * (q_x - p_x) + (y - p_y) * (q_y - p_y)) / ((q_x - p_x) * (q_x - p_x) + (q_y - p_y) * (q_y - p_y)) AS f FROM st, cor WHERE dx * dx + dy * dy > 100 AND dx * dx + dy * dy < 90000),
bins AS (SELECT corridor, least(greatest(CAST(trunc(f * sqrt(ux * ux + uy * uy) / 100) AS BIGINT), 0), greatest(CAST(ceil(sqrt(ux * ux + uy * uy) / 100) AS BIGINT), 1) - 1) AS bin, max(CAST(dx * ux + dy * uy >= 0 AS INT)) AS forward, max(CAST(dx * ux + dy * uy < 0 AS INT)) AS backward
  FROM pr WHERE f BETWEEN -0.01 AND 1.01 AND sqrt(pow(x - p_x - f * ux, 2) + pow(y - p_y - f * uy, 2)) <= width / 2 + 40 GROUP BY ALL)"""


def corridors(spark, d):
    y = F.col("n_nationkey") * 20.0
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("corridor"), F.lit(0.0).alias("ax"), y.alias("ay"), F.lit(430.0).alias("bx"), (y + 15).alias("by"), F.lit(20.0).alias("width"))


def walked(spark, d):
    one = events(spark, d).groupBy("user_id", "t").agg(F.max("value").alias("x"), (F.max("k") * 5.0).alias("y"))
    return cv.direction_bins(one, ["user_id"], "t", "x", "y", corridors(spark, d))


@query("direction_bins", f"WITH {EV}, {CORRIDORS}, {STEPS}, {BINS} SELECT * FROM bins")
def direction_bins(spark, d):
    return walked(spark, d)


@query("direction_summary", f"WITH {EV}, {CORRIDORS}, {STEPS}, {BINS} SELECT corridor, greatest(CAST(ceil(sqrt(pow(q_x - p_x, 2) + pow(q_y - p_y, 2)) / 100) AS BIGINT), 1) AS n_bins, round(coalesce(sum(forward + backward), 0) / (2 * greatest(ceil(sqrt(pow(q_x - p_x, 2) + pow(q_y - p_y, 2)) / 100), 1)), 6) AS done, CAST(coalesce(sum(CAST(forward <> backward AS INT)), 0) AS DOUBLE) AS one_way_m FROM cor LEFT JOIN bins USING (corridor) GROUP BY corridor, p_x, p_y, q_x, q_y")
def direction_summary(spark, d):
    return cv.direction_summary(walked(spark, d), corridors(spark, d)).withColumn("done", r6("done"))


@query("raster_max_merge", f"WITH {EV}, r AS (SELECT user_id % 3 AS source, CAST(floor(value / 20) AS BIGINT) AS row, k % 10 AS col, count(*) AS passes FROM ev GROUP BY ALL) SELECT row, col, max(least(passes, 255)) AS passes FROM r GROUP BY ALL")
def raster_max_merge(spark, d):
    r = events(spark, d).groupBy((F.col("user_id") % 3).alias("source"), F.floor(F.col("value") / 20).alias("row"), (F.col("k") % 10).alias("col")).agg(F.count("*").alias("passes"))
    return cv.raster_max(r, ["row", "col"], "passes")


@query("nearest_unpainted", f"""WITH {EV}, p AS (SELECT DISTINCT CAST(floor(value / 10) AS BIGINT) AS row, CAST(k % 50 AS BIGINT) AS col FROM ev), g AS (SELECT r.range AS row, c.range AS col FROM range(0, 60) r, range(0, 60) c), free AS (SELECT * FROM g ANTI JOIN p USING (row, col)),
q AS (SELECT s_suppkey, s_nationkey * 20.0 + 3 AS x, (s_suppkey * 7 % 100) * 5.0 AS y FROM supplier), j AS (SELECT s_suppkey, row, col, greatest(abs(col - CAST(trunc(x / 10) AS BIGINT)), abs(row - CAST(trunc(y / 10) AS BIGINT))) AS ring, sqrt(pow((col + 0.5) * 10 - x, 2) + pow((row + 0.5) * 10 - y, 2)) AS dist FROM q, free),
n AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY ring, dist, row, col) AS n FROM j WHERE ring <= 500) SELECT s_suppkey, row, col, round(dist, 6) AS distance FROM q LEFT JOIN (SELECT s_suppkey, row, col, dist FROM n WHERE n = 1) USING (s_suppkey)""")
def nearest_unpainted(spark, d):
    painted = events(spark, d).select(F.floor(F.col("value") / 10).alias("row"), (F.col("k") % 50).cast("bigint").alias("col")).distinct()
    grid = spark.range(60).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(59).cast("bigint"))).alias("col"))
    q = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") * 20.0 + 3).alias("x"), ((F.col("s_suppkey") * 7 % 100) * 5.0).alias("y"))
    return cv.nearest_unpainted(q, "s_suppkey", "x", "y", grid.join(painted, ["row", "col"], "left_anti"), 10.0).withColumn("distance", r6("distance"))


@query("room_masses", f"""WITH {EV}, p AS (SELECT user_id, -value / 100 AS logw, CASE WHEN k % 7 = 0 THEN NULL ELSE k % 5 END AS room FROM ev), m AS (SELECT user_id, room, sum(exp(logw)) AS w FROM p GROUP BY ALL), a AS (SELECT user_id, sum(w) AS total FROM m GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, room) AS n FROM m WHERE room IS NOT NULL)
SELECT user_id, max(CASE WHEN n = 1 THEN room END) AS room, round(max(CASE WHEN n = 1 THEN w / total END), 6) AS mass, max(CASE WHEN n = 2 THEN room END) AS runner_up, round(max(CASE WHEN n = 2 THEN w / total END), 6) AS runner_up_mass FROM n JOIN a USING (user_id) WHERE n <= 2 GROUP BY user_id""")
def room_masses(spark, d):
    p = events(spark, d).select("user_id", (-F.col("value") / 100).alias("logw"), F.when(F.col("k") % 7 != 0, F.col("k") % 5).alias("room"))
    return cv.room_masses(p, ["user_id"], "logw", "room").withColumn("mass", r6("mass")).withColumn("runner_up_mass", r6("runner_up_mass"))


@query("bias_in_band", f"WITH {EV}, v AS (SELECT user_id, list_sort(list(value)) AS v FROM ev GROUP BY ALL) SELECT user_id, v[len(v) // 2 + 1] AS median, CASE WHEN len(v) >= 5 THEN v[len(v) // 2 + 1] BETWEEN 200 - 30 AND 280 + 30 END AS fits FROM v")
def bias_in_band(spark, d):
    return cv.bias_in_band(events(spark, d), ["user_id"], "value", 200.0, 280.0, 30.0, 5)


@query("last_of_each_bin", f"WITH {EV}, n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id % 20, round(value / 50), round(k / 50.0) ORDER BY event_id DESC) AS n FROM ev) SELECT event_id FROM n WHERE n <= 3")
def last_of_each_bin(spark, d):
    e = events(spark, d).select("event_id", (F.col("user_id") % 20).alias("u"), "value", F.col("k").cast("double").alias("k"))
    return cv.last_of_each_bin(e, ["u"], ["value", "k"], "event_id", 50.0).select("event_id")


@query("densified_truth", f"""WITH {EV}, one AS (SELECT user_id, t, max(value) AS x, CAST(max(k) AS DOUBLE) AS y FROM ev GROUP BY ALL), l AS (SELECT *, lead(t) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM one WINDOW w AS (PARTITION BY user_id ORDER BY t)),
i AS (SELECT *, unnest(range(0, CAST(ceil((nt - t) / 43200000.0) AS BIGINT))) AS i FROM l WHERE nt > t)
SELECT user_id, t + i * 43200000 AS t, round(x + (nx - x) * (i * 43200000.0 / (nt - t)), 6) AS x, round(y + (ny - y) * (i * 43200000.0 / (nt - t)), 6) AS y FROM i UNION ALL SELECT user_id, t, round(x, 6), round(y, 6) FROM l WHERE nt IS NULL""")
def densified_truth(spark, d):
    """Half-days take the place of thirtieths of a second."""
    one = events(spark, d).groupBy("user_id", "t").agg(F.max("value").alias("x"), F.max("k").cast("double").alias("y"))
    return cv.densified(one, ["user_id"], "t", "x", "y", 1000.0 / 43_200_000).withColumn("x", r6("x")).withColumn("y", r6("y"))


@query("drifted_tracks")
def drifted_tracks(spark, d):
    one = events(spark, d).groupBy("user_id", "t").agg(F.max("value").alias("x"), F.max("k").alias("y"))
    return cv.drifted(one, "user_id", "t", "x", "y", 0.02, 0.001, 17)


@query("seeded_split")
def seeded_split(spark, d):
    return cv.seeded_split(events(spark, d).select("user_id"), "user_id", 20, 17)


@query("same_inputs", "WITH a AS (SELECT DISTINCT c_nationkey AS map, c_mktsegment AS name FROM customer WHERE c_acctbal > 4000), b AS (SELECT DISTINCT c_nationkey AS map, c_mktsegment AS name FROM customer) SELECT coalesce(a.map, b.map) AS map, bool_and(a.map IS NOT NULL AND b.map IS NOT NULL) AS unchanged FROM a FULL JOIN b ON a.map = b.map AND a.name = b.name GROUP BY 1")
def same_inputs(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("map"), F.col("c_mktsegment").alias("name"), "c_acctbal")
    return cv.same_inputs(c.where("c_acctbal > 4000"), c, ["map"], "name")


@query("inherited_map", """WITH s AS (SELECT o_orderkey AS session, CASE o_orderstatus WHEN 'O' THEN 'blind' WHEN 'F' THEN 'companion' ELSE 'test' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 7 END AS map_id, o_custkey AS pair_id FROM orders),
b AS (SELECT pair_id, arg_min(map_id, session) AS m FROM s WHERE kind = 'blind' AND map_id IS NOT NULL GROUP BY ALL), j AS (SELECT session, kind, CASE WHEN map_id IS NULL AND kind = 'companion' THEN m ELSE map_id END AS map_id, pair_id FROM s LEFT JOIN b USING (pair_id)) SELECT * FROM j WHERE map_id IS NOT NULL""")
def inherited_map(spark, d):
    kind = F.when(F.col("o_orderstatus") == "O", "blind").when(F.col("o_orderstatus") == "F", "companion").otherwise("test")
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("session"), kind.alias("kind"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 7).alias("map_id"), F.col("o_custkey").alias("pair_id"))
    return cv.inherited_map(s)


@query("matched_map", """WITH s AS (SELECT c_custkey AS session, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 300 END AS map_id, c_acctbal AS width, c_nationkey / 10.0 AS height FROM customer), m AS (SELECT s_suppkey AS map, s_acctbal AS width, s_nationkey / 10.0 AS height FROM supplier),
n AS (SELECT s.session, min(m.map) AS map FROM s JOIN m ON abs(s.width - m.width) <= 50 AND abs(s.height - m.height) <= 50 WHERE s.map_id IS NULL OR s.map_id NOT IN (SELECT map FROM m) GROUP BY ALL) SELECT s.session, coalesce(a.map, n.map) AS map FROM s LEFT JOIN m a ON a.map = s.map_id LEFT JOIN n ON n.session = s.session""")
def matched_map(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("session"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey") % 300).alias("map_id"), F.col("c_acctbal").alias("width"), (F.col("c_nationkey") / 10).alias("height"))
    m = table(spark, d, "supplier").select(F.col("s_suppkey").alias("map"), F.col("s_acctbal").alias("width"), (F.col("s_nationkey") / 10).alias("height"))
    return cv.matched_map(s, m, 50.0)


@query("sessions_to_upload", "SELECT o_orderkey AS session FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def sessions_to_upload(spark, d):
    """Sessions that no stored build includes yet."""
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("session"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("session")).join(done, "session", "left_anti")


@query("safe_names", r"WITH n AS (SELECT page_id AS id, url AS name FROM pages UNION ALL SELECT page_id, 'p' || page_id || '.html' FROM pages UNION ALL SELECT page_id, substr(coalesce(url, ''), 9, page_id % 5) FROM pages) SELECT id, name, regexp_matches(name, '^[A-Za-z0-9._\-]{1,120}$') AS safe FROM n")
def safe_names(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    part = F.substring(F.coalesce("url", F.lit("")), F.lit(9), (F.col("id") % 5).cast("int"))
    n = p.select("id", F.col("url").alias("name")).unionAll(p.select("id", F.concat(F.lit("p"), F.col("id"), F.lit(".html")))).unionAll(p.select("id", part))
    return n.withColumn("safe", cv.safe_name(F.col("name")))


@query("version_listing", "SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_name, p_partkey) AS INT) AS rank FROM part")
def version_listing(spark, d):
    p = table(spark, d, "part").withColumn("n", F.struct("p_name", "p_partkey"))
    return cv.versions(p, ["p_brand"], "p_size", "n").select("p_brand", "p_partkey", "rank")


@query("walkable_raster", """WITH cor AS (SELECT n_nationkey AS corridor, n_nationkey * 10.0 AS p_x, 20.0 AS p_y, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 10.0 ELSE 400.0 END AS q_x, n_nationkey * 12.0 + 30 AS q_y, 30.0 AS width FROM nation), g AS (SELECT r.range AS row, c.range AS col, (c.range + 0.5) * 25 AS x, (r.range + 0.5) * 25 AS y FROM range(0, 16) r, range(0, 20) c),
j AS (SELECT *, q_x - p_x AS ux, q_y - p_y AS uy FROM g, cor WHERE pow(q_x - p_x, 2) + pow(q_y - p_y, 2) > 1e-6), f AS (SELECT *, greatest(least(((x - p_x) * ux + (y - p_y) * uy) / (ux * ux + uy * uy), 1), 0) AS f, CASE WHEN atan2(uy, ux) < 0 THEN atan2(uy, ux) + pi() WHEN atan2(uy, ux) >= pi() THEN atan2(uy, ux) - pi() ELSE atan2(uy, ux) END AS angle FROM j),
i AS (SELECT *, first_value(angle) OVER (PARTITION BY row, col ORDER BY corridor) AS axis FROM f WHERE sqrt(pow(x - p_x - f * ux, 2) + pow(y - p_y - f * uy, 2)) <= width / 2 + 20)
SELECT row, col, CASE WHEN max(CAST(least(abs(axis - angle), pi() - abs(axis - angle)) > radians(20) AS INT)) = 1 THEN 'junction' ELSE 'corridor' END AS state, round(min(axis), 6) AS axis FROM i GROUP BY ALL""")
def walkable_raster(spark, d):
    n = F.col("n_nationkey")
    c = table(spark, d, "nation").select(n.alias("corridor"), (n * 10.0).alias("ax"), F.lit(20.0).alias("ay"), F.when(n % 3 == 0, n * 10.0).otherwise(400.0).alias("bx"), (n * 12.0 + 30).alias("by"), F.lit(30.0).alias("width"))
    return cv.walkable(c, 500.0, 400.0).withColumn("axis", r6("axis"))


@query("identifiability", """WITH s AS (SELECT s_nationkey % 5 AS map, s_suppkey AS win, n_nationkey AS cand, pow(s_acctbal / 500 - n_nationkey, 2) + 0.5 AS d, n_nationkey * 1.0 AS x, 0.0 AS y, s_nationkey * 1.0 AS tx, 0.5 AS ty FROM supplier JOIN nation ON n_regionkey = s_nationkey % 5),
b AS (SELECT *, row_number() OVER (PARTITION BY map, win ORDER BY d, cand) AS n FROM s), o AS (SELECT map, win, d, x, y, sqrt(pow(x - tx, 2) + pow(y - ty, 2)) AS err FROM b WHERE n = 1), r AS (SELECT o.map, o.win, min(s.d) / o.d AS ratio FROM s JOIN o ON s.map = o.map AND s.win = o.win WHERE sqrt(pow(s.x - o.x, 2) + pow(s.y - o.y, 2)) > 3 AND o.d > 0 GROUP BY o.map, o.win, o.d),
e AS (SELECT map, count(*) AS n, avg(CAST(err <= 1.5 AS INT)) AS rate, list_sort(list(err)) AS v FROM o GROUP BY map), a AS (SELECT map, list_sort(list(ratio)) AS v FROM r GROUP BY map)
SELECT e.map, n, round(rate, 6) AS top1_rate, round((e.v[(n - 1) // 2 + 1] + e.v[n // 2 + 1]) / 2, 6) AS median_err, round(e.v[least(n - 1, CAST(floor(0.9 * n) AS INT)) + 1], 6) AS p90_err, round((a.v[(len(a.v) - 1) // 2 + 1] + a.v[len(a.v) // 2 + 1]) / 2, 6) AS ambiguity FROM e LEFT JOIN a ON a.map = e.map""")
def identifiability(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("map"), F.col("n_nationkey").alias("cand"))
    s = table(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("map"), F.col("s_suppkey").alias("window"), (F.col("s_acctbal") / 500).alias("f"), (F.col("s_nationkey") * 1.0).alias("tx"))
    j = s.join(n, "map").select("map", "window", "cand", (F.pow(F.col("f") - F.col("cand"), F.lit(2)) + 0.5).alias("d"), (F.col("cand") * 1.0).alias("x"), F.lit(0.0).alias("y"), "tx", F.lit(0.5).alias("ty"))
    out = cv.identifiability(j, ["map"])
    return out.select("map", "n", *[r6(c).alias(c) for c in ("top1_rate", "median_err", "p90_err", "ambiguity")])
