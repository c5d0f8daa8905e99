"""As-of, interval, spatial, anti and ordered-alternative joins; set operations; ranking; graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodepath.functions import scalars as sc
from lodepath.operators import alignment, graphs, radio, spatial
from lodepath.plans.common import EV, events, r6, table
from lodepath.plans.registry import query

DAY = 86_400_000
L = "SELECT event_id, user_id, t FROM ev WHERE event_type = 'click'"
R = "SELECT user_id, t AS rt, max(value) AS v, min(value) AS v0 FROM ev WHERE event_type = 'view' GROUP BY ALL"


def sides(spark, d):
    e = events(spark, d)
    return e.where("event_type = 'click'").select("event_id", "user_id", "t"), e.where("event_type = 'view'").select("user_id", "t", F.col("value").alias("v"))


@query("asof_backward", f"WITH {EV}, l AS ({L}), r AS ({R}) SELECT l.event_id, CASE WHEN l.t - rt <= {DAY} THEN rt END AS r_t, CASE WHEN l.t - rt <= {DAY} THEN v END AS r_v FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.rt")
def asof_backward(spark, d):
    left, right = sides(spark, d)
    return alignment.asof(left, right, ["user_id"], "t", ["v"], "backward", DAY).select("event_id", "r_t", "r_v")


@query("asof_forward", f"WITH {EV}, l AS ({L}), r AS ({R}) SELECT l.event_id, CASE WHEN rt - l.t <= {DAY} THEN rt END AS r_t, CASE WHEN rt - l.t <= {DAY} THEN v0 END AS r_v FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t <= r.rt")
def asof_forward(spark, d):
    left, right = sides(spark, d)
    return alignment.asof(left, right, ["user_id"], "t", ["v"], "forward", DAY).select("event_id", "r_t", "r_v")


@query("asof_nearest_tol", f"""WITH {EV}, l AS ({L}), r AS ({R}), b AS (SELECT l.*, rt AS bt, v AS bv FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.rt), n AS (SELECT b.*, rt AS ft, v0 AS fv FROM b ASOF LEFT JOIN r ON b.user_id = r.user_id AND b.t <= r.rt),
h AS (SELECT event_id, t, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR t - bt <= ft - t) THEN bt ELSE ft END AS ht, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR t - bt <= ft - t) THEN bv ELSE fv END AS hv FROM n)
SELECT event_id, CASE WHEN abs(t - ht) <= {DAY} THEN ht END AS r_t, CASE WHEN abs(t - ht) <= {DAY} THEN hv END AS r_v FROM h""")
def asof_nearest_tol(spark, d):
    left, right = sides(spark, d)
    return alignment.asof(left, right, ["user_id"], "t", ["v"], "nearest", DAY).select("event_id", "r_t", "r_v")


@query("asof_strict", f"WITH {EV}, l AS (SELECT event_id, user_id, t FROM ev), r AS (SELECT user_id, t AS rt, max(value) AS v FROM ev GROUP BY ALL) SELECT l.event_id, rt AS r_t, v AS r_v FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t > r.rt")
def asof_strict(spark, d):
    """The row before, never one of the very time."""
    e = events(spark, d)
    return alignment.asof(e.select("event_id", "user_id", "t"), e.select("user_id", "t", F.col("value").alias("v")), ["user_id"], "t", ["v"], exact=False).select("event_id", "r_t", "r_v")


@query("bracket_interp", f"""WITH {EV}, l AS ({L}), r AS ({R}), b AS (SELECT l.*, rt AS bt, v AS bv FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.rt), n AS (SELECT b.*, rt AS ft, v0 AS fv FROM b ASOF LEFT JOIN r ON b.user_id = r.user_id AND b.t <= r.rt)
SELECT event_id, round(CASE WHEN ft - bt <= {3 * DAY} THEN bv + (fv - bv) * CASE WHEN ft > bt THEN (t - bt) / CAST(ft - bt AS DOUBLE) ELSE 0 END WHEN ft IS NULL AND t - bt <= {DAY} THEN bv WHEN bt IS NULL AND ft - t <= {DAY} THEN fv END, 6) AS v FROM n""")
def bracket_interp(spark, d):
    left, right = sides(spark, d)
    return alignment.interpolate(left, right, ["user_id"], "t", ["v"], 3 * DAY, DAY).select("event_id", r6("r_v").alias("v"))


@query("in_spans", f"""WITH {EV}, s AS (SELECT user_id, t AS a, t + {DAY // 2} AS b FROM ev WHERE event_type = 'purchase') SELECT event_id, user_id FROM ev WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM s WHERE s.user_id = ev.user_id AND ev.t BETWEEN a AND b)""")
def in_spans(spark, d):
    e = events(spark, d)
    s = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("a"), (F.col("t") + DAY // 2).alias("b"))
    return alignment.within(e.where("event_type = 'click'"), s, ["user_id"], "t", "a", "b", DAY, "left_semi").select("event_id", "user_id")


@query("outside_spans", f"""WITH {EV}, s AS (SELECT user_id, t AS a, t + {DAY // 2} AS b FROM ev WHERE event_type = 'purchase') SELECT event_id, user_id FROM ev WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = ev.user_id AND ev.t BETWEEN a AND b)""")
def outside_spans(spark, d):
    """Rows in none of the dropped spans."""
    e = events(spark, d)
    s = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("a"), (F.col("t") + DAY // 2).alias("b"))
    return alignment.within(e.where("event_type = 'click'"), s, ["user_id"], "t", "a", "b", DAY, "left_anti").select("event_id", "user_id")


@query("window_overlap", f"""WITH {EV}, w AS (SELECT user_id, event_type, min(t) AS a, max(t) AS b FROM ev GROUP BY ALL) SELECT x.user_id, greatest(x.a, y.a) AS lo, least(x.b, y.b) AS hi FROM w x JOIN w y USING (user_id) WHERE x.event_type = 'click' AND y.event_type = 'view' AND least(x.b, y.b) - greatest(x.a, y.a) >= {10 * DAY}""")
def window_overlap(spark, d):
    w = events(spark, d).groupBy("user_id", "event_type").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return alignment.overlap(w.where("event_type = 'click'"), w.where("event_type = 'view'"), ["user_id"], "a", "b", 10 * DAY)


@query("revisit_pairs", f"WITH {EV} SELECT a.event_type, a.t AS t_a, b.t AS t_b, round(abs(a.value - b.value), 6) AS diff FROM ev a JOIN ev b ON a.event_type = b.event_type AND a.t < b.t AND b.t - a.t >= {DAY} AND sqrt(pow(a.value - b.value, 2) + pow(a.k * 5 - b.k * 5, 2)) <= 2")
def revisit_pairs(spark, d):
    e = events(spark, d).withColumn("y", F.col("k") * 5).withColumn("x", F.col("value"))
    return spatial.revisits(e, ["event_type"], "t", "x", "y", "value", 2.0, DAY).select("event_type", "t_a", "t_b", r6("diff").alias("diff"))


@query("nearest_feature", f"""WITH {EV}, p AS (SELECT event_id, value AS x, k * 5 AS y FROM ev WHERE event_type = 'click'), s AS (SELECT event_id AS site, value AS x, k * 5 AS y FROM ev WHERE event_type = 'purchase'), r AS (SELECT event_id, site, sqrt(pow(p.x - s.x, 2) + pow(p.y - s.y, 2)) AS dist FROM p JOIN s ON abs(p.x - s.x) <= 5 AND abs(p.y - s.y) <= 5)
SELECT event_id, max(site) FILTER (WHERE dist = m) AS site, round(min(dist), 6) AS distance FROM (SELECT *, min(dist) OVER (PARTITION BY event_id) AS m FROM r WHERE dist <= 5) GROUP BY event_id""")
def nearest_feature(spark, d):
    e = events(spark, d).select("event_id", "event_type", F.col("value").alias("x"), (F.col("k") * 5).alias("y"))
    s = e.where("event_type = 'purchase'").select(F.col("event_id").alias("site"), "x", "y")
    return spatial.nearest(e.where("event_type = 'click'"), s, [], "event_id", "site", "x", "y", 5.0).select("event_id", "site", r6("distance").alias("distance"))


@query("point_in_room", f"""WITH {EV}, rooms AS (SELECT n_nationkey AS room, (n_nationkey % 5) * 100.0 AS x0, (n_nationkey // 5) * 100.0 AS y0, 90.0 AS w FROM nation), h AS (SELECT event_id, room, row_number() OVER (PARTITION BY event_id ORDER BY room) AS n FROM ev JOIN rooms ON value >= x0 AND value < x0 + w AND k * 5 >= y0 AND k * 5 < y0 + w - abs(0) AND (value - x0) + (k * 5 - y0) < 1.5 * w)
SELECT event_id, room FROM h WHERE n = 1""")
def point_in_room(spark, d):
    """Even-odd containment in pentagons (a square with its far corner cut off)."""
    x0, y0, w = (F.col("n_nationkey") % 5) * 100.0, F.floor(F.col("n_nationkey") / 5) * 100.0, 90.0
    p = lambda a, b: F.struct((x0 + a * w).alias("x"), (y0 + b * w).alias("y"))
    rooms = table(spark, d, "nation").select(F.col("n_nationkey").alias("room"), F.array(p(0, 0), p(1, 0), p(1, 0.5), p(0.5, 1), p(0, 1)).alias("ring"))
    e = events(spark, d).select("event_id", F.col("value").alias("x"), (F.col("k") * 5.0).alias("y"))
    return spatial.contain(e, rooms, "event_id", "x", "y", "ring", "room", 100.0).select("event_id", "room")


@query("nearest_corridor", f"""WITH {EV}, c AS (SELECT n_nationkey AS corridor, n_nationkey * 20.0 AS x FROM nation), q AS (SELECT event_id, corridor, abs(value - x) AS dist FROM ev JOIN c ON abs(value - x) <= 15), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, corridor) AS n FROM q) SELECT event_id, corridor, round(dist, 6) AS distance FROM r WHERE n = 1""")
def nearest_corridor(spark, d):
    c = table(spark, d, "nation").select(F.col("n_nationkey").alias("corridor"), (F.col("n_nationkey") * 20.0).alias("ax"), F.lit(-1000.0).alias("ay"), (F.col("n_nationkey") * 20.0).alias("bx"), F.lit(2000.0).alias("by"))
    e = events(spark, d).select("event_id", F.col("value").alias("x"), F.col("k").cast("double").alias("y"))
    return spatial.nearest_segment(e, c, "event_id", "x", "y", "corridor", 15.0).select("event_id", "corridor", r6("distance").alias("distance"))


@query("ray_clearance", f"WITH {EV}, c AS (SELECT n_nationkey * 20.0 AS x FROM nation) SELECT event_id, round(min(x - value), 6) AS distance FROM ev JOIN c ON x >= value AND x - value <= 50 GROUP BY event_id")
def ray_clearance(spark, d):
    c = table(spark, d, "nation").select((F.col("n_nationkey") * 20.0).alias("ax"), F.lit(-10.0).alias("ay"), (F.col("n_nationkey") * 20.0).alias("bx"), F.lit(110.0).alias("by"))
    r = events(spark, d).select("event_id", F.col("value").alias("x"), F.col("k").cast("double").alias("y"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(50.0).alias("reach"))
    return spatial.ray_hits(r, c, "event_id", 25.0).select("event_id", r6("distance").alias("distance"))


@query("knn_embeddings", """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS n FROM p)
SELECT query_id, vec_id, CAST(n AS INT) AS rank, round(1 / (dist + 1), 6) AS w FROM r WHERE n <= 5""")
def knn_embeddings(spark, d):
    """The stated query set (ids divisible by 100) against all rows; each query keeps its own five in every task before the merge."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    dist = F.sqrt(F.aggregate(F.zip_with("q", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    blocks = max(8, e.count() // 65_536 + 1)  # of rows, each about as large however many there are
    both = q.withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(e.withColumn("blk", F.expr(f"cast(pmod(xxhash64(vec_id), {blocks}) as int)")), "blk").where("query_id <> vec_id")
    return radio.knn(both.select("query_id", "vec_id", dist.alias("d")), "query_id", ["vec_id"], 5).select("query_id", "vec_id", "rank", r6("w").alias("w"))


@query("sparse_union_distance", f"""WITH {EV}, a AS (SELECT user_id, k % 10 AS ap, -avg(k) AS dbm FROM ev GROUP BY ALL), b AS (SELECT ap, dbm FROM a WHERE user_id = (SELECT min(user_id) FROM a)), u AS (SELECT user_id, ap FROM a UNION SELECT user_id, b.ap FROM (SELECT DISTINCT user_id FROM a), b)
SELECT u.user_id, round(sqrt(avg(pow(coalesce(a.dbm, -100) - coalesce(b.dbm, -100), 2))), 6) AS dist FROM u LEFT JOIN a USING (user_id, ap) LEFT JOIN b ON u.ap = b.ap GROUP BY u.user_id""")
def sparse_union_distance(spark, d):
    a = events(spark, d).groupBy("user_id", (F.col("k") % 10).alias("ap")).agg((-F.avg("k")).alias("dbm"))
    m = a.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("ap", "dbm"))).alias("m"))
    ref = m.orderBy("user_id").limit(1).select(F.col("m").alias("ref"))  # one row
    return m.crossJoin(F.broadcast(ref)).select("user_id", r6(radio.union_distance(F.col("m"), F.col("ref"))).alias("dist"))


@query("topk_per_group", f"WITH {EV}, r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM ev WHERE value >= 100) SELECT user_id, event_id, value, CAST(n AS INT) AS rank FROM r WHERE n <= 5")
def topk_per_group(spark, d):
    return radio.strongest(events(spark, d), ["user_id"], "value", "event_id", 5, 100.0).select("user_id", "event_id", "value", "rank")


@query("event_merge_order", f"WITH {EV}, u AS (SELECT user_id AS s, t, 0 AS stream, event_id AS id FROM ev UNION ALL SELECT conv_id AS s, CAST(1704067200000 + turn * 1000 AS BIGINT) AS t, 1 AS stream, conv_id * 1000 + turn AS id FROM conversations) SELECT s, t, stream, id, CAST(row_number() OVER (PARTITION BY s ORDER BY t, stream, id) AS INT) AS pos FROM u")
def event_merge_order(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("s"), "t", F.lit(0).alias("stream"), F.col("event_id").alias("id"))
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("s"), (F.lit(1704067200000) + F.col("turn") * 1000).cast("bigint").alias("t"), F.lit(1).alias("stream"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return e.unionByName(c).withColumn("pos", F.row_number().over(Window.partitionBy("s").orderBy("t", "stream", "id")))


@query("ordered_alternatives", "SELECT c_custkey, coalesce(a.s_suppkey, b.s_suppkey, -1) AS hit FROM customer LEFT JOIN supplier a ON a.s_suppkey = c_custkey * 10 LEFT JOIN supplier b ON b.s_suppkey = c_custkey + 50")
def ordered_alternatives(spark, d):
    """Two candidate keys, the first that hits."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier").select("s_suppkey")
    a, b = s.withColumnRenamed("s_suppkey", "a"), s.withColumnRenamed("s_suppkey", "b")
    return c.join(a, F.col("a") == F.col("c_custkey") * 10, "left").join(b, F.col("b") == F.col("c_custkey") + 50, "left").select("c_custkey", F.coalesce("a", "b", F.lit(-1)).alias("hit"))


@query("full_outer_precedence", "WITH a AS (SELECT c_nationkey AS tag, avg(c_acctbal) AS x, 0.0 AS y FROM customer WHERE c_nationkey < 20 GROUP BY 1), b AS (SELECT s_nationkey AS tag, avg(s_acctbal) AS x, 0.0 AS y, count(*) AS n FROM supplier WHERE s_nationkey > 2 GROUP BY 1), j AS (SELECT coalesce(a.tag, b.tag) AS tag, a.x AS tx, b.x AS lx, coalesce(a.x IS NULL OR (n >= 5 AND abs(a.x - b.x) > 500), false) AS use FROM a FULL JOIN b ON a.tag = b.tag) SELECT tag, round(CASE WHEN use THEN lx ELSE tx END, 4) AS x, CASE WHEN use THEN 'learned' ELSE 'table' END AS source FROM j")
def full_outer_precedence(spark, d):
    a = table(spark, d, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("tag")).agg(F.avg("c_acctbal").alias("x")).withColumn("y", F.lit(0.0))
    b = table(spark, d, "supplier").where("s_nationkey > 2").groupBy(F.col("s_nationkey").alias("tag")).agg(F.avg("s_acctbal").alias("x"), F.count("*").alias("n")).withColumn("y", F.lit(0.0))
    return radio.precedence(a, b, "tag", 5, 500.0).select("tag", F.round("x", 4).alias("x"), "source")


@query("mismatch_list", "WITH a AS (SELECT c_nationkey AS tag, avg(c_acctbal) AS x FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS tag, avg(s_acctbal) AS x FROM supplier GROUP BY 1) SELECT tag, round(abs(a.x - b.x), 4) AS dist FROM a JOIN b USING (tag) WHERE abs(a.x - b.x) > 500")
def mismatch_list(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("tag")).agg(F.avg("c_acctbal").alias("x"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("tag")).agg(F.avg("s_acctbal").alias("y"))
    return a.join(b, "tag").withColumn("dist", F.round(F.abs(F.col("x") - F.col("y")), 4)).where(F.abs(F.col("x") - F.col("y")) > 500).select("tag", "dist").orderBy(F.desc("dist"), "tag")


@query("anti_checks", "SELECT 'customer without order' AS issue, CAST(c_custkey AS BIGINT) AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'order without customer', o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE o_custkey = c_custkey) UNION ALL SELECT 'nation without supplier', CAST(n_nationkey AS BIGINT) FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) UNION ALL SELECT 'part without line', p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
def anti_checks(spark, d):
    t = lambda n: table(spark, d, n)
    checks = [
        ("customer without order", t("customer"), t("orders"), "c_custkey", "o_custkey", "c_custkey"), ("order without customer", t("orders"), t("customer"), "o_custkey", "c_custkey", "o_orderkey"),
        ("nation without supplier", t("nation"), t("supplier"), "n_nationkey", "s_nationkey", "n_nationkey"), ("part without line", t("part"), t("lineitem"), "p_partkey", "l_partkey", "p_partkey"),
    ]
    out = None
    for name, a, b, x, y, i in checks:
        part = a.join(b, a[x] == b[y], "left_anti").select(F.lit(name).alias("issue"), F.col(i).cast("bigint").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


@query("link_checks", "WITH e AS (SELECT c_custkey AS a, c_custkey * 7 % (SELECT count(*) + 40 FROM customer) + 1 AS b FROM customer UNION SELECT c_custkey * 7 % (SELECT count(*) + 40 FROM customer) + 1, c_custkey FROM customer WHERE c_nationkey % 2 = 0), v AS (SELECT c_custkey AS v FROM customer) SELECT 'dangling' AS issue, a, b FROM e WHERE b NOT IN (SELECT v FROM v) UNION ALL SELECT 'one way', a, b FROM e WHERE b IN (SELECT v FROM v) AND (b, a) NOT IN (SELECT (a, b) FROM e)")
def link_checks(spark, d):
    """Neighbour lists: links to what isn't there, and links that the other side doesn't have."""
    c = table(spark, d, "customer")
    other = c.crossJoin(F.broadcast(c.agg((F.count("*") + 40).alias("n")))).select("c_custkey", "c_nationkey", (F.col("c_custkey") * 7 % F.col("n") + 1).alias("o"))
    e = other.select(F.col("c_custkey").alias("a"), F.col("o").alias("b")).union(other.where("c_nationkey % 2 = 0").select("o", "c_custkey")).distinct()
    there = e.join(c.select(F.col("c_custkey").alias("b")), "b", "left_semi").select("a", "b")
    one_way = there.join(e.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
    return e.join(c.select(F.col("c_custkey").alias("b")), "b", "left_anti").select(F.lit("dangling").alias("issue"), "a", "b").unionByName(one_way.select(F.lit("one way").alias("issue"), "a", "b"))


@query("semi_join_whitelist", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_whitelist(spark, d):
    good = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, d, "orders")
    return o.join(good, o.o_custkey == good.c_custkey, "left_semi").select("o_orderkey")


@query("set_ops", "SELECT 'both' AS kind, nk FROM (SELECT c_nationkey AS nk FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT 'only left', nk FROM (SELECT c_nationkey AS nk FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def set_ops(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nk"))
    b = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nk"))
    return a.intersect(b).select(F.lit("both").alias("kind"), "nk").unionByName(a.exceptAll(b).distinct().join(b, "nk", "left_anti").select(F.lit("only left").alias("kind"), "nk"))


@query("components", "WITH RECURSIVE e AS (SELECT c_custkey AS a, 1000000000 + CAST(floor(c_acctbal / 2) AS BIGINT) AS b FROM customer UNION SELECT c_custkey, 2000000000 + c_custkey * c_custkey % 1999 FROM customer), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(v, root) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.v AND r.root < u.b) SELECT v, min(root) AS root FROM r GROUP BY v")
def components(spark, d):
    """Customers joined by equal balances (to 2) or equal codes."""
    c = table(spark, d, "customer")
    one, two = 1_000_000_000 + F.floor(F.col("c_acctbal") / 2), 2_000_000_000 + F.col("c_custkey") * F.col("c_custkey") % 1999
    return graphs.components(c.select(F.col("c_custkey").alias("a"), F.explode(F.array(one, two)).alias("b")).distinct())


@query("components_all")
def components_all(spark, d):
    """Orders and suppliers joined by all lines."""
    li = table(spark, d, "lineitem")
    return graphs.components(li.select((F.col("l_orderkey") * 10).alias("a"), (F.col("l_suppkey") * 10 + 1).alias("b")).distinct())


@query("shortest_path", """WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b, CAST(1 + n_regionkey AS DOUBLE) AS w FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 1) % 25, 4.0 FROM nation), u AS (SELECT a, b, min(w) AS w FROM (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e) GROUP BY ALL),
p(v, dist, n) AS (SELECT 0, CAST(0 AS DOUBLE), 0 UNION SELECT b, dist + w, n + 1 FROM p JOIN u ON u.a = p.v WHERE n < 8) SELECT 0 AS src, v, min(dist) AS dist FROM p GROUP BY v""")
def shortest_path(spark, d):
    n = table(spark, d, "nation")
    e = n.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b"), (1.0 + F.col("n_regionkey")).alias("w"))
    e = e.unionByName(n.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") + 1) % 25).alias("b"), F.lit(4.0).alias("w")))
    return graphs.shortest_paths(e, spark.sql("select 0 as src"))


@query("regression_compare", """WITH m AS (SELECT o_orderpriority AS id, year(o_orderdate) AS y, avg(o_totalprice) AS median_cm, avg(CAST(o_totalprice > 300000 AS INT)) AS wrong FROM orders GROUP BY ALL), u AS (SELECT id, y, 'median_cm' AS metric, median_cm AS v FROM m UNION ALL SELECT id, y, 'wrong', wrong FROM m), j AS (SELECT c.id, c.y, c.metric, c.v, b.v AS base, CASE c.metric WHEN 'median_cm' THEN abs(b.v) * 0.01 + 100 ELSE 0.005 END AS tol FROM u c LEFT JOIN u b ON b.id = c.id AND b.metric = c.metric AND b.y = c.y - 1)
SELECT id, y, metric, round(v, 6) AS v, CASE WHEN base IS NULL THEN 'new' WHEN v > base + tol THEN 'worse' WHEN v < base - tol THEN 'better' ELSE 'flat' END AS verdict FROM j""")
def regression_compare(spark, d):
    from lodepath.operators.evaluation import compare

    m = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("id"), F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("median_cm"), F.avg((F.col("o_totalprice") > 300000).cast("int")).alias("wrong"))
    base = m.withColumn("y", F.col("y") + 1)
    return compare(m, base, ["id", "y"], {"median_cm": (0.01, 100.0), "wrong": (0.0, 0.005)}).select("id", F.col("y").cast("bigint").alias("y"), "metric", r6("v").alias("v"), "verdict")


@query("ladder_level", "WITH m AS (SELECT l_suppkey AS id, avg(l_quantity) AS median_cm, avg(CAST(l_quantity > 45 AS INT)) AS wrong FROM lineitem GROUP BY 1), l AS (SELECT * FROM (VALUES (1, 'usable', 27.0, 0.12), (2, 'target', 25.5, 0.1), (3, 'top', 25.0, 0.09)) t(ord, level, hi, w)) SELECT m.id, coalesce(max_by(level, ord), 'none') AS level FROM m LEFT JOIN l ON median_cm <= hi AND wrong <= w GROUP BY m.id")
def ladder_level(spark, d):
    from lodepath.operators.evaluation import ladder

    m = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.avg("l_quantity").alias("median_cm"), F.avg((F.col("l_quantity") > 45).cast("int")).alias("wrong"))
    return ladder(m, "id", [("usable", {"median_cm": 27.0, "wrong": 0.12}), ("target", {"median_cm": 25.5, "wrong": 0.1}), ("top", {"median_cm": 25.0, "wrong": 0.09})])


@query("newest_valid", f"WITH {EV} SELECT user_id, max_by(event_id, (t, event_id)) AS newest FROM ev WHERE value > 100 GROUP BY user_id")
def newest_valid(spark, d):
    return events(spark, d).where("value > 100").groupBy("user_id").agg(F.max_by("event_id", F.struct("t", "event_id")).alias("newest"))


@query("keep_newest", f"WITH {EV}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS n FROM ev) SELECT user_id, event_id FROM r WHERE n > 20")
def keep_newest(spark, d):
    """Retention: what is beyond the newest twenty of a key is to be deleted."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("t"), F.desc("event_id")))
    return events(spark, d).withColumn("n", n).where("n > 20").select("user_id", "event_id")


@query("pair_nearest_start", f"WITH {EV}, b AS (SELECT user_id, event_id, t FROM ev WHERE event_type = 'purchase'), c AS (SELECT user_id, event_id AS cid, t AS ct FROM ev WHERE event_type = 'view'), r AS (SELECT event_id, cid, row_number() OVER (PARTITION BY event_id ORDER BY abs(t - ct), cid) AS n FROM b LEFT JOIN c USING (user_id)) SELECT event_id, cid FROM r WHERE n = 1")
def pair_nearest_start(spark, d):
    """Each blind session with its pair's companion of the nearest start; without one it is kept with null."""
    e = events(spark, d)
    b = e.where("event_type = 'purchase'").select("user_id", "event_id", "t")
    c = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("cid"), "t")
    # of several companions of one time the least is wanted
    low = c.groupBy("user_id", "t").agg(F.min("cid").alias("cid"))
    both = alignment.bracket(b, low, ["user_id"], "t", ["cid"])
    back, fore = F.col("prev"), F.col("next")
    da, db = F.col("t") - back["_t"], fore["_t"] - F.col("t")
    pick = F.when(back.isNull(), fore["cid"]).when(fore.isNull(), back["cid"]).when(da < db, back["cid"]).when(db < da, fore["cid"]).otherwise(F.least(back["cid"], fore["cid"]))
    return both.select("event_id", pick.alias("cid"))


@query("sign_and_ids", "SELECT page_id, upper(substr(md5(url), 1, 2)) || '-' || upper(substr(md5(url), 3, 2)) || '-' || upper(substr(md5(url), 5, 2)) || '-' || upper(substr(md5(url), 7, 2)) AS tag, md5(url) || '_1' AS shelf FROM pages")
def sign_and_ids(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", sc.tag_id(F.substring(F.md5("url"), 1, 8)).alias("tag"), sc.shelf_name(F.md5("url")).alias("shelf"))
