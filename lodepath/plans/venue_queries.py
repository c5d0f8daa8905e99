"""Venue geometry, protocols and versioned storage."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lodepath.operators import spatial
from lodepath.plans.common import EV, events, r6, table
from lodepath.plans.registry import query


@query("unit_adjacency", """WITH u AS (SELECT n_nationkey AS u, (n_nationkey % 5) * 100.0 AS x0, (n_nationkey // 5) * 130.0 AS y0 FROM nation) SELECT a.u AS a, b.u AS b, round(sqrt(pow(greatest(abs(a.x0 - b.x0) - 80, 0), 2) + pow(greatest(abs(a.y0 - b.y0) - 80, 0), 2)), 6) AS gap FROM u a JOIN u b ON a.u < b.u WHERE sqrt(pow(greatest(abs(a.x0 - b.x0) - 80, 0), 2) + pow(greatest(abs(a.y0 - b.y0) - 80, 0), 2)) <= 60""")
def unit_adjacency(spark, d):
    """Squares of 80 on a lattice, as outlines."""
    x, y = (F.col("n_nationkey") % 5) * 100.0, F.floor(F.col("n_nationkey") / 5) * 130.0
    e = lambda a, b, c, f: F.struct((x + a).alias("ax"), (y + b).alias("ay"), (x + c).alias("bx"), (y + f).alias("by"))
    edges = table(spark, d, "nation").select(F.col("n_nationkey").alias("u"), F.explode(F.array(e(0, 0, 80, 0), e(80, 0, 80, 80), e(80, 80, 0, 80), e(0, 80, 0, 0))).alias("e")).select("u", "e.*")
    return spatial.adjacent(edges, "u", 60.0).select("a", "b", r6("gap").alias("gap"))


@query("parallel_corridors", f"""WITH {EV}, c AS (SELECT user_id AS c, avg(k) * 7 % 180 AS deg, sum(value) AS len FROM ev GROUP BY user_id) SELECT a.c AS a, b.c AS b FROM c a JOIN c b ON a.c < b.c AND abs(a.len - b.len) <= 0.1 * greatest(a.len, b.len) AND least((a.deg - b.deg + 360) % 180, 180 - (a.deg - b.deg + 360) % 180) <= 10.000001 ORDER BY a, b LIMIT 400""")
def parallel_corridors(spark, d):
    """Pairs of nearly parallel corridors of nearly equal length, the first 400 (the report's own limit)."""
    c = events(spark, d).groupBy(F.col("user_id").alias("c")).agg(F.radians((F.avg("k") * 7) % 180).alias("heading"), F.sum("value").alias("length"))
    return spatial.parallels(c, "c", math.radians(10.000001), 0.1, 400)


@query("walk_once_protocol", f"""WITH {EV}, s AS (SELECT user_id, event_type, min(t // 86400000) AS day FROM ev GROUP BY ALL), p AS (SELECT b.event_type AS build, c.event_type AS test, b.user_id FROM s b JOIN s c ON b.user_id = c.user_id AND b.event_type <> c.event_type AND b.day <> c.day), f AS (SELECT b.event_type AS build, c.event_type AS test, b.user_id FROM s b JOIN s c ON b.user_id = c.user_id AND b.event_type <> c.event_type WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = c.user_id AND p.test = c.event_type))
SELECT user_id, build, test FROM p UNION ALL SELECT user_id, build, test FROM f""")
def walk_once_protocol(spark, d):
    """Each test session with builds of other days; if there are none, with all others."""
    s = events(spark, d).groupBy("user_id", "event_type").agg(F.min(F.floor(F.col("t") / 86_400_000)).alias("day"))
    b, c = s.select("user_id", F.col("event_type").alias("build"), F.col("day").alias("bd")), s.select("user_id", F.col("event_type").alias("test"), F.col("day").alias("td"))
    pairs = b.join(c, "user_id").where("build <> test")
    good = pairs.where("bd <> td")
    rest = pairs.join(good.select("user_id", "test").distinct(), ["user_id", "test"], "left_anti")
    return good.select("user_id", "build", "test").unionByName(rest.select("user_id", "build", "test"))


@query("versioned_put", "WITH n AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders GROUP BY o_custkey), s AS (SELECT c_custkey AS k, c_custkey * 10 AS v FROM customer) SELECT coalesce(s.k, n.k) AS k, CASE WHEN n.v IS NULL OR s.v > n.v THEN s.v ELSE n.v END AS v FROM s FULL JOIN n USING (k)")
def versioned_put(spark, d):
    from lodepath.sources.sinks import put_versioned

    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") * 10).alias("v"))
    return put_versioned(s, n, "k", "v")[0]


@query("occupant_units", "SELECT s_suppkey AS unit, n_name, r_name, max_by(c_name, c_custkey) AS occupant FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_custkey % 100 = s_suppkey % 100 AND c_nationkey = s_nationkey GROUP BY ALL")
def occupant_units(spark, d):
    """A chain of lookups; of several occupants the last one stays."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    j = s.join(c, (F.col("c_custkey") % 100 == F.col("s_suppkey") % 100) & (F.col("c_nationkey") == F.col("s_nationkey")), "left")
    return j.groupBy(F.col("s_suppkey").alias("unit"), "n_name", "r_name").agg(F.max_by("c_name", "c_custkey").alias("occupant"))


@query("mean_over_seeds", f"WITH {EV}, r AS (SELECT user_id, k % 5 AS seed, avg(value) AS v FROM ev GROUP BY ALL) SELECT user_id, count(*) AS seeds, round(avg(v), 6) AS mean FROM r GROUP BY user_id")
def mean_over_seeds(spark, d):
    r = events(spark, d).groupBy("user_id", (F.col("k") % 5).alias("seed")).agg(F.avg("value").alias("v"))
    return r.groupBy("user_id").agg(F.count("*").alias("seeds"), r6(F.avg("v")).alias("mean"))
