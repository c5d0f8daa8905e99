"""Aggregations and quantile conventions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodepath.functions import quantiles as qt
from lodepath.functions import scalars as sc
from lodepath.operators import radio, sequences
from lodepath.plans.common import EV, events, r6, table
from lodepath.plans.registry import query

KEYS = ["user_id", "event_type"]


@query("q_nearest_rank", f"""WITH {EV}, g AS (SELECT user_id, event_type, list_sort(list(value)) AS v FROM ev GROUP BY ALL)
SELECT user_id, event_type, round(v[least(CAST(floor((len(v) - 1) * 0.5 + 0.5) AS INT), len(v) - 1) + 1], 6) AS p50, round(v[least(CAST(floor((len(v) - 1) * 0.9 + 0.5) AS INT), len(v) - 1) + 1], 6) AS p90 FROM g""")
def q_nearest_rank(spark, d):
    got = qt.order_statistics(events(spark, d), KEYS, "value", {"p50": lambda n: qt.nearest_rank(n, 0.5), "p90": lambda n: qt.nearest_rank(n, 0.9)})
    return got.select(*KEYS, r6("p50").alias("p50"), r6("p90").alias("p90"))


@query("q_linear", f"WITH {EV} SELECT user_id, event_type, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.25), 6) AS p25 FROM ev GROUP BY ALL")
def q_linear(spark, d):
    return events(spark, d).groupBy(*KEYS).agg(r6(qt.linear("value", 0.9)).alias("p90"), r6(qt.linear("value", 0.25)).alias("p25"))


@query("q_upper_median", f"WITH {EV}, g AS (SELECT user_id, event_type, list_sort(list(value)) AS v FROM ev GROUP BY ALL) SELECT user_id, event_type, round(v[len(v) // 2 + 1], 6) AS med FROM g")
def q_upper_median(spark, d):
    return qt.order_statistics(events(spark, d), KEYS, "value", {"med": qt.upper_middle}).select(*KEYS, r6("med").alias("med"))


@query("q_averaged_median", f"WITH {EV} SELECT user_id, event_type, round(median(value), 6) AS med FROM ev GROUP BY ALL")
def q_averaged_median(spark, d):
    return events(spark, d).groupBy(*KEYS).agg(r6(qt.averaged_median("value")).alias("med"))


@query("q_trunc", f"WITH {EV}, g AS (SELECT user_id, event_type, list_sort(list(value)) AS v FROM ev GROUP BY ALL) SELECT user_id, event_type, round(v[least(CAST(floor(len(v) * 0.9) AS INT), len(v) - 1) + 1], 6) AS p90 FROM g")
def q_trunc(spark, d):
    return qt.order_statistics(events(spark, d), KEYS, "value", {"p90": lambda n: qt.truncated(n, 0.9)}).select(*KEYS, r6("p90").alias("p90"))


@query("q_weighted", """WITH s AS (SELECT l_suppkey, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY v) AS run, sum(w) OVER (PARTITION BY l_suppkey) AS tot FROM s)
SELECT l_suppkey, round(min(v), 6) AS p80 FROM c WHERE run >= 0.8 * tot GROUP BY l_suppkey""")
def q_weighted(spark, d):
    return qt.weighted_quantile(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity", 0.8, "p").select("l_suppkey", r6("p").alias("p80"))


@query("tag_ranges", """WITH b AS (SELECT l_suppkey, CAST(floor(l_quantity / 10) AS BIGINT) AS bin, l_extendedprice AS v FROM lineitem), q AS (
  SELECT l_suppkey, bin, count(*) AS n, quantile_disc(v, 0.5) AS r FROM b GROUP BY ALL)
SELECT l_suppkey, bin, n, round(max(r) OVER (PARTITION BY l_suppkey ORDER BY bin), 6) AS range FROM q WHERE n >= 3""")
def tag_ranges(spark, d):
    """Range by signal bin: a quantile of each bin with enough samples, made monotone along the bins."""
    from pyspark.sql import Window

    b = table(spark, d, "lineitem").select("l_suppkey", F.floor(F.col("l_quantity") / 10).alias("bin"), F.col("l_extendedprice").alias("v"), F.lit(1).alias("one"))
    q = qt.weighted_quantile(b, ["l_suppkey", "bin"], "v", "one", 0.5, "r").join(b.groupBy("l_suppkey", "bin").agg(F.count("*").alias("n")), ["l_suppkey", "bin"]).where("n >= 3")
    return q.select("l_suppkey", "bin", "n", r6(F.max("r").over(Window.partitionBy("l_suppkey").orderBy("bin"))).alias("range"))


@query("weighted_centroid", f"""WITH {EV}, r AS (SELECT user_id AS tag, -30 - k AS rssi, value AS x, k * 3.0 AS y FROM ev), c AS (SELECT tag, count(*) AS n, sum(pow(10, (rssi + 100) / 10.0) * x) / sum(pow(10, (rssi + 100) / 10.0)) AS x, sum(pow(10, (rssi + 100) / 10.0) * y) / sum(pow(10, (rssi + 100) / 10.0)) AS y FROM r GROUP BY tag),
s AS (SELECT r.tag, count(*) AS m, sqrt(avg(pow(r.x - c.x, 2) + pow(r.y - c.y, 2))) AS sd FROM r JOIN c USING (tag) WHERE rssi >= -85 GROUP BY r.tag)
SELECT c.tag, c.n, round(c.x, 4) AS x, round(c.y, 4) AS y, CASE WHEN s.m >= 5 THEN round(sd, 4) END AS spread, coalesce(s.m >= 5 AND sd > 150, false) AS moving FROM c LEFT JOIN s USING (tag)""")
def weighted_centroid(spark, d):
    r = events(spark, d).select(F.col("user_id").alias("tag"), (-30 - F.col("k")).alias("rssi"), F.col("value").alias("x"), (F.col("k") * 3.0).alias("y"))
    return radio.tag_centroids(r, moving=150).select("tag", "n", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("spread", 4).alias("spread"), "moving")


@query("circular_mean", f"WITH {EV} SELECT user_id, round(atan2(sum(sin(a)), sum(cos(a))), 6) AS mean, round(sqrt(pow(sum(sin(a)), 2) + pow(sum(cos(a)), 2)) / count(*), 6) AS r FROM (SELECT user_id, (t % 86400000) / 86400000.0 * 2 * pi() AS a FROM ev) GROUP BY user_id")
def circular_mean(spark, d):
    e = events(spark, d).withColumn("a", (F.col("t") % 86_400_000) / 86_400_000.0 * 2 * F.pi())
    s, c = F.sum(F.sin("a")), F.sum(F.cos("a"))
    return e.groupBy("user_id").agg(r6(F.atan2(s, c)).alias("mean"), r6(F.sqrt(s * s + c * c) / F.count("*")).alias("r"))


@query("regr_calibration", f"""WITH {EV}, a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n, value FROM ev WHERE event_type = 'click'), b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n, value FROM ev WHERE event_type = 'view')
SELECT user_id, count(*) AS n, round(CASE WHEN var_pop(a.value) > 0 THEN covar_pop(a.value, b.value) / var_pop(a.value) ELSE 1 END, 6) AS slope, round(avg(b.value) - CASE WHEN var_pop(a.value) > 0 THEN covar_pop(a.value, b.value) / var_pop(a.value) ELSE 1 END * avg(a.value), 6) AS intercept FROM a JOIN b USING (user_id, n) GROUP BY user_id""")
def regr_calibration(spark, d):
    from lodepath.operators.alignment import occurrence_pairs

    e = events(spark, d).withColumn("o", F.struct("t", "event_id"))
    p = occurrence_pairs(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id"], "o", "value")
    return radio.linear_fit(p, ["user_id"], "a_value", "b_value").select("user_id", "n", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query("bin_agreement", f"""WITH {EV}, a AS (SELECT user_id, k % 7 AS p, row_number() OVER (PARTITION BY user_id, k % 7 ORDER BY t, event_id) AS n, value FROM ev WHERE event_type = 'click'), b AS (SELECT user_id, k % 7 AS p, row_number() OVER (PARTITION BY user_id, k % 7 ORDER BY t, event_id) AS n, value FROM ev WHERE event_type = 'view')
SELECT p, round(avg(CAST(floor(a.value / 50) = floor(b.value / 50) AS INT)), 6) AS raw, round(avg(CAST(floor(a.value / 50) = floor((b.value + 25) / 50) AS INT)), 6) AS shifted FROM a JOIN b USING (user_id, p, n) GROUP BY p""")
def bin_agreement(spark, d):
    from lodepath.operators.alignment import occurrence_pairs

    e = events(spark, d).withColumn("o", F.struct("t", "event_id")).withColumn("p", F.col("k") % 7)
    p = occurrence_pairs(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id", "p"], "o", "value")
    same = lambda off: r6(F.avg((F.floor(F.col("a_value") / 50) == F.floor((F.col("b_value") + off) / 50)).cast("int")))
    return p.groupBy("p").agg(same(0).alias("raw"), same(25).alias("shifted"))


@query("first_max_wins", f"""WITH {EV}, p AS (SELECT user_id, value AS a, lead(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS b FROM ev), r AS (SELECT user_id, o, avg(CAST(floor(a / 100) = floor((b + o) / 100) AS INT)) AS agree FROM p, (SELECT unnest(range(-20, 21)) AS o) WHERE b IS NOT NULL GROUP BY user_id, o), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY agree DESC, o) AS n FROM r)
SELECT user_id, CAST(o AS INT) AS "offset", round(agree, 6) AS agree FROM k WHERE n = 1""")
def first_max_wins(spark, d):
    from pyspark.sql import Window

    p = events(spark, d).withColumn("b", F.lead("value").over(Window.partitionBy("user_id").orderBy("t", "event_id"))).where("b is not null")
    return radio.offset_search(p.select("user_id", F.col("value").alias("a"), "b"), ["user_id"], "a", "b", -20, 20, 100.0).select("user_id", "offset", r6("agree").alias("agree"))


@query("two_level_max_of_mean", "SELECT l_suppkey, l_returnflag, round(max(m), 6) AS best FROM (SELECT l_suppkey, l_returnflag, l_linenumber, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL) GROUP BY ALL")
def two_level_max_of_mean(spark, d):
    return radio.two_level(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], "l_linenumber", "l_extendedprice").select("l_suppkey", "l_returnflag", r6("best").alias("best"))


@query("interval_union", "SELECT l_suppkey, l_returnflag, min(l_discount) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY GROUPING SETS ((l_suppkey, l_returnflag), (l_suppkey))")
def interval_union(spark, d):
    return radio.interval_union(table(spark, d, "lineitem"), [["l_suppkey", "l_returnflag"], ["l_suppkey"]], "l_discount", "l_extendedprice")


@query("seconds_spine", f"""WITH {EV}, c AS (SELECT user_id, t // 86400000 AS day, count(DISTINCT event_type) AS n FROM ev GROUP BY ALL), s AS (SELECT user_id, unnest(range(a, b + 1)) AS day FROM (SELECT user_id, min(t // 86400000) AS a, max(t // 86400000) AS b FROM ev GROUP BY user_id))
SELECT user_id, day, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (user_id, day)""")
def seconds_spine(spark, d):
    """Distinct channels by time bin, bins without rows kept."""
    e = events(spark, d).withColumn("day", F.floor(F.col("t") / 86_400_000))
    c = e.groupBy("user_id", "day").agg(F.countDistinct("event_type").alias("n"))
    return sequences.spine(e, ["user_id"], "day").join(c, ["user_id", "day"], "left").select("user_id", "day", F.coalesce("n", F.lit(0)).alias("n"))


@query("pooled_ratios", "SELECT o_orderpriority, count(*) AS n, round(sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) / count(*), 6) AS high, round(CASE WHEN sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) = 0 THEN NULL ELSE sum(CASE WHEN o_orderstatus = 'P' AND o_totalprice > 200000 THEN 1 ELSE 0 END) / sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) END, 6) AS high_p FROM orders GROUP BY ALL")
def pooled_ratios(spark, d):
    o = table(spark, d, "orders")
    hi, p = (F.col("o_totalprice") > 200000).cast("int"), (F.col("o_orderstatus") == "P").cast("int")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), r6(F.avg(hi)).alias("high"), r6(F.try_divide(F.sum(hi * p), F.sum(p))).alias("high_p"))


@query("grouping_sets_report", f"""WITH {EV}, a AS (SELECT event_type, CASE WHEN age <= 0 THEN '0' WHEN age <= 7 THEN '1-7' WHEN age <= 30 THEN '8-30' ELSE '>30' END AS bucket, value FROM (SELECT *, CAST(floor(((SELECT max(t) FROM ev) - t) / 86400000.0) AS BIGINT) AS age FROM ev))
SELECT event_type, bucket, count(*) AS n, round(avg(value), 6) AS mean FROM a GROUP BY GROUPING SETS ((), (bucket), (event_type))""")
def grouping_sets_report(spark, d):
    e = events(spark, d)
    last = e.agg(F.max("t").alias("last"))
    a = e.crossJoin(F.broadcast(last)).select("event_type", "value", sc.age_bucket(sc.age_days(F.col("last"), F.col("t"))).alias("bucket"))  # one row
    return a.groupingSets([[], [F.col("bucket")], [F.col("event_type")]], "event_type", "bucket").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query("pooled_points", f"""WITH {EV}, s AS (SELECT user_id, list(value) AS errors FROM ev GROUP BY user_id), p AS (SELECT unnest(errors) AS e FROM s), o AS (SELECT list_sort(list(e)) AS v FROM p)
SELECT (SELECT count(*) FROM s) AS replays, len(v) AS points, round(v[least(CAST(floor((len(v) - 1) * 0.5 + 0.5) AS INT), len(v) - 1) + 1], 6) AS median_cm, round((SELECT avg(CAST(e > 400 AS INT)) FROM p), 6) AS wrong FROM o""")
def pooled_points(spark, d):
    """Metrics over all points of all sessions, not means of sessions' metrics."""
    e = events(spark, d)
    med = qt.order_statistics(e.withColumn("g", F.lit(1)), ["g"], "value", {"median_cm": lambda n: qt.nearest_rank(n, 0.5)})
    tot = e.agg(F.countDistinct("user_id").alias("replays"), F.count("*").alias("points"), r6(F.avg((F.col("value") > 400).cast("int"))).alias("wrong")).withColumn("g", F.lit(1))
    return tot.join(med, "g").select("replays", "points", r6("median_cm").alias("median_cm"), "wrong")


@query("session_summary", f"""WITH {EV}, s AS (SELECT event_type, user_id, median(value) AS m, sum(CAST(value > 480 AS INT)) AS jumps, (max(t) - min(t)) / 60000.0 AS minutes FROM ev GROUP BY ALL)
SELECT event_type, round(median(m), 6) AS med, round(sum(jumps) / sum(minutes), 9) AS jumps_per_min FROM s GROUP BY event_type""")
def session_summary(spark, d):
    s = events(spark, d).groupBy("event_type", "user_id").agg(F.median("value").alias("m"), F.sum((F.col("value") > 480).cast("int")).alias("jumps"), ((F.max("t") - F.min("t")) / 60000.0).alias("minutes"))
    return s.groupBy("event_type").agg(r6(F.median("m")).alias("med"), F.round(F.sum("jumps") / F.sum("minutes"), 9).alias("jumps_per_min"))


@query("median_wander", f"""WITH {EV}, w AS (SELECT user_id, (t - min(t) OVER (PARTITION BY user_id)) // 259200000 AS w, value, k FROM ev), m AS (SELECT user_id, w, median(value) AS mv, median(k) AS mk FROM w GROUP BY ALL HAVING count(*) >= 5)
SELECT user_id, round(greatest(max(mv) - min(mv), max(mk) - min(mk)), 6) AS wander FROM m GROUP BY user_id""")
def median_wander(spark, d):
    w = sequences.tumbling_from_first(events(spark, d), ["user_id"], "t", 259_200_000)
    m = w.groupBy("user_id", "window").agg(F.count("*").alias("n"), F.median("value").alias("mv"), F.median("k").alias("mk")).where("n >= 5")
    return m.groupBy("user_id").agg(r6(F.greatest(F.max("mv") - F.min("mv"), F.max("mk") - F.min("mk"))).alias("wander"))


@query("running_bias", f"""WITH {EV}, s AS (SELECT user_id, t // 86400000 AS sec, avg(value) AS m FROM ev GROUP BY ALL), w AS (SELECT user_id, sec, list_sort(list(m) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)) AS v FROM s)
SELECT user_id, sec, CASE WHEN len(v) >= 5 THEN round(v[len(v) // 2 + 1], 6) END AS bias FROM w""")
def running_bias(spark, d):
    """Means by second, then the upper median of those of the last ten, from five on."""
    from pyspark.sql import Window

    s = events(spark, d).groupBy("user_id", F.floor(F.col("t") / 86_400_000).alias("sec")).agg(F.avg("value").alias("m"))
    v = F.sort_array(F.collect_list("m").over(Window.partitionBy("user_id").orderBy("sec").rangeBetween(-9, 0)))
    return s.withColumn("v", v).select("user_id", "sec", F.when(F.size("v") >= 5, r6(F.element_at("v", F.floor(F.size("v") / 2).cast("int") + 1))).alias("bias"))


@query("bias_jumps", f"WITH {EV}, s AS (SELECT user_id, t // 86400000 AS sec, avg(value) AS m FROM ev GROUP BY ALL), l AS (SELECT *, lag(sec) OVER w AS ps, lag(m) OVER w AS pm FROM s WINDOW w AS (PARTITION BY user_id ORDER BY sec)) SELECT user_id, sec, round(m - pm, 6) AS jump FROM l WHERE sec - ps = 1 AND abs(m - pm) > 200")
def bias_jumps(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("sec")
    s = events(spark, d).groupBy("user_id", F.floor(F.col("t") / 86_400_000).alias("sec")).agg(F.avg("value").alias("m"))
    s = s.withColumn("ps", F.lag("sec").over(w)).withColumn("jump", F.col("m") - F.lag("m").over(w))
    return s.where((F.col("sec") - F.col("ps") == 1) & (F.abs("jump") > 200)).select("user_id", "sec", r6("jump").alias("jump"))


@query("issue_histogram", f"WITH {EV}, r AS (SELECT CASE WHEN value < 50 THEN 'low' WHEN k IS NULL THEN 'missing' WHEN k > 90 THEN 'edge' WHEN value > 450 THEN 'high' END AS reason FROM ev) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason ORDER BY n DESC, reason LIMIT 2")
def issue_histogram(spark, d):
    """The first failing rule drops a row; the two most frequent reasons (the report's own limit)."""
    reason = F.when(F.col("value") < 50, "low").when(F.col("k").isNull(), "missing").when(F.col("k") > 90, "edge").when(F.col("value") > 450, "high")
    return events(spark, d).select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(2)


@query("lag_autocorr", f"""WITH {EV}, c AS (SELECT user_id, t, event_id, value - avg(value) OVER (PARTITION BY user_id) AS dv FROM ev), l AS (SELECT user_id, dv, lead(dv, 1) OVER w AS l1, lead(dv, 2) OVER w AS l2, lead(dv, 3) OVER w AS l3 FROM c WINDOW w AS (PARTITION BY user_id ORDER BY t * 1000000 + event_id)), s AS (SELECT user_id, sum(dv * dv) AS q, sum(dv * l1) AS c1, sum(dv * l2) AS c2, sum(dv * l3) AS c3 FROM l GROUP BY user_id)
SELECT user_id, lag, round(r, 6) AS r FROM (SELECT user_id, unnest([1, 2, 3]) AS lag, unnest([c1 / q, c2 / q, c3 / q]) AS r FROM s)""")
def lag_autocorr(spark, d):
    e = events(spark, d).withColumn("o", F.col("t") * 1_000_000 + F.col("event_id"))
    return sequences.autocorrelation(e, ["user_id"], "o", "value", 3).select("user_id", "lag", r6("r").alias("r"))


@query("consensus_pick", f"""WITH {EV}, b AS (SELECT event_type, user_id, avg(k) AS bearing, count(*) AS w FROM ev GROUP BY ALL), s AS (SELECT a.event_type, a.user_id, a.bearing, sum(c.w) AS support FROM b a JOIN b c ON a.event_type = c.event_type AND abs(a.bearing - c.bearing) <= 2 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY support DESC, user_id) AS n FROM s)
SELECT event_type, user_id, CAST(support AS BIGINT) AS support, round(bearing, 6) AS bearing FROM r WHERE n = 1""")
def consensus_pick(spark, d):
    """The element with the greatest weight of others within a tolerance: found in a sorted window, not by pairs."""
    from pyspark.sql import Window

    b = events(spark, d).groupBy("event_type", "user_id").agg(F.avg("k").alias("bearing"), F.count("*").alias("w"))
    near = F.sum("w").over(Window.partitionBy("event_type").orderBy("bearing").rangeBetween(-2, 2))
    best = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("support"), "user_id"))
    return b.withColumn("support", near).withColumn("n", best).where("n = 1").select("event_type", "user_id", "support", r6("bearing").alias("bearing"))


@query("dominant_direction", f"WITH {EV} SELECT user_id, round(atan2(sum(value * sin(4 * radians(k))), sum(value * cos(4 * radians(k)))) / 4, 6) AS axis FROM ev GROUP BY user_id")
def dominant_direction(spark, d):
    a = F.radians("k") * 4
    return events(spark, d).groupBy("user_id").agg(r6(F.atan2(F.sum(F.col("value") * F.sin(a)), F.sum(F.col("value") * F.cos(a))) / 4).alias("axis"))
