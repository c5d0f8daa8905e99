"""Window and sequence operators over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodepath.functions import scalars as sc
from lodepath.operators import sequences as sq
from lodepath.plans.common import EV, events, r6, table
from lodepath.plans.registry import query

DAY = 86_400_000
#: One row for each time of a session, so that orders are total.
ONE = "one AS (SELECT user_id, t, max(value) AS value, max(k) AS k FROM ev GROUP BY ALL)"


def single(spark, d):
    return events(spark, d).groupBy("user_id", "t").agg(F.max("value").alias("value"), F.max("k").alias("k"))


@query("tap_groups", f"""WITH {EV}, {ONE}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w BETWEEN {DAY // 24} AND {DAY // 2} THEN 0 ELSE 1 END AS n FROM one WINDOW w AS (PARTITION BY user_id ORDER BY t)), i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t) AS island FROM g)
SELECT user_id, min(t) AS start, max(t) AS "end" FROM i GROUP BY user_id, island HAVING count(*) = 3""")
def tap_groups(spark, d):
    """Runs of exactly three rows whose gaps are in a range."""
    g = sq.gap_groups(single(spark, d), ["user_id"], "t", DAY // 24, DAY // 2)
    return g.groupBy("user_id", "island").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n")).where("n = 3").select("user_id", "start", "end")


WIN = f"w AS (SELECT user_id, (t - min(t) OVER (PARTITION BY user_id)) // {DAY} AS win, value FROM ev), f AS (SELECT user_id, win, avg(value) > 330 AS bad, avg(value) < 150 AS good, count(*) AS n FROM w GROUP BY ALL)"


def windows(spark, d):
    w = sq.tumbling_from_first(events(spark, d), ["user_id"], "t", DAY)
    return w.groupBy("user_id", F.col("window").alias("win")).agg((F.avg("value") > 330).alias("bad"), (F.avg("value") < 150).alias("good"), F.count("*").alias("n"))


@query("island_spans", f"WITH {EV}, {WIN}, r AS (SELECT user_id, win, win - row_number() OVER (PARTITION BY user_id ORDER BY win) AS g FROM f WHERE bad) SELECT user_id, min(win) AS start, max(win) + 1 AS \"end\" FROM r GROUP BY user_id, g")
def island_spans(spark, d):
    return sq.true_spans(windows(spark, d), ["user_id"], "win", "bad")


SPINE = "s AS (SELECT user_id, unnest(range(a, b + 1)) AS win FROM (SELECT user_id, min(win) AS a, max(win) AS b FROM f GROUP BY user_id)), j AS (SELECT s.user_id, s.win, coalesce(bad, false) AS bad, coalesce(good, false) AS good FROM s LEFT JOIN f USING (user_id, win))"


@query("dilate_flags", f"WITH {EV}, {WIN}, {SPINE} SELECT user_id, win, bool_or(bad) OVER (PARTITION BY user_id ORDER BY win ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS dilated FROM j")
def dilate_flags(spark, d):
    return sq.dilate(windows(spark, d), ["user_id"], "win", "bad").select("user_id", "win", "dilated")


@query("bridge_flags", f"WITH {EV}, {WIN}, {SPINE} SELECT user_id, win, good OR (NOT bad AND bool_or(good) OVER w AND NOT bool_or(bad) OVER w) AS trusted FROM j WINDOW w AS (PARTITION BY user_id ORDER BY win ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def bridge_flags(spark, d):
    return sq.bridge(windows(spark, d), ["user_id"], "win", "good", "bad").select("user_id", "win", "trusted")


@query("window10_from_first", f"WITH {EV} SELECT user_id, win, count(*) AS n, round(median(value), 6) AS med FROM (SELECT user_id, value, (t - min(t) OVER (PARTITION BY user_id)) // {10 * DAY} AS win FROM ev) GROUP BY ALL")
def window10_from_first(spark, d):
    w = sq.tumbling_from_first(events(spark, d), ["user_id"], "t", 10 * DAY)
    return w.groupBy("user_id", F.col("window").alias("win")).agg(F.count("*").alias("n"), r6(F.median("value")).alias("med"))


@query("ttff_hold", f"""WITH {EV}, {ONE}, i AS (SELECT *, value < 300 AS ok, CASE WHEN lag(value < 300) OVER w IS DISTINCT FROM (value < 300) THEN 1 ELSE 0 END AS n FROM one WINDOW w AS (PARTITION BY user_id ORDER BY t)), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t) AS island FROM i), h AS (SELECT user_id, min(t) AS a FROM (SELECT user_id, island, min(t) AS t, max(t) AS b FROM r WHERE ok GROUP BY ALL) WHERE b - t >= {DAY} GROUP BY user_id)
SELECT u.user_id, h.a AS at FROM (SELECT DISTINCT user_id FROM one) u LEFT JOIN h USING (user_id)""")
def ttff_hold(spark, d):
    """The first time that a condition begins to hold for a day."""
    return sq.first_hold(single(spark, d).withColumn("ok", F.col("value") < 300), ["user_id"], "t", "ok", DAY)


@query("onset_count", f"WITH {EV}, {ONE} SELECT user_id, CAST(sum(CASE WHEN value > 400 AND NOT coalesce(p > 400, false) THEN 1 ELSE 0 END) AS BIGINT) AS onsets FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY t) AS p FROM one) GROUP BY user_id")
def onset_count(spark, d):
    s = single(spark, d).withColumn("bad", F.col("value") > 400)
    return s.withColumn("o", sq.onsets("bad", ["user_id"], "t")).groupBy("user_id").agg(F.sum("o").alias("onsets"))


@query("door_latency", f"""WITH {EV}, {ONE}, p AS (SELECT *, k // 34 AS room, CAST(floor(value / 170) AS INT) AS seen FROM one), n AS (SELECT *, sum(CASE WHEN c THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS stay FROM (SELECT *, coalesce(lag(room) OVER (PARTITION BY user_id ORDER BY t) <> room, false) AS c FROM p)), q AS (SELECT *, sum(CASE WHEN seen = room THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, stay ORDER BY t) AS run FROM n),
g AS (SELECT user_id, stay, min(a) AS a FROM (SELECT user_id, stay, run, min(t) AS a, max(t) AS b FROM q WHERE seen = room GROUP BY ALL) WHERE b - a >= {DAY // 4} GROUP BY ALL), s AS (SELECT user_id, stay, min(t) AS "at", min(room) AS room FROM n WHERE stay > 0 GROUP BY ALL)
SELECT s.user_id, s."at", s.room, CASE WHEN a - s."at" <= {5 * DAY} THEN a - s."at" END AS latency FROM s LEFT JOIN g USING (user_id, stay)""")
def door_latency(spark, d):
    from lodepath.operators.evaluation import transitions

    p = single(spark, d).withColumn("room", F.floor(F.col("k") / 34).cast("int")).withColumn("seen", F.floor(F.col("value") / 170).cast("int"))
    return transitions(p, ["user_id"], "t", "room", "seen", DAY // 4, 5 * DAY)


@query("path_and_jumps", f"""WITH {EV}, {ONE}, s AS (SELECT *, sqrt(pow(value - lag(value) OVER w, 2) + pow(k - lag(k) OVER w, 2)) AS step FROM one WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, round(sum(CASE WHEN step < 300 THEN step ELSE 0 END), 4) AS path, CAST(sum(CASE WHEN step > 300 THEN 1 ELSE 0 END) AS BIGINT) AS jumps FROM s GROUP BY user_id""")
def path_and_jumps(spark, d):
    p = sq.path_length(single(spark, d), ["user_id"], "t", "value", "k", 300.0)
    return p.groupBy("user_id").agg(F.round(F.max("path"), 4).alias("path"), F.sum(F.coalesce(F.col("step") > 300, F.lit(False)).cast("int")).alias("jumps"))


@query("moving_average", f"WITH {EV}, {ONE} SELECT user_id, t, round(avg(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM one")
def moving_average(spark, d):
    return single(spark, d).select("user_id", "t", r6(sq.moving_average("value", ["user_id"], "t", 5)).alias("smooth"))


@query("rolling_stats", f"WITH {EV}, {ONE} SELECT user_id, t, round(avg(value) OVER w, 6) AS mean, CAST(count(*) OVER w * sum(v * v) OVER w - pow(sum(v) OVER w, 2) AS BIGINT) AS nnvar FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS v FROM one) WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {3 * DAY} PRECEDING AND CURRENT ROW)")
def rolling_stats(spark, d):
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-3 * DAY, 0)
    v, n = F.round(F.col("value") * 100).cast("bigint"), F.count("*").over(w)
    return single(spark, d).select("user_id", "t", r6(F.avg("value").over(w)).alias("mean"), (n * F.sum(v * v).over(w) - F.sum(v).over(w) * F.sum(v).over(w)).alias("nnvar"))


@query("peak_times", f"""WITH {EV}, {ONE}, l AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b, (lead(t) OVER w - lag(t) OVER w) / 2.0 AS dt FROM one WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, t, round(t + CASE WHEN a - 2 * value + b <> 0 THEN 0.5 * (a - b) / (a - 2 * value + b) ELSE 0 END * dt, 2) AS at FROM l WHERE value >= 350 AND value >= a AND value > b""")
def peak_times(spark, d):
    return sq.peaks(single(spark, d), ["user_id"], "t", "value", 350.0).select("user_id", "t", F.round("at", 2).alias("at"))


@query("thinning", f"""WITH RECURSIVE {EV}, {ONE}, r AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n FROM one), f(user_id, n, t, last) AS (SELECT user_id, n, t, t FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.n, r.t, CASE WHEN r.t - f.last >= {2 * DAY} THEN r.t ELSE f.last END FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
SELECT user_id, t FROM f WHERE t = last""")
def thinning(spark, d):
    return sq.thin(single(spark, d), ["user_id"], "t", 2 * DAY)


@query("low_pass", f"""WITH RECURSIVE {EV}, {ONE}, r AS (SELECT user_id, t, value, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n FROM one), f(user_id, n, t, s) AS (SELECT user_id, n, t, value FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.n, r.t, CASE WHEN r.t - f.t > {3 * DAY} THEN r.value ELSE f.s + (r.t - f.t) / ({DAY}.0 + (r.t - f.t)) * (r.value - f.s) END FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
SELECT user_id, t, round(s, 6) AS smooth FROM f""")
def low_pass(spark, d):
    return sq.low_pass(single(spark, d), ["user_id"], "t", "value", float(DAY), 3.0 * DAY).select("user_id", "t", r6("smooth").alias("smooth"))


@query("arc_resample", f"""WITH {EV}, {ONE}, s AS (SELECT *, coalesce(sqrt(pow(value - lag(value) OVER w, 2) + pow(k - lag(k) OVER w, 2)), 0) AS step FROM one WINDOW w AS (PARTITION BY user_id ORDER BY t)), p AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY t) AS path FROM s)
SELECT user_id, CAST(floor(path / 1000) AS BIGINT) AS bin, round(avg(value), 6) AS mean FROM p GROUP BY ALL""")
def arc_resample(spark, d):
    p = sq.path_length(single(spark, d), ["user_id"], "t", "value", "k")
    return sq.resample(p, ["user_id"], "path", "value", 1000.0).select("user_id", "bin", r6("mean").alias("mean"))


@query("window_match", f"""WITH {EV}, {ONE}, q AS (SELECT user_id, t, list(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s FROM one), f AS (SELECT user_id, t, list_transform(s, lambda x: x - list_avg(s)) AS fwd FROM q WHERE len(s) = 4), m AS (SELECT a.user_id, a.t, list_sum(list_transform(range(1, 5), lambda i: pow(a.fwd[i] - b.fwd[i], 2))) AS sf, list_sum(list_transform(range(1, 5), lambda i: pow(a.fwd[i] - b.fwd[5 - i], 2))) AS sr FROM f a JOIN f b ON a.user_id = b.user_id AND a.t <> b.t)
SELECT user_id, t, round(least(min(sf), min(sr)), 4) AS sse FROM m GROUP BY ALL""")
def window_match(spark, d):
    """Each window's best match among the session's other windows, either way round."""
    s = sq.subsequences(single(spark, d), ["user_id"], "t", "value", 4)
    a, b = s.select("user_id", "t", "fwd"), s.select("user_id", F.col("t").alias("u"), F.col("fwd").alias("f2"), F.col("rev").alias("r2"))
    sse = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, v: acc + v)
    m = a.join(b, "user_id").where("t <> u").withColumn("e", F.least(sse("fwd", "f2"), sse("fwd", "r2")))
    return m.groupBy("user_id", "t").agg(F.round(F.min("e"), 4).alias("sse"))


@query("recent_scores", f"WITH {EV}, {ONE} SELECT user_id, t, round(avg(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS recent FROM one WHERE k >= 20")
def recent_scores(spark, d):
    s = single(spark, d).withColumn("counted", F.col("k") >= 20)
    return sq.recent_scores(s, ["user_id"], "t", "value", "counted").select("user_id", "t", r6("recent").alias("recent"))


@query("travel_direction", f"""WITH {EV}, {ONE}, l AS (SELECT *, value - lag(value, 3) OVER w AS dx, k - lag(k, 3) OVER w AS dy FROM one WINDOW w AS (PARTITION BY user_id ORDER BY t)), h AS (SELECT user_id, t, CASE WHEN sqrt(dx * dx + dy * dy) >= 100 THEN atan2(dx, dy) END AS a FROM l)
SELECT user_id, t, round(last_value(a IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t), 6) AS heading FROM h""")
def travel_direction(spark, d):
    """Heading of the displacement over three rows; the last known one where it is too short."""
    w = Window.partitionBy("user_id").orderBy("t")
    dx, dy = F.col("value") - F.lag("value", 3).over(w), F.col("k") - F.lag("k", 3).over(w)
    h = single(spark, d).withColumn("a", F.when(F.hypot(dx, dy) >= 100, F.atan2(dx, dy)))
    return h.select("user_id", "t", r6(F.last("a", ignorenulls=True).over(w)).alias("heading"))


@query("report_trend", "WITH m AS (SELECT o_orderpriority AS id, year(o_orderdate) AS y, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY ALL) SELECT id, max(v) FILTER (WHERE y = 1993) AS y1993, max(v) FILTER (WHERE y = 1994) AS y1994, max(v) FILTER (WHERE y = 1995) AS y1995 FROM m GROUP BY id")
def report_trend(spark, d):
    g = table(spark, d, "orders").select(F.col("o_orderpriority").alias("id"), F.concat(F.lit("y"), F.year("o_orderdate")).alias("y"), "o_totalprice")
    return g.groupBy("id").pivot("y", ["y1993", "y1994", "y1995"]).agg(F.round(F.avg("o_totalprice"), 4))


@query("repeat_suppression", f"WITH {EV} SELECT event_id FROM (SELECT event_id, t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS gap FROM ev) WHERE gap IS NULL OR gap >= {DAY}")
def repeat_suppression(spark, d):
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("user_id", "event_type").orderBy("t", "event_id"))
    return events(spark, d).withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") >= DAY)).select("event_id")


@query("json_envelope", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, 'k' || json_extract_string(props, '$.k') AS label FROM events")
def json_envelope(spark, d):
    from lodepath.sources.documents import unwrapped

    e = table(spark, d, "events").withColumn("doc", F.concat(F.lit('{"code":0,"success":true,"data":'), F.to_json(F.struct(F.col("props").alias("s"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("props").alias("s")))) - 6), F.lit("}")))
    inner = e.select("event_id", unwrapped(F.col("doc")).alias("j"))
    return inner.select("event_id", F.get_json_object("j", "$.k").cast("int").alias("k"), F.concat(F.lit("k"), F.get_json_object("j", "$.k")).alias("label"))


@query("date_keys", "WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS t FROM events) SELECT event_id, strftime(make_timestamp(t * 1000), '%Y-%m-%d') AS day, (1706659200000 - t) // 86400000 AS age FROM e")
def date_keys(spark, d):
    e = events(spark, d)
    return e.select("event_id", F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd").alias("day"), sc.age_days(F.lit(1706659200000), F.col("t")).alias("age"))


@query("altitude_and_angles", f"WITH {EV} SELECT event_id, round(44330.0 * (1 - pow((950 + k) / 1013.25, 1 / 5.255)), 4) AS alt, round(least((value % 180), 180 - (value % 180)), 6) AS line FROM ev")
def altitude_and_angles(spark, d):
    return events(spark, d).select("event_id", F.round(sc.altitude(F.col("k") + 950, 1013.25), 4).alias("alt"), r6(F.degrees(sc.line_angle(F.radians("value"), F.lit(0.0)))).alias("line"))


@query("search_destinations", "SELECT p_partkey FROM part WHERE p_name ILIKE '%an%' OR p_brand ILIKE '%an%' ORDER BY p_partkey LIMIT 60")
def search_destinations(spark, d):
    """A search box's first sixty hits (the report's own limit)."""
    return table(spark, d, "part").where(F.col("p_name").ilike("%an%") | F.col("p_brand").ilike("%an%")).select("p_partkey").orderBy("p_partkey").limit(60)


@query("reading_rate", f"WITH {EV}, g AS (SELECT t // {DAY} AS s, event_type, count(*) AS n, count(DISTINCT user_id) AS tags, sum(value) AS m FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY m DESC, event_type) AS i FROM g) SELECT s, event_type, n, tags, round(m, 2) AS total FROM r WHERE i <= 3")
def reading_rate(spark, d):
    g = events(spark, d).groupBy(F.floor(F.col("t") / DAY).alias("s"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("tags"), F.sum("value").alias("m"))
    i = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("m"), "event_type"))
    return g.withColumn("i", i).where("i <= 3").select("s", "event_type", "n", "tags", F.round("m", 2).alias("total"))
