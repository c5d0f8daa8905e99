"""Operators that other queries don't reach, over whole tables and over files written from them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodepath.functions import scalars as sc
from lodepath.operators import fusion, matching, production, radio, spatial, survey
from lodepath.plans.common import EV, events, r6, shared_folder, table
from lodepath.plans.registry import query
from lodepath.sources import documents, sessions, sinks
from lodepath.streaming import ledger


def folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- functions


@query("device_correction", f"WITH {EV} SELECT event_id, round((-value / 5) * (1 + k % 3 * 0.1) + (k % 5 - 2), 6) AS rssi FROM ev WHERE (-value / 5) * (1 + k % 3 * 0.1) + (k % 5 - 2) < 0 AND (-value / 5) * (1 + k % 3 * 0.1) + (k % 5 - 2) >= -127")
def device_correction(spark, d):
    """Each device's linear correction of raw readings; what is no reading after it goes."""
    e = events(spark, d).withColumn("rssi", sc.corrected_rssi(-F.col("value") / 5, 1 + F.col("k") % 3 * 0.1, F.col("k") % 5 - 2))
    return e.where(sc.valid_rssi(F.col("rssi"))).select("event_id", r6("rssi").alias("rssi"))


@query("name_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y%m%d') >= '19950101' AND strftime(o_orderdate, '%Y%m%d') < '19970101'")
def name_dates(spark, d):
    """Sessions by the date in their names, one of which is 2017_walk-20170321_a: the last run of eight digits that is a date."""
    name = F.concat(F.lit("walk-"), F.col("o_orderkey"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-a"))
    o = table(spark, d, "orders").select("o_orderkey", sc.name_day(name).alias("day"))
    return o.where("day >= '19950101' and day < '19970101'")


@query("standard_shelves", "SELECT p_partkey, shelf, standard FROM (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN 'A' || p_size || '#' || p_partkey % 7 WHEN p_partkey % 4 = 1 THEN 'B' || p_size || '_' || p_partkey % 7 WHEN p_partkey % 4 = 2 THEN 'X-' || p_size ELSE p_brand END AS code, replace(code, '#', '_') || CASE WHEN contains(code, '#') OR contains(code, '_') THEN '' ELSE '_1' END AS shelf, regexp_matches(shelf, '^[A-Z]{1,2}[0-9]{1,3}_[0-9]{1,3}$') AS standard FROM part)")
def standard_shelves(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    code = F.when(k % 4 == 0, F.concat(F.lit("A"), s, F.lit("#"), k % 7)).when(k % 4 == 1, F.concat(F.lit("B"), s, F.lit("_"), k % 7)).when(k % 4 == 2, F.concat(F.lit("X-"), s)).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", sc.shelf_name(code).alias("shelf")).withColumn("standard", sc.standard_shelf(F.col("shelf")))


@query("unit_quaternions", "SELECT l_orderkey, l_linenumber, round(w / n, 6) AS w, round(l_tax / n, 6) AS z FROM (SELECT *, 1 - l_discount AS w, sqrt(w * w + l_discount * l_discount + l_tax * l_tax) AS n FROM lineitem) WHERE abs(n - 1) <= 0.1")
def unit_quaternions(spark, d):
    """Attitudes scaled to length 1; those too far from it are no attitudes."""
    q = sc.gated_quaternion(1 - F.col("l_discount"), F.col("l_discount"), F.lit(0.0), F.col("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q")).where("q is not null").select("l_orderkey", "l_linenumber", r6("q.w").alias("w"), r6("q.z").alias("z"))


@query("plane_and_back", f"WITH {EV}, p AS (SELECT event_id, 59 + value / 1000 AS lat, 18 + k / 1000.0 AS lon FROM ev), e AS (SELECT *, radians(lon - 18) * 637813700 * cos(radians(59.0)) AS ea, -radians(lat - 59) * 637813700 AS so FROM p) SELECT event_id, round(ea * cos(0.4) - so * sin(0.4), 2) AS x, round(ea * sin(0.4) + so * cos(0.4), 2) AS y, round(lat, 8) AS lat, round(lon, 8) AS lon FROM e")
def plane_and_back(spark, d):
    """Places on a turned plane in cm, and from there back to degrees."""
    e = events(spark, d)
    x, y = sc.to_plane(59 + F.col("value") / 1000, 18 + F.col("k") / 1000, 59.0, 18.0, 0.4)
    p = e.select("event_id", x.alias("x"), y.alias("y"))
    lat, lon = sc.from_plane(F.col("x"), F.col("y"), 59.0, 18.0, 0.4)
    return p.select("event_id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round(lat, 8).alias("lat"), F.round(lon, 8).alias("lon"))


@query("sign_texts", "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN chr(CAST(65 + c_custkey % 26 AS INT)) || c_custkey % 40 END AS aisle, CASE WHEN c_custkey % 3 < 2 THEN CAST(c_custkey % 90 AS INT) END AS bay FROM customer")
def sign_texts(spark, d):
    """Aisle and bay as signs have them, in small letters too; other texts are no signs."""
    k = F.col("c_custkey")
    letter = F.when(k % 2 == 0, F.char(65 + k % 26)).otherwise(F.char(97 + k % 26))
    text = F.when(k % 3 == 0, F.concat(letter, k % 40, F.lit("-"), k % 90)).when(k % 3 == 1, F.concat(F.lit(" "), letter, F.lit(" "), k % 40, F.lit("/"), k % 90)).otherwise(F.concat(letter, F.lit("exit"), k))
    return table(spark, d, "customer").select("c_custkey", sc.aisle_bay(text).alias("s")).select("c_custkey", "s.aisle", "s.bay")


@query("language_pick", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'zh ' || p_brand WHEN 1 THEN p_name WHEN 2 THEN p_type END AS label FROM part")
def language_pick(spark, d):
    """Of names in several languages the one that comes first in the order of languages; else the first there is."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    names = F.when(k % 4 == 0, F.create_map(F.lit("en"), "p_name", F.lit("zh"), F.concat(F.lit("zh "), "p_brand"))).when(k % 4 == 1, F.create_map(F.lit("fr"), "p_type", F.lit("en"), "p_name")).when(k % 4 == 2, F.create_map(F.lit("fr"), "p_type", F.lit("sv"), "p_name"))
    return p.select("p_partkey", sc.label_of(names).alias("label"))


@query("site_labels", "SELECT DISTINCT n_name, substr(sha1(n_name), 1, 8) AS label FROM nation JOIN customer ON c_nationkey = n_nationkey")
def site_labels(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("n_name").distinct().select("n_name", sinks.site_label(F.col("n_name")).alias("label"))


# --- joins


@query("readings_at_shelves", f"WITH {EV}, t AS (SELECT p_partkey AS tag, p_brand AS shelf FROM part) SELECT shelf, count(*) AS n, round(avg(value), 6) AS mean, count(DISTINCT tag) AS tags FROM ev JOIN t ON tag = k + 1 GROUP BY shelf")
def readings_at_shelves(spark, d):
    """Readings by the shelf of their tag; tags that no shelf has are left out."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("tag"), F.col("p_brand").alias("shelf"))
    return radio.at_shelves(events(spark, d).withColumn("tag", F.col("k") + 1), t, "tag").groupBy("shelf").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), F.countDistinct("tag").alias("tags"))


@query("readings_at_tags", f"WITH {EV}, t AS (SELECT p_partkey AS tag, p_size * 10.0 AS x, p_retailprice / 10 AS y FROM part) SELECT user_id, count(*) AS n, round(sum(w * x) / sum(w), 5) AS x, round(sum(w * y) / sum(w), 5) AS y FROM (SELECT user_id, x, y, pow(10, (-value / 5) / 20) AS w FROM ev JOIN t ON tag = k + 1) GROUP BY user_id")
def readings_at_tags(spark, d):
    """Where each session was, by the places of the tags it heard, the louder ones more."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("tag"), (F.col("p_size") * 10.0).alias("x"), (F.col("p_retailprice") / 10).alias("y"))
    j = radio.at_shelves(events(spark, d).withColumn("tag", F.col("k") + 1), t, "tag").withColumn("w", F.pow(F.lit(10.0), (-F.col("value") / 5) / 20))
    mean = lambda c: F.round(F.sum(F.col("w") * F.col(c)) / F.sum("w"), 5).alias(c)
    return j.groupBy("user_id").agg(F.count("*").alias("n"), mean("x"), mean("y"))


@query("point_medians", f"WITH {EV}, m AS (SELECT user_id, k % 10 AS tag, event_type, count(*) AS n, median(value) AS med FROM ev GROUP BY ALL HAVING count(*) >= 2) SELECT a.user_id, a.tag, round(a.med, 6) AS ref, round(b.med, 6) AS tgt, a.n AS n_ref, b.n AS n_tgt FROM m a JOIN m b ON a.user_id = b.user_id AND a.tag = b.tag AND a.event_type = 'click' AND b.event_type = 'view'")
def point_medians(spark, d):
    """Medians of two devices by point and tag, where both have heard the tag there often enough."""
    e = events(spark, d).select("user_id", (F.col("k") % 10).alias("tag"), "event_type", "value")
    both = radio.paired_medians(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id", "tag"], "value", 2)
    return both.select("user_id", "tag", r6("ref").alias("ref"), r6("tgt").alias("tgt"), "n_ref", "n_tgt")


@query("corridor_junctions", """WITH c AS (SELECT s_suppkey AS corridor, (s_suppkey * 37 % 500) * 1.0 AS ax, (s_suppkey * 53 % 400) * 1.0 AS ay, ax + 200 * cos(radians(s_suppkey % 24 * 15 + 3.7)) AS bx, ay + 200 * sin(radians(s_suppkey % 24 * 15 + 3.7)) AS by_ FROM supplier),
p AS (SELECT p.corridor AS a, q.corridor AS b, p.ax, p.ay, p.bx - p.ax AS ux, p.by_ - p.ay AS uy, q.ax AS qx, q.ay AS qy, q.bx - q.ax AS vx, q.by_ - q.ay AS vy FROM c p JOIN c q ON p.corridor < q.corridor), t AS (SELECT *, ux * vy - uy * vx AS den FROM p WHERE abs(ux * vy - uy * vx) >= 0.05 * 40000),
w AS (SELECT *, greatest(0, least(1, ((qx - ax) * vy - (qy - ay) * vx) / den)) AS t, greatest(0, least(1, ((qx - ax) * uy - (qy - ay) * ux) / den)) AS w FROM t) SELECT a, b, round(t * 200, 4) AS at_a, round(w * 200, 4) AS at_b FROM w WHERE sqrt(pow(ax + ux * t - qx - vx * w, 2) + pow(ay + uy * t - qy - vy * w, 2)) <= 80""")
def corridor_junctions(spark, d):
    """Where corridors that aren't parallel meet, or nearly so."""
    from lodepath.plans.survey_queries import walls

    j = survey.junctions(walls(spark, d).withColumnRenamed("wall", "corridor"))
    return j.select("a", "b", F.round("at_a", 4).alias("at_a"), F.round("at_b", 4).alias("at_b"))


@query("vertices_near_track", f"WITH {EV}, v AS (SELECT l_orderkey AS o, l_linenumber AS n, (l_orderkey * 13 % 5000) * 1.0 + l_tax AS x, (l_partkey * 7 % 300) * 1.0 + l_discount AS y FROM lineitem), t AS (SELECT event_id, event_id * 50 % 5000 + value / 10 AS x, k * 3.0 AS y FROM ev), j AS (SELECT o, n, event_id, sqrt(pow(v.x - t.x, 2) + pow(v.y - t.y, 2)) AS d FROM v JOIN t ON abs(v.x - t.x) <= 30 AND abs(v.y - t.y) <= 30) SELECT o, n, round(min(d), 6) AS distance FROM j WHERE d <= 30 GROUP BY o, n")
def vertices_near_track(spark, d):
    """The nearest point of the track for each vertex of a mesh, within a reach."""
    l = table(spark, d, "lineitem")
    v = l.select(F.struct(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).alias("v"), F.lit(0).alias("s"), ((F.col("l_orderkey") * 13 % 5000) * 1.0 + F.col("l_tax")).alias("x"), ((F.col("l_partkey") * 7 % 300) * 1.0 + F.col("l_discount")).alias("y"))
    t = events(spark, d).select(F.col("event_id").alias("t"), F.lit(0).alias("s"), (F.col("event_id") * 50 % 5000 + F.col("value") / 10).alias("x"), (F.col("k") * 3.0).alias("y"))
    return spatial.nearest(v, t, ["s"], "v", "t", "x", "y", 30.0).select("v.o", "v.n", r6("distance").alias("distance"))


@query("connector_floors")
def connector_floors(spark, d):
    """Lifts and stairs of several floors that are one: suppliers are connectors of their nation's building."""
    k = F.col("s_suppkey")
    c = table(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("venue"), F.format_string("%06d", k).alias("id"), F.when(k % 3 == 0, "stairs").otherwise("elevator").alias("category"), (k * 11 % 4).cast("int").alias("ordinal"), (k * 37 % 60 * 100.0).alias("x"), (k * 53 % 40 * 100.0).alias("y"))
    return matching.connector_groups(c)


# --- sources and sinks


@query("tag_table", "SELECT 'T' || p_partkey AS tag, 'A' || p_size AS aisle, CAST(p_partkey % 30 AS VARCHAR) AS bay, p_brand AS sku, 'A' || p_size || '-' || p_partkey % 30 AS code FROM part")
def tag_table(spark, d):
    """A table of tags under headers of its own, written as CSV and read by its headers' words."""
    at, k = folder(spark, "tags"), F.col("p_partkey")
    sinks.csv(table(spark, d, "part").select(F.concat(F.lit("T"), k).alias("My ESL_ID"), F.concat(F.lit("A"), "p_size").alias(" Aisle "), (k % 30).alias("BAY no"), F.col("p_brand").alias("Product Code")), at)
    return documents.tag_locations(spark, at).select("tag", "aisle", "bay", "sku", "code")


@query("log_chunk_files", f"WITH {EV} SELECT 'd' || event_type AS device, 'u' || user_id AS level, count(*) AS n, min(event_id) AS low FROM ev WHERE t // 86400000 = (SELECT min(t // 86400000) + 3 FROM ev) GROUP BY ALL")
def log_chunk_files(spark, d):
    """Log lines written as JSON lines by day and device; then one day's, read by its folder."""
    e, at = events(spark, d), folder(spark, "logs")
    day = F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd")
    lines = e.select(day.alias("day"), F.concat(F.lit("d"), "event_type").alias("dev"), F.to_json(F.struct(F.concat(F.lit("d"), "event_type").alias("device"), F.col("t").alias("recv"), F.lit("log").alias("type"), "t", F.concat(F.lit("u"), "user_id").alias("level"), F.lit("c").alias("cat"), F.col("event_id").cast("string").alias("msg"))).alias("value"))
    lines.repartition("day").write.partitionBy("day", "dev").option("compression", "none").text(at)
    first = e.agg(F.date_format(F.timestamp_millis(F.min("t") + 3 * 86_400_000), "yyyy-MM-dd")).first()[0]
    got = sessions.log_files(spark, f"{at}/day={first}/*/*.txt")
    return got.groupBy("device", "level").agg(F.count("*").alias("n"), F.min(F.col("msg").cast("bigint")).alias("low"))


@query("report_json", "SELECT year(o_orderdate) AS y, count(*) AS n, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS worst FROM orders GROUP BY 1")
def report_json(spark, d):
    """Reports as JSON documents, one a year, written and read again."""
    at, o = folder(spark, "reports"), table(spark, d, "orders")
    rep = o.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.max("o_totalprice").alias("worst"))
    sinks.report_json(rep, at)
    return spark.read.text(at).select(F.from_json("value", "y bigint, n bigint, mean double, worst double").alias("r")).select("r.*")


@query("calibration_files", f"WITH {EV}, p AS (SELECT user_id, value AS x, value * 0.9 + k / 10.0 - 3 AS y FROM ev) SELECT user_id, count(*) AS n, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 4) AS intercept FROM p GROUP BY user_id")
def calibration_files(spark, d):
    """A device's calibration as JSON, from pairs that are written as CSV and read again."""
    at = folder(spark, "calibration")
    sinks.csv(events(spark, d).select("user_id", F.col("value").alias("x"), (F.col("value") * 0.9 + F.col("k") / 10 - 3).alias("y")), f"{at}/pairs")
    pairs = spark.read.option("header", True).schema("user_id bigint, x double, y double").csv(f"{at}/pairs")
    sinks.report_json(radio.linear_fit(pairs, ["user_id"], "x", "y"), f"{at}/fit")
    got = spark.read.text(f"{at}/fit").select(F.from_json("value", "user_id bigint, n bigint, slope double, intercept double").alias("r")).select("r.*")
    return got.select("user_id", "n", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("streamed_map_state", f"WITH {EV} SELECT CAST(floor(k * 5 / 50.0) AS BIGINT) AS row, CAST(floor(value / 50) AS BIGINT) AS col, count(*) AS n, round(avg(value), 9) AS mean FROM ev GROUP BY ALL")
def streamed_map_state(spark, d):
    """A map's grid folded from a stream of events, a file a batch, each batch once; the SQL aggregates all at once."""
    at, cols = folder(spark, "state"), "session string, x double, y double, value double, tag string, rssi double"
    src = events(spark, d).select(F.col("user_id").cast("string").alias("session"), F.col("value").alias("x"), (F.col("k") * 5.0).alias("y"), "value", F.col("event_type").alias("tag"), (-F.col("value") / 5).alias("rssi"))
    src.repartition(3).write.parquet(f"{at}/in")
    state = ledger.Ledger(spark, f"{at}/tables")
    ledger.run(spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), state, f"{at}/checkpoint", ledger.map_state(50.0))
    return state.table("grid").select("row", "col", "n", F.round("mean_value", 9).alias("mean"))


# --- jobs


@query("production_field")
def production_field(spark, d):
    """The field that sessions (twelve groups of suppliers, each with a level of its own) make together, as a job of stages."""
    s = table(spark, d, "lineitem").select((F.col("l_suppkey") % 12).alias("session"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("t"), (F.col("l_quantity") * 10).alias("x"), (F.col("l_discount") * 1000).alias("y"), (F.col("l_quantity") / 5 + F.col("l_tax") * 100 + F.col("l_suppkey") % 12 * 3).alias("value"))
    out, _ = production.production(spark, s, folder(spark, "production"), d, window_ms=30 * 86_400_000, most_error=12.0)
    return out["field"].select("row", "col", "n", r6("mean").alias("mean"))


@query("poses_on_map", f"""WITH {EV}, one AS (SELECT user_id, t, max(value) AS x, max(k) AS y FROM ev GROUP BY ALL), a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n FROM one), an AS (SELECT user_id, t, x * 3 + 100 AS mx, y * 3 - 50 AS my, x * 3 AS ax, y * 3 AS az FROM a WHERE n % 5 = 1),
sg AS (SELECT * FROM (SELECT *, lead(t) OVER w AS t1, lead(mx) OVER w AS nmx, lead(my) OVER w AS nmy FROM an WINDOW w AS (PARTITION BY user_id ORDER BY t)) WHERE t1 IS NOT NULL AND sqrt(pow(nmx - mx, 2) + pow(nmy - my, 2)) >= 100),
j AS (SELECT p.user_id, p.t, p.x * 3 + 100 AS map_x, p.y * 3 - 50 AS map_y, s.t1 FROM one p ASOF LEFT JOIN sg s ON p.user_id = s.user_id AND p.t >= s.t) SELECT user_id, t, round(CASE WHEN t <= t1 THEN map_x END, 4) AS map_x, round(CASE WHEN t <= t1 THEN map_y END, 4) AS map_y FROM j""")
def poses_on_map(spark, d):
    """Poses put on the map by segments between anchors, which here are a shift, so every pose is shifted."""
    from pyspark.sql import Window

    one = events(spark, d).groupBy("user_id", "t").agg(F.max("value").alias("x"), F.max("k").cast("double").alias("y"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("t"))
    a = one.withColumn("n", n).where("n % 5 = 1").select("user_id", F.col("t").alias("t_ms"), (F.col("x") * 3 + 100).alias("map_x_cm"), (F.col("y") * 3 - 50).alias("map_y_cm"), (F.col("x") * 3).alias("ar_x_cm"), (F.col("y") * 3).alias("ar_z_cm"))
    p = one.select("user_id", "t", (F.col("x") * 3).alias("px"), (F.col("y") * 3).alias("py"))
    got = fusion.to_map(p, fusion.segments(a, ["user_id"], 100.0), ["user_id"], "t", "px", "py")
    return got.select("user_id", "t", F.round("map_x", 4).alias("map_x"), F.round("map_y", 4).alias("map_y"))
