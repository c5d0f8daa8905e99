"""Sources and sinks: the driver's tables are put in the form of files' lines and documents, decoded, and compared with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodepath.operators import grids
from lodepath.plans.common import EV, events, r6, shared_folder, table
from lodepath.plans.registry import query
from lodepath.sources import documents as dc
from lodepath.sources import package, sinks
from lodepath.sources import sessions as ss


def lines(e, header: str, *fields):
    """(session, line) of rows with a column user_id: a header a session, and a line a row."""
    session = F.concat(F.lit("u"), F.col("user_id"))
    head = e.select(session.alias("session")).distinct().select("session", F.lit(header + "\r").alias("line"))
    return head.unionAll(e.select(session.alias("session"), F.concat_ws(",", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]).alias("line")))


def lit(v):
    return F.lit(v)


@query("scan_imu", f"""WITH {EV}, b AS (SELECT *, user_id % 2 = 0 AS newer FROM ev)
SELECT 'u' || user_id AS session, t AS t_ms, value AS ax, CASE WHEN k % 7 = 0 THEN 0.0 ELSE CAST(k AS DOUBLE) END AS ay, CASE WHEN k % 5 <> 0 THEN 40.0 END AS mz, CASE WHEN newer AND k % 4 <> 0 THEN CAST(k AS DOUBLE) END AS heading_deg,
  CASE WHEN newer AND k % 2 = 0 THEN 9.8 END AS gravity, CASE WHEN newer AND k % 3 <> 0 THEN 0.5 END AS attitude FROM b""")
def scan_imu(spark, d):
    """Sessions of two format versions; cells that are no numbers, fields of zeros, gated gravity and attitude."""
    e, k = events(spark, d), F.col("k")
    old = [F.col("t"), F.col("value"), F.when(k % 7 == 0, "x").otherwise(k.cast("string")), lit(1), lit(0), lit(0), lit(0), *[F.when(k % 5 == 0, 0.0).otherwise(v) for v in (k + 1.0, F.col("value"), lit(40.0))]]
    quat = F.when(k % 3 == 0, 0.0).otherwise(0.5)
    new = [*old, lit(2), quat, quat, quat, quat, F.when(k % 4 == 0, -1).otherwise(k), lit(0), lit(0), F.when(k % 2 == 0, 9.8).otherwise(30.0)]
    head = "t_ms,ax,ay,az,gx,gy,gz,mx,my,mz"
    both = lines(e.where("user_id % 2 = 1"), head, *old).unionAll(lines(e.where("user_id % 2 = 0"), head + ",mag_acc,qw,qx,qy,qz,heading_deg,gvx,gvy,gvz", *new))
    r = ss.imu(ss.decoded(both, "imu"))
    return r.select("session", "t_ms", "ax", "ay", F.col("field.mz").alias("mz"), "heading_deg", F.col("gravity.z").alias("gravity"), F.col("attitude.w").alias("attitude"))


@query("scan_imu_with_gravity", f"WITH {EV} SELECT 'u' || user_id AS session, t AS t_ms, CASE WHEN k % 2 = 0 THEN 9.8 ELSE CAST(k AS DOUBLE) END AS up FROM ev")
def scan_imu_with_gravity(spark, d):
    e, k = events(spark, d), F.col("k")
    l = lines(e, "t_ms,ax,ay,az,gx,gy,gz,mx,my,mz,gvx,gvy,gvz", F.col("t"), lit(0), lit(0), k, *[lit(0)] * 6, lit(0), lit(0), F.when(k % 2 == 0, 9.8).otherwise(99.0))
    return ss.with_gravity(ss.imu(ss.decoded(l, "imu"))).select("session", "t_ms", F.col("gravity.z").alias("up"))


@query("scan_ble", f"WITH {EV} SELECT 'u' || user_id AS session, t AS t_ms, 'e' || k AS esl_id, -k - 40 AS rssi FROM ev WHERE k % 5 <> 0 AND -k - 40 >= -127")
def scan_ble(spark, d):
    e, k = events(spark, d), F.col("k")
    l = lines(e, "t_ms,point_id,esl_id,rssi,src,mfg_hex", F.col("t"), lit("p"), F.when(k % 5 == 0, "").otherwise(F.concat(lit("e"), k)), -k - 40, lit("s"), lit(""))
    return ss.ble(ss.decoded(l, "ble")).select("session", "t_ms", "esl_id", "rssi")


@query("scan_wifi", f"WITH {EV}, w AS (SELECT user_id, t // 86400000 AS day, 'ap' || (k % 6) AS bssid, max(-k) AS rssi FROM ev WHERE k % 11 <> 0 GROUP BY ALL) SELECT 'u' || user_id AS session, day * 86400000 AS t_ms, count(*) AS aps, max(rssi) AS strongest, string_agg(bssid || rssi, ' ' ORDER BY bssid) AS levels FROM w GROUP BY ALL")
def scan_wifi(spark, d):
    """Access points in any case and with blanks; a scan's strongest reading of each."""
    e, k = events(spark, d), F.col("k")
    name = F.when(k % 2 == 0, F.concat(lit(" AP"), k % 6, lit(" "))).otherwise(F.concat(lit("ap"), k % 6))
    l = lines(e, "t_ms,bssid,rssi,freq", F.floor(F.col("t") / 86400000) * 86400000, name, F.when(k % 11 == 0, "bad").otherwise((-k).cast("string")), lit(""))
    m = F.map_entries("levels")
    return ss.wifi_scans(ss.wifi(ss.decoded(l, "wifi"))).select("session", "t_ms", F.size("levels").cast("bigint").alias("aps"), F.array_max(F.map_values("levels")).alias("strongest"), F.array_join(F.transform(m, lambda x: F.concat(x["key"], x["value"])), " ").alias("levels"))


@query("scan_truth", f"WITH {EV}, g AS (SELECT user_id, t, value AS x_cm, k FROM ev WHERE k % 3 <> 0), n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM g) SELECT 'u' || user_id AS session, t AS t_ms, x_cm, CAST(k AS DOUBLE) AS y_cm FROM n WHERE n >= 2")
def scan_truth(spark, d):
    e, k = events(spark, d), F.col("k")
    l = lines(e, "t_ms,x_cm,y_cm", F.col("t"), F.col("value"), F.when(k % 3 == 0, "-").otherwise(k.cast("string")))
    return ss.truth(ss.decoded(l, "truth")).select("session", "t_ms", "x_cm", "y_cm")


@query("scan_heading_signs", f"WITH {EV} SELECT 'u' || user_id AS session, t AS t_ms, CAST(k AS DOUBLE) - 5 AS deg FROM ev WHERE k >= 5 UNION ALL SELECT 'u' || user_id, t, value FROM ev WHERE event_type = 'view'")
def scan_heading_signs(spark, d):
    e = events(spark, d)
    h = lines(e, "t_ms,magnetic_deg,true_deg,accuracy_deg,x,y,z", F.col("t"), lit(1), F.col("k") - 5, *[lit(0)] * 4)
    s = lines(e.where("event_type = 'view'"), "t_ms,text,x_cm,y_cm", F.col("t"), lit("\"Aisle 4, left\""), F.col("value"), lit(0))
    signs = ss.decoded(s, "signs").where("text = 'Aisle 4, left'")
    return ss.headings(ss.decoded(h, "heading")).unionAll(signs.select("session", "t_ms", F.col("x_cm").alias("deg")))


@query("scan_live_track", f"WITH {EV} SELECT 'u' || user_id AS session, t AS t_ms, value + CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS x_cm, CAST(k AS DOUBLE) + CASE WHEN user_id % 3 = 0 THEN 0 ELSE 7.5 END AS y_cm FROM ev")
def scan_live_track(spark, d):
    """The first five columns of a live track, in the map's present frame."""
    e = events(spark, d)
    t = ss.decoded(lines(e, "t_ms,x_cm,y_cm,unc_cm,conf", F.col("t"), F.col("value"), F.col("k"), lit(1), lit(1)), "track")
    u = F.col("user_id")
    metas = e.select("user_id").distinct().select(F.concat(lit("u"), u).alias("session"), F.when(u % 3 != 0, F.array(u.cast("double"), lit(7.5))).alias("map_origin_offset_cm"))
    return ss.shifted(t, metas, "x_cm", "y_cm").select("session", "t_ms", "x_cm", "y_cm")


@query("scan_quality", "WITH n AS (SELECT n_nationkey AS n FROM nation WHERE n_nationkey % 4 <> 0) SELECT 's' || n AS session, n % 2 = 0 AS kept, n * 10 AS start_ms, n * 10 + 5 AS end_ms FROM n UNION ALL SELECT 's' || n, n % 2 = 0, 0, 1 FROM n")
def scan_quality(spark, d):
    n = F.col("n_nationkey")
    doc = F.when(n % 4 == 0, "{broken").otherwise(F.format_string('{"score": 5, "kept": %s, "reason": null, "droppedSpansMs": [[%d, %d], [0, 1]]}', (n % 2 == 0).cast("string"), n * 10, n * 10 + 5))
    kept, spans = ss.quality_of(table(spark, d, "nation").select(F.concat(lit("s"), n).alias("session"), doc.alias("doc")))
    return kept.join(spans, "session").select("session", "kept", F.col("start_ms").cast("int").alias("start_ms"), F.col("end_ms").cast("int").alias("end_ms"))


@query("classify_sessions", """WITH s AS (SELECT o_orderkey AS session, CASE o_orderkey % 5 WHEN 0 THEN 'blind' WHEN 1 THEN 'companion' END AS role, o_orderkey % 3 = 0 AS survey FROM orders), f AS (SELECT o_orderkey AS session, CASE WHEN o_orderkey % 2 = 0 THEN 'anchors.csv' ELSE 'truth.csv' END AS name FROM orders WHERE o_orderkey % 7 <> 0)
SELECT session, CASE WHEN role IS NOT NULL THEN role WHEN survey AND name = 'anchors.csv' THEN 'build' WHEN name = 'truth.csv' THEN 'test' ELSE 'none' END AS kind FROM s LEFT JOIN f USING (session)""")
def classify_sessions(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("session"))
    s = F.col("session")
    metas = o.select("session", F.when(s % 5 == 0, "blind").when(s % 5 == 1, "companion").alias("role"), (s % 3 == 0).alias("survey"))
    files = o.where("session % 7 <> 0").select("session", F.when(s % 2 == 0, "anchors.csv").otherwise("truth.csv").alias("name"))
    return ss.classify(metas, files)


@query("trace_streams", f"""WITH {EV} SELECT 'u' || user_id AS session, t AS t_ms, 'acc' AS stream, value AS x FROM ev WHERE event_type = 'click' UNION ALL SELECT 'u' || user_id, t, 'waypoint', CAST(k AS DOUBLE) FROM ev WHERE event_type = 'view' UNION ALL SELECT 'u' || user_id, t, 'wifi', CAST(-k AS DOUBLE) FROM ev WHERE event_type NOT IN ('click', 'view') AND k * 100 <= 5000""")
def trace_streams(spark, d):
    """Public traces: type by line; Wi-Fi rows last seen over 5 s ago go."""
    e, k = events(spark, d), F.col("k")
    tab = lambda *c: F.concat_ws("\t", *c)
    line = F.when(F.col("event_type") == "click", tab(F.col("t"), lit("TYPE_ACCELEROMETER"), F.col("value"), lit("0"), lit("0"))).when(F.col("event_type") == "view", tab(F.col("t"), lit("TYPE_WAYPOINT"), k, lit("1"))).otherwise(tab(F.col("t"), lit("TYPE_WIFI"), lit("ssid"), lit("AA"), -k, lit("2400"), F.col("t") - k * 100))
    l = e.select(F.concat(lit("u"), F.col("user_id")).alias("session"), line.alias("line"))
    s = ss.traces(l.unionAll(l.limit(1).select("session", lit("#\thead\tline").alias("line"))))
    part = lambda n, c: s[n].select("session", "t_ms", lit(n).alias("stream"), F.col(c).cast("double").alias("x"))
    return part("acc", "x").unionAll(part("waypoint", "x")).unionAll(part("wifi", "rssi"))


@query("scan_fingerprints", "SELECT 'f' || (p_partkey % 9) AS source, CAST(p_size % 3 AS VARCHAR) AS floor, 'p' || p_partkey AS num, p_retailprice AS x, 's' || p_size AS shelf, CAST(-p_size AS DOUBLE) AS low FROM part WHERE p_size % 3 = 1")
def scan_fingerprints(spark, d):
    """One document a source, points by floor, one floor read."""
    p = table(spark, d, "part")
    point = F.struct(F.concat(lit("p"), "p_partkey").alias("num"), F.col("p_retailprice").alias("x"), lit(0.0).alias("y"), F.array(lit("n1")).alias("neighbourIds"), F.array(F.struct(F.concat(lit("s"), "p_size").alias("shelfCode"), (-F.col("p_size")).cast("double").alias("minRSSI"), lit(0.0).alias("maxRSSI"), lit("t").alias("type"))).alias("data"))
    by = p.groupBy(F.concat(lit("f"), F.col("p_partkey") % 9).alias("source"), (F.col("p_size") % 3).cast("string").alias("floorId")).agg(F.collect_list(point).alias("fingerprintList"))
    docs = by.groupBy("source").agg(F.to_json(F.collect_list(F.struct("floorId", "fingerprintList"))).alias("doc"))
    return dc.fingerprints(docs, "1").select("source", "floor", "num", "x", "shelf", "low")


@query("scan_goods", "WITH g AS (SELECT DISTINCT ps % 5 AS src, p_brand AS sku, 'e' || p_partkey AS tag, p_partkey FROM (SELECT *, p_partkey AS ps FROM part)) SELECT 'g' || src AS source, sku, count(*) AS n, min(tag) AS first FROM g GROUP BY ALL")
def scan_goods(spark, d):
    """Even sources flat, odd ones nested."""
    p = table(spark, d, "part").select((F.col("p_partkey") % 5).alias("src"), F.col("p_brand").alias("sku"), F.concat(lit("e"), "p_partkey").alias("tag"))
    flat = p.where("src % 2 = 0").groupBy("src").agg(F.to_json(F.collect_list(F.struct("sku", F.col("tag").alias("eslId")))).alias("doc"))
    nested = p.where("src % 2 = 1").groupBy("src", "sku").agg(F.collect_list("tag").alias("eslIds")).groupBy("src").agg(F.to_json(F.collect_list(F.struct("sku", "eslIds"))).alias("doc"))
    g = dc.goods(flat.unionAll(nested).select(F.concat(lit("g"), "src").alias("source"), "doc"))
    return g.select("source", "sku", F.size("tags").cast("bigint").alias("n"), F.array_min("tags").alias("first"))


GRID = "c AS (SELECT l_suppkey % 4 AS session, CAST(floor(l_quantity / 10) AS INT) AS row, CAST(floor(l_discount * 100 / 3 + 1e-9) AS INT) AS col, l_extendedprice / 1000 AS b FROM lineitem), g AS (SELECT session, row, col, count(*) AS n, avg(b) AS mean FROM c GROUP BY ALL)"


def grid(spark, d):
    li = table(spark, d, "lineitem")
    c = li.select((F.col("l_suppkey") % 4).alias("session"), F.floor(F.col("l_quantity") / 10).cast("int").alias("row"), F.floor(F.col("l_discount") * 100 / 3 + 1e-9).cast("int").alias("col"), (F.col("l_extendedprice") / 1000).alias("b"))
    return grids.aggregate(c, ["session", "row", "col"], ["b"])


@query("grid_document", f"WITH {GRID} SELECT 'm' || session AS source, row, col, round(mean, 2) AS mean, n FROM g")
def grid_document(spark, d):
    """Grids as JSON documents in an envelope, with nulls for empty cells, and read again."""
    doc = sinks.grid_json(grid(spark, d), ["session"], 6, 4, ["mean_b", "mean_b", "mean_b"])
    envelope = F.to_json(F.struct(lit(0).alias("code"), lit("ok").alias("message"), F.concat(lit('{"magField": '), "doc", lit("}")).alias("data")))
    m = dc.maps(doc.select(F.concat(lit("m"), "session").alias("source"), dc.unwrapped(envelope).alias("doc")))
    return m["cells"].select("source", "row", "col", F.col("total").alias("mean"), F.col("n").cast("bigint").alias("n"))


@query("package_round_trip", f"WITH {GRID} SELECT 'm' || session AS map, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(round(mean, 3), 2) AS total, 1.5 AS vertical, CAST(least(n, 327) AS DOUBLE) AS horizontal FROM g")
def package_round_trip(spark, d):
    """Field sections of each session's grid, packed to files' bytes, stored in the shared folder and read again."""
    g = grid(spark, d).withColumn("map", F.concat(lit("m"), "session")).withColumn("i", F.col("row") * 4 + F.col("col"))
    values = [F.round("mean_b", 3), lit(1.5), F.least("n", lit(327)), lit(0.5), lit(0.5), lit(0.5)]
    field = package.field_section(g.select("map", "i", *[v.cast("double").alias(n) for v, n in zip(values, package.VALUES, strict=True)]), "map", 400.0, 600.0, 100.0)
    meta = g.select("map").distinct().select("map", lit("meta").alias("kind"), F.encode(F.concat(lit('{"mapId":"'), "map", lit('"}')), "UTF-8").alias("content"))
    path = f"{shared_folder(spark)}/packages-{uuid.uuid4().hex}"
    package.packed(field.unionByName(meta), "map").write.parquet(path)
    return package.field_cells(package.unpacked(spark.read.parquet(path), "map"), "map").select("map", "row", "col", "total", "vertical", "horizontal")


@query("csv_round_trip", f"WITH {EV} SELECT event_id, user_id, round(value, 6) AS value, event_type || ', \"' || k || '\"' AS note FROM ev")
def csv_round_trip(spark, d):
    """Quotes and commas in cells, written by the CSV sink to the shared folder and read again."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    note = F.concat("event_type", lit(', "'), "k", lit('"'))
    sinks.csv(events(spark, d).select("event_id", "user_id", "value", note.alias("note")), path)
    back = spark.read.option("header", True).option("quote", '"').option("escape", '"').schema("event_id bigint, user_id bigint, value double, note string").csv(path)
    return back.withColumn("value", r6("value"))


@query("truth_export", f"""WITH RECURSIVE {EV}, one AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n FROM (SELECT DISTINCT user_id, t FROM ev)), k(user_id, n, last, kept) AS (SELECT user_id, n, t, true FROM one WHERE n = 1 UNION ALL SELECT o.user_id, o.n, CASE WHEN o.t - k.last >= 100000000 THEN o.t ELSE k.last END, o.t - k.last >= 100000000 FROM k JOIN one o ON o.user_id = k.user_id AND o.n = k.n + 1)
SELECT 'u' || user_id AS session, last AS t_ms FROM k WHERE kept""")
def truth_export(spark, d):
    """Truth written to CSV at least so many ms apart (10^8 here for 100), and read again."""
    path = f"{shared_folder(spark)}/truth-{uuid.uuid4().hex}"
    e = events(spark, d).select(F.concat(lit("u"), "user_id").alias("session"), F.col("t").alias("t_ms")).distinct()
    sinks.truth_csv(e, path, 100_000_000)
    return spark.read.option("header", True).schema("session string, t_ms bigint").csv(path)


@query("log_lines", f"WITH {EV} SELECT event_id AS t, 'd' || user_id AS device FROM ev WHERE event_type IN ('click', 'view') AND ('d' || user_id || ' ' || event_type || ' msg ' || k) LIKE '%iew msg 1%'")
def log_lines(spark, d):
    """NDJSON lines written to the shared folder, read, and searched by level and text in any case."""
    path = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    e = events(spark, d).select(F.concat(lit("d"), "user_id").alias("device"), F.col("event_id").alias("t"), F.col("event_type").alias("level"), F.upper("event_type").alias("cat"), F.concat(lit("Msg "), "k").alias("msg"))
    e.write.json(path)
    logs = spark.read.schema("device string, t bigint, level string, cat string, msg string").json(path)
    return ss.log_filter(logs, ["click", "view"], "IEW msg 1").select("t", "device")
