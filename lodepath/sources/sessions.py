"""Recorded sessions: one folder (or zip) of CSV files and a meta.json each, read as tables keyed by `session`.

Files of all format versions are read with the newest schema; columns that a version lacks are null. A file that no
session has gives an empty table. Cells that aren't numbers are null, but in IMU rows 0, as recorders write them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodepath.functions import scalars as sc

D, L, I, S = T.DoubleType(), T.LongType(), T.IntegerType(), T.StringType()
COLUMNS: dict[str, dict[str, T.DataType]] = {
    "imu": {"t_ms": L, **dict.fromkeys("ax ay az gx gy gz mx my mz".split(), D), "mag_acc": I, **dict.fromkeys("qw qx qy qz heading_deg gvx gvy gvz".split(), D)},
    "mag_raw": {"t_ms": L, "mx": D, "my": D, "mz": D},
    "acc_raw": {"t_ms": L, "ax": D, "ay": D, "az": D},
    "ble": {"t_ms": L, "point_id": S, "esl_id": S, "rssi": I, "src": S, "mfg_hex": S},
    "wifi": {"t_ms": L, "bssid": S, "rssi": I, "freq": I},
    "marks": {"point_id": S, "x_cm": D, "y_cm": D, "t_start_ms": L, "t_end_ms": L, "note": S},
    "arkit_pose": {"t_ms": L, **dict.fromkeys("x_m y_m z_m qx qy qz qw".split(), D), "tracking": I, "limited_reason": I},
    "anchors": {"t_ms": L, "kind": S, **dict.fromkeys("map_x_cm map_y_cm ar_x_cm ar_z_cm heading_rad".split(), D), "note": S},
    "baro": {"t_ms": L, "rel_alt_m": D, "pressure_kpa": D},
    "heading": {"t_ms": L, **dict.fromkeys("magnetic_deg true_deg accuracy_deg x y z".split(), D)},
    "pedometer": {"t_ms": L, "steps": L, **dict.fromkeys("distance_m cadence_hz pace_s_per_m".split(), D)},
    "device": {"t_ms": L, **dict.fromkeys("battery battery_state thermal low_power brightness".split(), D)},
    "track": {"t_ms": L, **dict.fromkeys("x_cm y_cm unc_cm conf pdr_x pdr_y heading_deg steps b_total b_vert b_horiz".split(), D), **dict.fromkeys("check src trust posture".split(), S), "lat_left_cm": D, "lat_right_cm": D, "room_id": S, "carry_mode": S, "room_mass": D, "carry_auto": S, "frozen": I},
    "truth": {"t_ms": L, "x_cm": D, "y_cm": D},
    "review": {"t_ms": L, **dict.fromkeys("truth_x_cm truth_y_cm est_x_cm est_y_cm unc_cm".split(), D), "converged": S},
    "depth_lateral": {"t_ms": L, **dict.fromkeys("left_cm right_cm wall_left_cm wall_right_cm".split(), D)},
    "signs": {"t_ms": L, "text": S, "x_cm": D, "y_cm": D},
}
META = T.StructType([T.StructField(n, S) for n in "platform device_label model os_version app_version purpose role pair_id carry_mode map_id map_frame_id".split()] + [T.StructField(n, L) for n in ("start_ms", "end_ms")] + [T.StructField(n, I) for n in ("format_version", "imu_format")] + [T.StructField(n, T.BooleanType()) for n in ("survey", "live", "arkit", "camera")] + [T.StructField("map_origin_offset_cm", T.ArrayType(D))] + [T.StructField(n, D) for n in ("map_width_cm", "map_height_cm", "lever_arm_cm")])
QUALITY = T.StructType([T.StructField("score", I), T.StructField("grade", S), T.StructField("kept", T.BooleanType()), T.StructField("reason", S), T.StructField("droppedSpansMs", T.ArrayType(T.ArrayType(L)))])


def present(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def session_of(path: Column) -> Column:
    """The folder that a file is in."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All sessions' rows of a file: session and its columns, typed; root/<session>/<name>.csv."""
    pattern = f"{root}/*/{name}.csv"
    if not present(spark, pattern):
        return spark.createDataFrame([], T.StructType([T.StructField("session", S), *[T.StructField(c, k) for c, k in COLUMNS[name].items()]]))
    return decoded(spark.read.text(pattern).select(session_of(F.col("_metadata.file_path")).alias("session"), F.col("value").alias("line")), name)


def decoded(lines: DataFrame, name: str) -> DataFrame:
    """Rows of a file's (session, line): split by each session's own header, so versions with fewer or more columns mix.

    No lines, or none but headers, give an empty table; sessions without a header have no rows."""
    cols = COLUMNS[name]
    lines = lines.select("session", F.regexp_replace("line", "[\r\ufeff]", "").alias("line"))
    first = next(iter(cols))
    is_head = F.col("line").rlike(rf'^"?{first}"?\s*(,|$)')
    heads = lines.where(is_head).groupBy("session").agg(F.first("line").alias("head")).distinct()
    out = None
    for head in [r.head for r in heads.select("head").distinct().collect()]:  # one read for each version's header, of which there are few
        names = [h.strip().strip('"') for h in head.split(",")]
        schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
        rows = lines.where(~is_head & (F.col("line") != "")).join(heads.where(F.col("head") == head).select("session"), "session", "left_semi").select("session", F.from_csv("line", F.lit(schema)).alias("r"))
        typed = [(F.trim(F.col(f"r.c{names.index(c)}")) if c in names else F.lit(None).cast("string")).try_cast(k).alias(c) for c, k in cols.items()]
        out = rows.select("session", *typed) if out is None else out.unionByName(rows.select("session", *typed))
    return out if out is not None else lines.where("false").select("session", *[F.lit(None).cast(k).alias(c) for c, k in cols.items()])


def meta(spark: SparkSession, root: str) -> DataFrame:
    docs = spark.read.text(f"{root}/*/meta.json", wholetext=True)
    return docs.select(session_of(F.col("_metadata.file_path")).alias("session"), F.from_json("value", META).alias("m")).select("session", "m.*")


def imu(rows: DataFrame) -> DataFrame:
    """Decoded IMU rows: numbers that can't be read are 0, fields of zeros have no value, gravity and attitude are gated."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    base = rows.where("t_ms is not null").select("session", "t_ms", *[zero(c) for c in "ax ay az gx gy gz mx my mz".split()], "mag_acc", "qw", "qx", "qy", "qz", F.nullif("heading_deg", F.lit(-1.0)).alias("heading_deg"), "gvx", "gvy", "gvz")
    field = F.when(~sc.no_value(F.col("mx"), F.col("my"), F.col("mz")), F.struct("mx", "my", "mz"))
    return base.select("session", "t_ms", "ax", "ay", "az", "gx", "gy", "gz", field.alias("field"), "mag_acc", "heading_deg", sc.gated_gravity(F.col("gvx"), F.col("gvy"), F.col("gvz")).alias("gravity"), sc.gated_quaternion(F.col("qw"), F.col("qx"), F.col("qy"), F.col("qz")).alias("attitude"))


def ble(rows: DataFrame) -> DataFrame:
    """Readings with a tag id and a valid strength."""
    return rows.where((F.coalesce(F.col("esl_id"), F.lit("")) != "") & sc.valid_rssi(F.col("rssi")))


def wifi(rows: DataFrame) -> DataFrame:
    """Scans with a time, an access point (lower-cased, trimmed) and a strength; a missing frequency is 0."""
    b = F.lower(F.trim("bssid"))
    return rows.where("t_ms is not null and rssi is not null").select("session", "t_ms", b.alias("bssid"), "rssi", F.coalesce("freq", F.lit(0)).alias("freq")).where("bssid <> ''")


def headings(rows: DataFrame) -> DataFrame:
    """(session, t_ms, deg): true headings; rows without one, or with a negative one (no fix), are left out."""
    return rows.where("t_ms is not null and true_deg >= 0").select("session", "t_ms", F.col("true_deg").alias("deg"))


def with_gravity(rows: DataFrame) -> DataFrame:
    """imu() rows whose `gravity` falls back to the acceleration where the recorder gave none."""
    return rows.withColumn("gravity", F.coalesce("gravity", F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("az").alias("z"))))


def wifi_scans(rows: DataFrame) -> DataFrame:
    """(session, t_ms, levels): a map of the strongest reading of each access point of a scan."""
    return rows.groupBy("session", "t_ms", "bssid").agg(F.max("rssi").alias("rssi")).groupBy("session", "t_ms").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bssid", "rssi")))).alias("levels"))


def truth(rows: DataFrame) -> DataFrame:
    """Truth rows of sessions that have at least two."""
    from pyspark.sql import Window

    good = rows.dropna(subset=["t_ms", "x_cm", "y_cm"])
    return good.withColumn("_n", F.count("*").over(Window.partitionBy("session"))).where("_n >= 2").drop("_n")


def shifted(rows: DataFrame, metas: DataFrame, x: str, y: str) -> DataFrame:
    """Map coordinates of old sessions moved to the map's present frame."""
    off = metas.select("session", F.try_element_at("map_origin_offset_cm", F.lit(1)).alias("_ox"), F.try_element_at("map_origin_offset_cm", F.lit(2)).alias("_oy"))
    j = rows.join(off, "session", "left")
    return j.withColumn(x, F.col(x) + F.coalesce("_ox", F.lit(0.0))).withColumn(y, F.col(y) + F.coalesce("_oy", F.lit(0.0))).drop("_ox", "_oy")


def dropped_spans(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(session, kept, reason) and (session, start_ms, end_ms) of quality.json; what can't be read is as if absent."""
    if not present(spark, f"{root}/*/quality.json"):
        return spark.createDataFrame([], "session string, kept boolean, reason string"), spark.createDataFrame([], "session string, start_ms bigint, end_ms bigint")
    return quality_of(spark.read.text(f"{root}/*/quality.json", wholetext=True).select(session_of(F.col("_metadata.file_path")).alias("session"), F.col("value").alias("doc")))


def quality_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables of dropped_spans() from (session, doc)."""
    q = docs.select("session", F.from_json("doc", QUALITY).alias("q")).where("q.kept is not null")
    return q.select("session", "q.kept", "q.reason"), q.select("session", F.explode("q.droppedSpansMs").alias("s")).select("session", F.col("s")[0].alias("start_ms"), F.col("s")[1].alias("end_ms"))


def classify(metas: DataFrame, files: DataFrame) -> DataFrame:
    """(session, kind): build, test, blind, companion or none, from meta and which files (session, name) there are."""
    has = files.groupBy("session").agg(F.collect_set("name").alias("names"))
    m = metas.join(has, "session", "left")
    have = lambda n: F.coalesce(F.array_contains("names", n), F.lit(False))
    kind = F.when(F.col("role") == "blind", "blind").when(F.col("role") == "companion", "companion").when(F.coalesce("survey", F.lit(False)) & have("anchors.csv"), "build").when(have("truth.csv"), "test").otherwise("none")
    return m.select("session", kind.alias("kind"))


def merge_streams(streams: list[tuple[str, int, DataFrame]]) -> DataFrame:
    """Events (session, t_ms, rank, stream, payload JSON) of several streams, for replay in order of (t_ms, rank) within sessions."""
    out = None
    for name, rank, df in streams:
        e = df.select("session", "t_ms", F.lit(rank).alias("rank"), F.lit(name).alias("stream"), F.to_json(F.struct(*[c for c in df.columns if c not in ("session", "t_ms")])).alias("payload"))
        out = e if out is None else out.unionByName(e)
    return out.repartition("session").sortWithinPartitions("session", "t_ms", "rank")


def trace_text(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Streams of tab-separated public traces (time, type, values...): one table for each TYPE_*; Wi-Fi rows last seen over 5 s ago are left out."""
    session = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1)
    return traces(spark.read.text(path).select(session.alias("session"), F.col("value").alias("line")))


def traces(lines: DataFrame) -> dict[str, DataFrame]:
    """The streams of trace_text() from (session, line)."""
    lines = lines.where(~F.col("line").startswith("#")).select("session", F.split("line", "\t").alias("f")).where("size(f) >= 3")
    base = lines.select("session", F.col("f")[0].try_cast("bigint").alias("t_ms"), F.col("f")[1].alias("type"), F.slice("f", 3, 20).alias("v")).where("t_ms is not null")
    three = lambda kind, names: base.where(F.col("type") == kind).select("session", "t_ms", *[F.try_element_at("v", F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)])
    wifi_rows = base.where("type = 'TYPE_WIFI'").select("session", "t_ms", F.lower(F.try_element_at("v", F.lit(2))).alias("bssid"), F.try_element_at("v", F.lit(3)).try_cast("int").alias("rssi"), F.try_element_at("v", F.lit(4)).try_cast("int").alias("freq"), F.try_element_at("v", F.lit(5)).try_cast("bigint").alias("seen"))
    return {
        "acc": three("TYPE_ACCELEROMETER", ("x", "y", "z")), "gyro": three("TYPE_GYROSCOPE", ("x", "y", "z")), "mag": three("TYPE_MAGNETIC_FIELD", ("x", "y", "z")), "mag_raw": three("TYPE_MAGNETIC_FIELD_UNCALIBRATED", ("x", "y", "z")),
        "rotation": three("TYPE_ROTATION_VECTOR", ("x", "y", "z")), "waypoint": three("TYPE_WAYPOINT", ("x", "y")), "wifi": wifi_rows.where("seen is null or t_ms - seen <= 5000"), "beacon": base.where("type = 'TYPE_BEACON'").select("session", "t_ms", "v"),
    }


def ply_vertices(spark: SparkSession, path: str) -> DataFrame:
    """(source, x, y, z) of binary little-endian PLY files whose vertices begin with three floats."""
    import numpy as np
    import pandas as pd

    def run(it):
        size = {"float": 4, "float32": 4, "double": 8, "uchar": 1, "uint8": 1, "int": 4, "uint": 4, "short": 2, "ushort": 2, "char": 1}
        for pdf in it:
            for source, content in zip(pdf["path"], pdf["content"], strict=True):
                at = content.index(b"end_header\n") + 11
                head = content[:at].decode("ascii").splitlines()
                n, width, on = 0, 0, False
                for line in head:
                    w = line.split()
                    if w[:1] == ["element"]:
                        on = w[1] == "vertex"
                        n = int(w[2]) if on else n
                    elif w[:1] == ["property"] and on:
                        width += size[w[1]]
                raw = np.frombuffer(content, np.uint8, n * width, at).reshape(n, width)[:, :12].copy().view("<f4")
                yield pd.DataFrame({"source": source, "x": raw[:, 0].astype(float), "y": raw[:, 1].astype(float), "z": raw[:, 2].astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "source string, x double, y double, z double")


def unzipped(spark: SparkSession, path: str) -> DataFrame:
    """(session, name, content) of the files in zipped sessions; a zip without exactly one meta.json is an error."""
    import io
    import zipfile

    import pandas as pd

    def run(it):
        for pdf in it:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                z = zipfile.ZipFile(io.BytesIO(content))
                metas = [n for n in z.namelist() if n.rsplit("/", 1)[-1] == "meta.json"]
                if len(metas) != 1:
                    raise ValueError(f"{p} holds {len(metas)} meta.json files")
                top = metas[0][: -len("meta.json")]
                session = p.rsplit("/", 1)[-1].removesuffix(".zip")
                yield pd.DataFrame([(session, n[len(top) :], z.read(n)) for n in z.namelist() if n.startswith(top) and not n.endswith("/")], columns=["session", "name", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "session string, name string, content binary")


def log_chunks(spark: SparkSession, root: str, day: str) -> DataFrame:
    """A day's log lines: root/<day>/<device>/*.ndjson."""
    return log_files(spark, f"{root}/{day}/*/*.ndjson")


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """Log lines of JSON-line files."""
    return spark.read.schema("device string, recv bigint, type string, t bigint, level string, cat string, msg string").json(path)


def log_filter(logs: DataFrame, levels: list[str], text: str = "") -> DataFrame:
    """Lines of these levels whose fields together hold the text, in any case."""
    return logs.where(F.col("level").isin(*levels) & F.contains(F.lower(F.concat_ws(" ", "device", "cat", "msg")), F.lit(text.lower())))


def listing(spark: SparkSession, path: str, limit: int, after: tuple | None = None) -> tuple[list, tuple | None]:
    """One page of a folder's files, newest first and equal times by name: ((path, time, length) rows, cursor of the next page or None).

    `after` is the cursor of the page before. Only names and times are read, never contents; empty files aren't listed."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    if after is not None:
        time, name = F.lit(after[0]), F.lit(after[1])
        f = f.where((F.col("modificationTime") < time) | ((F.col("modificationTime") == time) & (F.col("path") > name)))
    rows = f.orderBy(F.desc("modificationTime"), "path").limit(limit + 1).collect()
    page = rows[:limit]
    return page, ((page[-1]["modificationTime"], page[-1]["path"]) if len(rows) > limit else None)
