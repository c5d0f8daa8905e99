"""Sinks: CSV, grid and report JSON, thinned truth, Markdown, versioned puts, venue GeoJSON."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodepath.operators.sequences import thin


def csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
    (w.partitionBy(*by) if by else w).csv(path)


def truth_csv(truth: DataFrame, path: str, least_ms: int = 100) -> None:
    """Truth rows thinned to at least so many milliseconds."""
    csv(truth.join(thin(truth, ["session"], "t_ms", least_ms), ["session", "t_ms"], "left_semi"), path)


def grid_json(cells: DataFrame, keys: list[str], rows: int, cols: int, values: list[str]) -> DataFrame:
    """keys, doc: one JSON document a map with all rows x cols cells in order, values to 2 places, nulls kept."""
    entry = F.struct((F.col("row") * cols + F.col("col")).cast("int").alias("i"), F.array(*[F.round(v, 2) for v in values]).alias("v"), F.col("n").cast("int").alias("n"))
    got = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(entry["i"], entry))).alias("m"))
    seq = F.sequence(F.lit(0), F.lit(rows * cols - 1))
    doc = F.to_json(F.struct(F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), F.transform(seq, lambda i: F.try_element_at("m", i)["v"]).alias("cells"), F.transform(seq, lambda i: F.coalesce(F.try_element_at("m", i)["n"], F.lit(0))).alias("counts")), {"ignoreNullFields": "false"})
    return got.select(*keys, doc.alias("doc"))


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A small report as a Markdown table; a table of more than `most` rows is no report, and an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows; write it with csv()")
    line = lambda xs: "| " + " | ".join("-" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line(["-"] * len(df.columns)), *[line(r) for r in rows]])


def report_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines with their nulls: reports and calibrations."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def put_versioned(stored: DataFrame, new: DataFrame, key: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(the table after the put, refused rows): a new row is refused where the stored version is newer."""
    s = stored.select(F.col(key).alias("_k"), F.col(version).alias("_v"))
    j = new.join(s, F.col(key) == F.col("_k"), "left")
    refused = j.where(F.col("_v") > F.col(version)).select(new.columns)
    taken = j.where(F.col("_v").isNull() | (F.col("_v") <= F.col(version))).select(new.columns)
    return stored.join(taken.select(key), key, "left_anti").unionByName(taken), refused


def _uuid5(name: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda n: None if n is None else str(uuid.uuid5(uuid.NAMESPACE_URL, n))), "string")(name)


def feature_json(units: DataFrame, kind: str, space: str) -> DataFrame:
    """(kind, doc): a GeoJSON collection of units (id, category, ring) with ids that depend on nothing but their names."""
    ring = F.transform(F.concat("ring", F.slice("ring", 1, 1)), lambda p: F.array(p["x"], p["y"]))
    f = units.withColumn("uid", _uuid5(F.concat(F.lit(f"{space}/{kind}/"), F.col("id").cast("string"))))
    one = F.struct(F.lit("Feature").alias("type"), F.col("uid").alias("id"), F.lit(kind).alias("feature_type"), F.struct("category").alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    return f.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.sort_array(F.collect_list(F.to_json(one))).alias("features"))).alias("doc")).select(F.lit(kind).alias("kind"), "doc")


def site_label(name: Column, salt: str = "") -> Column:
    """A site's public label: keyed digest where there is a salt (HMAC-SHA256), else SHA-1; 8 characters."""
    if not salt:
        return F.substring(F.sha1(name.cast("binary")), 1, 8)
    key = salt.encode().ljust(64, b"\0") if len(salt.encode()) <= 64 else __import__("hashlib").sha256(salt.encode()).digest().ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), name.cast("binary")), 256))
    return F.substring(F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), inner), 256), 1, 8)
