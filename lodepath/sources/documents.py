"""JSON documents: envelopes, maps, fingerprints, goods, grids, tag locations, venue GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ELEMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("shapeType", "code", "x", "y", "width", "height", "rotation", "lineWidth")] + [T.StructField("points", T.ArrayType(T.StringType()))])
UNIT = T.StructType([T.StructField("id", T.StringType()), T.StructField("category", T.StringType()), T.StructField("name", T.StringType()), T.StructField("polygon", T.ArrayType(T.DoubleType()))])
GRID = T.StructType([T.StructField("cellCm", T.DoubleType()), T.StructField("cols", T.IntegerType()), T.StructField("rows", T.IntegerType()), T.StructField("cells", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("sigma", T.ArrayType(T.DoubleType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])
MAP = T.StructType([T.StructField("width", T.StringType()), T.StructField("height", T.StringType()), T.StructField("mapElementList", T.ArrayType(ELEMENT)), T.StructField("floorPolygons", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("obstaclePolygons", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("units", T.ArrayType(UNIT)), T.StructField("magField", GRID)])
FINGER = T.ArrayType(T.StructType([T.StructField("num", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("neighbourIds", T.ArrayType(T.StringType())), T.StructField("data", T.ArrayType(T.StructType([T.StructField("shelfCode", T.StringType()), T.StructField("minRSSI", T.DoubleType()), T.StructField("maxRSSI", T.DoubleType()), T.StructField("type", T.StringType())])))]))


def unwrapped(doc: Column) -> Column:
    """The inner JSON of {code, message, success, data} envelopes, whose data may itself be JSON in a string; two passes."""
    once = lambda j: F.coalesce(F.when(j.rlike(r'(?s)^\s*\{.*"data"\s*:') & j.rlike(r'"(code|success|message)"\s*:'), F.get_json_object(j, "$.data")), j)
    return once(once(doc))


def number(c: Column) -> Column:
    """A number given as a number or as text; null if it is neither."""
    return c.try_cast("double")


def scalar_text(c: Column) -> Column:
    """Any scalar as text, whole numbers without .0."""
    return F.regexp_replace(c, r"^(-?\d+)\.0+$", "$1")


def whole(spark: SparkSession, path: str) -> DataFrame:
    """(source, doc) of each JSON file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), unwrapped(F.col("value")).alias("doc"))


def maps(docs: DataFrame) -> dict[str, DataFrame]:
    """Of (source, doc): elements by shapeType, floor and obstacle polygons, units, and the magnetic grid's cells.

    A grid whose number of cells isn't rows x cols is an error."""
    m = docs.select("source", F.from_json("doc", MAP).alias("m"))
    e = m.select("source", F.posexplode("m.mapElementList").alias("pos", "e")).select("source", "pos", F.col("e.shapeType").alias("kind"), F.col("e.code").alias("code"), *[number(F.col(f"e.{c}")).alias(c) for c in ("x", "y", "width", "height", "rotation", "lineWidth")], F.transform("e.points", lambda p: p.try_cast("double")).alias("points"))
    poly = lambda field, kind: m.select("source", F.posexplode(f"m.{field}").alias("poly_id", "flat")).withColumn("kind", F.lit(kind))
    grid = m.where("m.magField is not null").select("source", "m.magField.*")
    ok = F.size("cells") == F.col("rows") * F.col("cols")
    cells = grid.select("source", "cols", F.when(ok, F.col("cells")).otherwise(F.raise_error(F.lit("the grid's cells don't match rows x cols"))).alias("cells"), "sigma", "counts").select("source", "cols", "sigma", "counts", F.posexplode("cells").alias("i", "v"))
    cells = cells.where("v is not null").select("source", F.floor(F.col("i") / F.col("cols")).cast("int").alias("row"), (F.col("i") % F.col("cols")).alias("col"), F.col("v")[0].alias("total"), F.col("v")[1].alias("vertical"), F.col("v")[2].alias("horizontal"), F.try_element_at("sigma", F.col("i") + 1).alias("sigma"), F.try_element_at("counts", F.col("i") + 1).alias("n"))
    units = m.select("source", F.posexplode("m.units").alias("pos", "u")).select("source", "pos", "u.id", "u.category", "u.name", "u.polygon")
    return {"sizes": m.select("source", number(F.col("m.width")).alias("width"), number(F.col("m.height")).alias("height")), "elements": e, "polygons": poly("floorPolygons", "floor").unionByName(poly("obstaclePolygons", "obstacle")), "units": units, "cells": cells}


def fingerprints(docs: DataFrame, floor: str | None = None) -> DataFrame:
    """(source, floor, num, x, y, neighbours, shelf, low, high, kind) of flat or per-floor documents."""
    floors = T.ArrayType(T.StructType([T.StructField("floorId", T.StringType()), T.StructField("fingerprintList", FINGER)]))
    is_floors = F.col("doc").contains("fingerprintList")
    one = T.StructType(floors.elementType.fields)
    several = F.when(F.ltrim("doc").startswith("["), F.from_json("doc", floors)).otherwise(F.array(F.from_json("doc", one)))
    listed = F.when(is_floors, several).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("floorId"), F.from_json("doc", FINGER).alias("fingerprintList"))))
    rows = docs.select("source", F.explode(listed).alias("f"))
    if floor is not None:
        rows = rows.where(F.col("f.floorId").isNull() | (F.col("f.floorId") == floor))
    p = rows.select("source", F.col("f.floorId").alias("floor"), F.explode("f.fingerprintList").alias("p"))
    return p.select("source", "floor", "p.num", "p.x", "p.y", F.col("p.neighbourIds").alias("neighbours"), F.explode_outer("p.data").alias("d")).select("source", "floor", "num", "x", "y", "neighbours", F.col("d.shelfCode").alias("shelf"), F.col("d.minRSSI").alias("low"), F.col("d.maxRSSI").alias("high"), F.col("d.type").alias("kind"))


def goods(docs: DataFrame) -> DataFrame:
    """(source, sku, tags in order) of nested ({sku, eslIds}) or flat ({sku, eslId}) lists."""
    item = T.ArrayType(T.StructType([T.StructField("sku", T.StringType()), T.StructField("eslId", T.StringType()), T.StructField("eslIds", T.ArrayType(T.StringType()))]))
    rows = docs.select("source", F.posexplode(F.from_json("doc", item)).alias("pos", "g"))
    tags = rows.select("source", "pos", "g.sku", F.posexplode_outer(F.coalesce("g.eslIds", F.array("g.eslId"))).alias("i", "tag")).where("tag is not null")
    return tags.groupBy("source", "sku").agg(F.sort_array(F.collect_list(F.struct("pos", "i", "tag"))).alias("x")).select("source", "sku", F.col("x.tag").alias("tags"))


#: Words by which a tag table's columns are known, in order of preference.
TAG_COLUMNS = {"tag": ("esl_id", "esl", "tag"), "aisle": ("aisle",), "bay": ("bay",), "shelf": ("shelf",), "seq": ("shelfseq", "seq"), "sku": ("productcode", "sku")}


def tag_locations(spark: SparkSession, path: str) -> DataFrame:
    """(tag, aisle, bay, shelf, seq, sku, code) of a CSV whose columns are found by their headers' words; code is aisle-bay."""
    raw = spark.read.csv(path, header=True, multiLine=True, encoding="UTF-8", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    clean = {c: c.replace("﻿", "").strip().lower().replace(" ", "") for c in raw.columns}
    out, used = [], set()
    for name, words in TAG_COLUMNS.items():
        hit = next((c for w in words for c, k in clean.items() if k == w and c not in used), None) or next((c for w in words for c, k in clean.items() if w in k and c not in used), None)
        used.add(hit)
        out.append((F.col(f"`{hit}`") if hit else F.lit(None).cast("string")).alias(name))
    t = raw.select(*out).where("tag is not null and tag <> ''")
    return t.withColumn("code", F.when(F.col("aisle").isNotNull() & F.col("bay").isNotNull(), F.concat_ws("-", "aisle", "bay")))


def features(spark: SparkSession, path: str) -> DataFrame:
    """(source, kind, id, properties, geometry) of the features of GeoJSON files."""
    one = T.StructType([T.StructField("features", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("feature_type", T.StringType()), T.StructField("properties", T.StringType()), T.StructField("geometry", T.StringType())])))])
    f = whole(spark, path).select("source", F.explode(F.from_json("doc", one).features).alias("f"))
    return f.select("source", F.coalesce("f.feature_type", F.regexp_extract("source", r"([^/]+)\.(geo)?json$", 1)).alias("kind"), "f.id", "f.properties", "f.geometry")


def venue_units(f: DataFrame) -> DataFrame:
    """Units with their level's ordinal and their occupant's name: occupant -> anchor -> unit, a later occupant taking over."""
    p = lambda c: F.get_json_object("properties", f"$.{c}")
    level = f.where("kind = 'level'").select(F.col("id").alias("level_id"), p("ordinal").cast("int").alias("ordinal"))
    unit = f.where("kind = 'unit'").select(F.col("id").alias("unit_id"), p("category").alias("category"), p("level_id").alias("level_id"), F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<array<array<double>>>")[0].alias("ring"))
    anchor = f.where("kind = 'anchor'").select(F.col("id").alias("anchor_id"), p("unit_id").alias("unit_id"))
    names = F.from_json(p("name"), "map<string,string>")
    from lodepath.functions.scalars import label_of

    occupant = f.where("kind = 'occupant'").select(F.col("id").alias("o"), p("anchor_id").alias("anchor_id"), label_of(names).alias("name"))
    named = occupant.join(anchor, "anchor_id").groupBy("unit_id").agg(F.max_by("name", "o").alias("name"))
    return unit.join(level, "level_id", "left").join(named, "unit_id", "left")
