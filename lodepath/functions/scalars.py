"""Column functions of positioning data: magnetic features, angles, geodesy, radio, identifiers, polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GOOD_GRAVITY = (5.0, 15.0)
ISSUE_FIELD = (10.0, 120.0)


def magnetic_feature(mx: Column, my: Column, mz: Column, ux: Column, uy: Column, uz: Column) -> tuple[Column, Column, Column]:
    """(total, vertical, horizontal) of a field vector, up being the gravity direction; null without a direction."""
    total = F.sqrt(mx * mx + my * my + mz * mz)
    norm = F.sqrt(ux * ux + uy * uy + uz * uz)
    vertical = F.when(norm > 0, (mx * ux + my * uy + mz * uz) / norm)
    return total, vertical, F.sqrt(F.greatest(total * total - vertical * vertical, F.lit(0.0)))


def no_value(mx: Column, my: Column, mz: Column) -> Column:
    """True where a magnetometer row of zeros means that there is no value."""
    return (mx == 0) & (my == 0) & (mz == 0)


def gated_gravity(x: Column, y: Column, z: Column) -> Column:
    """A gravity struct where its norm is plausible, else null."""
    norm = F.sqrt(x * x + y * y + z * z)
    return F.when(norm.between(*GOOD_GRAVITY), F.struct(x.alias("x"), y.alias("y"), z.alias("z")))


def gated_quaternion(w: Column, x: Column, y: Column, z: Column) -> Column:
    """A unit quaternion where the norm is within 0.1 of 1, else null."""
    norm = F.sqrt(w * w + x * x + y * y + z * z)
    return F.when(F.abs(norm - 1) <= 0.1, F.struct((w / norm).alias("w"), (x / norm).alias("x"), (y / norm).alias("y"), (z / norm).alias("z")))


def rotation_quaternion(rx: Column, ry: Column, rz: Column) -> Column:
    """Unit quaternion of a rotation vector's x, y, z parts (sines of half the angle)."""
    w2 = F.lit(1.0) - rx * rx - ry * ry - rz * rz
    return F.struct(F.sqrt(F.greatest(w2, F.lit(0.0))).alias("w"), rx.alias("x"), ry.alias("y"), rz.alias("z"))


def valid_rssi(rssi: Column) -> Column:
    return (rssi < 0) & (rssi >= -127)


def corrected_rssi(rssi: Column, scale: Column | float, offset: Column | float) -> Column:
    """A device's linear correction of raw readings."""
    return rssi * F.lit(scale) + F.lit(offset)


def plausible_field(b: Column) -> Column:
    return (b > 1) & (b < 200)


def wrapped(angle: Column) -> Column:
    """Into (-pi, pi]."""
    return F.lit(math.pi) - F.pmod(F.lit(math.pi) - angle, F.lit(2 * math.pi))


def line_angle(a: Column, b: Column) -> Column:
    """Difference of undirected lines, 0 to pi / 2."""
    d = F.pmod(a - b, F.lit(math.pi))
    return F.least(d, F.lit(math.pi) - d)


def altitude(pressure: Column, reference: Column | float) -> Column:
    """Metres above the reference pressure."""
    return F.lit(44330.0) * (1 - F.pow(pressure / F.lit(reference), F.lit(1 / 5.255)))


def to_plane(lat: Column, lon: Column, lat0: float, lon0: float, rotation: float = 0.0) -> tuple[Column, Column]:
    """Equirectangular centimetres right of and below an origin (y grows downward), turned by a rotation in radians."""
    r = 6_378_137.0 * 100
    east, south = F.radians(lon - lon0) * r * math.cos(math.radians(lat0)), -F.radians(lat - lat0) * r
    c, s = math.cos(rotation), math.sin(rotation)
    return east * c - south * s, east * s + south * c


def from_plane(x: Column, y: Column, lat0: float, lon0: float, rotation: float = 0.0) -> tuple[Column, Column]:
    """(lat, lon): the inverse of to_plane."""
    r = 6_378_137.0 * 100
    c, s = math.cos(rotation), math.sin(rotation)
    east, south = x * c + y * s, -x * s + y * c
    return F.lit(lat0) - F.degrees(south / r), F.lit(lon0) + F.degrees(east / (r * math.cos(math.radians(lat0))))


def tag_id(payload_hex: Column) -> Column:
    """XX-XX-XX-XX of a payload's first four bytes, where it has four to seven bytes."""
    n = F.length(payload_hex) / 2
    return F.when((n >= 4) & (n < 8), F.concat_ws("-", *[F.upper(F.substring(payload_hex, 1 + 2 * i, 2)) for i in range(4)]))


def shelf_name(code: Column) -> Column:
    """# becomes _; a code without either gets _1."""
    return F.when(F.instr(code, "#") > 0, F.replace(code, F.lit("#"), F.lit("_"))).when(F.instr(code, "_") > 0, code).otherwise(F.concat(code, F.lit("_1")))


def standard_shelf(name: Column) -> Column:
    """True for names such as A12_3: one or two capitals, up to three digits, and up to three after the underscore."""
    return name.rlike(r"^[A-Z]{1,2}[0-9]{1,3}_[0-9]{1,3}$")


def name_day(name: Column) -> Column:
    """The last run of exactly eight digits in a name that is a date (yyyyMMdd); null without one."""
    runs = F.regexp_extract_all(name, F.lit(r"(?<![0-9])([0-9]{8})(?![0-9])"), F.lit(1))
    return F.try_element_at(F.filter(runs, lambda r: F.try_to_date(r, "yyyyMMdd").isNotNull()), F.lit(-1))


def aisle_bay(text: Column) -> Column:
    """(aisle, bay) read from a sign such as `A12-3`; null if it isn't one."""
    p = r"^\s*([A-Za-z]{1,2}\s?\d{1,3})[-_ /](\d{1,3})\s*$"
    return F.when(text.rlike(p), F.struct(F.upper(F.replace(F.regexp_extract(text, p, 1), F.lit(" "), F.lit(""))).alias("aisle"), F.regexp_extract(text, p, 2).cast("int").alias("bay")))


def age_bucket(days: Column) -> Column:
    return F.when(days <= 0, "0").when(days <= 7, "1-7").when(days <= 30, "8-30").when(days > 30, ">30")


def age_days(newer_ms: Column, older_ms: Column) -> Column:
    return F.floor((newer_ms - older_ms) / 86_400_000)


def label_of(labels: Column) -> Column:
    """Of a map of languages: zh-Hans, zh, zh-CN, en, else that of the first language by name."""
    return F.coalesce(*[F.try_element_at(labels, F.lit(k)) for k in ("zh-Hans", "zh", "zh-CN", "en")], F.try_element_at(labels, F.array_min(F.map_keys(labels))))


def cross_sum(ring: Column, weigh) -> Column:
    """Sum over a closed ring's edges of weigh(a, b) times their cross product; ring is an array of (x, y)."""
    n = F.size(ring)
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1)), lambda a, b: weigh(a, b) * (a["x"] * b["y"] - b["x"] * a["y"]))
    return F.aggregate(edges, F.lit(0.0), lambda acc, v: acc + v)


def signed_area(ring: Column) -> Column:
    return cross_sum(ring, lambda a, b: F.lit(0.5))


def centroid(ring: Column) -> tuple[Column, Column]:
    a6 = 6 * signed_area(ring)
    return cross_sum(ring, lambda a, b: a["x"] + b["x"]) / a6, cross_sum(ring, lambda a, b: a["y"] + b["y"]) / a6


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd containment in a closed ring."""
    n = F.size(ring)
    hits = F.zip_with(
        ring, F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1)),
        lambda a, b: F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0),
    )
    return F.aggregate(hits, F.lit(0), lambda acc, v: acc + v) % 2 == 1


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    l2 = dx * dx + dy * dy
    t = F.when(l2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / l2))).otherwise(F.lit(0.0))
    return F.hypot(x - ax - t * dx, y - ay - t * dy)


def boundary_distance(ring: Column, x: Column, y: Column) -> Column:
    n = F.size(ring)
    return F.array_min(F.zip_with(ring, F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1)), lambda a, b: segment_distance(x, y, a["x"], a["y"], b["x"], b["y"])))


def flat_ring(flat: Column) -> Column:
    """[x0, y0, x1, y1, ...] as an array of (x, y)."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1), lambda i: F.struct(flat[i * 2].alias("x"), flat[i * 2 + 1].alias("y")))
