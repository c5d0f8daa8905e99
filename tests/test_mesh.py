"""Shelves in a scanned mesh: known shifts and heights, and binned quantiles against sorted values."""

import math
import random
import statistics

from lodepath.operators import mesh


def test_binned_quantiles(spark):
    rng = random.Random(2)
    groups = {g: [rng.gauss(0, 30) for _ in range(n)] for g, n in enumerate([1, 2, 3, 10, 101, 1000])}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v double").repartition(4)
    wanted = {"p95": lambda n: mesh.F.floor(n * 0.95), "mid": lambda n: (n - 1) / 2}
    for r in mesh.binned_quantiles(df, ["g"], "v", 0.2, wanted).collect():
        vs = sorted(groups[r.g])
        assert r.n == len(vs) and abs(r.p95 - vs[int(len(vs) * 0.95)]) <= 0.1 + 1e-9 and abs(r.mid - statistics.median(vs)) <= 0.1 + 1e-9


def box(rng, cx, cy, w, h, turn, top, n):
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    out = []
    for _ in range(n):
        u, v = rng.choice([(rng.uniform(-w / 2, w / 2), rng.choice([-1, 1]) * h / 2 + rng.gauss(0, 2)), (rng.uniform(-w / 2, w / 2), rng.uniform(-h / 2, h / 2))])
        z = top - abs(rng.gauss(0, 0.02)) if abs(v) < h / 2 - 6 else rng.uniform(0, top)
        out.append((cx + u * c - v * s, cy + u * s + v * c, z))
    return out


def plain_shelf(sh, points):
    code, cx, cy, w, h, turn = sh
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    ext = max(w, h) / 2 + 80
    near = [p for p in points if (cx - ext) // 100 <= p[0] // 100 <= (cx + ext) // 100 and (cy - ext) // 100 <= p[1] // 100 <= (cy + ext) // 100]
    if len(near) < 30:
        return None
    local = [((x - cx) * c + (y - cy) * s, -(x - cx) * s + (y - cy) * c, z) for x, y, z in near]
    up = sorted(z for u, v, z in local if abs(u) <= w / 2 and abs(v) <= h / 2 and 0.2 <= z <= 3.5)
    top = up[int(len(up) * 0.95)] if len(up) >= 30 else None
    est = []
    for sign in (1, -1):
        d = [sign * (v if w >= h else u) - min(w, h) / 2 for u, v, z in local if abs(u if w >= h else v) <= max(w, h) / 2 - 10 and 0.4 <= z <= 1.6]
        d = [x for x in d if -40 <= x <= 80]
        if len(d) >= 30:
            est.append(sign * statistics.median(d))
    return (len(near), top, sum(est) / len(est) if est else None, len(est)) if top is not None or est else None


def test_shelf_heights(spark):
    rng = random.Random(4)
    shelves, points = [], []
    for k in range(8):
        cx, cy, w, h, turn = 500.0 + 700 * (k % 4), 400.0 + 900 * (k // 4), rng.choice([100.0, 300.0]), rng.choice([60.0, 200.0]), rng.choice([0.0, 90.0, 20.0])
        shelves.append((f"s{k}", cx, cy, w, h, turn))
        c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
        off = (-s * 12, c * 12) if w >= h else (c * 12, s * 12)  # 12 cm along the short axis
        points += box(rng, cx + off[0], cy + off[1], w, h, turn, 2.3, [0, 10, 900, 900, 900, 900, 900, 900][k])
    shelves.append(("far", 90_000.0, 90_000.0, 100.0, 50.0, 0.0))
    points += box(rng, 90_000.0, 90_000.0, 100.0, 50.0, 0.0, 2.0, 500)
    v, sh = spark.createDataFrame(points, "x double, y double, h double").repartition(4), spark.createDataFrame(shelves, "code string, x double, y double, w double, h double, turn double")
    track = spark.createDataFrame([(0.0 + 100 * k, 800.0) for k in range(40)] + [(None, 1.0)], "x double, y double")
    got = {r.code: r for r in mesh.shelf_heights(v, sh, track).collect()}
    want = {s[0]: plain_shelf(s, points) for s in shelves if s[0] != "far"}
    want = {k: v for k, v in want.items() if v}
    assert got.keys() == want.keys() and len(want) >= 6
    for k, (n, top, shift, faces) in want.items():
        r = got[k]
        assert (r.points, r.faces) == (n, faces) and (r.top is None) == (top is None) and (r.shift is None) == (shift is None)
        assert top is None or abs(r.top - top) <= 0.0005 + 1e-9
        assert shift is None or abs(r.shift - shift) <= 0.05 + 1e-9
        assert shift is None or abs(shift - 12) < 4 and abs(math.hypot(r.dx, r.dy) - abs(r.shift)) < 1e-9
    assert mesh.shelf_heights(v, sh, track.limit(0)).count() == 0
    some = mesh.placed(v.limit(50).withColumn("v", mesh.F.monotonically_increasing_id()).withColumn("s", mesh.F.lit(1)), track.where("x is not null").withColumn("t", mesh.F.col("x").cast("long")).withColumn("s", mesh.F.lit(1)), ["s"], "v", "t", 5000.0)
    assert some.count() == 50
