"""Snapping to aisles and cutting edges against plain loops."""

import heapq
import math
import random
from collections import defaultdict

from lodepath.operators import snapping as sn


def foot(p, a, b):
    d = (b[0] - a[0], b[1] - a[1])
    n = d[0] ** 2 + d[1] ** 2
    t = max(0.0, min(1.0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / n)) if n else 0.0
    return (a[0] + t * d[0], a[1] + t * d[1])


def plain_snap(p, shelves, aisles):
    inside = []
    for k, x, y, w, h, turn in shelves:
        c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
        if abs((p[0] - x) * c + (p[1] - y) * s) <= w / 2 + 30 and abs(-(p[0] - x) * s + (p[1] - y) * c) <= h / 2 + 30:
            inside.append((w * h, k, (-s, c) if w >= h else (c, s)))
    if inside:
        n, best = min(inside)[2], None
        for side in (1, -1):
            d = (n[0] * side, n[1] * side)
            for k, ax, ay, bx, by in aisles:
                e = (bx - ax, by - ay)
                den = d[0] * e[1] - d[1] * e[0]
                if abs(den) > 1e-12 * max(math.hypot(*e), 1):
                    q = (ax - p[0], ay - p[1])
                    t, u = (q[0] * e[1] - q[1] * e[0]) / den, (q[0] * d[1] - q[1] * d[0]) / den
                    if t >= -1e-9 and -1e-9 <= u <= 1 + 1e-9:
                        best = min(best or (9e9,), (max(t, 0), -side, k))
        if best:
            return best[2]
    return min((math.dist(p, foot(p, (ax, ay), (bx, by))), k) for k, ax, ay, bx, by in aisles)[1]


def test_snapped(spark):
    rng = random.Random(6)
    aisles = [(k, 0.0, 400.0 * k, 3000.0, 400.0 * k) for k in range(6)] + [(10 + k, 1500.0 * k, 0.0, 1500.0 * k, 2000.0) for k in range(3)] + [(20, 200.0, 100.0, 900.0, 1700.0)]
    shelves = [(k, rng.uniform(0, 3000), rng.uniform(0, 2000), rng.choice([100.0, 400.0]), rng.choice([60.0, 200.0]), rng.choice([0.0, 90.0, 30.0, 180.0])) for k in range(25)]
    points = [(k, rng.uniform(-300, 3300), rng.uniform(-300, 2300)) for k in range(250)] + [(900, 40_000.0, -7_000.0), (901, None, 1.0)]
    got = {r.pid: r for r in sn.snapped(spark.createDataFrame(points, "pid int, x double, y double").repartition(3), spark.createDataFrame(shelves, "shelf int, x double, y double, w double, h double, turn double"), spark.createDataFrame(aisles, "aisle int, ax double, ay double, bx double, by double")).collect()}
    line = {a[0]: a for a in aisles}
    assert got.keys() == {p[0] for p in points} - {901}
    for k, x, y in points[:-1]:
        want = plain_snap((x, y), shelves, aisles)
        f = foot((x, y), line[want][1:3], line[want][3:5])
        assert got[k].aisle == want and math.dist((got[k].x, got[k].y), f) < 1e-6, k
    nearest = sum(min((math.dist((x, y), foot((x, y), a[1:3], a[3:5])), a[0]) for a in aisles)[1] != got[k].aisle for k, x, y in points[:-1])
    assert nearest >= 8  # shelves face aisles that aren't the nearest


def distances(edges, start):
    g = defaultdict(list)
    for a, b, n in edges:
        g[a].append((b, n))
        g[b].append((a, n))
    out, heap = {}, [(0.0, start)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in out:
            out[v] = d
            for w, n in g[v]:
                heapq.heappush(heap, (d + n, w))
    return out


def test_inserted(spark):
    rng = random.Random(7)
    at = {f"n{i}{j}": (600.0 * i, 500.0 * j) for i in range(4) for j in range(3)}
    pairs = [(f"n{i}{j}", f"n{i + 1}{j}") for i in range(3) for j in range(3)] + [(f"n{i}{j}", f"n{i}{j + 1}") for i in range(4) for j in range(2)]
    edges = [(k, a, b, *at[a], *at[b]) for k, (a, b) in enumerate(pairs)]
    points = [(k, rng.uniform(-50, 1900), rng.choice([0, 500, 1000]) + rng.gauss(0, 30)) for k in range(120)]
    place, nodes, cut = sn.inserted(spark.createDataFrame(points, "pid int, x double, y double").repartition(3), spark.createDataFrame([(k, *v) for k, v in at.items()], "node string, x double, y double"), spark.createDataFrame(edges, "edge int, a string, b string, ax double, ay double, bx double, by double"))
    where, known = {r.pid: r.node for r in place.collect()}, {r.node: (r.x, r.y) for r in nodes.collect()}
    want, feet = {}, defaultdict(list)
    for k, x, y in points:
        near = min((math.dist((x, y), v), n) for n, v in at.items())
        if near[0] <= 30:
            want[k] = near[1]
            continue
        _, e = min((math.dist((x, y), foot((x, y), e[3:5], e[5:7])), e[0]) for e in edges)
        f = foot((x, y), edges[e][3:5], edges[e][5:7])
        near = min((math.dist(f, v), n) for n, v in at.items())
        if near[0] <= 30:
            want[k] = near[1]
        else:
            feet[e].append((math.dist(f, edges[e][3:5]), k))
    for e, fs in feet.items():
        last, n = None, 0
        for s, k in sorted(fs):
            if last is None or s - last > 30:
                last, n = s, n + 1
            want[k] = f"{e}:{n}"
    assert where == want and len(feet) > 5 and len(set(want.values())) < len(want)
    rows = cut.collect()
    assert len(rows) == len(edges) + len(known) - len(at)
    assert all(math.dist(known[r.a], (r.ax, r.ay)) < 1e-9 and math.dist(known[r.b], (r.bx, r.by)) < 1e-9 for r in rows)
    before = distances([(a, b, math.dist(at[a], at[b])) for _, a, b, *_ in edges], "n00")
    after = distances([(r.a, r.b, math.dist((r.ax, r.ay), (r.bx, r.by))) for r in rows], "n00")
    assert all(abs(before[v] - after[v]) < 1e-6 for v in before) and after.keys() == known.keys()


def test_equal_places_and_aisles_look_once(spark, monkeypatch):
    """Many points on two places, many aisles between the same ends: one look for each place, the smallest aisle wins."""
    looked, whole = [], sn.first_hits
    monkeypatch.setattr(sn, "first_hits", lambda rays, *rest: looked.append(rays.count()) or whole(rays, *rest))
    points = spark.createDataFrame([(k, 50.0 if k % 2 else 500.0, 10.0) for k in range(60)], "pid int, x double, y double")
    shelves = spark.createDataFrame([(k, 50.0, 0.0, 100.0, 40.0, 0.0) for k in range(5)], "shelf int, x double, y double, w double, h double, turn double")
    aisles = spark.createDataFrame([(k, 0.0, 9000.0, 900.0, 9000.0) for k in range(9, 2, -1)], "aisle int, ax double, ay double, bx double, by double")
    got = {(r.pid, r.aisle, r.x, r.y) for r in sn.snapped(points, shelves, aisles).collect()}
    assert got == {(k, 3, 50.0 if k % 2 else 500.0, 9000.0) for k in range(60)}
    assert looked == [2]
