"""Survey zones against recursive bisection, and their status, entries and order by plain loops."""

import math
import random

from lodepath.operators import zoning

C = "map int, corridor string, ax double, ay double, bx double, by double, width double"


def floor_plan(seed):
    rng = random.Random(seed)
    rows = []
    for m in range(4):
        for k in range([0, 1, 12, 40][m]):
            x, y, n = rng.uniform(0, 8000), rng.uniform(0, 5000), rng.choice([100.0, 900.0, 4000.0, 9000.0])
            rows.append((m, f"c{k:02}", x, y, x + (n if k % 2 else 0), y + (0 if k % 2 else n), rng.choice([40.0, 80.0, 150.0, 300.0])))
    return rows


def plain_lanes(c):
    _, code, ax, ay, bx, by, width = c
    n = math.hypot(bx - ax, by - ay)
    if n <= 150 or width < 50:
        return []
    offs = [(0.0, 0)] if width <= 100 else [(width / 2 - 40, 1), (-(width / 2 - 40), -1)] + ([(0.0, 0)] if width > 160 else [])
    return [(code, s, ax - (by - ay) / n * o, ay + (bx - ax) / n * o, bx - (by - ay) / n * o, by + (bx - ax) / n * o) for o, s in offs]


def plain_zones(corridors, target):
    items = []
    for c in corridors:
        nl = len(plain_lanes(c))
        n = math.hypot(c[4] - c[2], c[5] - c[3])
        for k in range(max(math.ceil(n / 1500), 1) if nl else 0):
            parts = max(math.ceil(n / 1500), 1)
            p, q = ((c[2] + (c[4] - c[2]) * t, c[3] + (c[5] - c[3]) * t) for t in (k / parts, (k + 1) / parts))
            items.append({"id": (c[1], k), "w": round(n / parts * nl * 1000), "c": ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2), "p": p, "q": q, "t": (k / parts, (k + 1) / parts)})
    groups = []

    def split(some):
        total = sum(i["w"] for i in some)
        if total <= target * 1.15 * 1000 or len(some) < 2:
            groups.append(some)
            return
        span = [max(i["c"][a] for i in some) - min(i["c"][a] for i in some) for a in (0, 1)]
        a = 0 if span[0] >= span[1] else 1
        some = sorted(some, key=lambda i: (i["c"][a], i["id"]))
        parts = math.ceil(total / (target * 1000))
        acc, cut = 0, 1
        for k, i in enumerate(some):
            acc += i["w"]
            if acc >= total * (parts // 2) / parts:
                cut = max(1, min(k + 1, len(some) - 1))
                break
        split(some[:cut])
        split(some[cut:])

    if items:
        split(items)
    mid = lambda g, a: sum(i["c"][a] * i["w"] for i in g) / max(sum(i["w"] for i in g), 1000)
    return sorted(groups, key=lambda g: (int(mid(g, 1) / 1000), mid(g, 0)))


def off(p, a, b):
    d, l2 = (b[0] - a[0], b[1] - a[1]), (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    t = max(0, min(1, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / l2)) if l2 else 0
    return math.dist(p, (a[0] + t * d[0], a[1] + t * d[1]))


def test_zones_status_entries_and_next(spark):
    rows, target, cell = floor_plan(5), 15_000.0, 50.0
    rng = random.Random(9)
    df = spark.createDataFrame(rows, C).repartition(3)
    z = zoning.zoned(zoning.pieces(df), target).persist()
    zones = {m: plain_zones([r for r in rows if r[0] == m], target) for m in range(4)}
    want = {(m, *i["id"]): k + 1 for m, gs in zones.items() for k, g in enumerate(gs) for i in g}
    assert {(r.map, r.corridor, r.k): r.zone for r in z.collect()} == want and max(want.values()) > 12
    # cells to paint: those of map 3 partly painted, map 2 untouched, map 1 wholly painted
    cells = [(m, r, c, {1: 1, 2: 0}.get(m, int(r < 60 and rng.random() < 0.9))) for m in (1, 2, 3) for r in range(0, 280, 1) for c in range(0, 340, 1) if m == 3 or (r + c) % 2 == 0]
    cdf = spark.createDataFrame(cells, "map int, row long, col long, passes int")
    painted = {(m, r, c): p for m, r, c, p in cells}
    status = {}
    for m, gs in zones.items():
        for k, g in enumerate(gs):
            total = left = 0.0
            for i in g:
                code = i["id"][0]
                for _, _, ax, ay, bx, by in plain_lanes(next(r for r in rows if r[0] == m and r[1] == code)):
                    p, q = ((ax + (bx - ax) * t, ay + (by - ay) * t) for t in i["t"])
                    n = math.dist(p, q)
                    steps = max(int(n / 50), 1)
                    total += n
                    left += n / (steps + 1) * sum(painted.get((m, int((p[1] + (q[1] - p[1]) * j / steps) / cell), int((p[0] + (q[0] - p[0]) * j / steps) / cell)), 1) == 0 for j in range(steps + 1))
            status[m, k + 1] = (total, left, 1 - left / total)
    st = zoning.status(z, zoning.lanes(df), cdf, cell).persist()
    got = {(r.map, r.zone): (r.total, r.remaining, r.fraction) for r in st.collect()}
    assert got.keys() == status.keys()
    for k, v in status.items():
        assert all(abs(a - b) < 1e-6 * max(1, abs(b)) for a, b in zip(got[k], v, strict=True)), k
    entry = {}
    for m, gs in zones.items():
        sites = [(r, c) for mm, r, c, p in cells if mm == m and p and r % 4 == 0 and c % 4 == 0]
        for k, g in enumerate(gs):
            if sites:
                entry[m, k + 1] = min((min(off(((c + 0.5) * cell, (r + 0.5) * cell), i["p"], i["q"]) for i in g), r, c) for r, c in sites)
    en = zoning.entries(z, cdf, cell, 4).persist()
    seen = {(r.map, r.zone): r for r in en.collect()}
    assert seen.keys() == entry.keys()
    for k, (d, r, c) in entry.items():
        assert abs(seen[k].distance - d) < 1e-6 and (seen[k].x, seen[k].y) == ((c + 0.5) * cell, (r + 0.5) * cell)
    for at in ([], [(2, 9000.0, 5000.0), (3, 0.0, 0.0)]):
        nxt = {r.map: r.zone for r in zoning.next_zone(st, zoning.zone_table(z), en, spark.createDataFrame(at, "map int, x double, y double")).collect()}
        for m, gs in zones.items():
            todo = [k for k in range(1, len(gs) + 1) if status[m, k][2] < 0.85]
            begun = [k for k in todo if status[m, k][2] >= 0.15]
            best = None
            if begun:
                best = max(begun, key=lambda k: (status[m, k][2], -k))
            elif todo and (m, todo[0]) in entry:
                best = min(todo, key=lambda k: (entry[m, k][0], k))
            elif todo and any(a[0] == m for a in at):
                x, y = next(a[1:] for a in at if a[0] == m)
                mid = {r.zone: (r.x, r.y) for r in zoning.zone_table(z).collect() if r.map == m}
                best = min(todo, key=lambda k: (math.dist(mid[k], (x, y)), k))
            elif todo:
                best = todo[0]
            if gs:
                assert nxt[m] == best, m
    assert zoning.zoned(zoning.pieces(df.limit(0))).count() == 0
