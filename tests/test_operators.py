"""Known answers and edge cases of the operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodepath.functions import quantiles as qt
from lodepath.functions import scalars as sc
from lodepath.kernels import location as loc
from lodepath.kernels import motion as mo
from lodepath.kernels.base import replay, stream
from lodepath.operators import alignment, evaluation, fusion, graphs, grids, radio, sequences, spatial
from lodepath.sources import package


@pytest.mark.parametrize("n", range(1, 7))
def test_quantile_conventions_on_small_groups(spark, n):
    v = sorted(random.Random(n).sample(range(100), n))
    df = spark.createDataFrame([(1, float(x)) for x in v], "g int, v double")
    r = qt.order_statistics(df, ["g"], "v", {"near": lambda c: qt.nearest_rank(c, 0.9), "up": qt.upper_middle, "cut": lambda c: qt.truncated(c, 0.9)}).first()
    assert (r.near, r.up, r.cut) == (v[min(math.floor((n - 1) * 0.9 + 0.5), n - 1)], v[n // 2], v[min(int(0.9 * n), n - 1)])


@pytest.mark.parametrize("gap,hit", [(99, True), (100, True), (101, False)])
def test_asof_tolerance_is_inclusive(spark, gap, hit):
    a, b = spark.createDataFrame([("s", 1000 + gap)], "k string, t long"), spark.createDataFrame([("s", 1000, 5.0)], "k string, t long, v double")
    assert (alignment.asof(a, b, ["k"], "t", ["v"], "backward", 100).first().r_v == 5.0) is hit


def test_bracket_takes_ends_and_ties(spark):
    a = spark.createDataFrame([("s", 5), ("s", 10), ("s", 0)], "k string, t long")
    b = spark.createDataFrame([("s", 0, 0.0), ("s", 10, 10.0)], "k string, t long, v double")
    got = {r.t: r.r_v for r in alignment.interpolate(a, b, ["k"], "t", ["v"], 10).collect()}
    assert got == {5: 5.0, 10: 10.0, 0: 0.0}
    assert alignment.interpolate(a, b, ["k"], "t", ["v"], 9).where("t = 5").first().r_v is None


def test_blocks_change_nothing(spark):
    rng = random.Random(8)
    a = spark.createDataFrame([(rng.choice("xy"), rng.randint(0, 400)) for _ in range(120)], "k string, t long")
    b = spark.createDataFrame([(rng.choice("xy"), rng.randint(100, 300), float(i)) for i in range(40)], "k string, t long, v double")
    for how in ("backward", "forward", "nearest"):
        one, two = (sorted(map(str, alignment.asof(a, b, ["k"], "t", ["v"], how, 60, block=w).collect())) for w in (None, 50))
        assert one == two
    assert sorted(map(str, alignment.interpolate(a, b, ["k"], "t", ["v"], 40, 10).collect())) == sorted(map(str, alignment.interpolate(a, b, ["k"], "t", ["v"], 40, 10, block=50).collect()))


def test_asof_on_empty_sides(spark):
    a, b = spark.createDataFrame([("s", 5)], "k string, t long"), spark.createDataFrame([], "k string, t long, v double")
    assert alignment.asof(a, b, ["k"], "t", ["v"]).first().r_v is None
    assert alignment.asof(b.select("k", "t"), b, ["k"], "t", ["v"]).count() == 0


def test_revisits_are_those_of_all_pairs(spark):
    rng = random.Random(41)
    rows = [("s", 700 * i, rng.uniform(0, 150), rng.uniform(0, 150), rng.uniform(20, 60)) for i in range(60)]
    want = [round(abs(a[4] - b[4]), 9) for i, a in enumerate(rows) for b in rows[i + 1 :] if math.dist(a[2:4], b[2:4]) <= 35 and b[1] - a[1] >= 9000]
    df = spark.createDataFrame(rows, "s string, t long, x double, y double, v double")
    assert sorted(round(r["diff"], 9) for r in spatial.revisits(df, ["s"], "t", "x", "y", "v", 35, 9000).collect()) == sorted(want) and want


def test_scenario_metrics_pool_the_points(spark):
    rng = random.Random(42)
    runs = [(rng.choice("pqr"), [round(rng.uniform(20, 900), 1) for _ in range(rng.choice([0, 3, 11]))]) for _ in range(14)] + [("z", [])]
    rows = [(k, e, len(e) + rng.randint(1, 9), rng.uniform(3, 30) if e else None) for k, e in runs]
    got = {x.id: x for x in evaluation.scenario_metrics(spark.createDataFrame(rows, "id string, errors array<double>, ref_points int, first_fix_m double"), ["id"]).collect()}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        every = sorted(e for r in mine for e in r[1])
        rank = lambda q, v=every: v[min(int((len(v) - 1) * q + 0.5), len(v) - 1)] if v else None
        assert (got[k].replays, got[k].median_cm, got[k].p90_cm) == (len(mine), rank(0.5), rank(0.9))
        assert abs(got[k].coverage - len(every) / sum(r[2] for r in mine)) < 1e-9 and abs(got[k].fixed_share - sum(1 for r in mine if r[1]) / len(mine)) < 1e-9


def test_compare_by_share_and_absolute_tolerance(spark):
    rng = random.Random(43)
    share, least = 0.12, 17.0
    pairs = [(f"k{i}", rng.choice([None, rng.uniform(150, 450)]) if i % 9 == 0 else rng.uniform(150, 450), rng.uniform(150, 450)) for i in range(40)]
    now = spark.createDataFrame([(k, a) for k, a, _ in pairs], "id string, m double")
    base = spark.createDataFrame([(k, b) for k, _, b in pairs], "id string, m double")
    got = {r.id: r.verdict for r in evaluation.compare(now, base, ["id"], {"m": (share, least)}).collect()}
    for k, a, b in pairs:
        room = share * b + least
        assert got[k] == ("worse" if a is None or a > b + room else "better" if a < b - room else "flat")


def test_age_buckets(spark):
    days = [None, *random.Random(44).sample(range(2, 90), 30), 0, 1]
    want = [None if d is None else "0" if d < 1 else "1-7" if d <= 7 else "8-30" if d <= 30 else ">30" for d in days]
    assert [r.b for r in spark.createDataFrame([(x,) for x in days], "d int").coalesce(1).select(sc.age_bucket(F.col("d")).alias("b")).collect()] == want


def test_union_distance_fills_what_one_side_lacks(spark):
    rng = random.Random(45)
    for _ in range(4):
        a, b = ({k: float(-rng.randint(35, 95)) for k in rng.sample(range(9), rng.randint(1, 6))} for _ in range(2))
        both = set(a) | set(b)
        want = math.sqrt(sum((a.get(k, -100) - b.get(k, -100)) ** 2 for k in both) / len(both))
        r = spark.createDataFrame([(a, b)], "a map<int,double>, b map<int,double>").select(radio.union_distance(F.col("a"), F.col("b")).alias("d")).first()
        assert abs(r.d - want) < 1e-9


def test_degenerate_fit_has_slope_one(spark):
    r = radio.linear_fit(spark.createDataFrame([(1, 3.0, 1.0), (1, 3.0, 5.0)], "g int, x double, y double"), ["g"], "x", "y").first()
    assert r.slope == 1 and r.intercept == 0


def test_grids_merge_in_any_split(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(int(i % 3), 0, 0, float(v)) for i, v in enumerate(rng.normal(40, 5, 50))], "s int, row int, col int, b double")
    a = grids.aggregate(df, ["row", "col"], ["b"]).first()
    b = grids.merge(grids.aggregate(df, ["s", "row", "col"], ["b"]), ["row", "col"], ["b"]).first()
    assert a.n == b.n and abs(a.mean_b - b.mean_b) < 1e-9 and abs(a.m2_b - b.m2_b) < 1e-6


def test_offsets_are_recovered_in_any_order():
    rng = random.Random(46)
    names = [f"n{i}" for i in range(7)]
    true = {n: (0.0 if n == "n0" else rng.uniform(-15, 15)) for n in names} | {"alone": 2.5}
    links = [(x, y, rng.randint(25, 60), true[y] - true[x], 1.0) for x, y in [*zip(names, names[1:], strict=False), ("n0", "n4"), ("n2", "n6")]]
    sizes = {"n0": 500, **{n: rng.randint(20, 90) for n in names[1:]}, "alone": 10}
    one, two = fusion.offsets(links, sizes), fusion.offsets(links[::-1], dict(reversed(sizes.items())))
    assert {k: round(v[1], 6) for k, v in one.items()} == {k: round(v[1], 6) for k, v in two.items()}
    assert all(abs(one[s][1] - true[s]) < 0.05 for s in names) and one["alone"][0] == 1


def test_segments_take_poses_to_the_map(spark):
    th = 0.4
    pts = [(t, 10.0 * t, 3.0 * t) for t in range(0, 200, 10)]
    to_map = lambda x, y: (math.cos(th) * x - math.sin(th) * y + 100, math.sin(th) * x + math.cos(th) * y - 50)
    anchors = spark.createDataFrame([("s", t, *to_map(x, y), x, y) for t, x, y in (pts[0], pts[9], pts[-1])], "session string, t_ms long, map_x_cm double, map_y_cm double, ar_x_cm double, ar_z_cm double")
    poses = spark.createDataFrame([("s", t, x, y) for t, x, y in pts], "session string, t_ms long, x double, y double")
    got = fusion.to_map(poses, fusion.segments(anchors, ["session"]), ["session"], "t_ms", "x", "y").collect()
    assert all(math.dist((r.map_x, r.map_y), to_map(r.x, r.y)) < 1e-6 for r in got) and len(got) == len(pts)


def test_hard_iron_sphere(spark):
    rng = np.random.default_rng(1)
    u = rng.normal(size=(200, 3))
    u = u / np.linalg.norm(u, axis=1, keepdims=True) * 45 + [3, -7, 12]
    df = spark.createDataFrame([("s", *map(float, x)) for x in u] + [("s", 0.0, 0.0, 0.0)], "k string, mx double, my double, mz double")
    r = fusion.hard_iron(df, ["k"]).first()
    assert np.allclose([r.cx, r.cy, r.cz, r.radius], [3, -7, 12, 45], atol=1e-6)


def test_polygon_functions(spark):
    ring = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 3D), named_struct('x', 0D, 'y', 3D))"
    df = spark.sql(f"select {ring} r, 1D x, 1D y, 5D ox")
    c = sc.centroid(F.col("r"))
    r = df.select(sc.signed_area(F.col("r")).alias("a"), c[0].alias("cx"), c[1].alias("cy"), sc.inside(F.col("r"), F.col("x"), F.col("y")).alias("i"), sc.inside(F.col("r"), F.col("ox"), F.col("y")).alias("o"), sc.boundary_distance(F.col("r"), F.col("x"), F.col("y")).alias("d")).first()
    assert (r.a, r.cx, r.cy, r.i, r.o, r.d) == (12.0, 2.0, 1.5, True, False, 1.0)


def test_plane_round_trip(spark):
    df = spark.createDataFrame([(48.1, 11.5)], "lat double, lon double")
    x, y = sc.to_plane(F.col("lat"), F.col("lon"), 48.0, 11.4, 0.3)
    back = df.select(x.alias("x"), y.alias("y")).select(*[c.alias(n) for c, n in zip(sc.from_plane(F.col("x"), F.col("y"), 48.0, 11.4, 0.3), ("lat", "lon"), strict=True)]).first()
    assert abs(back.lat - 48.1) < 1e-9 and abs(back.lon - 11.5) < 1e-9


def test_components_and_paths(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 5.0), (1, 4, 9.0), (8, 9, 1.0)], "a long, b long, w double")
    assert {r.v: r.root for r in graphs.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    assert {r.v: r.dist for r in graphs.shortest_paths(e, spark.sql("select 1L as src")).collect()} == {1: 0, 2: 1, 3: 2, 4: 7}


def test_taps():
    """Groups of three at steps that a hand makes; a clock of known offset and drift is found again."""
    rng = random.Random(47)

    def three(t):
        return [t, t + rng.randint(300, 800), t + rng.randint(1100, 1900)]

    starts = [rng.randint(0, 4000), rng.randint(200_000, 300_000), rng.randint(700_000, 900_000)]
    taps = [t for s in starts for t in three(s)]
    alone = [starts[0] + 60_000, starts[1] + 60_000, starts[1] + 60_500]
    assert sum(loc.tap_groups(sorted(taps + alone)), []) == taps
    four = [0, 400, 850, 1300]
    assert loc.tap_groups(four) == [] and loc.tap_groups(four[:3]) == [four[:3]]
    offset, ppm = rng.uniform(-900, 900), rng.uniform(-80, 80)
    clock = lambda t: t + offset + ppm * 1e-6 * (t - taps[0])
    got = loc.tap_sync(taps, [clock(t) + rng.uniform(-2, 2) for t in taps])
    assert abs(got[0] - offset) < 4 and abs(got[1] - ppm) < 8 and got[2] < 5
    off_one = [clock(t) + (150 if i == 4 else 0) for i, t in enumerate(taps)]
    assert loc.tap_sync(taps, off_one) is None


def test_floors():
    def run(rate, seconds, cadence):
        m, out, alt, steps, t = mo.Floors(), [], 0.0, 0, 0
        for phase, n in ((0, 100), (1, int(seconds * 10)), (0, 100)):
            for _ in range(n):
                t, alt, steps = t + 100, alt + phase * rate / 10, steps + phase * cadence / 10
                out += m.step(type("R", (), {"t": t, "altitude": alt, "steps": int(steps)}))
        return [(f, k) for _, f, k in out]

    assert run(1.5, 6, 0) == [(round(9 / 3.5), "elevator")]
    assert run(-0.25, 18, 2) == [(-1, "stairs")] and run(0.25, 20, 0) == [(1, "escalator")]


def test_routes():
    nodes = {0: (0, 0), 1: (0, 10), 2: (10, 10), 3: (10, 0)}
    edges = {0: {1: 10, 3: 10}, 1: {0: 10, 2: 10}, 2: {1: 10, 3: 10}, 3: {0: 10, 2: 10}}
    assert loc.astar(nodes, edges, 0, 2)[1] == 20 and loc.astar(nodes, {0: {}}, 0, 2) is None
    free = np.ones((8, 8), bool)
    free[3, :7] = False
    p = loc.grid_route(free, (0, 0), (7, 0))
    assert p[0] == (0, 0) and p[-1] == (7, 0) and loc.grid_route(free & (np.arange(8)[:, None] != 3), (0, 0), (7, 0)) is None
    assert loc.visit_order(np.abs(np.subtract.outer(np.arange(6), np.arange(6)))) == [0, 1, 2, 3, 4, 5]


def test_particles_follow_a_walk():
    g = np.fromfunction(lambda r, c: 40 + 10 * np.sin(r / 2.0) + 8 * np.cos(c / 3.0), (30, 30))
    m, x, y, out = loc.Particles(g, 50.0, (400.0, 400.0), 500), 400.0, 400.0, []
    for i in range(60):
        x, y = x + 15, y + 6
        out += m.step(type("R", (), {"t": i, "dx": 15.0, "dy": 6.0, "b": g[int(y // 50), int(x // 50)]}))
    assert math.dist(out[-1][1:3], (x, y)) < 150


def test_stream_equals_replay(spark, tmp_path):
    rows = [(k, t * 400, bool((t * 7 + k) % 3)) for k in (1, 2) for t in range(100)]
    df = spark.createDataFrame(rows, "k long, t long, good boolean")
    schema = "k long, w long, n long, score double, recent double, stop boolean"
    want = {tuple(r) for r in replay(df, "k", ["t"], mo.QualityWindows, schema).where("w < 3").collect()}
    df.where("t < 20000").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    df.where("t >= 20000").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stream(s, "k", ["t"], mo.QualityWindows, schema).writeStream.format("memory").queryName("qw").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("qw").where("w < 3").collect()} == want


def test_package_round_trip(spark, tmp_path):
    import struct
    import zlib

    sections = {"meta": b"{}", "ble": package.tag_section({"b": (1.5, 2.0, -60.4, 70_000), "a": (0.0, 9.0, -200.0, 3)}, 100.0)}
    blob = package.encode(sections)
    body = zlib.decompress(blob, -15)
    assert body[:6] == b"HPMP\x01\x00" and struct.unpack_from("<I", body, 6)[0] == 2 and body.endswith(b"\0" * 16)
    assert package.decode(blob) == sections and package.tag_rows(sections["ble"]) == [("a", 0.0, 9.0, -128, 3), ("b", 1.5, 2.0, -60, 65_535)]
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    assert package.decode(z.compress(body[:-12]) + z.flush()) == sections  # files of before end after five sections
    for wrong in (b"XXXX" + body[4:], body[:-2], body[:20]):
        z = zlib.compressobj(9, zlib.DEFLATED, -15)
        with pytest.raises((ValueError, struct.error)):
            package.decode(z.compress(wrong) + z.flush())
    at, rows = str(tmp_path / "p"), [("one", k, bytearray(v)) for k, v in sections.items()] + [("two/é", "meta", bytearray(b"2")), ("two/é", "map", bytearray(b"3"))]
    df = spark.createDataFrame(rows, "package string, kind string, content binary").repartition(3)
    package.write_packages(df, at)
    read = lambda: {(r.package, r.kind): bytes(r.content) for r in spark.read.format("map_package").load(at).collect()}
    assert read() == {(p, k): bytes(v) for p, k, v in rows}
    files = spark.read.format("binaryFile").load(at)
    assert {r.kind: bytes(r.content) for r in package.unpacked(files).where("path like '%one%'").collect()} == sections
    for wrong in (df.where("package = 'one'"), df.unionAll(df).where("package <> 'one'").withColumn("package", F.lit("three"))):  # one that is there, and a kind that comes twice
        with pytest.raises(Exception):
            package.write_packages(wrong, at)
    apart = spark.createDataFrame([("four", "meta", bytearray(b"1")), ("four", "map", bytearray(b"2"))], "package string, kind string, content binary").repartition(2, "kind")
    with pytest.raises(Exception):
        apart.repartitionByRange(2, "kind").write.format("map_package").mode("append").save(at)
    assert read() == {(p, k): bytes(v) for p, k, v in rows} and not list((tmp_path / "p").glob(".*.part"))
    package.write_packages(df.where("package <> 'one'"), at, "overwrite")
    assert set(read()) == {("two/é", "meta"), ("two/é", "map")}
    cells = [("m", i, *[rng_ for rng_ in (40.126 + i, -3.004, 500.0, 0.5, 0.0, 0.25)]) for i in (5, 0, 11)] + [("m", 3, None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    c = spark.createDataFrame(cells, "map string, i int, " + ", ".join(f"{v} double" for v in package.VALUES))
    back = package.field_cells(package.field_section(c, "map", 390.0, 250.0, 100.0), "map").collect()
    assert {(r.row, r.col): (r.total, r.vertical, r.horizontal) for r in back} == {(1, 1): (45.13, -3.0, 327.67), (0, 0): (40.13, -3.0, 327.67), (2, 3): (51.13, -3.0, 327.67)}


def test_forward_asof_of_a_long_key_is_linear(spark):
    """10^5 rows of one key on either side: a frame that looked ahead anew for each row would take hours."""
    import time

    n = 100_000
    a = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 7 % n * 10 + 3).alias("t"))
    b = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 10).alias("t"), F.col("id").cast("double").alias("v"))
    took = {}
    for how, want in (("backward", lambda t: t // 10), ("forward", lambda t: t // 10 + 1), ("nearest", lambda t: t // 10)):
        start = time.time()
        got = alignment.asof(a, b, ["k"], "t", ["v"], how).agg(F.sum("r_v"), F.count("r_v")).first()
        took[how] = time.time() - start
        vs = [want(t) for t in range(3, n * 10, 10)]
        assert got[0] == sum(v for v in vs if v < n) and got[1] == sum(v < n for v in vs)
    assert took["forward"] < 20 and took["nearest"] < 30
    null = spark.createDataFrame([("k", None), ("k", 5)], "k string, t long")
    assert {(r.t, r.r_v) for r in alignment.asof(null, b, ["k"], "t", ["v"], "forward").collect()} == {(None, None), (5, 1.0)}


def test_folds_carry_over_batches(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(0, 3000), rng.uniform(0, 9)) for k in (1, 2, None) for _ in range(150)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame(rows, "k int, t long, v double")
        thin = sorted(map(str, sequences.thin(df, ["k"], "t", 90).collect()))
        smooth = sorted(map(str, sequences.low_pass(df, ["k"], "t", "v", 50.0, 60.0).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want_t, want_s = [], []
    for k in (1, 2, None):
        last = state = None
        for t, v in sorted((t, v) for kk, t, v in rows if kk == k):
            if last is None or t - last >= 90:
                last = t
                want_t.append((k, t))
            dt = None if state is None else t - state[0]
            state = (t, v if dt is None or dt <= 0 or dt > 60 else state[1] + dt / (50 + dt) * (v - state[1]))
            want_s.append((k, *state))
    row = lambda names, rs: sorted(f"Row({', '.join(f'{n}={x!r}' for n, x in zip(names, r, strict=True))})" for r in rs)
    assert thin == row(("k", "t"), want_t) and smooth == row(("k", "t", "smooth"), want_s)


def test_native_windows_equal_the_machines(spark):
    rng = random.Random(11)
    rows = sorted({(k, rng.randint(0, 200_000)) for k in (1, 2) for _ in range(160)})
    data = [(k, t, rng.random() < 0.6, rng.uniform(-3, 3), rng.randint(0, 3)) for k, t in rows]
    df = spark.createDataFrame(data, "k long, t long, good boolean, value double, tag int").withColumn("rssi", F.col("value"))
    rounded = lambda got: sorted(tuple(None if x is None else round(float(x), 9) for x in r) for r in got)
    quality = replay(df, "k", ["t"], lambda: mo.QualityWindows(10_000), "k long, w long, n long, score double, recent double, stop boolean").select("k", "w", "n", "score").collect()
    assert rounded(sequences.tumbling_quality(df, ["k"], "t", "good", 10_000).collect()) == rounded(quality)
    bias = replay(df, "k", ["t"], lambda: mo.Bias(12), "k long, sec long, bias double").collect()
    assert rounded(sequences.recent_bias(df, ["k"], "t", "value", keep=12).collect()) == rounded(bias)
    radio_ = replay(df, "k", ["t", "tag", "rssi"], mo.RadioWindow, "k long, t long, tag int, mean double, n int").collect()
    assert rounded(sequences.tag_window(df, ["k"], "t", "tag", "rssi").collect()) == rounded(radio_)


def test_grids_merge_far_from_zero(spark):
    df = spark.createDataFrame([(1, 1, 1e8, 0.0), (1, 1, 1e8 + 1, 0.0)], "row int, n int, mean_b double, m2_b double")
    assert grids.merge(df, ["row"], ["b"]).first().m2_b == 0.5


def test_thinning_keeps_what_is_far_from_the_last_kept(spark):
    df = spark.createDataFrame([("s", t) for t in (0, 60, 100, 150, 199, 200, 310)], "k string, t long")
    assert sorted(r.t for r in sequences.thin(df, ["k"], "t", 100).collect()) == [0, 100, 200, 310]


def test_sessions_of_mixed_versions(spark, tmp_path):
    from lodepath.sources import sessions as ss

    for name, head, row in (("a", "t_ms,ax,ay,az,gx,gy,gz,mx,my,mz", "1,1,x,3,0,0,0,0,0,0"), ("b", "t_ms,ax,ay,az,gx,gy,gz,mx,my,mz,mag_acc,qw,qx,qy,qz,heading_deg,gvx,gvy,gvz", "2,1,2,3,0,0,0,20,0,40,3,1,0,0,0,-1,0,0,9.8")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "imu.csv").write_text(f"{head}\r\n{row}\r\nbad,1,2,3,4,5,6,7,8,9\r\n")
        (tmp_path / name / "meta.json").write_text('{"map_origin_offset_cm": [10, 20], "survey": true}')
    r = {x.session: x for x in ss.imu(ss.read(spark, str(tmp_path), "imu")).collect()}
    assert r["a"].ay == 0 and r["a"].field is None and r["a"].gravity is None
    assert r["b"].gravity.z == 9.8 and r["b"].attitude.w == 1 and r["b"].heading_deg is None and len(r) == 2
    assert ss.read(spark, str(tmp_path), "ble").count() == 0
    t = spark.createDataFrame([("a", 1.0, 2.0)], "session string, x double, y double")
    assert tuple(ss.shifted(t, ss.meta(spark, str(tmp_path)), "x", "y").first()) == ("a", 11.0, 22.0)


def test_listing_by_pages(spark, tmp_path):
    import os

    from lodepath.sources import sessions as ss

    for i in range(7):
        f = tmp_path / f"f{i}.zip"
        f.write_bytes(b"x" * (i + 1))
        os.utime(f, (1_000_000 + i // 2, 1_000_000 + i // 2))
    seen, after = [], None
    while True:
        page, after = ss.listing(spark, str(tmp_path), 3, after)
        seen += [r.path.rsplit("/", 1)[1] for r in page]
        if after is None:
            break
    assert seen == [f"f{i}.zip" for i in (6, 4, 5, 2, 3, 0, 1)]


def test_drift_and_split_are_seeded(spark):
    from lodepath.operators import coverage as cv

    rows = [(k, t * 100, float(t), 0.0) for k in "ab" for t in range(50)]
    df = spark.createDataFrame(rows, "k string, t long, x double, y double")
    one, two = (sorted(map(tuple, cv.drifted(d, "k", "t", "x", "y", 0.0, 0.0, 5).collect())) for d in (df, df.repartition(7)))
    assert one == two and len(one) == 100
    for k in "ab":  # neither scale nor drift: lengths stay
        p = [r[2:] for r in one if r[0] == k]
        assert all(abs(math.dist(p[i], p[j]) - abs(i - j)) < 1e-9 for i in range(50) for j in range(50))
    bent = [r[2:] for r in sorted(map(tuple, cv.drifted(df, "k", "t", "x", "y", 0.05, 0.3, 5).collect())) if r[0] == "a"]
    assert math.dist(bent[0], bent[24]) + math.dist(bent[24], bent[49]) > math.dist(bent[0], bent[49]) + 1e-6
    ids = spark.createDataFrame([(f"s{i:02}",) for i in range(20)], "id string")
    names = [f"s{i:02}" for i in range(20)]
    random.Random(3).shuffle(names)
    assert {r.id for r in cv.seeded_split(ids, "id", 6, 3).where("test").collect()} == set(names[:6])


def test_wifi_scans(spark):
    from lodepath.sources import sessions as ss

    rows = [("s", 2000, "A", -70, None), ("s", 1000, "a ", -60, 1), ("s", 1000, "b", -80, 1), ("s", 1000, "a", -55, 1), ("s", None, "c", -1, 1), ("s", 5, "", -1, 1), ("s", 6, "d", None, 1)]
    df = ss.wifi(spark.createDataFrame(rows, "session string, t_ms long, bssid string, rssi int, freq int"))
    assert {r.t_ms: r.levels for r in ss.wifi_scans(df).collect()} == {1000: {"a": -55, "b": -80}, 2000: {"a": -70}}


def test_map_document(spark):
    from lodepath.sources import documents as dc

    inner = '{"width": "100", "height": 50, "mapElementList": [{"shapeType": "shelf", "code": "A1", "x": "1.5", "y": 2}], "magField": {"cellCm": 50, "cols": 2, "rows": 1, "cells": [[1, 2, 3], null], "counts": [5, 0]}}'
    import json

    doc = json.dumps({"code": 0, "message": "ok", "data": inner})
    m = dc.maps(spark.createDataFrame([("f", doc)], "source string, raw string").select("source", dc.unwrapped(F.col("raw")).alias("doc")))
    assert m["elements"].first().x == 1.5 and m["sizes"].first().width == 100 and [(r.row, r.col, r.total) for r in m["cells"].collect()] == [(0, 0, 1.0)]


def test_versioned_put_and_labels(spark):
    import hashlib
    import hmac

    from lodepath.sources import sinks

    a = spark.createDataFrame([("m", 5, "old"), ("n", 1, "old")], "k string, v int, x string")
    b = spark.createDataFrame([("m", 4, "new"), ("n", 2, "new"), ("o", 1, "new")], "k string, v int, x string")
    after, refused = sinks.put_versioned(a, b, "k", "v")
    assert {(r.k, r.x) for r in after.collect()} == {("m", "old"), ("n", "new"), ("o", "new")} and [r.k for r in refused.collect()] == ["m"]
    got = a.where("k = 'm'").select(sinks.site_label(F.col("k"), "salt").alias("h")).first().h
    assert got == hmac.new(b"salt", b"m", hashlib.sha256).hexdigest()[:8]


def test_nearest_site_among_very_many(spark):
    """Sites lie on each other, far more of them than points within the radius; as a plain loop finds it, ties to the larger id."""
    from lodepath.operators.graphs import checkpointed

    rng = random.Random(8)
    places = [(rng.randint(0, 60) / 4, rng.randint(0, 60) / 4) for _ in range(700)] + [(rng.uniform(40, 90), rng.uniform(0, 50)) for _ in range(60)]
    sites = [(k, *places[k % len(places)]) for k in range(200 * len(places))]
    points = [(k, rng.uniform(-6, 100), rng.uniform(-6, 60)) for k in range(1500)] + [(2000, 1.125, 1.0), (2001, None, 1.0)]
    points += [(k, rng.uniform(-6, 100), 90.0) for k in range(20)] + [(3000, 45.0, 100.0), (3000, *places[-1])]  # rows of one id are one point
    s = checkpointed(spark.range(len(sites)).select(F.col("id").alias("s"), F.element_at(F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in places]), (F.col("id") % len(places) + 1).cast("int")).alias("p")).select("s", "p.x", "p.y"))
    p = spark.createDataFrame(points, "p int, x double, y double")
    last = {(a, b): k for k, a, b in sites}
    want = {}
    for k, x, y in [q for q in points if q[1] is not None]:
        near = min((math.sqrt((x - a) ** 2 + (y - b) ** 2), -i) for (a, b), i in last.items())
        if near[0] <= 5 and (k not in want or near < (want[k][1], -want[k][0])):
            want[k] = (-near[1], round(near[0], 9))
    got = spatial.nearest(p, s, [], "p", "s", "x", "y", 5.0)
    assert {r.p: (r.s, round(r.distance, 9)) for r in got.collect()} == want and 500 < len(want) < 1500
    parts = spatial.nearest(p, s, [], "p", "s", "x", "y", 5.0, most=40)
    assert {r.p: (r.s, round(r.distance, 9)) for r in parts.collect()} == want


def test_nearest_looks_at_few_of_the_sites_within_reach():
    """Points between crowds of sites and in them; steps that hold few pairs give the same."""
    rng = np.random.default_rng(4)
    sx, sy = np.floor(rng.uniform(0, 40, 6000)) // 2 * 2 + rng.uniform(0, 0.3, 6000), rng.integers(0, 30, 6000) * 1.0
    px, py = rng.uniform(-8, 50, 900), rng.uniform(-8, 40, 900)
    d = np.sqrt((px[:, None] - sx) ** 2 + (py[:, None] - sy) ** 2)
    want = np.where(d.min(axis=1) <= 5, d.argmin(axis=1), -1)
    for most in (1_000_000, 50):
        at, far = spatial.nearest_places(px, py, sx, sy, 5.0, most)
        assert (at == want).all() and (far[at >= 0] == d.min(axis=1)[at >= 0]).all() and 300 < (at >= 0).sum() < 900
    at, far = spatial.nearest_places(px, py, np.ones(9), np.ones(9), 5.0)
    assert set(at) == {-1, 8}


def test_equal_walls_and_corridors_are_reckoned_once(spark, monkeypatch):
    """Copies of a cross: each pair of corridors meets, each run of them is linked, and each wall counts, but one of each line is looked at."""
    from lodepath.operators import survey

    seen, whole = [], survey.cells_of
    monkeypatch.setattr(survey, "cells_of", lambda df, *rest: seen.append(df.count()) or whole(df, *rest))
    lines = [(k, 0.0, 0.0, 1000.0, 0.0) if k % 2 else (k, 500.0, -500.0, 500.0, 500.0) for k in range(60)]
    c = spark.createDataFrame(lines, "corridor int, ax double, ay double, bx double, by double")
    got = survey.junctions(c).collect()
    assert {(r.a, r.b) for r in got} == {(a, b) for a in range(60) for b in range(a + 1, 60) if (a + b) % 2} and {(r.at_a, r.at_b) for r in got} == {(500.0, 500.0)} and len(got) == 900
    done = spark.createDataFrame([(k, b, not (k == 7 and 3 <= b <= 6)) for k in range(60) for b in range(10)], "corridor int, bin int, done boolean")
    linked = {(r.corridor, r.bin): r.linked for r in survey.linked_coverage(done, c).collect()}
    assert linked == {(k, b): k != 7 for k in range(60) for b in range(10) if not (k == 7 and 3 <= b <= 6)}
    new = spark.createDataFrame([(k, 0.0, 5.0, 100.0, 5.0) for k in range(40)] + [(99, 0.0, 15.0, 300.0, 15.0)], "wall int, ax double, ay double, bx double, by double").withColumn("map", F.lit(1))
    r = survey.wall_agreement(new, c.withColumnRenamed("corridor", "w").withColumn("map", F.lit(1)), ["map"], "wall").first()
    assert (round(r.overlap, 6), round(r["mean"], 6), r.worst) == (4300.0, round((4000 * 5 + 300 * 15) / 4300, 6), 15.0)
    assert seen == [2, 2, 2]
