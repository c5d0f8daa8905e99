"""Survey coverage and inputs: pass rasters, two-direction bins, nearest unpainted cells, room masses, bias checks, session lists."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodepath.operators.spatial import line_cells


def safe_name(name: Column) -> Column:
    """True for names of 1 to 120 letters, digits, dots, underscores and hyphens (A-Z a-z 0-9)."""
    return name.rlike(r"^[A-Za-z0-9._\-]{1,120}\z")


def raster_max(rasters: DataFrame, keys: list[str], passes: str, most: int = 255) -> DataFrame:
    """keys, passes: of several coverage rasters the greatest number of passes by cell, at most one byte's."""
    return rasters.groupBy(*keys).agg(F.max(F.least(F.col(passes), F.lit(most))).alias(passes))


def cells_of(segments: DataFrame, reach: Column, cell: float) -> DataFrame:
    """segments (ax, ay, bx, by, ...) with `cx`, `cy`: each cell that comes within reach of them, along the line and not in its whole box."""
    return line_cells(segments, reach, cell).withColumnsRenamed({"_cx": "cx", "_cy": "cy"})


def direction_bins(tracks: DataFrame, by: list[str], time: str, x: str, y: str, corridors: DataFrame, bin_cm: float = 100.0, cell: float = 100.0) -> DataFrame:
    """corridor, bin, forward, backward: which bins of a corridor were walked, and which way.

    corridors: corridor, ax, ay, bx, by, width. A point counts with its displacement over three rows, of 10 to 300 cm,
    for every corridor whose axis is within half the width and 40 cm; they meet by cells, an equi-join."""
    w = Window.partitionBy(*by).orderBy(time)
    p = tracks.select(F.col(x).alias("x"), F.col(y).alias("y"), (F.col(x) - F.lag(x, 3).over(w)).alias("dx"), (F.col(y) - F.lag(y, 3).over(w)).alias("dy"))
    far = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    p = p.where((far > 100) & (far < 90_000)).withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    c = corridors.withColumn("ux", F.col("bx") - F.col("ax")).withColumn("uy", F.col("by") - F.col("ay")).withColumn("len2", F.expr("ux * ux + uy * uy")).where("len2 > 1")
    reach = F.greatest("width", F.lit(0.0)) / 2 + 40
    j = p.join(cells_of(c, reach + 0.01 * F.sqrt("len2"), cell), ["cx", "cy"])
    t = ((F.col("x") - F.col("ax")) * F.col("ux") + (F.col("y") - F.col("ay")) * F.col("uy")) / F.col("len2")
    j = j.withColumn("t", t).where("t between -0.01 and 1.01")
    j = j.where(F.hypot(F.col("x") - F.col("ax") - F.col("t") * F.col("ux"), F.col("y") - F.col("ay") - F.col("t") * F.col("uy")) <= reach)
    last = F.greatest(F.ceil(F.sqrt("len2") / bin_cm), F.lit(1)) - 1
    at = F.least(F.greatest((F.col("t") * F.sqrt("len2") / bin_cm).cast("bigint"), F.lit(0)), last)
    ahead = F.expr("dx * ux + dy * uy >= 0")
    return j.groupBy("corridor", at.alias("bin")).agg(F.max(ahead.cast("int")).alias("forward"), F.max((~ahead).cast("int")).alias("backward"))


def direction_summary(bins: DataFrame, corridors: DataFrame, bin_cm: float = 100.0) -> DataFrame:
    """corridor, n_bins, done (share of both ways' bins), one_way_m: corridors that nobody walked are there too."""
    n = F.greatest(F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / bin_cm), F.lit(1))
    got = bins.groupBy("corridor").agg(F.sum(F.col("forward") + F.col("backward")).alias("_w"), F.sum((F.col("forward") != F.col("backward")).cast("int")).alias("_o"))
    out = corridors.select("corridor", n.alias("n_bins")).join(got, "corridor", "left")
    return out.select("corridor", "n_bins", (F.coalesce("_w", F.lit(0)) / (2 * F.col("n_bins"))).alias("done"), (F.coalesce("_o", F.lit(0)) * bin_cm / 100).alias("one_way_m"))


def nearest_unpainted(points: DataFrame, pid: str, x: str, y: str, cells: DataFrame, cell: float, most_cm: float = 5000.0) -> DataFrame:
    """pid, row, col, distance of the nearest free cell (cells: row, col): the nearest ring first, then the distance, row and column.

    Rings are searched up to most_cm; a point that finds none has nulls. A look of size s joins each point with the free cells of
    the nine blocks of s x s cells around it, which hold all rings up to s; points that found none look again with blocks of
    twice the size. Each look's plan is cut, and the search ends when all points have found theirs."""
    from lodepath.operators.graphs import checkpointed

    most = int(most_cm / cell)
    every = points.select(pid, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(x) / cell).cast("bigint").alias("ci"), (F.col(y) / cell).cast("bigint").alias("cj"))
    free = checkpointed(cells.select("row", "col").distinct())
    rest, out, size = checkpointed(every.where("x is not null and y is not null")), None, min(4, max(most, 1))
    ring = F.greatest(F.abs(F.col("col") - F.col("ci")), F.abs(F.col("row") - F.col("cj")))
    dist = F.hypot((F.col("col") + 0.5) * cell - F.col("x"), (F.col("row") + 0.5) * cell - F.col("y"))
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    while True:
        near = rest.withColumn("bi", F.explode(F.transform(around, lambda k: F.floor(F.col("ci") / size) + k))).withColumn("bj", F.explode(F.transform(around, lambda k: F.floor(F.col("cj") / size) + k)))
        there = free.withColumn("bi", F.floor(F.col("col") / size)).withColumn("bj", F.floor(F.col("row") / size))
        hit = near.join(there, ["bi", "bj"]).withColumn("ring", ring).withColumn("distance", dist).where(F.col("ring") <= min(size, most))
        best = checkpointed(hit.groupBy(pid).agg(F.min(F.struct("ring", "distance", "row", "col")).alias("b")).select(pid, "b.row", "b.col", "b.distance"))
        out = best if out is None else out.unionAll(best)
        rest = checkpointed(rest.join(best.select(pid), pid, "left_anti"))
        if size >= most or rest.isEmpty():
            return points.select(pid).join(out, pid, "left")
        size = min(2 * size, most)


def room_masses(particles: DataFrame, by: list[str], logw: str, room: str) -> DataFrame:
    """by, room, mass, runner_up, runner_up_mass: shares of the weight; particles in no room (null) count in the whole only."""
    top = particles.groupBy(*by).agg(F.max(logw).alias("_m"))
    w = F.exp(F.col(logw) - F.col("_m"))
    mass = particles.join(top, by).groupBy(*by, room).agg(F.sum(w).alias("_w")).withColumn("_all", F.sum("_w").over(Window.partitionBy(*by)))
    order = Window.partitionBy(*by).orderBy(F.desc("_w"), room)
    ranked = mass.where(F.col(room).isNotNull() & (F.col("_w") > 0)).withColumn("_n", F.row_number().over(order)).where("_n <= 2")
    pick = lambda c, n: F.max(F.when(F.col("_n") == n, c))
    return ranked.groupBy(*by).agg(pick(F.col(room), 1).alias("room"), pick(F.col("_w") / F.col("_all"), 1).alias("mass"), pick(F.col(room), 2).alias("runner_up"), pick(F.col("_w") / F.col("_all"), 2).alias("runner_up_mass"))


def bias_in_band(totals: DataFrame, by: list[str], total: str, low: Column | float, high: Column | float, slack: float, least: int) -> DataFrame:
    """by, median, fits: whether the upper median of corrected magnitudes is in the map's band; null under `least` samples."""
    from lodepath.functions import quantiles as qt

    med = qt.order_statistics(totals, by, total, {"median": qt.upper_middle}).join(totals.groupBy(*by).agg(F.count(total).alias("_n")), by)
    lo, hi = (F.lit(v) if not isinstance(v, Column) else v for v in (low, high))
    return med.select(*by, "median", F.when(F.col("_n") >= least, F.col("median").between(lo - slack, hi + slack)).alias("fits"))


def last_of_each_bin(samples: DataFrame, by: list[str], axes: list[str], time: str, size: float = 10.0, keep: int = 3) -> DataFrame:
    """The last `keep` samples of each bin of the field's space."""
    bins = [F.round(F.col(a) / size) for a in axes]
    order = Window.partitionBy(*by, *bins).orderBy(F.desc(time))
    return samples.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")


def densified(points: DataFrame, by: list[str], time: str, x: str, y: str, hz: float = 30.0) -> DataFrame:
    """by, time, x, y: straight lines between waypoints at hz, and each key's last waypoint; times are cut to whole ms."""
    w = Window.partitionBy(*by).orderBy(time)
    step = 1000.0 / hz
    nxt = lambda c: F.lead(c).over(w).alias(f"_{c}")
    legs = points.select(*by, time, x, y, nxt(time), nxt(x), nxt(y))
    count = F.ceil((F.col(f"_{time}") - F.col(time)) / step)
    i = legs.where(F.col(f"_{time}") > F.col(time)).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
    f = F.col("_i") * step / (F.col(f"_{time}") - F.col(time))
    at = lambda c: (F.col(c) + (F.col(f"_{c}") - F.col(c)) * f).alias(c)
    inner = i.select(*by, (F.col(time) + F.col("_i") * step).cast("bigint").alias(time), at(x), at(y))
    return inner.unionByName(legs.where(F.col(f"_{time}").isNull()).select(*by, F.col(time).cast("bigint").alias(time), F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)))


def drifted(truth: DataFrame, key: str, time: str, x: str, y: str, scale_sigma: float, head_sigma: float, seed: int) -> DataFrame:
    """key, time, x, y: each key's path in a frame of its own, with a random scale and a heading that walks at random.

    Every key has its own generator, seeded by (seed, key), so the result doesn't depend on who runs which key."""

    def start(k):
        rng = random.Random(f"{seed}|{k}")
        return rng, rng.uniform(0, 2 * math.pi), 1 + rng.gauss(0, scale_sigma)

    def run(batches):
        import pandas as pd

        now, rng, turn, scale, last, at = None, None, 0.0, 1.0, None, (0.0, 0.0)
        for pdf in batches:
            out = []
            for k, t, px, py in zip(pdf[key], pdf[time], pdf[x], pdf[y], strict=True):
                if last is None or k != now:
                    now, last, at = k, None, (0.0, 0.0)
                    rng, turn, scale = start(k)
                else:
                    turn += rng.gauss(0, head_sigma) * math.sqrt(max(t - last[0], 1) / 1000)
                    dx, dy = (px - last[1]) * scale, (py - last[2]) * scale
                    at = (at[0] + dx * math.cos(turn) - dy * math.sin(turn), at[1] + dx * math.sin(turn) + dy * math.cos(turn))
                last = (t, px, py)
                out.append((k, t, *at))
            yield pd.DataFrame(out, columns=[key, time, x, y])

    kind = truth.schema[key].dataType.simpleString()
    rows = truth.select(key, F.col(time).cast("bigint").alias(time), F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    return rows.repartition(key).sortWithinPartitions(key, time).mapInPandas(run, f"`{key}` {kind}, `{time}` bigint, `{x}` double, `{y}` double")


def seeded_split(ids: DataFrame, key: str, test_n: int, seed: int, most: int = 1_000_000) -> DataFrame:
    """key, test: `test_n` ids drawn by Python's seeded shuffle of the sorted ids, as evaluations were split before.

    That shuffle needs the list of ids as a whole; over `most` ids is an error."""
    names = [r[0] for r in ids.select(key).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} ids")
    names.sort()
    random.Random(seed).shuffle(names)
    chosen = ids.sparkSession.createDataFrame([(n,) for n in names[:test_n]], f"`{key}` {ids.schema[key].dataType.simpleString()}")
    return ids.select(key).distinct().join(chosen.withColumn("_t", F.lit(True)), key, "left").select(key, F.coalesce("_t", F.lit(False)).alias("test"))


def same_inputs(before: DataFrame, now: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, unchanged: whether both sides list the very same names, for a build that needn't be run again."""
    a, b = (d.select(*keys, name).distinct().withColumn(c, F.lit(True)) for d, c in ((before, "_a"), (now, "_b")))
    both = a.join(b, [*keys, name], "full")
    return both.groupBy(*keys).agg(F.min((F.col("_a").isNotNull() & F.col("_b").isNotNull()).cast("int")).cast("boolean").alias("unchanged"))


def inherited_map(sessions: DataFrame) -> DataFrame:
    """sessions (session, kind, map_id, pair_id) with the map of their pair's first blind session where a companion has none; no other session without a map stays."""
    blind = sessions.where("kind = 'blind' and map_id is not null").groupBy("pair_id").agg(F.min_by("map_id", "session").alias("_map"))
    got = F.when(F.col("map_id").isNull() & (F.col("kind") == "companion"), F.col("_map")).otherwise(F.col("map_id"))
    return sessions.join(blind, "pair_id", "left").withColumn("map_id", got).where("map_id is not null").select("session", "kind", "map_id", "pair_id")


def matched_map(sessions: DataFrame, maps: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """session, map: the map of its id or, without one, the first whose width and height are within the tolerance; null if none is.

    sessions: session, map_id, width, height; maps: map, width, height. Sizes meet by bins of the tolerance."""
    by_id = sessions.join(maps.select(F.col("map").alias("map_id"), F.lit(True).alias("_there")).distinct(), "map_id", "left")
    found = by_id.where("_there").select("session", F.col("map_id").alias("map"))
    rest = by_id.where("_there is null").withColumn("bin", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("width") / tolerance) + d)))
    m = maps.select("map", F.col("width").alias("mw"), F.col("height").alias("mh"), F.floor(F.col("width") / tolerance).alias("bin"))
    near = rest.join(m, "bin").where(f"abs(width - mw) <= {tolerance} and abs(height - mh) <= {tolerance}").groupBy("session").agg(F.min("map").alias("map"))
    return sessions.select("session").join(found.unionByName(near), "session", "left")


def versions(rows: DataFrame, by: list[str], version: str, name: str) -> DataFrame:
    """rows with `rank`: a listing by version, newest first, equal ones by name."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(version), name)))


def walkable(corridors: DataFrame, width: float, height: float, cell: float = 25.0, margin: float = 20.0, turn_deg: float = 20.0) -> DataFrame:
    """row, col, state, axis: cells whose centre is within a corridor's half width and the margin.

    corridors: corridor, ax, ay, bx, by, width. axis is the first corridor's direction in [0, pi); state is 'corridor',
    or 'junction' where a later corridor's direction differs from it by more than turn_deg."""
    c = corridors.withColumn("ux", F.col("bx") - F.col("ax")).withColumn("uy", F.col("by") - F.col("ay")).withColumn("len2", F.expr("ux * ux + uy * uy")).where("len2 > 1e-6")
    half = F.greatest("width", F.lit(0.0)) / 2 + margin
    angle = F.pmod(F.atan2("uy", "ux"), F.lit(math.pi))
    px, py = (F.col("cx") + 0.5) * cell, (F.col("cy") + 0.5) * cell
    in_map = F.col("cx").between(0, math.ceil(width / cell) - 1) & F.col("cy").between(0, math.ceil(height / cell) - 1)
    j = cells_of(c.withColumn("angle", angle), half, cell).where(in_map)
    t = F.greatest(F.least(((px - F.col("ax")) * F.col("ux") + (py - F.col("ay")) * F.col("uy")) / F.col("len2"), F.lit(1.0)), F.lit(0.0))
    j = j.withColumn("t", t).where(F.hypot(px - F.col("ax") - F.col("t") * F.col("ux"), py - F.col("ay") - F.col("t") * F.col("uy")) <= half)
    first = F.first("angle").over(Window.partitionBy("cx", "cy").orderBy("corridor"))
    j = j.withColumn("axis", first).withColumn("d", F.abs(F.col("axis") - F.col("angle")))
    turned = F.max((F.least("d", F.lit(math.pi) - F.col("d")) > math.radians(turn_deg)).cast("int"))
    return j.groupBy(F.col("cy").alias("row"), F.col("cx").alias("col")).agg(F.when(turned == 1, "junction").otherwise("corridor").alias("state"), F.min("axis").alias("axis"))


def identifiability(scored: DataFrame, by: list[str], hit: float = 1.5, apart: float = 3.0) -> DataFrame:
    """by, n, top1_rate, median_err, p90_err, ambiguity: how surely a stretch of field tells its place.

    scored: by, window, cand, d (distance of the fields), x, y (the candidate's place), tx, ty (the window's). The best
    candidate of a window is that of least (d, cand); ambiguity is the median ratio of the least d among candidates
    over `apart` from the best one to its own. Windows of a group are counted by distinct values, not collected."""
    from lodepath.functions import quantiles as qt

    keys = [*by, "window"]
    best = scored.groupBy(*keys).agg(F.min(F.struct("d", "cand", "x", "y", "tx", "ty")).alias("b"))
    far = F.hypot(F.col("x") - F.col("b.x"), F.col("y") - F.col("b.y")) > apart
    second = scored.join(best, keys).where(far).groupBy(*keys).agg((F.min("d") / F.first("b.d")).alias("ratio"), F.first("b.d").alias("_d")).where("_d > 0").drop("_d")
    err = best.select(*keys, F.hypot(F.col("b.x") - F.col("b.tx"), F.col("b.y") - F.col("b.ty")).alias("err"))
    middle = {"lo": lambda n: F.floor((n - 1) / 2), "hi": lambda n: F.floor(n / 2)}
    e = qt.order_statistics(err, by, "err", {**middle, "p90_err": lambda n: qt.truncated(n, 0.9)}).withColumn("median_err", (F.col("lo") + F.col("hi")) / 2)
    r = qt.order_statistics(second, by, "ratio", middle).select(*by, ((F.col("lo") + F.col("hi")) / 2).alias("ambiguity"))
    rate = err.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("err") <= hit).cast("int")).alias("top1_rate"))
    return rate.join(e.select(*by, "median_err", "p90_err"), by).join(r, by, "left")
