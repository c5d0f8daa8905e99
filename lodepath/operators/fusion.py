"""Multi-session map building: sample filters, offsets between sessions, alignment to anchors, quality gates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodepath.operators import alignment


def reasons(df: DataFrame, rules: list[tuple[str, Column]], kept: str = "kept") -> DataFrame:
    """df with `reason`: the first rule of the list that holds."""
    out = None
    for name, rule in rules:
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return df.withColumn("reason", out.otherwise(kept) if out is not None else F.lit(kept))


def moving(df: DataFrame, by: list[str], time: str, x: str, y: str, back: float, speed: float, keep_unknown: bool = True) -> DataFrame:
    """df with `moving`: speed since the last row at least `back` earlier reaches `speed`; without one, keep_unknown."""
    then = df.withColumn("_now", F.col(time)).withColumn(time, F.col(time) - back)
    j = alignment.asof(then, df.select(*by, time, F.col(x).alias("_x"), F.col(y).alias("_y")), by, time, ["_x", "_y"])
    v = F.hypot(F.col(x) - F.col("r__x"), F.col(y) - F.col("r__y")) / (F.col("_now") - F.col(f"r_{time}"))
    return j.withColumn(time, F.col("_now")).withColumn("moving", F.when(F.col(f"r_{time}").isNull(), F.lit(keep_unknown)).otherwise(v >= speed)).drop("_now", "r__x", "r__y", f"r_{time}")


def edges(cells: DataFrame, session: str, cell: list[str], value: str) -> DataFrame:
    """a, b, n, med, mad of value differences (b - a) over the cells that two sessions share, a < b."""
    x = cells.select(*cell, F.col(session).alias("a"), F.col(value).alias("_va"))
    y = cells.select(*cell, F.col(session).alias("b"), F.col(value).alias("_vb"))
    d = x.join(y, cell).where("a < b").select("a", "b", (F.col("_vb") - F.col("_va")).alias("_d"))
    med = d.groupBy("a", "b").agg(F.median("_d").alias("med"), F.count("*").alias("n"))
    return d.join(med, ["a", "b"]).groupBy("a", "b", "n", "med").agg(F.median(F.abs(F.col("_d") - F.col("med"))).alias("mad"))


def offsets(links: list[tuple], sizes: dict, strong: int = 20, weak: int = 4, weak_mad: float = 4.0) -> dict:
    """Each session's offset and component from edges (a, b, n, med, mad), sessions being few enough for one machine.

    Strong edges form components; weak ones of small deviation only join different components, at half weight.
    Offsets are weighted least squares (weight sqrt(n)) with the component's largest session at 0."""
    parent = {s: s for s in sizes}

    def find(s):
        while parent[s] != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    used = [(a, b, med, n**0.5) for a, b, n, med, _ in links if n >= strong]
    for a, b, *_ in used:
        parent[find(a)] = find(b)
    base = {s: find(s) for s in sizes}
    for a, b, n, med, mad in sorted(links):
        if weak <= n < strong and mad <= weak_mad and base[a] != base[b]:
            used.append((a, b, med, 0.5 * n**0.5))
    for a, b, *_ in used:
        parent[find(a)] = find(b)
    groups: dict = {}
    for s in sorted(sizes):
        groups.setdefault(find(s), []).append(s)
    out = {}
    ordered = sorted(groups.values(), key=lambda g: (-sum(sizes[s] for s in g), min(g)))
    for rank, group in enumerate(ordered):
        ref = max(group, key=lambda s: (sizes[s], [-ord(c) for c in str(s)]))
        free = [s for s in group if s != ref]
        at = {s: i for i, s in enumerate(free)}
        rows = [(a, b, med, w) for a, b, med, w in used if a in set(group)]
        m, v = np.zeros((len(rows), len(free))), np.zeros(len(rows))
        for i, (a, b, med, w) in enumerate(rows):
            if b in at:
                m[i, at[b]] += w
            if a in at:
                m[i, at[a]] -= w
            v[i] = w * med
        sol = np.linalg.lstsq(m, v, rcond=None)[0] if free and len(rows) else np.zeros(len(free))
        for s in group:
            out[s] = (rank, float(sol[at[s]]) if s in at else 0.0)
    return out


def solve_offsets(cells: DataFrame, session: str, cell: list[str], value: str, most_links: int = 200_000) -> DataFrame:
    """(session, component, offset): edges come from Spark as one row a pair of sessions, the system is solved on the driver.

    It is a map's sessions that are solved, not a corpus; over most_links pairs is an error."""
    spark = cells.sparkSession
    links = [tuple(r) for r in edges(cells, session, cell, value).select("a", "b", "n", "med", "mad").limit(most_links + 1).collect()]
    if len(links) > most_links:
        raise ValueError(f"more than {most_links} pairs of sessions share cells; solve map by map")
    sizes = {r[0]: r[1] for r in cells.groupBy(session).count().collect()}
    rows = [(s, k, o) for s, (k, o) in offsets(links, sizes).items()]
    return spark.createDataFrame(rows, f"{session} {cells.schema[session].dataType.simpleString()}, component int, offset double")


def segments(anchors: DataFrame, by: list[str], least_cm: float = 500.0, scale: tuple[float, float] = (0.9, 1.1)) -> DataFrame:
    """Alignment segments between consecutive anchors (t_ms, map_x_cm, map_y_cm, ar_x_cm, ar_z_cm): by, t0, t1, theta, ox, oy, dx, dy.

    Only pairs at least so far apart whose lengths agree within `scale` count; the residual at the end (dx, dy) is
    spread linearly over the segment's time."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("t_ms")
    cols = ("t_ms", "map_x_cm", "map_y_cm", "ar_x_cm", "ar_z_cm")
    n = anchors.select(*by, *cols, *[F.lead(c).over(w).alias(f"n_{c}") for c in cols]).where("n_t_ms is not null")
    mx, my, ax, ay = (F.col(f"n_{c}") - F.col(c) for c in cols[1:])
    lm, la = F.hypot(mx, my), F.hypot(ax, ay)
    n = n.withColumn("_lm", lm).withColumn("_la", la).where((F.col("_lm") >= least_cm) & (F.col("_la") / F.col("_lm")).between(*scale))
    n = n.withColumn("theta", F.atan2(my, mx) - F.atan2(ay, ax))
    c, s = F.cos("theta"), F.sin("theta")
    ex, ey = F.col("map_x_cm") + c * ax - s * ay, F.col("map_y_cm") + s * ax + c * ay
    return n.select(*by, F.col("t_ms").alias("t0"), F.col("n_t_ms").alias("t1"), "theta", F.col("map_x_cm").alias("mx"), F.col("map_y_cm").alias("my"), F.col("ar_x_cm").alias("ax"), F.col("ar_z_cm").alias("az"), (F.col("n_map_x_cm") - ex).alias("dx"), (F.col("n_map_y_cm") - ey).alias("dy"))


def to_map(poses: DataFrame, segs: DataFrame, by: list[str], time: str, x: str, y: str, tail_ms: float = 0.0) -> DataFrame:
    """Poses in map coordinates (map_x, map_y) by the last segment that began; null before the first, and after a segment's end plus tail."""
    cols = [c for c in segs.columns if c not in (*by, "t0")]
    j = alignment.asof(poses, segs.withColumnRenamed("t0", time), by, time, cols, prefix="s_")
    c, s = F.cos("s_theta"), F.sin("s_theta")
    dx, dy = F.col(x) - F.col("s_ax"), F.col(y) - F.col("s_az")
    share = F.least((F.col(time) - F.col(f"s_{time}")) / (F.col("s_t1") - F.col(f"s_{time}")), F.lit(1.0))
    ok = F.col(time) <= F.col("s_t1") + tail_ms
    mx = F.when(ok, F.col("s_mx") + c * dx - s * dy + share * F.col("s_dx"))
    my = F.when(ok, F.col("s_my") + s * dx + c * dy + share * F.col("s_dy"))
    return j.select(*poses.columns, mx.alias("map_x"), my.alias("map_y"))


def quality_gate(rows: DataFrame, by: list[str], time: str, error: str, window_ms: int = 10_000, most: float = 500.0, least_rows: int = 1, reject_share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Dropped spans and verdicts of sessions: windows since the first row whose upper-median error is too large, with one window around each."""
    from lodepath.functions.quantiles import order_statistics, upper_middle
    from lodepath.operators.sequences import dilate, true_spans, tumbling_from_first

    w = tumbling_from_first(rows, by, time, window_ms)
    med = order_statistics(w, [*by, "window"], error, {"med": upper_middle})
    n = w.groupBy(*by, "window").agg(F.count(error).alias("n"))
    bad = n.join(med, [*by, "window"], "left").select(*by, "window", ((F.col("n") >= least_rows) & (F.col("med") > most)).alias("bad"))
    wide = dilate(bad, by, "window", "bad")
    spans = true_spans(wide, by, "window", "dilated")
    first = rows.groupBy(*by).agg(F.min(time).alias("_t0"))
    spans = spans.join(first, by).select(*by, (F.col("_t0") + F.col("start") * window_ms).alias("start_ms"), (F.col("_t0") + F.col("end") * window_ms).alias("end_ms"))
    verdict = wide.groupBy(*by).agg(F.avg(F.col("dilated").cast("int")).alias("dropped")).withColumn("kept", F.col("dropped") <= reject_share)
    return spans, verdict


def hard_iron(samples: DataFrame, by: list[str]) -> DataFrame:
    """by, cx, cy, cz, radius: the least-squares sphere through magnetometer samples, from sums (rows of zeros mean no value)."""
    from lodepath.functions.scalars import no_value

    s = samples.where(~no_value(F.col("mx"), F.col("my"), F.col("mz"))).withColumn("one", F.lit(1.0)).withColumn("q", F.col("mx") ** 2 + F.col("my") ** 2 + F.col("mz") ** 2)
    v = ("mx", "my", "mz", "one")
    sums = s.groupBy(*by).agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(v) for b in v[i:]], *[F.sum(F.col("q") * F.col(a)).alias(f"q_{a}") for a in v])

    def solve(it):
        for pdf in it:
            out = []
            for r in pdf.to_dict("records"):
                m = np.array([[r[f"{v[min(i, j)]}_{v[max(i, j)]}"] for j in range(4)] for i in range(4)])
                p = np.linalg.lstsq(m, np.array([r[f"q_{a}"] for a in v]), rcond=None)[0]
                c = p[:3] / 2
                out.append([*[r[b] for b in by], *c, float(np.sqrt(max(p[3] + c @ c, 0)))])
            yield pdf.__class__(out, columns=[*by, "cx", "cy", "cz", "radius"])

    kinds = ", ".join(f"{b} {samples.schema[b].dataType.simpleString()}" for b in by)
    return sums.mapInPandas(solve, f"{kinds}, cx double, cy double, cz double, radius double")
