"""Evaluation reports: pooled metrics, comparison with a baseline, ladders, office metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodepath.functions import quantiles as qt


def scenario_metrics(reports: DataFrame, by: list[str], wrong_over: float = 500.0, close: float = 200.0) -> DataFrame:
    """Metrics of reports (by..., errors ARRAY<DOUBLE>, ref_points, first_fix_m): quantiles and shares over all points of all reports.

    Without any error the quantiles, shares and first fix are null, coverage and fixed share 0."""
    points = reports.select(*by, F.explode("errors").alias("e"))
    q = qt.order_statistics(points, by, "e", {n: (lambda c, p=p: qt.nearest_rank(c, p)) for n, p in (("median_cm", 0.5), ("p75_cm", 0.75), ("p90_cm", 0.9))})
    share = points.groupBy(*by).agg(F.count("*").alias("points"), F.avg((F.col("e") > wrong_over).cast("int")).alias("wrong_fix"), F.avg((F.col("e") <= close).cast("int")).alias("within2m"))
    tot = reports.groupBy(*by).agg(F.count("*").alias("replays"), F.sum("ref_points").alias("_ref"), F.avg(F.when(F.size("errors") > 0, 1).otherwise(0)).alias("fixed_share"))
    first = qt.order_statistics(reports, by, "first_fix_m", {"first_fix_m": lambda c: qt.nearest_rank(c, 0.5)})
    out = tot.join(q, by, "left").join(share, by, "left").join(first, by, "left").withColumn("points", F.coalesce("points", F.lit(0)))
    return out.withColumn("coverage", F.coalesce(F.try_divide("points", "_ref"), F.lit(0.0))).drop("_ref")


def unpivot(df: DataFrame, keys: list[str], metrics: list[str], value: str) -> DataFrame:
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(value)) for m in metrics])).alias("x")).select(*keys, "x.metric", f"x.{value}")


def compare(now: DataFrame, base: DataFrame, keys: list[str], tolerance: dict[str, tuple[float, float]], higher_is_better: tuple[str, ...] = ()) -> DataFrame:
    """keys, metric, v, base, verdict (new, worse, better, flat); tolerance: metric -> (share of the baseline, absolute).

    A value that is null where the baseline has one is worse; the reverse is better."""
    names = list(tolerance)
    a, b = unpivot(now, keys, names, "v"), unpivot(base, keys, names, "base").withColumn("_there", F.lit(True))
    both = a.join(b, [*keys, "metric"], "left")
    tol: Column | None = None
    for m, (rel, abs_) in tolerance.items():
        t = F.abs("base") * rel + abs_
        tol = F.when(F.col("metric") == m, t) if tol is None else tol.when(F.col("metric") == m, t)
    sign = F.when(F.col("metric").isin(*higher_is_better), -1).otherwise(1)
    diff = (F.col("v") - F.col("base")) * sign
    verdict = (
        F.when(F.col("_there").isNull() | (F.col("base").isNull() & F.col("v").isNull()), "new").when(F.col("v").isNull(), "worse").when(F.col("base").isNull(), "better")
        .when(diff > tol, "worse").when(diff < -tol, "better").otherwise("flat")
    )
    return both.withColumn("verdict", verdict).drop("_there")


def ladder(metrics: DataFrame, key: str, levels: list[tuple[str, dict[str, float]]], at_least: tuple[str, ...] = ("coverage", "room")) -> DataFrame:
    """key, level: the last level of the list whose thresholds all hold ('none' if none does)."""
    out = F.lit("none")
    for name, limits in levels:
        ok = F.lit(True)
        for m, v in limits.items():
            ok = ok & F.coalesce(F.col(m) >= v if m in at_least else F.col(m) <= v, F.lit(False))
        out = F.when(ok, name).otherwise(out)
    return metrics.select(key, out.alias("level"))


def transitions(points: DataFrame, by: list[str], time: str, room: str, seen: str, hold: float, late: float) -> DataFrame:
    """by, at, room, latency: each change of the true room over judged points, and the time until the estimate has been in it for `hold`.

    Null where that takes longer than `late` or the room is left before."""
    w = Window.partitionBy(*by).orderBy(time)
    p = points.withColumn("_new", (F.lag(room).over(w) != F.col(room)))
    p = p.withColumn("_stay", F.sum(F.coalesce(F.col("_new"), F.lit(False)).cast("int")).over(w))
    p = p.withColumn("_ok", F.coalesce(F.col(seen) == F.col(room), F.lit(False)))
    stay = Window.partitionBy(*by, "_stay").orderBy(time)
    p = p.withColumn("_run", F.sum((~F.col("_ok")).cast("int")).over(stay))
    good = p.where("_ok").groupBy(*by, "_stay", "_run").agg(F.min(time).alias("_a"), F.max(time).alias("_b")).where(F.col("_b") - F.col("_a") >= hold).groupBy(*by, "_stay").agg(F.min("_a").alias("_a"))
    starts = p.where("_stay > 0").groupBy(*by, "_stay").agg(F.min(time).alias("at"), F.min_by(room, time).alias("room"))
    both = starts.join(good, [*by, "_stay"], "left")
    return both.select(*by, "at", "room", F.when(F.col("_a") - F.col("at") <= late, F.col("_a") - F.col("at")).alias("latency"))
