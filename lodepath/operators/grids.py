"""Magnetic-field grids as sparse tables (keys, row, col, n, mean, m2): aggregation, merging, filling, sampling.

(n, mean, m2) merge exactly and in any order (Chan's formula), so partial grids are kept as tables and combined by
aggregations; no grid is ever gathered into an array outside a sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_of(x: Column, cell: float, count: int | Column) -> Column:
    """Index of a cell; a point on the upper edge is in the last one."""
    return F.least(F.floor(x / cell), F.lit(count) - 1 if isinstance(count, int) else count - 1)


def in_bounds(x: Column, y: Column, width: float, height: float) -> Column:
    return (x >= 0) & (x <= width) & (y >= 0) & (y <= height)


def aggregate(samples: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and n, and for each value mean_<v> and m2_<v> (sum of squared deviations)."""
    aggs = [F.count("*").alias("n")]
    for v in values:
        aggs += [F.avg(v).alias(f"mean_{v}"), (F.coalesce(F.var_pop(v), F.lit(0.0)) * F.count(v)).alias(f"m2_{v}")]
    return samples.groupBy(*keys).agg(*aggs)


def merge(parts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Partial grids (rows of aggregate()) into one: Chan's between-parts term is each part's n (mean - cell's mean) ** 2.

    The cell's mean comes first, and parts then meet it, so that no large squares are taken from each other."""
    n = F.sum("n")
    means = parts.groupBy(*keys).agg(*[(F.sum(F.col("n") * F.col(f"mean_{v}")) / n).alias(f"_cell_{v}") for v in values])
    aggs = [n.alias("n")]
    for v in values:
        off = F.col(f"mean_{v}") - F.col(f"_cell_{v}")
        aggs += [F.first(f"_cell_{v}").alias(f"mean_{v}"), F.sum(F.col(f"m2_{v}") + F.col("n") * off * off).alias(f"m2_{v}")]
    same = [F.col(f"_p.{k}").eqNullSafe(F.col(f"_m.{k}")) for k in keys]
    both = parts.alias("_p").join(means.alias("_m"), same).select("_p.*", *[f"_cell_{v}" for v in values])
    return both.groupBy(*keys).agg(*aggs)


def sigma(n: Column, m2: Column, floor: float = 0.5) -> Column:
    """Standard deviation of a cell, at least `floor`; 0 for a single sample."""
    return F.when(n > 1, F.greatest(F.sqrt(m2 / (n - 1)), F.lit(floor))).otherwise(F.lit(0.0))


def merge_capped(survey: DataFrame, live: DataFrame, keys: list[str], value: str, weight: float = 0.3, share: float = 0.5, conflict: float = 8.0, fill_least: int = 8, fill_sigma: float = 1.5) -> DataFrame:
    """A survey grid healed by a live one: keys, n, mean, sigma, action.

    A live cell weighs min(weight * n, share * survey n), is left out under 0.5, and is a conflict where the mean
    would be more than `conflict` off; cells that the survey lacks are filled from fill_least samples up."""
    a = survey.select(*keys, F.col("n").alias("sn"), F.col(f"mean_{value}").alias("sm"), F.col(f"m2_{value}").alias("s2"))
    b = live.select(*keys, F.col("n").alias("ln"), F.col(f"mean_{value}").alias("lm"), F.col(f"m2_{value}").alias("l2"))
    both = a.join(b, keys, "full").withColumn("w", F.least(F.col("ln") * weight, F.col("sn") * share))
    only = F.col("sn").isNull()
    action = (
        F.when(only & (F.col("ln") >= fill_least), "fill").when(only, "none").when(F.col("ln").isNull() | (F.col("w") < 0.5), "keep")
        .when(F.abs(F.col("lm") - F.col("sm")) > conflict, "conflict").otherwise("merge")
    )
    mean = F.when(F.col("action") == "fill", F.col("lm")).when(F.col("action") == "merge", (F.col("sn") * F.col("sm") + F.col("w") * F.col("lm")) / (F.col("sn") + F.col("w"))).otherwise(F.col("sm"))
    s = F.when(F.col("action") == "fill", sigma(F.col("ln"), F.col("l2")) * fill_sigma).otherwise(sigma(F.col("sn"), F.col("s2")))
    return both.withColumn("action", action).where("action <> 'none'").select(*keys, F.coalesce("sn", "ln").alias("n"), mean.alias("mean"), s.alias("sigma"), "action")


def neighbours(cells: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Each cell sent to all cells within `reach` rows and columns: to_row, to_col, dr, dc and its own columns."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    out = cells.withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span))
    return out.withColumn("to_row", F.col("row") + F.col("dr")).withColumn("to_col", F.col("col") + F.col("dc"))


def fill_idw(cells: DataFrame, targets: DataFrame, keys: list[str], value: str, cell: float, radius: float, power: float = 2.0) -> DataFrame:
    """Targets (keys, row, col) that cells lack, by inverse-distance weighting of cells within a radius: keys, row, col, filled, nearest."""
    holes = targets.join(cells, [*keys, "row", "col"], "left_anti")
    near = neighbours(cells.select(*keys, "row", "col", value), keys, int(radius // cell))
    d = F.sqrt((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double")) * cell
    sent = near.withColumn("d", d).where((F.col("d") > 0) & (F.col("d") <= radius)).select(*keys, F.col("to_row").alias("row"), F.col("to_col").alias("col"), "d", value)
    w = 1 / F.pow("d", F.lit(power))
    return holes.join(sent, [*keys, "row", "col"]).groupBy(*keys, "row", "col").agg((F.sum(w * F.col(value)) / F.sum(w)).alias("filled"), F.min("d").alias("nearest"))


def sample_bilinear(points: DataFrame, cells: DataFrame, keys: list[str], pid: str, value: str, cell: float, rows: int, cols: int, least: float = 0.25) -> DataFrame:
    """pid, value at points (x, y) from the four cells around, at cell centres, clamped to the edge; null under a valid weight of `least`."""
    fx, fy = F.col("x") / cell - 0.5, F.col("y") / cell - 0.5
    p = points.withColumn("_cx", F.least(F.greatest(fx, F.lit(0.0)), F.lit(cols - 1.0))).withColumn("_cy", F.least(F.greatest(fy, F.lit(0.0)), F.lit(rows - 1.0)))
    p = p.withColumn("_c", F.least(F.floor("_cx"), F.lit(max(cols - 2, 0)))).withColumn("_r", F.least(F.floor("_cy"), F.lit(max(rows - 2, 0))))
    p = p.withColumn("_tx", F.col("_cx") - F.col("_c")).withColumn("_ty", F.col("_cy") - F.col("_r"))
    corner = F.explode(F.array(*[
        F.struct((F.col("_r") + dr).alias("row"), (F.col("_c") + dc).alias("col"), ((F.col("_ty") if dr else 1 - F.col("_ty")) * (F.col("_tx") if dc else 1 - F.col("_tx"))).alias("w"))
        for dr in (0, 1) for dc in (0, 1)
    ]))
    sent = p.select(*keys, pid, corner.alias("_k")).select(*keys, pid, F.col("_k.row").alias("row"), F.col("_k.col").alias("col"), F.col("_k.w").alias("w"))
    hit = sent.join(cells.select(*keys, "row", "col", F.col(value).alias("_v")), [*keys, "row", "col"], "left")
    good = F.sum(F.when(F.col("_v").isNotNull(), F.col("w")).otherwise(F.lit(0.0)))
    return hit.groupBy(*keys, pid).agg(F.when(good >= least, F.sum(F.col("w") * F.col("_v")) / good).alias("value"))


def blur(cells: DataFrame, keys: list[str], value: str, sd: float, reach: int) -> DataFrame:
    """A Gaussian blur over present cells, weights normalised."""
    w = F.exp(-(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")) / F.lit(2 * sd * sd))
    sent = neighbours(cells.select(*keys, "row", "col", value), keys, reach).select(*keys, F.col("to_row").alias("row"), F.col("to_col").alias("col"), w.alias("w"), value)
    sums = sent.groupBy(*keys, "row", "col").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("blurred"))
    return sums.join(cells.select(*keys, "row", "col"), [*keys, "row", "col"], "left_semi")


def grow(cells: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """The disc dilation of a set of cells."""
    near = neighbours(cells.select(*keys, "row", "col"), keys, reach).where(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc") <= reach * reach)
    return near.select(*keys, F.col("to_row").alias("row"), F.col("to_col").alias("col")).distinct()


def runs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Row-wise runs of cells as rectangles: keys, c0, c1, r0, r1; equal runs of adjacent rows are one."""
    from pyspark.sql import Window

    a = cells.select(*keys, "row", "col").distinct().withColumn("_g", F.col("col") - F.row_number().over(Window.partitionBy(*keys, "row").orderBy("col")))
    a = a.groupBy(*keys, "row", "_g").agg(F.min("col").alias("c0"), F.max("col").alias("c1"))
    a = a.withColumn("_h", F.col("row") - F.row_number().over(Window.partitionBy(*keys, "c0", "c1").orderBy("row")))
    return a.groupBy(*keys, "c0", "c1", "_h").agg(F.min("row").alias("r0"), F.max("row").alias("r1")).drop("_h")


def change_blocks(residuals: DataFrame, keys: list[str], value: str, sigma_col: str, time: str, least: float = 2.0, samples: int = 8) -> DataFrame:
    """Blocks whose mean residual is at least max(least, last sigma), from so many samples up."""
    g = residuals.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.max_by(sigma_col, time).alias("last_sigma"))
    return g.where((F.col("n") >= samples) & (F.abs("mean") >= F.greatest(F.lit(least), F.col("last_sigma"))))


def coverage(points: DataFrame, cells: DataFrame, group: list[str], least: int = 5) -> DataFrame:
    """Share of a corridor's sample points (row, col, across_row, across_col) with enough samples in their cell or one beside it."""
    side = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    sent = points.withColumn("_s", side).withColumn("row", F.col("row") + F.col("_s") * F.col("across_row")).withColumn("col", F.col("col") + F.col("_s") * F.col("across_col"))
    hit = sent.join(cells.where(F.col("n") >= least).select("row", "col", F.lit(1).alias("_hit")), ["row", "col"], "left")
    per = hit.groupBy(*group, "point").agg(F.max(F.coalesce("_hit", F.lit(0))).alias("_c"))
    return per.groupBy(*group).agg(F.avg("_c").alias("covered"))
