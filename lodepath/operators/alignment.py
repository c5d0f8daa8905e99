"""As-of, bracket and interval joins.

As-of joins are a union of both sides and one window by key and time: one shuffle, linear, no matter how many rows
match. With `block`, keys are cut into blocks of time that are sorted apart, so that a key which holds a large part
of all rows isn't one task; what lies before and after a block comes from a table of one row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _both(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str]) -> DataFrame:
    payload = F.struct(F.col(time).alias("_t"), *values)
    row = F.struct(*left.columns)
    a = left.select(*by, F.col(time).alias("_t"), F.lit(1).alias("_side"), row.alias("_row"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_hit"))
    b = right.where(F.col(time).isNotNull()).select(*by, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), payload.alias("_hit"))
    return a.unionByName(b)


def bracket(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], block: float | None = None, sides: tuple[str, ...] = ("prev", "next")) -> DataFrame:
    """left with structs `prev` (last right row at or before) and `next` (first at or after), null if there is none.

    A right row at exactly the time is both. Of right rows of equal time, prev is the largest and next the
    smallest in order of `values`. sides: which of the two to look for; one alone costs half. Each is a running
    maximum or minimum along a sort, forwards or backwards, so a key's rows cost their number, not its square."""
    if block is not None:
        at = F.floor(F.col(time) / block)
        a, b = left.withColumn("_blk", at), right.where(F.col(time).isNotNull()).withColumn("_blk", at)
        keys = [*by, "_blk"]
        row = F.struct(F.col(time).alias("_t"), *values)
        ends = b.groupBy(*keys).agg(F.max(row).alias("_last"), F.min(row).alias("_first"))
        blocks = a.select(*keys).distinct().join(ends, keys, "full")
        w = Window.partitionBy(*by).orderBy("_blk")
        before = F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        after = F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
        around = blocks.select(*keys, before.alias("_before"), after.alias("_after"))
        inside = bracket(a, b, keys, time, values, sides=sides)
        outer = {"prev": "_before", "next": "_after"}
        return inside.join(around, keys, "left").select(*left.columns, *[F.coalesce(c, outer[c]).alias(c) for c in sides])
    every = _both(left, right, by, time, values)
    found = {
        "prev": lambda: F.max("_hit").over(Window.partitionBy(*by).orderBy(F.col("_t").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0)),
        "next": lambda: F.min("_hit").over(Window.partitionBy(*by).orderBy(F.col("_t").desc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0)),
    }
    for c in sides:
        every = every.withColumn(c, found[c]())
    return every.where("_side = 1").select("_row.*", *sides)


def asof(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], direction: str = "backward", tolerance: float | None = None, exact: bool = True, prefix: str = "r_", block: float | None = None) -> DataFrame:
    """left with the matching right row's time and values (prefixed), null where none is within the tolerance (inclusive).

    direction: backward, forward or nearest (ties go backward). exact=False passes over rows of the very time."""
    if not exact:
        shifted = right.withColumn(time, F.col(time) + (1 if direction == "backward" else -1))
        got = asof(left, shifted, by, time, values, direction, None, True, prefix, block)
        t = F.col(f"{prefix}{time}") - (1 if direction == "backward" else -1)
        keep = F.lit(True) if tolerance is None else F.abs(F.col(time) - t) <= tolerance
        return got.withColumn(f"{prefix}{time}", t).select(*left.columns, *[F.when(keep, F.col(f"{prefix}{c}")).alias(f"{prefix}{c}") for c in (time, *values)])
    both = bracket(left, right, by, time, values, block, {"backward": ("prev",), "forward": ("next",)}.get(direction, ("prev", "next")))
    back, fore = F.col("prev"), F.col("next")
    if direction == "backward":
        hit = back
    elif direction == "forward":
        hit = fore
    else:
        nearer = fore.isNull() | (F.col(time) - back["_t"] <= fore["_t"] - F.col(time))
        hit = F.when(back.isNotNull() & nearer, back).otherwise(fore)
    if tolerance is not None:
        hit = F.when(F.abs(F.col(time) - hit["_t"]) <= tolerance, hit)
    return both.withColumn("_h", hit).select(*left.columns, F.col("_h._t").alias(f"{prefix}{time}"), *[F.col(f"_h.{v}").alias(f"{prefix}{v}") for v in values])


def interpolate(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], max_gap: float | None = None, beyond: float = 0.0, prefix: str = "r_", block: float | None = None) -> DataFrame:
    """left with right's numeric values interpolated linearly at its time.

    max_gap bounds the distance of the two bracketing rows; beyond: how far past the first or last row its value
    still holds. Null elsewhere."""
    both = bracket(left, right, by, time, values, block)
    t, a, b = F.col(time), F.col("prev"), F.col("next")
    gap = b["_t"] - a["_t"]
    share = F.when(gap > 0, (t - a["_t"]) / gap).otherwise(F.lit(0.0))
    fits = a.isNotNull() & b.isNotNull()
    if max_gap is not None:
        fits = fits & (gap <= max_gap)

    def at(v: str) -> Column:
        inner = F.when(fits, a[v] + (b[v] - a[v]) * share)
        held = F.when(b.isNull() & (t - a["_t"] <= beyond), a[v]).when(a.isNull() & (b["_t"] - t <= beyond), b[v])
        return F.coalesce(inner, held).alias(f"{prefix}{v}")

    return both.select(*left.columns, *[at(v) for v in values])


def within(points: DataFrame, spans: DataFrame, by: list[str], time: str, start: str, end: str, bin_size: int, how: str = "inner") -> DataFrame:
    """Points joined with spans that hold their time (both ends included), by time bins so that it is an equi-join.

    A span is repeated once for each bin that it touches. how: inner, left_semi or left_anti."""
    p = points.withColumn("_bin", F.floor(F.col(time) / bin_size))
    s = spans.where(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size))))
    s = s.select(*[F.col(c).alias(f"_s_{c}") for c in (*by, "_bin")], *[c for c in spans.columns if c not in by])
    on = [p[c] == s[f"_s_{c}"] for c in (*by, "_bin")] + [p[time].between(s[start], s[end])]
    return p.join(s, on, how).drop("_bin", "_s__bin", *[f"_s_{c}" for c in by])


def overlap(a: DataFrame, b: DataFrame, key: list[str], start: str, end: str, least: float) -> DataFrame:
    """Pairs of windows of a key whose common part lasts at least so long: keys, lo, hi."""
    x, y = a.select(*key, F.col(start).alias("_a0"), F.col(end).alias("_a1")), b.select(*key, F.col(start).alias("_b0"), F.col(end).alias("_b1"))
    both = x.join(y, key).select(*key, F.greatest("_a0", "_b0").alias("lo"), F.least("_a1", "_b1").alias("hi"))
    return both.where(F.col("hi") - F.col("lo") >= least)


def occurrence_pairs(a: DataFrame, b: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """The k-th row of a key on one side with the k-th on the other: keys, k, a_value, b_value."""
    number = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    x = a.select(*key, number.alias("k"), F.col(value).alias("a_value"))
    y = b.select(*key, number.alias("k"), F.col(value).alias("b_value"))
    return x.join(y, [*key, "k"])
