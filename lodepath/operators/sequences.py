"""Sequence operators over rows ordered in a key: runs, flags, thinning, holds, resampling, autocorrelation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], order: str, new: Column | None = None, flag: str | None = None) -> DataFrame:
    """df with `island`: a number that grows where `new` holds, or where the flag's value changes."""
    w = Window.partitionBy(*by).orderBy(order)
    start = new if new is not None else (F.lag(flag).over(w).isNull() | (F.lag(flag).over(w) != F.col(flag)))
    return df.withColumn("_new", F.coalesce(start, F.lit(True)).cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gap_groups(df: DataFrame, by: list[str], time: str, low: float, high: float) -> DataFrame:
    """df with `island`: a row joins the one before it if their gap is within [low, high]."""
    gap = F.col(time) - F.lag(time).over(Window.partitionBy(*by).orderBy(time))
    return islands(df, by, time, new=~F.coalesce(gap.between(low, high), F.lit(False)))


def true_spans(df: DataFrame, by: list[str], index: str, flag: str) -> DataFrame:
    """by, start, end (exclusive) of each run of consecutive indexes whose flag holds."""
    runs = df.where(F.col(flag)).withColumn("_r", F.col(index) - F.row_number().over(Window.partitionBy(*by).orderBy(index)))
    return runs.groupBy(*by, "_r").agg(F.min(index).alias("start"), (F.max(index) + 1).alias("end")).drop("_r")


def spine(df: DataFrame, by: list[str], index: str) -> DataFrame:
    """Every index from a key's first to its last, so that windows without rows are there."""
    ends = df.groupBy(*by).agg(F.min(index).alias("_a"), F.max(index).alias("_b"))
    return ends.select(*by, F.explode(F.sequence("_a", "_b")).alias(index))


def dilate(df: DataFrame, by: list[str], index: str, flag: str, around: int = 1) -> DataFrame:
    """df on its spine with `dilated`: the flag of any index within so many."""
    whole = spine(df, by, index).join(df, [*by, index], "left")
    near = Window.partitionBy(*by).orderBy(index).rowsBetween(-around, around)
    return whole.withColumn("dilated", F.coalesce(F.max(F.col(flag)).over(near), F.lit(False)))


def bridge(df: DataFrame, by: list[str], index: str, good: str, dropped: str, around: int = 2) -> DataFrame:
    """df on its spine with `trusted`: good, or neither good nor dropped with a good one and no dropped one near."""
    whole = spine(df, by, index).join(df, [*by, index], "left")
    near = Window.partitionBy(*by).orderBy(index).rowsBetween(-around, around)
    g, d = F.coalesce(F.col(good), F.lit(False)), F.coalesce(F.col(dropped), F.lit(False))
    return whole.withColumn("trusted", g | (~d & F.max(g).over(near) & ~F.max(d).over(near)))


def carried(df: DataFrame, by: list[str], columns: list[str], out: str, start, fold) -> DataFrame:
    """by and `out` columns from a fold along each key's rows in order of `columns`, in batches of sorted partitions.

    fold(state, arrays) takes a run of a key's rows as one array a column and gives (state, output columns); only the
    state is kept between batches, so a long key takes no more memory than a short one."""

    def run(batches):
        import pandas as pd

        now, state = None, start
        for pdf in batches:
            code = pdf.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
            heads = [0, *([i for i in range(1, len(code)) if code[i] != code[i - 1]] if len(code) and code.min() != code.max() else []), len(code)]
            parts = []
            for lo, hi in zip(heads[:-1], heads[1:], strict=True):
                if lo == hi:
                    continue
                key = tuple(None if pd.isna(pdf[k].iloc[lo]) else pdf[k].iloc[lo] for k in by)  # 1 and 1.0 are equal: nulls in a batch change the type
                if key != now:
                    now, state = key, start
                state, got = fold(state, [pdf[c].to_numpy()[lo:hi] for c in columns])
                part = pd.DataFrame(got)
                for k in reversed(by):
                    part.insert(0, k, pdf[k].iloc[lo : lo + 1].repeat(len(part)).to_numpy())
                parts.append(part)
            if parts:
                yield pd.concat(parts, ignore_index=True)

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)
    rows = df.select(*by, *columns).repartition(*by).sortWithinPartitions(*by, *columns)
    return rows.mapInPandas(run, f"{keys}, {out}")


def thin(df: DataFrame, by: list[str], time: str, least: float) -> DataFrame:
    """by, time of rows kept greedily: at least so long after the last one kept; null times are left out."""

    def fold(last, arrays):
        import numpy as np

        t, kept = arrays[0], []
        i = 0 if last is None else int(np.searchsorted(t, last + least))
        while i < len(t):
            last = t[i]
            kept.append(last)
            i = int(np.searchsorted(t, last + least)) if least > 0 else i + 1
        return last, {time: np.array(kept, dtype=np.int64)}

    times = df.select(*by, F.col(time).cast("bigint").alias(time)).where(F.col(time).isNotNull())
    return carried(times, by, [time], f"`{time}` bigint", None, fold)


def low_pass(df: DataFrame, by: list[str], time: str, value: str, tau: float, restart: float) -> DataFrame:
    """by, time, smooth: an exponential low pass of time constant tau; a gap over `restart`, or none, starts anew."""

    def fold(state, arrays):
        out = []
        for t, v in zip(arrays[0].tolist(), arrays[1].tolist(), strict=True):
            dt = 0.0 if state is None else t - state[0]
            s = v if state is None or dt <= 0 or dt > restart else state[1] + dt / (tau + dt) * (v - state[1])
            state = (t, s)
            out.append(s)
        return state, {time: arrays[0].astype("int64"), "smooth": out}

    rows = df.select(*by, F.col(time).cast("double").alias(time), F.col(value).cast("double").alias(value)).where(F.col(time).isNotNull())
    return carried(rows, by, [time, value], f"`{time}` bigint, smooth double", None, fold)


def tumbling_quality(df: DataFrame, by: list[str], time: str, good: str, size: int) -> DataFrame:
    """by, win, n, score: windows since a key's first row, empty ones included, scored by their share of good rows."""
    first = F.min(time).over(Window.partitionBy(*by))
    win = df.withColumn("win", F.floor((F.col(time) - first) / size)).groupBy(*by, "win").agg(F.count("*").alias("n"), F.avg(F.col(good).cast("int")).alias("score"))
    whole = win.groupBy(*by).agg(F.max("win").alias("_m")).select(*by, F.explode(F.sequence(F.lit(0).cast("bigint"), "_m")).alias("win"))
    return whole.join(win, [*by, "win"], "left").select(*by, "win", F.coalesce("n", F.lit(0)).alias("n"), "score")


def recent_bias(df: DataFrame, by: list[str], time: str, value: str, keep: int = 180, least: int = 5, second: int = 1000) -> DataFrame:
    """by, sec, bias: the upper median of the last `keep` seconds' means (seconds with rows), from `least` on."""
    means = df.groupBy(*by, F.floor(F.col(time) / second).alias("sec")).agg(F.avg(value).alias("m"))
    last = F.sort_array(F.collect_list("m").over(Window.partitionBy(*by).orderBy("sec").rowsBetween(1 - keep, 0)))
    seen = means.select(*by, "sec", last.alias("v")).where(F.size("v") >= least)
    return seen.select(*by, "sec", F.element_at("v", (F.floor(F.size("v") / 2) + 1).cast("int")).alias("bias"))


def tag_window(df: DataFrame, by: list[str], time: str, tag: str, rssi: str, short: int = 1500, long: int = 3000, least: int = 3) -> DataFrame:
    """by, time, tag, mean, n: a reading's tag over (now - short, now], widened to `long` where all tags have under `least` readings.

    Readings of one time count for each other, in whatever order they came."""
    at = F.col(time).cast("bigint")
    w = lambda keys, span: Window.partitionBy(*keys).orderBy(at).rangeBetween(1 - span, 0)
    few = F.count("*").over(w(by, short)) < least
    near, wide = w([*by, tag], short), w([*by, tag], long)
    return df.select(*by, at.alias(time), tag, F.when(few, F.avg(rssi).over(wide)).otherwise(F.avg(rssi).over(near)).alias("mean"), F.when(few, F.count("*").over(wide)).otherwise(F.count("*").over(near)).alias("n"))


def steps(df: DataFrame, by: list[str], time: str, x: str, y: str) -> DataFrame:
    """df with `step`: distance from the row before (null at the first)."""
    w = Window.partitionBy(*by).orderBy(time)
    return df.withColumn("step", F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)))


def path_length(df: DataFrame, by: list[str], time: str, x: str, y: str, jump: float | None = None) -> DataFrame:
    """df with `path`: the cumulative path, without steps of at least `jump`."""
    s = steps(df, by, time, x, y)
    add = F.coalesce(F.col("step") if jump is None else F.when(F.col("step") < jump, F.col("step")), F.lit(0.0))
    return s.withColumn("path", F.sum(add).over(Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)))


def moving_average(value: str, by: list[str], order: str, n: int) -> Column:
    """Centred over an odd number of rows, cut short at both ends."""
    return F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-(n // 2), n // 2))


def peaks(df: DataFrame, by: list[str], time: str, value: str, least: float) -> DataFrame:
    """Rows of at least `least`, not below the row before and above the one after, with the vertex of their parabola as `at`."""
    w = Window.partitionBy(*by).orderBy(time)
    v, a, b = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    marked = df.withColumn("_a", a).withColumn("_b", b).withColumn("_dt", (F.lead(time).over(w) - F.lag(time).over(w)) / 2)
    bend = F.col("_a") - 2 * v + F.col("_b")
    shift = F.when(bend != 0, F.lit(0.5) * (F.col("_a") - F.col("_b")) / bend).otherwise(F.lit(0.0))
    return marked.where((v >= least) & (v >= F.col("_a")) & (v > F.col("_b"))).withColumn("at", F.col(time) + shift * F.col("_dt")).drop("_a", "_b", "_dt")


def first_hold(df: DataFrame, by: list[str], time: str, flag: str, hold: float) -> DataFrame:
    """by, at: the start of the first run of true flags that spans at least `hold`; null if there is none."""
    runs = islands(df, by, time, flag=flag).where(F.col(flag)).groupBy(*by, "island").agg(F.min(time).alias("a"), F.max(time).alias("b"))
    return df.select(*by).distinct().join(runs.where(F.col("b") - F.col("a") >= hold).groupBy(*by).agg(F.min("a").alias("at")), by, "left")


def onsets(flag: str, by: list[str], order: str) -> Column:
    """1 where a run of true flags begins."""
    return (F.col(flag) & ~F.coalesce(F.lag(flag).over(Window.partitionBy(*by).orderBy(order)), F.lit(False))).cast("int")


def tumbling_from_first(df: DataFrame, by: list[str], time: str, size: int) -> DataFrame:
    """df with `window`: whole sizes since the key's first row (not since the epoch)."""
    first = F.min(time).over(Window.partitionBy(*by))
    return df.withColumn("window", F.floor((F.col(time) - first) / size))


def autocorrelation(df: DataFrame, by: list[str], order: str, value: str, lags: int) -> DataFrame:
    """by, lag, r: sum of products of deviations at a lag over the sum of squares (population)."""
    w = Window.partitionBy(*by)
    centred = df.withColumn("_d", F.col(value) - F.avg(value).over(w))
    ahead = centred.select(*by, "_d", *[F.lead("_d", k).over(w.orderBy(order)).alias(f"_l{k}") for k in range(1, lags + 1)])
    sums = ahead.groupBy(*by).agg(F.sum(F.col("_d") * F.col("_d")).alias("_s"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, lags + 1)])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_c{k}"), F.col("_s")).alias("r")) for k in range(1, lags + 1)]))
    return sums.select(*by, pairs.alias("x")).select(*by, "x.lag", "x.r")


def integrated_time(auto: DataFrame, by: list[str], least: float = 0.05) -> DataFrame:
    """by, tau: 1 + 2 * sum of r up to the first lag with r below `least`."""
    w = Window.partitionBy(*by).orderBy("lag")
    below = F.max((F.coalesce(F.col("r"), F.lit(0.0)) < least).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return auto.withColumn("_x", below).groupBy(*by).agg((1 + 2 * F.coalesce(F.sum(F.when(F.col("_x") == 0, F.col("r"))), F.lit(0.0))).alias("tau"))


def resample(df: DataFrame, by: list[str], distance: str, value: str, ds: float) -> DataFrame:
    """by, bin, mean: mean of a value by bins of path."""
    return df.groupBy(*by, F.floor(F.col(distance) / ds).alias("bin")).agg(F.avg(value).alias("mean"))


def subsequences(df: DataFrame, by: list[str], order: str, value: str, length: int) -> DataFrame:
    """by, order, fwd, rev: each row's next `length` values with their mean taken off, and the same reversed."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(0, length - 1)
    seq = df.select(*by, order, F.collect_list(value).over(w).alias("s")).where(F.size("s") == length)
    mean = F.aggregate("s", F.lit(0.0), lambda a, v: a + v) / length
    return seq.withColumn("fwd", F.transform("s", lambda v: v - mean)).withColumn("rev", F.reverse("fwd")).drop("s")


def recent_scores(df: DataFrame, by: list[str], order: str, score: str, counted: str, n: int = 6) -> DataFrame:
    """df's counted rows with `recent`: mean score of the last n of them."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0)
    return df.where(F.col(counted)).withColumn("recent", F.avg(score).over(w))
