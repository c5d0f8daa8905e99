"""Radio fingerprints: learning, matching and calibrating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def power(rssi: Column) -> Column:
    return F.pow(F.lit(10.0), (rssi + 100) / 10)


def tag_centroids(readings: DataFrame, tag: str = "tag", rssi: str = "rssi", strong: float = -85, least: int = 5, moving: float = 1500) -> DataFrame:
    """tag, n, x, y (centroid weighted by power), spread of strong readings about it (null under `least`), moving.

    The spread's second moments are those of strong readings alone, taken about the centroid of all readings."""
    w, s = power(F.col(rssi)), (F.col(rssi) >= strong).cast("double")
    sums = readings.groupBy(tag).agg(
        F.count("*").alias("n"), (F.sum(w * F.col("x")) / F.sum(w)).alias("cx"), (F.sum(w * F.col("y")) / F.sum(w)).alias("cy"), F.sum(s).alias("k"),
        F.sum(s * F.col("x")).alias("sx"), F.sum(s * F.col("y")).alias("sy"), F.sum(s * (F.col("x") ** 2 + F.col("y") ** 2)).alias("s2"),
    )
    about = F.col("s2") - 2 * (F.col("cx") * F.col("sx") + F.col("cy") * F.col("sy")) + F.col("k") * (F.col("cx") ** 2 + F.col("cy") ** 2)
    spread = F.when(F.col("k") >= least, F.sqrt(F.greatest(about / F.col("k"), F.lit(0.0))))
    return sums.select(tag, "n", F.col("cx").alias("x"), F.col("cy").alias("y"), spread.alias("spread"), F.coalesce(spread > moving, F.lit(False)).alias("moving"))


def two_level(readings: DataFrame, outer: list[str], inner: str, value: str) -> DataFrame:
    """outer, best: the greatest of the inner keys' means."""
    return readings.groupBy(*outer, inner).agg(F.avg(value).alias("_m")).groupBy(*outer).agg(F.max("_m").alias("best"))


def interval_union(ranges: DataFrame, grains: list[list[str]], low: str, high: str) -> DataFrame:
    """Least low and greatest high at several grains at once (grouping sets); grains' missing keys are null."""
    cols = list(dict.fromkeys(c for g in grains for c in g))
    return ranges.groupingSets([[F.col(c) for c in g] for g in grains], *cols).agg(F.min(low).alias("low"), F.max(high).alias("high"))


def union_distance(a: Column, b: Column, missing: float = -100.0) -> Column:
    """Root mean square difference of two maps id -> dBm over the union of ids; absent ids count as `missing`."""
    both = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.pow(F.coalesce(x, F.lit(missing)) - F.coalesce(y, F.lit(missing)), F.lit(2.0))))
    return F.sqrt(F.aggregate(both, F.lit(0.0), lambda s, v: s + v) / F.size(both))


def knn(distances: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """The k nearest of each query (ties keep the earlier), and position weights 1 / (d + 1)."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy("d", *order))
    return distances.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("w", 1 / (F.col("d") + 1))


def softmax(df: DataFrame, by: list[str], score: str, temperature: float = 1.0) -> DataFrame:
    """df with `p`: the scores' softmax within a key."""
    w = Window.partitionBy(*by)
    e = F.exp((F.col(score) - F.max(score).over(w)) / temperature)
    return df.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def log_likelihood(observed: DataFrame, ranges: DataFrame, oid: str, pid: str, tag: str, miss: float, unexpected: float, sd: float = 6.0, blocks: int = 1) -> DataFrame:
    """oid, pid, ll of points' tag ranges (low, high): squared distance outside the range, and a penalty for each tag not seen or not known.

    A tag's pairs are spread over `blocks` of points, to each of which all observations go."""
    o, r = observed.select(oid, tag, "rssi"), ranges.select(pid, tag, "low", "high")
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    seen = o.withColumn("_b", each).join(r.withColumn("_b", F.pmod(F.xxhash64(pid), F.lit(blocks)).cast("int")), [tag, "_b"]).withColumn("_z", F.greatest(F.col("low") - F.col("rssi"), F.col("rssi") - F.col("high"), F.lit(0.0)) / sd)
    both = seen.groupBy(oid, pid).agg(F.sum(-0.5 * F.col("_z") ** 2).alias("_s"), F.count("*").alias("_k"))
    n_o, n_r = o.groupBy(oid).agg(F.count("*").alias("_no")), r.groupBy(pid).agg(F.count("*").alias("_nr"))
    return both.join(n_o, oid).join(n_r, pid).select(oid, pid, (F.col("_s") - miss * (F.col("_nr") - F.col("_k")) - unexpected * (F.col("_no") - F.col("_k"))).alias("ll"))


def likelihoods(left, right, miss: float, unexpected: float, sd: float):
    """(ll, tags in common) of observations against points: two Arrow tables with lists (tags `t`, null for none known) of rssi `v`, or of `low` and `high`, and counts `n`. Arrays (observations, points)."""
    import numpy as np

    def flat(t, names):
        n = t.column("t").combine_chunks()
        tags = n.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(n)), n.value_lengths().to_numpy(zero_copy_only=False).astype(int))
        lists = [t.column(c).combine_chunks().flatten() for c in names]
        return row, tags, [(c.to_numpy(zero_copy_only=False).astype(float), c.is_null().to_numpy(zero_copy_only=False)) for c in lists]

    orow, otag, [(v, none)] = flat(left, ["v"])
    prow, ptag, [(low, no_low), (high, no_high)] = flat(right, ["low", "high"])
    tags = np.unique(otag)
    known = np.isin(ptag, tags)
    ptag, prow = np.searchsorted(tags, ptag[known]), prow[known]
    otag = np.searchsorted(tags, otag)
    # a tag that a point lacks, or knows no bound of, is in reach of any reading
    lows, highs = np.full((len(tags), right.num_rows), -np.inf), np.full((len(tags), right.num_rows), np.inf)
    lows[ptag, prow], highs[ptag, prow] = np.where(no_low, -np.inf, low)[known], np.where(no_high, np.inf, high)[known]
    has_o, has_p, reading, given = (np.zeros((t.num_rows, len(tags))) for t in (left, right, left, left))
    has_o[orow, otag], has_p[prow, ptag], reading[orow, otag], given[orow, otag] = 1, 1, np.where(none, 0.0, v), ~none
    s, k = np.zeros((left.num_rows, right.num_rows)), has_o @ has_p.T
    step = max(1, 65_536 // max(1, right.num_rows))  # of rows whose numbers stay in the processor's cache
    for at in range(0, left.num_rows, step):
        part = s[at : at + step]
        for t in range(len(tags)):
            x = reading[at : at + step, t][:, None]
            z = lows[t] - x
            np.maximum(z, x - highs[t], out=z)
            np.maximum(z, 0.0, out=z)
            z[given[at : at + step, t] == 0] = 0.0
            z /= sd
            z *= z
            part += z
    n_o, n_p = (t.column("n").to_numpy().astype(float) for t in (left, right))
    return -0.5 * s - miss * (n_p - k) - unexpected * (n_o[:, None] - k), k


def posteriors(observed: DataFrame, ranges: DataFrame, oid: str, pid: str, tag: str, miss: float, unexpected: float, sd: float = 6.0, block: int = 1024) -> DataFrame:
    """oid, pid, ll, p of all pairs with a tag in common: log likelihood as in log_likelihood, and its softmax over an observation's points.

    observed: one row an oid and tag, rssi; ranges: one row a pid and tag, low, high. Every pair is a row, so work is their product; a task holds
    one block of each side at a time. A first pass sums up each observation's softmax by blocks, a second one gives the
    rows: pairs are never shuffled, sorted or written in between."""
    import math

    o = observed.groupBy(oid).agg(*lists(tag, "rssi", "v"), F.count("*").alias("n"))
    r = ranges.groupBy(pid).agg(*lists(tag, "low", "low"), *lists(tag, "high", "high")[1:], F.count("*").alias("n"))
    n_o, n_r = o.agg(F.countDistinct(oid)).first()[0], r.agg(F.countDistinct(pid)).first()[0]
    bo, br = max(1, math.ceil(n_o / block)), max(1, math.ceil(n_r / block))
    deal = lambda df, key, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    keys = ["_ob", "_pb"]
    r = deal(r.where(F.col(pid).isNotNull()), pid, "_pb", br, "_ob", bo).groupBy(*keys)
    o = o.where(F.col(oid).isNotNull())
    kind_o, kind_p = (dict(d.dtypes)[c] for d, c in ((observed, oid), (ranges, pid)))

    def sums(left, right):
        import numpy as np
        import pyarrow as pa

        ll, k = likelihoods(left, right, miss, unexpected, sd)
        if not ll.size:
            return pa.table([left.column(oid).slice(0, 0), pa.array([], pa.float64()), pa.array([], pa.float64())], names=[oid, "_m", "_e"])
        with np.errstate(invalid="ignore"):
            ll = np.where(k > 0, ll, -np.inf)
            top = ll.max(axis=1)
            e = np.where(k > 0, np.exp(ll - top[:, None]), 0.0).sum(axis=1)
        some = np.flatnonzero((k > 0).any(axis=1))
        return pa.table([left.column(oid).take(pa.array(some)), pa.array(top[some]), pa.array(e[some])], names=[oid, "_m", "_e"])

    def rows(left, right):
        import numpy as np
        import pyarrow as pa

        ll, k = likelihoods(left, right, miss, unexpected, sd)
        i, j = (a.astype(np.int32) for a in np.nonzero(k > 0))
        top, e = (left.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_m", "_e"))
        p = np.exp(ll[i, j] - top[i]) / e[i]
        return pa.table([left.column(oid).take(pa.array(i)), right.column(pid).take(pa.array(j)), pa.array(ll[i, j]), pa.array(p)], names=[oid, pid, "ll", "p"])

    from lodepath.operators.graphs import checkpointed

    part = checkpointed(deal(o, oid, "_ob", bo, "_pb", br).groupBy(*keys).cogroup(r).applyInArrow(sums, f"`{oid}` {kind_o}, _m double, _e double"))
    top = part.groupBy(oid).agg(F.max("_m").alias("_top"))
    total = part.join(top, oid).groupBy(oid).agg(F.first("_top").alias("_m"), F.sum(F.col("_e") * F.exp(F.col("_m") - F.col("_top"))).alias("_e"))
    known = o.join(checkpointed(total), oid)
    return deal(known, oid, "_ob", bo, "_pb", br).groupBy(*keys).cogroup(r).applyInArrow(rows, f"`{oid}` {kind_o}, `{pid}` {kind_p}, ll double, p double")


def lists(tag: str, value: str, name: str) -> list[Column]:
    """Lists of a key's known tags (`t`) and of a value of theirs, in one order."""
    both = F.sort_array(F.collect_list(F.when(F.col(tag).isNotNull(), F.struct(F.col(tag).alias("t"), F.col(value).cast("double").alias("v")))))
    return [F.transform(both, lambda e: e["t"]).alias("t"), F.transform(both, lambda e: e["v"]).alias(name)]


def offset_search(pairs: DataFrame, by: list[str], ref: str, tgt: str, low: int, high: int, bin_db: float = 5.0) -> DataFrame:
    """by, offset, agree: the offset whose correction puts most target readings into the reference's bin; the first of equal ones."""
    tried = pairs.withColumn("offset", F.explode(F.sequence(F.lit(low), F.lit(high))))
    same = (F.floor(F.col(ref) / bin_db) == F.floor((F.col(tgt) + F.col("offset")) / bin_db)).cast("int")
    rate = tried.groupBy(*by, "offset").agg(F.avg(same).alias("agree"))
    return rate.groupBy(*by).agg(F.max_by("offset", F.struct("agree", -F.col("offset"))).alias("offset"), F.max("agree").alias("agree"))


def linear_fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n, slope, intercept, r: least squares; slope 1 where x doesn't vary."""
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("sxx"), F.covar_pop(x, y).alias("sxy"), F.var_pop(y).alias("syy"))
    slope = F.when(F.col("sxx") > 0, F.try_divide("sxy", "sxx")).otherwise(F.lit(1.0))
    r = F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))
    return sums.withColumn("slope", slope).withColumn("r", r).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx")).select(*by, "n", "slope", "intercept", "r")


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def strongest(readings: DataFrame, by: list[str], value: str, tie: str, k: int, floor: float) -> DataFrame:
    """The k strongest readings of a key that aren't below the floor."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), tie))
    return readings.where(F.col(value) >= floor).withColumn("rank", rank).where(F.col("rank") <= k)


def precedence(table: DataFrame, learned: DataFrame, key: str, least: int = 5, far: float = 1000.0) -> DataFrame:
    """Full outer join of tag positions: the table's, unless a learned one of enough samples is far from it."""
    a = table.select(key, F.col("x").alias("tx"), F.col("y").alias("ty"))
    b = learned.select(key, F.col("x").alias("lx"), F.col("y").alias("ly"), "n")
    both = a.join(b, key, "full")
    use = F.col("tx").isNull() | ((F.col("n") >= least) & (F.hypot(F.col("tx") - F.col("lx"), F.col("ty") - F.col("ly")) > far))
    use = F.coalesce(use, F.lit(False))
    return both.select(key, F.when(use, F.col("lx")).otherwise(F.col("tx")).alias("x"), F.when(use, F.col("ly")).otherwise(F.col("ty")).alias("y"), F.when(use, "learned").otherwise("table").alias("source"))


def at_shelves(readings: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """Readings with what is known of their tag (a shelf, or a place); those of tags that aren't known go. A tag known twice counts by its first row."""
    others = [c for c in tags.columns if c != tag]
    return readings.join(tags.groupBy(tag).agg(F.min(F.struct(*others)).alias("_at")), tag).select("*", "_at.*").drop("_at")


def paired_medians(ref: DataFrame, tgt: DataFrame, keys: list[str], value: str, least: int) -> DataFrame:
    """keys, ref, tgt, n_ref, n_tgt: medians of two devices' readings where both have at least so many."""
    med = lambda df, n: df.groupBy(*keys).agg(F.median(value).alias(n), F.count(value).alias(f"n_{n}")).where(F.col(f"n_{n}") >= least)
    return med(ref, "ref").join(med(tgt, "tgt"), keys)
