"""Mixing sources to target weights: temperature, and budgeted block permutations, in DataFrame functions only.

A source's weight is its token share to the power a, normalised. a is bisected (in steps of 16 at once) so that the
weights' entropy meets a target, unless a source would then repeat beyond a limit: then so that it just doesn't.
Weights times the token budget give each source whole epochs and a rest. A source's documents lie in 4096 blocks by
a hash of their id; an epoch is a keyed permutation of blocks, and of documents within a block. The rest is the
start of one more permutation, cut where the tokens of the next document would exceed it. That cut is a pair of
keys for each source, found from block sums and one block's documents, so no window ever holds a source, and the
documents themselves are never shuffled: they meet a table of one row a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodepath.llm.common import cut, table, unused

SMALL = 10_000  # so many sources are broadcast; more are joined by a shuffle


def tokens_of(text: Column) -> Column:
    """Words and one end."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + F.lit(1).cast("bigint")


def block_of(doc_id: Column) -> Column:
    return F.substring(F.md5(F.concat(F.lit("block|"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 3)


def block_key(seed: int, epoch: Column, source: Column, block: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(source, F.lit("")), block))


def doc_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def section(shares: DataFrame, value, target: float, rounds: int = 12, parts: int = 16) -> float:
    """The a in [0, 1] up to which value(a) >= target, for a value that falls as a grows; 1 if it never falls below."""
    lo, hi = 0.0, 1.0
    if shares.agg(value(1.0).alias("v")).first()[0] >= target:
        return 1.0
    for _ in range(rounds):
        points = [lo + (hi - lo) * k / (parts + 1) for k in range(1, parts + 1)]
        got = shares.agg(*[value(a).alias(f"v{k}") for k, a in enumerate(points)]).first()
        above = sum(v >= target for v in got)
        grid = [lo, *points, hi]
        lo, hi = grid[above], grid[above + 1]
    return lo


def exponent(shares: DataFrame, target_entropy: float, repeat_limit: float) -> float:
    """a for the table shares (p): the entropy's a, or, where a source would repeat too often, the least that keeps the limit."""
    p = F.col("p")
    z = lambda a: F.sum(F.pow(p, F.lit(a)))
    entropy = lambda a: F.log(z(a)) - F.sum(F.pow(p, F.lit(a)) * a * F.log(p)) / z(a)
    a = section(shares, entropy, target_entropy)
    repeats = lambda b: F.max(F.pow(p, F.lit(b - 1.0))) / z(b)
    if shares.agg(repeats(a).alias("r")).first()[0] <= repeat_limit:
        return round(a, 9)
    least = section(shares, lambda b: repeats(b), repeat_limit)  # repeats fall as b grows
    return round(min(1.0, least + 1e-9), 9)


def near(df: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """df joined with a table of n sources, null a source of its own."""
    side = sources.withColumnRenamed("source", "_source")
    return df.join(F.broadcast(side) if n <= SMALL else side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def plan(docs: DataFrame, entropy_share: float = 0.95, repeat_limit: float = 3.0, cover: bool = False, seed: int = 17) -> tuple[DataFrame, int]:
    """One row a source (source, weight, epochs, cut_block, cut_doc) and the number of sources.

    entropy_share: target entropy as a share of that of equal weights. repeat_limit: most epochs of any source (with
    cover, relative to the least repeated). The budget is all tokens; with cover it is the least that takes every
    document at least once. Empty input gives an empty plan."""
    source, doc_id = F.col("source").cast("string").alias("source"), F.col("doc_id")
    rows = docs.select(source, doc_id, block_of(doc_id).alias("block"), F.col("text").cast("string").alias("text"))
    blocks = cut(rows.groupBy("source", "block").agg(F.sum(tokens_of(F.col("text"))).alias("tokens")))
    by_source = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    total, n = by_source.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    shares = by_source.withColumn("p", F.col("tokens") / F.lit(max(1, int(total))))
    if not n:
        empty = shares.select("source", F.lit(0.0).alias("weight"), F.lit(0).cast("bigint").alias("epochs"), F.lit("").alias("cut_block"), F.lit("").alias("cut_doc"))
        return empty, 0
    if cover:  # repeats relative to the least: (p_min / p_max) ** (a - 1)
        low, high = shares.agg(F.min("p"), F.max("p")).first()
        p = F.col("p")
        z = lambda a: F.sum(F.pow(p, F.lit(a)))
        a = section(shares, lambda b: F.log(z(b)) - F.sum(F.pow(p, F.lit(b)) * b * F.log(p)) / z(b), entropy_share * math.log(n))
        if low < high:
            a = max(a, 1.0 - math.log(repeat_limit) / math.log(high / low))
        a = round(min(1.0, a), 9)
    else:
        a = exponent(shares, entropy_share * math.log(n), repeat_limit)
    z, most = shares.agg(F.sum(F.pow("p", F.lit(a))), F.max(F.pow(F.col("p"), F.lit(1.0 - a)))).first()
    budget = int(total) * (z * most if cover else 1.0)
    weighted = shares.withColumn("weight", F.round(F.pow("p", F.lit(a)) / F.lit(z), 9))
    goal = F.floor(F.col("weight") * budget + (F.lit(0.5) if cover else F.lit(0.0))).cast("bigint")
    if cover:
        goal = F.greatest(goal, F.col("tokens"))
    weighted = weighted.withColumn("goal", goal).withColumn("epochs", F.floor(F.col("goal") / F.col("tokens"))).withColumn("rest", F.col("goal") - F.col("epochs") * F.col("tokens"))
    weighted = cut(weighted.select("source", "weight", "epochs", "rest"))
    keyed = near(blocks, weighted, n).withColumn("key", block_key(seed, F.col("epochs"), F.col("source"), F.col("block")))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = keyed.withColumn("before", before).where("before <= rest and before + tokens > rest")  # one block a source
    edge = cut(edge.select("source", F.col("block").alias("edge"), F.col("key").alias("cut_block"), (F.col("rest") - F.col("before")).alias("left"), "epochs"))
    inside = near(rows, edge, n).where("block = edge").withColumn("key", doc_key(seed, F.col("epochs"), F.col("doc_id")))
    run = F.sum(tokens_of(F.col("text"))).over(Window.partitionBy("source").orderBy("key"))
    last = inside.withColumn("run", run).where("run <= left").groupBy("source").agg(F.max("key").alias("cut_doc"))
    cuts = near(weighted.select("source", "weight"), edge, n)
    with_doc = cuts.join(last.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left")
    return cut(with_doc.select("source", "weight", "epochs", "cut_block", F.coalesce("cut_doc", F.lit("")).alias("cut_doc"))), n


def mix(docs: DataFrame, seed: int = 17, names: tuple[str, str, str] = ("_weight", "_epoch", "_block_key"), **how) -> DataFrame:
    """docs with a row for each time a document is taken, and three columns, by default _weight, _epoch (from 0), _block_key.

    Within a source, _epoch, _block_key and a document's own key give the order of reading. Null sources are one
    source; null and empty texts count one token; documents of the same id stay together. The columns of docs keep
    their names; docs with a column of one of `names` is an error.
    """
    if taken := {c.lower() for c in docs.columns} & {n.lower() for n in names}:
        raise ValueError(f"docs has columns of the names of mix()'s own: {sorted(taken)}")
    sources, n = plan(docs, seed=seed, **how)
    weight, epoch, block = names
    own, epochs, cb, cd, times = unused(docs, "_source", "_epochs", "_cb", "_cd", "_n")
    side = sources.select(F.col("source").alias(own), F.col("weight").alias(weight), F.col("epochs").alias(epochs), F.col("cut_block").alias(cb), F.col("cut_doc").alias(cd))
    source = F.col("source").cast("string")
    both = docs.join(F.broadcast(side) if n <= SMALL else side, source.eqNullSafe(F.col(own)))
    key = block_key(seed, F.col(epochs), source, block_of(F.col("doc_id")))
    more = (key < F.col(cb)) | ((key == F.col(cb)) & (doc_key(seed, F.col(epochs), F.col("doc_id")) <= F.col(cd)))
    taken = both.withColumn(times, F.col(epochs) + more.cast("int")).where(F.col(times) > 0).withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(times) - 1)))
    return taken.withColumn(block, F.substring(block_key(seed, F.col(epoch), source, block_of(F.col("doc_id"))), 1, 16)).drop(own, epochs, cb, cd, times)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, weight, epoch, block_key) of all documents mixed to 95 % of the highest entropy, at most 3 epochs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", F.col("_weight").alias("weight"), F.col("_epoch").alias("epoch"), F.col("_block_key").alias("block_key"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, substr(md5('block|' || CAST(doc_id AS VARCHAR)), 1, 3) AS block,
    1 + len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS tokens FROM documents
), src AS (SELECT source, sum(tokens) AS n, sum(tokens) / (SELECT sum(tokens) FROM d) AS p FROM d GROUP BY source
), ps AS (SELECT list(CAST(p AS DOUBLE)) AS ps, 0.95 * ln(count(*)) AS goal FROM src
), ent(k, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT k + 1, CASE WHEN h >= goal THEN m ELSE lo END, CASE WHEN h >= goal THEN hi ELSE m END FROM (
    SELECT k, lo, hi, (lo + hi) / 2 AS m, goal,
      ln(list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2)))) - list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2) * (lo + hi) / 2 * ln(p))) / list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2))) AS h
    FROM ent, ps WHERE k < 52)
), rep(k, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT k + 1, CASE WHEN r >= 3 THEN m ELSE lo END, CASE WHEN r >= 3 THEN hi ELSE m END FROM (
    SELECT k, lo, hi, (lo + hi) / 2 AS m, list_max(list_transform(ps, lambda p: pow(p, (lo + hi) / 2 - 1))) / list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2))) AS r
    FROM rep, ps WHERE k < 52)
), a AS (
  SELECT CASE WHEN list_max(list_transform(ps, lambda p: pow(p, e - 1))) / list_sum(list_transform(ps, lambda p: pow(p, e))) <= 3 THEN round(e, 9) ELSE round(least(1, r + 1e-9), 9) END AS a
  FROM ps, (SELECT lo AS e FROM ent WHERE k = 52), (SELECT lo AS r FROM rep WHERE k = 52)
), w AS (SELECT source, n, round(pow(p, a) / (SELECT sum(pow(p, a)) FROM src), 9) AS weight FROM src, a
), g AS (SELECT source, n, weight, CAST(floor(weight * (SELECT sum(tokens) FROM d)) AS BIGINT) AS goal FROM w
), e AS (SELECT source, weight, CAST(floor(goal / n) AS BIGINT) AS epochs, CAST(goal - floor(goal / n) * n AS BIGINT) AS rest FROM g
), k AS (
  SELECT d.doc_id, d.source, d.block, d.tokens, e.weight, e.epochs, e.rest, md5('17|' || e.epochs || '|' || d.source || '|' || d.block) AS bk, md5('17|' || e.epochs || '|' || d.doc_id) AS dk
  FROM d JOIN e USING (source)
), r AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY bk, dk) AS run FROM k
), t AS (SELECT doc_id, source, weight, block, unnest(range(0, epochs + CASE WHEN run <= rest THEN 1 ELSE 0 END)) AS epoch FROM r)
SELECT doc_id, source, weight, epoch, substr(md5('17|' || epoch || '|' || source || '|' || block), 1, 16) AS block_key FROM t
"""
