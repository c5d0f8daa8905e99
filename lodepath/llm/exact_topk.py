"""Exact top-k by exhaustive term-at-a-time accumulation over sparse rows.

Candidates are dealt by a hash of their id to blocks of about BLOCK rows, queries to blocks of about QUERIES; one
task holds one pair of blocks, builds the candidates' inverted index, scatters each query term's weighted postings
into dense score arrays, and keeps k by partition selection. A window over the blocks' winners merges them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodepath.llm.common import ship, table

BLOCK, QUERIES, TOGETHER = 2048, 1024, 128


def ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each value, values) of a list column."""
    col = column.combine_chunks()
    return np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy())), col.flatten().to_numpy()


def distinct_ids(t: pa.Table) -> pa.Table:
    """One row an id, in order of ids; of rows with the same id the first in order of terms and weights."""
    t = t.append_column("order", pa.array([str(x) for x in zip(t["terms"].to_pylist(), t["weights"].to_pylist(), strict=True)] if len(t) and len(np.unique(t["id"].to_numpy())) < len(t) else [""] * len(t), pa.string()))
    t = t.sort_by([("id", "ascending"), ("order", "ascending")])
    ids = t["id"].to_numpy()
    return t.filter(pa.array(np.r_[True, ids[1:] != ids[:-1]][: len(ids)]))


def accumulate(queries: pa.Table, cands: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of each query's k best of these candidates; ties go to the smaller id."""
    queries, cands = distinct_ids(queries), distinct_ids(cands)
    cid, qid = cands["id"].to_numpy(), queries["id"].to_numpy()
    n = len(cid)
    row, term = ragged(cands["terms"])
    weight = ragged(cands["weights"])[1]
    order = np.argsort(term, kind="stable")
    posts, post_w, terms = row[order], weight[order], term[order]
    names = np.unique(terms)
    ptr = np.searchsorted(terms, np.r_[names, names[-1:] + 1]) if len(names) else np.zeros(1, np.int64)
    qrow, qterm = ragged(queries["terms"])
    qw = ragged(queries["weights"])[1]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(qid), TOGETHER):
        hi = min(lo + TOGETHER, len(qid))
        score = np.zeros((hi - lo, n), np.int64)
        a, b = np.searchsorted(qrow, [lo, hi])
        by = np.argsort(qterm[a:b], kind="stable") + a
        cuts = np.flatnonzero(np.r_[True, qterm[by][1:] != qterm[by][:-1]]) if b > a else []
        for first, last in zip(cuts, [*cuts[1:], len(by)], strict=True):
            some = by[first:last]
            at = np.searchsorted(names, qterm[some[0]])
            if at == len(names) or names[at] != qterm[some[0]]:
                continue
            docs, w = posts[ptr[at] : ptr[at + 1]], post_w[ptr[at] : ptr[at + 1]]
            add = np.multiply.outer(qw[some], w)
            if len(docs) == n:  # every candidate has the term: the scatter is a plain addition
                score[qrow[some] - lo] += add
            else:
                score[np.ix_(qrow[some] - lo, docs)] += add
        for i in range(hi - lo):
            s = score[i]
            own = np.searchsorted(cid, qid[lo + i])
            others = np.ones(n, bool)
            if own < n and cid[own] == qid[lo + i]:
                others[own] = False
            s, c = s[others], cid[others]
            if not len(s):
                continue
            least = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else s.min()
            best = np.flatnonzero(s >= least)
            best = best[np.lexsort((c[best], -s[best]))][:k]
            out.append((np.full(len(best), qid[lo + i]), c[best], s[best]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates of another id by integer inner product.

    Both sides are (id bigint, terms array<int>, weights array<bigint>), one term at most once a row; missing terms
    weigh 0, so a row without terms has score 0 with all. A null id takes no part; rows of one id count once (the
    smallest). A query with fewer than k candidates gets all. Ties go to the smaller id. Empty tables give none.
    """
    ship(queries.sparkSession)
    queries, candidates = queries.where("id is not null"), candidates.where("id is not null")
    nb, qb = max(1, -(-candidates.count() // BLOCK)), max(1, -(-queries.count() // QUERIES))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c, s = accumulate(left, right, k) if len(left) and len(right) else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": q, "vec_id": c, "score": s})

    q = queries.withColumn("qb", F.expr(f"cast(pmod(xxhash64(id, 1), {qb}) as int)")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    c = candidates.withColumn("cb", F.expr(f"cast(pmod(xxhash64(id), {nb}) as int)")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    cols = ["qb", "cb", "id", "terms", "weights"]
    found = q.select(cols).groupBy("qb", "cb").cogroup(c.select(cols).groupBy("qb", "cb")).applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sparse(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(id, terms, weights) of vectors (vec_id, embedding): floor(scale * x) of each component, zeros left out.

    Vectors null or holding null or non-finite components take no part."""
    good = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    w = vectors.where(good).select(F.col("vec_id").cast("bigint").alias("id"), F.expr(f"transform(embedding, x -> cast(floor({scale} * cast(x as double)) as bigint))").alias("w"))
    return w.select("id", F.expr("filter(transform(w, (x, i) -> if(x <> 0, i, -1)), i -> i >= 0)").alias("terms"), F.expr("filter(w, x -> x <> 0)").alias("weights"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best of all vectors for those whose vec_id is divisible by 50."""
    rows = sparse(table(spark, sf_dir, "embeddings"))
    return exact_topk(rows.where("id % 50 = 0"), rows, 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
