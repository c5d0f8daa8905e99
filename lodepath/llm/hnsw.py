"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard (Malkov & Yashunin 2018).

A shard has about SHARD rows, dealt by a hash of the id. Its graph is stored as flat neighbour arrays in one row of
a table in the shared folder, and may be used by any number of later searches. Search is by blocks of queries: one
task takes one (shard, block), and a window merges the shards' results. Largest inner product is turned into
nearest neighbour by one more component that gives all of a shard's vectors the same norm. Equal vectors of a shard
are one node, whose rows are given by ascending id. Nodes are inserted in batches, each batch searched at once.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodepath.llm.common import cut, ship, table

SHARD, QUERIES = 4096, 1024
M, M0, BUILD, SEARCH, WIDE, BATCH = 16, 32, 64, 96, 4, 256


class Graph:
    """x: nodes' vectors; adj[l]: neighbours of each node in layer l (-1: none); top: entry node."""

    def __init__(self, x: np.ndarray, seed: int = 5):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(M)).astype(int), 4)
        self.adj = [np.full((n, M if k else M0), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        self.level = level
        order = np.argsort(-level, kind="stable")  # upper layers' nodes first, so that layers are complete early
        self.top, at = int(order[0]) if n else -1, 1
        while at < n:
            size = int(min(BATCH, at, n - at))
            self._insert(order[at : at + size])
            at += size

    def _insert(self, nodes: np.ndarray) -> None:
        q = self.x[nodes]
        entry = np.full(len(nodes), self.top)
        for k in range(len(self.adj) - 1, -1, -1):
            here = np.flatnonzero(self.level[nodes] >= k)
            if not len(here):
                entry = self._descend(q, entry, k)
                continue
            ids, _ = self._beam(q, entry, k, BUILD)
            entry = ids[:, 0]
            self._link(nodes[here], ids[here], k)

    def _descend(self, q: np.ndarray, entry: np.ndarray, k: int) -> np.ndarray:
        best = np.einsum("ij,ij->i", self.x[entry], q)
        while True:
            near = self.adj[k][entry]
            s = np.einsum("imj,ij->im", self.x[near], q)
            s[near < 0] = -np.inf
            at = s.argmax(1)
            value = s[np.arange(len(q)), at]
            better = value > best
            if not better.any():
                return entry
            entry = np.where(better, near[np.arange(len(q)), at], entry)
            best = np.where(better, value, best)

    def _beam(self, q: np.ndarray, entry: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query the ef best nodes met (best first, -1 where fewer) and their inner products; WIDE nodes a step."""
        n, rows = len(q), np.arange(len(q))[:, None]
        ids = np.full((n, ef), -1)
        sim = np.full((n, ef), -np.inf, np.float32)
        done = np.ones((n, ef), bool)
        seen = np.zeros((n, len(self.x) + 1), bool)  # the last column takes -1
        seen[:, -1] = True
        ids[:, 0], sim[:, 0], done[:, 0] = entry, np.einsum("ij,ij->i", self.x[entry], q), False
        seen[rows[:, 0], entry] = True
        live = np.arange(n)
        while len(live):
            waiting = np.where(done[live], -np.inf, sim[live])
            pick = np.argpartition(-waiting, WIDE - 1, axis=1)[:, :WIDE]
            real = np.take_along_axis(waiting, pick, 1) > -np.inf
            go = real.any(1)
            live, pick, real = live[go], pick[go], real[go]
            if not len(live):
                break
            r = live[:, None]
            done[r, pick] = True
            near = self.adj[k][ids[r, pick]]
            near[~real] = -1
            near = near.reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[r, near]] = -1
            seen[r, near] = True
            s = np.einsum("imj,ij->im", self.x[near], q[live])
            s[near < 0] = -np.inf
            all_s = np.concatenate([sim[live], s], 1)
            best = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            sim[live] = np.take_along_axis(all_s, best, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), best, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], near < 0], 1), best, 1)
        order = np.argsort(-sim, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)

    def _spread(self, node: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
        """The neighbour heuristic for many nodes: a candidate stays if it is nearer to the node than to any that stays before it."""
        x = self.x[cand]
        s = np.einsum("imj,ij->im", x, self.x[node])
        s[(cand < 0) | (cand == node[:, None])] = -np.inf
        order = np.argsort(-s, axis=1, kind="stable")
        cand, s = np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1)
        x = np.take_along_axis(x, order[:, :, None], 1)
        between = x @ x.transpose(0, 2, 1)
        kept = np.zeros(cand.shape, bool)
        for j in range(cand.shape[1]):
            clash = (kept[:, :j] & (between[:, j, :j] > s[:, j : j + 1])).any(1)
            kept[:, j] = (s[:, j] > -np.inf) & ~clash & (kept[:, :j].sum(1) < most)
        spare = (s > -np.inf) & ~kept  # fill up with the nearest that were passed over
        rank = np.where(kept, 0, np.where(spare, 1, 2)) * cand.shape[1] + np.arange(cand.shape[1])
        order = np.argsort(rank, axis=1)[:, :most]
        out = np.where(np.take_along_axis(kept | spare, order, 1), np.take_along_axis(cand, order, 1), -1)
        if out.shape[1] < most:
            out = np.concatenate([out, np.full((len(out), most - out.shape[1]), -1)], 1)
        return out

    def _link(self, nodes: np.ndarray, found: np.ndarray, k: int) -> None:
        adj = self.adj[k]
        peers = self.x[nodes] @ self.x[nodes].T
        np.fill_diagonal(peers, -np.inf)
        near = np.argsort(-peers, axis=1)[:, : min(M, len(nodes) - 1)]
        mine = self._spread(nodes, np.concatenate([found, nodes[near]], 1), min(M, adj.shape[1]))
        adj[nodes, : mine.shape[1]] = mine
        src, dst = np.repeat(nodes, mine.shape[1]), mine.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        s = np.einsum("ij,ij->i", self.x[src], self.x[dst])
        order = np.lexsort((-s, dst))
        src, dst = src[order], dst[order]
        first = np.r_[True, dst[1:] != dst[:-1]]
        at = np.arange(len(dst)) - np.maximum.accumulate(np.where(first, np.arange(len(dst)), 0))
        near_enough = at < M0
        to, row = np.unique(dst[near_enough], return_inverse=True)
        back = np.full((len(to), M0), -1)
        back[row, at[near_enough]] = src[near_enough]
        both = np.concatenate([adj[to], back], 1)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        used = max(1, int((both >= 0).sum(1).max()))
        both = -np.sort(-both, axis=1)[:, :used]
        for lo in range(0, len(to), 512):
            adj[to[lo : lo + 512]] = self._spread(to[lo : lo + 512], both[lo : lo + 512], adj.shape[1])

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        entry = np.full(len(q), self.top)
        for k in range(len(self.adj) - 1, 0, -1):
            entry = self._descend(q, entry, k)
        return self._beam(q, entry, 0, ef)[0]


def build(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    """A shard's index: graph over distinct vectors, original vectors in double, and each node's ids in order."""
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    one = np.r_[True, ids[1:] != ids[:-1]]
    ids, vectors = ids[one], vectors[one]
    distinct, node = np.unique(vectors, axis=0, return_inverse=True)
    norm = np.sqrt((distinct**2).sum(1))
    high = norm.max()
    aug = np.concatenate([distinct / high, np.sqrt(np.maximum(1 - (norm / high) ** 2, 0))[:, None]], 1)
    g = Graph(aug)
    by = np.lexsort((ids, node))
    out = io.BytesIO()
    np.savez(out, x=g.x, distinct=distinct, top=g.top, ids=ids[by], ptr=np.searchsorted(node[by], np.arange(len(distinct) + 1)), **{f"adj{k}": a for k, a in enumerate(g.adj)})
    return out.getvalue()


def lookup(blob: bytes, qid: np.ndarray, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of at most k neighbours each in this shard; scores in double on original vectors."""
    z = np.load(io.BytesIO(blob))
    g = Graph.__new__(Graph)
    g.x, g.top, g.adj = z["x"], int(z["top"]), [z[f"adj{i}"] for i in range(sum(n.startswith("adj") for n in z.files))]
    distinct, ids, ptr = z["distinct"], z["ids"], z["ptr"]
    out = []
    for lo in range(0, len(q), BATCH):
        part = q[lo : lo + BATCH]
        aug = np.concatenate([part / np.maximum(np.sqrt((part**2).sum(1, keepdims=True)), 1e-300), np.zeros((len(part), 1))], 1).astype(np.float32)
        for i, nodes in enumerate(g.search(aug, ef)):
            nodes = nodes[nodes >= 0]
            s = (distinct[nodes] * part[i]).sum(1)
            order = np.argsort(-s, kind="stable")[: k + 1]
            nodes, s = nodes[order], s[order]
            rows = np.concatenate([ids[ptr[x] : min(ptr[x] + k + 1, ptr[x + 1])] for x in nodes])
            score = np.repeat(s, np.minimum(ptr[nodes + 1] - ptr[nodes], k + 1))
            other = rows != qid[lo + i]
            rows, score = rows[other], score[other]
            best = np.lexsort((rows, -score))[:k]
            out.append((np.full(len(best), qid[lo + i]), rows[best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: an id, and a finite non-zero vector of the most common length."""
    good = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    rows = vectors.where(good).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (common.d if common else 0))


def build_index(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """A table (shard, blob) of graphs over rows (vec_id, v), written to the shared folder."""
    shards = max(1, -(-rows.count() // shard))

    def run(t: pa.Table) -> pa.Table:
        v = t["v"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        return pa.table({"shard": pa.array([t["shard"][0].as_py()], pa.int32()), "blob": pa.array([build(t["vec_id"].to_numpy(), v)], pa.binary())})

    dealt = rows.withColumn("shard", F.expr(f"cast(pmod(xxhash64(vec_id), {shards}) as int)"))
    return cut(dealt.groupBy("shard").applyInArrow(run, "shard int, blob binary"))


def search_index(index: DataFrame, queries: DataFrame, k: int = 20, ef: int = SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries (vec_id, v) in an index; a query's own id is no neighbour."""
    shards = index.agg(F.max("shard")).first()[0]
    blocks = max(1, -(-queries.count() // QUERIES))
    last = -1 if shards is None else shards

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        qid = left["vec_id"].to_numpy()
        v = left["v"].combine_chunks().flatten().to_numpy().reshape(len(left), -1)
        order = np.lexsort((*v.T[::-1], qid))
        qid, v = qid[order], v[order]
        one = np.r_[True, qid[1:] != qid[:-1]]
        q, n, s = lookup(right["blob"][0].as_py(), qid[one], v[one], k, ef)
        return pa.table({"query_id": q, "vec_id": n, "score": s})

    q = queries.withColumn("qb", F.expr(f"cast(pmod(xxhash64(vec_id, 1), {blocks}) as int)"))
    q = q.withColumn("shard", F.explode(F.expr("sequence(0, %d)" % last if last >= 0 else "cast(array() as array<int>)")))
    g = index.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = q.select("qb", "shard", "vec_id", "v").groupBy("qb", "shard").cogroup(g.select("qb", "shard", "blob").groupBy("qb", "shard")).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, ef: int = SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows of vectors (vec_id, embedding, any others) whose vec_id is divisible by `every`.

    Vectors null, zero or holding null or non-finite components, of another length than most, or without id take no
    part. Rows of one id count once (the smallest vector). Ties go to the smaller id; fewer than k candidates give
    all that are found. An empty table gives an empty table.
    """
    ship(vectors.sparkSession)
    rows = usable(vectors)
    return search_index(build_index(rows), rows.where(F.col("vec_id") % every == 0), k, ef)


def exact_check(vectors: pd.DataFrame, every: int, k: int) -> dict[int, list[int]]:
    """Brute force for tests: each query's k best ids."""
    ids, x = vectors["vec_id"].to_numpy(), np.array(vectors["embedding"].tolist(), float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(1)
        best = np.lexsort((ids, -s))
        out[int(ids[i])] = [int(ids[j]) for j in best if ids[j] != ids[i]][:k]
    return out


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest of all vectors for those whose vec_id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"))
