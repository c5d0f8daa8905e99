"""Embedding near-duplicates: an exact metric range join.

Vectors are compared within their label. On the unit sphere a cosine of at least c is a distance of at most
r = sqrt(2 - 2c), so links are a range join in a metric space:

1. Equal vectors of a label are one *class* with a count: a group of exact copies sends one row a task.
2. Pivots, drawn from a bounded sample of classes, partition a label's vectors: a vector's home is the cell of its nearest
   pivot. The distances from each cell's members to its pivot are kept as a range.
3. Boundary replication: a vector x visits a cell if a member y with d(x, y) <= r can be in it. By the triangle
   inequality that takes d(x, p) within r of the cell's range, and, as y is no farther from its own pivot than from the pivot
   of x, d(x, p)^2 - d(x, home)^2 <= 2 r d(p, home). Cells are ordered and vectors only visit later ones: each pair meets once.
4. Cells join on their own. A cell of more than BLOCK members is dealt to blocks, each pair of blocks being one task,
   so no task holds more than 2 x BLOCK rows, however many vectors crowd around a pivot or have one label.
5. A task computes cosines as matrix products in double precision, and returns each class's number of links and, for
   its links' connected parts, one edge a class: never its pairs.
6. Sums by class, and components over the edges.

Work follows what the data are: clustered vectors visit few cells, vectors spread evenly over many dimensions visit many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodepath.llm.common import cut, drop, ship, table
from lodepath.llm.components import component_table

#: Members of a cell before there are more pivots; rows of a side of a task; most pivots, sent to every task.
CELL, BLOCK, PIVOTS = 4096, 4096, 4096
SLACK = 1e-6
GOOD = "label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"


def units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of a column of lists of one length, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


class Cells:
    """Pivots by space (vectors of one label and length). A cell is a pivot; spaces without pivots are one cell each."""

    def __init__(self, spaces: dict[int, np.ndarray]):
        self.pivots, self.first, n = spaces, {}, 0
        for k, p in spaces.items():
            self.first[k] = n
            n += len(p)
        self.n = n
        self.homes, self.visitors = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.low, self.high = np.full(n, np.inf), np.full(n, -np.inf)

    def parts_of(self, batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
        """(space, some of its rows) of a batch of (cid, space, ...); so many rows that their distances to all pivots take 8 MB."""
        space = batch.column(1).to_numpy()
        order = np.argsort(space, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(space[order])) + 1):
            if len(rows):
                k = int(space[rows[0]])
                step = max(1, min(4096, (1 << 20) // len(self.pivots.get(k, [0]))))
                for lo in range(0, len(rows), step):
                    yield k, batch.take(pa.array(rows[lo : lo + step]))

    def visits(self, space: int, x: np.ndarray, home: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the later cells that each row has to visit; home is the pivot's number within the space."""
        pivots = self.pivots[space]
        d, between = distances(x, pivots), distances(pivots[home], pivots)
        own = d[np.arange(len(x)), home][:, None]
        here = slice(self.first[space], self.first[space] + d.shape[1])
        ok = (d <= self.high[here] + radius + SLACK) & (d >= self.low[here] - radius - SLACK) & (d * d - own * own <= 2 * (radius + SLACK) * between + SLACK)
        row, cell = np.nonzero(ok & (np.arange(d.shape[1]) > home[:, None]))
        return row, cell + self.first[space]


CLASS = ["cid", "space", "n", "size", "embedding"]


def settle(cells: Cells):
    """Adds each class's home (-1 in a space without pivots) and its distance to that pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for space, some in cells.parts_of(batch):
                home, far = np.full(len(some), -1), np.zeros(len(some))
                if space in cells.pivots:
                    d = distances(units(some.column(4)), cells.pivots[space])
                    home, far = d.argmin(1), d.min(1)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(home.astype(np.int32)), pa.array(far)], names=[*CLASS, "home", "far"])

    return run


def visitors(cells: Cells, radius: float):
    """How many vectors visit each cell, summed within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(cells.n, np.int64)
        for batch in batches:
            for space, some in cells.parts_of(batch):
                if space in cells.pivots:
                    n += np.bincount(cells.visits(space, units(some.column(4)), some.column(5).to_numpy(), radius)[1], minlength=cells.n)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(n[seen])], names=["cell", "n"])

    return run


def spread(rows: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number in rows, part) of every row with each of its parts."""
    every = np.repeat(np.arange(len(rows)), parts)
    return every, np.arange(len(every)) - np.repeat(np.cumsum(parts) - parts, parts)


def dealt(cells: Cells, radius: float, block: int):
    """A row for each task that a class takes part in: (space, cell, left, right, side, cid, n, embedding).

    Blocks of homes meet each other (left <= right); blocks of visitors, numbered -1, -2, ... as `left`, meet all blocks of homes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home_parts, guest_parts = np.maximum(1, -(-cells.homes // block)), -(-cells.visitors // block)
        for batch in batches:
            for space, some in cells.parts_of(batch):
                cid = some.column(0).to_numpy()
                at, none = np.arange(len(some)), np.zeros(0, np.int64)
                if space in cells.pivots:
                    home = some.column(5).to_numpy()
                    cell = home + cells.first[space]
                    parts, guests = home_parts[cell], guest_parts[cell]
                    guest, to = cells.visits(space, units(some.column(4)), home, radius)
                else:
                    cell, parts, guests, guest, to = np.zeros(len(some), np.int64), -(-some.column(3).to_numpy() // block), np.zeros(len(some), np.int64), none, none
                mine = cid % parts
                e, other = spread(at, parts)
                out = [(e, cell[e], np.minimum(mine[e], other), np.maximum(mine[e], other), (mine[e] > other).astype(int))]
                e, other = spread(at, guests)
                out.append((e, cell[e], -1 - other, mine[e], np.ones(len(e), np.int64)))
                if len(guest):
                    e, other = spread(guest, home_parts[to])
                    out.append((guest[e], to[e], -1 - cid[guest[e]] % guest_parts[to[e]], other, np.zeros(len(e), np.int64)))
                row, *keys = (np.concatenate(x) for x in zip(*out, strict=True))
                for lo in range(0, len(row), 1 << 15):
                    part = slice(lo, lo + (1 << 15))
                    got = some.take(pa.array(row[part]))
                    yield pa.RecordBatch.from_arrays([got.column(1), *(pa.array(v[part].astype(np.int32)) for v in keys), *(got.column(k) for k in (0, 2, 4))], names=["space", "cell", "left", "right", "side", "cid", "n", "embedding"])

    return run


def roots(n: int, edges: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least member of the connected part of each of n nodes; edges come in bounded runs."""
    lab = np.arange(n)
    for i, j in edges:
        while True:
            a, b = lab[i], lab[j]
            pair = np.unique((np.minimum(a, b) * n + np.maximum(a, b))[a != b])
            if not len(pair):
                break
            low, high = np.divmod(pair, n)
            parent = np.arange(n)
            np.minimum.at(parent, high, low)
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            lab = parent[lab]
    return lab


def joined(least: float):
    """Number of links of each class of a task, and the class to which its connected part holds on."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("cid", "ascending")])
        cid, n, x = t["cid"].to_numpy(), t["n"].to_numpy(), units(t["embedding"])
        split = int(np.searchsorted(t["side"].to_numpy(), 1))
        same = split == len(cid)  # a block of homes with itself
        rx, rn = (x, n) if same else (x[split:], n[split:])
        links, shift = np.zeros(len(cid), np.int64), 0 if same else split

        def edges() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for lo in range(0, split, 512):
                hit = x[lo : min(lo + 512, split)] @ rx.T >= least
                rows = np.arange(len(hit))
                if same:
                    hit[rows, rows + lo] = False
                i, j = np.nonzero(hit)
                if len(i):
                    links[lo : lo + len(hit)] += hit @ rn
                    if not same:
                        links[shift:] += n[lo : lo + len(hit)] @ hit
                    yield i + lo, j + shift

        root = roots(len(cid), edges()) if split and len(rx) else np.arange(len(cid))
        some = (links > 0) | (root != np.arange(len(cid)))
        return pa.table({"cid": cid[some], "links": links[some], "root": cid[root[some]]})

    return run


def pivots_of(classes: DataFrame, sizes: DataFrame, cell: int, most: int) -> Cells:
    """The cells of the spaces in sizes (space, size): one pivot for each `cell` of their classes, `most` at most in all.

    Where there are more spaces than that, the largest get pivots. A space's pivots are its classes of least hash."""
    large = sizes.orderBy(F.desc("size"), "space").limit(most).collect()
    share = min(1.0, most / max(1, sum(-(-r.size // cell) for r in large)))
    wanted = {r.space: (int(-(-r.size // cell) * share), r.size) for r in large}
    wanted = {k: v for k, v in wanted.items() if v[0] > 1}
    if not wanted:
        return Cells({})
    asked = classes.sparkSession.createDataFrame([(k, 8.0 * v / size) for k, (v, size) in wanted.items()], "space bigint, part double")
    mark = F.xxhash64("cid", F.lit("pivot"))
    some = classes.join(F.broadcast(asked), "space").where(F.pmod(mark, F.lit(1 << 40)) < F.col("part") * float(1 << 40))
    drawn = some.select("space", "embedding", mark.alias("mark")).toArrow().sort_by([("mark", "ascending")])
    space, vectors = drawn["space"].to_numpy(), drawn["embedding"].combine_chunks()
    found = {k: units(vectors.take(pa.array(np.flatnonzero(space == k)[:v]))) for k, (v, _) in wanted.items() if (space == k).any()}
    return Cells({k: p for k, p in found.items() if len(p) > 1})


def range_join(vectors: DataFrame, cosine: float = 0.98, cell: int = CELL, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label, any others).

    Two rows link if their labels are equal and not null, their vectors equally long, and their cosine, in double
    precision, is `cosine` (over 0) or more. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing and are their own component. Repeated rows are vectors of their own and link with each other. A null vec_id is
    the largest: it names a component only if all its members' are null, and its own row is kept then. An empty table gives an
    empty table. cell, block and pivots bound memory and tasks; the result doesn't depend on them.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", "label")
    good = F.coalesce(F.expr(GOOD), F.lit(False))
    h = [F.xxhash64("label", "embedding"), F.xxhash64(F.lit("embedding"), "embedding", "label")]
    fit = rows.where(good).select("vec_id", "embedding", F.xxhash64("label", F.size("embedding")).alias("space"), h[0].alias("h1"), h[1].alias("h2"))
    grouped = fit.groupBy("h1", "h2").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("space").alias("space"), F.first("embedding").alias("embedding"))
    classes = cut(grouped.withColumn("cid", F.monotonically_increasing_id()))
    kind = dict(vectors.dtypes)["embedding"]
    sizes = classes.groupBy("space").agg(F.count("*").alias("size")).where(F.col("size") > cell)
    cells = pivots_of(classes, sizes, cell, pivots)
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    sized = classes.join(sizes, "space", "left").withColumn("size", F.coalesce("size", F.lit(1).cast("bigint"))).select(CLASS)
    homes = cut(sized.mapInArrow(settle(cells), f"cid bigint, space bigint, n bigint, size bigint, embedding {kind}, home int, far double"))
    if cells.n:  # a row a cell comes to the driver
        for r in homes.where("home >= 0").groupBy("space", "home").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect():
            c = cells.first[r.space] + r.home
            cells.homes[c], cells.low[c], cells.high[c] = r.n, r.low, r.high
        for r in homes.mapInArrow(visitors(cells, radius), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            cells.visitors[r.cell] = r.n
    tasks = homes.mapInArrow(dealt(cells, radius, block), f"space bigint, cell int, left int, right int, side int, cid bigint, n bigint, embedding {kind}")
    found = cut(tasks.groupBy("space", "cell", "left", "right").applyInArrow(joined(cosine), "cid bigint, links bigint, root bigint"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = component_table(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    lows = classes.select("cid", "low", "n", "h1", "h2").join(parts.withColumnRenamed("v", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = lows.groupBy("root").agg(F.min("low").alias("component_id"))
    known = cut(lows.join(least, "root").join(links, "cid", "left").select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    for t in (homes, found, parts, classes):
        drop(t)
    keys = rows.select("vec_id", *[F.when(good, x).otherwise(F.xxhash64("vec_id") if k else None).alias(f"h{k + 1}") for k, x in enumerate(h)])
    out = keys.join(known, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all vectors of each label."""
    return range_join(table(spark, sf_dir, "embeddings"), 0.98)


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
), walk AS (SELECT DISTINCT a AS vec_id, a AS seen FROM p UNION SELECT w.vec_id, p.b FROM walk w JOIN p ON w.seen = p.a),
c AS (SELECT vec_id, min(seen) AS component_id FROM walk GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
