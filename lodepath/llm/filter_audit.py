"""Filter interaction audit: what five filters remove in each of their 120 orders, by part of the corpus.

Only one number of a document matters: the set of filters that it fails, a mask of five bits. So the corpus is
summed to histograms of 32 masks: one row a part and kind of document (all, good, toxic). The outcome of each order
and step is a linear function of such a row: the incidence matrices (32 x 600, integers) tell for every mask whether a
step keeps it, removes it, finds it removed already, or is the only filter it fails. Rows times matrices give the answer.

Masks are column expressions over whole texts. Copies are known by two 64-bit hashes of the text. A text's first
document (the smallest doc_id) passes filter E and all others of the text fail it, so one grouped minimum by text, summed
within each task first, replaces any list of copies: a group of any size sends one row a task.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodepath.llm.common import cut, ship, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def incidence() -> dict[str, np.ndarray]:
    """For each outcome a 32 x 600 matrix of 0 and 1; columns are (order, step), order by order."""
    out = {k: np.zeros((32, len(ORDERS), 5), np.int64) for k in OUTCOMES}
    masks = np.arange(32)
    for o, order in enumerate(ORDERS):
        before = 0
        for step, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            fails, gone = (masks & bit) > 0, (masks & before) > 0
            out["kept"][:, o, step] = ~fails & ~gone
            out["removed"][:, o, step] = fails & ~gone
            out["redundant"][:, o, step] = fails & gone
            out["unique_fails"][:, o, step] = masks == bit
            before |= bit
    return {k: v.reshape(32, -1) for k, v in out.items()}


def shapley(removed: np.ndarray) -> np.ndarray:
    """The matrix that gives, at each (order, step), what its filter removes summed over all orders."""
    letters = np.array([FILTERS.index(x) for order in ORDERS for x in order])
    total = np.stack([removed[:, letters == k].sum(1) for k in range(5)], 1)
    return total[:, letters]


def quick_fails(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = (n < 200, 100 * distinct < 50 * n, 100 * capitals.cast("bigint") > 2 * F.length(text).cast("bigint"), text.rlike("[#$%&*|]"))
    out = F.lit(0)
    for k, fails in enumerate(tests):
        out = out + F.when(fails, 1 << k).otherwise(0)
    return out.cast("int")


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail exactly the filters of mask, and how many have the label."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text, F.length(text)).alias("h2"), quick_fails(text).alias("mask"),
    ).withColumn("salt", F.when(F.col("doc_id").isNull(), F.col("h1")).otherwise(0))  # rows without an id are dealt by text
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("salt")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    marked = rows.groupBy("doc_id", "salt", "h1", "h2", "mask", "part").agg(F.count("*").alias("n")).join(marks, ["doc_id", "salt"], "left")
    marked = marked.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("good", "toxic")})
    keys = ["doc_id", "salt", "h1", "h2", "mask", "good", "toxic"]
    each = cut(marked.groupBy(*keys).agg(F.collect_list(F.struct("part", "n")).alias("parts")))
    what = F.struct("mask", "good", "toxic", "parts")
    firsts = each.where("doc_id is not null").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", what.alias("what"))).alias("first"))
    passed = each.where("doc_id is null").select(what.alias("what")).unionAll(firsts.select("first.what"))
    # all count as failing E; those that pass it are taken from there and put where they belong
    last = 1 << FILTERS.index("E")
    moved = each.select(what.alias("what"), F.lit(last).alias("e"), F.lit(1).alias("sign")).unionAll(
        passed.select("what", F.explode(F.array(F.struct(F.lit(last).alias("e"), F.lit(-1).alias("sign")), F.struct(F.lit(0).alias("e"), F.lit(1).alias("sign")))).alias("to")).select("what", "to.e", "to.sign")
    )
    flat = moved.select(F.explode("what.parts").alias("p"), (F.col("what.mask") + F.col("e")).alias("mask"), "sign", "what.good", "what.toxic")
    n = F.col("p.n") * F.col("sign")
    return flat.groupBy(F.col("p.part").alias("part"), "mask").agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic")).where("n > 0")


def outcomes(batches):
    """Histograms of parts times the incidence matrices: 600 rows a part."""
    m = incidence()
    m["shapley"] = shapley(m["removed"])
    orders, steps = np.repeat(np.array(ORDERS), 5), np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS))
    for batch in batches:
        for lo in range(0, len(batch), 64):
            some = batch.slice(lo, 64)
            col = some.column(1)
            part = np.repeat(np.arange(len(some)), np.diff(col.offsets.to_numpy()))
            flat = col.flatten()
            x = np.zeros((3, len(some), 32), np.int64)
            for k, name in enumerate(("n", "good", "toxic")):
                x[k, part, flat.field("mask").to_numpy()] = flat.field(name).to_numpy()
            every = [x[0] @ m[k] for k in OUTCOMES] + [x[1] @ m["removed"], x[2] @ m["removed"], x[0] @ m["shapley"]]
            names = some.column(0).take(pa.array(np.repeat(np.arange(len(some)), 600)))
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(np.tile(orders, len(some))), pa.array(np.tile(steps, len(some))), *(pa.array(v.ravel()) for v in every)],
                names=["part", "filter_order", "step", *OUTCOMES, "good_lost", "toxic_lost", "shapley"],
            )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs are (doc_id, text, source, any others), labels (doc_id, quality, toxic). A null source is the part ''; a null
    text is an empty one (it fails A, passes B, C and D). Repeated rows count each; rows of one doc_id don't make each
    other fail E. A row without a doc_id passes E, has no labels, and makes no other row fail. A document labelled
    more than once has each label that any of its rows gives. An empty table has no parts and gives no rows.
    """
    ship(docs.sparkSession)
    rows = histograms(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    return rows.mapInArrow(outcomes, SCHEMA)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions of five filters over all documents, by source."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         coalesce(min(doc_id) OVER (PARTITION BY coalesce(text, '')) < doc_id, false) AS fe FROM documents
), m AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), fe] AS fails,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS toxic FROM d
), h AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')) x(i, letter)),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS ids, a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (SELECT filter_order, CAST(step AS INT) AS step, ids[step] AS f, ids[1:step - 1] AS before FROM o, range(1, 6) r(step)),
x AS (SELECT *, fails[f] AS here, len(list_filter(before, lambda b: fails[b])) > 0 AS gone, len(list_filter(fails, lambda v: v)) = 1 AS one FROM h, s),
g AS (
  SELECT part, filter_order, step, f, CAST(sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN here AND one THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g
"""
