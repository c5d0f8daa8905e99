"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al. 2017), trained in numpy.

Positives are confirmed toxic texts; the unlabelled set is a sample of texts whose labels are not looked at.
The risk is prior * R+(P) + max(0, R-(U) - prior * R-(P)), for a linear classifier over the presence of hashed
words; where the second term falls below zero its gradient is reversed, as in the paper.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodepath.llm import textops as tx
from lodepath.llm.common import hold_out, ship, table
from lodepath.llm.quality import one_label

EDGE = tx.SPACE.copy()
EDGE[list(b".,;:!?\"'()[]{}#$%&*|<>=+/\\~^_-")] = True


def distinct_words(rows: int, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, word hash), where punctuation also separates."""
    doc, _, _, h = tx.words(data, offs, EDGE)
    o = np.lexsort((h, doc))
    doc, h = doc[o], h[o]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])][: len(doc)]
    return doc[new], h[new]


@F.arrow_udf(returnType=T.ArrayType(T.LongType()))
def words_of(text: pa.Array) -> pa.Array:
    values, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi, data, offs in tx.slices(text):
        doc, h = distinct_words(hi - lo, data, offs)
        values.append(h.view(np.int64))
        lengths.append(np.bincount(doc, minlength=hi - lo))
    return tx.lists(np.concatenate(values), np.concatenate(lengths))


class NonNegativePU:
    """words: sorted hashes of the features used; weight and bias of the linear classifier."""

    def __init__(self, prior: float, features: int = 2048, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4):
        self.prior, self.features, self.rounds, self.rate, self.decay = prior, features, rounds, rate, decay
        self.words, self.weight, self.bias = np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior)))

    def fit(self, positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray]) -> NonNegativePU:
        """Each set is (flat hashes, length of each row)."""
        np_, nu = len(positive[1]), len(unlabelled[1])
        if not np_ or not nu:
            return self
        words, inv = np.unique(np.concatenate([positive[0], unlabelled[0]]), return_inverse=True)
        kp = np.bincount(inv[: len(positive[0])], minlength=len(words))
        ku = np.bincount(inv[len(positive[0]) :], minlength=len(words))
        pp, pu = (kp + 0.5) / (np_ + 1), (ku + 0.5) / (nu + 1)
        pool = (kp + ku + 1) / (np_ + nu + 2)
        z = np.where(kp + ku >= 3, np.abs(pp - pu) / np.sqrt(pool * (1 - pool) * (1 / np_ + 1 / nu)), 0)
        chosen = np.sort(np.argsort(-z, kind="stable")[: self.features])
        chosen = chosen[z[chosen] > 1.5]
        if not len(chosen):
            return self
        to = np.full(len(words), -1)
        to[chosen] = np.arange(len(chosen))

        def rows(ids, lengths):
            r = np.repeat(np.arange(len(lengths)), lengths)
            keep = to[ids] >= 0
            return r[keep], to[ids][keep], len(lengths)

        p, u = rows(inv[: len(positive[0])], positive[1]), rows(inv[len(positive[0]) :], unlabelled[1])
        w, b = np.zeros(len(chosen)), self.bias
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0

        def act(x):
            return 1 / (1 + np.exp(-np.clip(np.bincount(x[0], w[x[1]], minlength=x[2]) + b, -30, 30)))

        def grad(x, g):
            return np.bincount(x[1], g[x[0]], minlength=len(w)), g.sum()

        for k in range(1, self.rounds + 1):
            sp, su = act(p), act(u)  # logistic loss: l+ = -log s, l- = -log(1 - s)
            minus = -np.log1p(-su + 1e-12).mean() + self.prior * np.log1p(-sp + 1e-12).mean()
            gu, gp = grad(u, su / u[2]), grad(p, sp * self.prior / p[2])
            neg = (gu[0] - gp[0], gu[1] - gp[1])
            if minus >= 0:
                pos = grad(p, (sp - 1) * self.prior / p[2])
                g, gb = pos[0] + neg[0], pos[1] + neg[1]
            else:
                g, gb = -neg[0], -neg[1]
            g = g + self.decay * w
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            c1, c2 = 1 - 0.9**k, 1 - 0.999**k
            w = w - self.rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            b = b - self.rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
        self.words, self.weight, self.bias = words[chosen], w, float(b)
        return self

    def score(self, text: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for lo, hi, data, offs in tx.slices(text):
            z = np.full(hi - lo, self.bias)
            if len(self.words):
                doc, h = distinct_words(hi - lo, data, offs)
                h = h.view(np.int64)
                at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
                hit = self.words[at] == h
                z += np.bincount(doc[hit], self.weight[at[hit]], minlength=hi - lo)
            out.append(1 / (1 + np.exp(-np.clip(z, -36, 36))))
        return np.concatenate(out)


def train(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000) -> NonNegativePU:
    """Learns from at most so many confirmed toxic and so many unlabelled texts (those of smallest hash of doc_id).

    Unlabelled texts are rows of labels whose label is not looked at, so that both sets follow the same law and
    the prior is the share of toxic among all labelled rows that aren't held out."""
    spark = docs.sparkSession
    ship(spark)
    known = one_label(labels, "toxic").where(~hold_out("doc_id", 5, 0))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    model = NonNegativePU(min(max((toxic + 0.5) / (n + 1), 1e-4), 0.9))
    by = known.withColumn("order", F.xxhash64("doc_id"))
    sample = (
        by.where("label = 1").orderBy("order", "doc_id").limit(positives).select("doc_id", F.lit(1).alias("positive"))
        .unionAll(by.orderBy("order", "doc_id").limit(unlabelled).select("doc_id", F.lit(0).alias("positive")))
    )  # at most positives + unlabelled rows: small enough to broadcast whatever the corpus
    got = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("positive", words_of("text").alias("words")).toArrow()
    kind = got.column("positive").to_numpy()

    def part(k):
        x = got.filter(pa.array(kind == k)).column("words").combine_chunks()
        return x.flatten().to_numpy(), np.diff(x.offsets.to_numpy())

    return model.fit(part(1), part(0))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **limits: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text, any others).

    Null texts count as empty and get the score of a text without known words; repeated rows each get a row; a
    null doc_id has held_out null and is never learned from. Without labels all scores are one small constant.
    """
    model = train(docs, labels, **limits)
    score = F.arrow_udf(lambda text: pa.array(model.score(text)), "double")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), hold_out("doc_id", 5, 0).alias("held_out"), score(F.col("text").cast("string")).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from `labels.toxic`."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
