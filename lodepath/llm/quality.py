"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has its own covariance, shrunk towards the pooled one and towards a multiple of the identity
(Friedman's regularised discriminant analysis). A score is the difference of two Gaussian log densities, whose
Mahalanobis terms use cached Cholesky factors, put on a probability scale by a two-parameter logistic fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodepath.llm import textops as tx
from lodepath.llm.common import cut, drop, hold_out, ship, table

STATS = (
    "log words", "log mean word length", "log spread of word length", "logit capitals", "logit digits", "logit symbols", "logit exclamation marks",
    "logit other punctuation", "logit bytes above ASCII", "log words a line", "logit distinct words", "logit repeated lines", "logit short words", "log longest word",
    "logit words that end in a symbol", "logit vowels", "logit words in capitals", "logit repeated word pairs",
)
LINE = np.zeros(256, bool)
LINE[[10, 13]] = True


def _class(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


UPPER, DIGIT, SYMBOL, BANG, PUNCT, VOWEL = map(_class, ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*@^~<>=+|_\\{}[]/", "!?", ".,;:'\"()-", "aeiouAEIOU"))
LETTER = UPPER | _class("abcdefghijklmnopqrstuvwxyz")
LETTER[128:] = True
HIGH = np.zeros(256, bool)
HIGH[128:] = True


def statistics(rows: int, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The STATS of each row, as rows x len(STATS) doubles; texts without words have finite ones too."""
    doc, starts, ends, h = tx.words(data, offs)
    n = np.bincount(doc, minlength=rows).astype(float)
    length = (ends - starts).astype(float)
    size = np.maximum(np.diff(offs).astype(float), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.r_[0, np.cumsum(mask[data], dtype=np.int64)]
        return c[offs[1:]] - c[offs[:-1]]

    def by_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, values, minlength=rows)

    def logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))

    def distinct(d: np.ndarray, x: np.ndarray) -> np.ndarray:
        o = np.lexsort((x, d))
        d, x = d[o], x[o]
        new = np.r_[True, (d[1:] != d[:-1]) | (x[1:] != x[:-1])][: len(d)]
        return np.bincount(d[new], minlength=rows).astype(float)

    one = np.maximum(n, 1)
    mean = by_word(length) / one
    spread = np.sqrt(np.maximum(by_word(length * length) / one - mean * mean, 0))
    line_doc, _, _, line_h = tx.words(data, offs, LINE)
    lines = np.bincount(line_doc, minlength=rows).astype(float)
    longest = np.zeros(rows)
    np.maximum.at(longest, doc, length)
    caps = np.r_[0, np.cumsum(UPPER[data], dtype=np.int64)]
    letters = np.r_[0, np.cumsum(LETTER[data], dtype=np.int64)]
    in_caps, in_letters = caps[ends] - caps[starts], letters[ends] - letters[starts]
    pair = tx.mix(h[:-1] + tx.mix(h[1:])) if len(h) else h
    same = doc[:-1] == doc[1:]
    pairs = np.bincount(doc[:-1][same], minlength=rows).astype(float)
    out = [
        np.log1p(n), np.log1p(mean), np.log1p(spread), logit(share(UPPER), share(LETTER)), logit(share(DIGIT), size), logit(share(SYMBOL), size), logit(share(BANG), size),
        logit(share(PUNCT), size), logit(share(HIGH), size), np.log1p(n / np.maximum(lines, 1)), logit(distinct(doc, h), n), logit(lines - distinct(line_doc, line_h), lines), logit(by_word(length <= 3), n), np.log1p(longest),
        logit(by_word((SYMBOL | BANG)[data[ends - 1]].astype(float)), n), logit(share(VOWEL), share(LETTER)), logit(by_word((in_caps == in_letters) & (in_caps > 1)), n), logit(pairs - distinct(doc[:-1][same], pair[same]), pairs),
    ]
    return np.stack(out, 1)


@F.arrow_udf(returnType=T.ArrayType(T.DoubleType()))
def stats_of(text: pa.Array) -> pa.Array:
    parts = [statistics(hi - lo, data, offs) for lo, hi, data, offs in tx.slices(text)]
    flat = np.concatenate(parts) if parts else np.zeros((0, len(STATS)))
    return tx.lists(flat.ravel(), np.full(len(flat), flat.shape[1]))


class Discriminant:
    """Two Gaussians with shrunk covariances; z() is log p(x | 1) - log p(x | 0) plus the log ratio of priors."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, outers: np.ndarray, pool: float = 0.3, ridge: float = 0.05):
        d = sums.shape[1]
        means = sums / n[:, None]
        cov = outers / n[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = (cov * (n / n.sum())[:, None, None]).sum(0)
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        cov, pooled = cov / np.outer(self.scale, self.scale), pooled / np.outer(self.scale, self.scale)
        self.means, self.inverse, self.logdet = means / self.scale, [], []
        for k in (0, 1):
            c = (1 - pool) * cov[k] + pool * pooled
            c = (1 - ridge) * c + ridge * np.trace(c) / d * np.eye(d) + 1e-6 * np.eye(d)
            factor = np.linalg.cholesky(c)
            self.inverse.append(np.linalg.inv(factor).T)
            self.logdet.append(2 * np.log(np.diag(factor)).sum())
        self.prior = np.log(n[1] / n[0])
        self.slope, self.shift = 1.0, 0.0

    def z(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        far = [((x - self.means[k]) @ self.inverse[k]) for k in (0, 1)]
        d2 = [(f * f).sum(1) + ld for f, ld in zip(far, self.logdet, strict=True)]
        return 0.5 * (d2[0] - d2[1]) + self.prior

    def calibrate(self, z: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """Newton steps on the weighted logistic loss of slope * z + shift."""
        s = 1 / max(1.0, float(np.average(np.abs(z), weights=weight)))
        a = np.array([s, 0.0])
        x = np.stack([z, np.ones_like(z)], 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
            g = x.T @ (weight * (p - label)) + 1e-3 * a
            hess = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-3 * np.eye(2)
            step = np.linalg.solve(hess, g)
            a -= step * min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        if a[0] > 0:
            self.slope, self.shift = map(float, a)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.z(x) + self.shift, -36, 36)))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(labelled: DataFrame) -> Discriminant | None:
    """From rows (stats, label): moments are summed over all rows by Spark, the driver gets 2 x (d * d + d + 1) numbers.

    None if either class has no row."""
    d = len(STATS)

    def moments(batches):
        total = {}
        for b in batches:
            x, y = matrix(b.column(0)), b.column(1).to_numpy()
            for k in (0, 1):
                z = x[y == k]
                total[k] = total.get(k, 0) + np.r_[len(z), z.sum(0), (z.T @ z).ravel()]
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k)), pa.array(np.arange(len(v))), pa.array(v)], names=["k", "i", "v"])

    got = labelled.select("stats", F.col("label").cast("int")).mapInArrow(moments, "k bigint, i bigint, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).toPandas()
    v = np.zeros((2, 1 + d + d * d))
    v[got["k"], got["i"]] = got["v"]
    if not (v[:, 0] > 0).all():
        return None
    model = Discriminant(v[:, 0], v[:, 1 : d + 1], v[:, d + 1 :].reshape(2, d, d))
    z = F.arrow_udf(lambda x: pa.array(model.z(matrix(x))), "double")
    bars = labelled.select(F.round(z("stats"), 1).alias("z"), F.col("label").cast("int").alias("y"))
    bars = bars.select(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), "z")).alias("z"), "y").groupBy("z", "y").agg(F.count("*").alias("n")).toPandas()
    model.calibrate(bars["z"].to_numpy(), bars["y"].to_numpy(), bars["n"].to_numpy())
    return model


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) with label 0 or 1; a document labelled twice has the smaller label, others are left out."""
    return labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col(column).cast("int")).alias("label"))


def train(docs: DataFrame, labels: DataFrame) -> Discriminant | None:
    """The model of all labelled rows that aren't held out. docs have doc_id and stats, or text, whose statistics are then computed for those rows only."""
    known = docs.join(one_label(labels, "quality"), "doc_id").where(~hold_out("doc_id", 5, 0))
    if "stats" in docs.columns:
        return fit(known)
    known = cut(known.select(stats_of(F.col("text")).alias("stats"), "label"))
    model = fit(known)
    drop(known)
    return model


def score_of(model: Discriminant | None):
    """A column function from stats to a score of 0 to 1; 0.5 if there was nothing to learn from."""
    return F.arrow_udf(lambda x: pa.array(model.score(matrix(x)) if model else np.full(len(x), 0.5)), "double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text, any others).

    Null texts count as empty; empty and word-less texts are scored by the same model; repeated rows each get
    a row; a null doc_id has held_out null and is never learned from. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    stats = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), stats_of(F.col("text").cast("string")).alias("stats")))
    model = train(stats, labels)
    scored = stats.select("doc_id", hold_out("doc_id", 5, 0).alias("held_out"), score_of(model)("stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with their columns as they were.

    Nulls and empty texts are scored as in quality(); so rows without a doc_id stay if their text is good; an empty
    table stays empty. Without labels of both classes every score is 0.5 and every row stays where the threshold is no higher."""
    ship(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    score = score_of(train(text, labels))
    return docs.where(score(stats_of(F.col("text").cast("string"))) >= threshold)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from `labels.quality`."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
