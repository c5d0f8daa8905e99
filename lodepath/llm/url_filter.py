"""URL filters: longest-rule lookup, and a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodepath.llm import textops as tx
from lodepath.llm.common import ship, table

BUCKETS = 1 << 15
GRAMS = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of op2: (verdict, host, path prefix).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: A small labelled table to learn from where the user has none, made by seed_urls() from two vocabularies: words that hosts
#: to block are often made of (gambling, sex, quack medicine, usury, piracy, fraud, advertising), and words of other hosts.
BAD = "casino poker roulette jackpot betting bets lottery porn sex xxx escort webcam nude adult viagra cialis pills steroids payday loans forex keygen warez cracked torrent malware phishing spyware adware spam clickbait popup tracker ads banner followers replica giveaway prizes".split()
GOOD = "library news university cooking weather council science museum health travel garden history code football chess poetry radio cycling school forum encyclopedia parish market bakery theatre orchestra hospital railway harbour archive journal astronomy geology kitchen carpenter village holiday camera novel hiking".split()
PLAIN = "my the best top old new north south city world daily open first our".split()  # stand before and after either kind of word


def seed_urls(bad: list[str] = BAD, good: list[str] = GOOD, each: int = 12, seed: int = 5) -> list[tuple[str, int]]:
    """(url, 1 to block or 0 to allow): words in the forms that URLs take, and as many made-up names that mean nothing, to allow."""
    rng = random.Random(seed)

    def made_up() -> str:
        return "".join(rng.choice("bcdfghlmnprstvw") + rng.choice("aeiou") + rng.choice(["", "", "n", "r", "s"]) for _ in range(rng.randint(2, 4)))

    def url(name: str) -> str:
        top, lang = rng.choice(["com", "org", "net", "info", "de", "fr"]), rng.choice(["", "/en", "/de", "/fr", "/es"])
        return f"https://{rng.choice(['', '', 'www.', 'm.', 'blog.'])}{name}{rng.choice(['', '.example'])}.{top}{lang}/{rng.choice([str(rng.randrange(1000)), made_up(), ''])}"

    out = []
    for label, words in ((1, bad), (0, good)):
        for word in words:
            for _ in range(each):
                other = rng.choice([rng.choice(PLAIN), rng.choice(words), made_up()])
                gap = rng.choice(["-", "-", ""])
                out.append((url(rng.choice([word, word + gap + other, other + gap + word])), label))
    return out + [(url(made_up()), 0) for _ in range(len(bad) * each)]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]], what: int) -> Column:
    """The longest fitting rule's text (what = 0) or verdict (1); null if none fits. Rules are a short list."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.lit((h + p, verdict)[what])
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("string")


def gram_buckets(rows: int, data: np.ndarray, offs: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every byte n-gram of every row, lengths GRAMS."""
    row = np.repeat(np.arange(rows), np.diff(offs))
    out_r, out_b = [], []
    wide = data.astype(tx.U)
    for n in GRAMS:
        if len(data) < n:
            continue
        key = np.full(len(data) - n + 1, tx.U(salt * 8 + n))
        for j in range(n):
            key = (key << tx.U(8)) | wide[j : len(data) - n + 1 + j]
        same = row[: len(data) - n + 1] == row[n - 1 :]
        out_r.append(row[: len(data) - n + 1][same])
        out_b.append((tx.mix(key[same]) % tx.U(BUCKETS)).astype(np.int64))
    if not out_r:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_r), np.concatenate(out_b)


def features(host: pa.Array, path: pa.Array):
    """Yields (first row, end row, row of each n-gram, its bucket) for runs of rows; a mark stands at both ends."""
    for salt, col in ((1, host), (2, path)):
        marked = pa.array([f"^{x}$" for x in col.to_pylist()])
        for lo, hi, data, offs in tx.slices(marked):
            yield (lo, hi, *gram_buckets(hi - lo, tx.LOWER[data], offs, salt))


class UrlModel:
    """Logistic regression with weights for BUCKETS hashed n-grams; a row's n-grams count 1 / sqrt(their number)."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), bias

    @classmethod
    def fit(cls, urls: list[tuple[str, str]], label: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> UrlModel:
        """urls: (host, path). Full-batch gradient steps, both labels of equal weight in all; without both labels all weights stay 0."""
        r, b = cls._rows(pa.array([u[0] for u in urls], pa.string()), pa.array([u[1] for u in urls], pa.string()))
        n = max(1, len(urls))
        x = 1 / np.sqrt(np.maximum(np.bincount(r, minlength=n), 1))
        w, bias = np.zeros(BUCKETS), 0.0
        if len(set(label.tolist())) == 2:
            even = np.where(label == 1, n / (2 * (label == 1).sum()), n / (2 * (label == 0).sum()))
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[b], minlength=n) * x + bias, -30, 30)))
                e = (p - label) * even
                w -= rate * (np.bincount(b, (e * x)[r], minlength=BUCKETS) / np.sqrt(n) + decay * w)
                bias -= rate * e.mean()
        return cls(w, bias)

    @staticmethod
    def _rows(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = [(r + lo, b) for lo, _, r, b in features(host, path)]
        return tuple(np.concatenate(z) for z in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2

    def score(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        total, count = np.zeros(len(host)), np.zeros(len(host))
        for lo, hi, r, b in features(host, path):
            total[lo:hi] += np.bincount(r, self.weight[b], minlength=hi - lo)
            count[lo:hi] += np.bincount(r, minlength=hi - lo)
        return 1 / (1 + np.exp(-np.clip(total / np.sqrt(np.maximum(count, 1)) + self.bias, -30, 30)))


def train(spark: SparkSession, labelled: DataFrame, most: int = 100_000) -> UrlModel:
    """From a small table (url, label 0/1) of at most `most` rows; more is an error, as it is brought to the driver."""
    rows = labelled.where("url is not null and label in (0, 1)").select(host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"), F.col("label").cast("int").alias("y")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the labelled table has more than {most} rows")
    return UrlModel.fit([(r.h, r.p) for r in rows], np.array([r.y for r in rows], float))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], model: UrlModel, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of pages (page_id, url, any others).

    A null url, or one without ://, has empty host and path; no rule fits it and the model judges the empty
    strings. Repeated rows each get a row; an empty table gives an empty table.
    """
    ship(pages.sparkSession)
    score = F.arrow_udf(lambda h, p: pa.array(model.score(h, p)), "double")
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    h, p = F.col("host"), F.col("path")
    return parts.select(
        "page_id", "host", "path", rule_of(h, p, rules, 0).alias("rule"), rule_of(h, p, rules, 1).alias("listed"), score("host", "path").alias("score")
    ).select("page_id", "host", "path", "rule", F.coalesce("listed", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of `pages` under RULES, the rest judged by a model of the seed table."""
    seed = spark.createDataFrame(seed_urls(), "url string, label int")
    return judge(table(spark, sf_dir, "pages"), RULES, train(spark, seed))
