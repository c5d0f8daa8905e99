"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

Counts: exact, over all training texts; merged in each task, then by Spark. The most frequent tokens and one class
"rest" are the model's outputs: P(w | previous) = softmax(Q r + b), where r is the previous token's vector (with one
word of context, the model's matrix C is part of r). Their number grows with the square root of the training tokens
(vocabulary()), so that normalising, which is exact, costs in proportion to the corpus. A token of the rest has
P(rest | previous) times its share of the rest's smoothed counts, so that probabilities of all tokens, one unseen type
included, sum to 1.

Training: Spark sums (previous, next) over all training texts. Executors run noise-contrastive estimation with the
unigram law as noise (Mnih & Teh 2012) over shares of about SHARE distinct pairs; a round visits every pair at least
once and a frequent one once for each CHUNK of its count. Rounds alternate between the contexts' vectors (shares by
context) and the outputs' (shares by output), so that a share owns the rows that it changes and nothing is averaged
over shares. Only the parameters reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodepath.llm import textops as tx
from lodepath.llm.common import cut, drop, hold_out, ship, table

END = tx.U(0x0E0D0E0D0E0D0E0D)
VOCAB, WIDTH = 1023, 32
GROWTH = 4.0  # outputs for each square root of a training token
SHARE, CHUNK, ROUNDS, LEAST_STEPS = 1 << 21, 8, 2, 200
BATCH, NOISE, SHARED, RATE, DAMP = 512, 10, 256, 0.2, 3.0
HOT = 1 << 16
FLUSH = 1 << 20


def tokens(rows: int, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's words in order, then one end."""
    doc, _, _, h = tx.words(data, offs)
    n = np.bincount(doc, minlength=rows)
    ends = np.cumsum(n + 1) - 1
    row = np.repeat(np.arange(rows), n + 1)
    out = np.full(len(row), END, tx.U)
    inner = np.ones(len(row), bool)
    inner[ends] = False
    out[inner] = h
    return row, out.view(np.int64)


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token hash, count), merged over up to FLUSH distinct tokens at a time."""
    held, size = [], 0

    def merged():
        t, inv = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return t, np.bincount(inv, np.concatenate([n for _, n in held])).astype(np.int64)

    for batch in batches:
        for lo, hi, data, offs in tx.slices(batch.column(0)):
            t, n = np.unique(tokens(hi - lo, data, offs)[1], return_counts=True)
            held.append((t, n))
            size += len(t)
            if size > FLUSH:
                held = [merged()]
                size = len(held[0][0])
                if size > FLUSH // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=["t", "n"])
                    held, size = [], 0
    if held:
        t, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], names=["t", "n"])


class Lookup:
    """Positions of hashes in a table sorted by hash; -1 where absent."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], -1)


def previous(row: np.ndarray, ids: np.ndarray, start: int) -> np.ndarray:
    """Each token's predecessor in its row; `start` before the first."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    out[first] = start
    return out


def vocabulary(tokens: int) -> int:
    """Outputs besides the rest for so many training tokens."""
    return max(VOCAB, int(GROWTH * tokens**0.5))


def count_pairs(vocab: np.ndarray):
    """(pair, count), merged over up to FLUSH distinct pairs at a time: ids 0..V-1, V for the rest, and V + 1 as a context for the start."""
    find, v = Lookup(vocab), len(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged():
            p, inv = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return p, np.bincount(inv, np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in batches:
            for lo, hi, data, offs in tx.slices(batch.column(0)):
                row, h = tokens(hi - lo, data, offs)
                ids = find(h)
                ids[ids < 0] = v
                held.append(np.unique(previous(row, ids, v + 1) * (v + 1) + ids, return_counts=True))
                size += len(held[-1][0])
                if size > FLUSH:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > FLUSH // 2:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], names=["p", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, merged())], names=["p", "n"])

    return run


def summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct indexes, sums of their rows)."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], np.add.reduceat(rows[order], first, axis=0)


class LogBilinear:
    """Scores of `outputs` classes after one of `outputs + 1` contexts (the last: start of text).

    Rows 0..outputs-1 of `x` are the outputs' vectors and, in the last column, biases; the contexts' vectors follow."""

    def __init__(self, outputs: int, width: int = WIDTH, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.outputs = outputs
        self.x = rng.normal(0, 0.1, (2 * outputs + 1, width + 1)).astype(np.float32)
        self.x[:, width] = 0
        self.z = None

    def start(self, uni: np.ndarray, marginal: np.ndarray) -> None:
        """Biases from the outputs' probabilities; `marginal` has the contexts'."""
        self.uni, self.marginal = uni, marginal
        self.x[: self.outputs, -1] = np.log(uni)
        self.z = None

    def visit(self, h: np.ndarray, w: np.ndarray, n: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, int]:
        """Round k over pairs of context h and output w with counts n, by sparse Adagrad: (rows of x changed, updates).

        Even rounds change the contexts' vectors against outputs drawn as noise; odd ones change the outputs' against
        contexts drawn from their marginal, where the same noise falls on an output."""
        out, contexts = self.outputs, k % 2 == 0
        rng = np.random.default_rng([seed, k])
        times = -(-n // CHUNK)
        which, weight = np.repeat(np.arange(len(n)), times), (n / times).astype(np.float32)
        batch = min(BATCH, max(64, len(which) // 256))
        passes = max(1, -(-LEAST_STEPS * batch // max(len(which), 1)))
        logn, cum = np.log(NOISE * self.uni).astype(np.float32), np.cumsum(self.uni if contexts else self.marginal)
        own, other = (h + out, w) if contexts else (w, h + out)
        square, steps = np.full(len(self.x), DAMP, np.float32), 0
        for _ in range(passes):
            rng.shuffle(which)
            for lo in range(0, len(which), batch):
                at = which[lo : lo + batch]
                a, g = own[at], weight[at]
                x = np.minimum(np.searchsorted(cum, rng.random(SHARED) * cum[-1], side="right"), len(cum) - 1)
                mine, pos, neg = self.x[a], self.x[other[at]], self.x[x if contexts else x + out]
                for y in (mine,) if contexts else (pos, neg):
                    y[:, -1] = 1  # a context's last place meets the bias
                gp = g / (1 + np.exp(np.clip(np.einsum("ij,ij->i", mine, pos) - logn[w[at]], -30, 30)))  # 1 - P(data)
                gn = -g[:, None] * np.float32(NOISE / SHARED) / (1 + np.exp(np.clip((logn[x] if contexts else logn[a][:, None]) - mine @ neg.T, -30, 30)))  # shared noise, rescaled to NOISE draws a pair
                rows, d = summed(a, gp[:, None] * pos + gn @ neg)
                if contexts:
                    d[:, -1] = 0
                square[rows] += (d * d).mean(1)
                self.x[rows] += np.float32(RATE / (1 + k // 2)) * d / np.sqrt(square[rows])[:, None]
                steps += 1
        return np.unique(own), steps

    def fit(self, pairs: np.ndarray, seed: int = 11) -> LogBilinear:
        """pairs: (contexts, outputs) counts, as one share."""
        total = pairs.sum()
        if not total:
            return self
        self.start((pairs.sum(0) + 0.5) / (total + 0.5 * pairs.shape[1]), pairs.sum(1) / total)
        h, w = np.nonzero(pairs)
        for k in range(2 * ROUNDS):
            self.visit(h, w, pairs[h, w].astype(np.int64), k, seed)
        return self

    def logz(self, contexts: np.ndarray) -> np.ndarray:
        """Log of the sum over all outputs, by batched matrix products."""
        q, out = self.x[: self.outputs], np.full(len(contexts), -np.inf)
        for lo in range(0, len(contexts), 512):
            r = self.x[contexts[lo : lo + 512] + self.outputs].copy()
            r[:, -1] = 1
            for at in range(0, len(q), 1 << 14):
                z = r @ q[at : at + (1 << 14)].T
                top = z.max(1, keepdims=True)
                out[lo : lo + 512] = np.logaddexp(out[lo : lo + 512], top[:, 0] + np.log(np.exp(z - top).sum(1, dtype=np.float64)))
        return out

    def log10(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Normalised log10 P(word | context)."""
        if self.z is None:
            self.z = self.logz(np.arange(self.outputs + 1))
        out = np.empty(len(word))
        for lo in range(0, len(word), 1 << 16):
            c, w = context[lo : lo + (1 << 16)], self.x[word[lo : lo + (1 << 16)]]
            out[lo : lo + (1 << 16)] = np.einsum("ij,ij->i", self.x[c + self.outputs, :-1], w[:, :-1]) + w[:, -1] - self.z[c]
        return out / np.log(10)


ROWS = "k bigint, steps bigint, x array<float>"


def share_round(model: LogBilinear, k: int, seed: int = 11):
    """Per share of the pairs: the rows that it has changed; row -1 has the number of updates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        p, n = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(p)
        h, w = np.divmod(p[order], model.outputs)
        changed, steps = model.visit(h, w, n[order], k, seed)
        rows, steps = np.r_[changed, -1], np.r_[np.zeros(len(changed), np.int64), steps]
        for lo in range(0, len(rows), 1 << 14):
            part = model.x[rows[lo : lo + (1 << 14)]]
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(rows[lo : lo + (1 << 14)]), pa.array(steps[lo : lo + (1 << 14)]), vectors], names=["k", "steps", "x"])

    return run


def trained(pairs: DataFrame, outputs: int) -> tuple[LogBilinear, dict[str, int]]:
    """A model of pairs (p, n), p = context * outputs + output, and what it took: pairs, tokens, shares, updates."""
    spark = pairs.sparkSession
    model = LogBilinear(outputs)
    h, w = F.floor(F.col("p") / outputs), F.col("p") % outputs
    sums = pairs.select(F.explode(F.array(w, h + outputs)).alias("k"), "n").groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("d")).toPandas()
    sums, mine = np.bincount(sums["k"].to_numpy(np.int64), sums["n"].to_numpy(float), minlength=2 * outputs + 1), int(sums["d"].sum()) // 2
    took = {"pairs": mine, "tokens": int(sums[:outputs].sum()), "shares": -(-mine // SHARE), "updates": 0}
    if mine:
        n = sums[:outputs] + 0.5
        model.start(n / n.sum(), sums[outputs:] / sums[outputs:].sum())
        for k in range(2 * ROUNDS):
            got = pairs.repartition(took["shares"], w if k % 2 else h).mapInArrow(share_round(model, k), ROWS).toArrow()
            at = got["k"].to_numpy()
            model.x[at[at >= 0]] = got["x"].combine_chunks().flatten().to_numpy().reshape(len(at), -1)[at >= 0]
            took["updates"] += int(got["steps"].to_numpy().sum())

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(model.logz(c))], names=["c", "z"])

    z = spark.range(0, outputs + 1, 1, -(-(outputs + 1) // 2048)).mapInArrow(norms, "c bigint, z double").toPandas()
    model.z = np.empty(outputs + 1)
    model.z[z["c"].to_numpy()] = z["z"].to_numpy()
    return model, took


def scorer(hot: np.ndarray, counts: np.ndarray, vocab: int, model: LogBilinear):
    """Per row: what the hot tokens give, and (hash, times) of the others, which a join completes."""
    find, v = Lookup(hot), vocab
    logc = np.log10(counts + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offs in tx.slices(batch.column(1)):
                rows = hi - lo
                row, h = tokens(rows, data, offs)
                at = find(h)
                known = at >= 0
                word = np.where(known & (at < v), at, v)
                add = lambda at, w: np.bincount(at, w, minlength=rows).astype(np.float64)  # noqa: E731  (integers where nothing is counted)
                lm = add(row, model.log10(previous(row, word, v + 1), word))
                rest_hot = known & (at >= v)
                r, x = row[~known], h[~known]
                o = np.lexsort((x, r))
                r, x = r[o], x[o]
                first = np.r_[True, (r[1:] != r[:-1]) | (x[1:] != x[:-1])][: len(r)]
                times = np.diff(np.r_[np.flatnonzero(first), len(r)]).astype(np.int32)
                many = np.bincount(r[first], minlength=rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, rows), pa.array(np.bincount(row, minlength=rows)), pa.array(np.bincount(row[known], minlength=rows)), pa.array(lm),
                        pa.array(add(row[known], logc[at[known]])), pa.array(add(row[rest_hot], logc[at[rest_hot]])),
                        pa.array(np.bincount(row[word == v], minlength=rows)), tx.lists(x[first], many), tx.lists(times, many),
                    ],
                    names=["doc_id", "n_tokens", "n_known", "lm", "logc", "logc_rest", "n_rest", "rare", "times"],
                )

    return run


def lm_score(docs: DataFrame, vocab: int | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text, any others).

    Learns from rows whose crc32(doc_id as text) mod 7 isn't 2; a null doc_id has held_out null and isn't learned
    from. A null text is empty: its only token is the end. Repeated rows count and are scored each. Without
    training rows, all tokens are unknown and the model is uniform. `vocab` outputs; vocabulary() of the training tokens if None.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = docs.where(~hold_out("doc_id", 7, 2)).select("text")
    counts = cut(train.mapInArrow(count_tokens, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n")))
    types, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    vocab = vocabulary(int(total)) if vocab is None else vocab
    top = counts.orderBy(F.desc("n"), "t").limit(max(hot, vocab) if hot == HOT else hot).toPandas()
    hashes, freq = top["t"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    v = min(vocab, len(hashes))
    pairs = cut(train.mapInArrow(count_pairs(hashes[:v]), "p bigint, n bigint").groupBy("p").agg(F.sum("n").alias("n")))
    model, _ = trained(pairs, v + 1)
    drop(pairs)
    rest = np.log10(float((total + types + 1) - (freq[:v].sum() + v)))  # smoothed counts of the rest, one unseen type included
    base = np.log10(float(total + types + 1))
    parts = cut(
        docs.mapInArrow(scorer(hashes, freq, v, model), "doc_id bigint, n_tokens bigint, n_known bigint, lm double, logc double, logc_rest double, n_rest bigint, rare array<bigint>, times array<int>")
        .withColumn("rid", F.monotonically_increasing_id())
    )
    rare = parts.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("t"), F.col("x.times").alias("times"))
    more = rare.join(counts, "t").groupBy("rid").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("add"))
    zero = F.lit(0)
    return parts.drop("rare", "times").join(more, "rid", "left").select(
        "doc_id", hold_out("doc_id", 7, 2).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", zero)).alias("n_known"), F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("logc") + F.coalesce("add", zero) - F.col("n_tokens") * float(base)).alias("base_score"),
        (F.col("lm") + F.col("logc_rest") + F.coalesce("add", zero) - F.col("n_rest") * float(rest)).alias("score"),
    )


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return lm_score(table(spark, sf_dir, "documents"))
