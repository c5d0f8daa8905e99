"""Operators without SQL against plain versions of the same formulas, written with loops over texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lodepath.llm")

from lodepath.llm import lm_score, quality, surrogates, textops, toxicity  # noqa: E402

SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def low(b):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["The", "of", "HOUSE", "über", "a", "I", "x1", "42%", "why?!", "end.", "naïve", "ok", "no#", "ЁЖ", "字", "THE", "b-c", "(d)", "longestwordofall"]
    out = [None, "", " \n ", "one", "A\nA\nA\n", "\r\n\tAB AB AB"]
    return out + ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\t", "\r\n"]) for _ in range(rng.randint(1, 80))) for _ in range(n)]


# --- quality


def plain_statistics(t):
    b = (t or "").encode()
    words, size = [w for w in SPACES.split(b) if w], max(len(b), 1)
    lines = [x for x in re.split(rb"[\r\n]+", b) if x]
    logit = lambda part, whole: math.log((part + 0.5) / (max(whole - part, 0) + 0.5))
    of = lambda chars, x=b: sum(c in chars for c in x)
    upper, vowels = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), set(b"aeiouAEIOU")
    letter = upper | set(b"abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
    symbol, bang = set(b"#$%&*@^~<>=+|_\\{}[]/"), set(b"!?")
    n, lens = len(words), [len(w) for w in words]
    mean = sum(lens) / max(n, 1)
    spread = math.sqrt(max(sum(v * v for v in lens) / max(n, 1) - mean * mean, 0))
    pairs = list(zip(map(low, words), map(low, words[1:]), strict=False))
    caps = sum(of(upper, w) == of(letter, w) and of(upper, w) > 1 for w in words)
    return [
        math.log1p(n), math.log1p(mean), math.log1p(spread), logit(of(upper), of(letter)), logit(of(set(b"0123456789")), size), logit(of(symbol), size), logit(of(bang), size),
        logit(of(set(b".,;:'\"()-")), size), logit(of(set(range(128, 256))), size), math.log1p(n / max(len(lines), 1)), logit(len(set(map(low, words))), n),
        logit(len(lines) - len(set(map(low, lines))), len(lines)), logit(sum(v <= 3 for v in lens), n), math.log1p(max(lens, default=0)), logit(sum(w[-1] in symbol | bang for w in words), n),
        logit(of(vowels), of(letter)), logit(caps, n), logit(len(pairs) - len(set(pairs)), len(pairs)),
    ]


def test_statistics_equal_a_plain_recount():
    some = texts(1)
    column = pa.array(some, pa.string())
    got = np.concatenate([quality.statistics(hi - lo, data, offs) for lo, hi, data, offs in textops.slices(column, 500)])
    assert np.allclose(got, [plain_statistics(t) for t in some], atol=1e-9)


def test_discriminant_equals_a_plain_one():
    rng = np.random.default_rng(2)
    x = [rng.normal(size=(90, 4)) @ rng.normal(size=(4, 4)), rng.normal(size=(50, 4)) + 0.7]
    m = quality.Discriminant(np.array([90.0, 50.0]), np.stack([v.sum(0) for v in x]), np.stack([v.T @ v for v in x]), pool=0.3, ridge=0.05)
    cov = [np.cov(v.T, bias=True) for v in x]
    pooled = (90 * cov[0] + 50 * cov[1]) / 140
    scale = np.sqrt(np.diag(pooled))
    density = []
    for k in (0, 1):
        c = 0.7 * cov[k] / np.outer(scale, scale) + 0.3 * pooled / np.outer(scale, scale)
        c = 0.95 * c + 0.05 * np.trace(c) / 4 * np.eye(4) + 1e-6 * np.eye(4)
        d = np.concatenate(x) / scale - x[k].mean(0) / scale
        density.append(-0.5 * (np.einsum("ij,ij->i", d, np.linalg.solve(c, d.T).T) + np.linalg.slogdet(c)[1]))
    assert np.allclose(m.z(np.concatenate(x)), density[1] - density[0] + math.log(50 / 90), atol=1e-8)


def test_quality_stage_keeps_what_the_scores_say(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    twice = labels.unionAll(labels.limit(40).withColumn("quality", 1 - F.col("quality")))
    scored = quality.quality(docs, twice).toPandas()
    known = {}
    for r in twice.collect():
        known[r.doc_id] = min(r.quality, known.get(r.doc_id, 1))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    learn = [(plain_statistics(t), known[d]) for d, t in rows if d in known and zlib.crc32(str(d).encode()) % 5]
    x, y = np.array([s for s, _ in learn]), np.array([v for _, v in learn])
    m = quality.Discriminant(np.array([(y == k).sum() for k in (0, 1)], float), np.stack([x[y == k].sum(0) for k in (0, 1)]), np.stack([x[y == k].T @ x[y == k] for k in (0, 1)]))
    z = np.clip(np.floor(np.abs(m.z(x)) * 10 + 0.5) / 10 * np.sign(m.z(x)), -500, 500)
    m.calibrate(z, y, np.ones(len(y)))
    want = dict(zip([d for d, _ in rows], m.score(np.array([plain_statistics(t) for _, t in rows])), strict=True))
    assert max(abs(want[r.doc_id] - r.score) for r in scored.itertuples()) < 1e-6
    assert sorted(r.doc_id for r in quality.keep_good(docs, twice).select("doc_id").collect()) == sorted(scored[scored["predicted"] == 1]["doc_id"])


# --- toxicity


def test_nnpu_equals_a_dense_plain_fit():
    rng = random.Random(5)
    vocab = list(range(100, 140))
    rows = lambda n, bad: [sorted(set(rng.choices(vocab, k=6)) | ({1, 2} if rng.random() < bad else set())) for _ in range(n)]
    p, u = rows(30, 0.95), rows(60, 0.2)
    flat = lambda s: (np.array([w for r in s for w in r], np.int64), np.array([len(r) for r in s]))
    model = toxicity.NonNegativePU(0.2, features=10, rounds=60).fit(flat(p), flat(u))

    def z(w):
        kp, ku = sum(w in r for r in p), sum(w in r for r in u)
        pool = (kp + ku + 1) / (len(p) + len(u) + 2)
        return abs((kp + 0.5) / (len(p) + 1) - (ku + 0.5) / (len(u) + 1)) / math.sqrt(pool * (1 - pool) * (1 / len(p) + 1 / len(u))) if kp + ku >= 3 else 0

    every = sorted({w for r in p + u for w in r})
    chosen = sorted(w for w in sorted(every, key=lambda w: -z(w))[:10] if z(w) > 1.5)
    assert model.words.tolist() == chosen and {1, 2} <= set(chosen)
    xp, xu = (np.array([[1.0 * (w in r) for w in chosen] + [1.0] for r in s]) for s in (p, u))
    th = np.array([0.0] * len(chosen) + [math.log(0.2 / 0.8)])
    m, v = np.zeros_like(th), np.zeros_like(th)
    for k in range(1, 61):
        sp, su = 1 / (1 + np.exp(-xp @ th)), 1 / (1 + np.exp(-xu @ th))
        rest = np.mean(-np.log(1 - su)) - 0.2 * np.mean(-np.log(1 - sp))  # R-(U) - prior R-(P)
        g_rest = xu.T @ su / len(u) - 0.2 * xp.T @ sp / len(p)
        g = 0.2 * xp.T @ (sp - 1) / len(p) + g_rest if rest >= 0 else -g_rest
        g = g + 1e-4 * np.r_[th[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        th = th - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    assert np.allclose(model.weight, th[:-1], atol=1e-6) and abs(model.bias - th[-1]) < 1e-6


# --- surrogates


def plain_permuted(s, tweak, alphabets=surrogates.ALPHABETS):
    a, b = s[: len(s) // 2], s[len(s) // 2 :]

    def step(s, other, salt):
        digest = hashlib.sha256(f"{salt}|{other.lower()}".encode()).hexdigest()
        out = ""
        for i, c in enumerate(s):
            abc = next((x for x in alphabets if c in x), None)
            out += c if abc is None else abc[(abc.index(c) + int(digest[i % 32 * 2 : i % 32 * 2 + 2], 16)) % len(abc)]
        return out

    for k in range(4):
        a, b = (step(a, b, f"{tweak}|{k}"), b) if k % 2 == 0 else (a, step(b, a, f"{tweak}|{k}"))
    return a + b


def refill(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn(ds):
    return sum(v - 9 if v > 9 else v for v in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(ds)))) % 10


def plain_surrogate(e, key):
    digits = re.sub(r"\D", "", e)
    if "@" in e:
        local, host = e.rsplit("@", 1)
        name, top = host.rsplit(".", 1)
        return plain_permuted(local, f"{key}|mail|{host.lower()}") + "@" + plain_permuted(name, f"{key}|host|{top.lower()}") + "." + top
    if re.fullmatch("[0-9a-fA-F]{32,}", e):
        s = plain_permuted(e.lower(), f"{key}|secret", surrogates.HEX)
        return s.upper() if e == e.upper() else s
    if e[0] in "+(":
        code = re.match(r"\+(\d{1,3})(?=[ .(-])", e)
        code = code[1] if code else ""
        return refill(e, code + plain_permuted(digits[len(code) :], f"{key}|phone|{code}"))
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", e):
        return refill(e, plain_permuted(digits, f"{key}|ssn"))
    if re.fullmatch(r"\d[\d -]*", e):
        if luhn(digits):
            return e
        body = digits[0] + plain_permuted(digits[1:-1], f"{key}|card|{digits[0]}")
        return refill(e, body + next(c for c in "0123456789" if luhn(body + c) == 0))
    if re.match("[A-Z]{2}\\d{2}", e):
        return e[:2] + plain_permuted(e[2:], f"{key}|iban|{e[:2]}")
    words = e.split(" ")
    return " ".join([words[0], plain_permuted(words[1], f"{key}|family")])


def test_surrogates_equal_plain_ones(spark):
    rng = random.Random(6)
    found = ["Jo.Doe+x@Mail.Example.com", "é@müller.de", "0123456789abcdef" * 2, "ABCDEF0123456789" * 2, "+49 30 1234567", "(212) 555-0199", "123-45-6789", "DE89370400440532013000", "Herr Müller", "Dr. Иванов", "Mrs Παπας", "4111 1111 1111 1111", "4111111111111112"]
    for _ in range(40):
        found.append(f"{''.join(rng.choices('abcXYZ019._', k=rng.randint(1, 9)))}a@{''.join(rng.choices('mnopQ', k=4))}.org")
        found.append(f"{rng.randrange(1000):03}-{rng.randrange(100):02}-{rng.randrange(10000):04}")
    df = spark.createDataFrame([(e,) for e in found], "e string")
    got = [r.s for r in df.coalesce(1).select(surrogates.surrogate(F.col("e"), "k1").alias("s")).collect()]
    assert got == [plain_surrogate(e, "k1") for e in found]


# --- language model


def test_lm_scores_equal_a_plain_softmax(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(30)], k=rng.randint(0, 40)))) for i in range(60)] + [(None, "w1 new"), (7, None)]
    kept, fit = [], lm_score.trained

    def keep(pairs, outputs):
        kept.append(fit(pairs, outputs))
        return kept[-1]

    monkeypatch.setattr(lm_score, "trained", keep)
    vocab = 9
    got = Counter((None if r.doc_id is None else r.doc_id, r.n_tokens, round(r.score, 3)) for r in lm_score.lm_score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), vocab).collect())
    x, out = kept[0][0].x.astype(float), vocab + 1
    tokens = lambda t: [*(t or "").split(), None]
    count = Counter(w for d, t in docs if d is not None and zlib.crc32(str(d).encode()) % 7 != 2 for w in tokens(t))

    def hashed(w):
        if w is None:
            return int(np.array([lm_score.END]).view(np.int64)[0])
        data, offs = textops.buffers(pa.array([w]))
        return int(textops.words(data, offs)[3].view(np.int64)[0])

    top = sorted(count, key=lambda w: (-count[w], hashed(w)))[:vocab]
    rest = sum(count.values()) + len(count) + 1 - sum(count[w] + 1 for w in top)
    want = Counter()
    for d, t in docs:
        total, before = 0.0, out
        for w in tokens(t):
            at = top.index(w) if w in top else vocab
            r = x[out + before]
            z = x[:out, :-1] @ r[:-1] + x[:out, -1]
            total += (z[at] - np.log(np.exp(z).sum())) / math.log(10)
            if at == vocab:
                total += math.log10((count[w] + 1) / rest)
            before = at
        want[(d, len(tokens(t)), round(total, 3))] += 1
    near = lambda c: sorted((str(d), n, s) for (d, n, s), k in c.items() for _ in range(k))
    for a, b in zip(near(got), near(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 5e-3
