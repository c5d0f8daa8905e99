"""Filter audit, token alignment and range join against brute force, with the edge cases that their docstrings define."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("lodepath.llm")

from lodepath.llm import filter_audit, range_join, token_align  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, mask string, row string, pairs string"


def made(rows):
    return [(i, t, "en", s, 0, "p", "m", "r", "q") for i, t, s in rows]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    base = [" ".join(rng.choices(["ab", "cd", "x$", "ÉÉ", "字", "The", "ABCD", "q"], k=rng.choice([3, 199, 200, 201, 400]))) for _ in range(12)]
    many = " ".join(f"w{i}" for i in range(260))
    texts = [None, "", " \n\t\x0b", "One", "a b  c\n", "  lead", "tail  ", "a▁b", "<|endoftext|> x", "İ ﬁ ́", "\x00 nul", many, many, many.upper(), *base, *base[:7], base[0], base[0]]
    rows = [(i, t, [None, "", "s1", "s2"][i % 4]) for i, t in enumerate(texts)]
    rows += [rows[14], rows[14], (14, base[0], "s1"), (None, base[0], "s1"), (None, base[0], None), (None, None, "s2"), (3, base[1], "s1"), (500, " ".join(rng.choices(["alpha", "Beta.", "gamma\n", "字字", "1,234"], k=50_000)), "s2")]
    return rows


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame(made(docs), DOCS).repartition(3)


# --- filter audit


def plain_audit(docs, labels):
    masks, first = [], {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, s in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": i is not None and first[t] < i}
        masks.append((s or "", {k for k, v in fails.items() if v}, any(d == i and q == 1 for d, q, _ in labels if d is not None), any(d == i and x == 1 for d, _, x in labels if d is not None)))
    out = {}
    for part in {m[0] for m in masks}:
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before, c = set(order[: step - 1]), Counter()
                for p, fails, good, toxic in masks:
                    if p == part:
                        here, gone = f in fails, bool(fails & before)
                        c += Counter(kept=not here and not gone, removed=here and not gone, redundant=here and gone, unique_fails=fails == {f}, good_lost=here and not gone and good, toxic_lost=here and not gone and toxic)
                out[part, order, step] = c
                total[f] += c["removed"]
        for (p, order, step), c in out.items():
            if p == part:
                c["shapley"] = total[order[step - 1]]
    return out


def test_audit_equals_a_walk_through_every_order(spark, docs, frame):
    marks = [(i, i % 2, (i + 1) % 3 % 2) for i in range(0, 40)] + [(14, 1, 1), (15, None, None), (None, 1, 1), (9999, 1, 1)]
    got = filter_audit.filter_audit(frame, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    want = plain_audit(docs, marks)
    assert len(got) == len(want) == 600 * 3
    for r in got:
        for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"):
            assert r[k] == want[r.part, r.filter_order, r.step][k], (r, k)


def test_audit_of_nothing(spark, frame):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(frame.where("false"), none).count() == 0
    assert filter_audit.filter_audit(frame, none).agg({"good_lost": "max", "toxic_lost": "max"}).first()[0] == 0


def test_incidence_matrices_split_every_mask():
    m = filter_audit.incidence()
    assert m["kept"].shape == (32, 600)
    fails = m["removed"] + m["redundant"]
    letters = [o[s] for o in filter_audit.ORDERS for s in range(5)]
    for mask in range(32):
        for k, letter in enumerate(letters):
            assert fails[mask, k] == mask >> "ABCDE".index(letter) & 1
        assert m["removed"][mask].reshape(120, 5).sum(1).tolist() == [int(mask > 0)] * 120


# --- token alignment


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(texts, paths):
    """Whole texts encoded at once, all pairs of tokens compared."""
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    one.encode_special_tokens = True
    of = token_align.byte_values()
    links, groups = [], []
    for t in texts:
        a = one.encode(" " + t, add_special_tokens=False).ids if t else []
        b = two.encode(t) if t else []
        ba = [bytes(of[c] for c in one.id_to_token(i)) for i in a]
        bb = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [two.id_to_piece(i)]]
        if not t or not b"".join(ba) == b"".join(bb) == (" " + t).encode():
            a, b, ba, bb = [], [], [], []
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        sa, sb = [0, *ea[:-1]], [0, *eb[:-1]]
        links.append([(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if sa[i] < eb[j] and sb[j] < ea[i]] if len(a) < 3000 else None)
        cuts = sorted(set(ea) & set(eb))
        parts, lo = [], 0
        for c in cuts:
            parts.append((",".join(str(a[i]) for i in range(len(a)) if lo < ea[i] <= c), ",".join(str(b[j]) for j in range(len(b)) if lo < eb[j] <= c)))
            lo = c
        groups.append((len(a), len(b), len(cuts), hashlib.sha256(";".join(f"{x}|{y}" for x, y in parts).encode()).hexdigest() if a else ""))
    return links, groups


@pytest.mark.parametrize("hot", [1 << 18, 40, 0])
def test_alignment_equals_all_pairs_of_tokens(spark, docs, frame, paths, hot):
    short = [d for d in docs if d[1] is None or len(d[1]) < 5000]
    links, groups = plain_alignment([t for _, t, _ in short], paths)
    n = Counter(p for x in links for p in set(x))
    best = {}
    for (a, _), c in n.items():
        best[a] = max(c, best.get(a, 0))
    want = Counter((i, *g[:3], len(x), sum(n[p] == best[p[0]] for p in x), sum(n[p] for p in x), g[3]) for (i, _, _), x, g in zip(short, links, groups, strict=True))
    got = token_align.token_alignment(frame.where("text is null or length(text) < 5000"), *paths, hot=hot).collect()
    assert Counter(map(tuple, got)) == want
    assert sum(w[4] for w in want) > 1000


def test_alignment_of_a_long_text_and_of_nothing(spark, frame, paths):
    assert token_align.token_alignment(frame.where("false"), *paths).count() == 0
    r = token_align.token_alignment(frame.where("doc_id = 500"), *paths).first()
    assert r.n_links == r.n_a + r.n_b - r.n_groups == r.count_sum and r.n_a > 50_000 and r.n_best == r.n_links  # every pair of a single text counts once


def test_pieces_encode_as_whole_texts(paths):
    """Both sides' piecewise ids equal those of whole texts, with the bitsets' rank and select against a plain count."""
    rng = random.Random(5)
    texts = ["".join(rng.choices(" \n\taZé字.,'1#▁́ 　", k=rng.randint(1, 60))) for _ in range(3000)] + [" ", "  ", " a", "a ", "\n", "a  b   c    ", "don't stop'll", "x" * 3000, "字" * 2000]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    data, offs = token_align.spaced(data, offs, np.arange(len(texts)))
    for side in (token_align.ByteSide(paths[0]), token_align.PieceSide(paths[1])):
        ids, n, good = side(data, offs)
        at = np.r_[0, np.cumsum(n)]
        for k, t in enumerate(texts):
            whole = side.tokenizer.encode(" " + t, add_special_tokens=False).ids if isinstance(side, token_align.ByteSide) else side.model.encode(t)
            if "▁" not in t:  # a text with it never comes back from a model, so its ids count for nothing
                assert ids[at[k] : at[k + 1]].tolist() == whole, t
            assert good[k] == (b"".join(side.bytes[i] for i in whole) == (" " + t).encode())
    ends = np.sort(rng.sample(range(1, 1000), 200))
    bits = token_align.Bits.of(ends, 1000)
    assert bits.select().tolist() == (ends - 1).tolist()
    assert bits.rank(np.arange(1000)).tolist() == [int((ends - 1 < i).sum()) for i in range(1000)]


# --- range join


def plain_range(rows, cosine):
    good = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    index = {id(r): k for k, r in enumerate(rows)}
    parent, links = list(range(len(rows))), [0] * len(rows)

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for p, r in enumerate(good):
        for s in good[p + 1 :]:
            if r[2] == s[2] and len(r[1]) == len(s[1]):
                x, y = np.array(r[1]), np.array(s[1])
                if float(x @ y) / math.sqrt(float(x @ x) * float(y @ y)) >= cosine:
                    a, b = index[id(r)], index[id(s)]
                    links[a] += 1
                    links[b] += 1
                    parent[top(a)] = top(b)
    low = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[top(k)] = min(r[0], low.get(top(k), r[0]))
    return Counter((r[0], links[k], low.get(top(k)), r[0] == low.get(top(k))) for k, r in enumerate(rows))


def some_vectors(seed, n, d, clusters, noise):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    rows = [[i, np.float32(centres[rng.integers(clusters) if i % 3 else 0] + noise * rng.normal(size=d)).tolist(), int(rng.integers(2))] for i in range(n)]
    rows += [[n + i, rows[i % 5][1], rows[i % 5][2]] for i in range(30)]  # exact copies, most of few
    rows += [[n + 30, [2 * x for x in rows[1][1]], rows[1][2]], [n + 31, rows[0][1], None], [n + 32, None, 1], [n + 33, [0.0] * d, 1], [n + 34, [float("nan")] + rows[0][1][1:], 0], [n + 35, [None] + rows[0][1][1:], 0], [n + 36, [float("inf")] * d, 0], [n + 37, [], 1], [n + 38, rows[0][1][:-1], rows[0][2]]]
    return [tuple(r) for r in rows] + [tuple(rows[2]), (None, rows[4][1], rows[4][2]), (None, [1.0] + [0.0] * (d - 1), 9), (None, None, 1)]


@pytest.mark.parametrize("bounds", [{}, {"cell": 40, "block": 16, "pivots": 8}, {"cell": 8, "block": 1000, "pivots": 64}, {"cell": 20, "block": 7, "pivots": 1}])
@pytest.mark.parametrize("data", [(1, 300, 3, 6, 0.1), (2, 260, 16, 12, 0.08), (3, 200, 24, 40, 0.5)])
def test_range_join_equals_all_pairs(spark, data, bounds):
    rows = some_vectors(*data)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as cell", "2 as n", "3 as cid").repartition(3)
    got = Counter(map(tuple, range_join.range_join(df, 0.98, **bounds).collect()))
    assert got == plain_range(rows, 0.98)
    assert sum(k[1] for k in got) > 0


def test_range_join_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert range_join.range_join(df).count() == 0


def test_cells_leave_vectors_out_of_far_cells():
    """Clustered vectors visit few cells; none that holds a link is left out."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = range_join.units(pa.array((np.repeat(centres, 50, 0) + 0.03 * rng.normal(size=(2000, 16))).tolist()))
    cells = range_join.Cells({1: range_join.units(pa.array(centres.tolist()))})
    d = range_join.distances(x, cells.pivots[1])
    home = d.argmin(1)
    for c in range(40):
        cells.low[c], cells.high[c] = d[home == c, c].min(), d[home == c, c].max()
    row, cell = cells.visits(1, x, home, 0.2)
    assert len(row) < 0.05 * 2000 * 40
    seen = set(zip(row.tolist(), cell.tolist(), strict=True))
    i, j = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    apart = home[i] != home[j]
    assert all((a if home[a] < home[b] else b, max(home[a], home[b])) in seen for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True))
