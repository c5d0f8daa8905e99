"""Exact n-gram Jaccard join of whole texts by T-occurrence search.

1. One scan turns each text into its set of shingle hashes. Equal sets are one *class* from here on.
2. T-occurrence bound over the corpus. Under one order of all shingles, a set's first
   n - need + l shingles (need: the least overlap that a link asks for) hold at least l that any linked set has among its
   own first ones. So the scan sends only these, as inverted lists dealt by ranges of the hash; the lists count how many
   of a class's are shared, and classes with fewer than l, most of a corpus, are done: they link with nothing.
   Long shingles come first, ties by hash: short ones are of frequent words, and the larger a corpus is, the more of
   its texts share those by chance.
3. Sharding of the classes left. Sets that can be linked differ in at most d shingles, d following from size and
   threshold. Cut the shingle space into d + 1 parts: linked sets agree in at least one part (pigeonhole), so classes
   meet in the shard of that part's content. Sizes are in geometric intervals, and a set also signs for the next lower
   one. A class signs once a task, so a group of copies sends one row a task, whatever its size.
4. Of classes that meet, those pairs go whose parity bitmaps differ in more bits than linked sets can differ in
   shingles (a bound, so no link goes). The rest form candidate clusters; these are cut into blocks of about BLOCK
   classes, and each pair of blocks is one task. Cost within a cluster is quadratic in its *different* near texts.
5. T-occurrence search in each task: inverted lists over the block, each query merging its short lists and
   probing its long ones by binary search (DivideSkip), exact overlap in the end. Texts already joined are
   skipped, so a task returns at most one link a class and never all pairs.
6. Components over those links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodepath.llm import textops as tx
from lodepath.llm.common import cut, drop, ship, table
from lodepath.llm.components import component_table

BLOCK = 512  # classes of a block
VOLUME = 1 << 18  # and shingles: a block has no more than about either
FLUSH = 1 << 20
LOCAL = 1 << 14  # classes of a flush are numbered in 16 bits: it ends from 3 * LOCAL on, and rows come LOCAL at a time, so numbers stay under OFTEN
OFTEN = (1 << 16) - 1  # in place of a class's number: a shingle that several classes of a flush have
MU = 0.5
WORDS = 16  # 64-bit words of a bitmap
PIVOT = 64  # longer runs are connected pivot by pivot
HUGE = 1 << 15  # classes of more than this that share a signature are joined unseen: no link is lost, the search does more


def spare(t: int) -> int:
    """Shingles that a prefix is longer by, in hundredths of the set: the more, the fewer classes are left by chance."""
    return (100 - t) // 2


def prefixes(n: np.ndarray, t: int) -> np.ndarray:
    """Shingles that sets of n shingles send."""
    need = -(-n * t // 100)
    return np.minimum(n, n - need + np.maximum(1, n * spare(t) // 100))


def least_shared(t: int) -> str:
    """SQL: how many of a prefix, of a set of `n` shingles, any linked set's prefix has at least."""
    return f"greatest(1, (cast(n as bigint) * {t} + 99) div 100 * {spare(t)} div 100)"


class Intervals:
    """Size intervals, the most shingles by which linked sets differ, and the number of parts, for similarity of t / 100.

    There are more parts than shingles that may differ, by about as many as a set leaves empty: so linked sets agree
    in a part that isn't empty, unless both have as many empty parts as are spare; such sets sign for empty parts too."""

    def __init__(self, t: int, most: int):
        self.t, lows, parts = t, [1], []
        while lows[-1] <= most:
            high = lows[-1] * 100 // t
            both = high + high * 100 // t
            differ = both * (100 - t) // (100 + t)
            empty = (differ + 1) * np.exp(-lows[-1] / (differ + 1))
            parts.append((differ, differ + 1 + int(np.ceil(1.5 * empty + 3 * np.sqrt(empty)) if empty > 0.01 else 0)))
            lows.append(high + 1)
        self.lows, (self.differ, self.parts) = np.array(lows[:-1]), np.array(parts).T

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, side="right") - 1


def set_keys(rows: int, doc: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row's set."""
    key = np.zeros(rows, tx.U)
    np.add.at(key, doc, tx.mix(x ^ tx.U(0xA5A5A5A55A5A5A5A)))
    return tx.mix(key)


def signatures(rows: int, doc: np.ndarray, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of the parts of every non-empty set, for its own interval and the one below."""
    sizes = np.bincount(doc, minlength=rows)
    some = np.flatnonzero(sizes)
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(0, tx.U)
    steps = Intervals(t, int(sizes.max()))
    own = steps.of(np.maximum(sizes, 1))
    content, place = tx.mix(x ^ tx.U(0x51ED270B0A1F39C1)), tx.mix(x + tx.U(0x2545F4914F6CDD1D))
    out_r, out_s = [], []
    for down in (0, 1):
        inst = own - down
        use = (sizes > 0) & (inst >= 0)
        m = np.where(use, steps.parts[np.maximum(inst, 0)], 0)
        base = np.r_[0, np.cumsum(m)]
        keep = use[doc]
        d = doc[keep]
        part = (place[keep] % m[d].astype(tx.U)).astype(np.int64)
        total = np.zeros(base[-1], tx.U)
        np.add.at(total, base[d] + part, content[keep])
        filled = np.zeros(base[-1], bool)
        filled[base[d] + part] = True
        row = np.repeat(np.arange(rows), m)
        spare = m - np.where(use, steps.differ[np.maximum(inst, 0)], 0)
        bare = np.bincount(row[~filled], minlength=rows) >= spare
        sign = filled | bare[row]
        at = (np.arange(base[-1]) - base[row]).astype(tx.U)
        out_r.append(row[sign])
        out_s.append(tx.mix(total + tx.mix(inst[row].astype(tx.U) * tx.U(1 << 32) + at))[sign])
    return np.concatenate(out_r), np.concatenate(out_s)


def bitmaps(rows: int, doc: np.ndarray, x: np.ndarray) -> np.ndarray:
    """rows x WORDS: each shingle flips one bit, so two bitmaps differ in at most as many bits as their sets in shingles."""
    at = tx.mix(x ^ tx.U(0x3C79AC492BA7B653)) % tx.U(64 * WORDS)
    odd = np.bincount(doc * (64 * WORDS) + at.astype(np.int64), minlength=rows * 64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(rows, -1), axis=1).view(np.uint64)


def scan(k: int, t: int, buckets: int):
    """From (doc_id, text hash, text): rows (a, b, n, f, i, bytes).

    n >= 0: a document (class, doc_id, set size, its class's flush and number there, text hash in `h`); n = -1: an
    inverted list's part (bucket, -, -, flush, -, 32-bit hashes and 16-bit class numbers); n = -2: counts of
    shared shingles of a flush's classes (flush, -, -, flush, -, 32-bit counts and 16-bit class numbers). A flush is named
    by its task and order, so that a task that is run again names it alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, flushes = TaskContext.get().partitionId(), 0
        sent: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        local = size = 0

        def out(a, b, n, f, i, h=None, data=None):
            m = len(a)
            cols = [a, b, n, f, i, h if h is not None else pa.nulls(m, pa.int64()), data if data is not None else pa.nulls(m, pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "n", "f", "i", "h", "data"])

        def flush():
            x, i = (np.concatenate(z) for z in zip(*held, strict=True))
            held.clear()
            order = np.argsort(x, kind="stable")
            x, i = x[order], i[order]
            first = np.r_[True, x[1:] != x[:-1]]
            run = np.cumsum(first) - 1
            often = np.bincount(run)[run] > 1
            yield from counts(np.full(often.sum(), name), i[often], out)
            i = np.where(often, OFTEN, i).astype(np.uint16)[first]
            x = x[first]
            bucket = (x >> tx.U(32)) % tx.U(buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, low, i = bucket[order], x[order].astype(np.uint32), i[order]
            ends = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
            data = pa.array([low[p:q].tobytes() + i[p:q].tobytes() for p, q in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            m, none = len(data), np.zeros(len(data), np.int64)
            yield out(bucket[ends[:-1]].astype(np.int64), none, np.full(m, -1, np.int32), np.full(m, name), none.astype(np.int32), data=data)

        name = task << 32
        for batch in (b.slice(at, LOCAL) for b in batches for at in range(0, len(b), LOCAL)):
            for lo, hi, data, offs in tx.slices(batch.column(2)):
                rows = hi - lo
                doc, starts, ends, h = tx.words(data, offs)
                doc, x, long = tx.sized_shingle_sets(rows, doc, h, k, ends - starts)
                key = set_keys(rows, doc, x)
                n = np.bincount(doc, minlength=rows)
                number = np.full(rows, -1, np.int32)
                for j, v in enumerate(key.tolist()):
                    if n[j] and v not in sent:
                        sent.add(v)
                        number[j] = local
                        local += 1
                if len(sent) > 2_000_000:
                    sent.clear()
                yield out(tx.signed(key), batch.column(0).slice(lo, rows), n.astype(np.int32), np.full(rows, name), number, batch.column(1).slice(lo, rows))
                new = number[doc] >= 0
                d, y = doc[new], tx.mix(x[new] ^ tx.U(0x7F4A7C15F39CC060))
                order = np.lexsort((y, -long[new], d))
                d, y = d[order], y[order]
                head = np.arange(len(d)) - np.searchsorted(d, np.arange(rows))[d] < prefixes(n, t)[d]
                held.append((y[head], number[d[head]]))
                size += int(head.sum())
                if size > FLUSH or local >= 3 * LOCAL:
                    if size:
                        yield from flush()
                    flushes += 1
                    name = (task << 32) + flushes
                    local = size = 0
        if size:
            yield from flush()

    return run


def counts(f: np.ndarray, i: np.ndarray, out) -> Iterator[pa.RecordBatch]:
    """For each flush one row of its classes' counts."""
    if len(f):
        order = np.lexsort((i, f))
        f, i = f[order], i[order]
        heads = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (i[1:] != i[:-1])])
        times, f, i = np.diff(np.r_[heads, len(f)]).astype(np.uint32), f[heads], i[heads].astype(np.uint16)
        ends = np.r_[np.flatnonzero(np.r_[True, f[1:] != f[:-1]]), len(f)]
        data = pa.array([times[p:q].tobytes() + i[p:q].tobytes() for p, q in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        f, none = f[ends[:-1]], np.zeros(len(data), np.int64)
        yield out(f, none, np.full(len(data), -2, np.int32), f, none.astype(np.int32), data=data)


def sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f, i, shared) from count rows (f, data) sorted by f."""
    now, total = None, np.zeros(OFTEN + 1, np.int64)

    def close():
        i = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), now)), pa.array(i.astype(np.int32)), pa.array(total[i])], names=["f", "i", "shared"])

    for batch in batches:
        for f, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if f != now:
                if now is not None:
                    yield close()
                now = f
                total[:] = 0
            m = len(d) // 6
            total[np.frombuffer(d, np.uint16, m, 4 * m)] += np.frombuffer(d, np.uint32, m)
    if now is not None:
        yield close()


def count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From scan()'s rows sorted by a: documents and counts as they are, and counts from the inverted lists of each bucket."""
    held: list[tuple[int, bytes]] = []
    now = None

    def out(a, b, n, f, i, data):
        return pa.RecordBatch.from_arrays([*map(pa.array, (a, b, n, f, i)), pa.nulls(len(a), pa.int64()), data], names=["a", "b", "n", "f", "i", "h", "data"])

    def close():
        parts = [(f, np.frombuffer(d, np.uint32, len(d) // 6), np.frombuffer(d, np.uint16, len(d) // 6, len(d) // 6 * 4)) for f, d in held]
        x = np.concatenate([p[1] for p in parts])
        i = np.concatenate([p[2] for p in parts]).astype(np.int64)
        f = np.repeat(np.array([p[0] for p in parts]), [len(p[1]) for p in parts])
        order = np.argsort(x, kind="stable")
        x, i, f = x[order], i[order], f[order]
        same = x[1:] == x[:-1]
        use = (np.r_[False, same] | np.r_[same, False]) & (i != OFTEN)
        yield from counts(f[use], i[use], out)

    for batch in batches:
        n = batch.column("n").to_numpy()
        yield batch.filter(pa.array(n != -1))
        lists = batch.filter(pa.array(n == -1))
        for a, f, data in zip(lists.column("a").to_pylist(), lists.column("f").to_pylist(), lists.column("data").to_pylist(), strict=True):
            if a != now and held:
                yield from close()
                held = []
            now = a
            held.append((f, data))
    if held:
        yield from close()


def sets_of(k: int):
    """(key, size, bits, grams) of (want, text) where the text's class is the wanted one, each class once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for lo, hi, data, offs in tx.slices(batch.column("text")):
                rows = hi - lo
                doc, _, _, h = tx.words(data, offs)
                doc, x = tx.shingle_sets(rows, doc, h, k)
                key = set_keys(rows, doc, x).view(np.int64)
                n = np.bincount(doc, minlength=rows)
                ends = np.r_[0, np.cumsum(n)]
                at = []
                for i in np.flatnonzero(key == batch.column("want").slice(lo, rows).to_numpy()):
                    if int(key[i]) not in sent:
                        sent.add(int(key[i]))
                        at.append(i)
                if not at:
                    continue
                bits = bitmaps(rows, doc, x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[at]), pa.array(n[at].astype(np.int32)), pa.array([bits[i].tobytes() for i in at], pa.binary()), pa.array([x[ends[i] : ends[i + 1]].tobytes() for i in at], pa.binary())],
                    names=["key", "size", "bits", "grams"],
                )

    return run


def sign(t: int):
    """(sig, key) of the classes' parts, from (key, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            sets = [np.frombuffer(b, tx.U) for b in batch.column(1).to_pylist()]
            lo = 0
            ends = np.cumsum([len(g) for g in sets])
            while lo < len(sets):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + FLUSH, side="right")))
                some = sets[lo:hi]
                r, s = signatures(len(some), np.repeat(np.arange(len(some)), [len(g) for g in some]), np.concatenate(some), t)
                yield pa.RecordBatch.from_arrays([tx.signed(s), pa.array(key[lo:hi][r])], names=["a", "b"])
                lo = hi

    return run


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (sig, key) sorted by sig, the rows of signatures that several have."""
    held = None  # the last row, and whether it is alone in its run so far

    for batch in batches:
        if not len(batch):
            continue
        sig, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        alone = held is None or held[2]
        if held is not None:
            sig, key = np.r_[held[0], sig], np.r_[held[1], key]
        same = sig[1:] == sig[:-1]
        shared = np.r_[False, same] | np.r_[same, False]
        if not alone:
            shared[0] = False  # the held row has gone out already
        held = (sig[-1], key[-1], not (same[-1] if len(same) else not alone))
        if shared.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[shared]), pa.array(key[shared])], names=["a", "b"])


def near_pairs(key: np.ndarray, size: np.ndarray, bits: np.ndarray, run: np.ndarray, t: int) -> np.ndarray:
    """Edges (key, key) that connect, within each run, all pairs that may be linked by size and bitmap."""
    lengths = np.bincount(run)
    out = []
    for c in np.unique(lengths[lengths > 1]):
        rows = np.flatnonzero(lengths[run] == c).reshape(-1, c)  # runs of one length at a time
        if c > PIVOT:
            out.extend(by_pivots(r, size, bits, t) for r in rows)
            continue
        for gap in range(1, c):
            a, b = rows[:, : c - gap].ravel(), rows[:, gap:].ravel()
            fit = may_link(a, b, size, bits, t)
            out.append(np.stack([a[fit], b[fit]], 1))
    e = forest(np.concatenate(out), len(run)) if out else np.zeros((0, 2), np.int64)
    return np.unique(np.stack([key[e[:, 0]], key[e[:, 1]]], 1), axis=0) if len(e) else np.zeros((0, 2), np.int64)


def may_link(a: np.ndarray, b: np.ndarray, size: np.ndarray, bits: np.ndarray, t: int) -> np.ndarray:
    """Which pairs of rows may be linked by their sizes and bitmaps."""
    fit = np.flatnonzero((size[a] * 100 >= t * size[b]) & (size[b] * 100 >= t * size[a]))
    diff = np.bitwise_count(bits[a[fit]] ^ bits[b[fit]]).sum(1, dtype=np.int64)
    out = np.zeros(len(a), bool)
    out[fit[diff * (100 + t) <= (size[a[fit]].astype(np.int64) + size[b[fit]]) * (100 - t)]] = True
    return out


def by_pivots(rows: np.ndarray, size: np.ndarray, bits: np.ndarray, t: int) -> np.ndarray:
    """Edges that connect the rows of one long run: each row is held against those that aren't yet of its component."""
    label, out = np.arange(len(rows)), []
    for p in range(len(rows) - 1):
        rest = np.flatnonzero(label[p + 1 :] != label[p]) + p + 1
        if not len(rest):
            if (label == label[p]).all():
                break
            continue
        hit = rest[may_link(np.full(len(rest), rows[p]), rows[rest], size, bits, t)]
        if len(hit):
            out.append(np.stack([rows[hit], np.full(len(hit), rows[p])], 1))
            label[np.isin(label, label[hit])] = label[p]
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def forest(e: np.ndarray, n: int) -> np.ndarray:
    """Star edges (vertex, least vertex) of the components of edges over n vertices."""
    if not len(e):
        return e
    label = np.arange(n)
    while True:
        low = np.minimum(label[e[:, 0]], label[e[:, 1]])
        new = label.copy()
        np.minimum.at(new, label[e[:, 0]], low)
        np.minimum.at(new, label[e[:, 1]], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    v = np.flatnonzero(label != np.arange(n))
    return np.stack([v, label[v]], 1)


def prune(t: int):
    """From (sig, key, size, bits) sorted by (sig, key): edges between classes that may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        crowd = None  # (signature, first class) of a run too long to hold, whose classes are joined unseen

        def edges(e: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

        def near(table: pa.Table) -> pa.RecordBatch:
            sig = table.column(0).to_numpy()
            bits = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint64).reshape(len(sig), WORDS)
            return edges(near_pairs(table.column(1).to_numpy(), table.column(2).to_numpy(), bits, np.cumsum(np.r_[True, sig[1:] != sig[:-1]]) - 1, t))

        def star(key: np.ndarray) -> pa.RecordBatch:
            return edges(np.stack([key, np.full(len(key), crowd[1])], 1))

        for batch in batches:
            if crowd is not None:
                k = int(np.searchsorted(batch.column(0).to_numpy(), crowd[0], side="right"))
                yield star(batch.column(1).to_numpy()[:k])
                batch = batch.slice(k)
                crowd = crowd if not len(batch) else None
            if not len(batch):
                continue
            sig = batch.column(0).to_numpy()
            last = int(np.searchsorted(sig, sig[-1]))  # where the last run begins: it may go on
            if last or held and held[-1].column(0)[0].as_py() != sig[0]:
                yield near(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
            if sum(map(len, held)) > HUGE:
                key = np.concatenate([h.column(1).to_numpy() for h in held])
                crowd = (int(sig[-1]), int(key[0]))
                yield star(key)
                held = []
        if held:
            yield near(pa.Table.from_batches(held))

    return run


def t_occurrence(sets: list[np.ndarray], query: np.ndarray, index: np.ndarray, t: int) -> list[tuple[int, int]]:
    """Links that join `query` and `index` sets (positions in sets) into components: a spanning forest of all links.

    The sets are sorted arrays. If query and index are the same, each pair is looked at once.
    """
    itself = len(query) == len(index) and bool((query == index).all())
    sizes = np.array([len(s) for s in sets])
    terms = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ptr = np.r_[0, np.cumsum(sizes)]
    doc = np.repeat(np.arange(len(index)), sizes[index])
    term = np.concatenate([terms[ptr[i] : ptr[i + 1]] for i in index])
    order = np.argsort(term, kind="stable")
    posts, starts = doc[order], np.searchsorted(term[order], np.arange(terms.max() + 2))
    label, found = np.arange(len(sets)), []
    for q, x in enumerate(query):
        a = sizes[x]
        open_ = (label[index] != label[x]) & (sizes[index] * 100 >= t * a) & (sizes[index] * t <= a * 100)
        if itself:
            open_[q:] = False
        if not open_.any():
            continue
        mine = terms[ptr[x] : ptr[x + 1]]
        lens = starts[mine + 1] - starts[mine]
        least = -(-t * a // 100)  # overlap with the smallest possible partner
        some = lens > 0
        if some.sum() < least:
            continue
        by = np.argsort(lens, kind="stable")
        long = min(int(least) - 1, int(least / (MU * np.log2(max(2, lens.max())) + 1)))
        short, rest = by[: len(by) - long], by[len(by) - long :]
        short = short[lens[short] > 0]
        n = lens[short]
        flat = np.repeat(starts[mine[short]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        merged = np.sort(posts[flat], kind="stable")  # the lists are sorted runs: a merge, in a heap's order
        heads = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1]][: len(merged)])
        total = np.diff(np.r_[heads, len(merged)])
        cand = merged[heads]
        good = open_[cand] & (total >= least - long)
        cand, total = cand[good], total[good]
        if not len(cand):
            continue
        for z in rest:
            lst = posts[starts[mine[z]] : starts[mine[z] + 1]]
            if len(lst):
                at = np.minimum(np.searchsorted(lst, cand), len(lst) - 1)
                total = total + (lst[at] == cand)
        hit = total * (100 + t) >= t * (a + sizes[index[cand]])
        for y in index[cand[hit]]:
            if label[x] != label[y]:
                found.append((int(x), int(y)))
                lo, hi = sorted((label[x], label[y]))
                label[label == hi] = lo
    return found


def search(t: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["key", "blk"]).sort_values(["blk", "key"], ignore_index=True)
        sets = [np.frombuffer(b, np.uint64) for b in pdf["grams"]]
        blk, key = pdf["blk"].to_numpy(), pdf["key"].to_numpy()
        one, two = pdf["i"].iloc[0], pdf["j"].iloc[0]
        q, ix = (np.flatnonzero(blk == one), np.flatnonzero(blk == two)) if one >= 0 else (np.arange(len(pdf)),) * 2
        pairs = t_occurrence(sets, q, ix, t) if len(q) and len(ix) else []
        return pd.DataFrame({"a": [key[x] for x, _ in pairs], "b": [key[y] for _, y in pairs]}, dtype="int64")

    return run


def ngram_join(docs: DataFrame, k: int = 5, threshold: int = 80, stored: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text, any others).

    Two texts link when 100 * |intersection| >= threshold * |union| of their k-word shingle sets (lower-cased,
    distinct). component_id is the smallest doc_id reachable by links. A null, empty or word-less text has an
    empty set, links with nothing and has its own doc_id. Repeated rows each get a row. A null doc_id is carried;
    it is never a component_id unless all of the component are null. An empty table gives an empty table.

    Inverted lists are named by task and order of rows, so a task that is run again has to meet its rows in the same
    order. Rows of files come so: say stored=True where docs are no more than files read and columns of them. Others
    (after a join, say, or a repartition) are written to the shared folder first.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    docs = docs if stored else cut(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = min(1 << 16, 1 << max(10, int(chars >> 24).bit_length()))  # of lists: so many that one fits in a task's memory
    cols = "a bigint, b bigint, n int, f bigint, i int, h bigint, data binary"
    rows = docs.mapInArrow(scan(k, threshold, buckets), cols)
    spread = F.when(F.col("n") == -1, F.col("a")).otherwise(F.xxhash64("a", "b", "f", "i"))  # copies needn't meet
    met = cut(rows.repartition(parts, spread).sortWithinPartitions("a").mapInArrow(count_shared, cols))
    known = met.where("n >= 0").select(F.col("a").alias("key"), F.col("b").alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"))
    some = met.where("n > 0")
    classes = cut(some.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("rep"), F.min(F.struct(F.col("b").alias("doc_id"), "h")).alias("at")))
    shared = met.where("n = -2").select("f", "data").repartition(parts, "f").sortWithinPartitions("f").mapInArrow(sum_counts, "f bigint, i int, shared bigint")
    alive = cut(some.where("i >= 0").join(shared, ["f", "i"]).where(f"shared >= {least_shared(threshold)}").select(F.col("a").alias("key")).distinct())
    want = classes.join(alive, "key").select(F.col("key").alias("want"), F.col("at.doc_id").alias("id"), F.col("at.h").alias("th"))
    wanted = docs.join(want, docs.doc_id.eqNullSafe(want.id) & (docs.h == want.th)).select("want", "text")
    sets = cut(wanted.mapInArrow(sets_of(k), "key bigint, size int, bits binary, grams binary"))
    signs = sets.select("key", "grams").mapInArrow(sign(threshold), "a bigint, b bigint").repartition(parts, "a").sortWithinPartitions("a").mapInArrow(meet, "a bigint, b bigint")
    small = sets.groupBy("key").agg(F.min("size").alias("size"), F.min("bits").alias("bits"))
    near = signs.join(small, F.col("b") == F.col("key")).select("a", "key", "size", "bits")
    may = near.repartition(parts, "a").sortWithinPartitions("a", "key").mapInArrow(prune(threshold), "a bigint, b bigint")
    cand = component_table(may)
    mine = sets.select("key", "size", "grams").join(cand.withColumnRenamed("v", "key"), "key")
    weight = F.greatest(F.count("*") / BLOCK, F.sum("size") / VOLUME)
    weights = cut(mine.groupBy("root").agg(weight.alias("members")))
    sizes = weights.where("members > 1")
    bins = int(weights.where("members <= 1").agg(F.ceil(F.coalesce(F.sum("members"), F.lit(0.0)))).first()[0]) + 1
    placed = (
        mine.join(sizes, "root", "left")
        .withColumn("nb", F.coalesce(F.expr("cast(ceil(members) as int)"), F.lit(0)))
        .withColumn("blk", F.when(F.col("nb") > 0, F.expr("cast(pmod(xxhash64(key), nb) as int)")).otherwise(-1))
        .withColumn("unit", F.when(F.col("nb") > 0, F.col("root")).otherwise(F.expr(f"pmod(xxhash64(root), {bins})")))
        .withColumn("other", F.explode(F.expr("if(nb > 0, sequence(0, nb - 1), array(-1))")))
        .select("unit", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "key", "grams")
    )
    joined = component_table(placed.groupBy("unit", "i", "j").applyInPandas(search(threshold), "a bigint, b bigint"))
    for done in (sets, cand, weights, alive):
        drop(done)
    named = classes.select("key", "rep").join(joined, classes.key == joined.v, "left").select("key", "rep", F.coalesce("root", "key").alias("group"))
    least = named.groupBy("group").agg(F.min("rep").alias("component_id"))
    named = cut(named.join(least, "group").select(F.col("key").alias("own"), "component_id"))  # one row a class, so copies weigh nothing
    drop(classes)
    drop(joined)
    whole = known.where("n_shingles > 0").join(named, F.col("key") == F.col("own")).select("doc_id", "n_shingles", "component_id")
    return whole.unionAll(known.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity of 0.9 or more, over all documents."""
    return ngram_join(table(spark, sf_dir, "documents"), k=3, threshold=90, stored=True)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS g FROM w
), sets AS (SELECT min(doc_id) AS rep, len(g) AS n, list_sort(g) AS g FROM s WHERE len(g) > 0 GROUP BY list_sort(g), len(g)
), item AS (SELECT rep, n, unnest(g) AS x FROM sets
), pair AS (
  SELECT a.rep AS a, b.rep AS b FROM item a JOIN item b ON a.x = b.x AND a.rep < b.rep AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 190 * count(*) >= 90 * (a.n + b.n)
), edge AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair
), reach(v, r) AS (SELECT rep, rep FROM sets UNION SELECT edge.b, reach.r FROM reach JOIN edge ON edge.a = reach.v
), low AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE low.component_id END AS component_id
FROM s LEFT JOIN sets ON len(s.g) > 0 AND list_sort(s.g) = sets.g LEFT JOIN low ON low.v = sets.rep
"""
