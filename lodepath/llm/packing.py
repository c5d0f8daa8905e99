"""Packing by lexical retrieval: a sharded BM25 index returns unused neighbours of a window's seed document.

Documents are dealt to shards by content: they are sorted by two minima of their words' hashes, which near copies and
related texts share with a chance of their Jaccard similarity, so neither file layout nor partitions decide who stands
beside whom (ties and range borders apart). A shard is a run of about SHARD bytes of that order; its inverted index,
its windows and its output stay in one task, so memory is bounded. Within a shard each window's seed is
the document that opens it (or runs on into it); the best unused neighbours follow until the window is full. What
doesn't fit runs on into the next window. A shard's last window is cut into powers of two, which need no padding.

Tokenising: byte-level BPE never joins text across some borders (piece_starts()), so texts are cut there, each
distinct piece is encoded once, and ids are gathered; the result equals encoding whole texts.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodepath.llm import textops as tx
from lodepath.llm.common import ship, table

SHARD = 1 << 21
WINDOW = 1024
CACHE = 1_500_000
K1, B = 1.2, 0.75
OPEN = np.ones(256, bool)  # bytes after which a space before them opens a piece; lead bytes of Unicode's spaces don't
OPEN[[0x20, *range(0x09, 0x0E), 0xC2, 0xE1, 0xE2, 0xE3]] = False
SPECIAL = b"<|endoftext|>"
OTHER, WORD, PUNCT, BREAK, TAIL = range(5)
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = PUNCT
KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")] = WORD
KIND[0x0A] = BREAK
KIND[0x80:0xC0] = TAIL

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def piece_starts(data: np.ndarray, offs: np.ndarray, special: bytes = SPECIAL) -> np.ndarray:
    """Where a text may be cut without changing its ids; texts' own starts are among them.

    The tokenizer's pattern begins a match at each of these, whatever stands around: a space before a visible
    character; ASCII punctuation after an ASCII or Latin-1 letter or a digit; a line end after a visible ASCII
    character, and what visible character follows such a line end. (Contractions begin with their apostrophe.)
    Elsewhere pieces just stay longer; a text that holds the special token, if there is one, isn't cut.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    kind = KIND[data]
    before, here = kind[:-1], kind[1:]
    letter = (before == WORD) | (before == TAIL) & np.r_[False, data[:-2] == 0xC3] & (data[:-1] != 0x97) & (data[:-1] != 0xB7)
    visible = (before == WORD) | (before == PUNCT)
    one_break = (before == BREAK) & np.r_[False, visible[:-1]]
    cut[1:n] |= (here == PUNCT) & letter | (here == BREAK) & visible | one_break & ((here == WORD) | (here == PUNCT) | (data[1:] == 0xC3))
    cut[: n - 1] |= (data[:-1] == 0x20) & OPEN[data[1:]]
    raw, at = data.tobytes(), -1
    while special and (at := raw.find(special, at + 1)) >= 0:  # such a text is one piece
        row = int(np.searchsorted(offs, at, side="right")) - 1
        cut[offs[row] + 1 : offs[row + 1]] = False
    return np.flatnonzero(cut[:n])


class Encoder:
    """Token ids of texts, from a tokenizer file; each distinct piece is encoded once while it is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.hash, self.at, self.len, self.pool = np.zeros(0, tx.U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, h: np.ndarray, texts: list[str]) -> None:
        """Adds pieces of ascending hash h."""
        ids, lens = [], []
        for lo in range(0, len(texts), 8192):
            part = [e.ids for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 8192], add_special_tokens=False)]
            lens += map(len, part)
            ids.append(np.fromiter(chain.from_iterable(part), np.uint32))
        n = np.array(lens, np.int64)
        at = len(self.pool) + np.cumsum(n) - n
        self.pool = np.concatenate([self.pool, *ids])
        place = np.searchsorted(self.hash, h)
        self.hash, self.at, self.len = np.insert(self.hash, place, h), np.insert(self.at, place, at), np.insert(self.len, place, n)

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each row), without a last id."""
        rows, n = len(offs) - 1, len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        if len(self.hash) > CACHE:
            self._forget()
        starts = piece_starts(data, offs)
        ends = np.r_[starts[1:], n]
        h = tx.spans_hash(data, starts, ends)
        order = np.argsort(h)
        sorted_h = h[order]
        new = np.r_[True, sorted_h[1:] != sorted_h[:-1]]
        keys, first = sorted_h[new], order[new]
        place = np.minimum(np.searchsorted(self.hash, keys), max(len(self.hash) - 1, 0))
        missing = np.flatnonzero(self.hash[place] != keys) if len(self.hash) else np.arange(len(keys))
        if len(missing):
            raw = data.tobytes()
            f = first[missing]
            self._learn(keys[missing], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[f].tolist(), ends[f].tolist(), strict=True)])
            place = np.searchsorted(self.hash, keys)
        which = np.empty(len(h), np.int64)
        which[order] = place[np.cumsum(new) - 1]
        lens = self.len[which]
        to = np.cumsum(lens)
        flat = self.pool[np.repeat(self.at[which] - (to - lens), lens) + np.arange(to[-1])]
        row = np.searchsorted(starts, offs)
        return flat, np.diff(np.r_[0, to][row])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker process's encoder of a file: tasks that run in it one after another share what it remembers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Bm25:
    """An inverted index of a shard: postings of term t are docs[ptr[t]:ptr[t+1]] with their BM25 weights."""

    def __init__(self, rows: int, doc: np.ndarray, h: np.ndarray):
        self.rows = rows
        length = np.bincount(doc, minlength=rows)
        term = np.unique(h, return_inverse=True)[1]
        pair, tf = np.unique(term * rows + doc, return_counts=True)
        t, self.docs = np.divmod(pair, rows)
        df = np.bincount(t)
        idf = np.log(1 + (rows - df + 0.5) / (df + 0.5))
        self.ptr = np.r_[0, np.cumsum(df)]
        norm = K1 * (1 - B + B * length / max(1.0, length.mean()))
        self.weight = idf[t] * tf * (K1 + 1) / (tf + norm[self.docs]) if len(t) else np.zeros(0)
        shared = df[t] > 1
        d, t = self.docs[shared], t[shared]
        order = np.lexsort((t, d))
        self.terms, self.own = t[order], np.searchsorted(d[order], np.arange(rows + 1))

    def scores(self, seed: int) -> np.ndarray:
        """Of all documents against all shared terms of the seed."""
        t = self.terms[self.own[seed] : self.own[seed + 1]]
        if not len(t):
            return np.zeros(self.rows)
        n = self.ptr[t + 1] - self.ptr[t]
        to = np.cumsum(n)
        at = np.repeat(self.ptr[t] - (to - n), n) + np.arange(to[-1])
        return np.bincount(self.docs[at], self.weight[at], minlength=self.rows)


def arranged(index: Bm25, tokens: np.ndarray, window: int) -> np.ndarray:
    """The order of a shard's documents: each window takes its seed's best unused neighbours."""
    n = len(tokens)
    free = np.ones(n, bool)
    out, nxt, total, edge, score = [], 0, 0, window, None
    while len(out) < n:
        pick = -1
        if score is not None:
            left = np.where(free, score, 0)
            best = int(left.argmax())
            pick = best if left[best] > 0 else -1
        seeds = pick < 0  # no seed yet, or none of its neighbours is unused: the next unused document seeds the window
        if seeds:
            while not free[nxt]:
                nxt += 1
            pick = nxt
        out.append(pick)
        free[pick] = False
        total += int(tokens[pick])
        if total >= edge:
            edge = (total // window + 1) * window
            score = index.scores(pick) if total % window else None  # it runs on into the next window, and seeds that
        elif seeds:
            score = index.scores(pick)
    return np.array(out, np.int64)


def sequences(total: int, window: int) -> np.ndarray:
    """Starts of sequences over a shard's stream: full windows, then powers of two."""
    full = total // window
    starts, at = [i * window for i in range(full)], full * window
    bit = window >> 1
    while bit:
        if (total - full * window) & bit:
            starts.append(at)
            at += bit
        bit >>= 1
    return np.array([*starts, total], np.int64)


def pack(path: str, window: int, last_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, data, offs in tx.slices(batch.column(1), SHARD):
                rows = hi - lo
                flat, n = encode(data, offs)
                with_end = np.empty(len(flat) + rows, np.uint32)
                ends = np.cumsum(n + 1) - 1
                inner = np.ones(len(with_end), bool)
                inner[ends] = False
                with_end[inner], with_end[ends] = flat, last_id
                n = n + 1
                begin = ends + 1 - n
                doc, _, _, h = tx.words(data, offs)
                order = arranged(Bm25(rows, doc, h), n, window)
                stop = np.cumsum(n[order])
                seq = sequences(int(stop[-1]), window)
                edges = np.union1d(np.r_[0, stop], seq)
                a, b = edges[:-1], edges[1:]
                which = np.searchsorted(stop, a, side="right")
                d = order[which]
                start = a - (stop[which] - n[d])
                s = np.searchsorted(seq, a, side="right") - 1
                crc = [zlib.crc32(with_end[x : x + m].tobytes()) for x, m in zip((begin[d] + start).tolist(), (b - a).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows).take(pa.array(d)), *map(pa.array, (start, b - a, np.array(crc, np.int64), n[d], serial + s, a - seq[s]))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )
                serial += len(seq) - 1

    return run


def content_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with two minima of their words' hashes; 0 for texts without words."""
    for batch in batches:
        for lo, hi, data, offs in tx.slices(batch.column(1)):
            doc, _, _, h = tx.words(data, offs)
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]][: len(doc)])
            keys = np.zeros((2, hi - lo), tx.U)
            if len(first):
                for k in range(2):
                    keys[k, doc[first]] = np.minimum.reduceat(tx.mix(h ^ tx.U(0x9E3779B97F4A7C15 * (k + 1) & tx.MASK)), first)
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), *map(pa.array, keys.view(np.int64))], names=["doc_id", "text", "a", "b"])


def dealt(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in order of content; a large group of equal keys is split by text and id."""
    order = ["a", "b", F.xxhash64("text"), "doc_id"]
    return docs.mapInArrow(content_keys, "doc_id bigint, text string, a bigint, b bigint").repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")


def packing(docs: DataFrame, tokenizer: str, window: int = WINDOW, last_id: int = 0) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text, any others) in sequences of at most `window` tokens.

    Null and empty texts have the last id alone; repeated rows are packed each; a null doc_id is carried. A text
    longer than a window takes several. sequence_id is unique over the result. `tokenizer` is the path of a
    byte-level BPE file that every executor can read; `window` is a power of two. An empty table gives none.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return dealt(docs).mapInArrow(pack(tokenizer, window, last_id), SCHEMA)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing(table(spark, sf_dir, "documents"), tokenizer_path())
