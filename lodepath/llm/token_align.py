"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, over a corpus.

A text is a run of bytes that both tokenizers cut. Packed bitsets mark the bytes at which a token of A ends, and those
at which one of B ends. Their AND holds the shared cuts, which bound the groups. Two tokens overlap in one run of bytes, and
these runs are what all cuts of both make together, so the OR has one bit for each link; the popcount rank of that
bit in A's and in B's bitset is the number of its token of A and of B. The ranks of the shared cuts give the groups' token ranges.

Over the corpus, links are counted as (text, id pair) once each:

1. A scan aligns the texts and writes, for each, its counts, the digest of its groups, and its distinct id pairs with
   how often each occurs.
2. Pairs are counted over all texts (summed within a task first), and each id of A gets its highest count.
3. The most frequent pairs, at most HOT of them (12 bytes each, so a bounded table), go to every task and answer most links
   in place, so no frequent pair is ever a join key. All other pairs are joined to their counts. Sums by text of both
   parts are the answer. The bar between the two parts is taken from a histogram of counts, not by sorting pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodepath.llm import textops as tx
from lodepath.llm.common import cut, ship, table
from lodepath.llm.packing import Encoder, piece_starts, tokenizer_path

#: An id pair is a * 2**B_BITS + b, a positive 32-bit integer.
B_BITS = 15
HOT = 1 << 18
SLICE = 1 << 20
META = "▁".encode()
U64 = np.uint64

ALIGNED = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<int>, times array<int>"


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters are themselves, others follow from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """Token ids and byte lengths of spaced texts (a space, then the text); a text is cut into pieces that encode on their own.

    Each distinct piece is encoded once while it is remembered, and its tokens' bytes are held against the piece's."""

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.hash, self.at, self.len = np.zeros(0, tx.U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.good, self.pool = np.zeros(0, bool), np.zeros(0, np.int32)

    def starts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def _learn(self, h: np.ndarray, pieces: list[bytes]) -> None:
        ids, lens, good = [], [], []
        for lo in range(0, len(pieces), 8192):
            some = pieces[lo : lo + 8192]
            got = self.encode(some)
            lens += map(len, got)
            ids.append(np.fromiter(chain.from_iterable(got), np.int32))
            good += [b"".join([self.bytes[i] for i in x]) == p for x, p in zip(got, some, strict=True)]
        n = np.array(lens, np.int64)
        at = len(self.pool) + np.cumsum(n) - n
        self.pool = np.concatenate([self.pool, *ids])
        place = np.searchsorted(self.hash, h)
        self.hash, self.at = np.insert(self.hash, place, h), np.insert(self.at, place, at)
        self.len, self.good = np.insert(self.len, place, n), np.insert(self.good, place, good)

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, ids of each text, whether the text's bytes come back) of texts of at least one byte each."""
        if len(self.hash) > 1_000_000:
            self._forget()
        starts = self.starts(data, offs)
        ends = np.r_[starts[1:], len(data)]
        h = tx.spans_hash(data, starts, ends)
        order = np.argsort(h)
        new = np.r_[True, h[order][1:] != h[order][:-1]]
        keys, first = h[order][new], order[new]
        missing = np.flatnonzero(~np.isin(keys, self.hash, assume_unique=True))
        if len(missing):
            raw, f = data.tobytes(), first[missing]
            self._learn(keys[missing], [raw[a:b] for a, b in zip(starts[f].tolist(), ends[f].tolist(), strict=True)])
        which = np.empty(len(h), np.int64)
        which[order] = np.searchsorted(self.hash, keys)[np.cumsum(new) - 1]
        lens = self.len[which]
        to = np.cumsum(lens)
        flat = self.pool[np.repeat(self.at[which] - (to - lens), lens) + np.arange(to[-1])]
        at = np.searchsorted(starts, offs)
        return flat, np.diff(np.r_[0, to][at]), np.minimum.reduceat(self.good[which], at[:-1])


class ByteSide(Side):
    """A byte-level BPE file; strings of special tokens inside texts are plain text."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Encoder(path).tokenizer
        self.tokenizer.encode_special_tokens = True
        of = byte_values()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = {i: bytes(of[c] for c in word) for word, i in vocab.items() if all(c in of for c in word)}
        self.size = np.zeros(1 + max(vocab.values()), np.int64)
        self.size[list(self.bytes)] = [len(b) for b in self.bytes.values()]

    def starts(self, data, offs):
        return piece_starts(data, offs, special=b"")

    def encode(self, pieces):
        return [e.ids for e in self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)]


class PieceSide(Side):
    """A sentencepiece model that puts a space before what it encodes and, but for that, takes texts as they are.

    Where no piece of the vocabulary has a space after another character, merges never cross from a character to a space
    that follows it, so texts are cut there (but not before spaces that end a text); other models encode whole texts. A text that
    holds the model's own sign for a space never comes back as it was, wherever it is cut."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = {i: b"" if self.model.is_control(i) else bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.size = np.array([len(self.bytes[i]) for i in range(len(pieces))], np.int64)
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)

    def starts(self, data, offs):
        n = len(data)
        mark = np.zeros(n + 1, bool)
        mark[offs] = True
        if self.apart:
            space = data == 0x20
            edge = np.flatnonzero(space[1:] & ~space[:-1]) + 1
            solid = np.flatnonzero(~space)
            if len(solid):
                after = solid[np.minimum(np.searchsorted(solid, edge), len(solid) - 1)]  # the first other character behind
                same = np.searchsorted(offs, after, side="right") == np.searchsorted(offs, edge, side="right")
                mark[edge[same & (after > edge)]] = True
        return np.flatnonzero(mark[:n])

    def encode(self, pieces):
        return self.model.encode([p[1:].decode("utf-8", "replace") for p in pieces], num_threads=1)


class Bits:
    """A packed bitset over bytes: bit i is set if a token ends with byte i."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]

    @classmethod
    def of(cls, ends: np.ndarray, n: int) -> Bits:
        flags = np.zeros(-(-n // 64) * 64, np.uint8)
        flags[ends - 1] = 1
        return cls(np.packbits(flags, bitorder="little").view(U64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def select(self) -> np.ndarray:
        """Places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        low = (U64(1) << (at & 63).astype(U64)) - U64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[np.minimum(at >> 6, len(self.words) - 1)] & low)


def digit_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the decimal digits of 0 .. n-1, left-aligned with one place left, number of digits)."""
    width = len(str(max(0, n - 1)))
    size = np.array([len(str(i)) for i in range(n)])
    out = np.zeros((n, width + 1), np.uint8)
    v = np.arange(n)
    for k in range(width):
        some = size > k
        out[some, k] = 48 + v[some] // 10 ** (size[some] - 1 - k) % 10
    return out, size


class Aligner:
    """Links and groups of the tokens of two Sides over a run of texts."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.digits, self.width = digit_table(max(len(a.size), len(b.size)))
        if len(b.size) > 1 << B_BITS or len(a.size) > 1 << 31 - B_BITS:
            raise ValueError(f"vocabularies of at most {1 << 31 - B_BITS} and {1 << B_BITS} ids")

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links of each text; digests; pairs; times; pairs of each text) of texts without nulls."""
        rows = len(offs) - 1
        counts, hashes = np.zeros((4, rows), np.int64), [""] * rows
        none = (counts, hashes, np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(rows, np.int64))
        full = np.flatnonzero(np.diff(offs))
        if not len(full):
            return none
        data, offs = spaced(data, offs, full)
        (ida, na, ok_a), (idb, nb, ok_b) = self.a(data, offs), self.b(data, offs)
        lost = ~(ok_a & ok_b)
        if lost.any():  # those texts have no tokens: the others stand alone
            keep = ~lost
            ida, idb = ida[np.repeat(keep, na)], idb[np.repeat(keep, nb)]
            na, nb, full, sizes = na[keep], nb[keep], full[keep], np.diff(offs)[keep]
            if not len(full):
                return none
            offs = np.r_[0, np.cumsum(sizes)]
        n = int(offs[-1])
        a, b = Bits.of(np.cumsum(self.a.size[ida]), n), Bits.of(np.cumsum(self.b.size[idb]), n)
        cuts, links = (a & b).select(), (a | b).select()
        of = np.searchsorted(offs, links, side="right") - 1
        counts[0, full], counts[1, full] = na, nb
        counts[2, full], counts[3, full] = np.bincount(np.searchsorted(offs, cuts, side="right") - 1, minlength=len(full)), np.bincount(of, minlength=len(full))
        pair = (ida[a.rank(links)].astype(np.int64) << B_BITS) | idb[b.rank(links)]
        key, times = np.unique((of << 31) | pair, return_counts=True)
        n_pairs = np.zeros(rows, np.int64)
        n_pairs[full] = np.bincount(key >> 31, minlength=len(full))
        for d, h in zip(full.tolist(), self.digests(ida, idb, a.rank(cuts) + 1, b.rank(cuts) + 1, np.searchsorted(cuts, offs)), strict=True):
            hashes[d] = h
        return counts, hashes, (key & ((1 << 31) - 1)).astype(np.int32), times.astype(np.int32), n_pairs

    def digests(self, ida, idb, to_a, to_b, group_at) -> Iterator[str]:
        """SHA-256 of each text's groups, written as a1,a2|b1;a3|b2; to_a, to_b: tokens of A and B up to each group's end."""
        na, nb = np.diff(np.r_[0, to_a]), np.diff(np.r_[0, to_b])
        place_a = np.arange(len(ida)) + np.repeat(to_b - nb, na)
        place_b = np.arange(len(idb)) + np.repeat(to_a, nb)
        ids, sep = np.empty(len(ida) + len(idb), np.int64), np.full(len(ida) + len(idb), 44, np.uint8)
        ids[place_a], ids[place_b] = ida, idb
        sep[to_a + to_b - nb - 1], sep[to_a + to_b - 1] = 124, 59
        text, wide = self.digits[ids], self.width[ids]
        text[np.arange(len(ids)), wide] = sep
        flat = text[np.arange(text.shape[1]) <= wide[:, None]].tobytes()
        end = np.r_[0, np.cumsum(wide + 1)][np.r_[0, to_a + to_b][group_at]]
        for lo, hi in zip(end[:-1].tolist(), end[1:].tolist(), strict=True):
            yield hashlib.sha256(memoryview(flat)[lo : hi - 1]).hexdigest()


def spaced(data: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the given rows, none empty, each with a space before it."""
    n = np.diff(offs)[rows] + 1
    to = np.r_[0, np.cumsum(n)]
    out = np.full(to[-1], 0x20, np.uint8)
    own = np.ones(to[-1], bool)
    own[to[:-1]] = False
    out[own] = data  # rows that are left out have no bytes
    return out, to


def align(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            for lo, hi, data, offs in tx.slices(batch.column(2), SLICE):
                aligner = aligner or Aligner(ByteSide(path_a), PieceSide(path_b))
                counts, hashes, pairs, times, n = aligner(data, offs)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(lo, hi - lo) for k in (0, 1)), *map(pa.array, counts), pa.array(hashes, pa.string()), tx.lists(pairs, n), tx.lists(times, n)],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    return run


def counted(pairs: np.ndarray, count: np.ndarray, best: np.ndarray):
    """Sums over each text's pairs that are in the given sorted table; its other pairs are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            rows = len(col)
            doc = np.repeat(np.arange(rows), np.diff(col.offsets.to_numpy()))
            pair, times = col.flatten().to_numpy(), batch.column(2).flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            n_best, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            np.add.at(n_best, doc[hit], times[hit] * best[at[hit]])
            np.add.at(total, doc[hit], times[hit] * count[at[hit]])
            left = np.bincount(doc[~hit], minlength=rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_best), pa.array(total), tx.lists(pair[~hit], left), tx.lists(times[~hit].astype(np.int32), left)],
                names=["row", "n_best", "count_sum", "pairs", "times"],
            )

    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): in how many texts an id pair is linked, and whether no pair of its A id has more."""
    n = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    a = F.shiftright("pair", B_BITS)  # an id of A has at most as many pairs as B has ids
    return n.withColumn("best", (F.col("count") == F.max("count").over(Window.partitionBy(a))).cast("bigint"))


def frequent(counts: DataFrame, most: int) -> int:
    """The least count of which at most `most` pairs have that or more."""
    bin_of = F.floor(F.log2("count") * 8)
    bars = counts.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("count").alias("low"), F.max("count").alias("high")).toPandas().sort_values("bin", ascending=False)
    taken = bars[bars["n"].cumsum() <= most]
    return int(taken["low"].iloc[-1]) if len(taken) else int(bars["high"].max()) + 1 if len(bars) else 1


def token_alignment(docs: DataFrame, byte_bpe: str, piece_bpe: str, hot: int = HOT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs (doc_id, text, any others).

    byte_bpe and piece_bpe are paths of a byte-level BPE file and a sentencepiece model that every executor can read.
    Null and empty texts, and those of which either tokenizer's tokens don't give the bytes back, have zeros and an empty
    digest. Repeated rows are texts of their own: each has a row, and each counts. A null doc_id is carried. An empty
    table gives an empty table. hot: how many of the most frequent pairs may be sent to every task; the result doesn't depend on it.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    aligned = cut(texts.mapInArrow(align(byte_bpe, piece_bpe), ALIGNED))
    counts = cut(pair_counts(aligned))
    bar = frequent(counts, hot)
    top = counts.where(F.col("count") >= bar).toArrow().sort_by("pair")
    part = cut(aligned.select("row", "pairs", "times").mapInArrow(counted(*(top[c].to_numpy() for c in ("pair", "count", "best"))), "row bigint, n_best bigint, count_sum bigint, pairs array<int>, times array<int>"))
    rest = part.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    more = rest.join(counts.where(F.col("count") < bar), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more_sum"))
    sums = part.select("row", "n_best", "count_sum").join(more, "row", "left")
    add = {"n_best": "more_best", "count_sum": "more_sum"}
    sums = sums.select("row", *[(F.col(k) + F.coalesce(v, F.lit(0))).alias(k) for k, v in add.items()])
    return aligned.drop("pairs", "times").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two public tokenizers over all documents."""
    import public_tokenizers

    return token_alignment(table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))
