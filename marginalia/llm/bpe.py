"""Encoding a corpus with a public byte-level BPE vocabulary, by a pair occurrence index.

A text is cut by the vocabulary's pattern; each distinct piece of a partition is encoded once. The pieces that are
new to a worker are laid out in one array of symbols, and an index maps each adjacent pair that has a rank to all
its positions in that array. Ranks are applied in ascending order, each over all its positions, and only the lists of
the neighbouring pairs change. Texts are then put together from their pieces by gathers over flat arrays.

No shuffle: one pass over the texts, an Arrow batch at a time. The vocabulary is a file of about 1 MB; each worker
reads it itself where the path exists on its machine, so that nothing is broadcast.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import ready

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces that a worker keeps before it starts anew; bounds its memory to some 150 MB.
KEEP_PIECES = 400_000
#: Unicode's White_Space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _ranges(kind: str) -> str:
    """The characters whose general category begins with kind, as ranges of a character class."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}" + (f"-\\U{c - 1:08x}" if c - 1 > start else ""))
            start = None
    return "".join(out)


@lru_cache(1)
def pattern() -> re.Pattern:
    """The public pattern of this vocabulary: contractions, words, numbers and other signs, each with a space before."""
    letter, number = _ranges("L"), _ranges("N")
    return re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class Encoder:
    """Encodes texts with one vocabulary file of lines "base64 rank"."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = {r: t for t, r in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.rank = ranks
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.start, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _rank(self, pair: tuple[int, int]) -> int:
        """The rank of a pair's joined bytes, -1 if it has none."""
        r = self.pair_rank.get(pair)
        if r is None:
            if len(self.pair_rank) > 2_000_000:
                self.pair_rank.clear()
            r = self.pair_rank[pair] = self.rank.get(self.token[pair[0]] + self.token[pair[1]], -1)
        return r

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece, all pieces at once by the pair occurrence index."""
        byte, rank_of = self.byte, self._rank
        sym: list[int] = []
        starts = []
        for p in pieces:
            starts.append(len(sym))
            sym.extend(map(byte.__getitem__, p))
            sym.append(-1)  # no pair spans two pieces
        n = len(sym)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        at: dict[int, dict[tuple[int, int], list[int]]] = {}  # rank -> pair -> positions
        for i in range(n - 1):
            a, b = sym[i], sym[i + 1]
            if a >= 0 and b >= 0 and (r := rank_of((a, b))) >= 0:
                at.setdefault(r, {}).setdefault((a, b), []).append(i)
        active = list(at)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            lists = at.pop(r, None)
            if lists is None:
                continue
            # one rank may be reached by several pairs; all their places go from left to right
            places = sorted(chain.from_iterable(lists.values())) if len(lists) > 1 else sorted(next(iter(lists.values())))
            for i in places:
                j = nxt[i]
                if sym[i] < 0 or j >= n or sym[j] < 0 or rank_of((sym[i], sym[j])) != r:
                    continue
                k = nxt[j]
                sym[i], sym[j] = r, -2
                nxt[i] = k
                if k < n:
                    prev[k] = i
                    if sym[k] >= 0 and (x := rank_of((r, sym[k]))) >= 0:
                        self._note(at, active, x, (r, sym[k]), i)
                h = prev[i]
                if h >= 0 and sym[h] >= 0 and (x := rank_of((sym[h], r))) >= 0:
                    self._note(at, active, x, (sym[h], r), h)
        out = []
        for s in starts:
            ids, i = [], s
            while sym[i] != -1:
                ids.append(sym[i])
                i = nxt[i]
            out.append(ids)
        return out

    @staticmethod
    def _note(at, active, rank, pair, place) -> None:
        lists = at.get(rank)
        if lists is None:
            lists = at[rank] = {}
            heapq.heappush(active, rank)
        lists.setdefault(pair, []).append(place)

    def _learn(self, new: Iterable[str]) -> None:
        new = sorted(new)
        ids = self.merge([w.encode("utf-8", "surrogatepass") for w in new])
        base = len(self.place)
        self.place.update(zip(new, range(base, base + len(new)), strict=True))
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(length.sum()))])

    def _pieces(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The place of each piece of all texts in order, and how many pieces each text has."""
        find = pattern().findall
        pieces = [find(t) if t else [] for t in texts]
        count = np.fromiter(map(len, pieces), np.int64, len(pieces))
        words = list(chain.from_iterable(pieces))
        distinct = set(words)
        if len(self.place) + len(distinct) > KEEP_PIECES:
            self.clear()
        new = distinct.difference(self.place)
        if new:
            self._learn(new)
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words)), count

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i are ids[offsets[i]:offsets[i + 1]]; none for an empty or null text."""
        places, count = self._pieces(texts)
        length = self.length[places]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[places] - (ends - length), length) + np.arange(total)]
        ends = np.concatenate([[0], ends])
        return ends[np.concatenate([[0], np.cumsum(count)])], ids

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        places, count = self._pieces(texts)
        ends = np.concatenate([[0], np.cumsum(self.length[places])])
        return np.diff(ends[np.concatenate([[0], np.cumsum(count)])])


_sent: set[tuple[str, str]] = set()


def send(spark: SparkSession, path: str) -> None:
    """Gives every executor the vocabulary file (some 1 MB) where the driver has it; once an application."""
    sc = spark.sparkContext
    if (sc.applicationId, path) not in _sent and os.path.exists(path):
        sc.addFile(path)
        _sent.add((sc.applicationId, path))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """A worker's encoder, kept between its tasks; of the file at the path, or where the machine has none of the one sent."""
    return Encoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


def _slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some 8 MB of text each, so that batches of very long texts stay within memory."""
    sizes = np.cumsum(np.nan_to_num(np.array(pa.compute.binary_length(batch.column(column)).to_pylist(), dtype=float)))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + most_bytes, "right")))
        yield batch.slice(at, end - at)
        at = end


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) for every row: no special tokens, no change to the text, an empty list for an empty or null
    text. Repeated rows each give a row; other columns are not read, so that none can clash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for part in _slices(batch, "text"):
                offsets, ids = enc.encode(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("key"), lists], names=[key, "ids"])

    ready()
    send(docs.sparkSession, vocabulary)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns `keep` and n_tokens of every row; 0 for an empty or null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for part in _slices(batch, "__text"):
                n = enc.counts(part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    ready()
    send(docs.sparkSession, vocabulary)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{schema}, n_tokens long")
