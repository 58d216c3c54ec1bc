"""Near-duplicate texts by signature trees: all pairs whose word-shingle sets have a Jaccard similarity of at least t.

Exact: nothing is sampled and no link is lost. The steps:

1. Each text becomes its set of hashed word shingles. Texts with equal sets form a class; only one of them goes on. Sets are
   many times the size of their texts and don't compress: they are neither written nor sent, but made anew from the texts,
   many texts at once.
2. In how many texts a token (shingle) stands is counted by the first bits of its hash, some five more than it takes to
   number all tokens; what is sent are the sorted differences, compressed. Tokens that agree in them count as one: their
   count is too high, alike in all texts, which costs entries and loses nothing. Some HELD tokens of whole texts are a piece;
   where a piece's tokens are counted, their counts are written down for it, in its order. So a task that makes the piece
   anew reads its own counts and no others.
   The forest: a text enters it once for each of its rare tokens. With tokens ordered from the rarest, two sets
   with similarity t share one among the first n - ceil(t n) + 1 of each; tokens of one text only meet nobody, and a text
   whose shared tokens are fewer than t n enters nowhere. A text travels once to each partition that has some of its
   tokens, with a signature of BITS bits (each shared token sets one). There the entries, in token order, are cut into
   trees of some `TREE` entries, between two tokens.
3. Each tree is bulk-loaded with a fan-out of `FAN`. A node holds the OR of its entries' token bitmaps and of their
   signatures, the range of their sizes, the largest number of shingles that share bits and the largest number of tokens
   that come after an entry's own. The dual traversal of a tree with itself goes down from pairs of nodes to pairs of
   texts and drops a pair of nodes whose sizes can't fit, whose token bitmaps don't meet, or whose largest possible
   overlap, by common bits and by the tokens left, is too small. All candidates come from it.
4. A token with more than `BLOCK` entries is cut into blocks by size, each a tree; pairs of their roots are taken in Spark
   and the traversal goes on from each pair that is left in a task of its own. So no task holds a whole hot group.
5. What is left is checked exactly on the two texts' sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.components import components
from marginalia.session import materialize, ready

WORDS, BITS, BLOCK, TREE, FAN, FRONT = 5, 256, 8192, 4096, 8, 8192
HELD = 4_000_000  # tokens that a task has in hand at a time
CHUNK = 1 << 17  # characters that are looked at together
_BASE = 0x9E3779B97F4A7C15
_LANES = BITS // 64
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


@lru_cache(3)
def _letters(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each code point below most: a random number for its lower case, and whether that is a letter or digit."""
    low = [chr(c).lower() for c in range(most)]
    x = np.array([ord(c[0]) for c in low], np.uint64) + np.uint64(1)
    for factor, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27), (_BASE, 31)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(32)), np.array([c[0].isalnum() for c in low])


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 ** 64."""
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def _words(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of some texts, one after the other, and where each text's begin, with the end; bounds: those of
    the texts among the code points."""
    value, inner = _letters(next(x for x in (0x3000, 0x20000, 0x110000) if codes.max() < x))
    word = inner[codes]
    if len(codes) > 4 * CHUNK and not word.all():  # a long text goes by parts, cut between words
        gaps = np.flatnonzero(~word)
        cuts = np.unique([0, *gaps[np.flatnonzero(np.diff(gaps // CHUNK, prepend=-1))], len(codes)])
        if len(cuts) > 2:
            got = [_words(codes[a:b], np.clip(bounds - a, 0, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]
            return np.concatenate([h for h, _ in got]), sum(begin for _, begin in got)
    start, last = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    at = bounds[(bounds > 0) & (bounds < len(codes))]
    start[at] = word[at]
    last[at - 1] = word[at - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(last) + 1
    up, down = (x[: len(codes)] for x in (_powers(4 * CHUNK) if len(codes) <= 4 * CHUNK else _powers.__wrapped__(len(codes))))
    upto = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(value[codes] * up, out=upto[1:])
    h = (upto[e] - upto[s]) * down[s]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32)), np.searchsorted(s, bounds)


def sets_of(texts: pa.Array, words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `words` words: runs of letters and digits, in lower case."""
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    cuts = np.append(np.flatnonzero(np.diff((ends[:-1] - ends[0]) // CHUNK, prepend=-1)), len(texts))
    out: list[np.ndarray] = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        codes, bounds = data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
        if len(codes) and codes.max() > 127:
            bounds = bounds - np.append(0, np.cumsum((codes & 0xC0) == 0x80))[bounds]
            codes = np.frombuffer(codes.tobytes().decode().encode("utf-32-le"), np.uint32)
            if ((codes == 0x130) | (codes == 0x3A3)).any():  # their lower case is two characters, or depends on the next ones
                low = [x.lower() for x in texts.slice(a, b - a).to_pylist()]
                bounds = np.cumsum([0, *map(len, low)])
                codes = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
        if not len(codes):
            out += [np.empty(0, np.int64)] * (b - a)
            continue
        h, begin = _words(codes, bounds)
        n = max(0, len(h) - words + 1)
        x = np.zeros(n, np.uint64)
        for k in range(words):
            x = (x ^ (h[k : k + n] * _FACTORS[k % len(_FACTORS)])) * np.uint64(0x9FB21C651E98DF25)
            x ^= x >> np.uint64(32)
        x, spans = x.view(np.int64), [(i, max(i, j)) for i, j in zip(begin[:-1].tolist(), (begin[1:] - words + 1).tolist(), strict=True)]
        for i, j in spans:
            x[i:j].sort()
        new = np.append(True, x[1:] != x[:-1])
        new[begin[:-1][begin[:-1] < n]] = True
        out += [x[i:j][new[i:j]] for i, j in spans]
    return out


def shingles(text: str, words: int, _=None) -> np.ndarray:
    return sets_of(pa.array([text]), words)[0]


def signature(hashes: np.ndarray) -> np.ndarray:
    return signatures(hashes, np.zeros(len(hashes), np.int64), 1)[0]


def signatures(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """A row of bytes for each of n texts; text: the number of each hash's text."""
    bits = np.zeros((n, BITS), bool)
    bits[text, (hashes.view(np.uint64) >> np.uint64(20)) % np.uint64(BITS)] = True
    return np.packbits(bits, axis=1)


def _freed(df: DataFrame, name: str) -> DataFrame:
    """materialize(), after which what was shuffled for it is deleted at once; else it stays until the driver collects its garbage."""
    conf, of = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(of)
    conf.set(of, "true")
    try:
        return materialize(df, name)
    finally:
        conf.set(of, before)


def heads(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(key, n, same, th) of each text (key, text, th) with at least `words` words; same is equal for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = sets_of(batch.column(1), words)
            some = pa.array([k for k, x in enumerate(sets) if len(x)], pa.int64())
            if len(some):
                sets = [x for x in sets if len(x)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), pa.array(map(len, sets), pa.int32()), pa.array([xxhash.xxh128_digest(x.tobytes()) for x in sets], pa.binary()), batch.column(2).take(some)], names=["key", "n", "same", "th"])

    ready()
    return texts.select("key", "text", "th").mapInArrow(run, f"key {texts.schema['key'].dataType.simpleString()}, n int, same binary, th long")


def _packed(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes, the lowest first; _unpacked() has them back."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    planes = np.frombuffer(pa.decompress(x[8:], n, "zstd", asbytes=True), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _gathered(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Keys and sets of some texts (key, text) at a time, with some HELD tokens; each text has a set that isn't empty."""
    keys, sets, held = [], [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            keys.append(part.column(0))
            sets += sets_of(part.column(1), words)
            held += sum(map(len, sets[-part.num_rows :]))
            if held >= HELD:
                yield pa.concat_arrays(keys), sets
                keys, sets, held = [], [], 0
    if sets:
        yield pa.concat_arrays(keys), sets


def _pieced(sets: list[np.ndarray]) -> tuple[int, np.ndarray]:
    """A piece's name, which its tokens give, and all its tokens."""
    flat = np.concatenate(sets)
    return xxhash.xxh64_intdigest(flat.tobytes()) >> 1, flat


def shared_tokens(texts: DataFrame, words: int, bits: int, cuts: int) -> DataFrame:
    """(piece, part, df, most): how often the tokens of each piece of texts stand anywhere, by their first bits: 0 for once. They
    are in order of these bits, 2 ** cuts parts by the first of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _gathered(batches, words):
            piece, flat = _pieced(sets)
            fp, k = np.unique(flat.view(np.uint64) >> np.uint64(64 - bits), return_counts=True)
            at = np.searchsorted(fp, np.arange(1, 1 << cuts, dtype=np.uint64) << np.uint64(bits - cuts))
            for part, (x, y) in enumerate(zip(np.split(fp, at), np.split(k, at), strict=True)):
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([part], pa.int32()), pa.array([_packed(np.diff(x, prepend=np.uint64(0)))]), pa.array([_packed(y)])], names=["piece", "part", "fp", "df"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[tuple[int, bytes, bytes]]] = {}
        for batch in batches:
            for piece, part, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got.setdefault(part, []).append((piece, x, y))
        for part in list(got):
            pieces = got.pop(part)
            each = [np.cumsum(_unpacked(x), dtype=np.uint64) for _, x, _ in pieces]
            fp = np.concatenate(each)
            order = np.argsort(fp)
            fp, k = fp[order], np.concatenate([_unpacked(y) for *_, y in pieces])[order]
            new = np.concatenate([[True], fp[1:] != fp[:-1]])
            k = np.add.reduceat(k, np.flatnonzero(new))
            k[k == 1] = 0
            df = np.empty_like(fp)
            df[order] = k[np.cumsum(new) - 1]
            found = np.split(df, np.cumsum([len(x) for x in each[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, *_ in pieces], pa.int64()), pa.array([part] * len(pieces), pa.int32()), pa.array([_packed(x) for x in found], pa.binary()), pa.array([int(x.max()) for x in found], pa.int64())], names=["piece", "part", "df", "most"])

    ready()
    pieces = texts.select("key", "text").mapInArrow(count, "piece long, part int, fp binary, df binary")
    return pieces.repartition("part").mapInArrow(add, "piece long, part int, df binary, most long")


def _counts(files: list[str], piece: int) -> np.ndarray:
    """How often the distinct first bits of a piece's tokens stand, in their order."""
    got: dict[int, bytes] = {}
    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        got |= dict(zip(*(c.to_pylist() for c in pq.read_table(path, columns=["part", "df"], filters=[("piece", "=", piece)], filesystem=system).columns), strict=True))
    return np.concatenate([np.empty(0, np.uint64), *(_unpacked(got[p]) for p in sorted(got))]).astype(np.int64)


def _entered(t: float, words: int, files: dict[int, list[str]], bits: int, buckets: int, hot: bool):
    """Texts' entries. hot: a row for each under a token that stands more than BLOCK times; else a row for each bucket and piece,
    a compressed table of its texts with the entries under their other tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sets in _gathered(batches, words):
            n = np.array([len(x) for x in sets])
            piece, flat = _pieced(sets)
            text = np.repeat(np.arange(len(sets)), n)
            fp = flat.view(np.uint64) >> np.uint64(64 - bits)
            order, df, known = np.argsort(fp), np.zeros(len(flat), np.int64), _counts(files.get(piece, []), piece)
            fp = fp[order]
            nth = np.cumsum(np.concatenate([[0], fp[1:] != fp[:-1]]))
            if len(known) != nth[-1] + 1:
                raise RuntimeError("the texts came in other pieces than they were counted in: similar_classes() takes a written table")
            df[order] = known[nth]
            del fp, order, nth, known
            some = np.flatnonzero(df)
            some = some[np.lexsort((flat[some], df[some], text[some]))]  # each text's shared tokens, from the rarest
            flat, df, text = flat[some], df[some], text[some]
            shared = np.bincount(text, minlength=len(sets))
            begin = np.cumsum(shared) - shared
            at = np.arange(len(text)) - begin[text]
            # its rarest tokens, up to where another text of its size or less may share the first one
            long = shared - np.ceil(t * n - 1e-9).astype(np.int64) + 1
            sig = signatures(flat, text, len(sets))
            keep = np.flatnonzero((at < long[text]) & ((df > BLOCK) == hot))
            flat, text, rest = flat[keep], text[keep], (shared[text] - at - 1)[keep].astype(np.int32)
            sh = flat if hot else flat.astype(np.int32)  # half of the hash: tokens that agree in it cost a look
            if hot:
                if len(text):
                    yield from _entries(keys, n, shared, sig, text, [pa.array(sh), pa.array(rest)]).to_batches(10_000)
                continue
            bucket = (sh.view(np.uint32) >> np.uint32(8)) % np.uint32(buckets)
            order = np.lexsort((text, bucket))
            sh, text, rest, bucket = sh[order], text[order], rest[order], bucket[order].astype(np.int32)
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(text))
            for low, high in zip(cuts, cuts[1:], strict=False):
                whose = text[low:high]
                first = np.flatnonzero(np.diff(whose, prepend=-1))
                ends = pa.array(np.append(first, high - low), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[low:high])) for x in (sh, rest)]
                yield pa.RecordBatch.from_arrays([pa.array([bucket[low]], pa.int32()), pa.array([_table(_entries(keys, n, shared, sig, whose[first], lists))])], names=["bucket", "entries"])

    return run


def _entries(keys: pa.Array, n: np.ndarray, shared: np.ndarray, sig: np.ndarray, whose: np.ndarray, entries: list[pa.Array]) -> pa.Table:
    """Entries with what belongs to their texts; whose: the numbers of these."""
    ends = np.arange(len(whose) + 1, dtype=np.int32) * sig.shape[1]
    sigs = pa.BinaryArray.from_buffers(pa.binary(), len(whose), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(sig[whose]))])
    return pa.Table.from_arrays([keys.take(pa.array(whose)), pa.array(n[whose], pa.int32()), pa.array(shared[whose], pa.int32()), sigs, *entries], names=["key", "n", "shared", "sig", "sh", "rest"])


def _table(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def _lanes(sig: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sig.to_pylist()), np.uint64).reshape(-1, _LANES)


class _Texts:
    """Columns of some entries of texts under tokens: key, size, how many of the text's shared tokens come after the
    entry's, signature, how many tokens the signature is of (all, if not given)."""

    def __init__(self, key, n, rest, sig, shared=None):
        self.key, self.n, self.rest, self.sig = key, n, rest, sig
        self.excess = (n if shared is None else shared) - np.bitwise_count(sig).sum(1).astype(np.int64)

    @classmethod
    def of(cls, key: pa.Array, n: pa.Array, rest: pa.Array, sig: pa.Array, shared: pa.Array) -> _Texts:
        n, rest, shared = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (n, rest, shared))
        return cls(key.to_numpy(zero_copy_only=False), n, rest, _lanes(sig), shared)


class _Tree:
    """A signature tree over some entries in a given order: levels of nodes, from the entries up to one root.

    A node i covers the nodes FAN i to FAN i + FAN - 1 of the level below."""

    def __init__(self, x: _Texts, entries: np.ndarray, token: np.ndarray):
        """token: the number of each entry's token, counted within the tree; it sets one bit of the token bitmap."""
        self.entries, self.token = entries, token
        words = np.zeros((len(entries), _LANES), np.uint64)
        bit = token % BITS
        words[np.arange(len(entries)), bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
        n = x.n[entries]
        self.levels = [(words, x.sig[entries], n, n, x.excess[entries], x.rest[entries])]
        while len(self.levels[-1][2]) > 1:
            self.grow()

    def grow(self) -> None:
        """One level more; above the root it is the root again."""
        tok, sig, low, high, excess, rest = self.levels[-1]
        at = np.arange(0, len(low), FAN)
        self.levels.append((np.bitwise_or.reduceat(tok, at), np.bitwise_or.reduceat(sig, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at), np.maximum.reduceat(rest, at)))


def _meet(a: tuple, b: tuple, p: np.ndarray, q: np.ndarray, t: float, counts: dict[str, int] | None) -> np.ndarray:
    """The places of the pairs (p, q) of nodes of two levels under which two texts may be similar, by the nodes' bounds."""
    (ta, sa, la, ha, ea, ra), (tb, sb, lb, hb, eb, rb) = a, b
    sized = np.flatnonzero((ha[p] >= t * lb[q] - 1e-9) & (hb[q] >= t * la[p] - 1e-9))
    met = sized[(ta[p[sized]] & tb[q[sized]]).any(1)]
    i, j = p[met], q[met]
    # two texts share no more than common bits and shingles that share bits allow; nor, if the token is the first they share, than come after it
    overlap = np.minimum(np.bitwise_count(sa[i] & sb[j]).sum(1) + np.minimum(ea[i], eb[j]), 1 + np.minimum(ra[i], rb[j]))
    fit = met[overlap >= t / (1 + t) * (la[i] + lb[j]) - 1e-9]
    if counts is not None:
        for name, k in (("visited", len(p)), ("by_size", len(p) - len(sized)), ("by_tokens", len(sized) - len(met)), ("by_overlap", len(met) - len(fit))):
            counts[name] = counts.get(name, 0) + k
    return fit


def traverse(x: _Texts, a: _Tree, b: _Tree | None, t: float, counts: dict[str, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal of two trees, or of one with itself: the pairs of entries whose texts may be similar.

    counts, if given, gets the number of node pairs visited and of those dropped by each bound."""
    own, b = b is None, b or a
    while len(a.levels) != len(b.levels):
        min(a, b, key=lambda x: len(x.levels)).grow()
    stack = [(len(a.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    grid, step = np.arange(FAN * FAN), max(1, FRONT // (FAN * FAN))
    while stack:
        level, p, q = stack.pop()
        if own and level == 0:
            p, q = p[p < q], q[p < q]
        fit = _meet(a.levels[level], b.levels[level], p, q, t, counts)
        p, q = p[fit], q[fit]
        if not level:
            same = a.token[p] == b.token[q]
            yield a.entries[p[same]], b.entries[q[same]]
            continue
        for k in range(0, len(p), step):
            down = (p[k : k + step, None] * FAN + grid // FAN).ravel()
            right = (q[k : k + step, None] * FAN + grid % FAN).ravel()
            keep = (down < len(a.levels[level - 1][2])) & (right < len(b.levels[level - 1][2]))
            if own:
                keep &= down <= right
            stack.append((level - 1, down[keep], right[keep]))


def _inside(t: float):
    """Candidate pairs of a partition's entries: trees that whole tokens share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [pa.ipc.open_stream(x.as_buffer()).read_all() for batch in batches for x in batch.column(1)]
        if not got:
            return
        rows = pa.concat_tables(got).combine_chunks()
        del got
        key, n, shared, sig, sh, rest = (rows.column(c).chunk(0) for c in ("key", "n", "shared", "sig", "sh", "rest"))
        kind, text = key.type, np.repeat(np.arange(len(key)), sh.value_lengths().to_numpy())
        key, n, shared, sig, sh, rest = key.to_numpy(zero_copy_only=False), n.to_numpy().astype(np.int64), shared.to_numpy().astype(np.int64), _lanes(sig), sh.flatten().to_numpy(), rest.flatten().to_numpy()
        order = np.lexsort((n[text], sh))
        sh = sh[order]
        new = np.concatenate([[True], sh[1:] != sh[:-1]])
        meet = ~(new & np.append(new[1:], True))  # the others are alone under their token
        order, new = order[meet], new[meet]
        text, rest, token = text[order], rest[order].astype(np.int64), np.cumsum(new)
        first = np.flatnonzero(new)
        cuts = first[np.flatnonzero(np.diff(first // TREE, prepend=-1))]
        for low, high in zip(cuts, np.append(cuts[1:], len(text)), strict=True):
            e = text[low:high]
            x = _Texts(key[e], n[e], rest[low:high], sig[e], shared[e])
            yield from _emit(x, traverse(x, _Tree(x, np.arange(high - low), token[low:high] - token[low]), None, t), kind)

    return run


def _across(t: float):
    """Candidate pairs of entries sorted by (sh, pb, qb), two blocks of a hot token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            rest.append(batch)
            held += batch.num_rows
            if held < 2 * TREE:
                continue
            whole = pa.Table.from_batches(rest).combine_chunks()
            cuts = starts(whole)
            if len(cuts) < 2:
                continue
            yield from cells(whole.slice(0, cuts[-1]), cuts)
            rest = whole.slice(cuts[-1]).to_batches()
            held = sum(r.num_rows for r in rest)
        if rest:
            whole = pa.Table.from_batches(rest).combine_chunks()
            yield from cells(whole, np.append(starts(whole), whole.num_rows))

    def starts(rows: pa.Table) -> np.ndarray:
        sh, pb, qb = (rows.column(c).to_numpy() for c in ("sh", "pb", "qb"))
        return np.flatnonzero(np.concatenate([[True], (sh[1:] != sh[:-1]) | (pb[1:] != pb[:-1]) | (qb[1:] != qb[:-1])])[: len(sh)])

    def cells(rows: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """cuts: where the cells of rows begin, and their end."""
        x = _Texts.of(*(rows.column(c).combine_chunks() if rows.column(c).num_chunks != 1 else rows.column(c).chunk(0) for c in ("key", "n", "rest", "sig", "shared")))
        pb, qb, side = (rows.column(c).to_numpy() for c in ("pb", "qb", "side"))
        kind = rows.schema.field("key").type
        for c in range(len(cuts) - 1):
            entries = np.arange(cuts[c], cuts[c + 1])
            entries = entries[np.lexsort((x.sig[entries, 0], x.n[entries]))]
            one = lambda e: _Tree(x, e, np.zeros(len(e), np.int64))
            if pb[cuts[c]] == qb[cuts[c]]:
                yield from _emit(x, traverse(x, one(entries), None, t), kind)
            elif 0 < side[entries].sum() < len(entries):
                yield from _emit(x, traverse(x, one(entries[side[entries] == 0]), one(entries[side[entries] == 1]), t), kind)

    return run


def _emit(x: _Texts, pairs: Iterator[tuple[np.ndarray, np.ndarray]], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for a, b in pairs:
        if len(a):
            a, b = x.key[a], x.key[b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), kind), pa.array(np.maximum(a, b), kind)], names=["a", "b"])


def _bits(sig: str) -> list:
    """A signature's bits as longs, for OR and AND in Spark."""
    return [F.conv(F.hex(F.substring(sig, 8 * i + 1, 8)), 16, -10).cast("long").alias(f"b{i}") for i in range(_LANES)]


def _similarities(t: float, words: int):
    """(a, b, similarity) of pairs (a, b, one, two) of texts, where it is t or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, which = [], []
            for key, text in ((0, 2), (1, 3)):
                code = batch.column(key).dictionary_encode().indices.to_numpy()
                sets.append(sets_of(batch.column(text).take(pa.array(np.unique(code, return_index=True)[1])), words))
                which.append(code.tolist())
            at, values = [], []
            for i, (a, b) in enumerate(zip(*which, strict=True)):
                p, q = sets[0][a], sets[1][b]
                both = np.concatenate((p, q))
                both.sort()
                o = np.count_nonzero(both[1:] == both[:-1])
                if o / (len(p) + len(q) - o) >= t - 1e-12:
                    at.append(i)
                    values.append(o / (len(p) + len(q) - o))
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(values)], names=["a", "b", "similarity"])

    return run


def similar_classes(texts: DataFrame, t: float, words: int = WORDS) -> DataFrame:
    """(a, b, similarity) for the keys of different sets with similarity >= t; texts: (key, n, text), one row a set, a
    written table, as it is read twice in the same pieces."""
    ready()
    kind = texts.schema["key"].dataType.simpleString()
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits, cuts = min(60, max(32, (texts.agg(F.sum("n")).first()[0] or 0).bit_length() + 5)), min(20, parts.bit_length())
    shared = _freed(shared_tokens(texts, words, bits, cuts).repartition(parts, "piece").sortWithinPartitions("piece", "part"), "shared-tokens")
    most, files = 0, {}
    for r in shared.groupBy("piece", F.input_file_name().alias("file")).agg(F.max("most").alias("most")).collect():  # a row a piece
        most = max(most, r.most)
        files.setdefault(r.piece, []).append(r.file)
    entered = lambda hot, out: texts.select("key", "text").mapInArrow(_entered(t, words, files, bits, parts, hot), out)
    out = f"a {kind}, b {kind}"
    maybe = entered(False, "bucket int, entries binary").repartition(parts, "bucket").mapInArrow(_inside(t), out)
    if most > BLOCK:
        maybe = maybe.unionByName(_hot(entered(True, f"key {kind}, n int, shared int, sig binary, sh long, rest int"), t, out))
    one, two = texts.select(F.col("key").alias("a"), F.col("text").alias("one")), texts.select(F.col("key").alias("b"), F.col("text").alias("two"))
    maybe = _freed(maybe.where("a < b").distinct(), "candidates")
    both = maybe.join(one, "a").join(two, "b").select("a", "b", "one", "two")
    return both.mapInArrow(_similarities(t, words), f"{out}, similarity double")


def _hot(hot: DataFrame, t: float, out: str) -> DataFrame:
    """Candidate pairs from the entries (sh, key, n, shared, rest, sig) under hot tokens."""
    entry = ["key", "n", "shared", "rest", "sig"]
    # a hot token's blocks: by size class, and by the key where a class has more than BLOCK entries
    grade = F.floor(F.log("n") / F.lit(log(4 / 3))).cast("int")
    hot = hot.withColumn("grade", grade)
    room = hot.groupBy("sh", "grade").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))
    hot = hot.join(room, ["sh", "grade"]).withColumn("block", F.col("grade") * 65_536 + F.pmod(F.xxhash64("key"), "parts").cast("int")).select("sh", "block", *entry)
    nodes = hot.select("sh", "block", "n", "shared", *_bits("sig")).groupBy("sh", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("shared") - sum(F.bit_count(F.col(f"b{i}")) for i in range(_LANES))).alias("excess"), *(F.bit_or(f"b{i}").alias(f"b{i}") for i in range(_LANES)))
    p, q = nodes.alias("p"), nodes.alias("q")
    common = sum(F.bit_count(F.col(f"p.b{i}").bitwiseAND(F.col(f"q.b{i}"))) for i in range(_LANES)) + F.least("p.excess", "q.excess")
    fits = (F.col("p.high") >= t * F.col("q.low")) & (F.col("q.high") >= t * F.col("p.low")) & (common >= t / (1 + t) * (F.col("p.low") + F.col("q.low")) - 1e-9)
    cells = p.join(q, (F.col("p.sh") == F.col("q.sh")) & (F.col("p.block") <= F.col("q.block")) & fits).select(F.col("p.sh").alias("sh"), F.col("p.block").alias("pb"), F.col("q.block").alias("qb"))
    sides = cells.select("*", F.col("pb").alias("block"), F.lit(0).alias("side")).unionByName(cells.where("pb < qb").select("*", F.col("qb").alias("block"), F.lit(1).alias("side")))
    crowd = sides.join(hot, ["sh", "block"]).select("sh", "pb", "qb", "side", *entry)
    return crowd.repartition("sh", "pb", "qb").sortWithinPartitions("sh", "pb", "qb").mapInArrow(_across(t), out)


def classes(texts: DataFrame, key: str = "note_id", text: str = "body", words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(texts, members): one row (key, n, text) per distinct shingle set, under the least key that has it, and (class, key) of
    every text.

    Null texts and those under `words` words are in no class. Rows that repeat a key count once: of texts under one
    key the first in order of set and size stands."""
    some = texts.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    once = _freed(heads(some, words), "heads").groupBy("key").agg(F.min(F.struct("same", "n", "th")).alias("x")).select("key", "x.*")
    members = once.join(once.groupBy("same").agg(F.min("key").alias("class")), "same").select("class", "key", "n", "th")
    reps = members.where(F.col("class") == F.col("key")).select("key", "n", "th")
    one = some.join(reps, ["key", "th"]).dropDuplicates(["key", "th"]).select("key", "n", "text")
    return _freed(one, "class-texts"), _freed(members.select("class", "key"), "class-members")


def near_duplicates(texts: DataFrame, key: str = "note_id", text: str = "body", t: float = 0.5, words: int = WORDS, expand: int = 256) -> DataFrame:
    """(a, b, similarity), a < b: pairs of keys whose shingle sets have a similarity of at least t.

    A class of up to `expand` texts with equal sets gives all its pairs, within and with other classes. Of a larger one
    each text is linked to the class's least key, and only that key to other classes; together with the membership this
    is the whole relation without its square. Empty input gives no rows; other columns are not read."""
    one, members = classes(texts, key, text, words)
    size = members.groupBy("class").agg(F.count("*").alias("size"))
    large = size.where(F.col("size") > expand).select("class")
    acting = members.join(large, "class", "left_anti").unionByName(large.select("class", F.col("class").alias("key")))
    pairs = similar_classes(one, t, words)
    left, right = acting.select(F.col("class").alias("a"), F.col("key").alias("ka")), acting.select(F.col("class").alias("b"), F.col("key").alias("kb"))
    other = pairs.join(left, "a").join(right, "b").select("ka", "kb", "similarity")
    some = size.where((F.col("size") > 1) & (F.col("size") <= expand)).select("class")
    small = members.join(some, "class", "left_semi")
    inside = small.select("class", F.col("key").alias("ka")).join(small.select("class", F.col("key").alias("kb")), "class").where("ka < kb").select("ka", "kb", F.lit(1.0).alias("similarity"))
    star = members.join(large, "class", "left_semi").where("class < key").select(F.col("class").alias("ka"), F.col("key").alias("kb"), F.lit(1.0).alias("similarity"))
    return other.unionByName(inside).unionByName(star).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "similarity")


def groups(texts: DataFrame, key: str = "note_id", text: str = "body", t: float = 0.8, words: int = WORDS) -> DataFrame:
    """(key, class, group, n_links): one row per text with at least `words` words. class is the least key with an equal
    shingle set, group the least key of the connected component, n_links the number of other classes it is linked to.

    Links run between classes, so that copies, however many, add rows and no links."""
    one, members = classes(texts, key, text, words)
    pairs = _freed(similar_classes(one, t, words), "class-pairs")
    both = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a")))
    links = both.groupBy(F.col("a").alias("class")).agg(F.count("*").alias("n_links"))
    found = components(pairs).select(F.col("key").alias("class"), "group")
    out = members.join(links, "class", "left").join(found, "class", "left")
    return out.select(F.col("key").alias(key), "class", F.coalesce("group", "class").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
