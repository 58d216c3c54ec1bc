"""The k most similar vectors of every vector, by shifted Hilbert curves.

Vectors are scaled to length 1 and, for each of several curves, projected on a few random orthogonal directions, shifted
and put in Hilbert order: one range partitioning by (curve, place, key) of ids alone numbers every vector on every curve.
The numbers cut the curves into stretches of `STRETCH` vectors; a stretch also gets the `window` vectors that follow it,
so no window ends at a cut. A task compares each vector of its stretch with the `window` next ones by block products; the
result serves both sides of a pair, and the best k stand for each. Keys go `FINE` bits a dimension below the curve's
cells, so that many vectors in one cell lie in another order on each curve. The curves' results are merged and the k
best stand, by the exact cosine in double precision.

The work grows as vectors x curves x window: no pair of the whole collection is formed. Vectors that are equal up to
scale are one point on the curves however many rows they fill, and are put back at the end, each row with the k rows
of lowest id. The centre and spread for the projections come from a bounded sample (`sample` vectors); every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.session import materialize, ready

CURVES, DIMS, BITS, FINE, WINDOW, SAMPLE, STRETCH, PART, SEED = 14, 10, 3, 13, 2048, 4096, 16_384, 262_144, 20240607
#: Pairs whose exact cosines are computed at once; candidates a vector from which the best are told apart first.
SLICE, CROWD = 65_536, 64
#: Rows of a block product; pairs a task holds before it keeps the best k of each vector.
BLOCK, HELD = 512, 2_000_000
_GRID = np.array([-40.0, *(NormalDist().inv_cdf((i + 0.5) / 4096) for i in range(4096)), 40.0])
_QUANTILES = np.array([0.0, *((i + 0.5) / 4096 for i in range(4096)), 1.0])


def _transposed(cells: np.ndarray, bits: int) -> np.ndarray:
    """dims x n integers whose bits, the highest of all dimensions first, are the places on the Hilbert curve, after Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    return x ^ t


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cells (n x dims integers under 2**bits)."""
    x = _transposed(cells, bits)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> b) & 1)
    return key


def hilbert_bytes(cells: np.ndarray, bits: int) -> np.ndarray:
    """hilbert_keys of any number of bits, as n rows of bytes that compare alike; fewer bits give a prefix."""
    x = _transposed(cells, bits)
    each = [((x >> b) & 1).astype(np.uint8).T for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(each, axis=1), axis=1)


class Curves:
    """Random projections and shifts of several Hilbert curves, fitted to the centre and spread of a sample."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, bits: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        self.bits = bits
        self.centre = sample.mean(0)
        self.axes = [np.linalg.qr(rng.standard_normal((width, min(dims, width))))[0] for _ in range(curves)]
        self.spread = [np.maximum((sample - self.centre).dot(a).std(0), 1e-9) for a in self.axes]
        self.shift = [rng.uniform(0, 1 / (1 << bits), a.shape[1]) for a in self.axes]

    def keys(self, x: np.ndarray) -> np.ndarray:
        """n x curves x bytes: keys of unit vectors, FINE bits a dimension longer than the cells."""
        out, most, last = [], 1 << (self.bits + FINE), 1 - 1 / (1 << self.bits)
        for axes, spread, shift in zip(self.axes, self.spread, self.shift, strict=True):
            at = np.interp((x - self.centre).dot(axes) / spread, _GRID, _QUANTILES) + shift
            # what the shift moves past the end stays in the last cell, in its order
            at = np.where(at > last, last + (at - last) * (1 - last) / (1 - last + shift), at)
            cells = np.clip(np.floor(at * most).astype(np.int64), 0, most - 1)
            out.append(hilbert_bytes(cells, self.bits + FINE))
        return np.stack(out, axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _bytes(rows: np.ndarray) -> pa.Array:
    """Rows of equal length as binary values, without a copy of each."""
    size = rows.shape[1] * rows.itemsize
    ends = pa.array(np.arange(0, len(rows) * size + 1, size), pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(rows))])


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """The float rows of binary values that are all of one length."""
    if not len(column):
        return np.empty((0, width), np.float32)
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], "<f4", len(column) * width, int(ends[0])).reshape(-1, width)


def clean(chunks: DataFrame, key: str, vec: str, width: int) -> DataFrame:
    """(key, vec, point) of the vectors of `width` finite numbers that are not all zero, each key once; vec as bytes.

    point is equal for vectors that agree in five decimals once scaled to length 1. Of rows that share a key the one with
    the least bytes stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            x = _matrix(b.column(1), width).astype(np.float64)
            size = np.abs(x).max(1, initial=0)
            keep = np.isfinite(x).all(1) & (size > 0)
            x, raw = x[keep], _matrix(b.column(1), width)[keep]
            x = x / size[keep, None]
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            grid = np.round(unit * 1e5).astype(np.int32)
            point = [xxhash.xxh128_digest(r.tobytes()) for r in grid]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), _bytes(raw.astype("<f4")), pa.array(point, pa.binary())], names=["key", "vec", "point"])

    ready()
    kind = chunks.schema[key].dataType.simpleString()
    fit = chunks.where(F.col(key).isNotNull() & (F.size(vec) == width) & ~F.exists(vec, lambda x: x.isNull())).select(F.col(key).alias("key"), F.col(vec).cast("array<float>").alias("vec"))
    return fit.mapInArrow(run, f"key {kind}, vec binary, point binary").groupBy("key").agg(F.min(F.struct("vec", "point")).alias("x")).select("key", "x.vec", "x.point")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each sorted row's partition and its place there."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(at, at + n), pa.int64())], names=["curve", "key", "part", "at"])
        at += n


def _units(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pairs(x: np.ndarray, ids: np.ndarray, own: int, k: int, window: int, least: float, block: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cos): for each place a its best k among the places at most `window`, or some more, away, where the
    earlier of the two is one of the first `own`; no more than `most` pairs and a block's are held at once."""
    short = x.astype(np.float32)
    held = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    count = 0

    def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, cos = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((ids[b], -cos, a))
        a, b, cos = a[order], b[order], cos[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, int)
        keep = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a)))) < k
        return a[keep], b[keep], cos[keep]

    for i in range(0, own, block):
        end, high = min(i + block, own), min(len(x), i + block + window)
        near = short[i:end] @ short[i:high].T
        good = near >= least - 1e-4
        if np.count_nonzero(good) > CROWD * len(near) and near.shape[1] > k + 1:
            # of a crowd, only those that may be among the best k of either side besides itself: single precision is off by less than 1e-5
            low = np.partition(near, -k - 1, axis=1)[:, -k - 1, None] - 2e-5
            some = near >= low
            if len(near) > k + 1:
                some |= near >= np.partition(near, -k - 1, axis=0)[-k - 1] - 2e-5
            else:
                some[:] = True
            good &= some
        a, b = np.divmod(np.flatnonzero(good.ravel()), near.shape[1])
        keep = a < b
        a, b = a[keep] + i, b[keep] + i
        cos = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", x[a[j : j + SLICE]], x[b[j : j + SLICE]]) for j in range(0, len(a), SLICE))])
        cos = np.round(cos, 12)
        keep = cos >= least
        a, b, cos = a[keep], b[keep], cos[keep]
        held += [(a, b, cos), (b, a, cos)]
        count += 2 * len(a)
        if count > most:
            held = [best()]
            count = len(held[0][0])
    return best()


def _search(width: int, k: int, window: int, least: float, stretch: int, block: int, most: int):
    """The best k of each vector on the curves of a stretch; rows (to, g, curve, key, vec) come sorted by to and g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            to = batch.column(0).to_numpy()
            cuts = np.flatnonzero(to[1:] != to[:-1]) + 1
            if rest and batch.num_rows and rest[-1].column(0)[0].as_py() != to[0]:
                yield from one(rest)
                rest = []
            at = 0
            for c in cuts.tolist():
                yield from one([*rest, batch.slice(at, c - at)])
                rest, at = [], c
            if at < batch.num_rows:
                rest.append(batch.slice(at))
        if rest:
            yield from one(rest)

    def one(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(got).combine_chunks()
        kind = rows.schema.field("key").type
        to, g, curve, key = (rows.column(c).to_numpy() for c in ("to", "g", "curve", "key"))
        raw = _vectors(rows.column("vec").chunk(0), width)
        for c in np.unique(curve):
            of = np.flatnonzero(curve == c)
            of = of[np.argsort(g[of])]
            ids = key[of]
            a, b, cos = _pairs(_units(raw[of]), ids, int((g[of] // stretch == to[of]).sum()), k, window, least, block, most)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a], kind), pa.array(ids[b], kind), pa.array(cos, pa.float64())], names=["a", "b", "cos"])

    return run


def nearest(chunks: DataFrame, key: str = "chunk_id", vec: str = "vec", k: int = 5, least: float = 0.8, width: int = 96, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, window: int = WINDOW, sample: int = SAMPLE) -> DataFrame:
    """(a, b, cos, rank): the k vectors of highest cosine to each vector a, of at least `least`; ties go to the lower key.

    Vectors that are null, of another length, zero, or hold a null or a number that is not finite take no part, neither
    does a null key. Rows that repeat a key count once. A lone vector gives no rows; other columns are not read."""
    points = materialize(clean(chunks, key, vec, width), "vectors")
    kind = points.schema["key"].dataType.simpleString()
    # up to k + 1 lowest keys of each point, enough for every list it can appear in
    lowest = Window.partitionBy("point").orderBy("key")
    reps = points.select("key", "point").withColumn("nth", F.row_number().over(lowest)).where(F.col("nth") <= k + 1)
    some = [r.vec for r in points.orderBy(F.xxhash64("key"), "key").limit(sample).select("vec").collect()]
    if not some:
        return chunks.sparkSession.createDataFrame([], f"a {kind}, b {kind}, cos double, rank int")
    fitted = Curves(_units(np.array([np.frombuffer(v, "<f4") for v in some])), curves, dims, bits)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = fitted.keys(_units(_vectors(b.column(1), width)))
            flat = pa.array([r.tobytes() for r in keys.reshape(-1, keys.shape[2])], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, curves), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["key", "vec", "places"])

    first = reps.where("nth = 1").select("key")
    distinct = points.join(first, "key", "left_semi").select("key", "vec")
    placed = materialize(distinct.mapInArrow(place, f"key {kind}, vec binary, places array<binary>"), "placed")
    stretch = max(STRETCH, window)
    parts = max(1, -(-placed.count() * curves // PART))
    lined = placed.select("key", F.posexplode("places").alias("curve", "place")).repartitionByRange(parts, "curve", "place", "key").sortWithinPartitions("curve", "place", "key")
    lined = materialize(lined.select("curve", "key").mapInArrow(_number, f"curve int, key {kind}, part int, at long"), "places")
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = lined.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = lined.join(base, "part").groupBy("key").agg(F.collect_list(F.struct((F.col("base") + F.col("at")).alias("g"), "curve")).alias("x"))  # a number a curve
    sent = placed.select("key", "vec").join(numbered, "key").select("key", "vec", F.explode("x").alias("x")).select("x.g", "x.curve", "key", "vec")
    home = F.floor(F.col("g") / stretch)
    ahead = F.array(home, home - 1)  # the first of a stretch are also what follows the one before
    sent = sent.select(F.explode(F.when((F.col("g") % stretch < window) & (home > 0), ahead).otherwise(F.array(home))).alias("to"), "g", "curve", "key", "vec")
    found = sent.repartition("to").sortWithinPartitions("to", "g").mapInArrow(_search(width, k, window, least, stretch, BLOCK, HELD), f"a {kind}, b {kind}, cos double")
    best = found.groupBy("a").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("cos")).alias("far"), "b"))), 1, k).alias("x"))  # at most k x curves a vector
    pairs = best.select("a", F.explode("x").alias("y")).select("a", "y.b", (-F.col("y.far")).alias("cos"))
    # from points back to rows: the others of the own point come first, then those of the near points, lowest keys first
    named = reps.select(F.col("point"), F.col("key").alias("low"), "nth")
    of = reps.where("nth = 1").select(F.col("key").alias("rep"), "point")
    lists = pairs.join(of.select(F.col("rep").alias("b"), F.col("point").alias("pb")), "b").join(named.select(F.col("point").alias("pb"), "low", "nth"), "pb")
    lists = lists.join(of.select(F.col("rep").alias("a"), F.col("point").alias("point")), "a").where(F.col("nth") <= k).select("point", "low", "cos")
    many = reps.where("nth = 2").select("point")
    own = named.join(many, "point", "left_semi").select("point", "low", F.lit(1.0).alias("cos"))
    ranked = lists.unionByName(own).groupBy("point").agg(F.sort_array(F.collect_list(F.struct((-F.col("cos")).alias("far"), F.col("low").alias("b")))).alias("x"))
    rows = points.select("key", "point").join(ranked, "point").select(F.col("key").alias("a"), F.slice(F.filter("x", lambda y: y["b"] != F.col("key")), 1, k).alias("x"))
    return rows.select("a", F.posexplode("x").alias("rank", "y")).select("a", F.col("y.b").alias("b"), (-F.col("y.far")).alias("cos"), (F.col("rank") + 1).alias("rank"))


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of which one is among the nearest of the other."""
    return neighbours.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
