"""Relatedness over a bipartite graph, where pairs outnumber edges: no pair is shuffled, only lists of neighbours are.

Each side becomes a written table of lists of the other side's numbers. A task takes some nodes of a side, reads the
other side's lists from the shared folder and adds up its own nodes' pairs, a block of them at a time. A node with more pairs
than a block has is added up alone, some of its links at a time, into one sum for each node of its side; so hubs cost time,
which grows as the square of their links, and no memory. What goes on are each node's best. So edges travel three times and
pairs never."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import materialize, ready

#: Pairs a task adds up at once; links of the other side held at once: with more, they are read again for each block.
PAIRS, HELD = 2_000_000, 48_000_000
_kept: dict[str, list] = {}  # what a worker read last


def _numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written, with a dense number n from 0, and the number's type; to the driver come the counts of the partitions."""
    t = materialize(df.withColumn("id", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r.part, r.k) for r in t.groupBy(part.alias("part")).agg(F.count("*").alias("k")).collect())
    kind = "int" if sum(k for _, k in sizes) < 1 << 31 else "long"
    before = dict(zip([p for p, _ in sizes], accumulate((k for _, k in sizes), initial=0), strict=False))
    start = F.create_map(*(F.lit(x).cast("long") for p in before.items() for x in p))[part] if before else F.lit(0)
    return t.withColumn("n", (start + place).cast(kind)).drop("id"), kind


def _files(t: DataFrame) -> list[str]:
    return sorted(t.inputFiles())


def _batches(files: list[str], columns: list[str]) -> Iterator[pa.RecordBatch]:
    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(16_384, columns=columns)


def _nodes(files: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(key, degree) by number."""
    got = [[np.empty(0, np.int64)] * 3]
    got += [[c.fill_null(0).to_numpy() for c in b.columns] for b in _batches(files, ["n", "key", "deg"])]
    n, key, deg = (np.concatenate([g[k] for g in got]) for k in range(3))
    order = np.argsort(n)
    return key[order], deg[order]


def _lists(files: list[str], count: int, held: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, links) for some nodes at a time: where each number's links lie; start = end for the others."""

    def opened(uri: str) -> int:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            m = pq.ParquetFile(f).metadata
        return sum(c.num_values for g in range(m.num_row_groups) for k in range(m.num_columns) if (c := m.row_group(g).column(k)).path_in_schema.startswith("near."))

    left = sum(map(opened, files))
    start, end, at, room = np.zeros(count, np.int64), np.zeros(count, np.int64), 0, None
    for b in _batches(files, ["n", "near"]):
        n, size, links = b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy().astype(np.int64), b.column(1).flatten().to_numpy()
        if room is not None and at + len(links) > len(room):
            yield start, end, room[:at]
            start, end, at, room = np.zeros(count, np.int64), np.zeros(count, np.int64), 0, None
        if room is None:
            room = np.empty(max(len(links), min(left, held)), links.dtype)
        end[n] = at + np.cumsum(size)
        start[n] = end[n] - size
        room[at : at + len(links)] = links
        at, left = at + len(links), left - len(links)
    if room is not None:
        yield start, end, room[:at]


def _rounded(score: np.ndarray) -> np.ndarray:
    """Scores in units of 1e-9, halves upward by the shortest decimal form, as Spark rounds."""
    x = score * 1e9
    out = np.floor(x + 0.5).astype(np.int64)
    for k in np.flatnonzero(np.abs(x - np.floor(x) - 0.5) < 1e-4):
        out[k] = int((Decimal(repr(float(score[k]))) * 10**9).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def _best(top: int, most_degree: int | None, mine: list[str], others: list[str], lists: list[str], pairs: int, held: int):
    """The best of each node (n, near) of a side. mine, others: files of the nodes of its side and of the other one;
    lists: files of the other side's lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _kept.get("lists") != lists:
            _kept.clear()
            _kept.update(lists=lists, mine=_nodes(mine), degree=_nodes(others)[1])
            some, _kept["class"] = np.unique(_kept["degree"], return_inverse=True)  # their number is the root of twice the links at most
            _kept["weight"] = 1 / np.log(np.maximum(some, 2))
            parts = _lists(lists, len(_kept["degree"]), held)
            first = next(parts, None)
            whole = next(parts, None) is None
            _kept["parts"] = [first] if whole and first else []
            pa.default_memory_pool().release_unused()
        for batch in batches:
            near = batch.column(1)
            size = near.value_lengths().to_numpy().astype(np.int64)
            n, via, degree = batch.column(0).to_numpy(), near.flatten().to_numpy(), _kept["degree"]
            steps = degree[via]  # pairs through each link; a node has as many links as its degree at most
            if most_degree is not None:
                steps = np.where(steps <= most_degree, steps, 0)
            row = np.repeat(np.arange(len(n)), size)
            each = np.bincount(row, steps, len(n))
            alone = np.flatnonzero(each > pairs)
            cuts = np.union1d(np.flatnonzero(np.diff(np.cumsum(each) // pairs, prepend=-1)), np.concatenate([alone, alone + 1, [len(n)]])).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(size)])
            for a, b in zip(cuts, cuts[1:], strict=False):
                s = slice(ends[a], ends[b])
                used = steps[s] > 0
                if used.any():
                    yield from single(n[a:b], via[s][used]) if each[a] > pairs else block(n[a:b], row[s][used] - a, via[s][used])

    def single(n: np.ndarray, via: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One node with many pairs."""
        common, both = np.zeros(len(_kept["mine"][0]), np.int64), np.zeros(len(_kept["mine"][0]))
        via = via[np.argsort(_kept["degree"][via], kind="stable")]
        for start, end, links in _kept["parts"] or _lists(lists, len(_kept["degree"]), held):
            k = end[via] - start[via]
            cuts = np.append(np.flatnonzero(np.diff(np.cumsum(k) // pairs, prepend=-1)), len(via))
            for a, b in zip(cuts, cuts[1:], strict=False):
                v, m = via[a:b], k[a:b]
                at = np.repeat(start[v] - (np.cumsum(m) - m), m)
                at += np.arange(len(at))
                other = links[at]
                del at
                np.add.at(common, other, 1)
                np.add.at(both, other, np.repeat(_kept["weight"][_kept["class"][v]], m))
        other = np.flatnonzero(common)
        yield from scored(n, np.zeros(len(other), np.int64), other, common[other], both[other])

    def block(n: np.ndarray, row: np.ndarray, via: np.ndarray) -> Iterator[pa.RecordBatch]:
        bits = max(1, (len(_kept["weight"]) - 1).bit_length())
        space = len(_kept["mine"][0]).bit_length() + bits
        found = []
        for start, end, links in _kept["parts"] or _lists(lists, len(_kept["degree"]), held):
            k = end[via] - start[via]
            at = np.repeat(start[via] - (np.cumsum(k) - k), k)
            at += np.arange(len(at))
            code = links[at].astype(np.int64)
            del at
            code <<= bits
            code |= np.repeat(row << space | _kept["class"][via], k)
            found.append(code)
        code = np.concatenate(found)
        del found
        code.sort()  # by node, then other node, then degree of what they share
        pair = code >> bits
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        common = np.diff(np.append(first, len(code)))
        both = np.add.reduceat(_kept["weight"][code & ((1 << bits) - 1)], first)
        pair = pair[first]
        del code
        yield from scored(n, pair >> (space - bits), pair & ((1 << (space - bits)) - 1), common, both)

    def scored(n: np.ndarray, row: np.ndarray, other: np.ndarray, common: np.ndarray, both: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The best of pairs of n[row] and other, sorted by row, with the number and weight of what they share."""
        key, deg = _kept["mine"]
        keep = n[row] != other
        row, other, common, both = row[keep], other[keep], common[keep], both[keep]
        if not len(row):
            return
        score = 0.5 * both + 3 * common / (deg[n[row]] + deg[other] - common)
        # the least score, to a unit of 1e-9 or more, of each node's best; what lies under it by more is out
        free = 62 - len(n).bit_length()
        rough = (score * min(1e9, (1 << free) / (score.max() + 1))).astype(np.int64)
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        last = np.minimum(begins + top, np.append(begins[1:], len(row))) - 1
        ranked = row << free | ((1 << free) - 1 - rough)
        ranked.sort()
        least = np.zeros(len(n), np.int64)
        least[row[begins]] = (1 << free) - 1 - (ranked[last] & ((1 << free) - 1))
        del ranked
        near = np.flatnonzero(rough >= least[row] - 2)
        row, other, score = row[near], other[near], score[near]
        name = key[other].astype("U20")
        order = np.lexsort((name, -_rounded(score), row))
        row = row[order]
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        nth = np.arange(len(row)) - np.repeat(begins, np.diff(np.append(begins, len(row)))) + 1
        good = nth <= top
        order, nth = order[good], nth[good]
        yield pa.RecordBatch.from_arrays([pa.array(key[n[row[good]]], pa.int64()), pa.array(key[other[order]], pa.int64()), pa.array(nth, pa.int64()), pa.array(score[order])], names=["a", "b", "nth", "score"])

    return run


def related(edges: DataFrame, names: tuple[str, str], top: int = 8, most_degree: int | None = None, pairs: int = PAIRS, held: int = HELD) -> DataFrame:
    """(a, b, nth, score): the `top` nodes of its own side with the largest graph.link_relatedness() of each, equal ones (to nine
    places) in order of their names, which are a side's letter and the key.

    edges: (left long, right long), repeats count once. A null is nobody, but counts in the degree of what it is linked to.
    most_degree: nodes with more links say nothing about those they link; None: all do."""
    ready()
    lists = edges.groupBy(F.col("left").alias("key")).agg(F.collect_set("right").alias("near"), F.max(F.col("right").isNull().cast("int")).alias("void"))
    one, kind = _numbered(lists.select("key", "near", (F.size("near") + F.col("void")).cast("long").alias("deg")), "left-lists")
    each = one.select(F.explode("near").alias("key"), F.when(F.col("key").isNotNull(), F.col("n")).alias("other"))
    two, kind2 = _numbered(each.groupBy("key").agg(F.collect_list("other").alias("near"), F.count("*").alias("deg")), "right-lists")
    right = materialize(two, "right")
    left = materialize(right.select(F.explode("near").alias("n"), F.col("n").alias("m")).groupBy("n").agg(F.collect_list("m").alias("near")), "left")
    nodes = _files(materialize(one.select("n", "key", "deg"), "left-nodes")), _files(right)
    near = _files(left), _files(right)
    out = None
    for side, t in enumerate((left, right)):
        run = _best(top, most_degree, nodes[side], nodes[1 - side], near[1 - side], pairs, held)
        best = t.select("n", "near").mapInArrow(run, "a long, b long, nth long, score double")
        named = best.select(*(F.concat(F.lit(names[side]), F.col(c).cast("string")).alias(c) for c in "ab"), "nth", "score")
        out = named if out is None else out.unionByName(named)
    return out
