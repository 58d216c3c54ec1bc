"""The few Arrow functions whose semantics Spark's own operators can't express. Built when called, as workers import this
module without a session."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.session import ready


def nfc(c: Column) -> Column:
    """A text in Unicode's composed form; null stays null."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    ready()
    return F.pandas_udf(run, "string")(c)


def osa_distance(a: str, b: str, cap: int = 3) -> int:
    """Edits between two words, neighbours exchanged counting one and no letter edited twice; cap + 1 beyond cap."""
    if abs(len(a) - len(b)) > cap:
        return cap + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        if min(row) > cap:
            return cap + 1
        two, one = one, row
    return min(one[-1], cap + 1)


def osa(a: Column, b: Column, cap: int = 3) -> Column:
    """osa_distance of two columns; null if either is."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else osa_distance(p, q, cap) for p, q in zip(x, y, strict=True)], dtype="Int32")

    ready()
    return F.pandas_udf(run, "int")(a, b)


def min_span(lists: list[list[int]]) -> int | None:
    """The least distance between the ends of a window that holds one position of each list; null if a list is empty."""
    if any(len(x) == 0 for x in lists):
        return None
    at = [0] * len(lists)
    best = None
    while True:
        now = [x[i] for x, i in zip(lists, at, strict=True)]
        low = min(now)
        best = max(now) - low if best is None else min(best, max(now) - low)
        k = now.index(low)
        at[k] += 1
        if at[k] == len(lists[k]):
            return best


def proximity(positions: Column, wanted: Column) -> Column:
    """(terms present / terms wanted) / (1 + least span / terms present) of array<array<int>> sorted positions; 0 under two terms."""

    def run(p: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([(len(x) / w) / (1 + min_span(x) / len(x)) if x is not None and len(x) > 1 else 0.0 for x, w in zip(p, n, strict=True)], dtype=float)

    ready()
    return F.pandas_udf(run, "double")(positions, wanted)


def yaml_json(front: Column) -> Column:
    """A YAML mapping as JSON text; null for text that is malformed or no mapping, or without a YAML library."""

    def run(s: pd.Series) -> pd.Series:
        import json

        try:
            import yaml
        except ImportError:
            return pd.Series([None] * len(s), dtype=object)

        def one(t):
            try:
                v = yaml.safe_load(t) if t is not None else None
            except yaml.YAMLError:
                return None
            return json.dumps(v, default=str, ensure_ascii=False) if isinstance(v, dict) else None

        return s.map(one)

    ready()
    return F.pandas_udf(run, "string")(front)


def line_diff(before: str | None, after: str | None, most_cells: int = 4_000_000) -> list[tuple[str, str]]:
    """Lines as (" ", "-", "+") and text by the longest common subsequence, deletions first where either would do; beyond
    most_cells all lines of the one are deleted and all of the other added. Equal lines at the head need no table; the
    table of the rest is filled a row at a time."""
    a, b = (before.split("\n") if before else []), (after.split("\n") if after else [])
    if len(a) * len(b) > most_cells:
        return [("-", x) for x in a] + [("+", x) for x in b]
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    out = [(" ", x) for x in a[:k]]
    a, b = a[k:], b[k:]
    if a and b:
        number: dict[str, int] = {}
        left, right = (np.array([number.setdefault(x, len(number)) for x in side], np.int64) for side in (a, b))
        rows = np.zeros((len(a) + 1, len(b) + 1), np.int32)
        for i in range(len(a) - 1, -1, -1):
            row = np.maximum(rows[i + 1, :-1], np.where(right == left[i], rows[i + 1, 1:] + 1, 0))
            rows[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
        i = j = 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.append((" ", a[i]))
                i, j = i + 1, j + 1
            elif rows[i + 1, j] >= rows[i, j + 1]:
                out.append(("-", a[i]))
                i += 1
            else:
                out.append(("+", b[j]))
                j += 1
        a, b = a[i:], b[j:]
    return out + [("-", x) for x in a] + [("+", x) for x in b]


def diff(before: Column, after: Column) -> Column:
    """array<struct<op, text>> of two texts' lines."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[{"op": o, "text": t} for o, t in line_diff(p, q)] for p, q in zip(x, y, strict=True)], dtype=object)

    ready()
    return F.pandas_udf(run, "array<struct<op:string,text:string>>")(before, after)
