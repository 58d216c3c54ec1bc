"""Splitting oversized sections at natural boundaries by content-defined chunking.

A section longer than the limit is cut where a rolling hash of the 16 characters before a place has a landmark value;
the cut snaps to the nearest natural boundary of the best kind that the window between the least and the greatest size
holds: paragraph, line, sentence, word, and only without any of these a bare place between two characters. As places
depend on the text around them and not on a count from the section's start, an edit alters the pieces next to it and
the later cuts fall where they fell before.

One pass over the notes, no shuffle; a text is handled whole within its Arrow batch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import ready

MAX_CHARS, OVERLAP, MIN_CHARS = 1400, 150, 500
_HEADING = re.compile(r"#{1,4} ")
_FENCE = ("```", "~~~")
#: Places after which a kind of boundary lies, best first.
KINDS = ("paragraph", "line", "sentence", "word", "none")
_BREAKS = (re.compile(r"\n[^\S\n]*\n\s*"), re.compile(r"\n"), re.compile(r"[.!?؟。…][\"'»”)\]*_]*\s+"), re.compile(r"\s+"))
_BASE, _WIDTH = 0x100000001B3, 16


def sections(body: str) -> Iterator[tuple[int, str | None, str]]:
    """(section_no, heading, text without white space at the end) of each section. Lines end at a line feed; a section
    starts at a line with one to four # and a space, outside fenced code; section 0 is what comes before the first."""
    number, heading, start, at, fence = 0, None, 0, 0, ""
    for line in body.splitlines(keepends=True) if "\r" not in body and body.isascii() and not re.search(r"[\x0b\x0c\x1c-\x1e]", body) else re.findall(r"[^\n]*\n|[^\n]+$", body):
        three = line[:3]
        if fence:
            if three == fence:
                fence = ""
        elif three in _FENCE:
            fence = three
        elif _HEADING.match(line):
            yield number, heading, body[start:at].rstrip()
            number, heading, start = number + 1, line.lstrip("#").strip(), at
        at += len(line)
    yield number, heading, body[start:].rstrip()


def _landmarks(text: str) -> np.ndarray:
    """The mixed rolling hash of the 16 characters before each place 0..len(text)."""
    code = np.fromiter(map(ord, text), np.uint64, len(text))
    h = np.zeros(len(text) + 1, np.uint64)
    power = 1
    for k in range(_WIDTH):
        h[k + 1 :] += code[: len(text) - k] * np.uint64(power)
        power = power * _BASE & 0xFFFFFFFFFFFFFFFF
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _boundaries(text: str) -> list[np.ndarray]:
    return [np.fromiter((m.end() for m in b.finditer(text)), np.int64) for b in _BREAKS]


def _inside(places: np.ndarray, low: int, high: int) -> np.ndarray:
    return places[np.searchsorted(places, low, "left") : np.searchsorted(places, high, "right")]


def _hard(text: str, place: int, low: int) -> int:
    """The last place at or before `place` that parts no line break, mark or joiner from what it belongs to."""
    p = place
    while p > low and (unicodedata.combining(text[p]) or text[p] in "\u200d\ufe0f" or text[p - 1] == "\u200d" or text[p - 1 : p + 1] == "\r\n"):
        p -= 1
    return p if p > low else place


def pieces(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, min_chars: int = MIN_CHARS, landmark_bits: int = 8) -> list[tuple[int, int, int, str]]:
    """(start, end, characters shared with the piece before, kind of boundary at the end) of each piece of a text.

    A piece, its overlap included, has at most max_chars; without overlap the pieces are the text. A text within
    the limit is one piece, an empty one none."""
    if not 0 <= overlap < max_chars or not 0 < min_chars <= max_chars - overlap:
        raise ValueError("sizes need 0 <= overlap < max_chars and 0 < min_chars <= max_chars - overlap")
    n = len(text)
    if n <= max_chars:
        return [(0, n, 0, "end")] if n else []
    marks = _landmarks(text)
    hits = np.flatnonzero(marks >> np.uint64(64 - landmark_bits) == 0)
    breaks = _boundaries(text)
    core = max_chars - overlap
    out, at = [], 0
    while at < n:
        most = core if at else max_chars  # the first piece has nothing before it
        if n - at <= most:
            end, kind = n, "end"
        else:
            low, high = at + min_chars, at + most
            own = _inside(hits, low, high)
            aim = int(own[0]) if len(own) else low + int(np.argmin(marks[low : high + 1]))
            for kind, places in zip(KINDS, breaks, strict=False):  # noqa: B007
                near = _inside(places, low, high)
                if len(near):
                    end = int(near[np.argmin(np.abs(near - aim))])
                    break
            else:
                end, kind = _hard(text, aim, low), "none"
        shared = 0
        if at and overlap:
            for places in breaks[1:]:
                near = _inside(places, at - overlap, at - 1)
                if len(near):
                    shared = at - int(near[0])
                    break
            else:
                shared = at - max(at - overlap, 0)
                while shared > 0 and (unicodedata.combining(text[at - shared]) or text[at - shared] in "\u200d\ufe0f" or text[at - shared - 1 : at - shared + 1] == "\r\n"):
                    shared -= 1
        out.append((at - shared, end, shared, kind))
        at = end
    return out


SCHEMA = "section_no long, heading string, piece_no int, start int, end int, overlap int, boundary string, piece string"


def split_sections(notes: DataFrame, key: str = "note_id", body: str = "body", max_chars: int = MAX_CHARS, overlap: int = OVERLAP, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row per piece of each section longer than max_chars: (key, section_no, heading, piece_no, start, end, overlap,
    boundary, piece). start and end count code points in the section.

    Null and empty bodies, rows without a key and sections within the limit give no rows. Repeated rows of a note give equal pieces, of
    which one is kept. Other columns of the notes are not read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch["key"], batch["body"], strict=True):
                for number, heading, section in sections(text):
                    if len(section) > max_chars:
                        rows += [(k, number, heading, i, s, e, o, kind, section[s:e]) for i, (s, e, o, kind) in enumerate(pieces(section, max_chars, overlap, min_chars))]
            yield pd.DataFrame(rows, columns=[key, "section_no", "heading", "piece_no", "start", "end", "overlap", "boundary", "piece"])

    ready()
    kind = notes.schema[key].dataType.simpleString()
    long = notes.where(F.col(key).isNotNull() & (F.length(body) > max_chars)).select(F.col(key).alias("key"), F.col(body).alias("body"))
    return long.mapInPandas(run, f"`{key}` {kind}, {SCHEMA}").dropDuplicates([key, "section_no", "piece_no"])
