"""Language of documents and of paragraphs, by word-first backoff.

A word that the model knows scores its log frequency in each language; an unseen word falls back to its character
n-grams, from five letters down to one, at the longest length of which the model knows at least half. Words' scores add
up over a paragraph; a text's main language is that of most of its letters.

The model is fitted on a bounded sample of labelled rows (`sample_rows` of each table, by hash of the key). As labels may
be wrong and texts mixed, it is fitted again on the sample's paragraphs under the languages it gives them. It is the
only thing that is broadcast, and grows with the sample, not with the data. Scoring is one Arrow pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import ready

SAMPLE_ROWS, LONGEST, SMOOTH, CLIP = 2000, 5, 0.5, 9.0
_WORD = re.compile(r"[^\W\d_]+")
_ITEM = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s+(?:\[[ xX]\]\s*)?")
_SKIP = re.compile(r"\s*(?:#{1,6}\s|[|]|—|(?:\[\[[^\]\n]+\]\]\s*)+$|(?:#\w[\w/-]*\s*)+$|<?\w+://\S+\s*$)")
_NOISE = re.compile(r"\[\[[^\]\n]*\]\]|`[^`\n]*`|\w+://\S+|\*\*[^*\n]{1,60}\*\*")
_STOP = re.compile(r"[.!?؟。…][\"'»”)\]*]*(?:\s|$)")
#: Kinds of a paragraph: nothing to read, phrases (list items), sentences.
NONE, PHRASES, SENTENCES = 0, 1, 2


def label_code(label: Column, codes: DataFrame) -> Column:
    """The code of a label in any spelling that lang_codes has, with a region or in quotes; null if it names none of them.

    lang_codes is a small table that does not grow; its spellings become one map literal."""
    bare = F.lower(F.trim(F.regexp_replace(F.trim(label), "^[\"']|[\"']$", "")))
    known = {}
    for r in codes.collect():
        for spelled in (r.code, r.code3, r.english_name, r.own_name):
            if spelled:
                known[spelled.strip().lower()] = r.code
    if not known:
        return F.lit(None).cast("string")
    spellings = F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair])
    region = F.regexp_extract(bare, r"^([a-z]{2,3})[-_][a-z0-9]+$", 1)
    return F.coalesce(F.try_element_at(spellings, bare), F.try_element_at(spellings, region))


def front_matter_label(front: Column) -> Column:
    """The value of the key lang or language, in any case, of a YAML text; null if there is none."""
    found = F.regexp_extract(front, r"(?im)^\s*(?:lang|language)\s*:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def paragraphs(text: str) -> list[tuple[int, int, str]]:
    """(para_no, kind, prose) of each run of lines between blank lines. Prose leaves out code, tables, headings, links,
    addresses, tags and signatures."""
    out, number, fence, inside = [], 0, "", False
    prose, items = [], []

    def close() -> None:
        nonlocal inside, prose, items
        if inside:
            kind = SENTENCES if any(_STOP.search(p) or p.count(" ") >= 4 for p in prose) else PHRASES if prose or items else NONE
            out.append((number, kind, " ".join(prose + items)))
        inside, prose, items = False, [], []

    for line in text.split("\n"):
        if not line or line.isspace():
            close()
            continue
        if not inside:
            inside, number = True, number + 1
        three = line[:3]
        if fence:
            if three == fence:
                fence = ""
        elif three in ("```", "~~~"):
            fence = three
        elif not _SKIP.match(line):
            clean = _NOISE.sub(" ", line)
            if m := _ITEM.match(line):
                items.append(clean[m.end() :])
            else:
                prose.append(clean)
    close()
    return out


class Model:
    """Log frequencies of words and of character n-grams in each language."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray]):
        self.langs, self.words, self.grams = langs, words, grams
        self.place: dict[str, int] = {}
        self.rows = np.empty((0, len(langs)))

    def __reduce__(self):
        return Model, (self.langs, self.words, self.grams)

    @classmethod
    def fit(cls, labelled: list[tuple[str, str]], langs: list[str]) -> Model:
        """labelled: (language, text). Words and n-grams seen fewer than twice or three times are left to backoff."""
        at = {c: i for i, c in enumerate(langs)}
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(langs)))
        for lang, text in labelled:
            for w, n in Counter(_WORD.findall(text.lower())).items():
                counts[w][at[lang]] += n
        grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(langs)))
        for w, n in counts.items():
            weight = np.log1p(n)
            for g in cls.split(w, range(1, LONGEST + 1)):
                grams[g] += weight
        words = cls._logs({w: n for w, n in counts.items() if n.sum() >= 2}, lambda w: 0)
        return cls(langs, words, cls._logs({g: n for g, n in grams.items() if n.sum() >= 3 * math.log(2)}, len))

    @staticmethod
    def _logs(counts: dict[str, np.ndarray], kind) -> dict[str, np.ndarray]:
        """Log frequencies, less their mean over languages and clipped, so that one word decides only so much."""
        total, size = defaultdict(float), Counter()
        for k, n in counts.items():
            total[kind(k)] = total[kind(k)] + n
            size[kind(k)] += 1
        out = {}
        for k, n in counts.items():
            logs = np.log((n + SMOOTH) / (total[kind(k)] + SMOOTH * size[kind(k)]))
            out[k] = np.maximum(logs - logs.max(), -CLIP)
        return out

    @staticmethod
    def split(word: str, lengths) -> Iterator[str]:
        bounded = f" {word} "
        for n in lengths:
            for i in range(len(bounded) - n + 1):
                yield bounded[i : i + n]

    def score(self, word: str) -> np.ndarray:
        """The word's scores in each language, 0 for the likeliest."""
        known = self.words.get(word)
        if known is not None:
            return known
        for n in range(LONGEST, 0, -1):
            own = list(self.split(word, (n,)))
            got = [g for x in own if (g := self.grams.get(x)) is not None]
            if own and 2 * len(got) >= len(own):
                mean = np.mean(got, 0)
                return 0.5 * (mean - mean.max())
        return np.zeros(len(self.langs))

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The scores of each text, its letters and its words."""
        found = [_WORD.findall(t.lower()) for t in texts]
        flat = list(chain.from_iterable(found))
        count = np.fromiter(map(len, found), np.int64, len(found))
        if len(self.place) > 400_000:
            self.place.clear()
            self.rows = np.empty((0, len(self.langs)))
        new = sorted(set(flat).difference(self.place))
        if new:
            base = len(self.place)
            self.place.update(zip(new, range(base, base + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, [self.score(w) for w in new]])
        index = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        ends = np.concatenate([[0], np.cumsum(count)])
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.rows[index], 0)])
        length = np.concatenate([[0], np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))])
        return np.diff(sums[ends], axis=0), np.diff(length[ends]), count


def posterior(scores: np.ndarray) -> np.ndarray:
    """Shares of each language from scores; words in a sentence are not independent, so that scores count half."""
    e = np.exp(0.5 * (scores - scores.max(-1, keepdims=True)))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[str, str]], langs: list[str], rounds: int = 2) -> Model:
    """Fits on whole texts under their labels, then on paragraphs under the languages that come out."""
    model = Model.fit(rows, langs)
    parts = [p for _, text in rows for _, kind, p in paragraphs(text) if kind]
    for _ in range(rounds if parts else 0):
        scores, _, words = model.totals(parts)
        best, share = scores.argmax(1), posterior(scores).max(1)
        model = Model.fit([(langs[i], p) for i, p, s, n in zip(best, parts, share, words, strict=True) if s > 0.9 and n >= 3], langs)
    return model


def sample(rows: DataFrame, key: str, text: str, code: Column, most: int) -> list[tuple[str, str]]:
    """(code, text) of some `most` labelled rows by a hash of the key, whole texts, the same ones each time; `most` bounds what the driver holds."""
    labelled = rows.withColumn("__code", code).where(F.col("__code").isNotNull() & F.col(text).isNotNull())
    n = labelled.count()
    if n > most:
        labelled = labelled.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_003)) < int(1_000_003 * most / n))
    return [(r[0], r[1]) for r in labelled.select("__code", text).collect()]


SCHEMA = "rec_id long, main string, para_no long, lang string, confidence double, letters long, sentences boolean"


def languages(rows: DataFrame, key: str, text: str, model: Model, keep: list[Column] | None = None) -> DataFrame:
    """(rec_id, label, main, para_no, lang, confidence, letters, sentences): the record (para_no 0) and each paragraph with words.

    `label` is the row's own, in `keep[0]` if given. Null, empty and wordless texts give no rows. sentences: whether the
    paragraph, or any of the record's, holds one. Equal letters of two languages: the one first in alphabetical order."""
    ready()
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = np.array(m.langs, object)
        for b in batches:
            owner, numbers, kinds, parts = [], [], [], []
            for i, t in enumerate(b["text"]):
                for number, kind, p in paragraphs(t):
                    if kind:
                        owner.append(i)
                        numbers.append(number)
                        kinds.append(kind)
                        parts.append(p)
            if not parts:
                continue
            scores, letters, words = m.totals(parts)
            some = words > 0
            owner, numbers = (np.array(x)[some] for x in (owner, numbers))
            speech = ((np.array(kinds) == SENTENCES) & (words >= 3))[some]
            scores, letters = scores[some], letters[some]
            if not len(owner):
                continue
            best, share = scores.argmax(1), posterior(scores).max(1)
            held = np.zeros((len(b), len(names)))
            np.add.at(held, (owner, best), letters)
            sure = np.zeros((len(b), len(names)))
            np.add.at(sure, (owner, best), letters * share)
            spoken = np.zeros(len(b), bool)
            np.logical_or.at(spoken, owner, speech)
            present = np.unique(owner)
            main = held[present].argmax(1)
            total = held[present].sum(1)
            mains = np.zeros(len(b), int)
            mains[present] = main
            keys, labels = b["key"].to_numpy(), b["label"].to_numpy()
            yield pd.DataFrame({"rec_id": keys[present], "label": labels[present], "main": names[main], "para_no": 0, "lang": names[main], "confidence": np.round(sure[present, main] / total, 6), "letters": total.astype(np.int64), "sentences": spoken[present]})
            yield pd.DataFrame({"rec_id": keys[owner], "label": labels[owner], "main": names[mains[owner]], "para_no": numbers, "lang": names[best], "confidence": np.round(share, 6), "letters": letters, "sentences": speech})

    label = (keep or [F.lit(None).cast("string")])[0]
    some = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), label.alias("label"), F.col(text).alias("text"))
    return some.mapInPandas(run, SCHEMA.replace("rec_id long,", "rec_id long, label string,"))


def cases(found: DataFrame, least: float = 0.8) -> DataFrame:
    """(rec_id, para_no, lang, confidence): records whose label is missing, names no language or another than the main one,
    and paragraphs of sentences in another language than the main one. Records without a sentence are never cases.

    found: languages(). Repeated rows of a record are one case. `least` is the confidence a paragraph needs."""
    head = (F.col("para_no") == 0) & (F.col("label").isNull() | (F.col("label") != F.col("lang")))
    other = (F.col("para_no") > 0) & (F.col("lang") != F.col("main")) & (F.col("confidence") >= least)
    return found.where(F.col("sentences") & (head | other)).select("rec_id", "para_no", "lang", "confidence").dropDuplicates(["rec_id", "para_no"])
