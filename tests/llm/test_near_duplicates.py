import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from marginalia.llm import near_duplicates as nd
from marginalia.llm.components import components


def make(seed, n=90):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            t = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 2, 6])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((i, " ".join(t)))
        else:
            rows.append((i, " ".join(rng.choices(words, k=rng.choice([5, 9, 40, 120])))))
    return rows


def brute(rows, t, k=5):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        if len(w) >= k:
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return sorted((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t)


@pytest.mark.parametrize(("seed", "t", "block"), [(1, 0.5, 1024), (2, 0.8, 1024), (3, 0.5, 3)])
def test_all_pairs(spark, monkeypatch, seed, t, block):
    monkeypatch.setattr(nd, "BLOCK", block)  # 3: every shared shingle counts as hot and is split
    rows = make(seed)
    df = spark.createDataFrame([(i, x, "c", 1) for i, x in [*rows, rows[0]]], "note_id long, body string, sig string, n int")
    assert sorted((r.a, r.b) for r in nd.near_duplicates(df, t=t).collect()) == brute(rows, t)


def test_trees_of_many_levels(spark, monkeypatch):
    monkeypatch.setattr(nd, "FAN", 3)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(base[:40] + rng.choices([f"x{j}" for j in range(90)], k=rng.choice([2, 20, 60])))) for i in range(120)]
    df = spark.createDataFrame(rows, "note_id long, body string")
    assert sorted((r.a, r.b) for r in nd.near_duplicates(df).collect()) == brute(rows, 0.5)


def test_traversal_prunes_and_loses_nothing():
    """On the notes of sf0.001, one tree over every shared token: most node pairs are dropped by each of the bounds."""
    got = pq.read_table("/root/testdata/sf0.001/notes.parquet", columns=["note_id", "body"]).to_pandas().dropna().drop_duplicates("note_id")
    sets = {k: s for k, t in zip(got.note_id, got.body, strict=True) if len(s := nd.shingles(t, 5, {}))}
    held: dict[int, list[int]] = {}
    for k, s in sets.items():
        for h in s.tolist():
            held.setdefault(h, []).append(k)
    posts = [(h, k) for h, ks in sorted(held.items()) if len(ks) > 1 for k in sorted(ks, key=lambda k: len(sets[k]))]
    x = nd._Texts(np.array([k for _, k in posts]), np.array([len(sets[k]) for _, k in posts]), np.full(len(posts), 10**6), np.array([nd.signature(sets[k]).view(np.uint64) for _, k in posts]))
    token = np.unique([h for h, _ in posts], return_inverse=True)[1]
    counts: dict[str, int] = {}
    found = {(min(x.key[i], x.key[j]), max(x.key[i], x.key[j])) for a, b in nd.traverse(x, nd._Tree(x, np.arange(len(posts)), token), None, 0.5, counts) for i, j in zip(a, b, strict=True)}
    true = {(a, b) for a in sets for b in sets if a < b and (o := len(np.intersect1d(sets[a], sets[b]))) / (len(sets[a]) + len(sets[b]) - o) >= 0.5}
    assert true and true <= found
    assert min(counts["visited"], counts["by_size"], counts["by_tokens"], counts["by_overlap"]) > 0
    assert counts["visited"] < len(posts) ** 2 / 20


def test_uneven_trees():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(70)]
    x = nd._Texts(np.arange(70), np.array([len(s) for s in sets]), np.full(70, 10**6), np.array([nd.signature(s << 20).view(np.uint64) for s in sets]))
    a, b = (nd._Tree(x, e, np.zeros(len(e), np.int64)) for e in (np.arange(3), np.arange(3, 70)))
    found = {(i, j) for p, q in nd.traverse(x, a, b, 0.5) for i, j in zip(p.tolist(), q.tolist(), strict=True)}
    assert {(i, j) for i in range(3) for j in range(3, 70) if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))} <= found


def test_copies(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i, text) for i in range(12)] + [(50, text + " more"), (60, "too few words"), (61, None), (62, "")]
    df = spark.createDataFrame(rows, "note_id long, body string")
    assert sorted((r.a, r.b) for r in nd.near_duplicates(df).collect()) == brute(rows, 0.5)
    star = sorted((r.a, r.b) for r in nd.near_duplicates(df, expand=5).collect())
    assert star == sorted([(0, i) for i in range(1, 12)] + [(0, 50)])
    g = {r.note_id: (r["class"], r.group, r.n_links) for r in nd.groups(df, t=0.5).collect()}
    assert g[7] == (0, 0, 1) and g[50] == (50, 0, 1) and 60 not in g
    assert nd.near_duplicates(df.where("false")).count() == 0 and nd.groups(df.where("false")).count() == 0


def test_sets_are_not_written(spark, monkeypatch):
    """What is written on the way is less than eight bytes a token, which the sets alone would take."""
    written, write = [], nd.materialize
    monkeypatch.setattr(nd, "materialize", lambda df, name: written.append(write(df, name)) or written[-1])
    rows = make(7, 1500)
    got = sorted((r.a, r.b) for r in nd.near_duplicates(spark.createDataFrame(rows, "note_id long, body string")).collect())
    assert got == brute(rows, 0.5)
    tokens = sum(len(nd.shingles(text, 5, {})) for _, text in rows)
    assert sum(Path(f.removeprefix("file:")).stat().st_size for df in written for f in df.inputFiles()) < 5 * tokens


def test_tokens_in_many_pieces(spark, monkeypatch):
    """Tokens counted and looked up some texts at a time, hot ones among them."""
    monkeypatch.setattr(nd, "HELD", 500)
    monkeypatch.setattr(nd, "BLOCK", 20)
    monkeypatch.setattr(nd, "TREE", 16)
    rows = make(8, 400)
    assert sorted((r.a, r.b) for r in nd.near_duplicates(spark.createDataFrame(rows, "note_id long, body string")).collect()) == brute(rows, 0.5)
    x = np.random.default_rng(1).integers(0, 1 << 60, 1000).astype(np.uint64)
    assert (nd._unpacked(nd._packed(x)) == x).all() and len(nd._unpacked(nd._packed(x[:0]))) == 0


def test_a_task_reads_the_counts_of_its_own_tokens(spark):
    """All that tasks read of counts is a number for each token that a piece has, however many pieces there are."""
    rows = make(9, 300)
    one, _ = nd.classes(spark.createDataFrame(rows, "note_id long, body string"))
    counts = [(r.piece, nd._unpacked(r.df)) for r in nd.shared_tokens(one.repartition(6), 5, 40, 3).select("piece", "df").collect()]
    sets = nd.sets_of(pa.array([r.text for r in one.collect()]), 5)
    every, k = np.unique(np.concatenate(sets).view(np.uint64) >> np.uint64(24), return_counts=True)
    assert len({p for p, _ in counts}) == 6
    assert sum(len(x) for _, x in counts) <= sum(map(len, sets)) and max(x.max() for _, x in counts) == k.max() > 1
    assert sum((x == 0).sum() for _, x in counts) == (k == 1).sum()


@pytest.mark.parametrize("chunk", [1 << 17, 7])
def test_sets_of_many_texts_at_once(monkeypatch, chunk):
    monkeypatch.setattr(nd, "CHUNK", chunk)
    nd._powers.cache_clear()
    rng = random.Random(4)
    texts = ["".join(rng.choices("abAB cC  __-\nİΣσςßÉé中文\U0001f600\U00010400\U0001d7d8١²\u0307ǅ", k=rng.choice([0, 1, 6, 40]))) for _ in range(400)]
    true = [{tuple(w[j : j + 2]) for j in range(len(w) - 1)} for x in texts for w in [re.findall(r"[^\W_]+", x.lower())]]
    got = nd.sets_of(pa.array(["aa bb", *texts]).slice(1), 2)
    assert [len(x) for x in got] == [len(x) for x in true] and all((x[1:] > x[:-1]).all() for x in got)
    for i in range(len(texts) - 1):
        assert len(np.intersect1d(got[i], got[i + 1])) == len(true[i] & true[i + 1])
    nd._powers.cache_clear()


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95)]
    got = {r.key: r.group for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[95] == got[100] == 90
