import numpy as np

from marginalia.llm import neighbours as nb


def truth(rows, k=5, least=0.8):
    ok = {}
    for i, v in rows:
        if v is not None and len(v) == 96 and None not in v and np.isfinite(v).all() and any(v):
            ok[i] = np.array(v, np.float32).astype(float)
    ids = sorted(ok)
    x = np.array([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    s = np.round(x @ x.T, 9)
    out = set()
    for a in range(len(ids)):
        near = sorted((b for b in range(len(ids)) if b != a and s[a, b] >= least), key=lambda b: (-s[a, b], ids[b]))[:k]
        out |= {(min(ids[a], ids[b]), max(ids[a], ids[b])) for b in near}
    return out


def test_recall_and_dirt(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 96))
    x = centres[rng.integers(0, 60, 700)] + 0.45 * rng.standard_normal((700, 96))
    rows = [(i, [float(z) for z in v]) for i, v in enumerate(x)]
    rows += [(800 + i, rows[0][1]) for i in range(9)] + [(900, [2 * z for z in rows[5][1]])]  # equal, and equal up to scale
    dirt = [(1000, None), (1001, [0.0] * 96), (1002, [1.0] * 95), (1003, [float("nan")] + [1.0] * 95), (1004, [None] + [1.0] * 95), (1005, [float("inf")] + [1.0] * 95), (None, [1.0] * 96)]
    df = spark.createDataFrame([(i, v, "c", 0.5) for i, v in [*rows, *dirt, rows[3]]], "chunk_id long, vec array<float>, point string, cos double")
    out = nb.nearest(df)
    got, want = {(r.a, r.b) for r in nb.similar_pairs(out).collect()}, truth(rows)
    assert len(got & want) / len(want) >= 0.98 and len(got & want) / len(got) >= 0.98
    assert max(r["count"] for r in out.groupBy("a").count().collect()) <= 5
    assert {r.b for r in out.where("a = 805").collect()} == {0, 800, 801, 802, 803}


def test_small(spark):
    df = spark.createDataFrame([(1, [1.0] * 96)], "chunk_id long, vec array<float>")
    assert nb.nearest(df).count() == 0 and nb.nearest(df.where("false")).count() == 0


def test_hilbert_curve_steps_to_neighbours():
    grid = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    order = np.argsort(nb.hilbert_keys(grid, 3))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


def test_crowd_in_one_cell(spark):
    rng = np.random.default_rng(6)
    n = 4000
    others, centre, families = rng.standard_normal((n // 2, 96)), rng.standard_normal(96), rng.standard_normal((n // 5, 96))
    crowd = centre / np.linalg.norm(centre) + 0.0014 / np.sqrt(96) * (families[rng.integers(0, n // 5, n)] + 0.2 * rng.standard_normal((n, 96)))  # cosines of 0.999999
    x = np.vstack([crowd, others]).astype(np.float32)
    out = nb.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vec array<float>"), window=60)
    got = {(r.a, r.b) for r in out.select("a", "b").collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = set()
    for a in range(0, n, 20):
        cos = np.round(unit @ unit[a], 12)
        cos[a] = -2
        want |= {(a, int(b)) for b in np.lexsort((np.arange(len(x)), -cos))[:5]}
    assert len(got & want) / len(want) >= 0.9


def test_bytes_begin_with_the_key_of_fewer_bits():
    cells = np.random.default_rng(2).integers(0, 1 << 16, (500, 4))
    order = nb.hilbert_bytes(cells, 16)
    assert (nb.hilbert_keys(cells >> 12, 4) == order[:, 0].astype(int) * 256 + order[:, 1]).all()


def test_no_window_ends_at_a_cut(spark, monkeypatch):
    """Stretches of 40 give what one stretch gives; pairs held are cut back to the best on the way."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((20, 96))
    df = spark.createDataFrame([(i, [float(z) for z in centres[i % 20] + 0.4 * rng.standard_normal(96)]) for i in range(500)], "chunk_id long, vec array<float>")
    monkeypatch.setattr(nb, "BLOCK", 1)
    found = []
    for stretch, held, part in ((100_000, 10**6, 10**6), (40, 50, 300)):
        monkeypatch.setattr(nb, "STRETCH", stretch)
        monkeypatch.setattr(nb, "HELD", held)
        monkeypatch.setattr(nb, "PART", part)
        found.append(sorted((r.a, r.b, r["rank"]) for r in nb.nearest(df, curves=2, window=40).collect()))
    assert found[0] == found[1] and len(found[0]) > 500
