import random

import pytest

from marginalia.operators import sessions

SCHEMA = "entry_id long, at_ms long, agent_id string, action_kind string, entity string, chunk long, start_ms string, n_entries string"


def brute(rows, gap):
    seen, by = set(), {}
    for entry, at, agent, *_ in rows:
        if agent is None or at is None or (entry is not None and (entry, at, agent) in seen):
            continue
        seen.add((entry, at, agent))
        by.setdefault(agent, []).append(at)
    out = []
    for agent, times in by.items():
        times.sort()
        run = [times[0]]
        for t in times[1:]:
            if t - run[-1] > gap:
                out.append((agent, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        out.append((agent, run[0], run[-1], len(run)))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(3))
def test_every_gap_setting_cut_from_one_tree(spark, seed):
    rng = random.Random(seed)
    rows = []
    for agent in ("a", "b", "c"):
        t = 1_640_000_000_000
        for i in range(150):
            t += rng.choice([0, 1, 1000, 1000, 60_000, 3_600_000, 90_000_000])
            rows.append((len(rows), t, agent, rng.choice(["Read", " write ", None])))
    rows += rng.sample(rows, 20)  # delivered twice
    rng.shuffle(rows)
    tree = sessions.gap_tree(frame(spark, rows)).cache()
    for gap in (0, 1, 999, 1000, 60_000, 3_599_999, 3_600_000, 10**9):
        got = sorted(map(tuple, sessions.cut(tree, gap).select("entity", "start_ms", "end_ms", "n_entries").collect()))
        assert got == brute(rows, gap), gap


def test_edges(spark):
    rows = [(1, 5, "a", "READ"), (1, 5, "a", "read"), (None, 5, "a", None), (None, 5, "a", None), (2, None, "a", "read"), (3, 7, None, "read"), (4, -100, "b", "read")]
    log = frame(spark, rows)
    got = sorted(map(tuple, sessions.cut(sessions.gap_tree(log), 10).collect()))
    assert got == [("a", 5, 5, 0, 3), ("b", -100, -100, 0, 1)]
    kinds = sessions.count_kinds(sessions.cut(sessions.gap_tree(log), 10), sessions.entries(log)).collect()
    assert sorted((r.entity, str(r.kind), r.n_of_kind) for r in kinds) == [("a", "None", 2), ("a", "read", 1), ("b", "read", 1)]
    assert sessions.cut(sessions.gap_tree(frame(spark, [])), 10).count() == 0
    with pytest.raises(ValueError):
        sessions.cut(sessions.gap_tree(log), -1)


def test_equal_gaps_keep_the_spine_short(spark):
    rows = [(i, i * 1000, "beat", "x") for i in range(5000)]
    tree = sessions.gap_tree(frame(spark, rows))
    assert [tuple(r) for r in sessions.cut(tree, 1000).collect()] == [("beat", 0, 4_999_000, 4_999_000, 5000)]
    assert sessions.cut(tree, 999).count() == 5000
