import random
import time
from itertools import permutations

from marginalia.llm import name_variants as nv

NICK = [("Elizabeth", "Liz"), ("William", "Bill")]


def run(spark, rows, aliases=None):
    names = spark.createDataFrame([(*r, None, "x") for r in rows], "name_id long, name_text string, path string, origin string, entity_kind string, core string")
    nick = spark.createDataFrame(NICK, "given_name string, nickname string")
    al = None if aliases is None else spark.createDataFrame(aliases, "path string, aliases array<string>")
    e = nv.entities(names, nick, al)
    out = {}
    for r in e.collect():
        out.setdefault(r.entity, set()).add(r.name_id)
    return sorted(map(sorted, out.values())), e


def test_tokens():
    assert nv.tokens("Dr. Elizabeth  Hinmirsał ") == ["elizabeth", "hinmirsal"]
    assert nv.tokens("Kemral Pradan Instruments L.L.C.") == ["kemral", "pradan", "instruments"]
    assert nv.tokens("KemralPradan Int'l, S.A.") == ["kemral", "pradan", "intl"]
    assert nv.tokens("Pravandan, C.W.") == ["pravandan", "c", "w"]
    assert nv.tokens("n/a") == nv.tokens("???") == nv.tokens(" ") == nv.tokens(None) == []
    assert nv.one_edit("ab", "ba") and nv.one_edit("abc", "abxc") and not nv.one_edit("abc", "abc") and not nv.one_edit("abcd", "badc")
    assert nv.shortens("mfg", "manufacturing") and not nv.shortens("abc", "abcd")


def test_variants_of_one_entity(spark):
    same = ["Elizabeth Quinlorwes", "Elizabeth Quinlorwes", "QUINLORWES, ELIZABETH", "Liz Quinlorwes", "E. Quinlorwes", "Quinlorwes, E.B.", "Elizabeth B. Quinlorwes", "Elizabeth Quinolrwes", "ElizabethQuinlorwes", "elizabeth_quinlorwes", "Dr. Elizabeth Quïnlorwes"]
    other = ["William Quinlorwes", "Bill Quinlorwes", "W. Quinlorwes"]
    rows = [(i, n, None, "mention") for i, n in enumerate(same)] + [(100 + i, n, None, "mention") for i, n in enumerate(other)]
    rows += [(200, "unknown", None, None), (201, None, None, None), (202, "", None, None), rows[0], (None, "Elizabeth Quinlorwes", None, None)]
    groups, e = run(spark, rows)
    assert groups == [list(range(len(same))), [100, 101, 102]]
    pairs = nv.variant_pairs(e)
    assert pairs.count() == 55 + 3 and nv.variant_pairs(e, expand=3).where("name_a = 0").count() == 10


def test_initials_follow_the_title_or_stay_alone(spark):
    rows = [(1, "Josephine Hinmirsal", None, "mention"), (2, "Jonathan Hinmirsal", "P/J. Hinmirsal.md", "alias"), (3, "J. Hinmirsal", "P/J. Hinmirsal.md", "title"), (4, "J. Hinmirsal", None, "mention")]
    assert run(spark, rows)[0] == [[1], [2, 3], [4]]


def test_aliases_and_empty(spark):
    rows = [(1, "Kemral Pradan Instruments", "O/K.md", "title"), (2, "Quite Other Words", None, "mention")]
    assert run(spark, rows, [("O/K.md", ["Quite Other Words"]), (None, ["x y"]), ("p", None)])[0] == [[1, 2]]
    assert run(spark, [])[0] == []


def test_pairs_between_spellings_of_a_large_entity(spark):
    text = {i: ["Ann Ode", "A. Ode", "Ann Odde"][i % 3] for i in range(30)}
    members = spark.createDataFrame([(i, "e") for i in text] + [(40, "f"), (41, "f")], "name_id long, entity string")
    names = spark.createDataFrame([*text.items(), (40, "B"), (41, "B")], "name_id long, name_text string")
    got = [(r.name_a, r.name_b) for r in nv.variant_pairs(members, 10, names).collect()]
    assert sorted(got) == sorted({(0, 1), (0, 2), (1, 2), (40, 41)} | {(i % 3, i) for i in range(3, 30)})
    assert len(nv.variant_pairs(members, 10).collect()) == 29 + 1


def test_assignment_is_least():
    rng = random.Random(3)
    for rows, cols in [(1, 1), (2, 2), (3, 3), (3, 5), (5, 5), (4, 6)]:
        for _ in range(40):
            cost = [[float(rng.choice([0, 1, 2, 5, nv.FAR])) for _ in range(cols)] for _ in range(rows)]
            total, chosen = nv.assign(cost)
            assert len(set(chosen)) == rows and sum(cost[r][c] for r, c in enumerate(chosen)) == total
            assert total == min(sum(cost[r][c] for r, c in enumerate(p)) for p in permutations(range(cols), rows))
    assert nv.assign([]) == (0, [])


def test_alignment_of_tokens():
    assert nv.aligned([["bill", "william"], ["quin"]], ["quin", "william"]) == 1
    assert nv.aligned([["a1", "b1"], ["b1", "c1"]], ["b1", "c1"]) == 2 and nv.aligned([["a1"], ["b1"]], ["a1", "c1"]) is None and nv.aligned([["a1"]], ["a1", "b1"]) is None
    assert nv.abbreviates(["quin"], ["e", "b"], ["elizabeth", "quin"]) and nv.abbreviates(["quin"], ["e", "b"], ["beth", "elizabeth", "quin"])
    assert not nv.abbreviates(["quin"], ["b", "e"], ["elizabeth", "quin"]) and not nv.abbreviates(["quin"], [], ["quin"]) and not nv.abbreviates(["quin", "x"], ["e"], ["elizabeth", "quin"])


def test_long_names_take_no_longer():
    parts = [[f"w{i}", *(f"w{i}v{k}" for k in range(6))] for i in range(12)]
    began = time.time()
    assert nv.aligned(parts, [f"w{i}v{i % 6}" for i in reversed(range(12))]) == 12
    assert time.time() - began < 0.05


def test_evidence_does_not_depend_on_the_size_of_the_table(spark):
    """Slips are told from other names by shares: twenty times as many rows give the same entities."""
    names = ["Kathryn Galmar"] * 2 + ["Kathrynn Galmar"] + ["Anna Dorvel"] * 3 + ["Anne Pelzim"] * 3 + ["Anne Dorvel"] + ["Lia Korben"] * 3 + ["Liaa Korben"] * 2 + ["Bo Xi", "Bob Xu"]

    def entity_names(times):
        groups, _ = run(spark, [(i, n, None, "mention") for i, n in enumerate(names * times)])
        return sorted({tuple(sorted({names[i % len(names)] for i in g})) for g in groups})

    once = entity_names(1)
    assert once == entity_names(20)
    assert ("Kathryn Galmar", "Kathrynn Galmar") in once and ("Lia Korben", "Liaa Korben") in once and ("Bo Xi",) in once and ("Anne Pelzim",) in once


def test_pairs_hold_no_plan_of_the_entities(spark):
    names = spark.createDataFrame([(i, t, None, "body") for i, t in enumerate(["Jane Smith", "Jane Smiht", "J. Smith", "Ann Lee"])], "name_id long, name_text string, path string, origin string")
    nick = spark.createDataFrame([("jane", "janie")], "given_name string, nickname string")
    plan = nv.variant_pairs(nv.entities(names, nick), names=names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 60  # 218 with the plan of the entities in each branch
