import random

from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import splitting as sp


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .\n\r#`~é́"), max_size=900), st.integers(20, 90))
def test_pieces_are_the_text(text, most):
    parts = sp.pieces(text, most, most // 9, max(1, most // 3))
    assert all(e - s <= most and 0 <= o <= most // 9 for s, e, o, _ in parts)
    assert "".join(text[s + o : e] for s, e, o, _ in parts) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n#`~\r"), max_size=200))
def test_sections_by_the_definition(body):
    got = [(n, s) for n, _, s in sp.sections(body)]
    number, out, own, fence = 0, [], "", ""
    for line in [x + "\n" for x in body.split("\n")[:-1]] + [body.split("\n")[-1]]:
        if fence:
            fence = "" if line[:3] == fence else fence
        elif line[:3] in ("```", "~~~"):
            fence = line[:3]
        elif any(line.startswith("#" * k + " ") for k in (1, 2, 3, 4)):
            out.append((number, own.rstrip()))
            number, own = number + 1, ""
        own += line
    assert got == [*out, (number, own.rstrip())]


def test_an_edit_alters_neighbours_only():
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) + rng.choice(["", "", ".", "\n\n"]) for _ in range(6000))
    before = {text[s:e] for s, e, *_ in sp.pieces(text)}
    edited = text[:9000] + "some new words " + text[9000:]
    after = {edited[s:e] for s, e, *_ in sp.pieces(edited)}
    assert len(before - after) <= 6 and len(before) > 25


def test_natural_boundaries():
    text = ("word " * 60 + "end.\n\n") * 12
    assert {k for *_, k in sp.pieces(text)} <= {"paragraph", "end"}
    assert {k for *_, k in sp.pieces("x" * 5000)} <= {"none", "end"}


def test_table(spark):
    long = "# Head\n" + "A sentence of words. " * 100
    rows = [(1, long, "c"), (1, long, "c"), (2, None, "c"), (3, "", "c"), (4, "short", "c"), (5, "x" * 1400 + "   ", "c"), (6, "```\n# no\n" + "y" * 1500, "c")]
    notes = spark.createDataFrame(rows, "note_id long, body string, piece string")
    out = sp.split_sections(notes).collect()
    assert {(r.note_id, r.section_no, r.heading) for r in out} == {(1, 1, "Head"), (6, 0, None)}
    assert len({(r.note_id, r.section_no, r.piece_no) for r in out}) == len(out)
    assert sp.split_sections(notes.where("false")).count() == 0
