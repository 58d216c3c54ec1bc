import random

from marginalia.llm import truncation as tr


def kind(t):
    return tr.ending(t)[0]


def test_endings():
    assert kind("All is said.") == kind("Said so. (Ann)") == kind("Is it done? :)") == "whole"
    assert kind("First done. Then the seco") == "cut" and kind("x\n```\ncode") == "cut" and kind("x\n```\ncode\n```") == "whole"
    assert kind("Done. See [[Ann Ke") == "cut" and kind("| a | b |\n| 1 | 2 |") == "whole" and kind("| a | b |\n| 1 | 2") == "cut"
    assert kind("The end of the wor [...]") == "cut" and kind("It is done. [...]") == "whole" and kind("It was sa�") == "cut"
    assert kind("so it goes…") == "dots" and kind("Done. …") == "whole"
    assert kind("- an item") == "item" and kind("Thanks, Ann") == "line" and kind("— Ann") == "other" and kind("#tag #two") == "other"
    assert kind("") == kind("  \n") == "whole"


def test_lengths():
    got = dict(zip(tr.ENCODINGS, tr.lengths('é"\r\n<'), strict=True))
    assert got == {"chars": 5, "utf8": 6, "utf16": 5, "html": 13, "html_utf8": 14, "json": 8, "json_ascii": 13, "lf": 4, "lf_utf8": 5, "crlf": 5, "crlf_utf8": 6}


def test_hidden_limits_and_cases(spark):
    rng = random.Random(4)
    words = "alpha beta gamma delta omega sigma kappa lambda".split()
    sentence = lambda: "The " + " ".join(rng.choices(words, k=rng.randint(3, 9))) + "."
    rows, cut = [], set()
    for i in range(600):
        text = " ".join(sentence() for _ in range(rng.randint(1, 12)))
        if i % 3 == 0:
            text += "\n\n" + "\n".join("- the " + rng.choice(words) for _ in range(4))
        if i % 3 == 1:
            text += rng.choice(["\n\nThanks, Ann", "\n\nEnd of notes"])
        source = "form" if i < 300 else "mail"
        if source == "form" and len(text) > 150:
            text = text[:150]
            if tr.ending(text)[0] != "whole":
                cut.add(i)
        rows.append((i, text, rng.choice([source, source.upper(), f" {source} "])))
    rows += [(900, None, "form"), (901, "", "form"), (902, "The alpha beta", None), (rows[0])]
    cut.add(902)
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, source string, cut string")
    m = tr.measure(df)
    limits = {(r.source, r.encoding, r.limit) for r in tr.hidden_limits(m.dropDuplicates(["key"])).collect()}
    assert ("form", "chars", 150) in limits and not any(s == "mail" for s, *_ in limits)
    out = tr.truncated(df, measured=m)
    got = {r.doc_id for r in out.where("cut").collect()}
    assert len(got & cut) / len(cut) > 0.97 and len(got & cut) / len(got) > 0.97
    rates = {r.source: r for r in tr.truncation_rates(out).collect()}
    assert rates["mail"].n_cut == rates["mail"].n_at_limit == 0 and rates["form"].share > 0.4 and rates["form"].n_at_limit > 0.9 * rates["form"].n_cut
    assert sum(r.n for r in tr.truncation_reasons(out).collect()) == len(got)
    assert tr.truncated(df.where("false")).count() == 0


def test_open_lines_with_rare_beginnings(spark):
    rng = random.Random(7)
    words = "alpha beta gamma delta omega sigma kappa lambda".split()
    some = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, f"Item{i} " + some(30)[:53].ljust(60 - len(f"Item{i} "), "x"), "form") for i in range(20)]  # one sentence, cut at 60
    rows += [(100 + i, f"The {some(rng.randint(3, 30))}.", "form") for i in range(200)]
    rows += [(400 + i, f"The {some(3)}.\nThanks, {some(1 + i % 3)}", "form") for i in range(30)]  # a whole kind of last line
    stop = next(t for n in range(1, 60) if len(t := "The " + "z" * n + ".\nThanks, Ann") == 60)
    rows += [(500, stop, "form")]  # it lies at the limit by chance
    rows += [(600 + i, f"Notably {some(4)}.", "mail") for i in range(10)] + [(700 + i, f"Notably {some(2 + i)}", "mail") for i in range(4)]
    out = {r.doc_id: r.reason for r in tr.truncated(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("cut").collect()}
    assert {i for i, reason in out.items() if reason == "at a limit, open line"} == set(range(20))
    assert set(out) == {*range(20), *range(700, 704)}


def test_two_limits_of_a_source(spark):
    """The smaller limit stands beside the larger one, as other texts lie at it."""
    rng = random.Random(9)
    long = lambda: " ".join(rng.choices("alpha béta gamma délta".split(), k=90))
    rows = [(i, long()[:200].rstrip().ljust(200, "x"), "form") for i in range(100)] + [(200 + i, long()[:90].rstrip().ljust(90, "x"), "form") for i in range(12)]
    rows += [(400 + i, long()[: rng.randint(20, 300)], "form") for i in range(60)]
    found = {(r.encoding, r.limit) for r in tr.hidden_limits(tr.measure(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert found == {("chars", 200), ("chars", 90)}
