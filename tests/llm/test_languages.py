from pyspark.sql import functions as F

from marginalia.llm import languages as lg

EN = ["the old report was sent to the office", "we will write the new plan for the team", "this is what the people of the house said about it"]
DE = ["der alte bericht wurde an das büro geschickt", "wir werden den neuen plan für die gruppe schreiben", "das ist was die leute aus dem haus darüber sagten"]
CODES = [("en", "eng", "English", "English"), ("de", "deu", "German", "Deutsch")]


def model():
    return lg.fit([("en", " ".join(EN) + ".")] * 5 + [("de", " ".join(DE) + ".")] * 5 + [("en", " ".join(DE) + ".")], ["de", "en"])


def test_labels(spark):
    codes = spark.createDataFrame(CODES, "code string, code3 string, english_name string, own_name string")
    rows = [("EN", "en"), ("en_US", "en"), ('"Deutsch"', "de"), ("de-AT", "de"), ("deu", "de"), ("und", None), ("", None), (None, None), ("n/a", None), ("fr", None)]
    df = spark.createDataFrame(rows, "l string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", lg.label_code(F.col("l"), codes)).collect())
    fm = spark.createDataFrame([("type: x\r\nLanguage: \"en\"\r\n",), ("lang:\nfoo: de",), (None,)], "f string")
    assert [r.v for r in fm.select(lg.front_matter_label(F.col("f")).alias("v")).collect()] == ['"en"', None, None]


def test_paragraphs():
    text = "# Title\n\nOne sentence here is long enough.\n  \n- item one\n- item two\n\n```\ncode\n\nmore\n```\n\n| a | b |"
    assert [(n, k) for n, k, _ in lg.paragraphs(text)] == [(1, lg.NONE), (2, lg.SENTENCES), (3, lg.PHRASES), (4, lg.NONE), (5, lg.NONE), (6, lg.NONE)]


def test_words_and_backoff():
    m = model()
    s, letters, words = m.totals(["the report of the team", "der bericht für die gruppe", "geschriebene gruppen", ""])
    assert [m.langs[i] for i in s.argmax(1)[:3]] == ["en", "de", "de"] and letters[3] == words[3] == 0
    assert lg.posterior(s)[0].max() > 0.9


def test_cases(spark):
    en, de = "The old report was sent to the office.", "Der alte Bericht wurde an das Büro geschickt."
    rows = [(1, en, "en"), (2, en, "de"), (3, en + " " + en + "\n\n" + de, None), (4, "", None), (5, None, None), (6, "```\nthe office\n```", None), (7, "\n\n" + de, "de"), (2, en, "de"), (None, en, None)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, main string")
    out = lg.cases(lg.languages(df, "doc_id", "text", model(), [F.col("lang")]))
    assert sorted((r.rec_id, r.para_no, r["lang"]) for r in out.collect()) == [(2, 0, "en"), (3, 0, "en"), (3, 2, "de")]
    assert lg.languages(df.where("false"), "doc_id", "text", model()).count() == 0
    assert len(lg.sample(df, "doc_id", "text", F.col("lang"), 100)) == 4 and lg.fit([], ["de", "en"]).totals(["x"])[0].shape == (1, 2)
