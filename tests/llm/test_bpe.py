import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file")


def encode(texts):
    o, ids = bpe.encoder(bpe.VOCABULARY).encode(texts)
    return [ids[o[i] : o[i + 1]].tolist() for i in range(len(texts))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_round_trip(texts):
    token = bpe.encoder(bpe.VOCABULARY).token
    assert [b"".join(token[i] for i in ids).decode() for ids in encode(texts)] == texts


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=80))
def test_as_the_library(text):
    import base64

    import public_tokenizers as P
    import tiktoken

    global _ref
    if "_ref" not in globals():
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
        _ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert encode([text]) == [_ref.encode_ordinary(text)]


def test_table(spark):
    rows = [(1, "Hello world", "a"), (2, "", "b"), (3, None, "c"), (4, "a" * 100_000, "d"), (4, "<|endoftext|>", "e"), (None, "x", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a column that clashes
    got = [(r.doc_id, len(r.ids)) for r in bpe.encode(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 2), (2, 0), (3, 0), (4, len(encode(["a" * 100_000])[0])), (4, len(encode(["<|endoftext|>"])[0])), (None, 1)], key=str)
    assert bpe.encode(docs.where("false")).count() == 0
    assert [r.n_tokens for r in bpe.token_counts(docs.where("doc_id = 1"), ["doc_id"]).collect()] == [2]


def test_starting_anew(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_PIECES", 3)
    enc = bpe.Encoder(bpe.VOCABULARY)
    for t in ("one two three four", "five six", "one six"):
        o, ids = enc.encode([t, t])
        assert ids[: o[1]].tolist() == ids[o[1] :].tolist() == encode([t])[0]


def test_a_machine_without_the_file_takes_the_one_sent(spark, tmp_path):
    """Where a task's machine has no file at the path, the copy that went with the application is read."""
    sent = tmp_path / "here" / "sent_vocabulary.tiktoken"
    sent.parent.mkdir()
    sent.write_bytes(open(bpe.VOCABULARY, "rb").read())
    bpe.send(spark, str(sent))
    df = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
    got, want = ({r.doc_id: r.ids for r in bpe.encode(df, vocabulary=v).collect()} for v in (str(tmp_path / "elsewhere" / sent.name), bpe.VOCABULARY))
    assert got == want and want[2] == []
