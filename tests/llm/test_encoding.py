import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kvizmill.llm.bytebpe import default_vocabulary, encoder
from kvizmill.llm.encoding import document_sizes, encode_documents


@pytest.fixture(scope="module")
def plain():
    """The same vocabulary in an independent library."""
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40))
def test_any_text_as_the_library_and_back(plain, text):
    bpe = encoder(default_vocabulary())
    ids = bpe.encode(text)
    assert ids == plain.encode_ordinary(text)
    assert bpe.decode(ids) == text


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000 + "x", "<|endoftext|>", "ёжиќ 一二 ²Ⅷ", "\r\n\t ", "'s'll 'TIS", "ab" * 20_000])
def test_hard_texts(plain, text):
    assert encoder(default_vocabulary()).encode(text) == plain.encode_ordinary(text)


def test_rows(spark):
    df = spark.createDataFrame([(1, "слон", "x"), (1, "слон", "x"), (2, None, "y"), (3, "", "z"), (None, " ", "w")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in encode_documents(df).collect()), key=str)
    want = encoder(default_vocabulary()).encode
    assert got == sorted([(1, want("слон")), (1, want("слон")), (2, []), (3, []), (None, want(" "))], key=str)
    assert sorted((r.doc_id or 0, r["size"]) for r in document_sizes(df).collect()) == [(0, 1), (1, len(want("слон"))), (1, len(want("слон"))), (2, 0), (3, 0)]
    assert encode_documents(df.where("false")).count() == 0


def test_whole_table(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in encode_documents(docs).collect():
        assert list(r.ids) == plain.encode_ordinary(texts[r.doc_id])
