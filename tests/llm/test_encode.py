import os
import random

import pytest
import tiktoken

from turnmill.llm.encode import PATTERN, TOKENIZERS, VOCABULARY, Vocabulary, decode_corpus, encode_corpus, vocabulary

pytestmark = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/{VOCABULARY}.tiktoken"), reason="no vocabulary files here")

TEXTS = [
    None, "", " ", "\n\n  x", "don't we'll", "台账、逐字稿。 繁體", "naïve — 🧑‍🔬 1️⃣", "<|endoftext|> [MASK]", "a" * 3000, "日本語ひらがな" * 50, "\r\n\t mixed\x00 12345 ½",
    "word " * 20_000, "zqxjk" * 300, "Проверим очередь", "!!!???***" * 9,
]


def test_same_ids_as_the_public_encoder_and_round_trip(spark):
    v = vocabulary(TOKENIZERS, VOCABULARY)
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([*rows, rows[4]], "doc_id bigint, text string").withColumnRenamed("doc_id", "doc_id")
    out = encode_corpus(df, "doc_id", "text")
    got = out.collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert list(r.ids) == known.encode_ordinary(TEXTS[r.doc_id] or "")
    back = {r.doc_id: r.text for r in decode_corpus(out, "doc_id", "ids").collect()}
    assert back == {i: t or "" for i, t in rows}
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_memory_limit_changes_nothing(monkeypatch):
    from turnmill.llm import encode

    v = encode.Vocabulary(TOKENIZERS, VOCABULARY)
    whole = [list(v.encode([t])[0]) for t in TEXTS]
    monkeypatch.setattr(encode, "MEMORY", 1)
    assert [list(v.encode([t])[0]) for t in TEXTS] == whole


def test_one_query_contracts_pieces_of_every_length():
    v = Vocabulary(TOKENIZERS, VOCABULARY)
    v.contract(list(v.ranks))  # every entry contracts to itself
    assert all(v.pieces[t] == (r,) for t, r in v.ranks.items())
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    some = random.Random(4)
    pieces = ["".join(some.choices("abcdefghij", k=n)).encode() for n in (2, 47, 48, 49, 50, 700, 5000)] + [b"ab" * 900, b"a" * 20_001, "很".encode() * 400]
    v.contract(pieces)
    for p in pieces:
        assert list(v.pieces[p]) == known.encode_ordinary(p.decode())
    v.contract([])


def test_decoding_of_odd_ids():
    v = Vocabulary(TOKENIZERS, VOCABULARY)
    assert v.decode([None, [], [int(v.byte[0xE5])]]) == [None, "", "�"]
    assert v.decode([]) == []
    with pytest.raises(ValueError):
        v.decode([[len(v.ranks) + 5]])
