"""Texts are split once by the language model."""

from __future__ import annotations

from vecfold.llm import language_model


def test_blocks_hold_the_tokens_of_their_texts():
    many = b" ".join(b"w%d" % i for i in range(70_000))
    for texts in ([b"", b" B a\tb\x0bA ", b"\n"], [many, b"W1 w2"]):
        row = language_model._tokenised(7, list(range(len(texts))), texts)
        ((number, tokens, _),) = language_model.tokens_of(row)
        wanted = [[*t.lower().split(), b""] for t in texts]
        assert number == 7 and tokens.words == sorted({w for t in wanted for w in t})
        assert tokens.lengths.tolist() == [len(t) for t in wanted]
        assert [tokens.words[i] for i in tokens.at] == [w for t in wanted for w in t]


def test_language_model_splits_texts_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Some words {i % 3} here") for i in range(40)], "doc_id long, text string")
    blocks, size = language_model.build(docs, language_model.BLOCK_BYTES, language_model._tokenised, language_model.SCHEMA)
    # no later pass can split a text: blocks have none
    assert "data" not in blocks.columns and size == sum(len(f"Some words {i % 3} here") for i in range(40))
    assert language_model.scored(docs).count() == 40
