"""Repeats found inside a block, and those of texts longer than a block."""

from collections import Counter

import pytest

from test_repeats import brute, texts
from vecfold.operators import suffixes as Y


def test_block_repeats():
    for s in [t for t in texts() if t]:
        pos, size, freq = Y._block_repeats(s)
        found = [(s[p - 1 : p - 1 + n], f) for p, n, f in zip(pos, size, freq)]
        expected = brute(s)
        assert len(found) == len(expected) and dict(found) == expected, s[:30]


@pytest.mark.parametrize("block", [0, 95, 1 << 19])
def test_long_texts_are_spread(spark, monkeypatch, block):
    monkeypatch.setattr(Y, "BLOCK_CHARS", block)
    rows = list(enumerate(texts()[-5:])) + [(None, "abab")]
    docs = spark.createDataFrame(rows, "id int, text string")
    found = Counter((r["id"], r["repeat"], r["freq"]) for r in Y.repeats_with_text(docs, "id", "text", 1, 3).collect())
    assert found == Counter((i, w, f) for i, s in rows[:-1] for w, f in brute(s).items() if f >= 3 and w)


def test_short_texts_start_no_rounds(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("short texts were spread")

    monkeypatch.setattr(Y, "order_suffixes", fail)
    docs = spark.createDataFrame(list(enumerate(texts())), "id int, text string")
    got = {r["id"]: r["nodes"] for r in Y.repeat_counts(docs, "id", "text").collect()}
    assert all(got.get(i, 0) == len(brute(s)) for i, s in enumerate(texts()))
