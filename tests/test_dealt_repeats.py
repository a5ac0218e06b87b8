"""Repeats over a corpus whose pieces are dealt in runs by their least gram."""

import random
from collections import Counter

import pytest

from vecfold.operators import repeats as X


def rows():
    rng = random.Random(8)
    shared = "".join(rng.choice("abé𝄞 d") for _ in range(70))
    texts = [shared[:40] + "x", "y" + shared + "é", shared, shared, "-" * 700, "q" + "-" * 90, "ab" * 60, "", None, "short", "z" * 12, "z" * 12]
    texts += ["".join(rng.choice("ab") for _ in range(300)) for _ in range(6)]
    # a repeated and a missing id
    return [*enumerate(texts), (1, shared), (None, shared[5:60]), (None, "ab" * 20)]


@pytest.mark.parametrize("held", [1 << 17, 2])
@pytest.mark.parametrize("low, high, own", [(12, 14, False), (16, 16, True), (32, 32, False)])
def test_dealt_repeats(spark, monkeypatch, low, high, own, held):
    # groups of pieces are held together, alone, or passed on as too large
    monkeypatch.setattr(X, "HELD", held)
    monkeypatch.setattr(X, "RUN", 20)
    freq, docs, after = Counter(), {}, {}
    for i, t in rows():
        for p in range(len(t or "")):
            for n in range(low, min(high, len(t) - p) + 1):
                w = t[p : p + n]
                freq[w] += 1
                docs.setdefault(w, set()).add(i)
                after.setdefault(w, set()).add(t[p + n : p + n + 1] or (i if own else ""))
    expected = {(w, n, len(docs[w])) for w, n in freq.items() if len(docs[w]) > 1 and len(after[w]) > 1}
    frame = spark.createDataFrame(rows(), "id long, text string")
    found = [tuple(r) for r in X.corpus_repeats(frame, "id", "text", low, high, own_ends=own).collect()]
    assert expected and len(found) == len(set(found)) and set(found) == expected


def test_texts_travel_as_a_few_characters_per_position(spark):
    rng = random.Random(9)
    texts = [(k, "".join(rng.choice("abcdefgh ") for _ in range(3000))) for k in range(5)]
    frame = spark.createDataFrame(texts, "id long, text string")
    runs = X.dealt_runs(frame, "id", "text", 32, 32).selectExpr("sum(_n) AS n", "sum(length(_body)) AS c").first()
    assert runs["n"] == 5 * (3000 - 31) and runs["c"] < 6 * runs["n"]
    plan = X.corpus_repeats(frame, "id", "text", 32, 32)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2
    kept = X.shared_runs(X.dealt_runs(frame, "id", "text", 32, 32).repartition(3, "_m"), "id", 32, 32)
    assert kept.count() == 0
