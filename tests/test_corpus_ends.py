"""Repeats over a corpus in which each text end is its own continuation."""

from collections import Counter

from vecfold.operators.repeats import corpus_repeats


def test_shared_endings_are_repeats(spark):
    texts = ["one story. all rights reserved", "another tale. all rights reserved", "abracadabra", "cadabra abra", "", None, "abra", "abra"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    freq, docs, after = Counter(), Counter(), {}
    for k, t in enumerate(texts):
        pieces = [(t[p : p + n], t[p + n : p + n + 1] or k) for p in range(len(t or "")) for n in (2, 3, 4) if p + n <= len(t)]
        freq.update(w for w, _ in pieces)
        docs.update({w for w, _ in pieces})
        for w, x in pieces:
            after.setdefault(w, set()).add(x)
    expected = {(w, n, docs[w]) for w, n in freq.items() if docs[w] > 1 and len(after[w]) > 1}
    found = {tuple(r) for r in corpus_repeats(frame, "id", "text", 2, 4, own_ends=True).collect()}
    assert found == expected and ("rved", 2, 2) in found
    assert "rved" not in {r.repeat for r in corpus_repeats(frame, "id", "text", 2, 4).collect()}
