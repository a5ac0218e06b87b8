"""The chance of a word in its class depends on the words before it."""

from __future__ import annotations

import numpy as np
import pytest

from vecfold.llm import language_model as lm


def test_word_chances_are_a_softmax_over_the_words_of_a_class():
    words = [b"w%dx%d" % (i, i % 3) for i in range(300)]
    counts = np.array([1 + (i * i) % 40 if i % 4 else 1 for i in range(len(words))])
    endings = np.fromiter(map(lm.ending, words), np.int64)
    codes = lm.codes_of(words)
    cell = lm.steps_of(counts) * lm.ENDINGS + endings
    cells, at = np.unique((cell * lm.CODES + codes[0]) * lm.CODES + codes[1], return_inverse=True)
    classes = lm.Classes.of_cells(np.stack([cells, np.bincount(at), np.bincount(at, counts)]).astype(np.int64))
    kind = classes.of(counts, endings)
    inside = classes.log_in_class(counts, kind)
    factors = np.exp(np.random.default_rng(3).normal(size=(1, lm.COLUMNS)).astype(np.float32))
    own = factors[0, lm.CLASSES + codes[0]] * factors[0, lm.CLASSES + lm.CODES + codes[1]]
    for c in set(kind.tolist()):
        mine = np.flatnonzero(kind == c)
        goal, rows = np.full(len(mine), c), np.repeat(factors, len(mine), 0)
        got = lm.word_chances(rows, goal, codes[:, mine], counts[mine] > 0, inside[mine], classes)
        rest = 1 / (classes.types[c] + 1) if c < lm.ENDINGS else 0  # the unknown word
        weighed = 10 ** inside[mine] * own[mine]
        total = weighed.sum() + rest
        assert 10**got == pytest.approx(weighed / total, rel=1e-4)
        slopes = np.empty((len(mine), 2 * lm.CODES), np.float32)
        assert lm.inside_sums(rows, goal, classes, slopes)[0] == pytest.approx(total, rel=1e-4)
        wanted = [np.bincount(codes[k][mine], weighed / total, lm.CODES) for k in range(2)]
        assert slopes[0] == pytest.approx(np.concatenate(wanted), abs=1e-5)


def test_words_of_one_class_differ_by_context(spark):
    one, two = "abend", "dbend"  # one class: same ending, same count
    assert lm.ending(one.encode()) == lm.ending(two.encode())
    texts = [f"left {one} right {two} left {one} right {two}"] * 60
    asked = [i for i in range(900, 960) if not lm.is_held_out(i)][:4]
    rows = [*enumerate(texts), *zip(asked, (f"left {one}", f"left {two}", f"right {one}", f"right {two}"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    found = {r.doc_id: r.score for r in lm.scored(docs).collect()}
    fit, unfit = found[asked[0]] + found[asked[3]], found[asked[1]] + found[asked[2]]
    # the chances of the classes and the counts are the same in both sums
    assert fit > unfit + 0.2


def test_sums_by_row():
    chance = np.random.default_rng(5)
    rows = np.concatenate([chance.integers(0, 500, 900), np.full(100, 7), np.full(lm.OFTEN, 600), np.full(lm.OFTEN + 1, 601)])
    values = chance.normal(size=(len(rows), 3))
    which, times, sums = lm.sums_by(chance.permutation(rows), values)
    assert sorted(which.tolist()) == np.unique(rows).tolist() and times.sum() == len(rows)
    which, times, sums = lm.sums_by(rows, values)
    for row, n, total in zip(which, times, sums):
        assert n == (rows == row).sum() and total == pytest.approx(values[rows == row].sum(axis=0))
