import random
from collections import Counter, defaultdict

import pytest

from vecfold.operators import repeats as X
from vecfold.operators import suffixes as Y


def brute(s, max_len=None):
    freq, ways = Counter(), defaultdict(set)
    for p in range(len(s)):
        for n in range(0, min(len(s) - p, max_len if max_len is not None else len(s)) + 1):
            w = s[p : p + n]
            freq[w] += 1
            ways[w].add(s[p + n : p + n + 1])
    return {w: f for w, f in freq.items() if f >= 2 and len(ways[w]) >= 2}


GOLDEN = {
    "abracadabra": {"abra": 2, "a": 5, "bra": 2, "ra": 2, "": 11},
    "": {}, "a": {}, "ab": {"": 2}, "aaa": {"a": 3, "aa": 2},
    "banana$band$$": {"": 13, "a": 4, "n": 3, "$": 3, "an": 3, "na": 2, "ana": 2, "ban": 2},
}


def texts():
    rng = random.Random(4)
    out = list(GOLDEN) + ["a" * 150, "ab" * 60, "é€𝄞" * 20 + "é", "xyz" + "q" * 40 + "xyz"]
    for alphabet, n in (("ab", 120), ("abc", 90), ("né𝄞", 70), ("abcdefghij", 200)):
        out.append("".join(rng.choice(alphabet) for _ in range(n)))
    block = "".join(rng.choice("abcdefgh ") for _ in range(90))
    out.append(block + "1" + block + "2" + block)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(texts())), "id int, text string")


def collected(df):
    out = defaultdict(dict)
    for r in df.collect():
        assert r["repeat"] not in out[r["id"]]
        out[r["id"]][r["repeat"]] = r["freq"]
    return out


def test_goldens_are_the_definition():
    assert all(brute(s) == want for s, want in GOLDEN.items())


def test_all_repeats(docs):
    got = collected(Y.repeats_with_text(docs, "id", "text"))
    for i, s in enumerate(texts()):
        assert got[i] == brute(s), s[:30]


def test_bounded_repeats(docs):
    got = collected(X.repeats(docs, "id", "text", 0, 5))
    for i, s in enumerate(texts()):
        assert got[i] == brute(s, 5), s[:30]


def test_chunks_do_not_cut_repeats(spark, monkeypatch):
    monkeypatch.setattr(X, "CHUNK", 7)
    s = texts()[-2]
    got = collected(X.repeats(spark.createDataFrame([(0, s)], "id int, text string"), "id", "text", 2, 6))
    assert got[0] == {w: f for w, f in brute(s, 6).items() if len(w) >= 2}


def test_suffix_order_and_prefixes(docs):
    ranks, lcps = defaultdict(dict), defaultdict(dict)
    for r in Y.suffix_rank(docs, "id", "text").collect():
        ranks[r["id"]][r["rank"]] = r["pos"]
    for r in Y.adjacent_prefixes(docs, "id", "text").collect():
        lcps[r["id"]][r["pos"]] = r["lcp"]
    assert [ranks[0][i] - 1 for i in range(11)] == [10, 7, 0, 3, 5, 8, 1, 4, 6, 9, 2]
    for i, s in enumerate(texts()):
        order = sorted(range(len(s)), key=lambda p: s[p:])
        assert [ranks[i][k] - 1 for k in range(len(s))] == order
        for k, p in enumerate(order):
            n, prev = 0, s[order[k - 1] :] if k else ""
            while n < min(len(prev), len(s) - p) and prev[n] == s[p + n]:
                n += 1
            assert lcps[i][p + 1] == n


def test_counts(docs):
    got = {r["id"]: r["nodes"] for r in Y.repeat_counts(docs, "id", "text").collect()}
    assert got[0] == 5
    assert all(got.get(i, 0) == len(brute(s)) for i, s in enumerate(texts()))
