"""The near-duplicates stage against plain Python."""

from collections import Counter

import pytest

import corpus_pipeline
from conftest import SCHEMA
from vecfold.llm import near_copies, simhash


def text(seed: int, n: int = 150) -> list[str]:
    return [f"w{seed}x{k * k % 997}" for k in range(n)]


def changed(words: list[str], *at: int) -> list[str]:
    return [f"new{k}" if k in at else w for k, w in enumerate(words)]


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def cases():
    texts = []
    for seed in range(12):
        base = text(seed)
        # similarities of about 0.93, 0.87 and 0.81, then 0.76 and 0.5
        for at in ((), (20,), (20, 60), (20, 60, 100), (20, 60, 100, 140), range(0, 150, 15)):
            texts.append(" ".join(changed(base, *at)))
        # a chain: each is similar to the one before it only
        texts += [" ".join(text(seed + 100)[k : k + 120]) for k in range(0, 30, 10)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (900, ""), (901, None), (902, "one two"), (3, texts[3]), (903, "ONE two")]


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    tree = list(range(len(rows)))

    def root(i):
        while tree[i] != i:
            i = tree[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 5 * both >= 4 * either:
                x, y = root(a), root(b)
                tree[max(x, y)] = min(x, y)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(root(k), []).append(i)
    return Counter(min((i for i in g if i is not None), default=None) for g in groups.values())


def test_the_stage_removes_near_copies(spark):
    rows = cases()
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    kept = Counter(r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").collect())
    assert kept == expected(rows)
    # a pair that fingerprints do not link
    a, b = " ".join(text(0)), " ".join(changed(text(0), 20, 60, 100))
    assert (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > simhash.THRESHOLD
    assert near_copies.similar(near_copies.shingle_set(a), near_copies.shingle_set(b))


@pytest.mark.parametrize("chunk", [2, 500])
def test_links_do_not_depend_on_chunks(spark, chunk):
    # one bucket for all texts: the pairs inside it are compared in blocks
    rows = [(k, " ".join(changed(text(1), *at))) for k, at in enumerate(((), (20,), (20, 60), range(0, 150, 9), range(0, 150, 8)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    codes = [int(near_copies.xxhash.xxh64_intdigest(near_copies.shingle_set(t).tobytes())) for _, t in rows]
    codes = [c - (1 << 64) if c >> 63 else c for c in codes]
    tagged = docs.selectExpr("doc_id", "xxhash64(text) AS tag").collect()
    signed = spark.createDataFrame(
        [(r.doc_id, r.tag, codes[r.doc_id], [7]) for r in tagged], "doc_id long, tag long, code long, keys array<long>")
    links = {frozenset((r.a, r.b)) for r in near_copies.near_links(docs, signed, chunk).collect()}
    near = {frozenset((codes[a], codes[b])) for a in range(5) for b in range(a) if near_copies.similar(
        near_copies.shingle_set(rows[a][1]), near_copies.shingle_set(rows[b][1]))}
    linked = set().union(*near)
    assert links <= near and set().union(*links) == linked and len(links) >= len(linked) - 1


def test_an_empty_table(nothing):
    assert near_copies.one_per_group(nothing).count() == 0
