"""Conversation trie, vector codes and URL filters against plain Python on small tables of hard cases."""

import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash

from vecfold.llm import prefix_trie, url_filter, vector_codes

# --- URL filters


def py_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    h = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    rest = rest[end:]
    end = min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))
    return h, rest[:end]


def py_rule(h, p):
    best = None
    for k, (verdict, rule) in enumerate(url_filter.RULES):
        rh, rp = rule.split("/", 1)
        rp = "/" + rp
        if (h == rh or h.endswith("." + rh)) and p.startswith(rp):
            if best is None or len(rule) > len(best[1]):
                best = (verdict, rule)
    return best


def py_features(h, p):
    out = []
    for side, text in (("h", h), ("p", p)):
        padded = "^" + text + "$"
        for n in url_filter.NGRAMS:
            for i in range(max(len(padded) - n + 1, 1)):
                seed = xxhash.xxh64_intdigest(side.encode(), 42)
                out.append(xxhash.xxh64_intdigest(padded[i:i + n].encode(), seed) % url_filter.BUCKETS)
    return out, 1 / math.sqrt(len(out))


def py_fit(rows, steps):
    w = np.zeros(url_filter.BUCKETS + 1)  # last: bias
    v = np.zeros_like(w)
    feats = [(py_features(*py_host_path(u)), y) for u, y in rows if y is not None]
    seen = np.zeros(len(w), bool)
    for (fs, x), _ in feats:
        seen[fs] = True
    seen[-1] = True
    for _ in range(steps):
        g = np.zeros_like(w)
        for (fs, x), y in feats:
            m = sum(w[f] * x for f in fs) + w[-1]
            err = 1 / (1 + math.exp(-m)) - y
            for f in fs:
                g[f] += err * x
            g[-1] += err
        g /= max(1, len(feats))
        v = np.where(seen, url_filter.MOMENTUM * v - url_filter.RATE * (g + url_filter.L2 * w), 0)
        w = w + v
    return w


def py_probability(w, url):
    (fs, x) = py_features(*py_host_path(url))
    return 1 / (1 + math.exp(-(sum(w[f] * x for f in fs) + w[-1])))


URLS = [
    (1, "https://www.Example.NET/en/a?x=1#y"), (2, "http://shop.example.net/de/b"), (3, "https://example.com/de/x"),
    (4, "https://a.example.com/en/x"), (5, "http://b.example.org/fr/z"), (6, "http://b.example.org/en/z"),
    (7, None), (8, "no scheme here"), (9, ""), (10, "ftp://net/"), (11, "https://EXAMPLE.COM/DE/x"),
    (12, "http://a://b/c"), (13, "https://host.net"), (14, "https://sub.example.net/en/"), (14, "https://sub.example.net/en/"),
    (15, "https://xnet/"), (None, "https://z.org/fr/"), (16, "http://日本.example.org/fr/ü?q#f"),
]


def test_url_rules_and_model_against_python(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumn("verdict", url_filter.F.lit("clash"))
    labelled = [(u, y) for u, y in [
        ("https://spam.example.net/x", 1), ("https://ok.example.org/fr/a", 0), ("https://a.example.com/de/q", 1),
        ("https://b.example.net/en/p", 0), ("https://c.example.org/fr/b", 0), ("http://d.net/", 1), (None, 1), ("x", None),
    ]]
    steps = 4
    model = url_filter.fit(spark.createDataFrame(labelled, "url string, label int"), steps=steps)
    w = py_fit(labelled, steps)
    got = url_filter.judge(pages, model).collect()
    assert len(got) == len(URLS)
    for r in got:
        h, p = py_host_path(r.url)
        assert (r.host, r.path) == (h, p), r.url
        rule = py_rule(h, p)
        assert r.rule == (rule and rule[1])
        assert r.block_probability == pytest.approx(py_probability(w, r.url), abs=1e-9)
        model_verdict = "block" if r.block_probability > 0.5 else "allow"
        assert r.verdict == (rule[0] if rule else model_verdict)


def test_url_filter_on_no_rows(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    model = url_filter.fit(url_filter.rule_labelled(empty), steps=2)
    assert url_filter.judge(empty, model).count() == 0
    lone = spark.createDataFrame([(1, "https://a.example.com/x")], "page_id long, url string")
    assert url_filter.judge(lone, model).first().verdict == "allow"


def test_rule_labelled_is_bounded(spark):
    pages = spark.createDataFrame([(i, f"https://h{i}.example.net/x") for i in range(50)], "page_id long, url string")
    assert url_filter.rule_labelled(pages, most=7).count() == 7


# --- conversation trie


def py_trie(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, role or "", text or ""))
    ordered = {c: [(r, x) for _, r, x in sorted(v, key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))] for c, v in convs.items()}
    built = {}
    for c in ordered:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = ordered.get(c - int(math.fmod(c, 5)), [])[:h] + ordered[c][h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for prefix, members in nodes.items():
        children = [p for p in nodes if len(p) == len(prefix) + 1 and p[:-1] == prefix]
        subtree = [p for p in nodes if p[: len(prefix)] == prefix]
        leaves = sum(1 for p in subtree if not any(len(q) == len(p) + 1 and q[:-1] == p for q in nodes))
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in subtree if p)
        ends = sorted(c for c in members if len(built[c]) == len(prefix))
        out[min(members), len(prefix)] = (
            None if not prefix else min(nodes[prefix[:-1]]), len(members), len(children), leaves, saved,
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def trie_rows():
    said = ["hi", "hello", "", "a much longer text é" * 200, "ok"]
    rows = []
    for c in range(0, 23):
        for t in range(c % 6):
            rows.append((c, t, ["user", "assistant"][t % 2], said[(c * t) % len(said)] if c % 4 else said[t % 3]))
    rows += [(7, None, None, None), (8, 2, "user", "hello"), (8, 2, "user", "hello"), (None, 1, "user", "x"), (40, 0, "user", "hi"), (41, None, "user", None)]
    rows += [(100 + c, t, "user", "same") for c in range(12) for t in range(3)]  # many copies
    return rows


@pytest.mark.parametrize("per_shard", [1_000_000, 7])
def test_trie_against_python(spark, per_shard, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TURNS_PER_SHARD", per_shard)
    rows = trie_rows()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", url_filter.F.lit("x"))
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
           for r in prefix_trie.trie(frame).collect()}
    want = py_trie(rows)
    assert got == want
    assert prefix_trie.trie(frame).count() == len(want)


def test_trie_on_no_rows(spark):
    assert prefix_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- vector codes


def py_codes(rows):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == d]
    m = d // 4
    x = [[math.floor(1024 * float(c)) for c in v] for _, v, _ in kept]
    books = [[row[j * m:(j + 1) * m] for row in x[:256]] for j in range(4)]

    def nearest(p, book):
        dists = [sum((a - b) ** 2 for a, b in zip(p, e)) for e in book]
        best = min(dists)
        return dists.index(best), best

    for _ in range(4):
        sums = [[None] * len(books[j]) for j in range(4)]
        for row in x:
            for j in range(4):
                k, _ = nearest(row[j * m:(j + 1) * m], books[j])
                s = sums[j][k] or [0] * (m + 1)
                sums[j][k] = [a + b for a, b in zip(s, row[j * m:(j + 1) * m] + [1])]
        for j in range(4):
            for k, s in enumerate(sums[j]):
                if s:
                    books[j][k] = [a // s[-1] for a in s[:-1]]
    out = []
    for (i, _, lab), row in zip(kept, x):
        found = [nearest(row[j * m:(j + 1) * m], books[j]) for j in range(4)]
        out.append((i, "".join(f"{k:02x}" for k, _ in found), sum(e for _, e in found), lab))
    by_label = {}
    for i, _, e, lab in out:
        by_label[lab] = by_label.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(i, c, e, by_label[lab]) for i, c, e, lab in out], digest


def test_vector_codes_against_python(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(0, 0.3, 8)], int(i % 3) if i % 7 else None) for i in range(300)]
    rows += [(5, rows[5][1], 1), (None, [0.1] * 8, 2), (900, None, 1), (901, [0.1, None] + [0.0] * 6, 1),
             (902, [float("nan")] + [0.0] * 7, 1), (903, [float("inf")] + [0.0] * 7, 0), (904, [0.0] * 4, 1)]
    rows += [(1000 + i, [1000.0] * 8, 1) for i in range(3)]  # far away and tied
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", url_filter.F.lit(1))
    coded, books = vector_codes.encode(frame)
    got = [(r.vec_id, r.code, r.error, r.label_error) for r in coded.collect()]
    want, digest = py_codes(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert vector_codes.books_digest(books) == digest


def test_vector_codes_cells_only_skip_dominated():
    rng = np.random.default_rng(5)
    book = rng.integers(-600, 600, (256, 16))
    points = rng.integers(-600, 600, (500, 16))
    codes, dists, seen = vector_codes.assign_part(points, book)
    full = ((points[:, None, :] - book[None]) ** 2).sum(2)
    assert (dists == full.min(1)).all() and (codes == full.argmin(1)).all()
    assert seen["pairs"] < len(points) * len(book)


def test_vector_codes_on_no_rows(spark):
    coded, books = vector_codes.encode(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert coded.count() == 0 and books == []


# --- packing's word cache


def test_word_cache_keeps_two_generations(monkeypatch):
    import public_tokenizers

    from vecfold.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    ids = packing._Ids(path)
    encode = packing.tokenizer(path).encode
    for word in [f"word{i % 7}".encode() for i in range(40)] + ["ünïcode".encode(), b""]:
        assert ids[word] == np.array(encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        assert len(ids.young) <= 3 and len(ids.old) <= 3
