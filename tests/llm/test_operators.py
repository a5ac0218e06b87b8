"""Every corpus operator against plain Python on a small table of hard cases, and on no rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from vecfold.llm import language_model, mixing, packing, quality_rules, rule_ensemble, secret_scan, simhash
from vecfold.llm import suffix_dedup, topk, toxicity

GAP = re.compile(r"[\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def split(text):
    return [w for w in GAP.split(text or "") if w]


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def by_row(frame, *columns):
    """Rows as a multiset, since ids repeat."""
    return Counter(tuple(r[c] for c in columns) for r in frame.collect())


# --- toxicity


def test_toxicity_learns_and_scores_every_row(spark, docs, nothing):
    texts = [(i, f"you are {'a vile pest' if i % 2 else 'a kind friend'} number{i}") for i in range(60)]
    train = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts] + [(None, 1), (3, None)], "doc_id long, label int")
    model = toxicity.fit(train, labels)
    found = train.select("doc_id", toxicity.score(model).alias("p")).collect()
    assert all((r.p >= 0.5) == bool(r.doc_id % 2) for r in found)
    scores = docs.select("doc_id", toxicity.score(model).alias("p")).collect()
    assert len(scores) == 14 and all(0 < r.p < 1 for r in scores)
    assert nothing.select(toxicity.score(model)).count() == 0
    assert toxicity.fit(nothing, labels)[1] == {}


def test_toxicity_is_made_indifferent_to_groups():
    pack = lambda ws: np.unique(np.array([toxicity.bucket(w) for w in ws], np.uint32)).tobytes()
    own, other, label = [], [], []
    for i in range(60):
        toxic = i % 2 == 0
        words = {b"women" if toxic else b"men", b"awful" if toxic and i % 4 else b"fine", b"talk%d" % (i % 5)}
        own.append(pack(words)), other.append(pack(toxicity.swapped(words, toxicity.swaps()))), label.append(float(toxic))
    gap = {}
    for penalty in (0.0, 5.0):
        weights = toxicity.fit_rows(own, other, np.array(label), penalty=penalty)[1]
        gap[penalty] = abs(weights.get(toxicity.bucket(b"women"), 0.0) - weights.get(toxicity.bucket(b"men"), 0.0))
    assert gap[0.0] > 1 and gap[5.0] < 0.25 * gap[0.0]


# --- secrets


def test_secret_spans(docs, rows, nothing):
    found = secret_scan.scan(docs, VOCABULARY)
    expected = Counter()
    for i, text, *_ in rows:
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(
            r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.A | re.I) if len(m[2]) > 5]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        spelled = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        counts = Counter(k for _, k, _ in spans)
        expected[i, counts[0], counts[1], counts[2], hashlib.sha256(spelled.encode()).hexdigest()] += 1
    assert by_row(found, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == expected
    assert secret_scan.scan(nothing, VOCABULARY).count() == 0


@pytest.mark.parametrize("text, hit", [
    ("a key x9Qk2LpV7tRz4WmB8nYc here", True),
    ("the id 123e4567-e89b-12d3-a456-426614174000 here", False),
    ("md5 d41d8cd98f00b204e9800998ecf8427e here", False),
    ("internationalisation_of_documents2024 here", False),
    ("an unbelievablylongwordwithoutdigits here", False),
])
def test_hard_to_spell(text, hit):
    assert bool(secret_scan.random_spans(text, secret_scan.encoder(VOCABULARY))) == hit


def test_mask():
    assert secret_scan.mask("ab secret cd", [(3, 0, 9), (5, 2, 9)]) == "ab [SECRET] cd"


# --- packing


def test_packing_is_a_round_trip(docs, rows, nothing):
    from tokenizers import Tokenizer

    tokenizer, expected = Tokenizer.from_file(TOKENIZER), Counter()
    for i, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected[i, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    found = packing.pack(docs, TOKENIZER)
    assert by_row(found, "doc_id", "piece", "start", "length", "ids_crc32") == expected
    laid = {}
    for r in found.collect():
        laid.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in laid.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(nothing, TOKENIZER).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(rng.integers(1, 65, [5, 300, 5000, 40][seed]) ** (1 + seed % 2) % 64 + 1, minlength=65)
    runs = packing.plan(counts, 64)
    used = np.zeros(1 + int((runs[:, 3] + runs[:, 2]).max()), int)
    for length, _, count, first, offset in sorted(runs.tolist(), key=lambda r: r[4]):
        assert (used[first : first + count] == offset).all()
        used[first : first + count] += length
    for length in range(65):
        mine = runs[runs[:, 0] == length]
        assert mine[:, 2].sum() == counts[length]
        assert (np.append(0, np.cumsum(mine[:, 2])[:-1]) == mine[:, 1]).all() if len(mine) else True
    assert used.max() <= 64
    if seed % 2 == 0:  # all lengths occur; of squares alone no tight packing need exist
        assert (used > 0).sum() <= 1.02 * math.ceil((counts * np.arange(65)).sum() / 64) + 2


# --- passages


def without_repeats(rows):
    last = 1 << 62
    texts = [(last if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    low = {}
    for i, t in texts:
        for k in range(len(t) - 49):
            low[t[k : k + 50]] = min(i, low.get(t[k : k + 50], last))
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if low[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        yield None if i == last else i, len(t), sum(gone), spans, kept


def test_passages_against_all_strings(docs, rows, nothing):
    found = suffix_dedup.dedup(docs)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    got = Counter((*(r[c] for c in columns[:-1]), bytes(r.kept)) for r in found.collect())
    assert got == Counter(without_repeats(rows))
    assert suffix_dedup.dedup(nothing).count() == 0


@pytest.mark.parametrize("runs", [1, 2, 3, 5, 8])
def test_merge_of_runs(runs):
    rng = np.random.default_rng(runs)
    pieces = []
    for _ in range(runs):
        rows = rng.integers(97, 99, (40, suffix_dedup.WIDTH), dtype=np.uint8)
        rows[:, 8:] = 97
        rows = np.unique(rows, axis=0)
        blob = suffix_dedup.front_coded(rows, np.arange(len(rows)))
        shared, low, records = suffix_dedup.decoded(blob)
        assert records == [r.tobytes() for r in rows] and low.tolist() == list(range(len(rows)))
        pieces.append((shared, records))
    run, place, lcp = suffix_dedup.merge(pieces)
    merged = [pieces[r][1][p] for r, p in zip(run, place)]
    assert merged == sorted(x for _, records in pieces for x in records)
    for a, b, known in zip(merged, merged[1:], lcp[1:]):
        assert known == next((k for k in range(len(a)) if a[k] != b[k]), len(a))


# --- quality rules


def test_quality_rules(spark, docs, rows, nothing):
    ratios = quality_rules.fit_ratios(docs, spark.createDataFrame([(0,), (2,), (None,)], "doc_id long"), 64)
    counts = np.zeros((64, 2))
    grams_of = lambda w: [xxhash.xxh64_intdigest(x.encode(), 42) for x in w] + [
        xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42)) for a, b in zip(w, w[1:])]
    bucket = lambda h: (h - (1 << 64) if h >> 63 else h) % 64
    for i, text, *_ in rows:
        for g in grams_of([w.lower() for w in split(text)]):
            counts[bucket(g)] += (1, i in (0, 2))
    assert ratios == quality_rules.log_ratios([tuple(map(int, c)) for c in counts])
    expected = Counter()
    for i, text, *_ in rows:
        w, text = split(text), text or ""
        windows, inside, seen, same = Counter(zip(w, w[1:], w[2:])), set(), set(), 0
        for k in range(len(w) - 2):
            if windows[tuple(w[k : k + 3])] > 1:
                inside |= {k, k + 1, k + 2}
        for line in text.split("\n"):
            if split(line):
                same += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        grams = grams_of([x.lower() for x in w])
        kept = not failed and sum(ratios[bucket(g)] for g in grams) / len(grams) / 1e6 >= quality_rules.LEAST_MEAN_RATIO
        expected[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), same, len(inside), failed, kept] += 1
    found = quality_rules.judge(docs, ratios)
    assert by_row(found, "doc_id", *quality_rules.BASE, "base_failed", "kept") == expected
    assert quality_rules.judge(nothing, ratios).count() == 0
    assert set(quality_rules.fit_ratios(nothing, nothing, 8)) == {0}


# --- exact top-k


def vectors():
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    data += [(i, [0.5] * 6) for i in range(300, 330)]  # ties
    data += [(330, None), (331, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (332, [float("nan")] * 6), (333, [float("inf")] * 6)]
    return data + [(334, []), (335, [1.0, 2.0]), (None, [1.0] * 6), (300, [0.5] * 6), (336, [1e300] * 6)]


def test_top_k(spark):
    frame = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>").selectExpr("*", "1 AS dim", "2 AS tile")
    found = topk.top_k(frame, frame.filter("vec_id % 100 = 0"), 4)
    clean = [(i, [math.floor(1024 * x) if abs(x) < 1e299 else int(1.7e308 if x > 0 else -1.7e308) for x in v])
             for i, v in vectors() if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    huge = (1 << 63) - 1
    expected = Counter()
    for q, v in dict((i, v) for i, v in clean if i % 100 == 0).items():
        scores = [(-min(max(sum(a * b for a, b in zip(v, u)), -huge - 1), huge), i) for i, u in clean if i != q and len(u) == len(v)]
        for rank, (score, i) in enumerate(sorted(scores)[:4]):
            expected[q, rank + 1, i, -score] += 1
    assert by_row(found, "query_id", "rank", "vec_id", "score") == expected
    assert topk.top_k(frame.limit(0), frame.limit(0), 4).count() == 0


def test_tiles_bound_every_pair():
    rng = np.random.default_rng(1)
    x, q = np.floor(1024 * rng.normal(size=(200, 64))), np.floor(1024 * rng.normal(size=(20, 64)))
    for segments in topk.SEGMENTS:
        assert (topk.features(q, segments) @ topk.features(x, segments).T >= q @ x.T - 1e-3).all()


# --- mixing


def test_mixing(docs, rows, nothing):
    frame = docs.drop("size")
    found = mixing.mix(frame).select("row.*", "size", "source_size", "target", "copies").collect()
    assert len(found) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in found:
        assert r["size"] == len(split(r.text)) and 0 <= r.copies <= 3
        sizes[r.source] += r["size"]
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
    assert all(r.source_size == sizes[r.source] for r in found)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, aims = float(sum(sizes.values())), set(order), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            aims[s] = 3.0 * sizes[s]
            left -= aims[s]
        open_ -= over
    aims |= {s: level * weight[s] for s in open_}
    assert target == pytest.approx(aims)
    assert mixing.mixed(frame).count() == sum(r.copies for r in found)
    assert mixing.mix(nothing).count() == 0


# --- quality classifier


def test_rule_ensemble(spark, docs, nothing):
    good = "The river was calm and the old boat moved slowly past the garden of a friend, {} times in all."
    texts = [(i, good.format(i) if i % 3 else "BUY!!! *** NOW %%% " * (3 + i % 4)) for i in range(90)]
    train = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in texts] + [(None, 1), (1, None)], "doc_id long, label int")
    model = rule_ensemble.fit(train, labels)
    assert model.rules and '"bias"' in model.to_json()
    found = rule_ensemble.statistics(train, "doc_id").withColumn("p", model.score()).collect()
    assert all((r.p >= 0.5) == bool(r.doc_id % 3) for r in found)
    every = rule_ensemble.statistics(docs, "doc_id").withColumn("p", model.score())
    assert every.filter("p > 0 AND p < 1").count() == 14
    assert rule_ensemble.statistics(nothing, "doc_id").count() == 0
    assert rule_ensemble.fit(nothing, labels).rules == []


# --- SimHash


def test_anchors_cover_what_the_threshold_links():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    b = a.copy()
    for _ in range(simhash.THRESHOLD):
        b ^= np.uint64(1) << rng.integers(0, 64, len(b)).astype(np.uint64)
    row, key, home = simhash.anchors(a)
    homes = set(zip(row[home].tolist(), key[home].tolist()))
    row, key, _ = simhash.anchors(b)
    assert {r for r, k in zip(row.tolist(), key.tolist()) if (r, k) in homes} == set(range(len(a)))


@pytest.mark.parametrize("block", [3, 20_000])
def test_links_connect_all_near_fingerprints(spark, block):
    rng = np.random.default_rng(9)
    seeds = rng.integers(0, 1 << 63, 12)
    prints = {int(s) for s in seeds}
    for s in seeds.tolist():
        for _ in range(12):
            s ^= 1 << int(rng.integers(63))
            s ^= 1 << int(rng.integers(63))
            prints.add(s)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    tree = {p: p for p in prints}

    def root(p):
        while tree[p] != p:
            p = tree[p]
        return p

    def groups(pairs):
        for p in prints:
            tree[p] = p
        for a, b in pairs:
            tree[max(root(a), root(b))] = min(root(a), root(b))
        return {p: root(p) for p in prints}

    near = groups((a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= simhash.THRESHOLD)
    links = [(r.a, r.b) for r in simhash.near_links(frame, block).collect()]
    assert all((a ^ b).bit_count() <= simhash.THRESHOLD for a, b in links)
    assert groups(links) == near


def test_simhash_components(docs, rows, nothing):
    prints = []
    for i, text, *_ in rows:
        w = split(lower(text))
        shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    group[a] = min(group[a], group[b])
    lowest = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in group}
    found = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("p"), "component_id")
    assert by_row(found, "doc_id", "p", "component_id") == Counter(
        (rows[k][0], f"{prints[k]:016x}", lowest[group[k]]) for k in range(len(rows)))
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(lowest[g] for g in set(group))


# --- language model


def test_language_model_counts_and_gain(docs, rows, nothing):
    tokens = [(i, [*split(lower(text)), ""]) for i, text, *_ in rows]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    found = language_model.scored(docs)
    got = by_row(found.withColumn("base", F.round("base_score", 6)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base")
    assert got == Counter(
        (i, held(i), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6))
        for i, t in tokens)
    total = found.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert total.b < total.s < 0
    assert language_model.scored(nothing).count() == 0


def test_class_chances_sum_to_one():
    table = np.zeros((2, language_model.STEPS * language_model.ENDINGS), np.int64)
    counts = np.array([1, 1, 2, 5, 9, 40, 300, 7])
    endings = np.arange(8) % language_model.ENDINGS
    cells = language_model.steps_of(counts) * language_model.ENDINGS + endings
    np.add.at(table, (0, cells), 1), np.add.at(table, (1, cells), counts)
    classes = language_model.Classes(table)
    kind = classes.of(counts, endings)
    inside = 10 ** classes.log_in_class(counts, kind)
    for c in set(kind.tolist()):
        rest = 1 / (classes.types[c] + 1) if c < language_model.ENDINGS else 0  # the unknown word
        assert inside[kind == c].sum() + rest == pytest.approx(1)
