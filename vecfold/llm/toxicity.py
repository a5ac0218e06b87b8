"""Toxicity: a logistic model on hashed words that is made indifferent to identity terms.

Training texts that mention an identity term are paired with copies in which the terms are swapped
for others of their group; the loss adds the squared change of the score between the two, so the
weight of the words around a mention decides and not the group that is mentioned. A lasso penalty keeps
the words that matter. At most ``MOST_LABELLED`` labelled rows are learned from; every text is
scored in whole.
"""

from __future__ import annotations

import math
import zlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecfold.llm.texts import lower_words, whole

# Labelled rows that a fit learns from, at most: those with the lowest hash of their id.
MOST_LABELLED = 20_000
BUCKETS = 1 << 20
SWAP_PENALTY = 1.0
LASSO = 5e-5
STEPS = 200
# Words in fewer training texts are left out.
LEAST_ROWS = 3
# Characters around a word that do not belong to it.
EDGES = b".,;:!?\"'()[]{}<>*#$%&|-_/\\`~+="
# Groups of identity terms; a term is swapped for the next one of its group.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"), ("immigrant", "refugee", "native", "foreigner"),
    ("disabled", "deaf", "blind"), ("old", "young"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
    ("muslime", "christen", "juden"), ("musulmans", "chrétiens", "juifs"), ("musulmanes", "cristianos", "judíos"),
    ("ausländer", "einheimische"), ("immigrés", "étrangers"), ("inmigrantes", "extranjeros"),
)


def swaps(groups=IDENTITY_TERMS) -> dict[bytes, bytes]:
    return {a.encode(): b.encode() for g in groups for a, b in zip(g, (*g[1:], g[0]))}


def bucket(word: bytes) -> int:
    return zlib.crc32(word.strip(EDGES)) % BUCKETS


def swapped(words: set[bytes], terms: dict[bytes, bytes]) -> set[bytes] | None:
    """The words with identity terms swapped, None if there is no such term."""
    bare = {w.strip(EDGES) for w in words}
    hit = bare & terms.keys()
    return (bare - hit) | {terms[w] for w in hit} if hit else None


def _features(texts: pd.Series) -> pd.DataFrame:
    terms, rows = swaps(), []
    for text in texts:
        words = set(lower_words(text))
        other = swapped(words, terms)
        pack = lambda ws: np.unique(np.fromiter(map(bucket, ws), np.uint32, len(ws))).tobytes()
        rows.append((pack(words), None if other is None else pack(other)))
    return pd.DataFrame(rows, columns=["own", "other"])


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``own, other, label`` of at most ``most`` labelled documents; ``labels`` has ``doc_id, label``."""
    usable = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded, so it may be broadcast
    texts = docs.select("doc_id", whole().alias("text")).join(F.broadcast(chosen), "doc_id")
    features = F.pandas_udf(_features, "own binary, other binary")
    return texts.select(features("text").alias("of"), F.col("label").cast("double")).select("of.own", "of.other", "label")


# Sets and entries that are worked on at once, so that what a step holds besides the matrix stays a few MB.
SETS_AT_ONCE, ENTRIES_AT_ONCE = 100, 1 << 18


def _sums(values: np.ndarray, at: np.ndarray, where: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """``values[at]`` summed over the runs that start at ``starts``, run ``i`` into place ``where[i]`` of ``size``."""
    out, first = np.zeros(size), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + ENTRIES_AT_ONCE, "right")) - 1)
        end = starts[last] if last < len(starts) else len(at)
        out[where[first:last]] = np.add.reduceat(values[at[starts[first] : end]], starts[first:last] - starts[first])
        first = last
    return out


class Rows:
    """Sets of buckets as one sparse 0/1 matrix over ``columns``, summed along either side."""

    def __init__(self, packed: list[bytes], columns: np.ndarray):
        self.n, self.width = len(packed), len(columns)
        found, lengths = [np.empty(0, np.int32)], np.zeros(self.n, np.int64)
        for start in range(0, self.n, SETS_AT_ONCE):
            sets = [np.frombuffer(p, np.uint32) for p in packed[start : start + SETS_AT_ONCE]]
            flat = np.concatenate(sets)
            at = np.minimum(np.searchsorted(columns, flat), len(columns) - 1)
            known = columns[at] == flat
            found.append(at[known].astype(np.int32))
            row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            lengths[start : start + len(sets)] = np.bincount(row[known], minlength=len(sets))
        self.column = np.concatenate(found)
        self.rows, self.row_starts = _runs(lengths)
        order = np.argsort(self.column, kind="stable")
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), lengths)[order]
        self.columns, self.column_starts = _runs(np.bincount(self.column, minlength=self.width))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return _sums(w, self.column, self.rows, self.row_starts, self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return _sums(r, self.row, self.columns, self.column_starts, self.width)


def _runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which runs are not empty, and where those start."""
    which = np.flatnonzero(lengths)
    return which, (np.cumsum(lengths) - lengths)[which]


def fit_rows(own: list[bytes], other: list[bytes | None], label: np.ndarray, penalty=SWAP_PENALTY, lasso=LASSO, steps=STEPS):
    """(bias, {bucket: weight}) by accelerated proximal gradient steps with adapted step sizes."""
    if not len(label) or label.min() == label.max():
        share = float(label.mean()) if len(label) else 0.0
        share = min(max(share, 0.01), 0.99)
        return math.log(share / (1 - share)), {}
    mentions = [i for i, x in enumerate(other) if x is not None]
    times = np.zeros(BUCKETS, np.int64)
    for p in chain(own, (other[i] for i in mentions)):
        times[np.frombuffer(p, np.uint32)] += 1  # a set holds a bucket once
    columns = np.flatnonzero(times >= LEAST_ROWS).astype(np.uint32)
    counts = times[columns]
    if not len(columns):
        return math.log(label.mean() / (1 - label.mean())), {}
    x, n = Rows(own, columns), len(own)
    first, second = (Rows([side[i] for i in mentions], columns) for side in (own, other))
    w, bias = np.zeros(len(columns)), math.log(label.mean() / (1 - label.mean()))
    old_w, old_bias, t = w, bias, 1.0
    # a bound of the curvature, per column: columns shared by few rows may move fast
    rate = 1.0 / (0.25 * (counts + 1) / n * np.sqrt(1 + len(x.row) / n) + 1e-9)
    rate = np.minimum(rate, 50.0)
    scale = np.ones(1)
    last = np.inf
    for _ in range(steps):
        ahead = (t - 1) / (t + 2)
        v, c = w + ahead * (w - old_w), bias + ahead * (bias - old_bias)
        z = x.dot(v) + c
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        gap = first.dot(v) - second.dot(v)
        loss = np.mean(np.logaddexp(0, z) - label * z) + penalty * np.sum(gap**2) / n + lasso * np.abs(v).sum()
        if loss > last * 1.05 + 1e-6:  # too fast: smaller steps from the last good point
            scale, t, v, c = scale / 2, 1.0, old_w, old_bias
            w, bias = old_w, old_bias
            last = np.inf
            continue
        last = min(last, loss)
        slope = x.back((p - label) / n) + 2 * penalty / n * (first.back(gap) - second.back(gap))
        step = scale * rate
        moved = v - step * slope
        old_w, old_bias = w, bias
        w = np.sign(moved) * np.maximum(np.abs(moved) - step * lasso, 0)
        bias = c - float(scale[0]) * 1.0 * float(np.mean(p - label))
        t += 1
    kept = np.flatnonzero(w)
    return float(bias), dict(zip(columns[kept].tolist(), w[kept].tolist()))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, **options) -> tuple[float, dict[int, float]]:
    """The model learned from ``labels`` (``doc_id, label``); constant if there are not two classes."""
    rows = training_rows(docs, labels, most).toArrow()  # at most ``most`` rows of bucket numbers
    own, other = (rows[c].to_pylist() for c in ("own", "other"))
    label = rows["label"].to_numpy().astype(float)
    del rows
    return fit_rows(own, other, label, **options)


class _Weights(dict):
    """Weight of a word as written, worked out once; emptied when it grows large."""

    def __init__(self, weights):
        super().__init__()
        self.weights = weights

    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        found = self.weights.get(bucket(word), 0.0)
        self[word] = found
        return found


def score(model: tuple[float, dict[int, float]], text: str = "text") -> Column:
    """Chance of the label from the set of a text's words; an empty or null text has the model's bias alone."""
    bias, weights = model

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        known = _Weights(weights)
        # fsum is exact, so the order of a set does not matter
        sums = [math.fsum({w.strip(EDGES): known[w] for w in set(lower_words(t)) if known[w]}.values()) for t in texts]
        return pd.Series(1 / (1 + np.exp(-np.clip(bias + np.array(sums, float), -40, 40))))

    return scored(whole(text))
