"""SimHash near-duplicates found with anchor points.

Fingerprints of 64 bits are cut into segments that share the threshold: two fingerprints that
differ in at most ``t`` bits differ in at most ``t_i`` bits of some segment i when the
``t_i + 1`` add up to more than ``t``. Each segment has a covering code as its anchors. The
perfect Golay code covers 23 bits with 4,096 anchors and radius 3, so a fingerprint lies within
3 of exactly one anchor (its home) and everything within ``t_i`` of it lies within ``3 + t_i``
of that anchor. Fingerprints are replicated to every anchor within that distance and compared
there. The last 18 bits take the code of all words (radius 0, threshold 0).

Copies collapse to one fingerprint first. Crowded anchors are split into a grid of blocks, so no
task holds more than two blocks, and a block reports a spanning forest of its links instead of
pairs. Components are joined from these forests by rounds of hooking and contraction.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import repeat
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecfold.llm.texts import lower_words, whole
from vecfold.operators.graph import components
from vecfold.plans.lineage import cut

SHINGLE_WORDS = 4
HASH_SEED = 42
THRESHOLD = 4
GOLAY_BITS, GOLAY_RADIUS = 23, 3
# Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY_POLYNOMIAL = 0b110001110101
# (first bit, bits, threshold inside the segment); thresholds plus one add up to THRESHOLD + 1.
SEGMENTS = ((0, 23, 1), (23, 23, 1), (46, 18, 0))
# Fingerprints of one anchor that are compared with each other in one task.
BLOCK = 20_000
# Shingles that are turned into bits at once.
BITS_AT_ONCE = 1 << 16


def shingle_hashes(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    words = lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(HASH_SEED))
    return np.fromiter(hashes, np.uint64, max(1, len(words) - size + 1))


def fingerprint(text: str, size: int = SHINGLE_WORDS) -> int:
    """Bit i is set if it is set in over half of the shingle hashes."""
    hashes = shingle_hashes(text, size)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BITS_AT_ONCE):
        part = hashes[at : at + BITS_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype=np.uint64).astype(np.int64)


def simhash(text: str = "text") -> Column:
    """The fingerprint as a long (two's complement); texts without words have 0."""
    return F.pandas_udf(_fingerprints, "long")(whole(text))


@lru_cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of every 23-bit word's low part, and the correctable error of each remainder."""

    def remainder(words: np.ndarray) -> np.ndarray:
        left = words.copy()
        for bit in range(GOLAY_BITS - 1, 10, -1):
            left ^= np.where(left >> bit & 1, GOLAY_POLYNOMIAL << (bit - 11), 0)
        return left

    # remainders are linear: those of the two halves of a word are xor-ed
    low, high = remainder(np.arange(1 << 12)), remainder(np.arange(1 << 11) << 12)
    ones = 1 << np.arange(GOLAY_BITS)
    patterns = [np.zeros(1, np.int64)]
    for weight in range(1, GOLAY_RADIUS + 1):
        grown = (patterns[-1][:, None] ^ ones).ravel()
        patterns.append(np.unique(grown[np.bitwise_count(grown) == weight]))
    errors = np.concatenate(patterns)
    table = np.zeros(1 << 11, np.int64)
    table[low[errors & 0xFFF] ^ high[errors >> 12]] = errors
    return np.stack([low, np.pad(high, (0, len(low) - len(high)))]), table


def home_anchor(words: np.ndarray) -> np.ndarray:
    """The Golay code word within distance 3 of each 23-bit word."""
    parts, table = _syndromes()
    return words ^ table[parts[0][words & 0xFFF] ^ parts[1][words >> 12]]


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) for every anchor that a fingerprint is replicated to.

    With radius 3 and threshold 1, an anchor within distance 4 is the home of the word itself or of
    a word that differs in one bit.
    """
    rows, keys, homes = [], [], []
    own = np.arange(len(prints))
    for number, (first, bits, threshold) in enumerate(SEGMENTS):
        words = (prints >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int64)
        if threshold:
            home = home_anchor(words)
            near = home_anchor((words[:, None] ^ (1 << np.arange(bits))).ravel()).reshape(len(words), bits)
            near = np.sort(near, axis=1)
            fresh = (near != home[:, None]) & np.column_stack([np.ones(len(words), bool), near[:, 1:] != near[:, :-1]])
            at, which = np.nonzero(fresh)
            rows.append(at), keys.append(near[at, which]), homes.append(np.zeros(len(at), bool))
            words = home
        rows.append(own), keys.append(words), homes.append(np.ones(len(own), bool))
        for k in range(-1 - bool(threshold), 0):
            keys[k] = keys[k] | number << 32
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy().astype(np.uint64)
        rows, keys, homes = anchors(prints)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(homes), pa.array(prints[rows].astype(np.int64))], ["anchor", "home", "fp"]
        )


def forest(keys: np.ndarray, homes: np.ndarray, prints: np.ndarray, threshold: int = THRESHOLD):
    """Links within ``threshold`` that span, per key, what homes and all rows of the key link.

    Rows come sorted by key with homes first. Rows are compared at one shift after another, for
    all keys at once; a link is kept if it joins two trees.
    """
    n = len(keys)
    ends = np.searchsorted(keys, keys, side="right")
    tree = np.arange(n)
    found: list[tuple[int, int]] = []
    live = np.flatnonzero(homes)
    shift = 0

    def root(i: int) -> int:
        while tree[i] != i:
            tree[i] = tree[tree[i]]
            i = tree[i]
        return i

    while True:
        shift += 1
        live = live[live + shift < ends[live]]
        if not len(live):
            return np.array(found, np.int64).reshape(-1, 2)
        hit = live[np.bitwise_count(prints[live] ^ prints[live + shift]) <= threshold]
        hit = hit[tree[hit] != tree[hit + shift]]
        joined = False
        for i in hit.tolist():
            a, b = root(i), root(i + shift)
            if a != b:
                tree[max(a, b)] = min(a, b)
                found.append((i, i + shift))
                joined = True
        while joined:
            up = tree[tree]
            joined = bool((up != tree).any())
            tree[:] = up


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block; only the rows of the last, maybe unfinished block are carried over."""

    def links(columns):
        *block, homes, prints = columns
        edge = np.any([k[1:] != k[:-1] for k in block], axis=0)
        keys = np.concatenate([[0], np.cumsum(edge)])
        ends = prints[forest(keys, homes, prints.astype(np.uint64))]
        return pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], ["a", "b"])

    carried = None
    for batch in batches:
        if not len(batch):
            continue
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("anchor", "i", "j", "home", "fp")]
        if carried is not None:
            now = [np.concatenate(x) for x in zip(carried, now)]
        other = np.any([k != k[-1] for k in now[:3]], axis=0)
        done = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if done:
            yield links([x[:done] for x in now])
        carried = [x[done:] for x in now]
    if carried is not None:
        yield links(carried)


def near_links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: links that connect what the threshold connects, for distinct ``fp``.

    At most one link per replica; two fingerprints within the threshold end up in one component.
    """
    replicas = prints.select("fp").mapInArrow(_replicate, "anchor long, home boolean, fp long")
    counts = replicas.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("h"))
    # at most one row per anchor that holds over a block: bounded by the number of anchors of all codes
    crowded = counts.filter(F.col("n") > block).select(
        "anchor", F.ceil(F.col("h") / block).alias("hs"), F.ceil(F.col("n") / block).alias("gs")
    )
    one = F.lit(1).cast("long")
    placed = replicas.join(F.broadcast(crowded), "anchor", "left").select(
        "anchor", "home", "fp", F.coalesce("hs", one).alias("hs"), F.coalesce("gs", one).alias("gs")
    )
    last = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    code = F.xxhash64("fp")
    as_home = placed.filter("home").select(
        "anchor", F.pmod(code, F.col("hs")).alias("i"), F.explode(last("gs")).alias("j"), F.lit(True).alias("home"), "fp"
    )
    # where a single block is enough its homes are there already
    as_guest = placed.filter(~F.col("home") | (F.col("hs") > 1) | (F.col("gs") > 1)).select(
        "anchor", F.explode(last("hs")).alias("i"), F.pmod(code, F.col("gs")).alias("j"), F.lit(False).alias("home"), "fp"
    )
    keys = ["anchor", "i", "j"]
    dealt = as_home.unionByName(as_guest).repartition(*keys).sortWithinPartitions(*keys, F.desc("home"), "fp")
    return dealt.mapInArrow(_compare, "a long, b long").filter("a != b").distinct()


def fingerprint_groups(prints: DataFrame) -> DataFrame:
    """``(fp, root)`` for the fingerprints that have a neighbour."""
    links = cut(near_links(prints))
    ends = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    zero = F.lit(0).cast("long").alias("g")
    found = components(ends.select(zero, "id"), links.select(zero, "a", "b"))
    return found.select(F.col("id").alias("fp"), "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, fp, root, component_id``.

    ``root`` is the same for all documents of a component; ``component_id`` is their smallest
    doc_id (null if none has one). Null and empty texts have fingerprint 0 and link like others;
    repeated rows are copies; an empty table gives an empty result.
    """
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), simhash().alias("fp")))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    groups = fingerprint_groups(prints)
    named = prints.join(groups, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    found = named.join(lowest, "root").select("fp", "root", "component_id")
    return rows.join(found, "fp").select("doc_id", "fp", "root", "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: the one with the smallest doc_id stays.

    Of repeated rows with that id one stays, and of a group without ids one.
    """
    print_of = simhash().alias("_fp")
    found = near_duplicates(docs)
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = keep.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("k")).select(
        F.col("k.doc_id").alias("_id"), F.col("k.fp").alias("_fp")
    )
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), print_of)
    kept = rows.join(keep, rows["_fp"].eqNullSafe(keep["_fp"]) & rows["_id"].eqNullSafe(keep["_id"]), "left_semi")
    return kept.dropDuplicates(["_id", "_fp"]).select("_row.*")
