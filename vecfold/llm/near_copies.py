"""Near copies: texts whose fingerprints ``simhash`` links, or whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more.

Fingerprints link as in ``simhash.near_duplicates``. Of the pairs of similar sets they reach few, so the
sets are compared as well. MinHash bands only propose: texts that agree in all rows of a band share a bucket. With 24 bands of
four rows two texts of similarity 0.8 meet in no bucket with a chance of 3 in a million, fewer above it.
Every link is checked on the whole shingle sets.

Texts with equal sets collapse to one vertex first. Each bucket is then checked against its lowest
vertex, one row per member. Only buckets whose members that leaves in several components are compared
pair by pair, inside tasks that hold two chunks of a bucket and report a spanning forest.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecfold.llm.simhash import fingerprint, fingerprint_groups, shingle_hashes
from vecfold.llm.texts import whole
from vecfold.operators.graph import components
from vecfold.plans.lineage import cut

SHINGLE_WORDS = 5
# Least Jaccard similarity of a link, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 24, 4
# Members of a bucket that a chunk holds.
CHUNK = 500
# Shingles that are hashed with all functions at once.
HASHED_AT_ONCE = 1 << 11
_RANDOM = np.random.default_rng(20240229)
FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
MASKS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE_WORDS))


def band_keys(shingles: np.ndarray) -> list[int]:
    """One bucket per band; a text without words has none."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), HASHED_AT_ONCE):
        part = shingles[at : at + HASHED_AT_ONCE]
        least = np.minimum(least, ((part ^ MASKS[:, None]) * FACTORS[:, None]).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough, in whole numbers."""
    top, below = LEAST
    if min(len(a), len(b)) * below < max(len(a), len(b)) * top:
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both * (below + top) >= top * (len(a) + len(b))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # fingerprints and sets in one pass: a second function in the stage would be a second worker per core that stays
    for batch in batches:
        prints, codes, keys = [], [], []
        for value in batch.column("text"):
            text = value.as_py()
            shingles = shingle_set(text)
            prints.append(fingerprint(text))
            codes.append(xxhash.xxh64_intdigest(shingles.tobytes()))
            keys.append(np.array(band_keys(shingles), np.uint64).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tag"), pa.array(np.array(prints, np.uint64).astype(np.int64)),
             pa.array(np.array(codes, np.uint64).astype(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "tag", "fp", "code", "keys"],
        )


def _set(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).tobytes() for t in texts], dtype=object)


def _similar(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(left, right)], dtype=bool)


def forest(sides: list[int], roots: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what is similar, given what ``roots`` connect; with two sides only across them."""
    number: dict[int, int] = {}
    tree = [number.setdefault(r, k) for k, r in enumerate(roots)]
    across = len(set(sides)) > 1
    found = []

    def root(i: int) -> int:
        while tree[i] != i:
            tree[i] = tree[tree[i]]
            i = tree[i]
        return i

    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    for at, a in enumerate(order):
        for b in order[at + 1 :]:
            if len(sets[a]) * LEAST[1] < len(sets[b]) * LEAST[0]:
                break
            if across and sides[a] == sides[b]:
                continue
            x, y = root(a), root(b)
            if x != y and similar(sets[a], sets[b]):
                tree[max(x, y)] = min(x, y)
                found.append((a, b))
    return found


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block (``key, i, j``), and a block is held as a whole."""

    def links(rows) -> pa.RecordBatch:
        _, sides, codes, roots, sets = zip(*rows)
        pairs = forest(list(sides), list(roots), [np.frombuffer(s, np.uint64) for s in sets])
        ends = [pa.array([codes[p[k]] for p in pairs], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(ends, ["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        key, i, j, *rest = (batch.column(c).to_pylist() for c in ("key", "i", "j", "side", "code", "root", "set"))
        for row in zip(zip(key, i, j), *rest):
            if held and held[0][0] != row[0]:
                yield links(held)
                held = []
            held.append(row)
    if held:
        yield links(held)


def _blocks(members: DataFrame, chunk: int) -> DataFrame:
    """Members (``key, n, code, root``) at every pair of chunks of their bucket that holds theirs."""
    n = F.ceil(F.col("n") / chunk)
    own = members.withColumn("_n", n).withColumn("side", F.pmod(F.xxhash64("code"), F.col("_n")))
    other = own.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    # the block of a chunk with itself is needed where it is the only one, and for pairs inside it
    return other.select("key", F.least("side", "_o").alias("i"), F.greatest("side", "_o").alias("j"), "side", "code", "root")


def near_links(docs: DataFrame, signed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(a, b)``: checked links between vertices that connect all similar ones that share a bucket."""
    members = cut(signed.select("code", F.explode("keys").alias("key")).distinct())
    buckets = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("code").alias("hub"), F.bit_xor(F.xxhash64("code")).alias("_all")
    ).filter("n > 1")
    # of buckets with the same members one is enough
    buckets = buckets.groupBy("n", "hub", "_all").agg(F.min("key").alias("key")).drop("_all")
    shared = cut(members.join(buckets.hint("merge"), "key"))
    first = signed.groupBy("code").agg(F.min(F.struct("doc_id", "tag")).alias("f"))
    wanted = first.join(shared.select("code").distinct().hint("merge"), "code", "left_semi")
    wanted = wanted.select("code", F.col("f.doc_id").alias("_id"), F.col("f.tag").alias("_tag"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_d"), F.xxhash64(whole()).alias("_t"), whole().alias("text"))
    same = texts["_d"].eqNullSafe(wanted["_id"]) & (texts["_t"] == wanted["_tag"])
    chosen = texts.join(wanted.hint("merge"), same).dropDuplicates(["code"])
    sets = cut(chosen.select("code", F.pandas_udf(_set, "binary")("text").alias("set")))

    pairs = shared.filter("code != hub").select(F.col("hub").alias("a"), F.col("code").alias("b")).distinct()
    right = pairs.join(sets.select(F.col("code").alias("b"), F.col("set").alias("_b")).hint("merge"), "b")
    both = right.join(sets.select(F.col("code").alias("a"), F.col("set").alias("_a")).hint("merge"), "a")
    links = cut(both.filter(F.pandas_udf(_similar, "boolean")("_a", "_b")).select("a", "b"))

    placed = shared.join(_roots(shared.select("code").distinct(), links).hint("merge"), "code")
    placed = cut(placed.select("key", "n", "code", "root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low != _high")
    open_ = placed.join(mixed.select("key").hint("merge"), "key", "left_semi")
    dealt = _blocks(open_, chunk).join(sets.hint("merge"), "code").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return links.unionByName(cut(dealt.mapInArrow(_compare, "a long, b long")))


def _roots(vertices: DataFrame, links: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long").alias("g")
    return components(vertices.select(zero, F.col("code").alias("id")), links.select(zero, "a", "b")).select(
        F.col("id").alias("code"), "root"
    )


def fingerprint_links(signed: DataFrame) -> DataFrame:
    """``(a, b)``: vertices whose texts have fingerprints of one component, each linked to its lowest vertex."""
    prints = cut(signed.select("fp", "code").distinct())
    groups = fingerprint_groups(prints.select("fp").distinct())
    rooted = prints.join(groups.hint("merge"), "fp", "left").select("code", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("code").alias("a"), F.max("code").alias("_last")).filter("a != _last")
    return rooted.join(lowest.drop("_last").hint("merge"), "root").filter("code != a").select("a", F.col("code").alias("b"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the one with the smallest doc_id stays.

    Null and wordless texts are copies of each other. Of repeated rows with that id one stays, and of a
    group without ids one.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole()).alias("tag"), whole().alias("text"))
    signed = cut(named.mapInArrow(_sign, "doc_id long, tag long, fp long, code long, keys array<long>"))
    links = cut(near_links(docs, signed).unionByName(fingerprint_links(signed)).distinct())
    linked = links.select(F.col("a").alias("code")).union(links.select("b")).distinct()
    lowest = signed.groupBy("code").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "tag")).alias("k"))
    rooted = lowest.join(_roots(linked, links).hint("merge"), "code", "left")
    keep = rooted.groupBy(F.coalesce("root", "code").alias("root")).agg(F.min("k").alias("k")).select(
        F.col("k.doc_id").alias("_k"), F.col("k.tag").alias("_g")
    )
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(whole()).alias("_tag"))
    same = rows["_id"].eqNullSafe(keep["_k"]) & (rows["_tag"] == keep["_g"])
    return rows.join(keep.hint("merge"), same, "left_semi").dropDuplicates(["_id", "_tag"]).select("_row.*")
