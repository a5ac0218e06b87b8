"""Suffix order, common prefixes and all repeats of texts of any length.

Positions are rows ``(id, pos)``, so one long text spreads over the cluster like many short
ones. Suffixes are first named by their first ``WIDTH`` code points; names then double: two
suffixes that share a name are told apart by the names ``WIDTH``, ``2 * WIDTH``, ... further
on, and only suffixes that still share a name take part in the next round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecfold.operators.graph import union_all
from vecfold.operators.repeats import windows
from vecfold.plans.lineage import cut, cut_counted, sized_broadcast
from vecfold.plans.ordered import prefix, ranges

WIDTH = 16
# Code points of a text whose repeats are found inside one task.
BLOCK_CHARS = 1 << 19


@dataclass
class Suffixes:
    """Ranks of all suffixes, and which suffixes were still alike after each doubling."""

    heads: DataFrame  # id, pos, w: the first WIDTH code points
    ranks: DataFrame  # id, pos, rank: unique, global
    alike: list[DataFrame]  # id, pos, rank: level k shares the first WIDTH * 2**k code points


def order_suffixes(df: DataFrame, id: str, text: str) -> Suffixes:
    """Global order of all suffixes by (id, suffix) in code-point order.

    Each round writes only the suffixes it renames. Those are joined to the ranks ``width``
    further on by an inner join (texts get an end mark), so that once few are left Spark
    broadcasts them and the bulk of the ranks is scanned without a shuffle.
    """
    docs = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    heads = cut(windows(docs, "id", "text", WIDTH))
    ends = docs.select("id", (F.length("text") + 1).alias("pos"), F.lit(-1).cast("long").alias("rank"))
    counted = heads.groupBy("id", "w").agg(F.count(F.lit(1)).alias("cnt"))
    run = prefix(ranges(counted, ["id", "w"]), ["id", "w"], [], run=("sum", "cnt"))
    names = run.select("id", "w", (F.col("run") - F.col("cnt")).alias("rank"), "cnt")
    shared = F.sum((F.col("cnt") > 1).cast("long"))
    now, seen = cut_counted(heads.join(names, ["id", "w"]).select("id", "pos", "rank", "cnt"), shared=shared)
    settled, alike, width = [], [], WIDTH
    while True:
        settled.append(now.filter(F.col("cnt") == 1).select("id", "pos", "rank"))
        if not seen["shared"]:
            return Suffixes(heads, union_all(settled), alike)
        open_ = now.filter(F.col("cnt") > 1).select("id", "pos", "rank")
        alike.append(open_)
        known = union_all([ends, open_, *settled])
        ahead = known.select("id", (F.col("pos") - width).alias("pos"), F.col("rank").alias("_next"))
        open_ = cut(open_.join(ahead, ["id", "pos"]).select("id", "pos", "rank", "_next"))
        counted = open_.groupBy("rank", "_next").agg(F.count(F.lit(1)).alias("cnt"))
        run = prefix(ranges(counted, ["rank", "_next"]), ["_next"], ["rank"], run=("sum", "cnt"))
        names = run.select("rank", "_next", (F.col("rank") + F.col("run") - F.col("cnt")).alias("_new"), "cnt")
        split = open_.join(names, ["rank", "_next"]).select("id", "pos", F.col("_new").alias("rank"), "cnt")
        now, seen = cut_counted(split, shared=shared)
        width *= 2


def suffix_rank(df: DataFrame, id: str, text: str) -> DataFrame:
    """``(id, pos, rank)``: 1-based position and 0-based rank of every suffix of each text."""
    last = order_suffixes(df, id, text).ranks
    base = sized_broadcast(last.groupBy("id").agg(F.min("rank").alias("_base")), 64)
    return last.join(base, "id").select(F.col("id").alias(id), "pos", (F.col("rank") - F.col("_base")).alias("rank"))


def _same_head(a, b):
    """Length of the common prefix of two strings of at most WIDTH code points."""
    at = F.expr(f"sequence(1, {WIDTH})")
    differs = F.transform(
        at, lambda i: (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))) | (F.substring(a, i, F.lit(1)) == "")
    )
    first = F.array_position(differs, True)
    return F.when(first > 0, first - 1).otherwise(WIDTH).cast("long")


def common_prefixes(s: Suffixes) -> DataFrame:
    """``(id, pos, rank, lcp)``: code points shared with the suffix ranked just before.

    ``rank`` is global; the first suffix of a text has -1. The doubling levels are walked from
    the widest down, so a common prefix of n code points costs log(n) joins.
    """
    last = cut(s.ranks)
    before = last.select("id", (F.col("rank") + 1).alias("rank"), F.col("pos").alias("prev"))
    pairs = last.join(before, ["id", "rank"], "left")
    firsts = pairs.filter(F.col("prev").isNull()).select("id", "pos", "rank", F.lit(-1).cast("long").alias("lcp"))
    pairs = cut(pairs.filter(F.col("prev").isNotNull()).withColumn("lcp", F.lit(0).cast("long")))
    for k in range(len(s.alike) - 1, -1, -1):
        mine = s.alike[k].select("id", F.col("pos").alias("_p"), F.col("rank").alias("_mine"))
        theirs = s.alike[k].select("id", F.col("pos").alias("_q"), F.col("rank").alias("_theirs"))
        moved = pairs.withColumns({"_p": F.col("pos") + F.col("lcp"), "_q": F.col("prev") + F.col("lcp")})
        moved = moved.join(mine, ["id", "_p"], "left").join(theirs, ["id", "_q"], "left")
        gain = F.when(F.col("_mine") == F.col("_theirs"), F.lit(WIDTH << k)).otherwise(0)
        pairs = cut(moved.select("id", "pos", "rank", "prev", (F.col("lcp") + gain).alias("lcp")))
    mine = s.heads.select("id", F.col("pos").alias("_p"), F.col("w").alias("_a"))
    theirs = s.heads.select("id", F.col("pos").alias("_q"), F.col("w").alias("_b"))
    ends = pairs.withColumns({"_p": F.col("pos") + F.col("lcp"), "_q": F.col("prev") + F.col("lcp")})
    ends = ends.join(mine, ["id", "_p"], "left").join(theirs, ["id", "_q"], "left")
    rest = _same_head(F.coalesce("_a", F.lit("")), F.coalesce("_b", F.lit("")))
    return cut(ends.select("id", "pos", "rank", (F.col("lcp") + rest).alias("lcp")).unionByName(firsts))


def adjacent_prefixes(df: DataFrame, id: str, text: str) -> DataFrame:
    """``(id, pos, lcp)`` per suffix, 0 for the first of a text."""
    return common_prefixes(order_suffixes(df, id, text)).select(
        F.col("id").alias(id), "pos", F.greatest("lcp", F.lit(0)).alias("lcp")
    )


# rows of a sweep: found intervals, and the running minima seen from either end of a range
_NODE, _FROM_LEFT, _FROM_RIGHT = 0, 1, 2


def _sweep(batches):
    """Intervals of equal prefix inside one sorted range; sides outside the range stay null."""
    rank, lcp = [], []
    for batch in batches:
        rank.append(batch.column(1).to_numpy())
        lcp.append(batch.column(2).to_numpy())
        region = batch.column(0)[0].as_py()
    if not rank:
        return
    rank, lcp = np.concatenate(rank), np.concatenate(lcp)
    kind, size, left, right = [], [], [], []
    stack: list[tuple[int, int | None]] = []
    for i, (r, n) in enumerate(zip(rank.tolist(), lcp.tolist())):
        start = r - 1 if i else None
        while stack and stack[-1][0] > n:
            length, start = stack.pop()
            kind.append(_NODE), size.append(length), left.append(start), right.append(r - 1)
        if n >= 0 and (not stack or stack[-1][0] < n):
            stack.append((n, start))
    for length, start in stack:
        kind.append(_NODE), size.append(length), left.append(start), right.append(None)
    for side, values, ranks in ((_FROM_LEFT, lcp, rank), (_FROM_RIGHT, lcp[::-1], rank[::-1])):
        low = np.minimum.accumulate(values)
        new = np.flatnonzero(np.r_[True, low[1:] < low[:-1]])
        for j in new:
            kind.append(side), size.append(int(low[j])), left.append(int(ranks[j])), right.append(None)
    yield pa.RecordBatch.from_pydict(
        {
            "region": pa.array([region] * len(kind), pa.int32()), "kind": pa.array(kind, pa.int32()),
            "len": pa.array(size, pa.int64()), "left": pa.array(left, pa.int64()), "right": pa.array(right, pa.int64()),
        }
    )


def _lookup(asked: DataFrame, minima: DataFrame, name: str) -> DataFrame:
    """For ``(region, len)`` the position of the running minimum nearest below ``len``."""
    keys = asked.select("region", "len").distinct().select(
        "region", "len", F.lit(1).alias("_ask"), F.lit(None).cast("struct<len:bigint,at:bigint>").alias("_at")
    )
    known = minima.select(
        "region", "len", F.lit(2).alias("_ask"), F.struct("len", F.col("left").alias("at")).alias("_at")
    )
    both = ranges(keys.unionByName(known), ["region", "len", "_ask"])
    seen = prefix(both, ["len", "_ask"], ["region"], best=("max", "_at"))
    return seen.filter(F.col("_ask") == 1).select("region", "len", F.col("best.at").alias(name))


def repeat_intervals(lcps: DataFrame) -> DataFrame:
    """``(left, right, len)``: rank intervals of suffixes whose longest common prefix is ``len``.

    Rows are swept range by range in rank order. Intervals that reach over a range boundary
    find their other end in two lookups: the next range whose minimum is smaller (one number
    per range) and, inside it, the first running minimum that is smaller.
    """
    parts = ranges(lcps.select("rank", "lcp"), ["rank"]).select(F.col("_range").alias("region"), "rank", "lcp")
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "region int, kind int, len long, left long, right long"
    in_order = parts.repartition(n, "region").sortWithinPartitions("region", "rank")
    swept = cut(in_order.mapInArrow(_per_region(_sweep), schema))
    if not swept.head(1):
        return swept.select("left", "right", "len")
    lows = {r["region"]: r["low"] for r in parts.groupBy("region").agg(F.min("lcp").alias("low")).collect()}
    last = parts.agg(F.max("rank")).first()[0]
    regions = sorted(lows)  # one number per range
    nodes = swept.filter(F.col("kind") == _NODE)

    lowest = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(lows[r]).alias("low")) for r in regions])
    below = F.filter(lowest, lambda x: x["low"] < F.col("len"))
    after = F.array_min(F.transform(F.filter(below, lambda x: x["r"] > F.col("region")), lambda x: x["r"]))
    prior = F.array_max(F.transform(F.filter(below, lambda x: x["r"] < F.col("region")), lambda x: x["r"]))
    nodes = cut(
        nodes.withColumns({
            "_r": F.when(F.col("right").isNull(), after), "_l": F.when(F.col("left").isNull(), prior),
        })
    )
    to_right = nodes.filter(F.col("_r").isNotNull()).select(F.col("_r").alias("region"), "len")
    to_left = nodes.filter(F.col("_l").isNotNull()).select(F.col("_l").alias("region"), "len")
    stops = _lookup(to_right, swept.filter(F.col("kind") == _FROM_LEFT), "_stop").withColumnRenamed("region", "_r")
    starts = _lookup(to_left, swept.filter(F.col("kind") == _FROM_RIGHT), "_start").withColumnRenamed("region", "_l")
    ends = nodes.join(stops, ["_r", "len"], "left").join(starts, ["_l", "len"], "left")
    return ends.select(
        F.coalesce("left", "_start").alias("left"),
        F.coalesce("right", F.col("_stop") - 1, F.lit(last)).alias("right"),
        "len",
    ).distinct()


def _per_region(sweep):
    """Feeds each region of a sorted partition to ``sweep`` on its own."""

    def run(batches):
        current, held = None, []
        for batch in batches:
            region = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(region)) + 1
            for start, stop in zip(np.r_[0, edges], np.r_[edges, len(region)]):
                if stop <= start:
                    continue
                if held and region[start] != current:
                    yield from sweep(held)
                    held = []
                current = region[start]
                held.append(batch.slice(start, stop - start))
        if held:
            yield from sweep(held)

    return run


def _packed(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """Per position as many code points as a number holds, in code-point order, and how many these are."""
    symbols, codes = np.unique(codes, return_inverse=True)
    bits = int(len(symbols)).bit_length()
    width = 62 // bits
    padded = np.r_[codes + 1, np.zeros(width - 1, np.int64)]
    key = np.zeros(len(codes), np.int64)
    for k in range(width):
        key = key << bits | padded[k : k + len(codes)]
    return key, width


def _ordered(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], int]:
    """Positions in suffix order, the names of every doubling, and the code points the first ones stand for."""
    n = len(codes)
    key, width = _packed(codes)
    order = np.argsort(key, kind="stable")
    starts = np.r_[True, key[order][1:] != key[order][:-1]]
    names, at = [], np.arange(n)
    name = np.empty(n, np.int64)
    name[order] = np.maximum.accumulate(np.where(starts, at, 0))
    span = width
    while True:
        names.append(name)
        # places in the order whose suffix still shares its name
        shared = np.flatnonzero(~(starts & np.r_[starts[1:], True]))
        if not len(shared):
            return order, names, width
        name = name.copy()
        pos = order[shared]
        ahead = pos + span
        after = np.where(ahead < n, names[-1][np.minimum(ahead, n - 1)], -1)
        own = names[-1][pos]
        by = np.argsort(own * (n + 1) + after + 1, kind="stable")
        pos, own, after = pos[by], own[by], after[by]
        order[shared] = pos
        new = np.r_[True, (own[1:] != own[:-1]) | (after[1:] != after[:-1])]
        starts[shared] = new
        name[pos] = np.maximum.accumulate(np.where(new, shared, 0))
        span *= 2


def _neighbour_prefixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order, and the code points each shares with the one before it (-1 for the first)."""
    n = len(codes)
    order, names, width = _ordered(codes)
    left, right = order[:-1], order[1:]
    shared = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(names) - 1, -1, -1):
        p, q = left + shared, right + shared
        # a name stands for that many code points or for a whole rest, which no other suffix shares
        same = np.flatnonzero((p < n) & (q < n))
        same = same[names[k][p[same]] == names[k][q[same]]]
        shared[same] += width << k
    open_ = np.arange(len(shared))
    while len(open_):
        p, q = left[open_] + shared[open_], right[open_] + shared[open_]
        inside = (p < n) & (q < n)
        open_, p, q = open_[inside], p[inside], q[inside]
        open_ = open_[codes[p] == codes[q]]
        shared[open_] += 1
    return order, np.r_[-1, shared][:n]


def _block_repeats(s: str) -> tuple[list[int], list[int], list[int]]:
    """Position (from 1), length and count of every repeat of a text."""
    order, lcp = _neighbour_prefixes(np.frombuffer(s.encode("utf-32-le"), "<u4").astype(np.int64))
    first, size, freq = [], [], []
    stack: list[tuple[int, int]] = []
    for i, n in enumerate(lcp.tolist()):
        start = i - 1
        while stack and stack[-1][0] > n:
            length, start = stack.pop()
            first.append(start), size.append(length), freq.append(i - start)
        if n >= 0 and (not stack or stack[-1][0] < n):
            stack.append((n, start))
    for length, start in stack:
        first.append(start), size.append(length), freq.append(len(lcp) - start)
    return (order[np.array(first, np.int64)] + 1).tolist(), size, freq


def _repeats_in_blocks(df: DataFrame, id: str, text: str, min_len: int, min_freq: int) -> DataFrame:
    """``(id, pos, len, freq)`` for texts of at most ``BLOCK_CHARS`` code points, text by text."""

    def run(batches):
        for batch in batches:
            for i, value in enumerate(batch.column("_t")):
                pos, size, freq = (np.array(c, np.int64) for c in _block_repeats(value.as_py()))
                kept = np.flatnonzero((size >= min_len) & (freq >= min_freq))
                ids = batch.column(id).take(pa.array(np.full(len(kept), i)))
                columns = [ids, pa.array(pos[kept].astype(np.int32)), pa.array(size[kept]), pa.array(freq[kept])]
                yield pa.RecordBatch.from_arrays(columns, [id, "pos", "len", "freq"])

    found = [T.StructField("pos", T.IntegerType()), T.StructField("len", T.LongType()), T.StructField("freq", T.LongType())]
    rows = df.select(id, F.col(text).alias("_t")).filter(F.col(id).isNotNull() & (F.length("_t") > 1))
    # dealt by hash, so that a file of long texts is not one task
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, id).mapInArrow(run, T.StructType([df.schema[id], *found]))


def all_repeats(df: DataFrame, id: str, text: str, min_len: int = 0, min_freq: int = 2) -> DataFrame:
    """``(id, pos, len, freq)``: every repeat of each text, by one of its positions.

    Rows without an id are left out. Texts of more than ``BLOCK_CHARS`` code points are spread over the
    cluster and need ids of their own.
    """
    short = _repeats_in_blocks(df.filter(F.length(text) <= BLOCK_CHARS), id, text, min_len, min_freq)
    long = df.filter(F.length(text) > BLOCK_CHARS)
    if not long.head(1):
        return short
    lcps = common_prefixes(order_suffixes(long, id, text))
    found = repeat_intervals(lcps).select("left", "len", (F.col("right") - F.col("left") + 1).alias("freq"))
    found = found.filter((F.col("len") >= min_len) & (F.col("freq") >= min_freq))
    where = lcps.select(F.col("rank").alias("left"), "id", "pos")
    spread = found.join(where, "left").select(F.col("id").alias(id), "pos", "len", "freq")
    return short.unionByName(spread)


def repeats_with_text(df: DataFrame, id: str, text: str, min_len: int = 0, min_freq: int = 2) -> DataFrame:
    """``(id, repeat, freq)`` like ``repeats.repeats``, without a length limit."""
    found = all_repeats(df, id, text, min_len, min_freq)
    piece = F.substring(F.col(text), F.col("pos"), F.col("len"))
    return found.join(df.select(id, text), id).select(id, piece.alias("repeat"), "freq")


def repeat_counts(df: DataFrame, id: str, text: str) -> DataFrame:
    """``(id, nodes)``: number of repeats per text; texts without any are left out."""
    return all_repeats(df, id, text).groupBy(id).agg(F.count(F.lit(1)).alias("nodes"))
