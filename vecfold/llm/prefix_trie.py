"""A prefix trie of conversations, as padded turn-id matrices in range shards.

A turn is identified by two 64-bit hashes of (role, text). A conversation is one row: its turn ids and
the UTF-8 byte counts of its texts. Rows are range partitioned by (turn ids in order, conv_id), so equal
prefixes are neighbours and a hot prefix spreads over several shards. In a shard the rows are padded to
the longest and sorted with ``numpy.lexsort`` (a missing turn sorts before any turn); a column's change
mask marks where a turn differs from the row before, and OR-accumulating the masks from the first
column on marks where a node of each depth starts. ``reduceat`` over the starts then gives per node its
members, smallest member, children and enders, and, over depth-wise suffix sums of values placed at
node starts and ends, the leaves and saved bytes of its subtree.

Each shard also sees the last row of the shard before and the first row of the shard after. With them
a node's start and end are known exactly in every shard, so a node that lies inside one shard is
complete there; only nodes that reach over a shard's edge (at most two chains per shard) are summed
by key in a small shuffle, and their enders' ids are joined in shard order before hashing.

Defined results: rows with a null conv_id are left out; null role or text are empty; rows with equal
turn numbers are ordered by role and text, and repeated rows are turns of their own. Conversations
without turns are members of the root only. An empty table gives no nodes. Very long texts cost only
their byte count; a conversation is one row, so its length bounds a row's width. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecfold.plans.lineage import cut_counted

HEADS = 9
BASE = 5
TURNS_PER_SHARD = 200_000
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

NODE_SCHEMA = (
    "key1 long, key2 long, depth long, parent1 long, parent2 long, conv_id long, parent_conv_id long, "
    "parent_open boolean, complete boolean, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends string, shard int"
)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """One row per conv_id c: the first h turns of conversation c - c % 5, then c's turns after its first h.

    Columns: conv_id, k1, k2 (turn ids) and nb (UTF-8 bytes of the text), arrays in turn order.
    """
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("idx"),
        F.xxhash64(F.lit("k1"), "role", "text").alias("k1"),
        F.xxhash64(F.lit("k2"), "role", "text").alias("k2"),
        F.octet_length("text").cast("long").alias("nb"),
    )
    ids = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id").distinct()
    ids = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % BASE).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"))
    head = turns.filter(F.col("idx") < HEADS - 1).withColumnRenamed("conv_id", "base").join(ids, "base").filter(F.col("idx") < F.col("h"))
    own = turns.join(ids.select("conv_id", "h"), "conv_id").filter(F.col("idx") >= F.col("h"))
    every = head.select("conv_id", F.lit(0).alias("part"), "idx", "k1", "k2", "nb").unionByName(
        own.select("conv_id", F.lit(1).alias("part"), "idx", "k1", "k2", "nb")
    )
    lists = every.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "idx", "k1", "k2", "nb"))).alias("t"))
    out = ids.select("conv_id").join(lists, "conv_id", "left")
    t = F.coalesce(F.col("t"), F.array().cast(lists.schema["t"].dataType))
    return out.select(
        "conv_id",
        F.transform(t, lambda x: x["k1"]).alias("k1"),
        F.transform(t, lambda x: x["k2"]).alias("k2"),
        F.transform(t, lambda x: x["nb"]).alias("nb"),
        # Upper-case hex of the unsigned ids: its string order is the order of the padded matrix.
        F.array_join(F.transform(t, lambda x: F.concat(F.lpad(F.hex(x["k1"]), 16, "0"), F.lpad(F.hex(x["k2"]), 16, "0"))), "").alias("seq"),
    )


def _chain(key: np.ndarray, k: np.ndarray, mix: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (key ^ k.view(np.uint64)) * np.uint64(mix)
        return x ^ (x >> np.uint64(29))


def shard_nodes(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one shard; ``g`` is -1 for the shard before's last row, 1 for the next one's first, else 0."""
    conv = rows["conv_id"].to_numpy(np.int64)
    lengths = np.array([len(x) for x in rows["k1"]], np.int64)
    n, depth = len(rows), int(lengths.max(initial=0))
    present = np.zeros((n, depth), np.uint8)
    k1 = np.zeros((n, depth), np.int64)
    k2 = np.zeros((n, depth), np.int64)
    nb = np.zeros((n, depth), np.int64)
    for r, (a, b, c) in enumerate(zip(rows["k1"], rows["k2"], rows["nb"])):
        present[r, : len(a)] = 1
        k1[r, : len(a)], k2[r, : len(a)], nb[r, : len(a)] = a, b, c
    keys = [conv]
    for j in reversed(range(depth)):
        keys += [k2[:, j].view(np.uint64), k1[:, j].view(np.uint64), present[:, j]]
    order = np.lexsort(keys)
    conv, lengths, present, k1, k2, nb = conv[order], lengths[order], present[order], k1[order], k2[order], nb[order]
    real = rows["g"].to_numpy()[order] == 0
    rows_at = np.arange(n)

    # starts[d][r]: a node of depth d starts at row r (for rows that reach depth d)
    starts = [rows_at == 0]
    for j in range(depth):
        change = np.ones(n, bool)
        change[1:] = (present[1:, j] != present[:-1, j]) | (k1[1:, j] != k1[:-1, j]) | (k2[1:, j] != k2[:-1, j])
        starts.append(starts[-1] | change)

    saved_at = np.zeros((n, depth + 1), np.int64)
    leaf_at = np.zeros((n, depth + 1), np.int64)
    nodes = []
    key1, key2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    parent_key = (key1, key2)
    parent_of = None  # per row: (complete, smallest member) of its node one level up
    for d in range(depth + 1):
        if d:
            parent_key = (key1, key2)
            key1, key2 = _chain(key1, k1[:, d - 1], MIX[0]), _chain(key2, k2[:, d - 1], MIX[1])
        at = np.nonzero(lengths >= d)[0]
        if not len(at):
            break
        begin = np.nonzero(starts[d][at])[0]
        end = np.append(begin[1:], len(at))
        first, last = at[begin], at[end - 1]
        n_real = np.add.reduceat(real[at].astype(np.int64), begin)
        smallest = np.minimum.reduceat(np.where(real[at], conv[at], np.iinfo(np.int64).max), begin)
        starts_here, ends_here = real[first], real[last]
        text_bytes = nb[first, d - 1] if d else np.zeros(len(first), np.int64)
        first_real = np.where(real[first], first, np.minimum(first + 1, n - 1))
        live = n_real > 0
        np.add.at(saved_at[:, d], first_real[live], (n_real * text_bytes - np.where(starts_here, text_bytes, 0))[live])
        is_leaf = ends_here & (lengths[last] == d) & live
        np.add.at(leaf_at[:, d], last[is_leaf], 1)
        child = np.zeros(n, np.int64)
        if d < depth:
            child = (starts[d + 1] & (lengths > d) & real).astype(np.int64)
        n_children = np.add.reduceat(child[at], begin)
        ending = (lengths[at] == d) & real[at]
        complete = starts_here & ends_here
        nodes.append(dict(d=d, at=at, begin=begin, end=end, first=first, n_real=n_real, smallest=smallest,
                          complete=complete, n_children=n_children, ending=ending, live=live))
        seg_of_row = np.full(n, -1)
        seg_of_row[at] = np.cumsum(starts[d][at]) - 1
        nodes[-1]["parent"] = parent_of
        nodes[-1]["keys"] = (key1[first], key2[first], parent_key[0][first], parent_key[1][first])
        parent_of = (seg_of_row, complete, smallest)

    below = np.cumsum(saved_at[:, ::-1], axis=1)[:, ::-1]
    leaves_below = np.cumsum(leaf_at[:, ::-1], axis=1)[:, ::-1]
    shard = int(rows["shard"].iloc[0]) if n else 0
    out = []
    for node in nodes:
        d, at, begin, live = node["d"], node["at"], node["begin"], node["live"]
        saved = np.add.reduceat(below[at, d], begin)
        leaves = np.add.reduceat(leaves_below[at, d], begin)
        ending_ids = [conv[at][b:e][node["ending"][b:e]] for b, e in zip(begin, node["end"])]
        if node["parent"] is None:
            p_open, p_conv = np.zeros(len(begin), bool), np.full(len(begin), None, object)
        else:
            seg, p_complete, p_small = node["parent"]
            ps = seg[node["first"]]
            p_open = ~p_complete[ps]
            p_conv = np.where(p_open, None, p_small[ps].astype(object))
        k1s, k2s, p1s, p2s = (x.view(np.int64) for x in node["keys"])
        for i in np.nonzero(live)[0]:
            text = ",".join(str(int(v)) for v in ending_ids[i])
            out.append((
                int(k1s[i]), int(k2s[i]), d, None if d == 0 else int(p1s[i]), None if d == 0 else int(p2s[i]),
                int(node["smallest"][i]), None if d == 0 or p_conv[i] is None else int(p_conv[i]), bool(d and p_open[i]),
                bool(node["complete"][i]), int(node["n_real"][i]), int(node["n_children"][i]), int(leaves[i]), int(saved[i]),
                hashlib.sha256(text.encode()).hexdigest() if node["complete"][i] else text, shard,
            ))
    names = [c.split() for c in NODE_SCHEMA.split(", ")]
    columns = list(zip(*out)) if out else [[] for _ in names]
    kinds = {"long": "Int64", "int": "Int32", "boolean": "boolean", "string": object}
    return pd.DataFrame({name: pd.array(list(col), dtype=kinds[kind]) for (name, kind), col in zip(names, columns)})


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs = rebuilt(conversations)
    spark = conversations.sparkSession
    sized = convs.select("conv_id", "seq", "k1", "k2", "nb")
    counted, seen = cut_counted(sized, turns=F.sum(F.size("k1")))
    n_shards = max(1, int((seen["turns"] or 0) // TURNS_PER_SHARD) + 1, int(seen["n"] // TURNS_PER_SHARD) + 1)
    shards, _ = cut_counted(counted.repartitionByRange(n_shards, "seq", "conv_id").withColumn("shard", F.spark_partition_id()))
    row = F.struct("conv_id", "seq", "k1", "k2", "nb")
    edges = shards.groupBy("shard").agg(
        F.min_by(row, F.struct("seq", "conv_id")).alias("head"), F.max_by(row, F.struct("seq", "conv_id")).alias("tail")
    )
    before = edges.select((F.col("shard") + 1).alias("shard"), F.lit(-1).alias("g"), "tail.*")
    after = edges.select((F.col("shard") - 1).alias("shard"), F.lit(1).alias("g"), "head.*")
    dealt = shards.select("shard", F.lit(0).alias("g"), "conv_id", "seq", "k1", "k2", "nb").unionByName(before).unionByName(after)
    dealt = dealt.join(edges.select("shard"), "shard")  # ghosts of shards that do not exist go
    pieces = dealt.groupBy("shard").applyInPandas(shard_nodes, NODE_SCHEMA)
    pieces, _ = cut_counted(pieces)
    done = pieces.filter("complete").select(
        "key1", "key2", "depth", "parent1", "parent2", "conv_id", "parent_conv_id", "parent_open",
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"),
    )
    joined = F.array_sort(F.collect_list(F.struct("shard", "ends")))
    summed = pieces.filter(~F.col("complete")).groupBy("key1", "key2", "depth").agg(
        F.first("parent1").alias("parent1"), F.first("parent2").alias("parent2"), F.min("conv_id").alias("conv_id"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.max("parent_open").alias("parent_open"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"),
        F.sha2(F.array_join(F.filter(F.transform(joined, lambda x: x["ends"]), lambda s: s != ""), ","), 256).alias("ends_sha256"),
    )
    summed, _ = cut_counted(summed)
    nodes = done.unionByName(summed)
    parents = summed.select(F.col("key1").alias("parent1"), F.col("key2").alias("parent2"), F.col("conv_id").alias("_pc"))
    resolved = nodes.filter("parent_open").join(parents, ["parent1", "parent2"], "left").withColumn("parent_conv_id", F.col("_pc")).drop("_pc")
    out = nodes.filter(~F.col("parent_open")).unionByName(resolved)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
