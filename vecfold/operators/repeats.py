"""Repeated substrings of texts, with counts.

A substring w (the empty one included) is reported when at least two non-empty suffixes start
with it and they continue in at least two ways; the end of the text counts as one way. Lengths
and positions count code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 512
# Pieces of at least this length are dealt in runs.
LEAST_DEALT = 12
# Most pieces of a run, and about how many pieces a task counts.
RUN, PER_TASK = 256, 1 << 20
# Most runs of a batch, and about how many pieces are compared at a time.
BATCH_RUNS, HELD = 1 << 15, 1 << 17


def windows(df: DataFrame, id: str, text: str, width: int, by: list[str] = ()) -> DataFrame:
    """``(id, pos, w)`` for every 1-based position: the text from it on, at most ``width`` long.

    Texts are first cut into overlapping chunks, because ``substring`` walks the string from
    its start: the cost per position then depends on the chunk, not on the text. Chunks are
    shuffled before they are multiplied, so one huge text is not one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body, size = F.col(text), F.length(text)
    starts = F.sequence(F.lit(1), size, F.lit(CHUNK))
    chunks = df.filter(size > 0).select(id, body.alias("_t"), F.explode(starts).alias("_start")).select(
        id, "_start", F.substring(F.col("_t"), F.col("_start"), F.lit(CHUNK + width)).alias("_c")
    )
    inside = F.sequence(F.lit(1), F.least(F.length("_c"), F.lit(CHUNK)))
    return chunks.repartition(n, id, "_start").select(id, "_start", "_c", F.explode(inside).alias("_p")).select(
        id,
        (F.col("_start") + F.col("_p") - 1).alias("pos"),
        F.substring(F.col("_c"), F.col("_p"), F.lit(width)).alias("w"),
    )


def _pieces(df: DataFrame, id: str, text: str, min_len: int, max_len: int) -> DataFrame:
    """``(id, repeat, _next)``: every piece of a text and how it continues, -1 at the end."""
    ahead = windows(df, id, text, max_len + 1)
    lengths = F.sequence(F.lit(min_len), F.least(F.length("w"), F.lit(max_len)))
    after = F.substring(F.col("w"), F.col("len") + 1, F.lit(1))
    return ahead.filter(F.length("w") >= min_len).select(id, "w", F.explode(lengths).alias("len")).select(
        id,
        F.substring(F.col("w"), F.lit(1), F.col("len")).alias("repeat"),
        # as a number: strings have no hash aggregate for min and max
        F.when(after == "", F.lit(-1)).otherwise(F.ascii(after)).alias("_next"),
    )


def repeats(
    df: DataFrame, id: str, text: str, min_len: int = 0, max_len: int = 8, min_freq: int = 2
) -> DataFrame:
    """``(id, repeat, freq)`` for repeats of ``min_len`` to ``max_len`` code points.

    One aggregation with map-side combine: a repeat continues in two ways exactly when its
    smallest and largest continuation differ (the end of the text counts as code -1).
    """
    pieces = _pieces(df, id, text, min_len, max_len)
    counted = pieces.groupBy(id, "repeat").agg(
        F.count(F.lit(1)).alias("freq"), F.min("_next").alias("_low"), F.max("_next").alias("_high")
    )
    return counted.filter((F.col("freq") >= min_freq) & (F.col("_low") != F.col("_high"))).select(
        id, "repeat", "freq"
    )


def _lowest_grams(codes: np.ndarray, size: int) -> np.ndarray:
    """Per position the least hash of the grams inside the ``size`` code points from it on."""
    gram = max(8, min(12, size // 2))
    n, span, wanted = len(codes) - gram + 1, 1, size - gram + 1
    low = np.zeros(n, np.uint64)
    for k in range(gram):
        low = low * np.uint64(0x9E3779B97F4A7C15) + codes[k : n + k]
    low = (low ^ (low >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    low ^= low >> np.uint64(32)
    while span * 2 <= wanted:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    rest = wanted - span
    return np.minimum(low[: len(low) - rest], low[rest:])


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of the parts of the given sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def dealt_runs(df: DataFrame, id: str, text: str, min_len: int, max_len: int) -> DataFrame:
    """``(id, _m, _body, _n)``: runs of ``_n`` neighbouring positions whose first ``min_len`` code points share a least gram.

    ``_body`` is the text from the first position of the run on, as far as its pieces and what follows them
    reach. Equal pieces have the same ``_m``, so all places of a piece meet, while a text travels as a few
    characters per position instead of a whole piece per position.
    """

    def run(batches):
        for batch in batches:
            rows, keys, bodies, sizes = [], [], [], []

            def found():
                ids = batch.column(id).take(pa.array(np.concatenate(rows)))
                columns = [ids, pa.array(np.concatenate(keys)), pa.array(bodies, pa.string()), pa.array(np.concatenate(sizes))]
                return pa.RecordBatch.from_arrays(columns, [id, "_m", "_body", "_n"])

            for i, value in enumerate(batch.column("_t")):
                s = value.as_py()
                low = _lowest_grams(np.frombuffer(s.encode("utf-32-le"), "<u4").astype(np.uint64), min_len)
                starts = np.r_[0, np.flatnonzero(low[1:] != low[:-1]) + 1]
                parts = -(-np.diff(np.r_[starts, len(low)]) // RUN)
                starts = np.repeat(starts, parts) + RUN * _within(parts)
                stops = np.r_[starts[1:], len(low)]
                rows.append(np.full(len(starts), i))
                keys.append(low[starts].view(np.int64))
                sizes.append((stops - starts).astype(np.int32))
                bodies += [s[a : b + max_len] for a, b in zip(starts.tolist(), stops.tolist())]
                if len(bodies) >= BATCH_RUNS:
                    yield found()
                    rows, keys, bodies, sizes = [], [], [], []
            if bodies:
                yield found()

    schema = T.StructType([
        df.schema[id], T.StructField("_m", T.LongType()), T.StructField("_body", T.StringType()), T.StructField("_n", T.IntegerType()),
    ])
    return df.filter(F.length(text) >= min_len).select(id, F.col(text).alias("_t")).mapInArrow(run, schema)


def _shared_parts(runs: pa.Table, id: str, min_len: int, max_len: int) -> pa.RecordBatch:
    """The parts of runs whose pieces two texts may hold; hashes that meet keep a piece too many."""
    bodies, n = runs["_body"].to_pylist(), runs["_n"].to_numpy().astype(np.int64)
    docs = runs[id].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    flat = np.frombuffer("".join(bodies).encode("utf-32-le"), "<u4").astype(np.uint64)
    key = np.zeros(len(flat) - min_len + 1, np.uint64)
    for k in range(min_len):
        key = key * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + len(key)]
    sizes = np.array([len(b) for b in bodies])
    row, within = np.repeat(np.arange(len(n)), n), _within(n)
    key, doc = key[(np.cumsum(sizes) - sizes)[row] + within], docs[row]
    order = np.argsort(key)
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    several = np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first)
    keep = np.zeros(len(key), bool)
    keep[order] = np.repeat(several, np.diff(np.r_[first, len(key)]))
    opens = keep & ~np.r_[False, keep[:-1] & (row[1:] == row[:-1])]
    closes = keep & ~np.r_[keep[1:] & (row[1:] == row[:-1]), False]
    at, start, stop = row[opens], within[opens], within[closes] + 1
    kept = [bodies[r][a : b + max_len] for r, a, b in zip(at.tolist(), start.tolist(), stop.tolist())]
    columns = [runs[c].combine_chunks().take(pa.array(at)) for c in (id, "_m")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string()), pa.array((stop - start).astype(np.int32))], [id, "_m", "_body", "_n"])


def shared_runs(runs: DataFrame, id: str, min_len: int, max_len: int) -> DataFrame:
    """Runs, dealt by ``_m``, without what a single text holds.

    Whole ``_m`` are held, about ``HELD`` pieces at a time; one that alone has many more is passed on as it is.
    """

    def run(batches):
        held, pieces = [], 0

        def settled(parts):
            table = pa.Table.from_batches(parts)
            if pieces > 16 * HELD:
                return table.combine_chunks().to_batches()
            return [_shared_parts(table, id, min_len, max_len)]

        for batch in batches:
            keys, n = batch.column("_m").to_numpy(), batch.column("_n").to_numpy()
            edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts = np.r_[0, edges]
            for start, stop, size in zip(starts, np.r_[edges, len(keys)], np.add.reduceat(n, starts, dtype=np.int64).tolist() if len(n) else []):
                same = held and held[-1].column("_m")[-1].as_py() == keys[start]
                if held and not same and pieces + size > HELD:
                    yield from settled(held)
                    held, pieces = [], 0
                held.append(batch.slice(start, stop - start))
                pieces += size
        if held:
            yield from settled(held)

    return runs.sortWithinPartitions("_m").mapInArrow(run, runs.schema)


def _dealt_pieces(df: DataFrame, id: str, text: str, min_len: int, max_len: int, several: bool) -> DataFrame:
    """``(_m, id, repeat, _next)`` like ``_pieces``, all places of a piece in one task of bounded size.

    With ``several``, pieces that a single text holds are left out as far as their hashes tell.
    """
    total = df.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * (max_len - min_len + 1) // PER_TASK))
    runs = dealt_runs(df, id, text, min_len, max_len).repartition(n, "_m")
    if several:
        runs = shared_runs(runs, id, min_len, max_len).repartition(n, "_m")
    placed = runs.select(id, "_m", "_body", F.explode(F.sequence(F.lit(1), "_n")).alias("_p"))
    lengths = F.sequence(F.lit(min_len), F.least(F.length("_body") - F.col("_p") + 1, F.lit(max_len)))
    sized = placed.withColumn("len", F.explode(lengths)) if max_len > min_len else placed.withColumn("len", F.lit(min_len))
    after = F.substring(F.col("_body"), F.col("_p") + F.col("len"), F.lit(1))
    return sized.select(
        "_m", id, F.substring(F.col("_body"), F.col("_p"), F.col("len")).alias("repeat"),
        F.when(after == "", F.lit(-1)).otherwise(F.ascii(after)).alias("_next"),
    )


def corpus_repeats(
    df: DataFrame, id: str, text: str, min_len: int, max_len: int, min_docs: int = 2, own_ends: bool = False
) -> DataFrame:
    """``(repeat, freq, docs)``: repeats over all texts together that at least ``min_docs`` texts hold.

    With ``own_ends`` the end of each text is a way of its own to go on, so what ends two texts and occurs
    nowhere else is a repeat; without, all ends are one way.

    Counted per text first and then over texts, so a repeat that most texts hold reaches the second
    sum as one row per text and is combined before it is shuffled. Longer pieces, which seldom repeat,
    are dealt in runs by their least gram; what one text alone holds is left out where they meet.
    """
    if min_len >= LEAST_DEALT:
        pieces, by = _dealt_pieces(df, id, text, min_len, max_len, min_docs > 1), ["_m"]
    else:
        pieces, by = _pieces(df, id, text, min_len, max_len), []
    per_text = pieces.groupBy(*by, id, "repeat").agg(
        F.count(F.lit(1)).alias("freq"), F.min("_next").alias("_low"), F.max("_next").alias("_high")
    )
    counted = per_text.groupBy(*by, "repeat").agg(
        F.sum("freq").alias("freq"), F.count(F.lit(1)).alias("docs"), F.min("_low").alias("_low"), F.max("_high").alias("_high"),
        F.count_if(F.col("_low") == -1).alias("_ends"),
    )
    differ = F.col("_low") != F.col("_high")
    if own_ends:
        differ |= F.col("_ends") >= 2
    return counted.filter((F.col("docs") >= min_docs) & differ).select("repeat", "freq", "docs")
