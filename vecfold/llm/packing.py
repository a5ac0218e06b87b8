"""Packing tokenized documents into sequences of fixed length.

Only the histogram of piece lengths (one count per length) reaches the driver. There, patterns of
up to three lengths that fill a sequence exactly are enumerated, their repeat counts are fitted to
the histogram by non-negative least squares and rounded, and what the rounded patterns leave over is
packed best-fit, longest first, in bulk. The plan says which ranks of which length go to which
sequences; every piece finds its place by its rank among the pieces of its length, which comes from
range-partitioned numbering, so a frequent length is spread over many tasks.

The plan's size depends on the sequence length alone: at most three rows per pattern, and a few
per length for the rest.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecfold.llm.texts import whole
from vecfold.plans.lineage import cut
from vecfold.plans.ordered import ordinal

SEQUENCE = 2048
END = 0
# Steps of the least-squares fit.
FIT_STEPS = 150
# Words whose ids a worker remembers, per generation; two generations are kept (about 100 MB each).
CACHED_WORDS = 500_000


@lru_cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Ids:
    """Ids of a word as little-endian 32-bit numbers, worked out once.

    Words are kept in two generations: when the young one is full it becomes the old one and the
    former old one is dropped, so frequent words stay and the cache is never emptied at once.
    """

    def __init__(self, path: str):
        self.encode = tokenizer(path).encode
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def __getitem__(self, word: bytes) -> bytes:
        found = self.young.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                found = np.array(self.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            if len(self.young) >= CACHED_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found


@lru_cache
def known_ids(path: str) -> _Ids:
    """The words that this worker has met, over all its tasks."""
    return _Ids(path)


def token_bytes(text: str, ids: _Ids) -> bytes:
    """Ids of the text and the end, four bytes each.

    The vocabulary splits at white space and drops it, so words can be looked up one by one.
    """
    return b"".join([*map(ids.__getitem__, text.encode().split()), END.to_bytes(4, "little")])


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: documents cut where they exceed ``size`` tokens."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = known_ids(path)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                blob = token_bytes(text.as_py(), ids)
                for piece, at in enumerate(range(0, len(blob), 4 * size)):
                    part = blob[at : at + 4 * size]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return rows.mapInArrow(split, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Rows of up to three of the ``lengths`` (0: none), in falling order, that sum to ``size``."""
    lengths = lengths.astype(np.int32)
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    first, second = np.meshgrid(lengths, np.append(lengths, np.int32(0)), indexing="ij")
    first, second = first.ravel(), second.ravel()
    third = size - first - second
    fits = (first >= second) & (third <= second) & (third >= 0)
    first, second, third = first[fits], second[fits], third[fits]
    fits = (third == 0) | there[third]
    return np.column_stack([first, second, third])[fits]


def repeats(table: np.ndarray, counts: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative repeat counts of the patterns that fit the histogram in least squares.

    Image-space reconstruction: each step scales a count by the ratio of what its lengths should
    hold to what they hold, which keeps it non-negative and lowers the squared error.
    """
    width = len(counts)
    goal = counts.astype(float)
    goal[0] = 0
    inside = table > 0
    pull = np.where(inside, goal[table], 0).sum(axis=1)
    x = np.full(len(table), goal.sum() / max(1, 3 * len(table)))
    for _ in range(steps):
        held = sum(np.bincount(table[:, k], x * inside[:, k], minlength=width) for k in range(3))
        x *= pull / np.maximum(np.where(inside, held[table], 0).sum(axis=1), 1e-12)
    return x


class Plan:
    """Runs ``(length, first rank, count, first sequence, offset)``: consecutive ranks to consecutive sequences."""

    def __init__(self, counts: np.ndarray, size: int):
        self.left, self.size = counts.astype(np.int64).copy(), size
        self.used = np.zeros(size + 1, np.int64)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, int(self.used[length]), count, sequence, offset))
        self.used[length] += count
        self.left[length] -= count

    def fill_patterns(self, table: np.ndarray, x: np.ndarray) -> None:
        """Rounded repeat counts, the largest first, as far as there are pieces."""
        for i in np.argsort(-x, kind="stable"):
            lengths = [v for v in table[i].tolist() if v]
            most = min(int(self.left[v]) // lengths.count(v) for v in lengths)
            count = min(most, max(1, int(x[i] + 0.5)))
            if count > 0:
                offset = 0
                for v in lengths:
                    self.place(v, count, self.sequences, offset)
                    offset += v
                self.sequences += count

    def fill_rest(self) -> None:
        """Longest first, each into the fullest sequences that hold it; equal sequences are one group."""
        room: dict[int, list[list[int]]] = {}
        for length in range(self.size, 0, -1):
            while self.left[length]:
                fitting = min((r for r in room if r >= length), default=None)
                if fitting is None:
                    fitting, per = self.size, self.size // length
                    first, group = self.sequences, -(-int(self.left[length]) // per)
                    self.sequences += group
                else:
                    per = fitting // length
                    first, group = room[fitting].pop()
                    if not room[fitting]:
                        del room[fitting]
                left = int(self.left[length])
                full = min(group, left // per)
                offset = self.size - fitting
                for k in range(per if full else 0):
                    self.place(length, full, first, offset + k * length)
                rest = min(left - full * per, per - 1) if full < group else 0
                for k in range(rest):
                    self.place(length, 1, first + full, offset + k * length)
                done = ((first, full, fitting - per * length), (first + full, bool(rest), fitting - rest * length),
                        (first + full + bool(rest), group - full - bool(rest), fitting))
                for start, n, space in done:
                    if n and space:
                        room.setdefault(space, []).append([start, int(n)])


def plan(counts: np.ndarray, size: int = SEQUENCE) -> np.ndarray:
    """Runs for a histogram (``counts[length]``), sorted by length and first rank."""
    made = Plan(counts, size)
    table = patterns(np.flatnonzero(counts), size)
    if len(table):
        made.fill_patterns(table, repeats(table, counts))
    made.fill_rest()
    runs = np.array(made.runs, np.int64).reshape(-1, 5)
    return runs[np.lexsort((runs[:, 1], runs[:, 0]))]


RANK_BITS = 48


def pack(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece.

    ``path`` names a tokenizer file that every executor has. A null or empty text is the end token
    alone; repeated rows are packed one by one; an empty table gives an empty result.
    """
    found = cut(pieces(docs, path, size))
    counts = np.zeros(size + 1, np.int64)
    for row in found.groupBy("length").count().collect():  # one row per length
        counts[row["length"]] = row["count"]
    runs = plan(counts, size)
    shared = docs.sparkSession.sparkContext.broadcast(runs)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        keys = runs[:, 0] << RANK_BITS | runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run = runs[np.searchsorted(keys, length << RANK_BITS | rank, side="right") - 1]
            sequence = run[:, 3] + rank - run[:, 1]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(run[:, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = ordinal(found, ["doc_id", "piece", "ids_crc32"], ["length"], "rank")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(placed, schema)
