"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

A token's chance is that of its class given the words before it, times that of the word in its
class. Classes are bands of training frequency, split by a hash of the word's ending. The class
is a softmax over hashed features of the two words before: the nearer word, the farther one (a skip), and
both together. Inside a class the word is a softmax over all words of the class with the same features: a
word's score is the logarithm of its share by training counts (the lowest band shares evenly among the
words seen once and one unknown word), plus a weight for each of its two hash codes from every feature.
The sum over a class's words is exact: words with the same two codes have the same weights, so it is a
sum over pairs of codes, each with the share of its words.

Texts are split once: a block is written as its distinct words and its tokens as numbers of them, which every
later pass reads. Word counts are exact and over the whole training part: blocks send their distinct words, dealt by
hash, and get the counts back in the same order. Features are trained in turns: every turn takes its share
of the blocks, each task runs gradient steps on its blocks from the current weights, and the changes
are averaged in a tree, each feature weighted by how often a task saw it. Weights have a fixed size.
"""

from __future__ import annotations

import math
import uuid
import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecfold.llm.blocks import NO_ID, answered, build, compress, expand, stored
from vecfold.plans.lineage import scratch_dir

FOLDS, HELD_OUT = 7, 2
BLOCK_BYTES = 4 << 20
# Text bytes for each deal of words.
WORD_DEAL = 32 << 20
# The end of a text; no word is empty.
END = b""
BANDS, ENDINGS, ENDING_BYTES = 8, 4, 2
CLASSES = BANDS * ENDINGS
# Word counts are told apart by quarters of their binary logarithm.
STEPS = 256
# Buckets of the nearer word, of the farther one, and of both.
BUCKETS = (2048, 2048, 4096)
FEATURES = sum(BUCKETS)
assert FEATURES <= 1 << 15
# Each word has two hash codes, so a class tells CODES * CODES kinds of words apart.
CODES, MOST_SCORE = 32, 20.0
COLUMNS = CLASSES + 2 * CODES
GROUPS = slice(0, CLASSES), slice(CLASSES, CLASSES + CODES), slice(CLASSES + CODES, COLUMNS)
SCHEMA = "block long, ids binary, lengths binary, words binary, tokens binary"
TURNS, RATE, TOKENS_AT_ONCE = 3, 0.5, 8192
SLICES, FAN = 4, 64
OFTEN = 24


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(b"" if doc_id == NO_ID else str(doc_id).encode()) % FOLDS == HELD_OUT


def _tokenised(number: int, ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
    """A block's row: its distinct words in sorted order, and its tokens as numbers of them."""
    split = [t.lower().split() for t in texts]
    words = sorted({END}.union(*split))
    place = {w: i for i, w in enumerate(words)}
    lengths = np.array([len(t) + 1 for t in split], "<i8")
    at = np.empty(int(lengths.sum()), _number_type(len(words)))
    start = 0
    for text in split:
        at[start : start + len(text)] = np.fromiter(map(place.__getitem__, text), at.dtype, len(text))
        at[start + len(text)] = place[END]
        start += len(text) + 1
    columns = [number], [np.array(ids, "<i8").tobytes()], [lengths.tobytes()], [compress(b" ".join(words))], [compress(at.tobytes())]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int64(), *(pa.binary(),) * 4))], ["block", "ids", "lengths", "words", "tokens"]
    )


def _number_type(words: int) -> str:
    return "<u2" if words <= 1 << 16 else "<i4"


class Tokens:
    """A block's tokens as numbers of its distinct words in sorted order."""

    def __init__(self, ids: bytes, lengths: bytes, words: bytes, tokens: bytes):
        self.ids, self.lengths = np.frombuffer(ids, "<i8"), np.frombuffer(lengths, "<i8")
        self.words = expand(words).split(b" ")
        self.at = np.frombuffer(expand(tokens), _number_type(len(self.words))).astype(np.int32)
        self.starts = np.append(0, np.cumsum(self.lengths)[:-1]).astype(np.int64)
        self.held_out = np.array([is_held_out(i) for i in self.ids.tolist()], bool)
        self.in_training = np.repeat(~self.held_out, self.lengths)

    def features(self) -> np.ndarray:
        """Rows of the weights that each token's context has, one column per kind."""
        codes = np.fromiter(map(zlib.crc32, self.words), np.uint32, len(self.words)).astype(np.uint64)
        odd = np.uint64(0x9E3779B97F4A7C15)
        mixed = np.append(codes, np.uint64(0x1234567)) * odd  # the last stands before the text
        nearer, farther = np.full(len(self.at), len(codes)), np.full(len(self.at), len(codes))
        nearer[1:], farther[2:] = self.at[:-1], self.at[:-2]
        nearer[self.starts] = farther[self.starts] = len(codes)
        second = self.starts[self.lengths > 1] + 1
        farther[second] = len(codes)
        a, b = mixed[nearer], mixed[farther] ^ np.uint64(0x5851F42D4C957F2D)
        both = (a ^ (b >> np.uint64(7))) * odd
        out, base = np.empty((len(self.at), 3), np.int64), 0
        for k, (code, size) in enumerate(zip((a, b * odd, both), BUCKETS)):
            out[:, k] = base + (code >> np.uint64(33)) % np.uint64(size)
            base += size
        return out


def ending(word: bytes) -> int:
    return zlib.crc32(word[-ENDING_BYTES:]) % ENDINGS


def codes_of(words) -> np.ndarray:
    """Two codes per word, one row for each."""
    mixed = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([(mixed >> np.uint64(shift)) % np.uint64(CODES) for shift in (36, 52)]).astype(np.int64)


def tokens_of(batch: pa.RecordBatch) -> Iterator[tuple[int, Tokens, int]]:
    """(block number, tokens, row of the batch)."""
    for row, number in enumerate(batch.column("block").to_pylist()):
        yield number, Tokens(*(batch.column(c)[row].as_py() for c in ("ids", "lengths", "words", "tokens"))), row


def _ask_counts(deals: int):
    """A block's distinct words by deal, with their counts in training texts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, tokens, _ in tokens_of(batch):
                counts = np.bincount(tokens.at[tokens.in_training], minlength=len(tokens.words))
                deal = deals_of(tokens.words, deals)
                rows = []
                for part in np.unique(deal).tolist():
                    mine = np.flatnonzero(deal == part)
                    words = compress(b" ".join([tokens.words[i] for i in mine]))
                    rows.append((part, number, words, counts[mine].astype("<i8").tobytes()))
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                    ["part", "block", "words", "counts"],
                )

    return ask


def deals_of(words: list[bytes], deals: int) -> np.ndarray:
    return np.fromiter(map(zlib.adler32, words), np.int64, len(words)) * 2654435761 % (1 << 32) % deals


def steps_of(counts: np.ndarray) -> np.ndarray:
    """Quarters of the binary logarithm; words that were never seen count with those seen once."""
    return np.minimum((4 * np.log2(np.maximum(counts, 1))).astype(np.int64), STEPS - 1)


def _add_counts(group: pa.Table) -> pa.Table:
    """Counts of the whole corpus for each block's words; block -1 has the types and tokens per step, ending and codes."""
    totals: dict[bytes, int] = {}
    asked = []
    for words, counts in zip(group.column("words").to_pylist(), group.column("counts").to_pylist()):
        asked.append(expand(words).split(b" "))
        for word, count in zip(asked[-1], np.frombuffer(counts, "<i8").tolist()):
            totals[word] = totals.get(word, 0) + count
    answers = [compress(np.array([totals[w] for w in words], "<i8").tobytes()) for words in asked]
    counts = np.fromiter(totals.values(), np.int64, len(totals))
    known = counts > 0
    cell = steps_of(counts) * ENDINGS + np.fromiter(map(ending, totals), np.int64, len(totals))
    first, second = codes_of(totals)
    cells, at = np.unique(((cell * CODES + first) * CODES + second)[known], return_inverse=True)
    table = np.stack([cells, *(np.bincount(at, w, minlength=len(cells)) for w in (np.ones(len(at)), counts[known]))])
    return pa.table({
        "block": pa.array([*group.column("block").to_pylist(), -1], pa.int64()),
        "part": pa.array([*group.column("part").to_pylist(), group.column("part")[0].as_py()], pa.int64()),
        "answer": pa.array([*answers, compress(table.astype("<i8").tobytes())], pa.binary()),
    })


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for answer in batch.column("answer"):
            columns = np.frombuffer(expand(answer.as_py()), "<i8").reshape(3, -1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "types", "mass"])


def cell_totals(counts: DataFrame) -> np.ndarray:
    """Cells that hold words, and their types and tokens: at most steps x endings x pairs of codes, whatever the number of deals."""
    flat = counts.filter("block = -1").select("answer").mapInArrow(_cells, "cell long, types long, mass long")
    found = flat.groupBy("cell").agg(F.sum("types").alias("types"), F.sum("mass").alias("mass")).toArrow()
    return np.stack([found.column(c).to_numpy() for c in ("cell", "types", "mass")]).astype(np.int64)


class Classes:
    """Bands of frequency with about equal mass, and what each class holds.

    ``table`` has types and tokens per step and ending; ``coded`` has them per step, ending and pair of codes.
    """

    @classmethod
    def of_cells(cls, cells: np.ndarray) -> Classes:
        coarse = cells[0] // (CODES * CODES)
        return cls(np.stack([np.bincount(coarse, w, minlength=STEPS * ENDINGS) for w in cells[1:]]).astype(np.int64), cells)

    def __init__(self, table: np.ndarray, coded: np.ndarray | None = None):
        types, mass = (t.reshape(STEPS, ENDINGS) for t in table)
        self.vocabulary, self.tokens = int(types.sum()), int(mass.sum())
        upper = mass.sum(axis=1)
        upper[0] = 0
        share = np.cumsum(upper) / max(1, upper.sum())
        self.band = np.minimum(1 + (share - upper / max(1, upper.sum()) / 2) * (BANDS - 1), BANDS - 1).astype(np.int64)
        self.band[0] = 0
        self.mass, self.types = np.zeros(CLASSES), np.zeros(CLASSES)
        for step in range(STEPS):
            cells = self.band[step] * ENDINGS + np.arange(ENDINGS)
            self.mass[cells] += mass[step]
            self.types[cells] += types[step]
        # what the words with a pair of codes have of their class, and what an unknown word has
        self.shares = np.zeros((CLASSES, CODES, CODES), np.float32)
        self.unknown = np.zeros(CLASSES, np.float32)
        self.unknown[:ENDINGS] = 1 / (self.types[:ENDINGS] + 1)
        if coded is not None:
            place, kinds, tokens = coded
            coarse, codes = np.divmod(place, CODES * CODES)
            which = self.band[coarse // ENDINGS] * ENDINGS + coarse % ENDINGS
            even = which < ENDINGS
            part = np.where(even, kinds / (self.types[which] + 1), tokens / np.maximum(self.mass[which], 1))
            self.shares = np.bincount(which * CODES * CODES + codes, part, CLASSES * CODES * CODES)
            self.shares = self.shares.reshape(CLASSES, CODES, CODES).astype(np.float32)

    def of(self, counts: np.ndarray, endings: np.ndarray) -> np.ndarray:
        return self.band[steps_of(counts)] * ENDINGS + endings

    def log_in_class(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its class, which is its chance where no feature has a weight."""
        even = classes < ENDINGS
        share = np.where(even, 1.0, counts) / np.where(even, self.types[classes] + 1, np.maximum(self.mass[classes], 1))
        return np.log10(share)


def block_counts(tokens: Tokens, parts: list[int], answers: list[bytes], deals: int) -> np.ndarray:
    counts, deal = np.zeros(len(tokens.words), np.int64), deals_of(tokens.words, deals)
    for part, answer in zip(parts, answers):
        counts[deal == part] = np.frombuffer(expand(answer), "<i8")
    return counts


def context_factors(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """What the features of each context multiply the chances of the classes and of the codes of words with.

    Scores are held within ``MOST_SCORE``, so that no product of two factors leaves the range of the numbers.
    """
    scores = weights.take(rows[:, 0], 0)
    scores += weights.take(rows[:, 1], 0)
    scores += weights.take(rows[:, 2], 0)
    np.maximum(scores, np.float32(-MOST_SCORE), out=scores)
    np.minimum(scores, np.float32(MOST_SCORE), out=scores)
    return np.exp(scores, out=scores)


def inside_sums(factors: np.ndarray, goal: np.ndarray, classes: Classes, chances: np.ndarray | None = None) -> np.ndarray:
    """For contexts in the order of their classes ``goal``: the sum of share times factors over all words of the class.

    ``chances``, if given, is filled with each code's chance in the class.
    """
    one, two = factors[:, GROUPS[1]], factors[:, GROUPS[2]]
    across = np.empty((len(goal), 2 * CODES), np.float32) if chances is None else chances
    ends = np.searchsorted(goal, np.arange(CLASSES + 1))
    for c in np.flatnonzero(np.diff(ends)).tolist():
        part = slice(ends[c], ends[c + 1])
        across[part, CODES:] = one[part] @ classes.shares[c]
        if chances is not None:
            across[part, :CODES] = two[part] @ classes.shares[c].T
    total = np.einsum("ij,ij->i", across[:, CODES:], two) + classes.unknown[goal]
    if chances is not None:
        across *= factors[:, CLASSES:]
        across *= (1 / total)[:, None]
    return total


def word_chances(factors: np.ndarray, goal: np.ndarray, codes: np.ndarray, known: np.ndarray, inside: np.ndarray, classes: Classes) -> np.ndarray:
    """log10 of words' chances in their classes ``goal``, which are in order; ``inside`` are the logarithms of their shares."""
    at = np.arange(len(goal))
    own = factors[at, CLASSES + codes[0]].astype(float) * factors[at, CLASSES + CODES + codes[1]]
    return inside + np.log10(np.where(known, own, 1.0) / inside_sums(factors, goal, classes))


def prepared(batch: pa.RecordBatch, classes: Classes, deals: int):
    """(tokens, and counts, classes and codes of the words) for each row of ``answered`` blocks."""
    for _, tokens, row in tokens_of(batch):
        counts = block_counts(tokens, batch.column("parts")[row].as_py(), batch.column("answers")[row].as_py(), deals)
        endings = np.fromiter(map(ending, tokens.words), np.int64, len(tokens.words))
        yield tokens, counts, classes.of(counts, endings), codes_of(tokens.words)


def in_class_order(word_class: np.ndarray, now: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words by class, and what goes with each of them."""
    order = np.argsort(word_class[now].astype(np.int16), kind="stable")
    return now[order], *(x[order] for x in others)


def sums_by(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``rows``, how often each comes, and the sums of its values.

    Rows that come often are summed one by one, the others a place at a time.
    """
    # places of the weights fit into 16 bits, which are sorted by counting
    order = np.argsort(rows.astype(np.int16), kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(rows[order]) != 0))
    times = np.diff(np.append(first, len(rows)))
    by_times = np.argsort(-times, kind="stable")
    first, times = first[by_times], times[by_times]
    sums = values.take(order[first], 0)
    ends = np.searchsorted(-times, -np.arange(OFTEN + 1))  # how many come more than so many times
    for k in range(ends[OFTEN]):
        values.take(order[first[k] : first[k] + times[k]], 0).sum(axis=0, out=sums[k])
    for place in range(1, OFTEN):
        some = slice(ends[OFTEN], ends[place])
        sums[some] += values.take(order[first[some] + place], 0)
    return rows[order[first]], times, sums


def _train(shared, classes: Classes, deals: int):
    """Gradient steps over a task's blocks; per slice of the features the changes and how often they were seen."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, prior = shared.value
        weights, squares = start.copy(), np.full((len(GROUPS), FEATURES), 1e-2, np.float32)
        seen = np.zeros(FEATURES, np.int64)
        for batch in batches:
            for tokens, _, word_class, codes in prepared(batch, classes, deals):
                rows, words = tokens.features()[tokens.in_training], tokens.at[tokens.in_training]
                for at in range(0, len(rows), TOKENS_AT_ONCE):
                    now = words[at : at + TOKENS_AT_ONCE]
                    now, part = in_class_order(word_class, now, rows[at : at + TOKENS_AT_ONCE])
                    target, each = word_class[now], np.arange(len(now))
                    factors, slope = context_factors(weights, part), np.empty((len(now), COLUMNS), np.float32)
                    inside_sums(factors, target, classes, slope[:, CLASSES:])
                    np.multiply(factors[:, GROUPS[0]], prior, out=slope[:, GROUPS[0]])
                    slope[:, GROUPS[0]] *= (1 / (factors[:, GROUPS[0]] @ prior))[:, None]
                    slope[each, target] -= 1
                    slope[each, CLASSES + codes[0, now]] -= 1
                    slope[each, CLASSES + CODES + codes[1, now]] -= 1
                    for k in range(part.shape[1]):
                        which, times, mean = sums_by(part[:, k], slope)
                        mean *= (1 / times).astype(np.float32)[:, None]
                        for group, square in zip(GROUPS, squares):
                            square[which] += np.einsum("ij,ij->i", mean[:, group], mean[:, group])
                            mean[:, group] *= (RATE / np.sqrt(square[which]))[:, None]
                        weights[which] -= mean
                        seen[which] += times
        task, size = TaskContext.get().partitionId(), FEATURES // SLICES
        change = weights - start
        for k in range(SLICES):
            part = slice(k * size, (k + 1) * size)
            columns = [k], [task], [compress(change[part].astype("<f4").tobytes())], [seen[part].astype("<i8").tobytes()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                ["slice", "task", "change", "seen"],
            )

    return train


def _average(group: pa.Table) -> pa.Table:
    total, weight = 0.0, 0
    for change, seen in zip(group.column("change").to_pylist(), group.column("seen").to_pylist()):
        times = np.frombuffer(seen, "<i8")
        total = total + np.frombuffer(expand(change), "<f4").reshape(len(times), COLUMNS) * times[:, None].astype(float)
        weight = weight + times
    mean = total / np.maximum(weight, 1)[:, None]
    return pa.table({
        "slice": group.column("slice")[:1], "task": group.column("_group")[:1],
        "change": pa.array([compress(mean.astype("<f4").tobytes())], pa.binary()),
        "seen": pa.array([weight.astype("<i8").tobytes()], pa.binary()),
    })


def averaged(changes: DataFrame, tasks: int) -> np.ndarray:
    """The mean change of every feature, at most ``FAN`` rows at a time."""
    schema = changes.schema
    while True:
        grouped = changes.withColumn("_group", F.floor(F.col("task") / FAN).cast("long"))
        changes = grouped.groupBy("slice", "_group").applyInArrow(_average, schema)
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            rows = sorted(changes.collect(), key=lambda r: r["slice"])  # SLICES rows of fixed size
            return np.vstack([np.frombuffer(expand(r["change"]), "<f4").reshape(-1, COLUMNS) for r in rows])


def _score(shared, classes: Classes, deals: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, prior = shared.value
        n, v = classes.tokens, classes.vocabulary
        for batch in batches:
            for tokens, counts, word_class, codes in prepared(batch, classes, deals):
                base = np.log10(counts + 1) - math.log10(n + v + 1)
                inside, rows = classes.log_in_class(counts, word_class), tokens.features()
                model = np.empty(len(tokens.at))
                for at in range(0, len(rows), TOKENS_AT_ONCE):
                    place = np.arange(at, min(at + TOKENS_AT_ONCE, len(rows)))
                    now, place, part = in_class_order(word_class, tokens.at[place], place, rows[place])
                    factors, goal = context_factors(weights, part), word_class[now]
                    chances = factors[np.arange(len(now)), goal] * prior[goal] / (factors[:, GROUPS[0]] @ prior)
                    words = word_chances(factors, goal, codes[:, now], counts[now] > 0, inside[now], classes)
                    model[place] = np.log10(chances.astype(float)) + words
                sums = lambda x: np.add.reduceat(x, tokens.starts)
                ids = pa.array([None if i == NO_ID else i for i in tokens.ids.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(tokens.held_out), pa.array(tokens.lengths), pa.array(sums((counts > 0)[tokens.at].astype(np.int64))),
                     pa.array(np.full(len(ids), n)), pa.array(sums(base[tokens.at])), pa.array(sums(model))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return score


def scored(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``.

    A null or empty text is the end alone; a row without id is in the training part; repeated rows count
    each time; without training texts every word is unknown; an empty table gives an empty result.
    """
    blocks, total = build(docs, BLOCK_BYTES, _tokenised, SCHEMA)
    deals = max(1, -(-total // WORD_DEAL))
    asked = blocks.mapInArrow(_ask_counts(deals), "part long, block long, words binary, counts binary")
    counts, _ = stored(asked.groupBy("part").applyInArrow(_add_counts, "block long, part long, answer binary"))
    classes = Classes.of_cells(cell_totals(counts))
    path = f"{scratch_dir(docs.sparkSession)}/{uuid.uuid4().hex}"
    ready = answered(blocks, counts.filter("block >= 0")).withColumn("turn", F.pmod(F.xxhash64("block"), F.lit(TURNS)))
    ready.write.partitionBy("turn").option("compression", "none").parquet(path)
    ready = docs.sparkSession.read.schema(ready.schema).parquet(path)
    weights = np.zeros((FEATURES, COLUMNS), np.float32)
    prior = ((classes.mass + 1) / (classes.mass + 1).sum()).astype(np.float32)
    context = docs.sparkSession.sparkContext
    for turn in range(TURNS if classes.tokens else 0):
        step = _train(context.broadcast((weights, prior)), classes, deals)
        mine = ready.filter(F.col("turn") == turn).select("block", "ids", "lengths", "words", "tokens", "parts", "answers")
        changes, seen = stored(mine.mapInArrow(step, "slice long, task long, change binary, seen binary"), top=F.max("task"))
        if seen["n"]:
            weights = weights + averaged(changes, seen["top"] + 1)
    final = _score(context.broadcast((weights, prior)), classes, deals)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return ready.mapInArrow(final, schema)
