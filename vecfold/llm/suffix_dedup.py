"""Removing passages that an earlier document holds, by a distributed merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller
id. Equal strings have equal content, so it is enough to sort the suffixes that start at anchors:
the place of the least hash among the short grams of a string is the same in every copy of it. All
strings with one anchor make one record: the bytes right of the anchor, then those left of it.

1. An anchor gram that one document alone has cannot repeat. The hashes of all anchors are exchanged
   once, packed, and those of two documents or more are marked.
2. Each block sorts the records of its marked anchors into a run, keeps equal records once with
   their smallest id, deals the run by gram hash into pieces, and front-codes each piece: how many
   bytes a record shares with the one before, then the rest.
3. The pieces of a deal are merged by a loser tree that plays by common prefixes: the prefix a record
   shares with the last winner is known from the front code, a longer one wins without a look at the
   bytes, and where two are equal bytes are compared from there on.
4. Records of one gram are neighbours in the merged run. For each string in them the smallest id is
   found, and each block gets back one bit per string of each record it sent.
5. The strings are laid over the texts again, and covered bytes go.

A deal gets each record at most once from a block, so a passage that a third of all documents hold
weighs no more than one record per block. A gram that documents hold in different surroundings gives
one record for each of these, and they stay in one deal.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecfold.llm.blocks import NO_ID, Block, answered, build, compress, expand, rows_of, stored

LENGTH = 50
# Bytes of an anchor gram; a string of LENGTH bytes holds WINDOW of them.
GRAM = 24
WINDOW = LENGTH - GRAM + 1
BLOCK_BYTES = 4 << 20
# Distinct records whose strings are compared at once, unless one gram has more.
ROWS_AT_ONCE = 1 << 13
# Strings whose anchors are found at once; a stretch cut here gives two records.
STRINGS_AT_ONCE = 1 << 18
# Text bytes for each deal of hashes and of records.
HASH_DEAL, RECORD_DEAL = 8 << 20, 2 << 20
HASH_BITS = 40
PLACE_BITS = np.uint64(32)
# A record: bytes from the anchor on, bytes before it (at the right end of their field), both lengths.
RIGHT, LEFT = LENGTH, WINDOW - 1
WIDTH = RIGHT + LEFT + 2


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every gram of ``GRAM`` bytes."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    eights = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    eights = np.ascontiguousarray(eights).view("<u8").ravel()
    mixed = eights[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k, odd in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9)):
        mixed ^= mixed >> np.uint64(31)
        mixed += eights[k : k + n]
        mixed *= np.uint64(odd)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ mixed >> np.uint64(32)


def anchors(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start, hash) of each stretch of strings that have one anchor.

    The anchor of a string is the leftmost least hash among its grams, so strings of a document with
    one anchor start at consecutive places. Strings that would cross documents are left out.
    """
    data = np.frombuffer(block.data, np.uint8)
    # how many documents hold the string that starts here: one, or none where it would cross
    inside = np.zeros(len(data) + 1, np.int8)
    long = block.ends - block.starts >= LENGTH
    inside[block.starts[long]] += 1
    inside[block.ends[long] - LENGTH + 1] -= 1
    np.cumsum(inside, out=inside)
    found = []
    for begin in range(0, len(data) - LENGTH + 1, STRINGS_AT_ONCE):
        found.append(_anchors_from(data, begin, inside))
    if not found:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchors_from(data: np.ndarray, begin: int, inside: np.ndarray):
    """``anchors`` of at most ``STRINGS_AT_ONCE`` strings."""
    hashes = gram_hashes(data[begin : begin + STRINGS_AT_ONCE + LENGTH - 1])
    starts = len(hashes) - WINDOW + 1
    least = (hashes >> PLACE_BITS << PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = WINDOW - width
    least = np.minimum(least[:starts], least[rest : rest + starts])
    valid = np.flatnonzero(inside[begin : begin + starts])
    at = (least[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edges = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    last = valid[np.append(edges[1:], len(valid)) - 1] if len(edges) else edges
    codes = hashes[at[edges]] >> np.uint64(64 - HASH_BITS)
    return begin + at[edges], begin + valid[edges], begin + last, codes


def documents_of(block: Block, places: np.ndarray) -> np.ndarray:
    return block.ids[np.searchsorted(block.ends, places, side="right")]


def _deal(codes: np.ndarray, deals: int) -> np.ndarray:
    """Which of ``deals`` equal stretches of the hash range a hash falls in."""
    return (codes * np.uint64(deals) >> np.uint64(HASH_BITS)).astype(np.int64)


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([],) * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _ask_hashes(deals: int):
    """Distinct anchor hashes of a block by deal, with a bit for those of two documents here."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, block, _ in rows_of(batch):
                at, _, _, codes = anchors(block)
                order = np.argsort(codes, kind="stable")
                codes, docs = codes[order], documents_of(block, at[order])
                distinct, starts = np.unique(codes, return_index=True)
                if not len(distinct):
                    continue
                several = np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts)
                cuts = np.searchsorted(_deal(distinct, deals), np.arange(deals + 1))
                rows = []
                for deal in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(cuts[deal], cuts[deal + 1])
                    packed = distinct[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8]
                    rows.append((deal, number, packed.tobytes(), np.packbits(several[part]).tobytes()))
                yield _table(rows, ["part", "block", "codes", "several"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    return ask


def _mark(group: pa.Table) -> pa.Table:
    """Per block a bit for each of its hashes: two documents have it."""
    size = HASH_BITS // 8
    codes, several, counts = [], [], []
    for packed, bits in zip(group.column("codes").to_pylist(), group.column("several").to_pylist()):
        raw = np.frombuffer(packed, np.uint8).reshape(-1, size)
        codes.append(np.pad(raw, ((0, 0), (0, 8 - size))).view("<u8").ravel())
        several.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(raw)))
        counts.append(len(raw))
    every = np.concatenate(codes)
    _, inverse, times = np.unique(every, return_inverse=True, return_counts=True)
    again = np.bincount(inverse, np.concatenate(several), minlength=len(times)) > 0
    marked = ((times > 1) | again)[inverse]
    answers = [np.packbits(m).tobytes() for m in np.split(marked, np.cumsum(counts)[:-1])]
    return pa.table({"block": group.column("block"), "part": group.column("part"), "answer": pa.array(answers, pa.binary())})


class Run:
    """The sorted, distinct records of a block's marked anchors."""

    def __init__(self, block: Block, parts: list[int], marks: list[bytes], deals: int):
        at, first, last, codes = anchors(block)
        distinct = np.unique(codes)
        cuts = np.searchsorted(_deal(distinct, deals), np.arange(deals + 1))
        marked = np.zeros(len(distinct), bool)
        for part, bits in zip(parts, marks):
            n = cuts[part + 1] - cuts[part]
            marked[cuts[part] : cuts[part + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
        keep = marked[np.searchsorted(distinct, codes)] if len(distinct) else np.empty(0, bool)
        self.at, self.first, self.last, codes = at[keep], first[keep], last[keep], codes[keep]
        self.docs = documents_of(block, self.at)
        # fields by gathering from padded bytes, then blanking what is beyond the record
        data = np.pad(np.frombuffer(block.data, np.uint8), (LEFT, RIGHT))
        right, left = self.last + LENGTH - self.at, self.at - self.first
        rows = np.zeros((len(self.at), WIDTH), np.uint8)
        for k in range(RIGHT):
            rows[:, k] = np.where(k < right, data[self.at + LEFT + k], 0)
        for k in range(LEFT):
            rows[:, RIGHT + k] = np.where(LEFT - k <= left, data[self.at + k], 0)
        rows[:, -2], rows[:, -1] = right, left
        order = np.argsort(rows.view(f"V{WIDTH}").ravel(), kind="stable")
        rows = rows[order]
        fresh = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))[: len(rows)]
        self.of = np.empty(len(rows), np.int64)
        self.of[order] = np.cumsum(fresh) - 1
        self.records, starts = rows[fresh], np.flatnonzero(fresh)
        self.low = np.minimum.reduceat(self.docs[order], starts) if len(rows) else self.docs
        self.code = codes[order][fresh]


def front_coded(records: np.ndarray, low: np.ndarray) -> bytes:
    """Shared prefix lengths, the rests, and the smallest ids of sorted records."""
    shared = np.zeros(len(records), np.uint8)
    if len(records) > 1:
        shared[1:] = (records[1:] != records[:-1]).argmax(axis=1)
    rest = records[np.arange(WIDTH)[None, :] >= shared[:, None]]
    return compress(b"".join([len(records).to_bytes(8, "little"), shared.tobytes(), low.astype("<i8").tobytes(), rest.tobytes()]))


def decoded(blob: bytes) -> tuple[list[int], np.ndarray, list[bytes]]:
    """(shared prefix lengths, smallest ids, records) of a front-coded piece."""
    data = expand(blob)
    n = int.from_bytes(data[:8], "little")
    shared = list(data[8 : 8 + n])
    low = np.frombuffer(data, "<i8", n, 8 + n)
    records, record, at = [], b"", 8 + 9 * n
    for lcp in shared:
        end = at + WIDTH - lcp
        record = record[:lcp] + data[at:end]
        records.append(record)
        at = end
    return shared, low, records


def _send_runs(hash_deals: int, deals: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, block, row in rows_of(batch):
                run = Run(block, batch.column("parts")[row].as_py() or [], batch.column("answers")[row].as_py() or [], hash_deals)
                rows, dealt = [], _deal(run.code, deals)
                for deal in np.unique(dealt).tolist():
                    mine = dealt == deal
                    rows.append((deal, number, front_coded(run.records[mine], run.low[mine])))
                yield _table(rows, ["part", "block", "piece"], [pa.int64(), pa.int64(), pa.binary()])

    return send


def merge(runs: list[tuple[list[int], list[bytes]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, place in the run, prefix shared with the record before) of all records in order.

    A loser tree: inner nodes hold the loser of the match played there and the prefix it shares with
    the winner. What enters from a run shares a known prefix with the last winner, as all losers on its
    way up do; the longer prefix wins, and only equal ones are compared, from their end on.
    """
    count = len(runs)
    done = (-1, -1)
    heads = [records[0] for _, records in runs]
    places = [0] * count
    losers: list[tuple[int, int]] = [done] * count

    def play(run: int, lcp: int, node: int) -> tuple[int, int]:
        """Plays a run up the tree; an exhausted run has a prefix of -1 and loses to all."""
        while node:
            other, known = losers[node]
            if known > lcp:
                losers[node], run, lcp = (run, lcp), other, known
            elif known == lcp and lcp >= 0:
                a, b = heads[run], heads[other]
                if a == b:
                    losers[node] = (other, WIDTH)
                else:
                    at = lcp
                    while a[at] == b[at]:
                        at += 1
                    if a[at] < b[at]:
                        losers[node] = (other, at)
                    else:
                        losers[node], run = (run, at), other
            node >>= 1
        return run, lcp

    # the first matches, from the leaves: nothing has been won, so every prefix is 0
    alive: dict[int, tuple[int, int]] = {}
    for run in range(count):
        node, entry = (run + count) >> 1, (run, 0)
        while node and node in alive:
            other, known = alive.pop(node)
            a, b = heads[entry[0]], heads[other]
            at = next((k for k in range(WIDTH) if a[k] != b[k]), WIDTH)
            if at == WIDTH or a[at] < b[at]:
                losers[node] = (other, at)
            else:
                losers[node], entry = (entry[0], at), (other, 0)
            node >>= 1
        if node:
            alive[node] = entry
        else:
            winner = entry
    run, lcp = winner
    order = []
    while lcp >= 0:
        place = places[run]
        order.append((run, place, lcp))
        shared, records = runs[run]
        places[run] = place = place + 1
        if place < len(records):
            heads[run] = records[place]
            run, lcp = play(run, shared[place], (run + count) >> 1)
        else:
            run, lcp = play(run, -1, (run + count) >> 1)
    return tuple(np.array(order, np.int64).reshape(-1, 3).T)


def smallest_ids(records: np.ndarray, low: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For merged records (one row each), the smallest id of each of their strings; columns by start."""
    fresh = lcp < WIDTH
    fresh[:1] = True
    record = np.cumsum(fresh) - 1
    starts = np.flatnonzero(fresh)
    rows, least = records[starts], np.minimum.reduceat(low, starts)
    head = lcp[starts] < GRAM
    head[:1] = True
    sizes = np.diff(np.append(np.flatnonzero(head), len(rows)))
    shared = np.repeat(sizes > 1, sizes)
    out = np.repeat(least[:, None], WINDOW, axis=1)
    # whole groups at a time, so what is spread out is bounded
    wanted = np.flatnonzero(shared)
    ends = np.cumsum(sizes[sizes > 1])
    begin = 0
    while begin < len(wanted):
        end = ends[np.searchsorted(ends, begin + ROWS_AT_ONCE, side="right") - 1] if ends[0] <= begin + ROWS_AT_ONCE else ends[0]
        end = end if end > begin else ends[np.searchsorted(ends, begin, side="right")]
        part = wanted[begin:end]
        out[part] = _least_of_strings(rows[part], least[part], out[part])
        begin = int(end)
    return out[record]


def _least_of_strings(rows: np.ndarray, least: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``out`` with the smallest id of every string that the distinct records ``rows`` hold."""
    # bytes in text order: left field, right field; the string at start t begins left + t bytes in
    flat = np.hstack([rows[:, RIGHT : RIGHT + LEFT], rows[:, :RIGHT]])
    right, left = rows[:, -2].astype(int), rows[:, -1].astype(int)
    which, start = np.nonzero(np.arange(WINDOW)[None, :] < (left + right - LENGTH + 1)[:, None])
    begin = LEFT - left[which] + start
    strings = np.zeros((len(which), LENGTH + 1), np.uint8)
    for k in range(LENGTH):
        strings[:, k] = flat[which, begin + k]
    strings[:, -1] = begin  # where the anchor is in the string
    order = np.argsort(strings.view(f"V{LENGTH + 1}").ravel(), kind="stable")
    strings = strings[order]
    new = np.append(True, (strings[1:] != strings[:-1]).any(axis=1))
    lowest = np.minimum.reduceat(least[which][order], np.flatnonzero(new))
    found = np.empty(len(which), np.int64)
    found[order] = lowest[np.cumsum(new) - 1]
    out[which, start] = found
    return out


def _merge_pieces(group: pa.Table) -> pa.Table:
    pieces = [decoded(p) for p in group.column("piece").to_pylist()]
    run, place, lcp = merge([(shared, records) for shared, _, records in pieces])
    offsets = np.append(0, np.cumsum([len(p[2]) for p in pieces]))
    at = offsets[run] + place
    every = np.frombuffer(b"".join(b"".join(p[2]) for p in pieces), np.uint8).reshape(-1, WIDTH)
    low = np.concatenate([p[1] for p in pieces])
    earlier = smallest_ids(every[at], low[at], lcp.copy()) < low[at][:, None]
    bits = (earlier.astype(np.uint32) << np.arange(WINDOW, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
    back = np.empty(len(at), "<u4")
    back[at] = bits
    answers = [compress(back[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
    return pa.table({"block": group.column("block"), "part": group.column("part"), "answer": pa.array(answers, pa.binary())})


def covered_bytes(block: Block, run: Run, bits: np.ndarray) -> np.ndarray:
    """Which bytes of the block lie in strings that an earlier document has; ``bits`` is by record."""
    lowest = run.docs == run.low[run.of]
    flags = np.where(lowest, bits[run.of] if len(bits) else 0, 0xFFFFFFFF)
    edges = np.zeros(len(block.data) + 1, np.int32)
    for start in range(WINDOW):
        begin = run.first[(flags >> start & 1).astype(bool) & (run.first + start <= run.last)] + start
        np.add.at(edges, begin, 1), np.add.at(edges, begin + LENGTH, -1)
    np.cumsum(edges, out=edges)
    return edges[:-1] > 0


def _remove(hash_deals: int, deals: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, block, row in rows_of(batch):
                run = Run(block, batch.column("parts")[row].as_py() or [], batch.column("answers")[row].as_py() or [], hash_deals)
                bits, dealt = np.zeros(len(run.records), np.uint32), _deal(run.code, deals)
                for part, answer in zip(batch.column("record_parts")[row].as_py() or [], batch.column("record_answers")[row].as_py() or []):
                    bits[dealt == part] = np.frombuffer(expand(answer), "<u4")
                gone = covered_bytes(block, run, bits)
                data, rows = np.frombuffer(block.data, np.uint8), []
                for doc_id, a, b in zip(block.ids.tolist(), block.starts.tolist(), block.ends.tolist()):
                    out = gone[a:b]
                    removed = int(out.sum())
                    spans = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()) if removed else 0
                    kept = data[a:b][~out].tobytes() if removed else block.data[a:b]
                    rows.append((None if doc_id == NO_ID else doc_id, b - a, removed, spans, kept))
                yield _table(rows, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"], [pa.int64()] * 4 + [pa.binary()])

    return remove


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes left) per row of ``docs``.

    A null text is empty; rows without id come after all others and lose nothing to each other, nor
    do repeated rows of one id; texts shorter than a string stay whole; an empty table gives an empty result.
    """
    blocks, total = build(docs, BLOCK_BYTES)
    hash_deals, deals = max(1, -(-total // HASH_DEAL)), max(1, -(-total // RECORD_DEAL))
    asked = blocks.mapInArrow(_ask_hashes(hash_deals), "part long, block long, codes binary, several binary")
    marks, _ = stored(asked.groupBy("part").applyInArrow(_mark, "block long, part long, answer binary"))
    marked = answered(blocks, marks)
    sent = marked.mapInArrow(_send_runs(hash_deals, deals), "part long, block long, piece binary")
    found, _ = stored(sent.groupBy("part").applyInArrow(_merge_pieces, "block long, part long, answer binary"))
    records = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "answer"))).alias("of"))
    records = records.select(F.col("block").alias("_of"), F.col("of.part").alias("record_parts"), F.col("of.answer").alias("record_answers"))
    both = marked.join(records, F.col("block") == F.col("_of"), "left").drop("_of")
    return both.mapInArrow(_remove(hash_deals, deals), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
