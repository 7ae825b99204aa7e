"""Best-fit packing of token sequences by minimum bin slack.

Pieces are counted by length. As no piece is longer than the capacity, that histogram has at most
`capacity` rows whatever the input's size, and it is all that the driver sees. Over it, bins are
planned one kind at a time: the longest length left opens the bin, a bitset subset-sum dynamic
programme over the other lengths finds the fullest feasible filling, and the combination is removed
as often as the counts allow. Every kind uses up a length, so the plan stays small too. Spark then
places the pieces: each takes a rank among the pieces of its length (counted in salted parts, so
that one very common length is spread), and rank and plan give sequence and offset.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquill.llm.common import slices, stored
from logquill.llm.token_ids import MEMO, encoder

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, memo: int = MEMO) -> DataFrame:
    """The pieces of each document: its ids and end_id, cut if longer than the capacity.

    All pieces but the first are full; the first takes the remainder. A null text counts as empty
    (one piece of one id); a null doc_id is kept; repeated rows give repeated pieces; texts
    of any length are encoded whole, in stretches. Other columns are not read. memo: words whose ids a worker remembers."""

    closing = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(None, memo).encode
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode([t or "" for t in batch["text"].to_pylist()]), strict=True):
                data = memoryview(ids + closing)
                n = len(data) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(itertools.pairwise(cuts)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to use each length so that the sum is as near to room as can be without passing it.

    Bit s of the bitset is set if some choice of the lengths so far sums to s. Longer lengths come
    first, so that short ones are kept for later bins; it ends when the room can be filled."""
    reach, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        before, shifted = reach, reach
        for _ in range(min(counts[length], room // length)):
            shifted = (shifted << length) & mask
            reach |= shifted
        steps.append((length, before))
        if reach >> room & 1:
            break
    total, uses = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> total & 1:
            total -= length
            uses[length] = uses.get(length, 0) + 1
    return uses


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(repeats, uses of each length) of each kind of bin; together they use up the histogram."""
    counts, kinds = dict(histogram), []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        uses = fullest({k: n for k, n in counts.items() if n}, capacity - longest)
        counts[longest] += 1
        uses[longest] = uses.get(longest, 0) + 1
        repeats = min(counts[k] // n for k, n in uses.items())
        for k, n in uses.items():
            counts[k] -= n * repeats
            if not counts[k]:
                del counts[k]
        kinds.append((repeats, uses))
    return kinds


def places(kinds: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, uses per bin, first bin, offset in the bin) by rank."""
    taken: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    first_bin = 0
    for repeats, uses in kinds:
        offset = 0
        for length in sorted(uses, reverse=True):
            out.setdefault(length, []).append((taken.get(length, 0), uses[length], first_bin, offset))
            taken[length] = taken.get(length, 0) + uses[length] * repeats
            offset += length * uses[length]
        first_bin += repeats
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def with_ranks(pieces: DataFrame, parts: int) -> DataFrame:
    """pieces with their rank among those of the same length. Pieces are dealt to salted parts and
    ranked there; the counts of the parts before are added."""
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    per_part = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("inside", F.row_number().over(inside) - 1)
    return ranked.join(bases, ["length", "part"]).select(*pieces.columns, (F.col("base") + F.col("inside")).alias("rank"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Each piece with its sequence_id and its offset there; sequences are gapless from 0.

    pieces has the columns of cut_pieces and is read twice: hand over a written table. Lengths must
    lie in 1..capacity. No piece is dropped; an empty table gives an empty result."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if any(not 1 <= k <= capacity for k in histogram):
        raise ValueError("a piece is longer than the capacity, or empty")
    table = places(plan_bins(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                at, rows = np.flatnonzero(length == value), table[int(value)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                bins, use = np.divmod(rank[at] - row[:, 0], row[:, 1])
                sequence[at], offset[at] = row[:, 2] + bins, row[:, 3] + use * value
            columns = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*columns, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    parts = 4 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_ranks(pieces, parts).mapInArrow(place, PLACED)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, memo: int = MEMO) -> DataFrame:
    """docs (doc_id, text) encoded, cut and packed: one row per piece. A worker remembers the ids of `memo` words."""
    return pack(stored(cut_pieces(docs, capacity, end_id, memo), "pieces"), capacity)
