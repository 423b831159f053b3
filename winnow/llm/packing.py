"""Best-fit packing of documents into token sequences by exact complements."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.shared import store
from winnow.llm.tokens import encoder

CAPACITY = 4096
END_BYTES = (1).to_bytes(4, "little")
RANK_BITS = 44


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", keep: Sequence[str] = ()
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and end id, cut only where longer than a sequence.

    The document's columns in `keep` are added to each of its pieces.
    """

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            row, number, start, length, crc = [], [], [], [], []
            for r, value in enumerate(batch.column(1)):
                ids = enc.encode(value.as_py()) + END_BYTES
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(r)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            first, *others = (c.take(pa.array(row, pa.int32())) for c in (batch.column(0), *batch.columns[2:]))
            yield pa.RecordBatch.from_arrays(
                [first, pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), *others],
                ["doc_id", "piece", "start", "length", "ids_crc32", *keep],
            )

    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep)
    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + _fields(ids, keep))


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in names)


class _Sums:
    """Which lengths are left, and the sums of two of them. Lengths only run out, so old sums are a superset."""

    def __init__(self, left: np.ndarray):
        self.left = left
        self.renew()

    def renew(self) -> None:
        have = np.flatnonzero(self.left).tolist()
        bits = sum(1 << n for n in have)
        sums = 0
        for n in have:
            sums |= bits << n
        size = len(self.left)
        raw = np.frombuffer((sums & ((1 << size) - 1)).to_bytes(size // 8 + 1, "little"), np.uint8)
        self.pair = np.unpackbits(raw, bitorder="little")[:size].astype(bool)

    def two(self, total: int) -> tuple[int, int] | None:
        """The pair with the longest member."""
        if total < 2 or not self.pair[total]:
            return None
        high = np.arange((total + 1) // 2, total)
        found = np.flatnonzero((self.left[high] > 0) & (self.left[total - high] > np.where(2 * high == total, 1, 0)))
        return (int(high[found[-1]]), total - int(high[found[-1]])) if len(found) else None

    def fits(self, parts: tuple[int, ...]) -> int:
        """How often a combination can be taken."""
        return min(int(self.left[n]) // k for n, k in Counter(parts).items())


def _complement(sums: _Sums, length: int, gap: int) -> tuple[int, ...] | None:
    """One, two or three lengths that fill the gap beside `length` exactly and can be taken at least once."""
    if sums.left[gap] and sums.fits((length, gap)):
        return (length, gap)
    pair = sums.two(gap)
    if pair and sums.fits((length, *pair)):
        return (length, *pair)
    for fresh in (False, True):
        have = np.flatnonzero(sums.left[:gap])
        hopeful = have[sums.pair[gap - have]]
        if not len(hopeful):
            return None
        for first in hopeful[::-1].tolist():
            pair = sums.two(gap - first)
            if pair and sums.fits((length, first, *pair)):
                return (length, first, *pair)
        if not fresh:
            sums.renew()
    return None


def pack_lengths(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many such sequences), from the number of pieces of each length.

    From the longest length down, combinations that fill its gap exactly are taken as often as their lengths are
    available; each uses up a length, so there are at most as many as lengths. What has no complement goes to the
    fullest open sequence that has room, longest first. The work depends on the lengths, not on the pieces.
    """
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    sums = _Sums(left)
    for length in range(capacity - 1, 0, -1):
        while left[length] and (parts := _complement(sums, length, capacity - length)):
            times = sums.fits(parts)
            for n in parts:
                left[n] -= times
            out.append((parts, times))
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms = np.zeros(capacity + 1, bool)
    for length in np.flatnonzero(left)[::-1].tolist():
        need = int(left[length])
        while need:
            fit = np.flatnonzero(rooms[length:])
            if len(fit):
                room = length + int(fit[0])
                parts, times = open_[room].pop()
                if not open_[room]:
                    rooms[room] = False
                if times > need:
                    open_[room].append((parts, times - need))
                    rooms[room] = True
                    times = need
            else:
                room, parts, times = capacity, (), need
            need -= times
            rest = room - length
            if rest:
                open_.setdefault(rest, []).append(((*parts, length), times))
                rooms[rest] = True
            else:
                out.append(((*parts, length), times))
    return out + [x for group in open_.values() for x in group]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), with the first sequence and the offset of each run of ranks."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for parts, times in patterns:
        offset = 0
        for n in parts:
            rows.append(((n << RANK_BITS) + used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", keep: Sequence[str] = ()
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the document's columns in `keep`.

    The pieces are stored once. Only the count of each length, at most `capacity` numbers, goes to the driver and comes
    back as runs of ranks. A piece's rank among its length is its place in its stored part plus the counts of the parts
    before, so a length that most pieces share is ranked in all tasks. Null text is empty and gives one piece, the end
    id; null ids and repeated rows are packed like others, each for itself; an empty table gives an empty result.
    """
    cut = pieces(docs, tokenizer, capacity, text, doc_id, keep)
    stored = store(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    part = F.shiftright("_row", 33)
    cells = store(stored.groupBy("length", part.alias("part")).agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cells.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[length] = n
    keys, sequences, offsets = _slots(pack_lengths(counts, capacity))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = cells.select("length", "part", before.alias("first"))
    ranked = stored.withColumn("part", part).withColumn("_n", F.row_number().over(Window.partitionBy("length", "part").orderBy("_row")) - 1)
    ranked = ranked.join(firsts, ["length", "part"]).withColumn("_rank", (F.col("first") + F.col("_n")).cast("long"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        for batch in batches:
            rank, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_rank", "length"))
            key = (length << RANK_BITS) + rank
            at = np.searchsorted(keys, key, "right") - 1
            found = [pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + found + [batch.column(c) for c in keep], [*names, "sequence_id", "offset", *keep]
            )

    kind = stored.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = ranked.select(*names, "_rank", *keep).mapInArrow(place, schema + _fields(stored, keep))
    return packed
