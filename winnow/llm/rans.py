"""Token ids as files of static range asymmetric numeral system blocks."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.llm.shared import broadcast_if_small, discard, read_bytes, store, write_bytes
from winnow.llm.tokens import encoder

END_ID = 1
PRECISION = 20
LOW = 32
LANES = 1024
BLOCK_IDS = 1 << 20
CHECKPOINT_STEPS = 256
MAGIC = b"TRB1"
SEPARATOR = b"\nend of block\n"
HEADER = struct.Struct("<4sIIIIIIII")
U64 = np.uint64


def normalise(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies that add up to 2**precision; every counted id has at least 1."""
    total, size = int(counts.sum()), 1 << precision
    if not total:
        return np.zeros(len(counts), np.int64)
    seen = counts > 0
    freq = np.where(seen, np.maximum(1, np.floor(counts * (size / total)).astype(np.int64)), 0)
    spare = size - int(freq.sum())
    while spare:
        order = np.argsort(-freq, kind="stable")
        order = order[freq[order] > (1 if spare < 0 else 0)][: max(1, abs(spare))]
        step = np.sign(spare) * max(1, abs(spare) // len(order)) if spare > 0 else -1
        take = order[: abs(spare)] if abs(step) == 1 else order
        freq[take] += step
        spare = size - int(freq.sum())
    return freq


class Table:
    """Shared frequency table: frequency and start of every id, and the id at every slot."""

    def __init__(self, freq: np.ndarray, precision: int = PRECISION):
        self.precision = precision
        self.freq = freq.astype(U64)
        self.start = (np.cumsum(freq) - freq).astype(U64)
        self.at = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())


def encode_ids(ids: np.ndarray, table: Table, lanes: int = LANES) -> bytes:
    """One independent block: id k belongs to lane k % lanes. Header, checkpoints, 32-bit words, then a checksum.

    The encoder runs backwards. Every `CHECKPOINT_STEPS` steps it notes the states and the place in the words, from
    which a decoder can start.
    """
    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    x = np.full(lanes, 1 << LOW, U64)
    words, marks, written = [], [], 0
    room, shift, low, mask = U64(2 * LOW - table.precision), U64(table.precision), U64(LOW), U64((1 << LOW) - 1)
    for step in range(steps - 1, -1, -1):
        s = ids[step * lanes : (step + 1) * lanes]
        k = len(s)
        f, head = table.freq[s], x[:k]
        out = np.flatnonzero(head >= (f << room))
        if len(out):
            words.append((head[out] & mask)[::-1].astype("<u4"))
            written += len(out)
            head[out] >>= low
        q = head // f
        x[:k] = (q << shift) + (head - q * f) + table.start[s]
        if step % CHECKPOINT_STEPS == 0:
            marks.append((written, x.copy()))
    stream = np.concatenate(words[::1])[::-1] if words else np.zeros(0, "<u4")
    marks.reverse()
    places = np.array([written - w for w, _ in marks], "<u4")
    states = np.concatenate([m for _, m in marks]).astype("<u8") if marks else np.zeros(0, "<u8")
    body = places.tobytes() + states.tobytes() + stream.astype("<u4").tobytes()
    head = HEADER.pack(MAGIC, n, lanes, len(marks), len(stream), table.crc, CHECKPOINT_STEPS, zlib.crc32(ids.astype("<u4").tobytes()), 0)
    return head + body + struct.pack("<I", zlib.crc32(head + body))


def decode_ids(block: bytes | memoryview, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids between two checkpoints of a block, all by default; damaged blocks and other tables raise ValueError."""
    magic, n, lanes, n_marks, n_words, crc, every, ids_crc, _ = HEADER.unpack_from(block)
    end = HEADER.size + n_marks * (4 + 8 * lanes) + 4 * n_words
    if magic != MAGIC or len(block) < end + 4 or struct.unpack_from("<I", block, end)[0] != zlib.crc32(block[:end]):
        raise ValueError("damaged block")
    if crc != table.crc:
        raise ValueError("block of another frequency table")
    places = np.frombuffer(block, "<u4", n_marks, HEADER.size)
    states = np.frombuffer(block, "<u8", n_marks * lanes, HEADER.size + 4 * n_marks).reshape(n_marks, lanes)
    stream = np.frombuffer(block, "<u4", n_words, HEADER.size + n_marks * (4 + 8 * lanes)).astype(U64)
    last = n_marks if last is None else last
    begin, stop = first * every * lanes, min(n, last * every * lanes)
    out = np.empty(max(0, stop - begin), np.uint32)
    if not len(out):
        return out
    x, at = states[first].astype(U64), int(places[first])
    slot_mask, shift, low, floor = U64((1 << table.precision) - 1), U64(table.precision), U64(LOW), U64(1 << LOW)
    for step in range(begin, stop, lanes):
        k = min(lanes, n - step)
        head = x[:k]
        slot = head & slot_mask
        s = table.at[slot]
        out[step - begin : step - begin + k] = s
        head = table.freq[s] * (head >> shift) + slot - table.start[s]
        need = np.flatnonzero(head < floor)
        if len(need):
            head[need] = (head[need] << low) | stream[at : at + len(need)]
            at += len(need)
        x[:k] = head
    if first == 0 and last == n_marks and zlib.crc32(out.tobytes()) != ids_crc:
        raise ValueError("damaged block")
    return out


def id_width(tokenizer: str) -> str:
    """Two bytes for vocabularies of up to 65,536 ids, else four."""
    return "<u2" if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def token_ids(docs: DataFrame, tokenizer: str, width: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids): the ids of whole texts and the end id, packed in the given width."""

    def run(batches):
        enc, end = encoder(tokenizer), np.array([END_ID], width).tobytes()
        for batch in batches:
            found = [np.frombuffer(enc.encode(value.as_py()), "<u4").astype(width).tobytes() + end for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "ids"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids binary")


def count_ids(ids: DataFrame, width: str) -> DataFrame:
    """(id, n) over all documents; every task sends one row per id it has seen."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for value in batch.column(0):
                part = np.bincount(np.frombuffer(value.as_buffer(), width))
                if len(part) > len(total):
                    part[: len(total)] += total
                    total = part
                else:
                    total[: len(part)] += part
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    return ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _block(docs: list[tuple[int | None, np.ndarray]], table: Table) -> bytes:
    """Document index and coded ids of one block."""
    stream = np.concatenate([ids for _, ids in docs]).astype(np.uint32)
    lengths = np.array([len(ids) for _, ids in docs], "<u4")
    names = np.array([d or 0 for d, _ in docs], "<i8")
    known = np.array([d is not None for d, _ in docs], np.uint8)
    coded = encode_ids(stream, table)
    index = names.tobytes() + lengths.tobytes() + known.tobytes()
    head = struct.pack("<III", len(docs), len(coded), zlib.crc32(index))
    return head + index + coded


def _blocks(content: bytes):
    """(doc ids, lengths, coded ids) of every block of a file."""
    view, at = memoryview(content), 0
    while at < len(view):
        n, size, crc = struct.unpack_from("<III", view, at)
        at += 12
        index = view[at : at + 13 * n]
        if len(index) < 13 * n or zlib.crc32(index) != crc:
            raise ValueError("damaged index")
        names = np.frombuffer(index, "<i8", n)
        lengths = np.frombuffer(index, "<u4", n, 8 * n)
        known = np.frombuffer(index, np.uint8, n, 12 * n).astype(bool)
        at += 13 * n
        yield names, known, lengths, view[at : at + size]
        at += size
        if view[at : at + len(SEPARATOR)] != SEPARATOR:
            raise ValueError("damaged file")
        at += len(SEPARATOR)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode whole texts and write `path`/table and `path`/blocks, in ascending doc_id order over the part files.

    Texts are tokenized once and their packed ids stored; the ids are counted to make the shared table (bounded by the
    vocabulary), range partitioned by doc_id, sorted inside the partitions and coded in blocks of about `BLOCK_IDS` ids.
    Null text is empty, so it has the end id alone; null ids come first; documents with equal or null ids keep no order
    among themselves, and a hash of their contents spreads them over partitions.
    """
    spark, width = docs.sparkSession, id_width(tokenizer)
    stored = store(token_ids(docs, tokenizer, width, text, doc_id), "token-ids")
    counts = {r["id"]: r["n"] for r in count_ids(stored, width).collect()}
    dense = np.zeros(max(counts, default=-1) + 1, np.int64)
    dense[list(counts)] = list(counts.values())
    freq = normalise(dense)
    rows = [(i, int(f)) for i, f in enumerate(freq) if f]
    spark.createDataFrame(rows, "id int, freq long").write.parquet(f"{path}/table")

    def run(batches):
        table, held, size = Table(freq), [], 0
        for batch in batches:
            for d, value in zip(batch.column(0), batch.column(1)):
                ids = np.frombuffer(value.as_buffer(), width)
                held.append((d.as_py(), ids))
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([_block(held, table)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_block(held, table)], pa.binary())], ["value"])

    salted = stored.withColumn("salt", F.xxhash64(stored.columns[1]))
    ordered = salted.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt").drop("salt")
    write_bytes(ordered.mapInArrow(run, "value binary"), f"{path}/blocks", SEPARATOR)
    discard(stored)


def read_table(spark: SparkSession, path: str) -> np.ndarray:
    """Frequencies by id; bounded by the vocabulary."""
    rows = {r["id"]: r["freq"] for r in spark.read.schema("id int, freq long").parquet(f"{path}/table").collect()}
    freq = np.zeros(max(rows, default=-1) + 1, np.int64)
    freq[list(rows)] = list(rows.values())
    return freq


def decode_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, nth, doc_id, first, ids): documents of every file in order; `first` counts the ids before it in its file."""
    return _decoded(spark, path, "ids array<long>", lambda ids: pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))


def _decoded(spark: SparkSession, path: str, column: str, make) -> DataFrame:
    freq = read_table(spark, path)

    def run(batches):
        table = Table(freq)
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                nth, first = 0, 0
                for names, known, lengths, coded in _blocks(content.as_py()):
                    ids = decode_ids(coded, table)
                    ends = np.cumsum(lengths, dtype=np.int64)
                    parts = np.split(ids, ends[:-1]) if len(ends) else []
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name.as_py()] * len(names)),
                            pa.array(np.arange(nth, nth + len(names))),
                            pa.array(names.astype(np.int64), mask=~known),
                            pa.array(first + ends - lengths),
                            pa.array(lengths.astype(np.int64)),
                            make(parts),
                        ],
                        ["path", "nth", "doc_id", "first", "n_tokens", column.split(" ")[0]],
                    )
                    nth += len(names)
                    first += int(ends[-1]) if len(ends) else 0

    return read_bytes(spark, f"{path}/blocks").mapInArrow(run, f"path string, nth long, doc_id long, first long, n_tokens long, {column}")


def file_order(path: str) -> list[Column]:
    """Sort keys of part files: the number of the task and of its file; from 100,000 on names no longer sort by them."""
    name = F.substring_index(F.col(path), "/", -1)
    return [F.regexp_extract(name, pattern, 1).cast("long") for pattern in (r"^part-(\d+)", r"-c(\d+)\.")] + [F.col(path)]


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files.

    start counts the ids of all documents before it: those of its file plus those of the files before, in the order of
    their part numbers. One task adds up one row per file.
    """
    found = _decoded(spark, path, "ids_crc32 long", lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()))
    found = store(found, "decoded")
    files = found.groupBy("path").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*file_order("path")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = store(files.select("path", before.alias("before")), "file-offsets")
    joined = found.join(broadcast_if_small(offsets, 256), "path")
    return joined.select("doc_id", (F.col("before") + F.col("first")).cast("long").alias("start"), "n_tokens", "ids_crc32")
