"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, memory-mapped by workers."""

from __future__ import annotations

import os
import struct
import uuid
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.session import scratch_path

WORD_BITS = 48
CHUNK_TOKENS = 3_000_000
SHARD_BYTES = 48 << 20
BEGIN, END = b" begin", b" end"
U64 = np.uint64
_mapped: dict[str, np.ndarray] = {}


# --- packed arrays ------------------------------------------------------------------------------------------------


def pack_small(values: np.ndarray) -> bytes:
    """Numbers below 255 take a byte; the others are listed behind with their places."""
    large = np.flatnonzero(values >= 255)
    head = struct.pack("<II", len(values), len(large))
    return head + np.minimum(values, 255).astype(np.uint8).tobytes() + large.astype("<u4").tobytes() + values[large].astype("<u8").tobytes()


def unpack_small(data: memoryview, at: int) -> tuple[np.ndarray, int]:
    n, m = struct.unpack_from("<II", data, at)
    at += 8
    values = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    places = np.frombuffer(data, "<u4", m, at + n)
    values[places] = np.frombuffer(data, "<u8", m, at + n + 4 * m).astype(np.int64)
    return values, at + n + 12 * m


def pack_words(keys: np.ndarray) -> bytes:
    """48-bit keys in six bytes each."""
    return struct.pack("<I", len(keys)) + keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_words(data: memoryview, at: int) -> tuple[np.ndarray, int]:
    (n,) = struct.unpack_from("<I", data, at)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at + 4).reshape(n, 6)
    return wide.view("<u8").ravel().astype(U64), at + 4 + 6 * n


# --- hashes -------------------------------------------------------------------------------------------------------


def word_key(word: bytes) -> int:
    """A word's key: the upper 48 bits of its XXH64."""
    return xxhash.xxh64_intdigest(word) >> (64 - WORD_BITS)


def word_keys(words) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), U64) >> U64(64 - WORD_BITS)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Mixed 64-bit keys of word pairs; their upper bits choose the shard."""
    z = first * U64(0x9E3779B97F4A7C15) + second * U64(0xC2B2AE3D27D4EB4F)
    z ^= z >> U64(29)
    z *= U64(0xBF58476D1CE4E5B9)
    return z ^ (z >> U64(32))


def upper(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    return (keys >> U64(width - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, and the end."""
    return [*(text or "").encode("utf-8").lower().split(), END]


class Chunk:
    """Token sequences of some documents as ids of the chunk's own vocabulary."""

    def __init__(self):
        self.ids: dict[bytes, int] = {BEGIN: 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str | None) -> None:
        words = tokens(text)
        known = self.ids
        found = [known.setdefault(w, len(known)) for w in words]
        self.parts.append(np.array([0, *found], np.int64))
        self.size += len(words)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each token's predecessor and of each token, and the number of tokens by document."""
        before = np.concatenate([p[:-1] for p in self.parts])
        after = np.concatenate([p[1:] for p in self.parts])
        return before, after, np.array([len(p) - 1 for p in self.parts], np.int64)


# --- counting -----------------------------------------------------------------------------------------------------


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts keys, and the start of each run of equal ones in it."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(keys) else np.zeros(0, np.int64)


def _send(chunk: Chunk, bits: int):
    """(shard, payload) of a chunk's pairs: contexts, how many followers each has, followers, counts."""
    before, after, _ = chunk.pairs()
    keys = word_keys(chunk.ids)
    size = len(chunk.ids)
    pairs, counts = np.unique(before * size + after, return_counts=True)
    first, second = keys[pairs // size], keys[pairs % size]
    shard = upper(pair_keys(first, second), bits, 64)
    for s in range(1 << bits):
        mine = np.flatnonzero(shard == s)
        if len(mine):
            context = (pairs // size)[mine]
            starts = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            fan = np.diff(np.append(starts, len(mine)))
            yield s, pack_words(keys[context[starts]]) + pack_small(fan) + pack_words(second[mine]) + pack_small(counts[mine])


def _received(payload: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    contexts, at = unpack_words(payload, 0)
    fan, at = unpack_small(payload, at)
    second, at = unpack_words(payload, at)
    counts, _ = unpack_small(payload, at)
    return np.repeat(contexts, fan), second, counts


def _save(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Write arrays one after the other under a final name at once, so that a repeated task leaves the same file."""
    os.makedirs(folder, exist_ok=True)
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(draft, "wb") as out:
        for a in arrays:
            out.write(a.tobytes())
    os.replace(draft, f"{folder}/{name}")


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


SUMS = ("n1", "n2", "n3", "n4", "distinct", "total", "files")
STATS = "kind string, " + ", ".join(f"{c} long" for c in SUMS)


def _reduce_pairs(folder: str, word_bits: int):
    def run(key, table):
        got = [_received(memoryview(p.as_buffer())) for p in table.column("payload")]
        first, second, counts = (np.concatenate([g[k] for g in got]) for k in range(3))
        del got
        z = pair_keys(first, second)
        order, starts = _grouped(z)
        counts = np.add.reduceat(counts[order], starts)
        at = order[starts]
        z, first, second = z[at], first[at], second[at]
        large = np.flatnonzero(counts >= 255)
        _save(
            folder, f"pairs-{key[0].as_py()}", np.array([len(z), len(large)], "<u8"), z.astype("<u8"), large.astype("<u8"),
            counts[large].astype("<u8"), np.minimum(counts, 255).astype(np.uint8),
        )
        rows: list[tuple[int, bytes]] = []
        order, starts = _grouped(first)
        words, own = first[order[starts]], counts[order]
        sums = [np.add.reduceat(x.astype(np.int64), starts) for x in (own, own == 1, own == 2, own >= 3)]
        rows += _by_word(words, sums, word_bits, b"c")
        order, starts = _grouped(second)
        sums = [np.add.reduceat(x, starts) for x in (counts[order], np.ones(len(order), np.int64))]
        rows += _by_word(second[order[starts]], sums, word_bits, b"f")
        totals = [*_counts_of_counts(counts), len(counts), int(counts.sum())]
        rows.append((-1, struct.pack("<6q", *totals)))
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _by_word(words: np.ndarray, sums: list[np.ndarray], bits: int, kind: bytes) -> list[tuple[int, bytes]]:
    """Sums of sorted words, cut at the borders of the word shards."""
    cuts = np.searchsorted(upper(words, bits, WORD_BITS), np.arange((1 << bits) + 1))
    return [
        (s, kind + pack_words(words[a:b]) + b"".join(pack_small(x[a:b]) for x in sums))
        for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))
        if b > a
    ]


WORD_COLUMNS = ("count", "contexts", "total", "ones", "twos", "more")


def _reduce_words(folder: str):
    def run(key, table):
        shard = key[0].as_py()
        if shard < 0:
            sums = np.sum([struct.unpack("<6q", p.as_buffer()) for p in table.column("payload")], axis=0)
            return pa.table({c: pa.array([v]) for c, v in zip(("kind", *SUMS), ["pairs", *map(int, sums), table.num_rows])})
        keys, stats = [], []
        for p in table.column("payload"):
            data = memoryview(p.as_buffer())
            words, at = unpack_words(data, 1)
            columns = np.zeros((6, len(words)), np.int64)
            for c in range(2, 6) if data[:1] == b"c" else range(2):
                columns[c], at = unpack_small(data, at)
            keys.append(words)
            stats.append(columns)
        words, columns = np.concatenate(keys), np.concatenate(stats, axis=1)
        order, starts = _grouped(words)
        columns = np.add.reduceat(columns[:, order], starts, axis=1)
        words = words[order[starts]]
        _save(folder, f"words-{shard}", np.array([len(words)], "<u8"), words.astype("<u8"), columns.astype("<u8"))
        follow = columns[1]
        sums = [*_counts_of_counts(follow), int((columns[0] > 0).sum()), int(columns[0].sum()), 1]
        return pa.table({c: pa.array([v]) for c, v in zip(("kind", *SUMS), ["words", *sums])})

    return run


@dataclass
class Model:
    """Where the arrays are, and the numbers that hold for all of them."""

    folder: str
    pair_bits: int
    word_bits: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    n_words_by_contexts: tuple[int, int, int]
    n_pairs: int
    vocabulary: int
    tokens: int
    shards: dict[str, int]  # name and bytes of every file written

    def shard(self, name: str) -> np.ndarray | None:
        """A file as mapped bytes; None where no words or pairs fell into the shard, an error where its file is gone."""
        size = self.shards.get(name)
        if size is None:
            return None
        path = f"{self.folder}/{name}"
        if path not in _mapped:
            found = os.path.getsize(path) if os.path.exists(path) else None
            if found != size:
                raise RuntimeError(f"{path} should have {size} bytes but {'has ' + str(found) if found is not None else 'is missing'}; is the shared folder mounted here?")
            _mapped[path] = np.memmap(path, np.uint8, "r")
        return _mapped[path]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; a half of each count where the counts of counts give none."""
    d = (0.5, 1.0, 1.5)
    if min(n1, n2, n3, n4) > 0:
        y = n1 / (n1 + 2 * n2)
        found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 < x <= k for k, x in enumerate(found, 1)):
            d = found
    return d


def mounted(path: str) -> str:
    """The file path of a shared folder; memory maps need one that is mounted on all machines."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: the model is memory-mapped, so the shared folder must be a mounted path")
    return unquote(parts.path)


def _written(folder: str) -> dict[str, int]:
    """Names and bytes of the files of a model; drafts of tasks that were lost do not count."""
    if not os.path.isdir(folder):
        return {}
    return {f.name: f.stat().st_size for f in os.scandir(folder) if not f.name.startswith(".")}


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count a model over all documents given; null texts are empty.

    Tasks count the word pairs of bounded chunks and send each shard one packed array. Shards are taken from the hash of
    the pair, so the followers of a very frequent word are spread over all of them; each shard's sums per word go on to
    word shards, again packed and already added up. Only the sums of each shard reach the driver.
    """
    spark = docs.sparkSession
    folder = mounted(scratch_path(spark, "kneser"))
    texts = docs.select(F.col(text).alias("text"))
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pair_bits = max(4, int(np.ceil(np.log2(max(1, volume / SHARD_BYTES)))))
    word_bits = max(3, pair_bits - 1)

    def count(batches):
        chunk = Chunk()

        def send():
            for s, payload in _send(chunk, pair_bits):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([payload], pa.binary())], ["shard", "payload"])

        for batch in batches:
            for value in batch.column(0):
                chunk.add(value.as_py())
                if chunk.size >= CHUNK_TOKENS:
                    yield from send()
                    chunk = Chunk()
        if chunk.size:
            yield from send()

    packed = "shard int, payload binary"
    pairs = texts.mapInArrow(count, packed).groupBy("shard").applyInArrow(_reduce_pairs(folder, word_bits), packed)
    sums = pairs.groupBy("shard").applyInArrow(_reduce_words(folder), STATS).groupBy("kind")
    sums = sums.agg(*[F.sum(c).alias(c) for c in SUMS])
    rows = {r["kind"]: r for r in sums.collect()}
    empty = dict.fromkeys(SUMS, 0)
    p, w = rows.get("pairs", empty), rows.get("words", empty)
    shards = _written(folder)
    if len(shards) != p["files"] + w["files"]:
        raise RuntimeError(f"{folder} has {len(shards)} of {p['files'] + w['files']} files; is the shared folder mounted here?")
    return Model(
        folder, pair_bits, word_bits, discounts(*(p[f"n{k}"] for k in (1, 2, 3, 4))), discounts(*(w[f"n{k}"] for k in (1, 2, 3, 4))),
        (w["n1"], w["n2"], w["distinct"] - w["n1"] - w["n2"]), p["distinct"], w["distinct"], w["total"], shards,
    )


# --- scoring ------------------------------------------------------------------------------------------------------


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted keys among sorted ones, -1 where missing."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)


def _by_shard(shards: np.ndarray):
    order = np.argsort(shards, kind="stable")
    values, starts = np.unique(shards[order], return_index=True)
    for s, a, b in zip(values.tolist(), starts, np.append(starts[1:], len(order))):
        yield s, order[a:b]


def look_up_words(model: Model, keys: np.ndarray) -> np.ndarray:
    """(6, n) statistics of words in the order of `WORD_COLUMNS`; zeros for unknown ones."""
    out = np.zeros((6, len(keys)), np.int64)
    for s, rows in _by_shard(upper(keys, model.word_bits, WORD_BITS)):
        data = model.shard(f"words-{s}")
        if data is None:
            continue
        n = int(data[:8].view("<u8")[0])
        at = _find(data[8 : 8 + 8 * n].view("<u8"), keys[rows])
        hit = at >= 0
        out[:, rows[hit]] = data[8 + 8 * n :].view("<u8").reshape(6, n)[:, at[hit]]
    return out


def look_up_pairs(model: Model, z: np.ndarray) -> np.ndarray:
    """Counts of word pairs."""
    out = np.zeros(len(z), np.int64)
    for s, rows in _by_shard(upper(z, model.pair_bits, 64)):
        data = model.shard(f"pairs-{s}")
        if data is None:
            continue
        n, m = map(int, data[:16].view("<u8"))
        rows = rows[np.argsort(z[rows])]
        at = _find(data[16 : 16 + 8 * n].view("<u8"), z[rows])
        hit = at >= 0
        found = data[16 + 8 * n + 16 * m :][at[hit]].astype(np.int64)
        full = found == 255
        if full.any():
            large = data[16 + 8 * n : 16 + 8 * n + 16 * m].view("<u8")
            found[full] = large[m:][np.searchsorted(large[:m], at[hit][full].astype("<u8"))]
        out[rows[hit]] = found
    return out


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def unigram_probability(model: Model, contexts: np.ndarray) -> np.ndarray:
    """Probability of words from the number of different words before them; unknown words share what is left."""
    share = 1 / (model.vocabulary + 1)
    if not model.n_pairs:
        return np.full(len(contexts), share)
    spare = sum(d * n for d, n in zip(model.word_discounts, model.n_words_by_contexts)) / model.n_pairs
    return (contexts - _discount(contexts, model.word_discounts)) / model.n_pairs + spare * share


def score_chunk(model: Model, chunk: Chunk) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base_score and score of the chunk's documents."""
    before, after, lengths = chunk.pairs()
    keys = word_keys(chunk.ids)
    count, contexts, total, ones, twos, more = look_up_words(model, keys)
    base = np.log10((count + 1) / (model.tokens + model.vocabulary + 1))
    low = unigram_probability(model, contexts)
    d1, d2, d3 = model.pair_discounts
    spare = (d1 * ones + d2 * twos + d3 * more) / np.maximum(total, 1)
    size = len(keys)
    pairs, back = np.unique(before * size + after, return_inverse=True)
    first, second = pairs // size, pairs % size
    c = look_up_pairs(model, pair_keys(keys[first], keys[second]))
    seen = total[first] > 0
    high = (c - _discount(c, model.pair_discounts)) / np.maximum(total[first], 1) + spare[first] * low[second]
    logs = np.log10(np.where(seen, high, low[second]))[back.ravel()]
    starts = np.cumsum(lengths) - lengths
    known = (count > 0).astype(np.int64)
    return lengths, np.add.reduceat(known[after], starts), np.add.reduceat(base[after], starts), np.add.reduceat(logs, starts)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with n_tokens, n_known, train_tokens, base_score and score (log10 probability of the whole text).

    Null texts are empty and have the end token only; words the model has not seen share the lowest order's rest;
    columns named like the new ones are replaced; repeated rows score alike; an empty table gives an empty result.
    Perplexity is 10 ** (-score / n_tokens).
    """
    added_names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = docs.drop(*added_names)
    names = [*kept.columns, *added_names]
    text_at = names.index(text)
    fields = {f.name: f.dataType.simpleString() for f in kept.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in kept.columns) + ", n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches):
        for batch in batches:
            column = batch.column(text_at)
            at = 0
            while at < batch.num_rows:
                chunk, begin = Chunk(), at
                while at < batch.num_rows and chunk.size < CHUNK_TOKENS:
                    chunk.add(column[at].as_py())
                    at += 1
                n, known, base, logs = score_chunk(model, chunk)
                part = batch.slice(begin, at - begin)
                added = [pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(logs)]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names)

    return kept.mapInArrow(run, schema)
