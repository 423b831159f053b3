"""Alignment of two tokenizers' tokens by byte offsets, and corpus-wide counts of the id pairs that overlap."""

from __future__ import annotations

import array
import hashlib
import json
import os
import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.shared import discard, store
from winnow.llm.tokens import byte_letters
from winnow.llm.kneser import mounted
from winnow.session import scratch_path

SEGMENT = 1 << 18
LONG_RUN = 1000
CACHE_WORDS = 300_000
CACHED_LENGTH = 64
FIRST_PROBE = 4
KEPT_GROUPS = 500_000
IRREGULAR = 1 << 48
CHUNK_LINKS = 1 << 21
ROWS = 64
SPACE = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>\Z")
LOOSE = re.compile(r"\s |\s\Z")
CUT = re.compile(r"(?<=\S)(?= .)", re.DOTALL)
_pairs: dict[tuple[str, str], "TokenizerPair"] = {}


class Groups(dict):
    """How groups are written, by number: a linked pair's own, or one from `IRREGULAR` on for each other group seen."""

    def __init__(self, a_sizes: np.ndarray, b_sizes: np.ndarray):
        self.a_sizes, self.b_sizes = a_sizes.tolist(), b_sizes.tolist()
        self.width = len(self.b_sizes)
        self.numbers: dict[bytes, int] = {}
        self.links: list[list[int]] = []

    def __missing__(self, pair: int) -> str:
        self[pair] = name = "%d|%d" % divmod(pair, self.width)
        return name

    def learn(self, key: bytes, n_a: int) -> int:
        """Number of a group of several tokens on a side or of unlike sizes, given the packed ids of both sides."""
        ids = array.array("I", key).tolist()
        a, b = ids[:n_a], ids[n_a:]
        links, i, j = [], 0, 0
        end_a, end_b = self.a_sizes[a[0]], self.b_sizes[b[0]]
        while True:
            links.append(a[i] * self.width + b[j])
            if end_a < end_b:
                i += 1
                end_a += self.a_sizes[a[i]]
            elif end_b < end_a:
                j += 1
                end_b += self.b_sizes[b[j]]
            else:
                break
        found = IRREGULAR + len(self.links)
        # the same ids in the same order part in one way only, where both sides have the same bytes
        self.numbers[key] = found
        self[found] = ",".join(map(str, a)) + "|" + ",".join(map(str, b))
        self.links.append(links)
        return found

    def trim(self) -> None:
        """Forget all when it has become much; between texts only."""
        if len(self) > KEPT_GROUPS:
            self.clear()
            self.numbers.clear()
            self.links.clear()


class TokenizerPair:
    """A byte-level BPE file (A) and a SentencePiece BPE model with byte fallback (B), with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as file:
            given = json.load(file)
        vocabulary = given["model"]["vocab"]
        letters = {c: bytes([n]) for n, c in byte_letters().items()}
        self.a_bytes = [b""] * max(max(vocabulary.values()) + 1, self.a.get_vocab_size())
        for entry, n in vocabulary.items():
            self.a_bytes[n] = b"".join(letters.get(c, c.encode("utf-8")) for c in entry)
        self.quick = self._quick(given)
        self.b_bytes = [self._piece(self.b.id_to_piece(n)) for n in range(self.b.get_piece_size())]
        self.a_sizes = np.array([len(x) for x in self.a_bytes])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        self.width = len(self.b_bytes)
        self.known_a: dict[str, bytes | None] = {}
        self.known_b: dict[str, bytes | None] = {}
        self.groups = Groups(self.a_sizes, self.b_sizes)
        self.narrow = max(self.a_sizes.max(), self.b_sizes.max()) < 256

    def _quick(self, given: dict):
        """The same encoding by a faster library, if the file's merges stand in the order of their ids; else None."""
        model, split = given["model"], given["pre_tokenizer"] or {}
        merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ordered = [model["vocab"].get("".join(m)) for m in merged] == list(range(256, 256 + len(merged)))
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if not (ordered and plain) or given["normalizer"] or given["model"].get("ignore_merges") or any(not t["special"] for t in given["added_tokens"]):
            return None
        import tiktoken

        special = {t["id"] for t in given["added_tokens"]}
        ranks = {data: n for n, data in enumerate(self.a_bytes) if data and n not in special}
        return tiktoken.Encoding("byte-level", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    #: how byte-level vocabularies part a text before merging; fixed
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    @staticmethod
    def _piece(piece: str) -> bytes:
        found = BYTE_PIECE.match(piece)
        return bytes([int(found[1], 16)]) if found else piece.replace(SPACE, " ").encode("utf-8")

    def sizes(self, of: np.ndarray) -> Sequence[int]:
        return of.astype(np.uint8).tobytes() if self.narrow else of.tolist()

    def _encode_a(self, word: str) -> list[int]:
        # long runs go to the library that takes them in n log n steps and without recursion
        if self.quick and len(word) < LONG_RUN:
            return self.quick(" " + word)
        return self.a.encode(" " + word, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        """Encode words behind a space, which B adds itself; None where the tokens do not give the word back."""
        plain = [w for w in words if w and len(w) < LONG_RUN and not w[-1].isspace()] if self.quick else []
        joined = "".join([" " + w for w in plain])
        data = joined.encode("utf-8")
        a = self.quick(joined) if plain else []
        b = self.b.encode(plain, num_threads=1)
        parts = [list(map(self.a_bytes.__getitem__, a)), list(map(self.b_bytes.__getitem__, chain.from_iterable(b)))]
        if all(b"".join(p) == data and b"" not in p for p in parts):
            # one call for all of A: the words' tokens end where the words do
            ends = np.cumsum([len(w.encode("utf-8")) + 1 for w in plain])
            a_cuts = (4 * (np.searchsorted(self.a_sizes[np.array(a, np.int64)].cumsum(), ends) + 1)).tolist()
            b_cuts = (4 * np.cumsum([len(x) for x in b])).tolist()
            packed_a, packed_b = array.array("I", a).tobytes(), array.array("I", chain.from_iterable(b)).tobytes()
            for w, i, x, j, y in zip(plain, [0, *a_cuts], a_cuts, [0, *b_cuts], b_cuts):
                self.known_a[w] = packed_a[i:x]
                self.known_b[w] = packed_b[j:y]
            words = [w for w in words if w not in self.known_a]
        for w, a, b in zip(words, map(self._encode_a, words), self.b.encode(words, num_threads=1)):
            data = (" " + w).encode("utf-8")
            a_parts, b_parts = [self.a_bytes[n] for n in a], [self.b_bytes[n] for n in b]
            good = b"".join(a_parts) == data == b"".join(b_parts) and b"" not in a_parts and b"" not in b_parts
            self.known_a[w] = array.array("I", a).tobytes() if good else None
            self.known_b[w] = array.array("I", b).tobytes() if good else None

    def encode(self, segments: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Packed ids of both tokenizers for segments that begin with a space; None for those they do not give back.

        Words are kept between calls: about `CACHE_WORDS` and those of one call, long ones for this call only.
        """
        if len(self.known_a) > CACHE_WORDS:
            self.known_a.clear()
            self.known_b.clear()
        parts = [stretches(s) for s in segments]
        missing = list(set(chain.from_iterable(parts)).difference(self.known_a))
        if missing:
            self._learn(missing)
        out: list[tuple[bytes, bytes] | None] = []
        for words in parts:
            try:
                out.append((b"".join(map(self.known_a.__getitem__, words)), b"".join(map(self.known_b.__getitem__, words))))
            except TypeError:  # None: not given back
                out.append(None)
        for w in missing:
            if len(w) > CACHED_LENGTH:
                del self.known_a[w], self.known_b[w]
        return out


def tokenizer_pair(a_path: str, b_path: str) -> TokenizerPair:
    """The worker's copy of two tokenizers."""
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = TokenizerPair(a_path, b_path)
    return _pairs[a_path, b_path]


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """Space and text, cut before a space that is not the last character and follows one that is no white space.

    Neither tokenizer joins characters across such a place, so the parts' ids are the text's, and both end a token there.
    A stretch without such a place stays whole.
    """
    text = " " + text
    out, at = [], 0
    while len(text) - at > size:
        found = CUT.search(text, at + size)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    out.append(text[at:])
    return out


def stretches(segment: str) -> list[str]:
    """The parts of a segment between such places, each without the space that it begins with."""
    if LOOSE.search(segment):
        return [part[1:] for part in CUT.split(segment)]
    return segment[1:].split(" ")


def run_length(a: Sequence[int], b: Sequence[int], i: int, j: int) -> int:
    """How many tokens from i and j on end at the same bytes, one by one: probes of 4, 8, 16, ... tokens, then halves.

    Both sides stand at a common end here, so their ends stay equal at this index shift just as long as their sizes do;
    sizes are compared because they fit single bytes.
    """
    most = min(len(a) - i, len(b) - j)
    n, width = 0, FIRST_PROBE
    while n + width <= most and a[i + n : i + n + width] == b[j + n : j + n + width]:
        n += width
        width *= 2
    while width > 1:
        width //= 2
        if n + width <= most and a[i + n : i + n + width] == b[j + n : j + n + width]:
            n += width
    return n


def align(a: Sequence[int], b: Sequence[int]) -> tuple[tuple[list[int], list[int], list[int]], tuple[list[int], list[int], list[int], list[int]]]:
    """Groups between bytes where tokens of both sides end, for token sizes in bytes with equal sums.

    First the stretches (i, j, n) of n one-to-one groups that `run_length` skips at the present index shift j - i; then
    the irregular groups (i, j, next i, next j), each walked to its common end, which moves the shift. Both as columns.
    """
    starts, others, lengths = [], [], []
    firsts, seconds, next_firsts, next_seconds = [], [], [], []
    i = j = 0
    last = len(a)
    while i < last:
        if a[i] == b[j]:
            n = run_length(a, b, i, j)
            starts.append(i)
            others.append(j)
            lengths.append(n)
            i += n
            j += n
            if i >= last:
                break
        firsts.append(i)
        seconds.append(j)
        ahead = a[i] - b[j]  # how far the end of i lies behind that of j
        while ahead:
            if ahead < 0:
                i += 1
                ahead += a[i]
            else:
                j += 1
                ahead -= b[j]
        i += 1
        j += 1
        next_firsts.append(i)
        next_seconds.append(j)
    return (starts, others, lengths), (firsts, seconds, next_firsts, next_seconds)


class Document:
    """Counts, digest and linked pairs of one text, added up segment by segment."""

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = 0
        self.links: list[np.ndarray] = []
        self.digest = hashlib.sha256()
        self.good = True

    def add(self, both: TokenizerPair, ids: tuple[bytes, bytes] | None) -> None:
        if ids is None:
            self.good = False
        if not self.good:
            return
        a, b = (np.frombuffer(side, np.uint32).astype(np.int64) for side in ids)
        (i, j, n), irregular = align(both.sizes(both.a_sizes[a]), both.sizes(both.b_sizes[b]))
        groups = both.groups
        groups.trim()
        packed_a, packed_b = ids
        known, numbers = groups.numbers, []
        for p, q, x, y in zip(*irregular):
            key = packed_a[4 * p : 4 * x] + packed_b[4 * q : 4 * y]
            numbers.append(known.get(key) or groups.learn(key, x - p))
        i, j, n = (np.array(v, np.int64) for v in (i, j, n))
        step = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
        at = np.repeat(i, n) + step
        single = a[at] * both.width + b[np.repeat(j, n) + step]
        # a group stands where its first token of A does
        order = np.full(len(a), -1)
        order[at] = single
        order[irregular[0]] = numbers
        order = order[order >= 0]
        if self.n_groups:
            self.digest.update(b";")
        self.digest.update(";".join(map(groups.__getitem__, order.tolist())).encode())
        self.n_a += len(a)
        self.n_b += len(b)
        self.n_groups += len(order)
        linked = chain.from_iterable(groups.links[k - IRREGULAR] for k in numbers)
        self.links += [single.astype(np.uint64), np.fromiter(linked, np.uint64)]

    def row(self, kind: type) -> tuple:
        if not self.good or not self.n_groups:
            return 0, 0, 0, 0, "", b""
        links = np.concatenate(self.links)
        return self.n_a, self.n_b, self.n_groups, len(links), self.digest.hexdigest(), links.astype(kind).tobytes()


def link_kind(both: TokenizerPair) -> type:
    """Pairs are one number, id of A times the size of B plus id of B; it fits 32 bits for usual vocabularies."""
    return np.dtype("<u4") if len(both.a_bytes) * len(both.b_bytes) <= 1 << 32 else np.dtype("<u8")


def align_documents(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """The rows without the text, with n_a, n_b, n_groups, n_links, groups_sha256 and the links as packed pair numbers.

    Whole texts; null and empty ones, and those whose joined token bytes differ from a space and the text, have no
    tokens: zeros and an empty digest. Columns named like the new ones are replaced.
    """
    added = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "links": "binary"}
    kept = docs.drop(*added)
    names = [c for c in kept.columns if c != text]
    chosen = kept.select(*names, F.col(text).alias("__text"))
    schema = ", ".join([f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in names] + [f"{c} {t}" for c, t in added.items()])

    def run(batches):
        both = tokenizer_pair(a_path, b_path)
        kind = link_kind(both)
        for batch in batches:
            texts = batch.column(len(names))
            at = 0
            while at < batch.num_rows:
                begin, at = at, min(batch.num_rows, at + ROWS)
                done, owners, parts = [Document() for _ in range(begin, at)], [], []
                for owner, value in zip(done, texts.slice(begin, at - begin).to_pylist()):
                    found = segments(value) if value else []
                    parts += found
                    owners += [owner] * len(found)
                for low in range(0, len(parts), ROWS):
                    some = slice(low, low + ROWS)
                    for owner, found in zip(owners[some], both.encode(parts[some])):
                        owner.add(both, found)
                columns = list(zip(*(d.row(kind) for d in done)))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                given = batch.slice(begin, at - begin)
                yield pa.RecordBatch.from_arrays(
                    [*(given.column(k) for k in range(len(names))), *(pa.array(c, t) for c, t in zip(columns, kinds))], [*names, *added]
                )

    return chosen.mapInArrow(run, schema)


# --- corpus counts ------------------------------------------------------------------------------------------------


@dataclass
class PairTable:
    """Sorted files of pair numbers and twice their counts, plus 1 where the count is the highest of its id of B."""

    folder: str
    shards: list[tuple[str, int, int]]  # name, first pair, number of pairs
    width: int
    kind: str

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and whether they are the highest, for sorted distinct pairs that the table holds."""
        out = np.zeros(len(pairs), np.int64)
        firsts = np.array([s[1] for s in self.shards], np.uint64)
        at = np.searchsorted(pairs, firsts)
        for (name, _, n), low, high in zip(self.shards, at, np.append(at[1:], len(pairs))):
            if high > low:
                keys, values = _mapped(f"{self.folder}/{name}", n)
                found = np.searchsorted(keys, pairs[low:high])
                if (found >= n).any() or (keys[found] != pairs[low:high]).any():
                    raise RuntimeError(f"{self.folder}/{name} lacks pairs of the corpus it was counted from")
                out[low:high] = values[found]
        return out >> 1, (out & 1).astype(bool)


def _mapped(path: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.memmap(path, "<u8", "r")
    if len(data) != 2 * n:
        raise RuntimeError(f"{path} has {len(data)} numbers instead of {2 * n}")
    return data[:n], data[n:]


def _chunks(batches, kind: np.dtype, links_at: int):
    """Rows with their links, in slices of about `CHUNK_LINKS` links or one row."""
    for batch in batches:
        begin = size = 0
        column = batch.column(links_at)
        sizes = [len(v.as_buffer()) // kind.itemsize if v.is_valid else 0 for v in column]
        for at, n in enumerate(sizes):
            if size and size + n > CHUNK_LINKS:
                yield batch.slice(begin, at - begin), sizes[begin:at]
                begin, size = at, 0
            size += n
        if begin < batch.num_rows:
            yield batch.slice(begin), sizes[begin:]


def _links(column: pa.Array, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in column if v.is_valid), kind)


def count_pairs(aligned: DataFrame, kind: np.dtype) -> DataFrame:
    """(pair, n): how many links of all documents hold each pair; sorted and added up in the tasks before the shuffle."""

    def run(batches):
        for part, _ in _chunks(batches, kind, 0):
            pairs, counts = np.unique(_links(part.column(0), kind), return_counts=True)
            for at in range(0, len(pairs), 1 << 16):
                some = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(pairs[some].astype(np.int64)), pa.array(counts[some].astype(np.int64))], ["pair", "c"])

    return aligned.select("links").mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("n"))


def write_table(counts: DataFrame, width: int, kind: np.dtype) -> PairTable:
    """Mark the highest counts of each id of B, and write the pairs in order to files below the shared folder.

    The table is bounded by the two vocabularies, whatever the corpus. Tasks write to a name of their own first, so one
    that runs again leaves no half file. Memory maps need a folder that is mounted on all machines; others raise.
    """
    folder = mounted(scratch_path(counts.sparkSession, "pairs"))
    counts = counts.withColumn("b", F.col("pair") % width)
    best = counts.groupBy("b").agg(F.max("n").alias("most"))
    marked = counts.join(best, "b").select("pair", (2 * F.col("n") + (F.col("n") == F.col("most")).cast("long")).alias("value"))

    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            pairs = np.concatenate([p for p, _ in parts])
            context = TaskContext.get()
            name = f"pairs-{context.partitionId()}-{context.taskAttemptId()}"
            os.makedirs(folder, exist_ok=True)
            with open(f"{folder}/.{name}", "wb") as file:
                file.write(pairs.astype("<u8").tobytes())
                file.write(np.concatenate([v for _, v in parts]).astype("<u8").tobytes())
            os.replace(f"{folder}/.{name}", f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(pairs[0])]), pa.array([len(pairs)])], ["name", "first", "n"])

    files = marked.repartitionByRange("pair").sortWithinPartitions("pair").mapInArrow(run, "name string, first long, n long").collect()
    return PairTable(folder, sorted(((r["name"], r["first"], r["n"]) for r in files), key=lambda s: s[1]), width, kind.str)


def add_counts(aligned: DataFrame, table: PairTable) -> DataFrame:
    """The aligned rows with n_best and count_sum instead of the links."""
    kept = [c for c in aligned.columns if c not in ("links", "n_best", "count_sum")]
    schema = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in kept) + ", n_best long, count_sum long"
    kind = np.dtype(table.kind)

    def run(batches):
        for part, sizes in _chunks(batches, kind, len(kept)):
            pairs, back = np.unique(_links(part.column(len(kept)), kind), return_inverse=True)
            counts, best = table.look_up(pairs.astype(np.uint64)) if len(pairs) else (np.zeros(0, np.int64), np.zeros(0, bool))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            added = [np.concatenate(([0], np.cumsum(v[back].astype(np.int64)))) for v in (best, counts)]
            columns = [pa.array(v[ends[1:]] - v[ends[:-1]]) for v in added]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(kept))), *columns], [*kept, "n_best", "count_sum"])

    return aligned.select(*kept, "links").mapInArrow(run, schema)


def cross_tokenizer(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """The rows without the text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    Texts are tokenized and aligned once, and their links stored; the pairs are counted over all documents; then each
    document looks up the counts of its own pairs. Repeated rows count each and get equal answers; an empty table gives
    an empty result; null, empty and irreproducible texts get zeros and an empty digest.
    """
    both = tokenizer_pair(a_path, b_path)
    kind = link_kind(both)
    aligned = store(align_documents(docs, a_path, b_path, text), "aligned")
    counts = store(count_pairs(aligned, kind), "pair-counts")
    table = write_table(counts, len(both.b_bytes), kind)
    discard(counts)
    return add_counts(aligned, table)
