"""Near duplicates by SimHash; candidates are found and pruned by the pigeonring rule."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.shared import components, discard, split_by_keys, stars, store

SHINGLE = 3
SEED = 42
MAX_BITS = 3
SEGMENTS = 4
WIDTH = 64 // SEGMENTS
CHUNK = 256
HASH_BATCH = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the XXH64 of all word shingles, repeats included; 0 without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[-n:] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    spans = list(zip(starts[:n].tolist(), last.tolist()))
    for at in range(0, n, HASH_BATCH):
        part = spans[at : at + HASH_BATCH]
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in part), np.uint64, len(part))
        set_bits += _bit_counts(hashes)
    return int(np.packbits(2 * set_bits > n).view(">u8")[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set, highest bit first."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp): fingerprints as signed longs."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return ids.mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, fp long")


def chain_ok(x: np.ndarray, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> np.ndarray:
    """Pigeonring test of XORed fingerprints: some start whose every chain keeps within its share of the budget.

    Of two fingerprints within `max_bits`, some segment starts a ring of which each chain of l consecutive segments
    differs in at most l * max_bits / segments bits.
    """
    width = 64 // segments
    mask = np.uint64((1 << width) - 1)
    counts = np.stack([np.bitwise_count((x >> np.uint64(width * (segments - 1 - k))) & mask).astype(np.int16) for k in range(segments)])
    passed = np.zeros(x.shape, bool)
    for start in range(segments):
        total, fits = np.zeros(x.shape, np.int16), np.ones(x.shape, bool)
        for length in range(1, segments + 1):
            total = total + counts[(start + length - 1) % segments]
            fits &= total * segments <= length * max_bits
        passed |= fits
    return passed


def links_between(a: np.ndarray, b: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that pass the chains and then the full comparison."""
    x = a[:, None] ^ b[None, :]
    i, j = np.nonzero(chain_ok(x, max_bits))
    near = np.bitwise_count(x[i, j]) <= max_bits
    return i[near], j[near]


def _ring_keys(fp: str):
    """Index keys of a fingerprint: each segment in full, with either half of the next one on the ring.

    The first two budgets of a chain are 0 and 1 bit: the first segment is equal, and of the second at least one half.
    """
    keys = []
    value = F.col(fp)
    half = WIDTH // 2
    segment = lambda k: F.shiftrightunsigned(value, WIDTH * (SEGMENTS - 1 - k)).bitwiseAND(F.lit((1 << WIDTH) - 1))
    for k in range(SEGMENTS):
        following = segment((k + 1) % SEGMENTS)
        halves = (F.shiftrightunsigned(following, half), following.bitwiseAND(F.lit((1 << half) - 1)))
        for which, part in enumerate(halves):
            tag = F.lit((2 * k + which) << (WIDTH + half)).cast("long")
            keys.append(tag.bitwiseOR(F.shiftleft(segment(k), half)).bitwiseOR(part))
    return F.array(*keys)


def _pairs(batches):
    """Links inside or between the chunks of each row, as one star per linked group."""
    for batch in batches:
        out_a, out_b = [], []
        for row in range(batch.num_rows):
            sides = []
            for fp, rep in ((0, 1), (2, 3)):
                fps, reps = batch.column(fp)[row].values, batch.column(rep)[row].values
                sides.append((fps.to_numpy(zero_copy_only=False).view(np.uint64), reps.to_numpy(zero_copy_only=False)))
            (a, ra), (b, rb) = sides
            i, j = links_between(a, b)
            ids = np.concatenate((ra, rb))
            nodes, at = np.unique(ids, return_inverse=True)
            label = stars(at[i], at[len(ra) + j], len(nodes))
            far = np.flatnonzero(label != np.arange(len(nodes)))
            out_a.append(nodes[far])
            out_b.append(nodes[label[far]])
        found = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (out_a, out_b)]
        yield pa.RecordBatch.from_arrays(found, ["a", "b"])


def fingerprint_links(marks: DataFrame) -> DataFrame:
    """(a, b) links between representatives of distinct fingerprints (fp, rep): enough to connect every linked class.

    Fingerprints meet under eight ring keys. A key with more than `CHUNK` of them is dealt into chunks, and each pair of
    chunks is compared in one step that returns stars: no key has to fit one task, and no list of all pairs exists.
    """
    keyed = marks.select("fp", "rep", F.explode(_ring_keys("fp")).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = keyed.join(counts, "key").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("fp", "rep"), F.col("chunks")).cast("int"))
    chunks = dealt.groupBy("key", "chunks", "chunk").agg(F.collect_list(F.struct("fp", "rep")).alias("m"))
    chunks = store(chunks.select("key", "chunks", "chunk", F.col("m.fp").alias("fps"), F.col("m.rep").alias("reps")), "ring")
    alone = chunks.select("fps", "reps", F.col("fps").alias("fps2"), F.col("reps").alias("reps2"))
    left = chunks.filter("chunks > 1")
    right = left.select("key", F.col("chunk").alias("chunk2"), F.col("fps").alias("fps2"), F.col("reps").alias("reps2"))
    across = left.join(right, "key").filter("chunk < chunk2").select("fps", "reps", "fps2", "reps2")
    links = store(alone.union(across).mapInArrow(_pairs, "a long, b long").distinct(), "ring-links")
    discard(chunks)
    return links


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; ids are integers.

    Lower-cases A-Z, takes three-word shingles of the whole text and links fingerprints that differ in at most three
    bits. Equal fingerprints form one node before any comparison, so exact copies cost one row. Null and empty texts
    have fingerprint zero and link like any other; repeated rows get the same component; rows whose id is null get
    their class's component too, which is null only if no row of it has an id; an empty table gives an empty result.
    """
    prints = store(fingerprints(docs, text, doc_id), "simhash")
    marks = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    links = fingerprint_links(marks.filter("rep IS NOT NULL"))
    found = components(links)
    classes = marks.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    classes = store(classes, "simhash-classes")
    discard(links)
    out = prints.join(classes, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component: that of the smallest id, once if it is repeated. Rows without an id are dropped.

    Texts whose id is kept and not repeated stay where they are read; the others are moved to meet the ids that go.
    """
    found = near_duplicates(docs, text, doc_id).filter("doc_id IS NOT NULL")
    ids = found.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("kept"))
    judged = store(ids.filter("n > 1 OR NOT kept"), "judged-ids")
    named = docs.filter(F.col(doc_id).isNotNull())
    maybe, alone = split_by_keys(named, F.xxhash64(F.col(doc_id)), judged.select(F.xxhash64("_id")))
    gone = judged.filter("NOT kept").select("_id")
    return maybe.join(gone, F.col(doc_id) == F.col("_id"), "left_anti").dropDuplicates([doc_id]).unionByName(alone)
