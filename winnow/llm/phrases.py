"""Phrase collocations from count streams kept in prefix and in suffix order and merged in lockstep."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.llm.shared import discard, store

MIN_COUNT = 100
MAX_WORDS = 5
COVER_PERCENT = 100
TOP = 2000
BLOCK_BYTES = 8 << 20
FILTER_BITS = 1 << 26
PAGE_BITS = 32768  # of Spark's bitmap functions
UNKNOWN = "und"
BREAK = b"\xff"  # no byte of UTF-8
LOWER = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b" " + BREAK * 10)


# --- counting -----------------------------------------------------------------------------------------------------


class Numbers(dict):
    """Words to numbers in the order of their first sight; the break between pieces is 0."""

    def __init__(self):
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def slices(data: bytes, limit: int = BLOCK_BYTES):
    """Parts of a text of about `limit` bytes, cut between pieces; a piece is never cut."""
    at = 0
    while len(data) - at > limit:
        cut = data.rfind(BREAK, at, at + limit)
        cut = cut if cut >= 0 else data.find(BREAK, at + limit)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut + 1
    yield data[at:]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def probes(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two bit places of phrases, given the hashes of their first, second, ... words."""
    h = mix(columns[0])
    for c in columns[1:]:
        h = mix(h * np.uint64(0xBF58476D1CE4E5B9) + c)
    last = np.uint64(FILTER_BITS - 1)
    return (h & last).astype(np.int64), ((h >> np.uint64(32)) & last).astype(np.int64)


def held(bits: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    found = np.ones(len(columns[0]), bool)
    for place in probes(columns):
        found &= (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return found


def count_block(data: bytes, lang: str, order: int, filters: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Phrases of `order` words in a block of lower-cased pieces, and how often each occurs.

    Occurrences are numbered by sorting, order by order, so nothing is counted by a hash. A phrase is left out when the
    filter of some lower order shows that a part of it is rarer than the corpus-wide limit.
    """
    tokens = data.replace(BREAK, b" \xff ").split()
    numbers = Numbers()
    ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
    del tokens
    words = list(numbers)
    hashes = word_hashes(words, lang) if order > 1 else None
    if order == 1:
        return pa.array(words[1:], pa.binary()), np.bincount(ids, minlength=len(words))[1:]
    frequent = held(filters[0], [hashes])
    frequent[0] = False
    rank = np.where(frequent[ids], ids, -1)
    for n in range(2, order + 1):
        places = np.flatnonzero((rank[:-1] >= 0) & (rank[1:] >= 0))
        keys = rank[places] * len(words) + ids[places + n - 1]
        _, first, back, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        at = places[first]
        if n < order:
            frequent = held(filters[n - 1], [hashes[ids[at + k]] for k in range(n)])
            rank = np.full(len(ids), -1)
            rank[places] = np.where(frequent[back], back, -1)
    names = pa.array(words, pa.binary())
    parts = [names.take(pa.array(ids[at + k])) for k in range(order)]
    return pc.binary_join_element_wise(*parts, b" "), counts


def count_phrases(texts: DataFrame, order: int, filters: list) -> DataFrame:
    """(lang, phrase, a): counts of the phrases of `order` words that the filters of lower orders let through.

    `texts` holds lang and the text as bytes. Blocks are counted in the tasks and added up there before the shuffle.
    """

    def run(batches):
        loaded = [f.value for f in filters]
        waiting: dict[str, list[bytes]] = {}
        size = 0

        def flush():
            for lang, parts in waiting.items():
                phrases, counts = count_block(BREAK.join(parts), lang, order, loaded)
                for at in range(0, len(phrases), 1 << 16):
                    part = phrases[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.string()), part, pa.array(counts[at : at + (1 << 16)])], ["lang", "phrase", "c"]
                    )
            waiting.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in slices(text.as_py().translate(LOWER)):
                    waiting.setdefault(lang, []).append(part)
                    size += len(part)
                    if size >= BLOCK_BYTES:
                        yield from flush()
                        size = 0
        yield from flush()

    counted = texts.mapInArrow(run, "lang string, phrase binary, c long")
    return counted.groupBy("lang", "phrase").agg(F.sum("c").alias("a"))


def build_filter(frequent: DataFrame) -> np.ndarray:
    """Bitmap of `FILTER_BITS` in which every frequent phrase sets two bits; its size never grows with the data."""

    def run(batches):
        for batch in batches:
            rows: dict[tuple[str, int], list[list[bytes]]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                split = phrase.split(b" ")
                rows.setdefault((lang, len(split)), []).append(split)
            for (lang, _), found in rows.items():
                for place in probes([word_hashes(list(c), lang) for c in zip(*found)]):
                    yield pa.RecordBatch.from_arrays([pa.array(place + 1)], ["place"])

    places = frequent.select("lang", "phrase").mapInArrow(run, "place long")
    pages = places.groupBy(F.bitmap_bucket_number("place").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for page, part in pages.collect():
        at = (page - 1) * PAGE_BITS // 8
        bits[at : at + len(part)] = np.frombuffer(part, np.uint8)
    return bits


def count_streams(docs: DataFrame, text: str, lang: str, min_count: int, max_words: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Frequent phrases of 1 to `max_words` words (lang, phrase, size, a), words per language, and the stored frames.

    Order by order: a phrase can only be frequent if both parts that lack one word are, so only such are counted. The
    filters that tell have a fixed size; where they fill up, more phrases are counted, and the result stays the same.
    """
    spark = docs.sparkSession
    texts = docs.filter(F.col(text).isNotNull()).select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("binary").alias("text"))
    filters, levels, totals, kept = [], [], None, []
    for order in range(1, max_words + 1):
        counted = count_phrases(texts, order, filters)
        level = store(counted if order == 1 else counted.filter(F.col("a") >= min_count), f"phrases-{order}")
        kept.append(level)
        if order == 1:
            totals = level.groupBy("lang").agg(F.sum("a").alias("n"))
            level = level.filter(F.col("a") >= min_count)
        levels.append(level.withColumn("size", F.lit(order)))
        if order == max_words or level.isEmpty():
            break
        filters.append(spark.sparkContext.broadcast(build_filter(level)))
    for f in filters:
        f.unpersist()
    stream = levels[0]
    for level in levels[1:]:
        stream = stream.unionByName(level)
    return stream.withColumn("phrase", F.col("phrase").cast("string")), totals, kept


# --- lockstep merge -----------------------------------------------------------------------------------------------


def _heads(ordered: DataFrame) -> list:
    """(partition, lang, key) of the first row of every partition."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    return ordered.select("part", "lang", "key").mapInArrow(run, "part int, lang string, key array<string>").collect()


def lockstep(spark: SparkSession, stream: DataFrame, suffix: bool) -> DataFrame:
    """(lang, phrase, a, parts, ext): counts of each phrase's beginnings (of its endings if `suffix`), and of extensions.

    The streams of all orders are laid out as one, in the order of their words (of their words backwards if `suffix`).
    There every phrase follows its beginnings, so one pass with a stack of at most `MAX_WORDS` counts meets them all; no
    table of phrases is held. A range boundary may part a phrase from its beginnings: those of the first row of each
    partition, at most four a partition, are looked up before. Rows with ext tell a phrase the count of one extension.
    """
    words = F.split("phrase", " ")
    key = F.reverse(words) if suffix else words
    ordered = stream.select("lang", key.alias("key"), "phrase", "a").repartitionByRange("lang", "key").sortWithinPartitions("lang", "key")
    # partitions stay as they are between the two passes, and each row knows its own: a union numbers tasks anew
    ordered = ordered.withColumn("part", F.spark_partition_id()).checkpoint()
    heads = _heads(ordered)
    wanted = {(h["lang"], tuple(h["key"][:k])) for h in heads for k in range(1, len(h["key"]))}
    known = {}
    if wanted:
        asked = spark.createDataFrame([(lang, list(k)) for lang, k in sorted(wanted)], "lang string, key array<string>")
        known = {(r["lang"], tuple(r["key"])): r["a"] for r in ordered.join(F.broadcast(asked), ["lang", "key"]).select("lang", "key", "a").collect()}
    begin = {h["part"]: (h["lang"], [(tuple(h["key"][:k]), known[h["lang"], tuple(h["key"][:k])]) for k in range(1, len(h["key"]))]) for h in heads}

    def run(batches):
        now, stack = None, None
        for batch in batches:
            if stack is None and batch.num_rows:
                now, stack = begin[batch.column(4)[0].as_py()]
                stack = list(stack)
            langs, phrases, counts, parts, parents, exts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), [], [], []
            of = []
            for lang, words, a in zip(langs, batch.column(1).to_pylist(), counts):
                if lang != now:
                    now, stack = lang, []
                while stack and (len(stack) >= len(words) or stack[-1][0] != tuple(words[: len(stack)])):
                    stack.pop()
                parts.append([n for _, n in stack])
                if stack:
                    shorter = stack[-1][0]
                    parents.append(" ".join(reversed(shorter) if suffix else shorter))
                    exts.append(a)
                    of.append(lang)
                stack.append((tuple(words), a))
            names = ["lang", "phrase", "a", "parts", "ext"]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
            for columns in ((langs, phrases, counts, parts, [None] * len(langs)), (of, parents, [None] * len(of), [None] * len(of), exts)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return ordered.mapInArrow(run, "lang string, phrase string, a long, parts array<long>, ext long")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, cover_percent: int = COVER_PERCENT,
    top: int | None = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best collocations of each language.

    Texts are split into pieces at `[.,;:!?]` and line ends and into words at blanks; A-Z are lower-cased. a, l and r are
    the counts of the phrase and of the two parts of its worst cut, n counts the language's words, and the score is
    floor(1000 a n / (l r)), exact in 38 digits. Phrases that lie in a longer one of at least `cover_percent` of their
    count are dropped: one word more is enough to look at, as counts only fall with length. Null languages are 'und';
    null and empty texts hold nothing; repeated rows count each; an empty table gives an empty result; other columns are
    not read. `top` None gives all.
    """
    spark = docs.sparkSession
    stream, totals, kept = count_streams(docs, text, lang, min_count, max_words)
    before = lockstep(spark, stream, False).withColumnsRenamed({"parts": "left"}).withColumn("right", F.lit(None).cast("array<long>"))
    behind = lockstep(spark, stream, True).withColumnsRenamed({"parts": "right"}).withColumn("left", F.lit(None).cast("array<long>"))
    merged = before.unionByName(behind).groupBy("lang", "phrase")
    merged = merged.agg(F.max("a").alias("a"), F.max("left").alias("left"), F.max("right").alias("right"), F.max("ext").alias("ext"))
    rows = merged.filter((F.size("left") > 0) & (F.col("ext").isNull() | (100 * F.col("ext") < cover_percent * F.col("a"))))
    rows = rows.join(totals, "lang").withColumn("words", F.size("left") + 1)
    exact = "cast({} as decimal(18, 0))"
    over = f"{exact.format('1000 * a')} * {exact.format('n')}"
    under = f"{exact.format('element_at(left, k)')} * {exact.format('element_at(right, words - k)')}"
    worst = F.expr(f"array_min(transform(sequence(1, words - 1), k -> struct(({over}) div ({under}) as score, k as k)))")
    rows = rows.withColumn("cut", worst).select(
        "lang", "phrase", "a", F.expr("element_at(left, cut.k)").alias("l"), F.expr("element_at(right, words - cut.k)").alias("r"), "n", F.col("cut.score").alias("score")
    )
    rows = store(rows, "collocations")
    for frame in kept:
        discard(frame)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
