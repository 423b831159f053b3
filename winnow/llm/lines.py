"""Quality rules from repetition: within a text by windows and lines, across documents by line frequency per host.

Built-in functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.shared import SPACES, WHITE, WORD, discard, split_by_keys, store

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "[#*$%&|<>]"
MIN_DOCUMENTS = 20
MIN_KEPT_PERCENT = 20


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of words; empty for null and for texts without a word."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACES)).otherwise(F.array().cast("array<string>"))


def repeated_words(hashes: Column, size: int = WINDOW) -> Column:
    """Words inside windows of `size` words that occur twice or more in the text.

    `hashes` are the word hashes. Window hashes are sorted with their positions, so that equal windows are neighbours;
    the sort runs only for texts with a repeated window.
    """
    zero = F.lit(0).cast("long")

    def covered(positions: Column) -> Column:
        gaps = F.transform(positions, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(positions, i + 1) - p, F.lit(size))))
        return F.aggregate(gaps, zero, lambda total, gap: total + gap)

    def repeats(pairs: Column) -> Column:
        same = lambda i, value: F.coalesce(F.get(pairs, i)["h"] == value, F.lit(False))
        kept = F.filter(pairs, lambda pair, i: same(i - 1, pair["h"]) | same(i + 1, pair["h"]))
        return _let(F.array_sort(F.transform(kept, lambda pair: pair["at"])), covered)

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - size)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))

    def count(values: Column) -> Column:
        pairs = F.array_sort(F.transform(values, lambda value, i: F.struct(value.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(values)) == F.size(values), zero).otherwise(_let(pairs, repeats))

    return _let(hashes, lambda h: F.when(F.size(h) <= size, zero).otherwise(_let(windows(h), count)))


def base_columns(text: str = "text") -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by name."""
    t = F.coalesce(F.col(text), F.lit(""))
    worded = F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD))
    stats = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(F.transform(w, lambda word: F.xxhash64(word))).alias("n_repeat_words"),
    )
    both = _let(words_of(t), stats)
    return {
        "_stats": both,
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": _let(worded, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    }


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the five counts and base_failed."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    kept = docs.drop(*[c for c in names if c in docs.columns])
    counted = kept.withColumns(base_columns(text))
    counted = counted.withColumns({c: F.col(f"_stats.{c}") for c in ("n_words", "word_chars", "n_repeat_words")})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).select(*kept.columns, *names)


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, one space between words."""
    return F.lower(F.btrim(F.regexp_replace(F.regexp_replace(line, SPACES, " "), "[0-9]+", "0")))


def line_key(line: Column) -> Column:
    return F.xxhash64(normalised(line))


def host_key(host: Column) -> Column:
    """Hash of the host; null is a host of its own."""
    return F.xxhash64(host, host.isNull())


def line_rows(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """(host, id, doc, txt, at, words, line) for every line with a word: hashes of host, text and normalised line.

    doc tells documents apart: the hash of the id, or of the text where the id is null.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    txt = F.xxhash64(t)
    doc = F.when(F.col(doc_id).isNull(), txt).otherwise(F.xxhash64(F.col(doc_id)))
    rows = docs.select(host_key(F.col(host)).alias("host"), F.col(doc_id).alias("id"), doc.alias("doc"), txt.alias("txt"), F.posexplode(F.split(t, "\n")).alias("at", "line"))
    rows = rows.withColumn("words", F.regexp_count("line", F.lit(WORD)).cast("long")).filter("words > 0")
    return rows.withColumn("line", line_key(F.col("line")))


def frequent_lines(rows: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(host, line, first) of the lines in more than `min_documents` documents of their host, however large it is.

    Documents are told apart by id, so copies of a text count each. first is the text, by its hash, of the document with
    the smallest id that holds the line (null ids come last). Lines are made distinct per document and then counted, both
    times in the tasks before the shuffle; a hot host is spread by its lines.
    """
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "txt")
    per_document = rows.groupBy("host", "line", "doc").agg(F.min(order).alias("first"))
    counts = per_document.groupBy("host", "line").agg(F.count("*").alias("docs"), F.min("first").alias("first"))
    return counts.filter(F.col("docs") > min_documents).select("host", "line", "first.txt").withColumnRenamed("txt", "first")


def dropped_lines(docs: DataFrame, text: str, host: str, doc_id: str, min_documents: int) -> DataFrame:
    """(_host, _txt, _drop): of every text that loses lines, the places of these lines and their numbers of words.

    A frequent line stays in the document with the smallest id that holds it, and in copies of that text. Lines meet the
    frequent ones by an equi-join on (host, line), so no host's lines are gathered in one place or sent to all tasks.
    """
    rows = store(line_rows(docs, text, host, doc_id), "lines")
    lost = rows.join(frequent_lines(rows, min_documents), ["host", "line"]).filter("txt <> first")
    found = lost.groupBy(F.col("host").alias("_host"), F.col("txt").alias("_txt")).agg(F.collect_set(F.struct("at", "words")).alias("_drop"))
    found = store(found, "dropped-lines")
    discard(rows)
    return found


def _marked(docs: DataFrame, dropped: DataFrame, text: str, host: str) -> DataFrame:
    """The documents with _drop, null where no line is lost."""
    keyed = docs.withColumns({"_host": host_key(F.col(host)), "_txt": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    return keyed.join(dropped, ["_host", "_txt"], "left").drop("_host", "_txt")


def _depleted(min_words: int, min_kept_percent: int) -> Column:
    gone = F.aggregate(F.transform("_drop", lambda d: d["words"]), F.lit(0).cast("long"), lambda total, n: total + n)
    few = _let(F.col("n_words") - gone, lambda left: (left < min_words) | (100 * left < min_kept_percent * F.col("n_words")))
    return F.col("_drop").isNotNull() & few


def quality(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    doc_id: str = "doc_id",
    min_documents: int = MIN_DOCUMENTS,
    min_words: int = MIN_WORDS,
    min_kept_percent: int = MIN_KEPT_PERCENT,
) -> DataFrame:
    """The documents with the base counts, base_failed and kept.

    kept is false for documents that fail the base rules, and for depleted ones: those of which the frequent lines of
    their host, but for those that stay by `dropped_lines`, leave less than `min_words` words or less than
    `min_kept_percent` of their words. Null text has no words and fails; a null host is a host of its own; rows with a
    null id are one document per text; repeated rows share a verdict; an empty table gives an empty result; columns named
    like the new ones are replaced.
    """
    dropped = dropped_lines(docs, text, host, doc_id, min_documents)
    ruled = base_rules(docs.drop("kept"), text)
    marked = _marked(ruled, dropped, text, host)
    return marked.select(*ruled.columns, (~(F.col("base_failed") | _depleted(min_words, min_kept_percent))).alias("kept"))


def clean(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The documents that `quality` keeps, without the frequent lines of their host, and with the columns it adds.

    The counts are those of the text before the removal. Only texts that may lose lines are moved to meet their places;
    the others are judged where they are read.
    """
    dropped = dropped_lines(docs, text, host, doc_id, min_documents)
    bare = docs.drop("kept")
    keyed = F.xxhash64(host_key(F.col(host)), F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    touched, whole = split_by_keys(bare, keyed, dropped.select(F.xxhash64("_host", "_txt")), late=text)
    ruled = base_rules(touched, text)
    kept = _marked(ruled, dropped, text, host).filter(~F.col("base_failed") & ~_depleted(MIN_WORDS, MIN_KEPT_PERCENT))
    lines = F.split(F.col(text), "\n")
    # array_except works by a hash set, so long texts take time in proportion
    stay = lambda all_: F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.transform("_drop", lambda d: d["at"]))
    left = _let(lines, lambda all_: F.array_join(F.transform(stay(all_), lambda at: F.get(all_, at)), "\n"))
    cleaned = kept.withColumn(text, F.when(F.col("_drop").isNotNull(), left).otherwise(F.col(text))).select(*ruled.columns)
    return cleaned.unionByName(base_rules(whole, text).filter(~F.col("base_failed"))).withColumn("kept", F.lit(True))
