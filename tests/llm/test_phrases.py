"""Phrase collocations against a plain count, quality scores from preferences, and token alignment against brute force."""

import random
from collections import Counter

import pytest

from winnow.llm import phrases

DOCS = "doc_id long, text string, lang string"


def brute_collocations(rows, min_count, max_words, percent, top):
    """All counts in dictionaries, every longer candidate looked through."""
    import re

    pieces = {}
    for _, text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            pieces.setdefault(lang or "und", []).append(re.findall("[^ \t]+", piece))
    out = []
    for lang, found in pieces.items():
        n = sum(map(len, found))
        f = Counter(tuple(ws[i : i + k]) for ws in found for k in range(1, max_words + 1) for i in range(len(ws) - k + 1))
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= min_count}
        inside = {}
        for g, a in candidates.items():
            for i in range(len(g)):
                for j in range(i + 1, len(g) + 1):
                    if j - i < len(g):
                        inside[g[i:j]] = max(inside.get(g[i:j], 0), a)
        rated = []
        for g, a in candidates.items():
            if 100 * inside.get(g, 0) >= percent * a:
                continue
            score, k = min(((1000 * a * n) // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            rated.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, name, left, right) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, rank, name.decode(), -a, left, right, n, -score))
    return sorted(out)


def wordy(rng, n):
    """Text with set phrases, odd blanks and every kind of break."""
    stock = ["the", "of", "New York", "new york City", "in spite of the", "Ä ö", "a\x01b", "a", "b", "x y", "日本 語", "to be or not to be"]
    return "".join(rng.choice(stock) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!", " ?\r\n", ";", ":", "\x0b", "\x0c"]) for _ in range(n))


@pytest.fixture(scope="module")
def wordy_rows():
    rng = random.Random(12)
    rows = [(i, wordy(rng, rng.randrange(0, 40)), [None, "en", "de", "und"][i % 4]) for i in range(120)]
    rows += [(200, None, "en"), (201, "", "en"), (202, " \t\n.", "xx"), (203, "one", "yy"), (204, wordy(rng, 4000), "en"), (205, "no break " * 3000, "zz")]
    return rows + [rows[1]] * 5


@pytest.mark.parametrize("min_count, max_words, percent, top", [(3, 5, 100, 10_000), (2, 4, 60, 10_000), (5, 5, 100, 7), (1, 3, 100, 10_000)])
def test_collocations_match_brute_force(spark, wordy_rows, min_count, max_words, percent, top):
    docs = spark.createDataFrame(wordy_rows, DOCS).withColumnsRenamed({"doc_id": "a"})  # clashes with a count
    got = phrases.collocations(docs.repartition(5), min_count=min_count, max_words=max_words, cover_percent=percent, top=top)
    want = brute_collocations(wordy_rows, min_count, max_words, percent, top)
    assert want and sorted(map(tuple, got.collect())) == want


def test_collocations_over_many_range_partitions(spark, wordy_rows):
    """Range boundaries fall inside phrases, and tasks begin with the counts of earlier partitions."""
    docs = spark.createDataFrame(wordy_rows, DOCS)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        got = phrases.collocations(docs, min_count=2, top=None).collect()
    finally:
        spark.conf.unset(key)
    assert sorted(map(tuple, got)) == brute_collocations(wordy_rows, 2, 5, 100, None)


def test_full_filters_change_nothing(spark, wordy_rows, monkeypatch):
    monkeypatch.setattr(phrases, "held", lambda bits, columns: columns[0] == columns[0])
    docs = spark.createDataFrame(wordy_rows, DOCS)
    got = phrases.collocations(docs, min_count=3, top=None).collect()
    assert sorted(map(tuple, got)) == brute_collocations(wordy_rows, 3, 5, 100, None)


def test_small_blocks_change_nothing():
    rng = random.Random(4)
    text = wordy(rng, 3000).encode().translate(phrases.LOWER)
    whole = dict(zip(*(x.to_pylist() if hasattr(x, "to_pylist") else x.tolist() for x in phrases.count_block(text, "en", 1, []))))
    parts = Counter()
    for part in phrases.slices(text, 100):
        parts.update(dict(zip(*(x.to_pylist() if hasattr(x, "to_pylist") else x.tolist() for x in phrases.count_block(part, "en", 1, [])))))
    assert parts == whole and sum(1 for _ in phrases.slices(text, 100)) > 20


def test_products_beyond_64_bits(spark):
    rows = spark.createDataFrame([("en", 10**13, 2 * 10**13, 10**13, 10**12)], "lang string, a long, n long, l long, r long")
    got = rows.selectExpr("(cast(1000 * a as decimal(18, 0)) * cast(n as decimal(18, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))").first()[0]
    assert got == 1000 * 10**13 * 2 * 10**13 // (10**13 * 10**12)


def test_no_documents_no_phrases(spark):
    got = phrases.collocations(spark.createDataFrame([], DOCS))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.count() == 0
