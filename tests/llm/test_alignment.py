"""Token alignment against plain brute force, and quality scores learned from preferences."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from winnow.llm import alignment, pairwise, queries

A_PATH, B_PATH = public_tokenizers.path(queries.BYTE_TOKENIZER), public_tokenizers.path(queries.PIECE_TOKENIZER)
FOLDER = "/root/testdata/sf0.001"
ODD = [" ", "  ", "\n", "\t", "a", "b", "the", " the", "foo", "1", "23", "é", "🙂", "日本", "\x00", "\x1c", " ", " ", "\x85", ".", "'s", "\r\n", "İ", "ﬁ", "_"]
ODD += ["<|endoftext|>", "<s>", "<0x41>", " unbelievable", "Tokenization", " don't", "ing"]

# --- token alignment ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    return alignment.tokenizer_pair(A_PATH, B_PATH)


def brute_tokens(both, text):
    """Ids and byte ranges of both sides from one call of each library on the whole text; None if not reproduced."""
    if not text:
        return None
    sides = []
    for ids, parts in ((both.a.encode(" " + text, add_special_tokens=False).ids, both.a_bytes), (both.b.encode(text), both.b_bytes)):
        ends = np.cumsum([len(parts[n]) for n in ids]).tolist()
        if b"".join(parts[n] for n in ids) != (" " + text).encode():
            return None
        sides.append((ids, list(zip([0, *ends], ends))))
    return sides


def brute_rows(both, rows):
    links, found = {}, {}
    for key, (_, text) in enumerate(rows):
        sides = brute_tokens(both, text)
        links[key], found[key] = Counter(), (0, 0, 0, "")
        if sides is None:
            continue
        (a, ra), (b, rb) = sides
        groups, i, j = [], 0, 0
        for end in sorted({e for _, e in ra} & {e for _, e in rb}):
            x = next(k for k in range(i, len(ra)) if ra[k][1] == end) + 1
            y = next(k for k in range(j, len(rb)) if rb[k][1] == end) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            links[key].update((a[p], b[q]) for p in range(i, x) for q in range(j, y) if max(ra[p][0], rb[q][0]) < min(ra[p][1], rb[q][1]))
            i, j = x, y
        found[key] = (len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest())
    total = sum(links.values(), Counter())
    most = {}
    for (_, b), n in total.items():
        most[b] = max(most.get(b, 0), n)
    return [
        (rows[k][0], *found[k][:3], sum(own.values()), sum(n for p, n in own.items() if total[p] == most[p[1]]), sum(n * total[p] for p, n in own.items()), found[k][3])
        for k, own in links.items()
    ]


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def odd_rows():
    rng = random.Random(13)
    rows = [(i, "".join(rng.choice(ODD) for _ in range(rng.randrange(1, 40)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " "), (403, "trailing "), (404, "▁ not reproduced"), (405, "x" * 5000), (406, " " * 3000), (407, "word and more " * 30_000)]
    return rows + [rows[3], rows[3], (None, "no id"), (None, "no id")]


def test_alignment_matches_brute_force(spark, both):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, links int").repartition(4)
    got = alignment.cross_tokenizer(docs, A_PATH, B_PATH).select(*NAMES).collect()
    want = brute_rows(both, rows)
    order = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert [r for r in want if r[0] == 404][0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_segments_and_encoders_change_nothing(both, monkeypatch):
    texts = [t for _, t in odd_rows() if t and len(t) < 3000]
    for size in (1, 7, 1 << 18):
        for text in texts:
            parts = alignment.segments(text, size)
            assert "".join(parts) == " " + text
            found = both.encode(parts)
            assert (None in found) == (brute_tokens(both, text) is None)
            if None not in found:
                unpack = lambda side: [n for ids in found for n in np.frombuffer(ids[side], np.uint32).tolist()]
                assert unpack(0) == both.a.encode(" " + text, add_special_tokens=False).ids
                assert unpack(1) == both.b.encode(text)


def test_skipping_finds_every_group():
    rng = random.Random(1)
    for _ in range(500):
        last = rng.randrange(1, 400)
        thick = rng.choice([2, 3, 50])
        sides = [sorted({last, *(k for k in range(1, last) if rng.randrange(thick))}) for _ in range(2)]
        if rng.random() < 0.3:
            sides[1] = sides[0]
        ea, eb = sides
        a, b = (np.diff(side, prepend=0).tolist() for side in sides)
        straight, irregular = alignment.align(a, b)
        ends, at = [], (0, 0)
        for i, j, x, y, skipped in sorted([(i, j, i + n, j + n, True) for i, j, n in zip(*straight)] + [(*g, False) for g in zip(*irregular)]):
            assert (i, j) == at
            ends += ea[i:x] if skipped else [ea[x - 1]]
            assert not skipped or ea[i:x] == eb[j:y]
            at = (x, y)
        assert ends == sorted(set(ea) & set(eb)) and at == (len(ea), len(eb))


def test_a_table_without_its_file_raises(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    aligned = alignment.align_documents(docs, A_PATH, B_PATH)
    pair = alignment.tokenizer_pair(A_PATH, B_PATH)
    table = alignment.write_table(alignment.count_pairs(aligned, alignment.link_kind(pair)), pair.width, alignment.link_kind(pair))
    assert sum(n for _, _, n in table.shards) > 0
    table.shards[0] = ("gone", *table.shards[0][1:])
    with pytest.raises(Exception, match="gone"):
        alignment.add_counts(aligned, table).collect()


def test_no_documents_no_links(spark):
    assert alignment.cross_tokenizer(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_alignment_of_the_table(spark, both):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_token_alignment"](spark, FOLDER).select(*NAMES).collect()
    assert sorted(map(tuple, got)) == sorted(brute_rows(both, rows))


# --- quality by preference ----------------------------------------------------------------------------------------


def brute_train(x, labels, pairs, ridge, steps=4000):
    """The same loss by plain gradient descent, pair by pair sums."""
    w = np.zeros(x.shape[1])
    win, lose = pairs
    gap = x[win] - x[lose]
    rate = 1 / (ridge + 0.25 * np.linalg.norm(gap, 2) ** 2)
    for _ in range(steps):
        w -= rate * (ridge * w - gap.T @ (1 / (1 + np.exp(gap @ w))))
    return w


def test_newton_steps_reach_the_minimum_of_the_pair_loss():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, len(pairwise.MEASURES)))
    labels = (x[:, 0] + 0.5 * x[:, 3] + rng.normal(size=60) > 0).astype(int)
    model = pairwise.train(x, labels, (30, 30))
    win, lose = pairwise.preference_pairs(labels, np.random.default_rng(pairwise.SEED))
    assert (labels[win] == 1).all() and (labels[lose] == 0).all()
    features = model.features(x)
    loss = lambda w: np.log1p(np.exp(-(features[win] - features[lose]) @ w)).sum() + pairwise.RIDGE / 2 * w @ w
    assert loss(model.weights) <= loss(brute_train(features, labels, (win, lose), pairwise.RIDGE)) + 1e-6


def test_threshold_is_the_quantile_of_the_labelled_scores():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(2, 60))
        values = rng.permutation(n).astype(float)
        poor = int(rng.integers(1, n))
        cut = pairwise.weighted_quantile(values, np.ones(n), poor / n)
        assert (values < cut).sum() == poor
    labels = np.array([0] * 20 + [1] * 40)
    x = rng.normal(size=(60, len(pairwise.MEASURES))) + 6 * labels[:, None]
    model = pairwise.train(x, labels, (20, 40))
    assert ((model.score(x) >= pairwise.CUT) == (labels == 1)).all()
    assert ((model.score(x) >= pairwise.CUT) == (model.strength(x) >= model.threshold)).all()


def brute_repetition(text):
    words = text.encode().split()
    return len(words) - len(set(words)), len(words) - 1 - len(set(zip(words, words[1:]))) if words else 0


def test_measures_of_texts():
    text = "One two two two. THREE four!\nOne two two two.\nOne two two two."
    found = dict(zip(pairwise.MEASURES, pairwise.measures(text)))
    words = text.split()
    n = len(words) + pairwise.SMOOTH
    repeated, pairs = brute_repetition(text)
    assert found["distinct_words"] == pytest.approx(repeated / n)
    assert found["distinct_pairs"] == pytest.approx(pairs / (len(words) - 1 + pairwise.SMOOTH))
    assert found["capital_words"] == pytest.approx(1 / n) and found["distinct_lines"] == pytest.approx(1 / (3 + pairwise.SMOOTH))
    assert found["line"] == pytest.approx(2 / (len(text) + pairwise.SMOOTH))
    for odd in (None, "", " ", "\n\n", "\0", "x" * 100_000, "é" * 50_000, "a b " * 200_000):
        assert np.isfinite(pairwise.measures(odd)).all()
    long = ("a few plain words. " * 5000).encode()
    assert b"".join(pairwise._blocks(long)) == long and max(map(len, pairwise._blocks(long))) <= pairwise.BLOCK


def test_scores_separate_held_out_documents(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice("the cat sat on a mat and then it ran home again quickly".split()) for _ in range(80)) + "."
    poor = lambda: " | ".join(rng.choice("CLICK HERE $$$ buy ### now &&&".split()) for _ in range(60))
    rows = [(i, good() if i % 4 else poor(), i) for i in range(400)]
    labels = [(i, int(bool(i % 4)), None) for i in range(0, 400)]
    rows += [(500, None, 0), (501, "", 0), (None, good(), 0), (1, good(), 0), (1, rows[1][1], 1)]  # an id with three rows
    labels += [(2, 1 - labels[2][1], 0), (3, 1, 0), (None, 1, 0), (7, None, 0), (9, 5, 0), (999, 0, 0)]  # both labels, repeated, null, other, absent
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int, text int")
    known = {r["id"]: r["label"] for r in pairwise.clean_labels(table, "doc_id", "quality").collect()}
    assert 2 not in known and known[3] == 1 and None not in known and known[9] == 1
    train = docs.filter("coalesce(crc32(cast(cast(doc_id as string) as binary)), 0) % 4 <> 2")
    model = pairwise.fit(train, table)
    again = pairwise.fit(train.repartition(7), table)
    assert np.array_equal(model.weights, again.weights) and model.threshold == again.threshold
    got = pairwise.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= pairwise.CUT) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 60 and all(r["predicted"] == bool(r["doc_id"] % 4) for r in held)
    empty = {r["score"] for r in got if r["doc_id"] in (500, 501)}
    assert len(empty) == 1
    top = pairwise.above_quantile(pairwise.score(docs, model), 0.9)
    assert 0.08 * len(rows) <= top.count() <= 0.12 * len(rows)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert pairwise.fit(docs, labels) is None
    assert [tuple(r) for r in pairwise.score(docs, None).select("score", "predicted").collect()] == [(0.0, 0)] * 2
    assert pairwise.score(docs.limit(0), None).count() == 0
    one = pairwise.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert pairwise.score(docs, one).count() == 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_held_out_quality_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op11_pairwise_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_threshold_and_label_counts_come_from_all_training_documents(spark, monkeypatch):
    """A sample of a few documents fits the strengths; labels of documents that are not given count nowhere."""
    monkeypatch.setattr(pairwise, "MAX_DOCS_PER_LABEL", 15)
    texts = [(i, ("plain words of a text " * (1 + i % 9) if i % 3 else "A1 $$ ## | <> " * (2 + i % 7)) + "x" * (i % 11)) for i in range(240)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = [(i, int(i % 3 > 0)) for i in range(240)] + [(i, 0) for i in range(1000, 1500)]
    model = pairwise.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    strength = np.sort(model.strength(np.array([pairwise.measures(t) for _, t in texts])))
    assert model.threshold == pytest.approx((strength[79] + strength[80]) / 2)


def test_order_statistic_is_exact(spark):
    values = [0.1, 0.1, 0.1, -5.0, 3.0, 3.0000000000000004, 1e9, 1e-9, 2.0]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    assert [pairwise.order_statistic(df, "s", k + 1, 2) for k in range(len(values))] == sorted(values)
