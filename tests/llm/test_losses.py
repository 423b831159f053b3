"""Inputs on which operators once lost data: repeated ids, open tags, absent files, many part files, texts of marks."""

import glob
import hashlib
import math
import os
import time

import numpy as np
import pytest

import corpus_pipeline
from winnow.llm import hnsw, kneser, language, rans, tagpaths, warc

STORY = ["A first paragraph, with commas, and some length to it; it goes on. " * 3, "The second one, as long, says what is left to say. It ends here, at last. " * 3]
STORY = [s.strip() for s in STORY]
BODY = "".join(f"<p>{s}</p>" for s in STORY)


def test_every_payload_is_in_a_response_when_ids_repeat(spark, tmp_path):
    a, b, c = ("a" * 1500, "b" * 1500, "c" * 1500)
    rows = [(1, a), (5, a), (1, b), (9, c), (1, c), (5, a), (None, a), (1, "short")]
    pages = spark.createDataFrame([(p, "u", h) for p, h in rows], "page_id long, url string, html string").repartition(3)
    warc.write_warc(pages, f"{tmp_path}/w")
    found = warc.records(warc.read_warc(spark, f"{tmp_path}/w")).collect()
    assert len(found) == len(rows)
    responses = {r["payload_digest"] for r in found if r["record_type"] == "response"}
    assert responses >= {hashlib.sha1(h.encode()).hexdigest() for _, h in rows}
    largest = {a: 5, b: 1, c: 9, "short": 1}
    want = sorted((p, hashlib.sha1(h.encode()).hexdigest(), "revisit" if p is not None and len(h) > 1000 and p != largest[h] else "response") for p, h in rows if p)
    got = sorted((int(r["record_id"].removeprefix("urn:page:")), r["payload_digest"], r["record_type"]) for r in found if r["record_id"] != "urn:page:")
    assert got == want


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav><a href=/>Home</a><article>{BODY}</article></body>",
        f"<body><aside><p>Beside it.</p><article>{BODY}</article></body>",
        f"<body><nav><ul><li><a href=/>Home</a><div>{BODY}</div></body>",
        f"<body><header>{BODY}</header></body>",
        f"<body><article title=it's>{BODY}</article></body>",
        f'<body><div data-x=5" tall><article>{BODY}</article></div></body>',
        f"<body><article title = 'a > b' class=\"x>y\">{BODY}</article></body>",
    ],
)
def test_articles_survive_open_frames_and_stray_quotes(page):
    assert tagpaths.extract(page) == "\n\n".join(STORY)


def test_frames_beside_an_article_stay_out():
    footer = "<footer><p>" + "Terms, rules, and notes; all of them apply here. " * 40 + "</p></footer>"
    assert tagpaths.extract(f"<body><nav>Home, away.</nav><div>{BODY}</div>{footer}</body>") == "\n\n".join(STORY)
    cards = "<aside><article><p>Another story, in short.</p></article></aside>"
    assert tagpaths.extract(f"<body><div>{BODY}</div>{cards}</body>") == "\n\n".join(STORY)


@pytest.mark.parametrize("page", ["<div>{}, here.", "<form>{}, here.", "<div class=ad>{}, here.", "<nav>{}, here.", "<div></x>", "<span></b>", "<li><ul>{}", "<p><span>{}"])
def test_work_grows_in_proportion_to_depth(page):
    def seconds(n):
        data = "<body><p>" + "".join(page.format(k) for k in range(n))
        start = time.process_time()
        tagpaths.extract(data)
        return time.process_time() - start

    seconds(500)
    assert seconds(16_000) < 40 * max(0.01, seconds(1000))


def test_scoring_without_the_model_files_raises(spark):
    docs = spark.createDataFrame([("a b a b c",), ("b a",)], "text string")
    model = kneser.train(docs)
    assert kneser.score(docs, model).count() == 2
    for name in model.shards:
        assert os.path.getsize(f"{model.folder}/{name}") == model.shards[name]
    gone = kneser.Model(**{**vars(model), "folder": model.folder + "-elsewhere"})
    with pytest.raises(Exception, match="shared folder"):
        kneser.score(docs, gone).collect()


def test_part_files_are_ordered_by_number(spark):
    names = ["part-99999-a-c000.txt", "part-100000-a-c000.txt", "part-00002-a-c010.txt", "part-00002-a-c009.txt", "part-1000000-a-c000.txt"]
    files = spark.createDataFrame([(f"file:/x/blocks/{n}",) for n in names], "path string")
    got = [r["path"].rpartition("/")[2] for r in files.orderBy(*rans.file_order("path")).collect()]
    assert got == [names[k] for k in (3, 2, 0, 1, 4)]


def test_equal_ids_are_spread_over_files(spark, tmp_path):
    from tests.llm.test_files import PATH

    docs = spark.createDataFrame([(None, f"word{k} and more {k * 7}") for k in range(400)], "doc_id long, text string")
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        rans.write_tokens(docs, f"{tmp_path}/t", PATH)
    finally:
        spark.conf.unset(conf)
    assert sum(os.path.getsize(f) > 0 for f in glob.glob(f"{tmp_path}/t/blocks/part-*")) >= 4
    found = rans.read_digests(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert len(found) == 400 and all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(found, found[1:]))


@pytest.mark.parametrize("text", ["² ½ ①", "12 ٣ !", "___", "́̈", "🙂 ™ ©", "Ⅷ ⁿ⁵"[:1], "", None])
def test_texts_without_a_letter_have_no_language(text):
    assert not language.has_letter(text)
    net = language.train(["some words here", "andere Worte dort"], ["en", "de"])
    assert language.predict_texts(language.Applier(net), [text, "words"])[0][0] == language.UNKNOWN


def brute_probabilities(net, window):
    """The network's answer for one window, position by position."""
    pooled = []
    for bank, bias in zip(net.banks, net.biases):
        width, _, filters = bank.shape
        for f in range(filters):
            sums = [sum(float(net.embed[window[at + k]] @ bank[k, :, f]) for k in range(width)) for at in range(len(window) - width + 1)]
            pooled.append(max(0.0, max(sums) + float(bias[f])))
    logits = [sum(p * float(net.out[k, c]) for k, p in enumerate(pooled)) + float(net.out_bias[c]) for c in range(len(net.labels))]
    top = max(logits)
    weights = [math.exp(x - top) for x in logits]
    return [w / sum(weights) for w in weights]


def test_predictions_match_a_loop_over_windows():
    net = language.train(["some words in here and there " * 30, "andere Worte dort und hier " * 30, "otras palabras por aquí"], ["en", "de", "es"])
    texts = ["words and words", "Worte " * 60, "palabras aquí y dort " * 30]
    labels, scores = language.predict_texts(language.Applier(net), texts)
    for text, label, score in zip(texts, labels, scores):
        data = text.encode()
        parts = [data[at : at + language.WINDOW] for at in range(0, len(data), language.WINDOW)]
        found = [brute_probabilities(net, list(p.ljust(language.WINDOW, b"\0"))) for p in parts]
        mean = [sum(len(p) * f[c] for p, f in zip(parts, found)) / len(data) for c in range(3)]
        assert label == net.labels[int(np.argmax(mean))] and score == pytest.approx(max(mean), abs=1e-5)


def brute_extract_scores(page):
    """Tag-path ratios with paths as tuples of labels and a walk over all elements of every block."""
    blocks = tagpaths._without_named([b for b in tagpaths.blocks_of(page) if not b.noise])
    paths = []
    for b in blocks:
        node, path = b.leaf, []
        while node.parent:
            path.append(node.path)
            node = node.parent
        paths.append(tuple(reversed(path)))
    fused = [1.0] * len(blocks)
    for measure, start in ((lambda b: max(0, len(b.text) - b.linked), 0), (lambda b: sum(c in ".,;:!?…。，、；：！？«»“”\"()" for c in b.text), 0.5)):
        means = []
        for p in paths:
            own = [b for b, q in zip(blocks, paths) if q == p]
            means.append((start + sum(map(measure, own))) / len(own))
        smooth = [math.sqrt(m * (0.25 * means[max(0, k - 1)] + 0.5 * m + 0.25 * means[min(len(means) - 1, k + 1)])) for k, m in enumerate(means)]
        fused = [f * (math.sqrt(s / max(smooth)) if max(smooth) else 0) for f, s in zip(fused, smooth)]
    if any(b.main for b in blocks):
        fused = [f * (1 if b.main else tagpaths.UNMARKED) for f, b in zip(fused, blocks)]
    return blocks, fused


def test_ratios_match_a_plain_form(spark):
    import random

    rng = random.Random(3)
    tags = ["div", "p", "ul", "li", "section", "article", "span", "a href=x", "div class=content", "blockquote", "nav", "form"]
    for _ in range(300):
        page = "<body>" + "".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags).split()[0]}>", "Some text, here. ", "more (words); "]) for _ in range(60))
        blocks, want = brute_extract_scores(page)
        got = tagpaths.path_ratios(blocks) if blocks else []
        assert np.allclose(got, want)


def vectors_by_level(n, dim, seed):
    """Unit vectors in pairs of near copies, sorted as a shard sorts them, and their levels."""
    rng = np.random.default_rng(seed)
    half = rng.normal(size=(n // 2, dim))
    values = hnsw.unit(np.concatenate([half, half + rng.normal(scale=0.1, size=half.shape)])).astype(np.float32)
    levels = hnsw.levels_of(np.arange(n))
    order = np.argsort(-levels, kind="stable")
    return values[order], levels[order]


def test_graph_whose_upper_layer_is_longer_than_a_first_batch(monkeypatch):
    monkeypatch.setattr(hnsw, "FIRST", 64)
    unit, levels = vectors_by_level(3000, 24, 0)
    graph = hnsw.build(unit, levels)
    assert len(graph.layers[-2]) > 64 and [len(x) for x in graph.layers][-1] == 3000
    assert all(((x >= -1) & (x < len(x))).all() for x in graph.layers)
    truth = unit @ unit.T >= 0.9
    q, x = hnsw.all_within(graph, unit, 0.9, hnsw.BEAM)
    found = np.zeros_like(truth)
    found[q, x] = True
    assert not (found & ~truth).any() and found.sum() >= 0.99 * truth.sum() and truth.sum() > 5500


def test_crowded_shards_are_compared_in_bounded_parts():
    rng = np.random.default_rng(3)
    unit = hnsw.unit(rng.normal(size=32) + rng.normal(scale=0.01, size=(12_000, 32))).astype(np.float32)
    graph = hnsw.Graph(unit, [np.full((12_000, 32), -1, np.int32)])
    sizes = [len(q) for q, _ in hnsw._compare(graph, unit[:700], np.arange(700), 0.9)]
    assert sum(sizes) == 700 * 12_000 and max(sizes) <= hnsw.VISITED // 16


def test_links_are_counted_and_grouped_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(hnsw, "HELD", 10)
    rng = np.random.default_rng(4)
    pairs = rng.integers(0, 60, (40, 2))
    links, parent = hnsw._Links(5), list(range(60))
    for at in range(0, 40, 3):
        links.add(pairs[at : at + 3, 0], pairs[at : at + 3, 1])
        assert links.held < 10
    for _ in range(60):
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert dict(zip(*map(np.ndarray.tolist, links.groups()))) == {k: p for k, p in enumerate(parent) if p != k}


def brute_links(rows):
    """(n_links, component) of (id, vector) by comparing all pairs; ids are distinct."""
    ids, values = [i for i, _ in rows], np.array([v for _, v in rows])
    unit = values / np.sqrt(np.einsum("ij,ij->i", values, values))[:, None]
    near = unit @ unit.T >= 0.9
    component = np.array(ids)
    while (least := np.where(near, component[None], max(ids) + 1).min(axis=1)).tolist() != component.tolist():
        component = least
    return {i: (int(n) - 1, int(c)) for i, n, c in zip(ids, near.sum(axis=1), component)}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_shards_of_few_bytes_meet_through_their_files(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 8))
    rows = [(3 * i, np.float32(centres[i % 30] + rng.normal(scale=(i % 4) * 0.1, size=8)).astype(float).tolist()) for i in range(300)]
    rows += [(2000 + k, rows[7 * k][1]) for k in range(20)] + [(3000, [0.0, 1.0] * 4), (3001, [-0.0, 1.0] * 4)]
    for name, value in (("SHARD_BYTES", 2000), ("BLOCK", 16), ("BLOCKS_PER_TASK", 2)):
        monkeypatch.setattr(hnsw, name, value)
    opened = []
    monkeypatch.setattr(hnsw, "discard_folder", lambda _, folder: opened.extend(os.listdir(folder)))
    vectors = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in hnsw.near_vectors(vectors, min_shards=2).collect()}
    assert got == brute_links(rows)
    assert len(opened) >= 8 and not any(x.startswith(".") for x in opened)


def test_a_graph_without_its_file_raises(tmp_path):
    with pytest.raises(RuntimeError, match="shared folder"):
        hnsw.open_shard(f"{tmp_path}", 0, 8, 100)


def spoken_rows(labelled):
    """Documents of two languages with and without labels, one of several pieces, and two without a letter."""
    rng = np.random.default_rng(6)
    words = {"aa": [f"the{k}and" for k in "abcdefghijklmnop"], "cc": [f"και{k}της" for k in "αβγδεζηθικλμνξοπ"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + str(rng.integers(1e6)) for _ in range(n))
    langs = ["aa", "cc"] * 30
    rows = [(i, text(lang, 3000 if i == 7 else 40), lang if labelled and i % 3 else None, f"h{i % 2}") for i, lang in enumerate(langs)]
    return rows + [(100 + k, " ".join(str(rng.integers(1e6)) for _ in range(40)), "aa", "h0") for k in range(2 * labelled)], langs


def test_the_language_found_reaches_the_sequences(spark, tmp_path):
    rows, langs = spoken_rows(True)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = corpus_pipeline.language_id(spark, docs, f"{tmp_path}")
    assert stage.columns == [*docs.columns, "lang_pred", "score"]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in stage.collect()}
    assert {i: lang for i, (lang, _) in found.items()} == dict(enumerate(langs))
    pieces = corpus_pipeline.pack_sequences(spark, stage, f"{tmp_path}").collect()
    assert {r["doc_id"] for r in pieces} == set(found) and len([r for r in pieces if r["doc_id"] == 7]) > 1
    assert all((r["lang_pred"], r["score"]) == found[r["doc_id"]] for r in pieces)
    packed = corpus_pipeline.run(spark, f"{tmp_path}").collect()
    assert len(packed) > 30 and all(r["lang_pred"] == found[r["doc_id"]][0] and 0.5 < r["score"] <= 1 for r in packed)


def test_documents_stay_where_no_language_can_be_learnt(spark):
    rows, langs = spoken_rows(False)
    docs = spark.createDataFrame([*rows, (200, "1 2 3", None, "h0"), (201, None, None, "h0")], "doc_id long, text string, lang string, source string")
    found = corpus_pipeline.language_id(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in found) == list(range(len(langs)))
    assert {(r["lang_pred"], r["score"]) for r in found} == {("und", 0.0)}
