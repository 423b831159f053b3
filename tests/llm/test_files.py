"""WARC, token files, packing, page extraction, vectors, the n-gram model and the pipeline on small tables."""

import gzip
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_texts import prose
from winnow.llm import hnsw, kneser, language, packing, queries, rans, tagpaths, tokens, warc

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "It's we'RE he'll. don't", "áb É́ İstanbul ŉ ſ ǅ", "x<|endoftext|>y <|ENDOFTEXT|> z", "a\x1cb\x1db\x85c\xa0d e　f", "日本語 テキスト。「」",
    "a.b,c 1234 5.6% ##a## ​‍", "naïve…» «été»… fin.", "ΑΣ ΟΔΟΣ. σς", "ß. STRASSE", "\x00a\x01 b", "<|startoftext|>", "ﬁ ﬀ. K Å",
]


# --- tokens, packing and token files ------------------------------------------------------------------------------


def test_ids_are_those_of_the_tokenizer():
    whole, own, rng = Tokenizer.from_file(PATH), tokens.encoder(PATH), random.Random(0)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("aZé.,!'# \n<|>0９ßΣ") for _ in range(60)) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def check_packing(rows, docs, capacity):
    """Every document's ids are there once and in order, and every sequence is gapless."""
    whole = Tokenizer.from_file(PATH)
    want = Counter()
    for d, text in docs:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def best_fit(lengths, capacity):
    """Number of sequences of plain best-fit decreasing."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_packing_of_a_table(spark):
    rng = random.Random(1)
    docs = [(i, prose(rng, rng.randrange(0, 60))) for i in range(300)] + [(900, None), (901, ""), (None, "x y"), (903, prose(rng, 2000))] + [(904, "a b c")] * 5
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, length int")
    rows = packing.pack(df, PATH, capacity=128).collect()
    n = check_packing(rows, docs, 128)
    assert n <= 1.03 * best_fit([r["length"] for r in rows], 128)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_exact_complements_reach_the_bound():
    rng = np.random.default_rng(0)
    for n in (1, 7, 200, 20_000):
        lengths = np.minimum(rng.lognormal(4, 1, n).astype(int) + 1, 256)
        counts = np.bincount(lengths, minlength=257)
        used, sequences = np.zeros(257, int), 0
        for parts, times in packing.pack_lengths(counts, 256):
            assert sum(parts) <= 256 and times > 0
            sequences += times
            for p in parts:
                used[p] += times
        assert (used == counts).all()
        bound = -(-int(lengths.sum()) // 256)
        assert sequences <= bound * 1.01 + 2
    # a single, a pair and a triple that fill up exactly, within availability
    counts = np.zeros(101, int)
    counts[[60, 40, 85, 9, 4, 2, 70, 18, 12]] = [2, 2, 1, 1, 1, 1, 1, 1, 1]
    assert {tuple(sorted(p)): t for p, t in packing.pack_lengths(counts, 100)} == {(40, 60): 2, (2, 4, 9, 85): 1, (12, 18, 70): 1}


def test_rans_blocks_checkpoints_and_damage():
    rng = np.random.default_rng(0)
    for n in (1, 5, 1024, 1025, 300_000):
        ids = np.minimum(rng.zipf(1.4, n), 49_000).astype(np.uint32)
        table = rans.Table(rans.normalise(np.bincount(ids)))
        block = rans.encode_ids(ids, table)
        assert (rans.decode_ids(block, table) == ids).all()
        if n == 300_000:
            step = rans.CHECKPOINT_STEPS * rans.LANES
            assert (rans.decode_ids(block, table, 1, 2) == ids[step : 2 * step]).all()
            p = np.bincount(ids) / n
            assert len(block) < 1.1 * -(p[p > 0] * np.log2(p[p > 0])).sum() * n / 8
        for at in (4, len(block) // 2, len(block) - 1):
            bad = bytearray(block)
            bad[at] ^= 1
            with pytest.raises(ValueError):
                rans.decode_ids(bytes(bad), table)
        other = rans.Table(rans.normalise(np.bincount(ids) + 1))
        with pytest.raises(ValueError):
            rans.decode_ids(block, other)
    one = rans.Table(rans.normalise(np.array([0, 5])))
    assert rans.decode_ids(rans.encode_ids(np.ones(3000, np.uint32), one), one).tolist() == [1] * 3000
    assert rans.normalise(np.ones(40_000, int)).sum() == 1 << rans.PRECISION


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    docs = [(1000 - i, prose(rng, rng.randrange(0, 90))) for i in range(200)] + [(5, None), (6, ""), (7, prose(rng, 20_000)), (None, "no id"), (8, "twice"), (8, "twice")]
    docs += [(20_000 + i, t) for i, t in enumerate(ODD)]
    rng.shuffle(docs)
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, start int").repartition(5)
    rans.write_tokens(df, f"{tmp_path}/t", PATH)
    got = [tuple(r) for r in rans.read_digests(spark, f"{tmp_path}/t").select("start", "doc_id", "n_tokens", "ids_crc32").collect()]
    want, start = [], 0
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        ids = ids_of(t)
        want.append((start, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got) == want
    whole = {r["doc_id"]: r["ids"] for r in rans.decode_documents(spark, f"{tmp_path}/t").collect()}
    assert whole[7] == ids_of(dict(docs)[7])
    empty = spark.createDataFrame([], "doc_id long, text string")
    rans.write_tokens(empty, f"{tmp_path}/e", PATH)
    assert rans.read_digests(spark, f"{tmp_path}/e").collect() == []


# --- WARC ---------------------------------------------------------------------------------------------------------


def test_warc_round_trip_with_revisits(spark, tmp_path):
    big, small = "<p>é&amp;</p>" * 200, "<p>x</p>"
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, small), (4, "u", small), (5, "u", None), (6, "u", ""), (7, "u", big), (None, "u", "z" * 1500), (8, "u", "z" * 1500)]
    rows += [(20, "long", "line\n" * 200_000), (20, "long", "line\n" * 200_000), (9, "u", "WARC/1.1\r\n\r\n\x1f\x08" * 200)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, refers_to string").repartition(3)
    warc.write_warc(pages, f"{tmp_path}/w")
    found = warc.read_warc(spark, f"{tmp_path}/w")
    assert warc.gaps(found).count() == 0
    got = []
    for r in warc.records(found).collect():
        page = r["record_id"].removeprefix("urn:page:")
        got.append((int(page) if page else None, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] and int(r["refers_to"].removeprefix("urn:page:"))))
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
    largest = {}
    for p, _, h in rows:
        largest[h] = max(largest.get(h, -1), p or -1)
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        again = p is not None and len(data) >= 1000 and largest[h] != p
        want.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", largest[h] if again else None))
    assert sorted(got, key=str) == sorted(want, key=str)
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/e")
    assert warc.read_warc(spark, f"{tmp_path}/e").collect() == []


def plain(n, body=b"body"):
    return warc.record(n, "http://x", body)


def names(found):
    return [x[3]["warc-record-id"].strip("<>") for x in found if x[0] == "record"]


def test_salvage_of_damaged_archives():
    records = [plain(k, b"payload %d " % k * 50) for k in range(8)]
    members = [warc.member(r) for r in records]
    whole = b"".join(m + warc.EMPTY_MEMBER for m in members)
    assert b"".join(records) == gzip.decompress(whole)
    assert len(names(warc.salvage(whole))) == 8 and len(names(warc.salvage(b"".join(records)))) == 8
    for pieces, sep in ((members, warc.EMPTY_MEMBER), (records, b"")):
        starts = np.cumsum([0] + [len(p) + len(sep) for p in pieces])
        data = bytearray(sep.join(pieces) + sep)
        data[starts[3] + len(pieces[3]) // 2] ^= 0x55
        found = list(warc.salvage(bytes(data)))
        assert names(found) == [f"urn:page:{k}" for k in range(8) if k != 3]
        (gap,) = [x for x in found if x[0] == "gap"]
        assert starts[3] <= gap[1] < gap[2] <= starts[4] and gap[3]
        # cut off in the middle of the last one
        found = list(warc.salvage(bytes(sep.join(pieces) + sep)[: starts[7] + 40]))
        assert names(found) == [f"urn:page:{k}" for k in range(7)] and found[-1][0] == "gap" and found[-1][2] == starts[7] + 40
    # junk before, between and behind, one version line that leads nowhere
    junk = b"junk WARC/1.0\r\nnothing\r\n\r\n\x1f\x8b\x08junk"
    found = list(warc.salvage(junk + members[0] + junk + records[1] + junk))
    assert names(found) == ["urn:page:0", "urn:page:1"] and sum(x[0] == "gap" for x in found) == 3
    covered = sorted((x[1], x[2]) for x in found)
    assert covered[0][0] == 0 and covered[-1][1] == len(junk) * 3 + len(members[0]) + len(records[1])
    assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
    assert list(warc.salvage(b"")) == [] and [x[:3] for x in warc.salvage(b"zzz")] == [("gap", 0, 3)]


def test_salvage_inside_a_member_of_many_records():
    rng = random.Random(4)
    records = [plain(k, "".join(rng.choice("abcdefgh <>") for _ in range(4000)).encode()) for k in range(40)]
    starts = np.cumsum([0] + [len(r) for r in records])
    everything = [f"urn:page:{k}" for k in range(40)]
    bad = bytearray(b"".join(records))
    bad[starts[7] + len(records[7]) - 100] ^= 0x55
    found = list(warc.salvage(warc.member(bytes(bad)) + warc.member(plain(99))))
    assert names(found) == [x for k, x in enumerate(everything) if k != 7] + ["urn:page:99"]
    (gap,) = [x for x in found if x[0] == "gap"]
    assert "differs" in gap[3] and f"bytes {starts[7]} to {starts[8]} of" in gap[3]
    stray = b"\r\n".join(records[:20]) + b"\r\n\n" + b"junk".join(records[20:])
    found = list(warc.salvage(warc.member(stray)))
    assert names(found) == everything and sum(x[0] == "gap" for x in found) == 19
    # a cut tail, and damage in the packed bytes: what was unpacked before stays, what follows the member is found
    whole = warc.member(b"".join(records))
    for data in (whole[: len(whole) * 3 // 4], whole[: len(whole) // 2] + bytes(200) + whole[len(whole) // 2 + 200 :] + warc.member(plain(99))):
        found = list(warc.salvage(data))
        got = [n for n in names(found) if n != "urn:page:99"]
        assert 10 < len(got) < 40 and got == everything[: len(got)]
        (gap,) = [x for x in found if x[0] == "gap"]
        assert gap[3].startswith("gzip: ") and f"behind byte {starts[len(got)]} of" in gap[3]
        assert gap[2] - gap[1] > 1000 and (gap[2] == len(data) or found[-1][3]["warc-record-id"] == "<urn:page:99>" and found[-1][1] == gap[2])
        assert {(x[1], x[2]) for x in found if x[0] == "record" and x[1] == 0} == {(0, gap[1])}
    # a wrong checksum: records with a digest stay, one without has no proof
    unproven = re.sub(rb"WARC-(Block|Payload)-Digest: [^\r]*\r\n", b"", records[1])
    packed = bytearray(warc.member(records[0] + unproven + records[2]))
    packed[-8] ^= 1
    assert names(warc.salvage(bytes(packed))) == ["urn:page:0", "urn:page:2"]
    packed[-8] ^= 1
    assert names(warc.salvage(bytes(packed))) == everything[:3]


# --- pages --------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="home sidebar-open"><header class="site-header"><h1>Site name</h1></header>
<nav><ul><li><a href=a>Menu, one.</a><li><a href=b>Menu two</a></ul></nav><div id="cookie-notice">We use cookies, really. Accept?</div>
<div class="content no-sidebar"><h2>Title &amp; more</h2><p>First paragraph, with <b>bold</b> text &lt;here&gt;.<p>Second,
  over lines; long enough to be the text of the page. Yes!<br>After a break.<ul><li>item one<li>item two, longer</ul><blockquote>Quoted words.</blockquote>
<script>var x = "<p>no</p>";</script></div><div class="widget related-posts"><p>Read this, and that. More.</p></div>
<section id="comments"><p>Great article, thanks! I agree with all of it, every word.</p></section><form><p>Your mail, please.</p><input></form>
<footer><p>&copy; 2020. All rights reserved, everywhere.</p></footer></body></html>"""


def test_main_text_of_an_unmarked_page():
    want = ["Title & more", "First paragraph, with bold text <here>.", "Second, over lines; long enough to be the text of the page. Yes! After a break.", "item one", "item two, longer", "Quoted words."]
    assert tagpaths.extract(PAGE) == "\n\n".join(want)


def test_main_text_of_a_marked_page():
    page = PAGE.replace('<div class="content no-sidebar">', "<article>").replace("</script></div>", "</script><aside>Aside, not this.</aside></article>")
    assert tagpaths.extract(page) == tagpaths.extract(PAGE)
    short = '<body><nav>A long menu, with many, many words. And more.</nav><div class="ad">Buy now, cheap. Really!</div><article><h1>No</h1><p>Yes.</p></article><footer>x, y. z</footer>'
    assert tagpaths.extract(short) == "No\n\nYes."


STORY = [f"Sentence {k} of the story, which is long enough to be read. It has marks, and goes on; to the end of the line." for k in range(6)]


def paragraphs(tag="p"):
    return "".join(f"<{tag}>{x}</{tag}>" for x in STORY)


@pytest.mark.parametrize("tag", ["main", "article", "div"])
@pytest.mark.parametrize("inner", ["p", "div"])
def test_unnamed_boilerplate_is_left_by_its_ratio(tag, inner):
    links = "<div><ul>" + "<li><a href=x>Another story, here</a></li>" * 8 + "</ul></div>"
    promo = "<section><div>Try it free</div><span>for a month</span></section>"
    page = f"<body><div><h4>Site</h4></div><{tag}>{links}<h1>Head</h1>{promo}<div><h2>Below</h2>{paragraphs(inner)}<ul><li>an item</li></ul></div>{promo}{links}</{tag}>{links}</body>"
    assert tagpaths.extract(page) == "\n\n".join(["Head", "Below", *STORY, "an item"])


def test_article_in_plain_divs_beside_marked_teasers():
    teasers = "".join(f"<article><div><a href=x>Teaser {k}</a></div></article>" for k in range(5))
    page = f"<body><div>{teasers}</div><div><div>{paragraphs()}</div></div><div><div>Short line</div></div></body>"
    assert tagpaths.extract(page) == "\n\n".join(STORY)


@pytest.mark.parametrize("wrapper", ["<form id=aspnetForm>", "<div class='layout sidebar-left'>", "<div class=search-page>", "<div id=share-root>", "<form><div class='share'><div class='sidebar'>"])
@pytest.mark.parametrize("tag", ["main", "article", "div"])
def test_wrappers_with_the_name_of_noise_keep_their_main_text(wrapper, tag):
    comments = "<div class=comments>" + "<p>I agree, and more.</p>" * 40 + "</div><div class=ad><p>Buy now, or later. Cheap!</p></div><aside><p>Beside, it.</p></aside>"
    page = f"<body><nav>Menu, one.</nav>{wrapper}<div class=cookie>We use cookies, really.</div><{tag}><h1>Head</h1>{paragraphs()}</{tag}>{comments}</body>"
    assert tagpaths.extract(page) == "\n\n".join(["Head", *STORY])
    # a short line beside the wrapper does not make the rest noise
    assert set(STORY) < set(tagpaths.extract(page.replace("</nav>", "</nav><div><div>Of the town, since 1900.</div></div>")).split("\n\n"))


def test_named_noise_stays_out_beside_main_text():
    form = "<form><p>" + "By sending this, you agree to all of it, now and later. " * 4 + "</p></form>"
    assert tagpaths.extract(f"<body><div>{paragraphs()}</div>{form}</body>") == "\n\n".join(STORY)
    assert tagpaths.extract("<body><div class=search-page><article><p>Yes.</p></article></div><div class=ad>buy</div></body>") == "Yes."
    assert tagpaths.extract("<body><aside><p>Left open<main><p>Yes, here.</p></main><form>Mail, please.</form></body>") == "Yes, here."


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("plain &lt;text", "plain <text"), ("<p>a < b and c", "a < b and c"), ("<script>x</script>", ""), ("<div class=ad>buy</div>", ""),
        ("<p>one<p>two", "one\n\ntwo"), ("<!-- <p>x</p> --><p>y&nbsp; z</p>", "y z"), ("<p title='a>b'>q</p>", "q"), ("<p>never <b>closed", "never closed"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
    ],
)
def test_page_edges(page, want):
    assert tagpaths.extract(page) == want


def test_tag_path_ratios_favour_text_paths():
    blocks = tagpaths.blocks_of("<body>" + "<ul>" + "<li><a href=x>Go there</a></li>" * 20 + "</ul><div>" + "<p>Long text, with marks, and sentences. Quite long.</p>" * 5 + "</div>")
    ratios = tagpaths.path_ratios(blocks)
    assert ratios[-4:].min() > 3 * ratios[:19].max()


def test_pages_of_a_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, None, None, "clash"), (2, None, None, "clash"), (None, "w", "<p>" + "x " * 300_000, "c")], "page_id long, url string, html string, text string")
    out = tagpaths.main_text(pages).collect()
    assert sorted(r["n_chars"] for r in out) == [0, 0, len(tagpaths.extract(PAGE)), 599_999] and all(len(r["text"]) == r["n_chars"] for r in out)
    assert tagpaths.main_text(pages.limit(0)).collect() == []


# --- vectors ------------------------------------------------------------------------------------------------------


def check_vectors(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, kept int")
    good = {i: np.array(np.array(v, np.float32), np.float64) for i, v in rows if v and None not in v and np.isfinite(np.array(v, np.float32)).all() and any(v)}
    unit = {i: v / np.sqrt(v @ v) for i, v in good.items()}
    links = lambda a, b: a in unit and b in unit and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9
    ids = [i for i, _ in rows]
    near = {i: sum(j != i and links(i, j) for j in ids) for i in ids}
    groups = brute.groups(ids, links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in hnsw.near_vectors(df, **options).collect()}
    assert got == {i: (near[i], groups[i], groups[i] == i) for i in ids}
    return near


def test_vectors_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(scale=(i % 5) * 0.1, size=16)]) for i in range(600)]
    rows += [(700 + k, rows[0][1]) for k in range(30)]
    rows += [(800, None), (801, []), (802, [0.0] * 16), (803, [float("nan")] + [1.0] * 15), (804, [float("inf")] * 16), (805, [1.0, 2.0]), (806, [2.0, 4.0]), (807, [None] + [1.0] * 15)]
    monkeypatch.setattr(hnsw, "BLOCK", 100)
    near = check_vectors(spark, rows, min_shards=3)
    assert max(near.values()) > 30
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hnsw.near_vectors(empty).collect() == []


def test_graph_search_recall_and_widening():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 32))
    values = np.concatenate([base[rng.integers(0, 60, 3000)] + rng.normal(scale=0.25, size=(3000, 32)), base[0] + rng.normal(scale=0.05, size=(400, 32))])
    ids = np.arange(len(values))
    order = np.lexsort((ids, -hnsw.levels_of(ids)))
    unit = hnsw.unit(values[order]).astype(np.float32)
    graph = hnsw.build(unit, hnsw.levels_of(ids[order]))
    assert len(graph.layers) > 1 and all(layer.shape[1] <= 2 * hnsw.DEGREE for layer in graph.layers)
    truth = unit @ unit.T >= 0.9
    q, x = hnsw.all_within(graph, unit, 0.9, hnsw.BEAM)
    found = np.zeros_like(truth)
    found[q, x] = True
    assert not (found & ~truth).any()
    assert (found & truth).sum() >= 0.99 * truth.sum() and truth.sum(axis=1).max() > 10 * hnsw.BEAM


# --- n-gram model -------------------------------------------------------------------------------------------------


def test_model_matches_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    draw = lambda n: " ".join(f"W{int(rng.paretovariate(0.7)) % 200}" for _ in range(n))
    train = [draw(rng.randrange(0, 60)) for _ in range(150)] + [None, "", "the " * 600]
    texts = [*train[:20], *[draw(30) for _ in range(10)], None, "unseen words only here", "the the w1"]
    want, n, vocabulary, prob, known = brute.kneser(train, texts)
    monkeypatch.setattr(kneser, "CHUNK_TOKENS", 500)
    model = kneser.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(4))
    assert (model.tokens, model.vocabulary) == (n, vocabulary)
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    out = kneser.score(spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(2), model).orderBy("doc_id").collect()
    for r, (tokens_, seen, base, score) in zip(out, want):
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens_, seen, n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)
    for context in (None, "the", known[3]):
        assert math.isclose(sum(prob(context, w) for w in known) + prob(context, "new word"), 1, rel_tol=1e-9)


def test_model_edges(spark):
    model = kneser.train(spark.createDataFrame([], "text string"))
    (row,) = kneser.score(spark.createDataFrame([("a b",)], "text string"), model).collect()
    assert (row["n_tokens"], row["n_known"], row["base_score"], row["score"]) == (3, 0, 0.0, 0.0)
    assert kneser.score(spark.createDataFrame([], "text string"), model).collect() == []
    values = np.array([0, 1, 254, 255, 70_000, 2**40])
    assert kneser.unpack_small(memoryview(kneser.pack_small(values)), 0)[0].tolist() == values.tolist()
    keys = np.array([0, 1, 2**48 - 1], np.uint64)
    assert kneser.unpack_words(memoryview(kneser.pack_words(keys)), 0)[0].tolist() == keys.tolist()
    with pytest.raises(ValueError):
        kneser.mounted("hdfs://host/folder")


# --- queries and pipeline -----------------------------------------------------------------------------------------

tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    from tests.oracle import compare, connect

    assert compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLES[name]) is None


@tables
def test_queries_without_sql(spark):
    docs = queries.table(spark, FOLDER, "documents").collect()
    texts = {r["doc_id"]: r["text"] for r in docs}
    found = queries.op1_language_id(spark, FOLDER).collect()
    langs = {r["doc_id"]: r["lang"] for r in docs}
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in texts if brute.remainder(d, 4) == 2}
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) >= 0.9
    prints, groups = brute.simhash_components(texts)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, FOLDER).collect()}
    assert got == {d: (f"{prints[d]:016x}", groups[d]) for d in texts}
    model, *_ = brute.kneser([t for d, t in texts.items() if brute.remainder(d, 7) != 2], texts.values())
    got = {r["doc_id"]: r for r in queries.op5_kneser_ney(spark, FOLDER).collect()}
    for d, (n, seen, base, score) in zip(texts, model):
        assert (got[d]["n_tokens"], got[d]["n_known"]) == (n, seen)
        assert math.isclose(got[d]["base_score"], base, rel_tol=1e-9) and math.isclose(got[d]["score"], score, rel_tol=1e-9)
    check_packing(queries.op7_best_fit_packing(spark, FOLDER).collect(), list(texts.items()), packing.CAPACITY)
    start = 0
    for r in sorted(queries.op8_rans_tokens(spark, FOLDER).collect(), key=lambda r: r["doc_id"]):
        ids = ids_of(texts[r["doc_id"]])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    pages = {r["page_id"]: r["text"] for r in queries.op6_tag_paths(spark, FOLDER).collect()}
    assert all(pages.values()) and len(pages) == queries.table(spark, FOLDER, "pages").count()


@tables
def test_vectors_of_the_table(spark):
    rows = queries.table(spark, FOLDER, "embeddings").collect()
    values = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in rows}
    unit = {i: v / np.sqrt(v @ v) for i, v in values.items()}
    groups = brute.groups(unit, lambda a, b: unit[a] @ unit[b] >= 0.9)
    got = {r["vec_id"]: r["component_id"] for r in queries.op4_vector_links(spark, FOLDER).collect()}
    assert got == groups


@tables
def test_pipeline_matches_brute_force(spark):
    rows = [r.asDict() for r in queries.table(spark, FOLDER, "documents").collect()]
    frequent = brute.frequent_lines([(r["doc_id"], r["source"], r["text"]) for r in rows])
    kept = []
    for r in rows:
        ok, text = brute.clean(r["text"], frequent.get(r["source"]))
        if ok:
            kept.append({**r, "text": text})
    stage = corpus_pipeline.quality_rules(spark, queries.table(spark, FOLDER, "documents"), FOLDER)
    assert {r["doc_id"]: r["text"] for r in stage.collect()} == {r["doc_id"]: r["text"] for r in kept}
    net = language.fit(stage)
    labels, scores = language.predict_texts(language.Applier(net), [r["text"] for r in kept])
    kept = [r for r, label, score in zip(kept, labels, scores) if label != language.UNKNOWN]
    assert len(kept) > 0.5 * len(rows)
    _, groups = brute.simhash_components({r["doc_id"]: r["text"] for r in kept})
    kept = [r for r in kept if groups[r["doc_id"]] == r["doc_id"]]
    mixed = brute.mix([(r["doc_id"], r["source"], r["text"]) for r in kept])
    texts = {r["doc_id"]: r["text"] for r in kept}
    final = [(d, texts[d]) for d, *_, copies in mixed for _ in range(copies)]
    check_packing(corpus_pipeline.run(spark, FOLDER).collect(), final, packing.CAPACITY)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "language ID", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing",
    ]
