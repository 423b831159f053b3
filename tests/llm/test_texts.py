"""Quality rules, SimHash, mixing and language identification on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from winnow.llm import language, lines, mixing, simhash
from winnow.llm.shared import components, split_by_keys, stars

DOCS = "doc_id long, text string, source string, lang string"


def prose(rng, n, vocabulary=300):
    return " ".join("w" + "abcdefghij"[k % 10] + "klmnopqrst"[k // 10 % 10] + "x" * (k // 100) for k in (rng.randrange(vocabulary) for _ in range(n)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [None, "", " \n\t ", "one", "Two Words", "a b c d e", "a b c d e f", "#*$ %&| <> x", "ÄÖ é　x 日本", "same line\nsame line\n\nsame line"]
    out += ["\n".join(prose(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    block = prose(rng, 12)
    out += [f"{block}\n{prose(rng, 30)}\n{block}", f"{block} {block} {block}", prose(rng, 30_000), "x " * 500, "1 2 3 4 5 1 2 3 4 5 6 7 8 9 10 11"]
    out += [out[15]] * 3
    return out


def documents(spark, texts, hosts=3):
    rows = [(i, t, None if i % 7 == 3 else f"src{i % hosts}", "en") for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, DOCS)


# --- quality rules ------------------------------------------------------------------------------------------------


def test_base_rules_match_brute_force(spark, texts):
    rows, docs = documents(spark, texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in lines.base_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {i: brute.base_rules(t) for i, t, _, _ in rows}


def repetitive_rows():
    """Hosts with notices in few and in many documents, documents of little else, exact and near copies, null ids and hosts."""
    rng = random.Random(5)
    notice, banner = "All rights reserved 2019", "all RIGHTS  reserved 7"
    rows = []
    for i in range(60):
        body = "\n".join(prose(rng, 15) for _ in range(3))
        rows.append((i, f"{body}\n{notice if i % 2 else banner}\n{notice}" if i % 3 else body, "a" if i < 50 else None))
    long_notice = " ".join([notice] * 4)
    rows += [(100 + i, f"{prose(rng, 3)}\n{long_notice} {i}", "a") for i in range(30)]  # little besides the line
    rows += [(200 + i, rows[0][1], "a") for i in range(40)]  # copies of one text
    near = "\n".join(prose(rng, 15) for _ in range(4))
    rows += [(300 + i, f"{near}\n{prose(rng, 4)}", "b") for i in range(21)] + [(400 + i, f"{prose(rng, 12)}\n{notice}", "c") for i in range(20)]
    rows += [(500, f"{prose(rng, 40)}\n{notice}", "b")]
    return rows


def test_frequent_lines_are_removed_and_depleted_documents_rejected(spark):
    rows = repetitive_rows()
    rng = random.Random(8)
    rows += [(None, f"{prose(rng, 20)}\n{notice}", "c") for notice in ("All rights reserved 1", "ALL rights reserved 22")] + [(400, rows[-2][1], "c")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    frequent = brute.frequent_lines([(d, h, t) for d, t, h in rows])
    assert set(frequent) >= {"a", "b", "c"} and None not in frequent
    want = sorted((i, t, brute.clean(t, frequent.get(h))[0]) for i, t, h in rows if i is not None)
    assert sorted((r["doc_id"], r["text"], r["kept"]) for r in lines.quality(docs).collect() if r["doc_id"] is not None) == want
    kept = {i: k for i, _, k in want}
    assert not any(kept[100 + i] for i in range(30)) and all(kept[200 + i] for i in range(40)) and sum(kept[300 + i] for i in range(21)) == 1
    cleaned = sorted((str(r["doc_id"]), r["text"]) for r in lines.clean(docs).collect())
    assert cleaned == sorted((str(i), brute.clean(t, frequent.get(h))[1]) for i, t, h in rows if brute.clean(t, frequent.get(h))[0])


def test_frequent_lines_match_the_sql(spark, tmp_path):
    """The given small tables have no frequent line, so the SQL is compared on a table that has."""
    import duckdb

    from tests.oracle import compare
    from winnow.llm import queries

    docs = spark.createDataFrame(repetitive_rows(), "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op3_line_frequency(spark, str(tmp_path))
    assert got.filter("NOT kept AND NOT base_failed").count() >= 20
    assert compare(got, con, queries.ORACLES["op3_line_frequency"]) is None


def test_lines_repeated_in_a_large_host_are_removed_but_for_one_copy(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(prose(rng, 15) for _ in range(3)), "a") for i in range(400)]
    notice = "All rights reserved 2019"
    rows[:30] = [(i, f"{t}\n{notice}", h) for i, t, h in rows[:30]]  # 30 of 502, under a tenth of the host
    page = "\n".join(prose(rng, 15) for _ in range(4))
    rows += [(500 + i, page, "a") for i in range(40)]  # exact copies are for the dedup stage
    near = "\n".join(prose(rng, 15) for _ in range(4))
    rows += [(600 + i, f"{near}\nnumber {chr(97 + i % 26)}{chr(97 + i // 26)}", "a") for i in range(60)]  # of near copies one stays
    rows += [(700 + i, f"{prose(rng, 30)}\n{notice}", "b") for i in range(20)] + [(None, page.split("\n")[0] + f"\n{prose(rng, 20)}", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {}
    for r in lines.clean(docs).collect():
        got.setdefault(r["doc_id"], r["text"])
    assert sum(notice in got[i] for i in range(30)) == 1 and all(got[i] == rows[i][1] for i in range(30, 400))
    assert all(got[i].split("\n")[:3] == rows[i][1].split("\n")[:3] for i in range(30))
    # the copies keep their lines, the text without an id that shares one does not
    assert all(got[500 + i] == page for i in range(40)) and page.split("\n")[0] not in got[None]
    assert [got[600 + i] for i in range(60) if 600 + i in got] == [x for i, x, _ in rows if x.startswith(near) and i in got] and sum(600 + i in got for i in range(60)) == 1
    assert all(got[700 + i].endswith(notice) for i in range(20))  # not more than the limit


def test_texts_that_lose_no_line_do_not_meet_the_dropped_lines(spark, monkeypatch):
    rows = repetitive_rows()
    rng = random.Random(9)
    rows += [(1000 + i, f"{prose(rng, 30)}\n{prose(rng, 30)}", "plain") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    moved, marked = [], lines._marked
    monkeypatch.setattr(lines, "_marked", lambda docs, *rest: moved.extend(r["doc_id"] for r in docs.collect()) or marked(docs, *rest))
    got = sorted((r["doc_id"], r["text"]) for r in lines.clean(docs).collect())
    frequent = brute.frequent_lines([(d, h, t) for d, t, h in rows])
    want = [(d, brute.clean(t, frequent.get(h))) for d, t, h in rows]
    assert got == sorted((d, text) for d, (ok, text) in want if ok)
    loses = {d for (d, (_, text)), (_, t, _) in zip(want, rows) if text != t}
    assert loses <= set(moved) and len(moved) < len(rows) - 290


def test_quality_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert lines.quality(empty).collect() == []
    odd = spark.createDataFrame([(None, None, None, 1, "x"), (1, "a", None, 2, "y"), (1, "a", None, 2, "y")], "doc_id long, text string, source string, n_words int, kept string")
    out = lines.quality(odd).orderBy("n_words").collect()
    assert [(r["n_words"], r["kept"]) for r in out] == [(0, False), (1, False), (1, False)]
    assert lines.clean(odd).count() == 0


# --- SimHash ------------------------------------------------------------------------------------------------------


def test_simhash_matches_brute_force(spark, texts):
    rng = random.Random(7)
    long = prose(rng, 400, 3000).split()
    for k in range(40):  # near copies at several distances
        copy = list(long)
        for _ in range(k % 6):
            copy[rng.randrange(len(copy))] = f"new{k}"
        texts = [*texts, " ".join(copy).upper() if k % 2 else " ".join(copy)]
    rows, docs = documents(spark, texts)
    prints, groups = brute.simhash_components({i: t for i, t, _, _ in rows})
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in prints}
    assert len(set(groups.values())) < len(groups) - 20
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups.values()))


def test_texts_of_ids_that_are_kept_once_are_not_dealt_out(spark, monkeypatch):
    rng = random.Random(10)
    rows = [(i, prose(rng, 60, 3000), f"row {i}") for i in range(300)]
    rows += [(300 + i, rows[i][1], "copy") for i in range(20)] + [(i, rows[i][1], "again") for i in range(50, 60)]
    rows += [(50, prose(rng, 60, 3000), "other text"), (None, rows[70][1], "no id"), (None, prose(rng, 60, 3000), "alone, no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string")
    dealt, once = [], type(docs).dropDuplicates
    monkeypatch.setattr(type(docs), "dropDuplicates", lambda self, *a: dealt.extend(r["doc_id"] for r in self.select("doc_id").collect()) or once(self, *a))
    kept = simhash.keep_one(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(300))
    assert all(r["note"] == f"row {r['doc_id']}" for r in kept if not 50 <= r["doc_id"] < 60)
    assert set(range(50, 60)) <= set(dealt) and len(dealt) < 40


def test_pigeonring_keeps_every_link_and_prunes():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400, np.uint64)
    flips = [np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, k, False).astype(np.uint64)) for k in rng.integers(1, 4, 4000)]
    x = np.array(flips, np.uint64)
    assert simhash.chain_ok(x).all()
    assert simhash.chain_ok(a[:, None] ^ a[None, :]).sum() < 450 + 400
    # a pair that shares a segment but breaks the second budget
    assert not simhash.chain_ok(np.array([0x0000_0007_0007_0007], np.uint64)).any()


def test_ring_keys_find_every_link(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = sorted({b ^ sum(1 << p for p in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 3)})
    rows = [(v - 2**64 if v >= 2**63 else v, i) for i, v in enumerate(values)]
    links = simhash.fingerprint_links(spark.createDataFrame(rows, "fp long, rep long"))
    got = {r["node"]: r["component"] for r in components(links).collect()}
    want = brute.groups(range(len(values)), lambda p, q: (values[p] ^ values[q]).bit_count() <= 3)
    assert {n: got.get(n, n) for n in want} == want


def test_crowded_ring_key_is_dealt_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    values = [(0xABCD << 48) | (k << 3) for k in range(64)]
    rows = [(v - 2**64 if v >= 2**63 else v, 1000 - i) for i, v in enumerate(values)]
    links = simhash.fingerprint_links(spark.createDataFrame(rows, "fp long, rep long"))
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert set(got.values()) == {1000 - 63} and len(got) == 64


def test_simhash_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b c d", 1), (5, "a b c d", 2), (5, "a b c d", 2), (7, None, 3), (3, "", 4)], "doc_id long, text string, component_id int")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(odd).collect())
    assert got == [(-1, 5), (3, 3), (5, 5), (5, 5), (7, 3)]
    assert sorted(r["doc_id"] for r in simhash.keep_one(odd).collect()) == [3, 5]


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 180)]
    rng = random.Random(1)
    hub = [(500, k) for k in range(501, 800)] + [(5, 799)]
    edges = chain + hub + [(9, 9), (None, 3), (700, 500)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[n] == 100 for n in range(100, 181)) and all(got[n] == 5 for n in range(500, 800))
    assert got[9] == 9


@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_split_by_keys_misses_no_key(spark, bits):
    rng = random.Random(4)
    values = [rng.getrandbits(64) - 2**63 for _ in range(4000)] + [0, -1, 1, 32767, 32768, 32769, 2**63 - 1, -(2**63), None]
    keys = values[:300] + values[4000:]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "k long, at long")
    inside, outside = split_by_keys(df, F.col("k"), spark.createDataFrame([(k,) for k in keys], "key long"), max_bits=bits)
    found, rest = ([tuple(r) for r in x.collect()] for x in (inside, outside))
    assert inside.columns == df.columns and sorted(r[1] for r in found + rest) == list(range(len(values)))
    assert {k for k in keys if k is not None} <= {k for k, _ in found} and (None, len(values) - 1) in rest
    assert bits == 64 or len(found) < 308 + 200
    inside, outside = split_by_keys(df, F.col("k"), spark.createDataFrame([], "key long"), max_bits=bits)
    assert inside.isEmpty() and outside.count() == len(values)


def test_split_by_keys_computes_each_row_on_one_side(spark):
    df = spark.createDataFrame([(k, "7" if k < 5 else "letters") for k in range(20)], "k long, t string")
    inside, outside = split_by_keys(df, F.col("k"), spark.range(5), late="t")
    assert sorted(r["k"] for r in inside.filter(F.col("t").cast("int") == 7).collect()) == list(range(5))  # a cast of letters fails
    assert outside.filter("t = 'letters'").count() == 15


def test_stars():
    assert stars(np.array([1, 2, 5]), np.array([0, 1, 4]), 7).tolist() == [0, 0, 0, 3, 4, 4, 6]
    assert stars(np.zeros(0, int), np.zeros(0, int), 0).tolist() == []


# --- mixing -------------------------------------------------------------------------------------------------------


def check_mix(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = mixing.mix(docs)
    got = sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["copies"]) for r in mixed.collect()), key=str)
    want = sorted(brute.mix(rows), key=str)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(math.isclose(g[3], w[3], rel_tol=1e-12) for g, w in zip(got, want))
    assert sorted(mixed.collect(), key=str) == sorted(mixing.mix(docs).collect(), key=str)
    return mixed


def test_mixing_matches_rounds_of_water_filling(spark):
    rng = random.Random(4)
    names = ["b", "a", "Z", "é", None, "tiny", "huge"]
    counts = [30, 50, 20, 5, 10, 1, 200]
    rows, n = [], 0
    for name, count in zip(names, counts):
        for _ in range(count):
            rows.append((n, name, prose(rng, rng.randrange(0, 60))))
            n += 1
    mixed = check_mix(spark, rows)
    by = {}
    for r in mixed.collect():
        by.setdefault(r["source"], [0, r["target"], r["source_size"], 0])
        by[r["source"]][0] += r["taken"]
        by[r["source"]][3] = max(by[r["source"]][3], r["size"])
        assert r["taken"] <= 3 * r["size"]
    assert any(t == 3 * s for _, t, s, _ in by.values()) and any(t < s for _, t, s, _ in by.values())
    assert all(abs(taken - target) <= biggest / 2 + 1e-9 for taken, target, _, biggest in by.values())
    repeated = mixing.repeat_rows(mixed, ["doc_id"]).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in repeated} == {r["doc_id"]: r["copies"] for r in mixed.collect() if r["copies"]}


def test_mixing_edge_tables(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []
    check_mix(spark, [(1, "a", None), (2, None, "")])
    check_mix(spark, [(1, "a", "x y z")])
    odd = spark.createDataFrame([(1, "a", "x y", 9), (1, "a", "x y", 9), (None, "a", "z", 9)], "doc_id long, source string, text string, size int")
    out = mixing.mix(odd)
    assert out.columns.count("size") == 1 and {(r["size"], r["source_size"], r["taken"]) for r in out.collect()} == {(2, 5, 2), (1, 5, 1)}


# --- language -----------------------------------------------------------------------------------------------------

LANGUAGES = {"aa": "the of and in to is was for".split(), "bb": "der die und ein zu ist war für".split(), "cc": "το και της είναι από".split()}


def sample(rng, lang, n):
    return " ".join(rng.choice(LANGUAGES[lang]) + str(rng.randrange(10)) for _ in range(n))


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = language.new_network(["a", "b", "c"], rng)
    x, y = rng.integers(0, 256, (6, 24)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    for p in net.parameters():
        p[...] = p.astype(np.float64)

    def loss():
        p = language._softmax(language.Applier(net).responses(x).astype(np.float64) @ net.out + net.out_bias)
        return -np.log(p[np.arange(6), y]).mean()

    grads = language._gradients(net, x, y)
    for p, g in zip(net.parameters(), grads):
        flat = np.flatnonzero(np.abs(g).ravel() > 1e-3)[:3]
        for k in flat:
            old, step = p.ravel()[k], 1e-2
            p.ravel()[k] = old + step
            up = loss()
            p.ravel()[k] = old - step
            down = loss()
            p.ravel()[k] = old
            assert abs((up - down) / (2 * step) - g.ravel()[k]) < 0.05 * abs(g.ravel()[k]) + 2e-3


def test_language_learns_and_answers_whole_texts(spark):
    rng = random.Random(1)
    rows = [(i, sample(rng, lang, 20 + i % 200), lang) for i, lang in enumerate(rng.choice(list(LANGUAGES)) for _ in range(240))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = language.remainder("doc_id", 4) == 2
    net = language.fit(docs.filter(~held))
    tests = docs.filter(held)
    found = language.identify(tests, net).collect()
    assert len(found) > 30 and np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)
    # the end of a text counts as much as its start
    late = sample(rng, "bb", 20) + " " + sample(rng, "cc", 4000)
    assert language.predict_texts(language.Applier(net), [late])[0] == ["cc"]


def test_language_edges(spark):
    odd = [(1, None, "x"), (2, "", None), (3, "123 !?", "y"), (4, "abc", None), (4, "abc", None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang_pred string")
    none = language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert none is None
    assert {(r["lang_pred"], r["score"]) for r in language.identify(docs, none).collect()} == {("und", 0.0)}
    one = language.fit(spark.createDataFrame([(1, "abc def", "aa"), (2, "x", None), (None, "abd", "aa")], "doc_id long, text string, lang string"))
    out = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(docs, one).collect())
    assert out == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "aa", 1.0), (4, "aa", 1.0)]
