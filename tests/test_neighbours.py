"""Nearest known vectors by pivots against all pairs."""

import math

import numpy as np
import pytest

from winnow.operators import neighbours as N

COLUMNS = "id long, v array<double>"


def brute(candidates, known, empty):
    def blank(v):
        return sum(v) == 0 if empty == "sum" else not any(v)

    usable = [v for v in known if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for key, v in candidates:
        if v is None:
            continue
        if any(x is None or not math.isfinite(x) for x in v) or not usable:
            out.setdefault(key, None)
            continue
        found = min(1.0 if blank(v) or blank(k) else 1.0 - float(np.dot(v, k) / np.linalg.norm(v) / np.linalg.norm(k)) for k in usable)
        out[key] = found if out.get(key) is None else min(found, out[key])
    return out


def vectors(rng, kind, n, dim=8):
    if kind == "spread":
        rows = rng.normal(size=(n, dim))
    elif kind == "clusters":
        rows = rng.normal(size=(6, dim))[rng.integers(0, 6, n)] + 0.01 * rng.normal(size=(n, dim))
    elif kind == "copies":
        rows = rng.normal(size=(4, dim))[np.minimum(rng.geometric(0.6, n), 4) - 1]
    else:  # scaled and opposite ones
        rows = rng.normal(size=(3, dim))[rng.integers(0, 3, n)] * rng.choice([-2.0, 1.0, 1e6, 1e-6], (n, 1))
    return rows.tolist()


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies", "scaled"])
@pytest.mark.parametrize("empty", ["sum", "norm"])
@pytest.mark.parametrize("pivots, rows", [(None, None), (7, 5), (1, 3)])
def test_nearest_known_matches_all_pairs(spark, kind, empty, pivots, rows):
    rng = np.random.default_rng(len(kind) + 2 * len(empty))
    known = vectors(rng, kind, 120) + ([[1.0, -1.0] + [0.0] * 6] if kind == "spread" else []) + [None]
    some = [(k, v) for k, v in enumerate(vectors(rng, kind, 150) + known[:20])]
    some += [(900, None), (901, [0.0] * 8), (902, [1.0, -1.0] + [0.0] * 6), (903, [float("nan")] + [1.0] * 7), (904, [None] + [1.0] * 7), (5, some[3][1])]
    odd = [[float("inf")] + [0.5] * 7, [None] + [0.5] * 7] if kind == "clusters" else []
    a = spark.createDataFrame([*some, some[0]], COLUMNS).repartition(5)
    b = spark.createDataFrame([(k, v) for k, v in enumerate(known + odd)], COLUMNS).repartition(3)
    got = {r["id"]: r["distance"] for r in N.nearest_known(a, b, "id", "v", empty, pivots, rows).collect()}
    want = brute([*some, some[0]], known, empty)
    assert set(want) - set(got) <= {k for k, d in want.items() if d is None}
    for key, distance in want.items():
        assert got.get(key) == (None if distance is None else pytest.approx(distance, abs=1e-9))


def test_shards_that_many_need_are_copied(spark):
    rng = np.random.default_rng(1)
    known, some = vectors(rng, "clusters", 60), vectors(rng, "clusters", 400)
    a = spark.createDataFrame(list(enumerate(some)), COLUMNS).repartition(4)
    got = {r["id"]: r["distance"] for r in N.nearest_known(a, spark.createDataFrame(list(enumerate(known)), COLUMNS), "id", "v", pivots=4, rows=2).collect()}
    want = brute(list(enumerate(some)), known, "sum")
    assert got == {k: pytest.approx(d, abs=1e-9) for k, d in want.items()}


def test_clustered_candidates_meet_few_shards():
    """What the triangle bounds are for: with clusters, most of the known vectors are ruled out before any product."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    known = unit(centres[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 32)))
    asked = unit(centres[rng.integers(0, 40, 500)] + 0.05 * rng.normal(size=(500, 32)))
    pivots = known[:128]
    angles = N._angles(known, pivots)
    at = angles.argmin(axis=1)
    own = angles[np.arange(4000), at]
    stats = [np.array([f(own[at == c]) if (at == c).any() else 0 for c in range(128)]) for f in (len, min, max)]
    cells = N.Cells.pack(pivots, *stats, 100)
    assert cells.n_shards >= 40 and sum(len(s) for s in cells.route(asked)[2]) < 0.25 * 500 * cells.n_shards


def test_no_known_vectors(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, None)], COLUMNS)
    for known, want in (([], None), ([(1, None)], None), ([(1, [0.0, 0.0])], 1.0), ([(1, [float("nan"), 1.0])], None)):
        got = N.nearest_known(a, spark.createDataFrame(known, COLUMNS), "id", "v").collect()
        assert {(r["id"], r["distance"]) for r in got} == {(1, want), (2, want)}
    assert N.nearest_known(a.limit(0), a, "id", "v").count() == 0


def test_shards_grow_with_the_known_set_before_they_become_many():
    """Small shards of a large set: a candidate is copied to a bounded number of shards, and copies are made in bounded lots."""
    pivots = np.eye(8)[:4]
    stats = (np.full(4, 50_000), np.zeros(4), np.full(4, 1.5))
    cells = N.Cells.pack(pivots, *stats, 16)
    assert cells.n_shards <= 2 * N.SHARDS and cells.rows == 200_000 // N.SHARDS
    assert max(len(s) for s in cells.route(pivots)[2]) <= cells.n_shards


def test_products_of_a_shard_are_taken_in_lots(monkeypatch):
    rng = np.random.default_rng(6)
    known, asked = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (rng.normal(size=(300, 8)), rng.normal(size=(50, 8))))
    angles = N._angles(known, known[:1])[:, 0]
    cells = N.Cells.pack(known[:1], np.array([300]), angles.min(keepdims=True), angles.max(keepdims=True), 400)
    shard = N.Shard(cells, np.zeros(300, np.int64), known)
    near = N._angles(asked, known[:1])[:, 0]
    expected = (1.0 - asked @ known.T).min(axis=1)
    monkeypatch.setattr(N, "PRODUCTS", 700)
    assert np.allclose(shard.nearest(asked, near, np.full(50, 4.0)), expected, atol=1e-12)


def test_mean_identity_moves_pieces_not_characters(spark, monkeypatch):
    """Texts of different lengths and alphabets across many pieces, against pairs; the shuffle has a row per piece."""
    texts = ["KREWY" * n + "é𝔸"[: n % 3] for n in range(1, 60)] + ["", "A", "é" * 130, "𝔸" * 130, "KREWY" * 30]
    share = lambda a, b: sum(x == y for x, y in zip(a, b)) / max(len(a), len(b), 1)
    pairs = [share(a, b) for i, a in enumerate(texts) for b in texts[:i]]
    found = N.mean_pairwise_identity(spark.createDataFrame([(t,) for t in texts], "s string"), "s")
    assert found.first().n_pairs == len(pairs) and found.first().mean_identity == pytest.approx(sum(pairs) / len(pairs))


def test_seen_counts_within_and_across_lots():
    seen = N.Seen()
    rows = [b"ab", "aé".encode("latin-1"), "a𝔸".encode("utf-32-le"), b"ab"]
    assert seen.add(rows[:2], np.array([1, 1])).tolist() == [0, 1]
    assert seen.add(rows[2:], np.array([4, 1])).tolist() == [2, 4]
