"""Medians by radix selection against sorting, and the bound on resampling noise."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from winnow.operators import aggregates as A
from winnow.operators import numbering as R

EXTREMES = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 * (1 - 2.0**-52), 1.0, 1.0 + 2.0**-52, 1.0 - 2.0**-53, 2.0, 3.0, 1e300, -1e300]
EXTREMES += [1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 0.1, -0.1, 1e-300, 2.0**52, 2.0**53 - 1, 8.0, 7.999999999999999]


def bits(x):
    n = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -n if x < 0 else n


def test_ordered_bits_are_those_of_the_double(spark):
    rng = random.Random(1)
    values = EXTREMES + [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)] + [2.0**k for k in range(-1074, 1024, 7)]
    values = [v for v in values if not math.isnan(v)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = {(r["v"], r["k"]) for r in R.ordered_bits(df, "v", "k").collect()}
    assert got == {(v, bits(v)) for v in values} | {(None, None)}


def middle(values):
    values = sorted(values)
    n = len(values)
    return (values[(n - 1) // 2] + values[n // 2]) / 2 if n else None


@pytest.mark.parametrize("seed", range(3))
def test_medians_of_odd_distributions(spark, seed):
    rng = random.Random(seed)
    finite = [x for x in EXTREMES if abs(x) < 1e308]
    makers = {
        "wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300), "ties": lambda: rng.choice([1.5, 2.5]), "close": lambda: 1.0 + rng.randrange(50) * 2.0**-52,
        "extreme": lambda: rng.choice(finite), "plain": rng.random, "outlier": lambda: 1e300 if rng.random() < 0.01 else rng.gauss(0, 1e-9), None: lambda: rng.choice([None, 7.0, float("nan")]),
    }
    rows = [(g, make()) for g, make in makers.items() for _ in range(rng.choice([1, 2, 501, 1000]))] + [("empty", None), ("both", float("inf")), ("both", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = {g: middle([v for k, v in rows if k == g and v is not None and not math.isnan(v)]) for g in {g for g, _ in rows}}
    got = R.medians(df, ["g"], "v", also=[F.count(F.lit(1)).alias("n")])
    assert got.columns == ["g", "median", "n"]
    assert {r["g"]: r["median"] for r in got.collect()} == want
    assert {r["g"]: r["n"] for r in got.collect()} == {g: sum(k == g for k, _ in rows) for g in want}
    (total,) = R.medians(df, [], "v").collect()
    assert total["median"] == middle([v for _, v in rows if v is not None and not math.isnan(v)])


def test_medians_without_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert R.medians(df, ["g"], "v").count() == 0 and R.medians(df, [], "v").count() == 0  # no rows, no groups


def test_few_bins_need_more_passes_and_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(rng.random(),) for _ in range(999)]
    monkeypatch.setattr(R, "BIN_BITS", 3)
    assert R.medians(spark.createDataFrame(rows, "v double"), [], "v").first()["median"] == middle([v for (v,) in rows])


def brute_presence(spark, rows, iterations, sigma, top):
    noise = A.noisy_scores(spark.createDataFrame(rows, "id string, score double, stratum string"), "id", "score", iterations, sigma, 7).collect()
    hits = {}
    for k in range(1, iterations + 1):
        ranked = sorted((r for r in noise if r["iteration"] == k), key=lambda r: (r["noisy_score"] is None, -(r["noisy_score"] or 0), r["id"]))
        for s in {r["stratum"] for r in ranked[:top]}:
            hits[s] = hits.get(s, 0) + 1
    return {s: hits.get(s, 0) / iterations for s in {r[2] for r in rows}}


@pytest.mark.parametrize("sigma, top", [(0.02, 5), (0.3, 3), (0.0, 4), (0.02, 500)])
def test_rows_out_of_reach_change_no_presence(spark, sigma, top):
    rng = random.Random(11)
    rows = [(f"d{k}", rng.choice([None, rng.random(), 0.9, 0.9 - rng.random() * 0.2]), rng.choice("ABCD")) for k in range(120)]
    df = spark.createDataFrame(rows, "id string, score double, stratum string")
    got = A.top_presence(df, "id", "score", "stratum", iterations=20, sigma=sigma, seed=7, top=top)
    assert {r["stratum"]: r["top_probability"] for r in got.collect()} == brute_presence(spark, rows, 20, sigma, top)


def test_noise_stays_within_its_bound(spark):
    extreme = math.sqrt(-2 * math.log(0.5 / 2**48))
    assert extreme <= A.NOISE_BOUND * (1 + 1e-12)
    found = spark.range(20000).select(A.hash_normal(F.col("id").cast("string")).alias("x")).agg(F.max(F.abs("x"))).first()[0]
    assert 3 < found <= A.NOISE_BOUND
