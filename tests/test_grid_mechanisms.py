"""Blocks with halos, salted cells, exact moments and the log-gamma series, against plain NumPy and math."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolite.functions import pvalues as pv
from tremolite.operators import cells as ce, nodes as nd


@pytest.mark.parametrize("block", [1, 2, 3, 8])
def test_gradient_of_a_full_grid(spark, block):
    rng = np.random.default_rng(block)
    shape = (7, 5, 4)
    v = rng.normal(size=shape)
    rows = [("a", i, j, k, float(v[i, j, k])) for i in range(7) for j in range(5) for k in range(4)]
    rows += [("b", i, j, k, float(2 * v[i, j, k])) for i in range(7) for j in range(5) for k in range(4)]
    df = spark.createDataFrame(rows, "g string, i int, j int, k int, t double")
    out = ce.gradient(df, ["g"], "t", block)
    assert out.columns == ["g", "i", "j", "k", "t", "gi", "gj", "gk"]
    want = np.gradient(v)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        for axis, c in enumerate(("gi", "gj", "gk")):
            assert r[c] == pytest.approx((1 if r["g"] == "a" else 2) * want[axis][r["i"], r["j"], r["k"]])


def test_gradient_shuffles_once_and_stops_at_holes(spark):
    df = spark.createDataFrame([(i, 0, 0, float(i * i)) for i in (0, 1, 2, 4, 5, 9)], "i int, j int, k int, t double")
    got = {r["i"]: r["gi"] for r in ce.gradient(df, [], "t", 4).collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 3.0, 4: 9.0, 5: 9.0, 9: None}
    named = df.withColumn("s", F.col("k") + F.col("j"))
    plan = ce.gradient(named, ["s"], "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1, plan


AXES = {"lon": [150.0, 155.0, 161.0, 170.0], "lat": [50.0, 52.0, 57.0], "depth": [0.0, 10.0, 100.0]}


def test_salted_cells_give_the_same_values_and_spread_a_crowded_cell(spark):
    r = random.Random(1)
    nodes = [(i, j, k, r.uniform(2, 8)) for i in range(4) for j in range(3) for k in range(3)]
    cells = spark.createDataFrame(nodes, "i int, j int, k int, v double")
    spots = [(n, 156.0 + r.random(), 53.0 + r.random(), 20.0 + r.random()) for n in range(4000)] + [(4000 + n, r.uniform(145, 175), r.uniform(48, 60), r.uniform(0, 150)) for n in range(300)]
    points = spark.createDataFrame(spots + [(9999, None, 53.0, 1.0)], "n int, lon double, lat double, depth double")
    plain = {x["n"]: x["out"] for x in ce.interpolate_points(points, cells, AXES, "v", "out").collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        salted = ce.interpolate_points(points, cells, AXES, "v", "out", sent=0)
        sizes = [x["count"] for x in salted.groupBy(F.spark_partition_id()).count().collect()]
        got = {x["n"]: x["out"] for x in salted.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got.keys() == plain.keys() and all(got[n] == pytest.approx(plain[n]) if plain[n] is not None else got[n] is None for n in plain)
    assert len(sizes) == 4 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_small_spread_on_a_long_time_keeps_its_slope(spark):
    """Times near 300 s that differ by microseconds: the slope is exact to 1e-6, in whatever order the sums are merged."""
    r = random.Random(3)
    x = [r.randrange(10) for _ in range(500)]
    pairs = [(300_000_000 + a, 519_000_000 + 2 * a + r.randrange(2)) for a in x]
    df = spark.createDataFrame([(n % 7, a / 1e6, b / 1e6) for n, (a, b) in enumerate(pairs)], "part int, delta_t_p double, delta_t_s double")
    merged = df.groupBy("part").agg(*nd.moments()).groupBy().agg(*nd.merge_moments())
    fit = nd.node_regression(nd.node_stats(merged)).first()
    p, s = np.array([a for a, _ in pairs], dtype=float) - 300e6, np.array([b for _, b in pairs], dtype=float) - 519e6
    slope = ((p - p.mean()) * (s - s.mean())).sum() / ((p - p.mean()) ** 2).sum()
    assert fit["slope"] == pytest.approx(slope, abs=1e-9)
    assert fit["p_std"] == pytest.approx(p.std() / 1e6, rel=1e-12) and fit["s_std"] == pytest.approx(s.std() / 1e6, rel=1e-12)
    assert fit["r_squared"] == pytest.approx(np.corrcoef(p, s)[0, 1] ** 2, abs=1e-9)


def test_log_gamma():
    x = np.concatenate([np.linspace(0.5, 30, 400), np.geomspace(31, 1e7, 200)])
    want = np.array([math.lgamma(v) for v in x])
    assert np.allclose(pv._log_gamma(x), want, rtol=1e-13, atol=1e-12)
    assert pv._log_gamma(np.zeros(0)).shape == (0,)
