"""Selection by bisected counts and search through the pyramid of times, against plain sorting and full search."""

import random

import numpy as np
import pytest

from tremolite.operators import location as lo, pyramid as py, selection as se


@pytest.mark.parametrize("few,bins,q", [(1, 5, 0.5), (3, 16, 0.1), (50, 4, 0.73), (4096, 512, 1.0)])
def test_quantiles_of_all_kinds_of_keys(spark, few, bins, q):
    r = random.Random(4)
    values = {
        "even": [float(i) for i in range(60)], "one": [3.5], "same": [2.0] * 40, "skewed": [10.0 ** r.uniform(-12, 12) for _ in range(70)],
        "ties": [float(r.randrange(4)) for _ in range(65)], None: [-1.0, 5.0, 5.0], "two": [1.0, 1.0 + 2.0**-52],
    }
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("even", None), ("none", None)]
    r.shuffle(rows)
    got = {x["g"]: x["m"] for x in se.quantile(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", q, "m", few, bins).collect()}
    assert got.keys() == values.keys()
    for k, vs in values.items():
        assert got[k] == pytest.approx(float(np.quantile(vs, q)), rel=1e-14)


def test_one_key_with_most_rows_needs_no_sort_of_them(spark):
    rows = spark.range(200_000).selectExpr("if(id % 10 = 0, id % 7, -1) as g", "cast((id * 7919) % 200003 as double) as v")
    got = {x["g"]: x["m"] for x in se.quantile(rows, ["g"], "v", 0.5, "m", 100, 16).collect()}
    table = rows.toPandas()
    for g, part in table.groupby("g"):
        assert got[g] == pytest.approx(float(np.quantile(part["v"], 0.5)), rel=1e-14)


def setting(spark, shape, stations, quakes, seed, rough=0.0, missing=0.0):
    """A field of distances (with `rough` noise) and quakes near cells of it; some times and observations are missing."""
    rng = np.random.default_rng(seed)
    at = rng.uniform(0, max(shape), (stations, 3))
    cells = [(i, j, k) for i in range(shape[0]) for j in range(shape[1]) for k in range(shape[2])]
    t = {(s, c): float(np.linalg.norm(at[s] - np.array(c)) + rough * rng.normal()) for s in range(stations) for c in cells}
    observed = [
        (e, s, t[s, c] + float(rng.normal(0, 0.05)) + e) for e in range(quakes) for c in [cells[rng.integers(len(cells))]] for s in range(stations) if rng.random() > missing or s < 2
    ]
    field = [(s, *c, None if rng.random() < missing / 10 else v) for (s, c), v in t.items()]
    f = spark.createDataFrame(field, "station_id int, i int, j int, k int, t double")
    o = spark.createDataFrame(observed + [(1000, 0, 1.0), (1001, 0, None), (1001, 1, 2.0)], "event_id int, station_id int, t_obs double")
    return o, f


@pytest.mark.parametrize("n", [1, 3])
@pytest.mark.parametrize("kind", [dict(), dict(rough=2.0), dict(missing=0.3), dict(rough=1.0, missing=0.2)])
def test_pyramid_gives_the_cells_of_a_full_search(spark, n, kind):
    o, f = setting(spark, (9, 7, 5), 6, 12, 3, **kind)
    want = {}
    for x in lo.pairwise_misfit(o, f).collect():
        want.setdefault(x["event_id"], []).append((round(x["misfit"], 9), x["i"], x["j"], x["k"]))
    got = {}
    for x in py.best_cells(o, f, n, decimals=9, edge=2).collect():
        got.setdefault(x["event_id"], []).append((x["misfit"], x["i"], x["j"], x["k"]))
    assert {e: sorted(v) for e, v in got.items()} == {e: sorted(v)[:n] for e, v in want.items()}


def test_bounds_hold_for_every_cell_of_a_block(spark):
    o, f = setting(spark, (8, 6, 4), 5, 4, 9, rough=0.5)
    cells = {}
    for x in lo.pairwise_misfit(o, f).collect():
        cells[x["event_id"], x["i"], x["j"], x["k"]] = x["misfit"]
    for size, blocks in py.opened_blocks(o, f, edge=2).items():
        for b in blocks.collect():
            inside = [m for (e, i, j, k), m in cells.items() if e == b["event_id"] and (i // size, j // size, k // size) == (b["b_i"], b["b_j"], b["b_k"])]
            assert inside and b["low"] <= min(inside) + 1e-9 and b["high"] >= max(inside) - 1e-9 and b["sure"] == len(inside)


def test_few_cells_are_opened_in_a_smooth_field(spark):
    o, f = setting(spark, (24, 24, 8), 8, 10, 1)
    opened = py.opened_blocks(o, f)
    looked = {size: blocks.count() for size, blocks in opened.items()}
    assert sum(looked.values()) < 10 * 24 * 24 * 8 / 6, looked


def test_all_ties_are_kept(spark):
    f = spark.createDataFrame([(s, i, j, 0, 1.0) for s in range(3) for i in range(5) for j in range(5)], "station_id int, i int, j int, k int, t double")
    o = spark.createDataFrame([(1, s, 2.0 + s) for s in range(3)], "event_id int, station_id int, t_obs double")
    got = [(x["i"], x["j"]) for x in py.best_cells(o, f, 6, edge=2).collect()]
    assert sorted(got) == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 0)]
    none = py.best_cells(o, f.where("false"))
    assert none.count() == 0 and py.best_cells(o.where("false"), f).count() == 0


def test_no_window_over_a_lattice_and_no_global_sort(spark):
    o, f = setting(spark, (4, 4, 4), 4, 3, 2)
    plan = lo.softmin_weights(lo.pairwise_misfit(o, f))._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "Window" not in plan
