import math
import random

import pytest
from pyspark.sql import functions as F

from tremolite.functions import geodesy as geo, pvalues as pv, scalars as sc
from tremolite.operators import catalogue as cat, measures as ms, nodes as nd, predicates as pre, ranking as rk


def points(spark, n=200):
    rnd = random.Random(3)
    rows = [(rnd.uniform(-179, 179), rnd.uniform(-80, 80), rnd.uniform(-500, 20000)) for _ in range(n)]
    return spark.createDataFrame(rows, "lon double, lat double, h double")


def test_ecef_round_trip(spark):
    x, y, z = geo.geodetic_to_ecef("lat", "lon", "h")
    df = points(spark).withColumns({"x": x, "y": y, "z": z})
    lat, lon, h = geo.ecef_to_geodetic("x", "y", "z")
    off = df.select(F.max(F.abs(lat - F.col("lat"))), F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(h - F.col("h")))).first()
    assert off[0] < 1e-9 and off[1] < 1e-9 and off[2] < 1e-3


def test_enu_round_trip(spark):
    x, y, z = geo.enu_to_ecef(F.lit(1200.0), F.lit(-300.0), F.lit(45.0), "lat", "lon", "h")
    df = points(spark).withColumns({"x": x, "y": y, "z": z})
    e, n, u = geo.ecef_to_enu("x", "y", "z", "lat", "lon", "h")
    for row in df.select(e.alias("e"), n.alias("n"), u.alias("u")).collect():
        assert (row.e, row.n, row.u) == pytest.approx((1200.0, -300.0, 45.0), abs=1e-6)


def test_haversine_and_mercator(spark):
    row = spark.range(1).select(
        geo.haversine_km(0.0, 0.0, 0.0, 180.0), geo.haversine_km(45.7597, 4.8422, 48.8567, 2.3508), geo.web_mercator(180.0, 0.0)[0]
    ).first()
    assert row[0] == pytest.approx(math.pi * 6371.0088)
    assert row[1] == pytest.approx(392.2172595594006, rel=1e-9)
    assert row[2] == pytest.approx(20037508.342789244)


def test_utm_known_point_and_round_trip(spark):
    df = spark.createDataFrame([(-115.5352, 33.0466), (-117.0, 0.0), (-119.9, 60.0)], "lon double, lat double")
    out = geo.utm_forward(df, "lon", "lat", 11)
    rows = {round(r.lon, 4): r for r in out.collect()}
    assert rows[-117.0].easting == pytest.approx(500000.0, abs=1e-6) and rows[-117.0].northing == pytest.approx(0, abs=1e-6)
    back = geo.utm_inverse(out.withColumnsRenamed({"lon": "lon0", "lat": "lat0"}), "easting", "northing", 11)
    for r in back.collect():
        assert (r.lon, r.lat) == pytest.approx((r.lon0, r.lat0), abs=1e-10)


def test_p_values():
    # Published quantiles of Student's t: two-sided 5 % and 1 %.
    assert pv.two_sided_p([12.706204736432095, 2.2281388519649385, 2.5758293035489004], [1, 10, 1e9]) == pytest.approx([0.05, 0.05, 0.01], rel=1e-6)
    assert pv.two_sided_p([0.0], [5]) == pytest.approx([1.0])
    assert math.isnan(pv.two_sided_p([1.0], [0])[0])


def test_regression_against_direct_formulas(spark):
    rnd = random.Random(5)
    pairs = []
    for node in range(6):
        for _ in range([1, 2, 3, 40, 500, 5][node]):
            p = 7.0 if node == 5 else rnd.uniform(5, 50)
            pairs.append((node, p, 1.73 * p + rnd.gauss(0, 0.5)))
    df = spark.createDataFrame(pairs, "node int, delta_t_p double, delta_t_s double")
    fit = nd.regression_p_value(nd.node_regression(nd.node_stats(df.groupBy("node").agg(*nd.moments()))))
    got = {r.node: r for r in fit.collect()}
    assert got[0].error == "insufficient_data" and got[0].slope is None
    assert got[5].slope is None and got[5].p_std == 0
    assert got[1].stderr == 0 and got[1].p_value == 0 and got[1].r_squared == pytest.approx(1)
    for node in (2, 3, 4):
        xs, ys = zip(*[(p, s) for n, p, s in pairs if n == node])
        n, mx, my = len(xs), sum(xs) / len(xs), sum(ys) / len(ys)
        sxx, sxy = sum((x - mx) ** 2 for x in xs), sum((x - mx) * (y - my) for x, y in zip(xs, ys))
        syy = sum((y - my) ** 2 for y in ys)
        r = sxy / math.sqrt(sxx * syy)
        assert got[node].slope == pytest.approx(sxy / sxx, rel=1e-9)
        assert got[node].stderr == pytest.approx(math.sqrt((1 - r * r) * syy / sxx / (n - 2)), rel=1e-6)
        assert 0 <= got[node].p_value <= 1


GRID = nd.NodeGrid(50.0, 57.0, 156.0, 166.0, 15, 21, "1995-01-01", "2001-08-01", 49)


def haversine(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


def test_disks_match_brute_force_and_runs_reopen(spark):
    rnd = random.Random(11)
    pts = [(n, rnd.uniform(155, 167), rnd.uniform(49, 58)) for n in range(40)]
    df = spark.createDataFrame(pts, "id int, lon double, lat double")
    nodes = nd.nodes_in_radius(df, GRID, "lon", "lat", 130.0)
    got = {(r.id, r.ix, r.iy) for r in nodes.collect()}
    want = {
        (n, ix, iy) for n, lon, lat in pts for ix in range(15) for iy in range(21)
        if haversine(lat, lon, 50 + ix * 0.5, 156 + iy * 0.5) <= 130
    }
    assert got == want
    runs = nd.node_runs(nodes, ["id"]).collect()
    assert {(r.id, r.ix, y) for r in runs for y in range(r.iy_start, r.iy_end + 1)} == got


def test_time_window_is_empty_outside_the_grid(spark):
    df = spark.sql("select 1 as e, timestamp_ntz '1980-01-01 00:00:00' as t union all select 2, timestamp_ntz '1998-01-01 00:00:00' union all select 3, timestamp_ntz '2020-01-01 00:00:00'")
    assert {r.e for r in nd.time_nodes(df, GRID, "t", 150).collect()} == {2}


def test_grid_index_errors(spark):
    bad = spark.createDataFrame([(99, 0, 0)], "ix int, iy int, it int")
    with pytest.raises(Exception, match="outside the grid"):
        GRID.locate(bad).collect()
    with pytest.raises(ValueError):
        nd.NodeGrid(0, 1, 0, 1, 2, 2, "1995-01-01", "1996-01-01", 1)
    assert GRID.nodes(spark).count() == 15 * 21 * 49


def test_spread_matches_brute_force(spark):
    rnd = random.Random(2)
    rows = []
    for e in range(25):
        for s in range(3):
            rows.append((e, 157 + rnd.random() * 6, 51 + rnd.random() * 5, 157 + rnd.random() * 6, 51 + rnd.random() * 5, rnd.uniform(1, 40), rnd.uniform(2, 70), rnd.randrange(2400)))
    df = spark.createDataFrame(rows, "event_id int, e_lon double, e_lat double, s_lon double, s_lat double, delta_t_p double, delta_t_s double, day int")
    df = df.withColumn("event_dttm", F.expr("timestampadd(DAY, day, timestamp_ntz '1995-01-01 00:00:00')"))
    got = {(r.ix, r.iy, r.it): (r.n, r.p_min, r.s_max) for r in nd.spread_to_nodes(df, GRID, 120, 250, 90).collect()}
    step = GRID.span_us / 48 / 86400e6
    want = {}
    for e, elon, elat, slon, slat, p, s, day in rows:
        for ix in range(15):
            for iy in range(21):
                la, lo = 50 + ix * 0.5, 156 + iy * 0.5
                if haversine(elat, elon, la, lo) <= 120 and haversine(slat, slon, la, lo) <= 250:
                    for it in range(49):
                        if abs(it * step - day) <= 90:
                            n, a, b = want.get((ix, iy, it), (0, 1e9, -1e9))
                            want[ix, iy, it] = (n + 1, min(a, p), max(b, s))
    assert got == want


def test_polygon_boundary_is_outside(spark):
    ring = spark.sql("select 'sq' as region_nm, array(named_struct('lon', 0D, 'lat', 0D), named_struct('lon', 2D, 'lat', 0D), named_struct('lon', 2D, 'lat', 2D), named_struct('lon', 0D, 'lat', 2D)) as ring")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.0, 1.0), (3, 2.0, 2.0), (4, 1.0, 2.0), (5, 3.0, 1.0), (6, 0.001, 1.999)], "id int, lon double, lat double")
    assert {r.id for r in cat.region_points(pts, ring, "lon", "lat").collect()} == {1, 6}
    box = pre.Box(2, 2, 0, 0)
    assert {r.id for r in pts.filter(box.touches("lon", "lat")).collect()} == {1, 2, 3, 4, 6}
    assert {r.id for r in pts.filter(box.contains("lon", "lat")).collect()} == {1, 6}


def test_quantiles_with_a_hot_group(spark):
    rnd = random.Random(9)
    rows = [("hot", round(rnd.gauss(0, 1), 2)) for _ in range(3000)] + [("a", 1.0), ("b", 1.0), ("b", 4.0)] + [("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in rk.exact_quantiles(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).collect()}
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q")).collect()}
    for g, q in want.items():
        assert [got[g].p10, got[g].p50, got[g].p90] == pytest.approx(q)


def test_row_index_and_stride(spark):
    df = spark.range(1000).withColumn("v", (F.col("id") * 7919) % 1000)
    got = rk.row_index(df, ["v"]).collect()
    assert all(r.row_no == r.v for r in got)
    kept = sorted(r.v for r in rk.stride_sample(df, ["v"], 300).collect())
    assert kept == list(range(0, 1000, 3))


def test_pair_rms_identity(spark):
    rnd = random.Random(4)
    v = [rnd.gauss(0, 1) for _ in range(17)]
    df = spark.createDataFrame([("a", x) for x in v] + [("b", 1.0)], "k string, r double")
    got = {r.k: r for r in ms.pairwise_rms(df, ["k"], "r").collect()}
    pairs = [(a - b) ** 2 for n, a in enumerate(v) for b in v[n + 1 :]]
    assert got["a"].rms == pytest.approx(math.sqrt(sum(pairs) / len(pairs))) and got["a"].n_pairs == len(pairs)
    assert got["b"].rms == 0.0 and got["b"].n_pairs == 0


def test_scalars(spark):
    row = spark.range(1).select(
        sc.ratio_diff(F.lit(0.0), F.lit(0.0)), sc.ratio_diff(F.lit(2.0), F.lit(0.0)), sc.relative_diff(F.lit(0.0), F.lit(0.0)),
        sc.relative_diff(F.lit(1.0), F.lit(3.0)), sc.bound_velocity(F.lit(10.0), 5.0, 2.0, sc.SoftLimit(sc.power(2.0), 1.0), sc.SoftLimit(sc.power(2.0), 1.0)), sc.apply_slowness(F.lit(2.0), F.lit(-9.0)),
        sc.snap_surface_depth(F.lit(-5.0), 10.0), sc.json_number(F.lit("Nan")), sc.biased_depth(F.lit(1.0), 100.0, 2.0),
    ).first()
    assert list(row) == [0.0, float("inf"), 0.0, 1.0, 10.0, 1e12, 0.0, None, pytest.approx(100.0)]


def test_year_filter_reaches_the_scan(spark, tb, tmp_path):
    path = str(tmp_path / "q")
    tb.quakes.write.parquet(path)
    stored = spark.read.parquet(path)
    plan = stored.filter(pre.since_year("event_dttm", 1998) & pre.in_days("event_dttm", "1998-01-01", "1999-01-01")).select("event_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_dttm" in text and "LessThan(event_dttm" in text
    assert "ReadSchema: struct<event_id:bigint,event_dttm:timestamp_ntz>" in text
