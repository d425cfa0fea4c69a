import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolite import registry
from tremolite.operators import cells as ce, inversion as inv, rays as ry
from tremolite.plans import straight_ray as sr
from tremolite.registry.grids import AXES, ZONE


@pytest.fixture(scope="module")
def bent(spark):
    rnd = random.Random(3)
    rows = [(f"r{n}", rnd.uniform(155, 166), rnd.uniform(50, 57), rnd.uniform(0, 30000), rnd.uniform(155, 166), rnd.uniform(50, 57), rnd.uniform(5, 90)) for n in range(1300)]
    rows.append(("still", 160.0, 53.0, 0.0, 160.0, 53.0, 1.0))
    rays = spark.createDataFrame(rows, "ray string, event_lon double, event_lat double, event_depth double, station_lon double, station_lat double, travel_time double")
    nodes = [(i, j, k, 3000.0 + 50 * ((i * 7 + j * 5 + k * 3) % 11)) for i in range(5) for j in range(4) for k in range(3)]
    return rays, spark.createDataFrame(nodes, "i int, j int, k int, v double")


def test_vectors_equal_the_points(bent, monkeypatch):
    rays, values = bent
    points = ce.interpolate_points(ry.straight_ray_samples(rays, ZONE), values, AXES, "v", "v_at")
    times = {r.ray: r.t_model for r in ry.ray_times(points, ["ray"], "v_at").collect()}
    want = {(r.ray, (r.i * 4 + r.j) * 3 + r.k): r.g for r in ry.ray_sensitivity(points, ["ray"], AXES, "v_at").collect()}
    made = sr.vectors(rays, values, AXES, ZONE)
    first = {r.ray: r.travel_time for r in rays.collect()}
    got = made.collect()
    assert {r.ray: first[r.ray] - r.dt for r in got} == pytest.approx(times)
    assert {(r.ray, c): g for r in got for c, g in zip(r.cells, r.g)} == pytest.approx(want, rel=1e-9, abs=1e-15)
    monkeypatch.setattr(ce, "SENT_CELLS", 1)
    assert {(r.ray, r.cell): r.g for r in sr.sensitivity(sr.vectors(rays, values, AXES, ZONE)).collect()} == want


def test_a_hole_in_the_nodes_is_an_error(bent):
    rays, values = bent
    with pytest.raises(ValueError, match="cells missing"):
        sr.vectors(rays, values.filter("i < 4"), AXES, ZONE)


def test_products_of_lists_equal_products_of_rows(spark, monkeypatch):
    monkeypatch.setattr(inv, "OPEN_TILES", 3)
    rng = np.random.default_rng(4)
    rows = [(n, float(rng.normal()), sorted(int(c) for c in rng.choice(3000, n % 40, replace=False))) for n in range(60)]
    rows = [(n, dt, c, [float(x) for x in rng.normal(size=len(c))]) for n, dt, c in rows]
    vectors = spark.createDataFrame(rows, "ray int, dt double, cells array<long>, g array<double>")
    flat = sr.sensitivity(vectors)
    a, b = inv.vector_system(vectors, 3000, 0.1)
    a0, b0 = inv.sparse_system(flat, vectors.select("ray", "dt"), ["ray"], 3000, 0.1)
    assert {(r.c1, r.c2): r.a for r in a.collect()} == pytest.approx({(r.c1, r.c2): r.a for r in a0.collect()})
    assert {r.cell: r.b for r in b.collect()} == pytest.approx({r.cell: r.b for r in b0.collect()})


@pytest.mark.parametrize("name", ["straight_ray_samples", "ray_time", "ray_sensitivity", "normal_equations_sparse"])
def test_no_row_per_point(spark, tb, name):
    """Points of a ray are made and summed inside one task; none is exploded, shuffled or stored."""
    registry.load()
    plan = registry.QUERIES[name](spark, tb.sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, 99" not in plan and "MapInArrow" in plan
