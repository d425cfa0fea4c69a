"""The quadtree cover against a ray cast over the whole ring."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tremolite.operators import cover as co, predicates as pre


def star(n, cx, cy, seed, low=0.3, high=3.0):
    """A closed-or-not ring with a border as ragged as one likes."""
    r = random.Random(seed)
    return [(cx + d * math.cos(2 * math.pi * k / n), cy + d * math.sin(2 * math.pi * k / n)) for k in range(n) for d in [r.uniform(low, high)]]


RINGS = {
    "ragged": star(400, 160.0, 53.0, 1), "plain": [(158.0, 51.0), (162.0, 52.0), (159.5, 55.0)], "small": star(30, 159.0, 54.0, 2, 1e-4, 1e-3),
    "closed": [(150.0, 50.0), (170.0, 50.0), (170.0, 60.0), (150.0, 60.0), (150.0, 50.0)], "far": star(12, -70.0, -40.0, 3), "point": [(160.0, 53.0)] * 3,
    "comb": [(155.0 + k * 0.1, 50.0 if k % 2 else 56.0) for k in range(80)] + [(163.0, 49.0), (155.0, 49.0)],
}


@pytest.fixture(scope="module")
def regions(spark):
    rows = [(n, [{"lon": x, "lat": y} for x, y in ring]) for n, ring in RINGS.items()] + [("none", None)]
    return spark.createDataFrame(rows, "region_nm string, ring array<struct<lon:double,lat:double>>")


def test_same_points_as_the_ray_cast(spark, regions):
    r = random.Random(7)
    spots = [(160.0, 53.0, 4.0)] * 1500 + [(159.0, 54.0, 2e-3)] * 1000 + [(160.0, 53.0, 12.0)] * 500 + [(-70.0, -40.0, 4.0)] * 300
    pts = [(i, x + r.uniform(-d, d), y + r.uniform(-d, d)) for i, (x, y, d) in enumerate(spots)] + [(9000, None, 53.0), (9001, 160.0, None)]
    points = spark.createDataFrame(pts, "id int, lon double, lat double")
    got = {(x["id"], x["region_nm"]) for x in co.region_points(points, regions, "lon", "lat").collect()}
    rings = pre.ring_edges(regions.where("ring is not null"))
    want = {
        (x["id"], x["region_nm"])
        for name in RINGS
        for x in points.join(F.broadcast(rings.where(F.col("region_nm") == name)), F.lit(True)).where(pre.inside_edges("lon", "lat", "edges")).select("id", "region_nm").collect()
    }
    assert got == want and len(want) > 3000


def test_corners_and_borders_are_outside(spark, regions):
    pts = [(n, i, *p) for n, ring in RINGS.items() for i, p in enumerate(ring)] + [("closed", -1, 150.0, 55.0), ("closed", -2, 160.0, 60.0)]
    points = spark.createDataFrame(pts, "own string, id int, lon double, lat double")
    assert co.region_points(points, regions, "lon", "lat").where("own = region_nm").count() == 0


def test_leaves_hold_few_edges_and_inside_leaves_none(spark, regions):
    rows = co.quadtree_cover(regions).collect()
    for name, ring in RINGS.items():
        own = [x for x in rows if x["region_nm"] == name]
        sizes = [len(x["edges"]) for x in own]
        if name == "point":
            assert not own
            continue
        assert max(sizes) <= co.EDGES or len(ring) <= co.EDGES or max(x["level"] for x in own) >= co.MOST
        assert name not in ("ragged", "plain", "closed") or any(x["inside"] and not x["edges"] for x in own)
        assert len({(x["level"], x["cx"], x["cy"]) for x in own}) == len(own)
    ragged = [len(x["edges"]) for x in rows if x["region_nm"] == "ragged"]
    assert sum(ragged) < 12 * 400


def test_no_ring_in_the_join(spark, regions):
    points = spark.createDataFrame([(1, 160.0, 53.0)], "id int, lon double, lat double")
    plan = co.region_points(points, regions, "lon", "lat")._jdf.queryExecution().toString()
    assert "ring#" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert co.region_points(points, regions.where("false"), "lon", "lat").count() == 0
