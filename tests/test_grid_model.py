"""Properties of velocity grids: the public test cases of grid models, as cell tables."""

import json

import pytest
from pyspark.sql import functions as F

from tremolite.operators import cells as ce
from tremolite.sources import tables as tab


def box(spark, nx, ny, nz, vp=0.0, vs=0.0):
    n = F.col("id")
    return spark.range(nx * ny * nz).select(
        F.floor(n / (ny * nz)).cast("int").alias("i"), (F.floor(n / nz) % ny).cast("int").alias("j"),
        (n % nz).cast("int").alias("k"), F.lit(float(vp)).alias("vp"), F.lit(float(vs)).alias("vs"),
    )


def values(df, v="vp"):
    return {(r.i, r.j, r.k): r[v] for r in df.collect()}


def test_creation_shape(spark):
    info = ce.grid_info(box(spark, 10, 20, 30), [], 50.0, 1).first()
    assert (info.n_i, info.n_j, info.n_k) == (10, 20, 30)


def test_set_and_get(spark):
    cells = box(spark, 5, 5, 5)
    up = spark.createDataFrame([(2, 3, 4, 5000.0)], "i int, j int, k int, vp double")
    got = values(ce.set_cells(cells, up, ce.CELL, ["vp"]))
    assert got[2, 3, 4] == 5000.0 and sum(got.values()) == 5000.0
    assert ce.get_cells(ce.set_cells(cells, up, ce.CELL, ["vp"]), up, ce.CELL).first().vp == 5000.0


def test_linear_gradient(spark):
    got = values(box(spark, 10, 10, 10).withColumn("vp", ce.linear_gradient(1000, 5000, 10)))
    assert got[0, 0, 0] == 1000 and got[9, 9, 9] == pytest.approx(5000) and abs(got[5, 5, 5] - 3000) < 500


def test_set_all_and_shape_check(spark):
    cells = box(spark, 3, 3, 3)
    assert set(values(ce.set_all_cells(cells, box(spark, 3, 3, 3, 4000), ce.CELL, ["vp"])).values()) == {4000.0}
    with pytest.raises(Exception, match="grid shape"):
        ce.set_all_cells(cells, box(spark, 3, 3, 2, 4000), ce.CELL, ["vp"]).collect()


def test_json_round_trip(spark, tmp_path):
    cells = box(spark, 3, 3, 3, 0, 1000).withColumns(
        {"vp": ce.linear_gradient(1000, 3000, 3), "m": F.lit(1),
         "vs": F.when((F.col("i") == 1) & (F.col("j") == 1) & (F.col("k") == 1), 1500.0).otherwise(1000.0)}
    )
    geometry = {"lon": 30.0, "lat": 60.0, "height": 100.0, "azimuth": 90.0, "side_size": 50.0}
    doc = tab.cells_to_models(cells, ["m"], geometry).first().doc
    (tmp_path / "m.json").write_text(json.dumps(json.loads(doc), indent=2))
    model = tab.read_models(spark, str(tmp_path / "m.json"))
    head = model.first()
    assert (head.lon, head.azimuth, head.n_x, head.n_z) == (30.0, 90.0, 3, 3)
    back = tab.models_to_cells(model, [])
    assert values(back) == values(cells) and values(back, "vs")[1, 1, 1] == 1500.0
    bare = json.loads(tab.cells_to_models(cells, ["m"], geometry, include_data=False).first().doc)
    assert "data" not in bare and bare["n_y"] == 3


def test_refine_identity(spark):
    cells = box(spark, 5, 5, 5).withColumn("vp", ce.linear_gradient(2000, 4000, 5))
    assert values(ce.refine(cells, 1, [], ["vp"])) == values(cells)
    assert values(ce.refine(cells, 1, [], ["vp"], "trilinear")) == pytest.approx(values(cells))


def test_refine_shape_and_corner(spark):
    cells = box(spark, 2, 2, 2).withColumn("vp", ce.linear_gradient(1000, 3000, 2))
    fine = values(ce.refine(cells, 2, [], ["vp"]))
    assert len(fine) == 64 and fine[0, 0, 0] == 1000.0
    assert ce.grid_info(cells, [], 100.0, 2).first().fine_cell_size == 50.0


def test_nearest_then_coarsen_is_identity(spark):
    cells = box(spark, 3, 2, 4).withColumn("vp", F.col("i") * 100.0 + F.col("j") * 10 + F.col("k"))
    back = ce.coarsen_sum(ce.refine(cells, 2, [], ["vp"]), 2, [], "vp").withColumn("vp", F.col("vp") / 8)
    assert values(back) == values(cells)


def test_trilinear_differs_from_nearest(spark):
    centre = (F.col("i") == 1) & (F.col("j") == 1) & (F.col("k") == 1)
    cells = box(spark, 3, 3, 3).withColumn("vp", F.when(centre, 5000.0).otherwise(1000.0))
    a, b = values(ce.refine(cells, 3, [], ["vp"])), values(ce.refine(cells, 3, [], ["vp"], "trilinear"))
    assert a != b and b[1, 1, 1] == pytest.approx(1000 + 4000 / 27)


def test_custom_interpolation(spark):
    fine = ce.refine(box(spark, 2, 2, 2), 2, [], ["vp"], lambda corner, di, dj, dk: F.lit(9999.0))
    assert set(values(fine).values()) == {9999.0}


def test_refine_rejects_bad_input(spark):
    cells = box(spark, 2, 2, 2)
    with pytest.raises(ValueError):
        ce.refine(cells, 0, [], ["vp"])
    with pytest.raises(ValueError):
        ce.refine(cells, 2, [], ["vp"], "cubic")
    with pytest.raises(ValueError):
        ce.coarsen_sum(cells, 3, [], "vp", (2, 2, 2))


def test_lattice_location_round_trip(spark):
    m = ce.Lattice(ce.TopPoint(-115.7, 32.8, 0.0), 500.0, 7, 9, 5)
    cells = ce.lattice_cells(spark, m)
    found = ce.locate_cells(cells, m, as_index=False)
    assert cells.count() == 7 * 9 * 5
    assert found.filter("not (z <=> dz and x <=> dx and y <=> dy)").count() == 0


def test_points_outside_lattice(spark):
    m = ce.Lattice(ce.TopPoint(160.0, 52.0, 0.0), 1000.0, 3, 3, 2)
    p = spark.createDataFrame([(160.0, 52.0, 0.0), (161.0, 52.0, 0.0), (160.0, 52.0, 5000.0)], "lon double, lat double, depth double")
    assert [r.z for r in ce.locate_cells(p, m).collect()] == [0, None, None]
    assert ce.add_cell_coords(p.drop("depth"), m).count() == 2
    with pytest.raises(ValueError):
        ce.Lattice(ce.TopPoint(0, 0), 1.0, 2, 3, 1)


def test_interpolation_is_exact_for_linear_values(spark):
    axes = {"x": [0.0, 1.0, 4.0], "y": [0.0, 2.0], "z": [0.0, 5.0, 6.0, 10.0]}
    nodes = [(i, j, k, 2 * x - y + 3 * z + 1) for i, x in enumerate(axes["x"]) for j, y in enumerate(axes["y"]) for k, z in enumerate(axes["z"])]
    cells = spark.createDataFrame(nodes, "i int, j int, k int, v double")
    pts = spark.createDataFrame([(0.5, 1.0, 5.5), (-1.0, 3.0, 12.0), (4.0, 2.0, 10.0)], "x double, y double, z double")
    for row in ce.interpolate_points(pts, cells, axes, "v", "out").collect():
        assert row.out == pytest.approx(2 * row.x - row.y + 3 * row.z + 1)


def test_nearest_index_ties_go_low(spark):
    axis = [0.0, 1.0, 3.0]
    got = spark.createDataFrame([(-5.0,), (0.5,), (0.6,), (2.0,), (2.1,), (9.0,)], "x double").select(ce.nearest_index("x", axis).alias("n"))
    assert [r.n for r in got.collect()] == [0, 0, 1, 1, 2, 2]


def test_gradient_matches_numpy(spark):
    import numpy as np

    a = np.random.default_rng(1).normal(size=(4, 3, 2))
    rows = [(0, i, j, k, float(a[i, j, k])) for i in range(4) for j in range(3) for k in range(2)]
    df = spark.createDataFrame(rows, "f int, i int, j int, k int, t double")
    want = np.gradient(a)
    for row in ce.gradient(df, ["f"], "t").collect():
        for axis, name in enumerate(("gi", "gj", "gk")):
            assert row[name] == pytest.approx(want[axis][row.i, row.j, row.k])


def test_version_snapshots(spark, tmp_path):
    path = str(tmp_path / "store")
    cells = box(spark, 2, 2, 2, 100).withColumn("m", F.lit("a"))
    for n in range(11):
        tab.save_model_version(cells.withColumn("vp", F.lit(float(n))), path, "m")
    newest = tab.load_model(spark, path, "m")
    assert newest.select("version", "vp").distinct().collect() == [(11, 10.0)]
    assert tab.load_model(spark, path, "m", 3).first().vp == 2.0


def test_missing_cells_raise(spark):
    rows = [(i, j, k, float(i + j + k)) for i in range(3) for j in range(3) for k in range(3)]
    grid = spark.createDataFrame(rows, "i int, j int, k int, v double")
    axes = {"x": [0.0, 1.0, 2.0], "y": [0.0, 1.0, 2.0], "z": [0.0, 1.0, 2.0]}
    points = spark.createDataFrame([(0.5, 0.5, 1.5), (2.0, 2.0, 2.0)], "x double, y double, z double")
    assert sorted(r.at for r in ce.interpolate_points(points, grid, axes, "v", "at").collect()) == [2.5, 6.0]
    with pytest.raises(Exception, match="missing near|lacks"):
        ce.interpolate_points(points, grid.filter("k < 2"), axes, "v", "at").collect()
    with pytest.raises(Exception, match="missing near"):
        ce.refine(grid.filter("not (i = 1 and j = 1 and k = 1)"), 2, [], ["v"], "trilinear").collect()
    assert ce.refine(grid, 2, [], ["v"], "trilinear").count() == 27 * 8


def test_event_tables_with_quotes_and_any_column_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('event_id,note,t\n1,"north, far",2.5\n2,"say ""hi""",\n')
    (tmp_path / "b.csv").write_text("t,event_id\n7.0,3\n")
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    rows, skipped = tab.scan_event_tables(spark, str(tmp_path), {"event_id": "long", "t": "double", "note": "string"}, ["event_id", "t"])
    assert sorted((r.event_id, r.t, r.note) for r in rows.collect()) == [(1, 2.5, "north, far"), (2, None, 'say "hi"'), (3, 7.0, None)]
    assert [r.file.rsplit("/", 1)[1] for r in skipped.collect()] == ["c.csv"]
