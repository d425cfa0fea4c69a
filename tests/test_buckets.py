"""Misfits inside buckets of quakes against the rows of all quakes and cells."""

import pandas as pd
import pytest

from tests.test_location import setting
from tremolite.operators import buckets as bk, location as lo, pyramid as py


def rows(df, *values):
    return {(x["event_id"], x["i"], x["j"], x["k"]): tuple(x[v] for v in values) for x in df.collect()}


@pytest.mark.parametrize("kind", [dict(), dict(rough=1.0, missing=0.2)])
def test_buckets_give_the_rows_of_the_long_form(spark, kind):
    o, f = setting(spark, (5, 4, 3), 6, 12, 7, **kind)
    long = lo.softmin_weights(lo.pairwise_misfit(o, f), 0.3)
    want, got = rows(long, "misfit", "weight"), rows(lo.cell_weights(o, f, 0.3), "misfit", "weight")
    assert got.keys() == want.keys() and len(got) > 100
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-12)
    assert rows(lo.best_cells(o, f, 4, decimals=9), "misfit") == rows(py.best_cells(o, f, 4, decimals=9, edge=2), "misfit")
    near = rows(lo.softmin_weights(lo.pairwise_misfit(o, f), 1.0, 0.5).filter("misfit <= 0.5 or weight > 0"), "weight")
    got = rows(lo.cell_weights(o, f, 1.0, 0.5), "weight")
    assert got.keys() == near.keys() and all(got[k] == pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in near.items())


def test_no_row_per_observation_and_cell(spark):
    o, f = setting(spark, (5, 4, 3), 6, 12, 7)
    for df in (lo.best_cells(o, f), lo.best_cells(o, f, 4), lo.locate_events(o, f, 0.5, 3)):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_whole_misfits_do_not_depend_on_the_order_of_stations(spark):
    o, f = setting(spark, (5, 4, 3), 6, 12, 7)
    sums = lambda q, c, m: pd.DataFrame({"event_id": q, "s": m.sum(axis=1)})
    turned = lambda df: df.selectExpr(*[c if c != "station_id" else "5 - station_id as station_id" for c in df.columns])
    run = lambda a, b: sorted(bk.misfits(a, b, bk.box_of(b), sums, "event_id int, s long", "station_id", "event_id", micros=True).collect())
    assert run(o, f) == run(turned(o), turned(f))


def test_stations_of_equal_times_are_sent_once(spark):
    """Thirty stations at three places make three sites, and give the rows that they give one by one."""
    o, f = setting(spark, (4, 3, 2), 3, 9, 5)
    many = lambda df: df.selectExpr(*[c if c != "station_id" else "station_id + 3*n as station_id" for c in df.columns])
    f = many(f.crossJoin(spark.range(10).selectExpr("cast(id as int) as n")))
    o = many(o.selectExpr("*", "event_id % 10 as n"))
    at = bk.sites(f, bk.box_of(f), "station_id").collect()
    assert len(at) == 3 and sorted(s for x in at for s in x["stations"]) == list(range(30))
    want, got = rows(lo.best_cell(lo.pairwise_misfit(o, f)), "misfit"), rows(lo.best_cells(o, f), "misfit")
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in want.items())


@pytest.mark.parametrize("held,at_once,batch", [(0, 8192, 10000), (500, 3, 10000), (1 << 20, 4, 2), (0, 1, 7)])
def test_rows_do_not_depend_on_what_a_task_holds(spark, monkeypatch, held, at_once, batch):
    """Times in a file, quakes of more observations than are taken at once, and quakes cut by the end of a batch."""
    o, f = setting(spark, (5, 4, 3), 6, 12, 7, rough=1.0, missing=0.2)
    want = rows(lo.cell_weights(o, f, 0.3, decimals=9, top_n=4), "misfit", "weight")
    monkeypatch.setattr(bk, "HELD", held)
    monkeypatch.setattr(bk, "ROWS", at_once)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = rows(lo.cell_weights(o, f, 0.3, decimals=9, top_n=4), "misfit", "weight")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and len(got) > 20
    assert all(got[k] == pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in want.items())


def test_a_bucket_is_not_held_whole(spark):
    """Quakes are given out while their bucket still arrives, and weights are scaled where they are made."""
    o, f = setting(spark, (5, 4, 3), 6, 12, 7)
    plan = lo.locate_events(o, f, 0.5, 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan and "Window" not in plan


@pytest.mark.parametrize("kind", [dict(), dict(rough=1.0, missing=0.2)])
def test_residuals_are_made_where_the_best_cell_is_found(spark, monkeypatch, kind):
    o, f = setting(spark, (5, 4, 3), 6, 12, 7, **kind)
    # An observation without a time, and one by a station without a field, which takes its quake out.
    o = o.unionByName(spark.createDataFrame([(3, 5, None), (4, 99, 1.0)], o.schema)).dropDuplicates(["event_id", "station_id"])
    plain = lo.residuals_at(lo.best_cells(o, f, decimals=9).drop("misfit"), o, f)
    key = ["event_id", "i", "j", "k", "station_id"]
    listed = lambda df, *cols: {tuple(x[c] for c in key): tuple(x[c] for c in cols) for x in df.collect()}
    want, made = listed(plain, "r"), lo.best_residuals(o, f, decimals=9)
    got = listed(made, "r")
    assert got.keys() == want.keys() and len(got) > 30
    for k, (v,) in want.items():
        assert got[k] == ((None,) if v is None else (pytest.approx(v, rel=1e-9, abs=1e-12),))
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    firsts, about = listed(lo.basis_differences(plain, ["event_id"]), "station_0", "d"), listed(lo.best_residuals(o, f, 9, "mean"), "r")
    got = listed(lo.best_residuals(o, f, 9, "first"), "station_0", "d")
    assert got.keys() == firsts.keys()
    for k, (s, d) in firsts.items():
        assert got[k][0] == s and got[k][1] == (None if d is None else pytest.approx(d, rel=1e-9, abs=1e-12))
        mine = [v for e, (v,) in want.items() if e[0] == k[0] and v is not None]
        assert want[k][0] is None or about[k][0] == pytest.approx(want[k][0] - sum(mine) / len(mine), abs=1e-12)
    monkeypatch.setattr(lo, "WHOLE", 1)
    for way in (None, "mean", "first"):
        long = listed(lo.best_residuals(o, f, 9, way), "r")
        assert long.keys() == want.keys()
