"""What a task holds and what is shuffled, read off the plans."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tremolite import registry
from tremolite.operators import fronts as fr, nodes as nd

registry.load()


def plan_of(spark, tb, name):
    return registry.QUERIES[name](spark, tb.sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["node_intersect", "node_runs"])
def test_opened_rows_are_not_shuffled(spark, tb, name):
    plan = plan_of(spark, tb, name)
    assert "Generate" in plan and "Exchange" not in plan[: plan.index("Generate")]


def test_few_stations_are_dealt_before_they_are_opened(spark, tb):
    assert "REPARTITION_BY_NUM" in plan_of(spark, tb, "node_runs")


def test_residuals_meet_before_they_are_summed(spark, tb):
    plan = plan_of(spark, tb, "hypo_rms")
    assert "Exchange" in plan and "partial_sum" not in plan[plan.index("Exchange") :]


def test_runs_with_a_node_that_comes_twice(spark):
    rows = [("a", 0, y) for y in (1, 2, 2, 3, 6, 6, 7, 9)] + [("b", 1, 4), ("a", 1, 4)]
    got = nd.node_runs(spark.createDataFrame(rows, "s string, ix int, iy int"), ["s"]).collect()
    assert {(r.s, r.ix, r.iy_start, r.iy_end) for r in got} == {("a", 0, 1, 3), ("a", 0, 6, 7), ("a", 0, 9, 9), ("b", 1, 4, 4), ("a", 1, 4, 4)} and len(got) == 5


def test_sums_in_parts_equal_sums_of_whole_products(spark):
    rnd = random.Random(2)
    times = [(n % 3, rnd.choice([-1, 1]) * rnd.randrange(10 ** rnd.randrange(1, 11)) / 1e6, rnd.randrange(10**10) / 1e6) for n in range(500)]
    df = spark.createDataFrame(times, "node int, delta_t_p double, delta_t_s double")
    want = df.groupBy("node").agg(*nd.moments()).groupBy().agg(*nd.merge_moments()).first().asDict()
    got = nd.whole_products(df.groupBy("node").agg(*nd.part_moments()).groupBy().agg(*nd.merge_parts())).first().asDict()
    assert got == want


def test_blocks_are_opened_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(fr, "ROWS", 2)
    n = 5
    schema = pa.schema([("source", pa.int64()), ("model", pa.int32()), ("bi", pa.int32()), ("bj", pa.int32()), ("bk", pa.int32()), ("t", pa.list_(pa.float64())), ("top", pa.float64()),
                        ("out", pa.list_(pa.struct([("bi", pa.int32()), ("bj", pa.int32()), ("bk", pa.int32()), ("at", pa.list_(pa.int32())), ("t", pa.list_(pa.float64()))])))])
    whole = pa.RecordBatch.from_pydict({
        "source": list(range(n)), "model": [0] * n, "bi": [0] * n, "bj": [0] * n, "bk": [0] * n, "at": [[0]] * n, "news_t": [[0.0]] * n,
        "is_source": [[True]] * n, "cell_at": [list(range(8))] * n, "cell_cost": [[1.0] * 8] * n, "t": pa.array([None] * n, pa.list_(pa.float64())),
    })
    made = list(fr._round(2, schema)([whole]))
    assert [b.num_rows for b in made] == [2, 2, 1]
    assert all(np.allclose(t, [0, 1, 1, 2, 1, 2, 2, 3]) for b in made for t in b.column("t").to_pylist())


def test_paths_across_blocks_equal_paths_in_one(spark, monkeypatch):
    """Rays with a cell in common, one off the field, and blocks of any size."""
    monkeypatch.setattr(fr, "PATH_CELLS", 5)
    cells = [(0, i, j, k, 1.0 + (i * 5 + j * 3 + k) % 7) for i in range(7) for j in range(4) for k in range(3) if (i, j, k) != (3, 1, 1)]
    t = spark.createDataFrame(cells, "model int, i int, j int, k int, c double")
    sources = spark.createDataFrame([(1, 0, 0, 0, 0), (2, 0, 6, 3, 2)], "source int, model int, i int, j int, k int")
    fields = fr.travel_fields(t, sources, F.col("c"), block=4).persist()
    times = {(r.source, r.i, r.j, r.k): r.t for r in fields.collect()}
    ends = [(s, 0, x, i, j, k) for x, (i, j, k) in enumerate([(6, 3, 2), (6, 3, 2), (0, 3, 0), (6, 0, 1), (3, 1, 1), (9, 9, 9)]) for s in (1, 2)]
    rays = spark.createDataFrame(ends, "source int, model int, ray int, i int, j int, k int")
    want = set()
    for s, _, x, *c in ends:
        step, c = 0, tuple(c)
        while True:
            want.add((s, x, step, *c))
            near = [(times[s, *n], n) for n in (tuple(a + b for a, b in zip(c, d)) for d in fr.STEPS) if (s, *n) in times]
            if (s, *c) not in times or not near or min(near)[0] >= times[s, *c]:
                break
            c, step = min(near)[1], step + 1
    for block in (2, 3, 16):
        got = [(r.source, r.ray, r.step, r.i, r.j, r.k) for r in fr.trace_back(rays, fields, block).collect()]
        assert set(got) == want and len(got) == len(want)
    fields.unpersist()


def test_one_box_takes_one_round(spark, monkeypatch):
    """Fields that fit into a block are followed at once: one table of paths, none per doubling."""
    stored = []
    keep = fr.materialise
    monkeypatch.setattr(fr, "materialise", lambda df, label: stored.append(label) or keep(df, label))
    fields = spark.createDataFrame([(1, 0, i, 0, 0, float(i)) for i in range(12)], "source int, model int, i int, j int, k int, t double")
    rays = spark.createDataFrame([(1, 0, 7, 11, 0, 0)], "source int, model int, ray int, i int, j int, k int")
    assert fr.trace_back(rays, fields).count() == 12 and stored == ["paths"]
