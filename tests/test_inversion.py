import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolite.operators import cells as ce, fronts as fr, inversion as inv, location as lo, rays as ry


def dijkstra(cost, source):
    t = {source: 0.0}
    heap = [(0.0, source)]
    while heap:
        d, c = heapq.heappop(heap)
        if d > t[c]:
            continue
        for s in fr.STEPS:
            n = tuple(a + b for a, b in zip(c, s))
            if n in cost and math.isfinite(cost[n]) and d + cost[n] < t.get(n, math.inf):
                t[n] = d + cost[n]
                heapq.heappush(heap, (t[n], n))
    return t


@pytest.fixture(scope="module")
def lattice(spark):
    rnd = random.Random(8)
    cells = {(i, j, k): rnd.choice([0.0, 900.0, 1500.0, 3000.0, 5000.0]) for i in range(9) for j in range(6) for k in range(5)}
    cells[0, 0, 0] = cells[8, 5, 4] = 1000.0
    df = spark.createDataFrame([(0, *c, v) for c, v in cells.items()], "model int, i int, j int, k int, vp double")
    sources = spark.createDataFrame([(1, 0, 0, 0, 0), (2, 0, 8, 5, 4)], "source int, model int, i int, j int, k int")
    cost = F.when(F.col("vp") > 0, 100.0 / F.nullif(F.col("vp"), F.lit(0.0)))
    brute = {c: 100.0 / v if v > 0 else math.inf for c, v in cells.items()}
    return df, sources, cost, brute


def test_fields_match_shortest_paths(lattice):
    df, sources, cost, brute = lattice
    got = {}
    for r in fr.travel_fields(df, sources, cost, block=2, compact_every=2).collect():
        assert (r.i, r.j, r.k) not in got.setdefault(r.source, {})
        got[r.source][r.i, r.j, r.k] = r.t
    for source, cell in ((1, (0, 0, 0)), (2, (8, 5, 4))):
        want = dijkstra(brute, cell)
        assert got[source].keys() == want.keys()
        assert all(got[source][c] == pytest.approx(want[c]) for c in want)


def test_round_limit_is_reported(lattice):
    df, sources, cost, _ = lattice
    with pytest.raises(RuntimeError, match="not settled"):
        fr.travel_fields(df, sources, cost, block=2, max_rounds=1)


def test_paths_sum_up_to_the_field(spark, lattice):
    df, sources, cost, brute = lattice
    fields = fr.travel_fields(df, sources, cost, block=4)
    fields = fields.persist()
    ends = fields.withColumn("ray", F.col("i") * 100 + F.col("j") * 10 + F.col("k")).drop("t")
    times = {(r.source, r.ray): r.t for r in fields.withColumn("ray", F.col("i") * 100 + F.col("j") * 10 + F.col("k")).collect()}
    sums, steps = {}, {}
    for r in fr.trace_back(ends, fields).collect():
        c = (r.i, r.j, r.k)
        start = {1: (0, 0, 0), 2: (8, 5, 4)}[r.source]
        sums[r.source, r.ray] = sums.get((r.source, r.ray), 0.0) + (0.0 if c == start else brute[c])
        steps.setdefault((r.source, r.ray), set()).add(r.step)
    assert sums.keys() == times.keys()
    assert all(sums[k] == pytest.approx(times[k]) for k in times)
    assert all(s == set(range(len(s))) for s in steps.values())
    fields.unpersist()


def test_misfit_equals_pair_form_and_weights_sum_to_one(spark):
    rng = np.random.default_rng(3)
    t = rng.uniform(1, 9, size=(5, 4, 3, 2))
    obs = rng.uniform(1, 9, size=(7, 5))
    field = spark.createDataFrame(
        [(s, i, j, k, float(t[s, i, j, k])) for s in range(5) for i in range(4) for j in range(3) for k in range(2)],
        "station_id int, i int, j int, k int, t double",
    )
    observed = spark.createDataFrame(
        [(e, s, float(obs[e, s])) for e in range(7) for s in range(5)] + [(99, 0, 1.0)], "event_id int, station_id int, t_obs double"
    )
    m = lo.pairwise_misfit(observed, field)
    got = {(r.event_id, r.i, r.j, r.k): r.misfit for r in m.collect()}
    assert len(got) == 7 * 24
    for (e, i, j, k), value in got.items():
        r = obs[e] - t[:, i, j, k]
        want = sum((r[a] - r[b]) ** 2 for a in range(5) for b in range(a + 1, 5))
        assert value == pytest.approx(want)
    w = lo.softmin_weights(m, 0.7)
    by_event = {}
    for r in w.collect():
        by_event.setdefault(r.event_id, {})[r.i, r.j, r.k] = r.weight
    for e, weights in by_event.items():
        mis = np.array([got[(e, *c)] for c in weights])
        d = mis - mis.min()
        raw = np.exp(-d / (0.7 * np.median(d[d > 0])))
        assert list(weights.values()) == pytest.approx(list(raw / raw.sum()))
    alone = lo.softmin_weights(m, 1.0, threshold=0.0).filter("weight > 0").groupBy("event_id").count().collect()
    assert len(alone) == 7 and all(r["count"] == 1 for r in alone)
    top = lo.locate_events(observed, field, 1.0, 3).groupBy("event_id").agg(F.count("*").alias("n"), F.sum("weight").alias("s")).collect()
    assert all(r.n == 3 and r.s == pytest.approx(1) for r in top)
    assert all(r.weight == 0 for r in lo.locate_events(observed, field, 1.0, 0).collect())


def test_cell_lengths_against_dense_sampling(spark):
    rng = np.random.default_rng(5)
    shape, size = (4, 5, 3), (2.0, 1.0, 3.0)
    rows = []
    for ray in range(30):
        a, b = rng.uniform(-1, 6, 3), rng.uniform(-1, 6, 3)
        if ray < 5:  # level rays, also along a face
            a, b = np.round(a), np.round(b)
            b[ray % 3] = a[ray % 3]
        rows.append((ray, *map(float, a), *map(float, b)))
    df = spark.createDataFrame(rows, "ray int, a0 double, a1 double, a2 double, b0 double, b1 double, b2 double")
    got = {}
    for r in ry.cell_lengths(df, ["ray"], shape, size).collect():
        got.setdefault(r.ray, {})[r.i, r.j, r.k] = r.length
    for ray, *ab in rows:
        a, b = np.array(ab[:3]), np.array(ab[3:])
        u = (np.arange(20000) + 0.5) / 20000
        p = a + u[:, None] * (b - a)
        inside = np.all((p >= 0) & (p <= np.array(shape) - 1e-9), axis=1)
        length = np.linalg.norm((b - a) * size)
        assert sum(got.get(ray, {}).values()) == pytest.approx(inside.mean() * length, abs=2e-3 * length + 1e-9)
        for c, v in got.get(ray, {}).items():
            share = np.all(np.floor(p) == c, axis=1) & inside
            assert v == pytest.approx(share.mean() * length, abs=2e-3 * length + 1e-9)


@pytest.fixture(scope="module")
def system(spark):
    rng = np.random.default_rng(7)
    s = np.where(rng.random((6, 9)) < 0.7, rng.uniform(0, 2, (6, 9)), 0.0)
    r = rng.normal(size=6)
    sums = spark.createDataFrame([(a, c, float(s[a, c])) for a in range(6) for c in range(9) if s[a, c]], "station_id int, cell long, s double")
    right = spark.createDataFrame([(a, float(r[a])) for a in range(6)], "station_id int, r double")
    pairs = [(a, b) for a in range(6) for b in range(a + 1, 6)]
    g = np.array([s[a] - s[b] for a, b in pairs])
    d = np.array([r[a] - r[b] for a, b in pairs])
    return sums, right, g.T @ g, g.T @ d


def test_pair_system_equals_explicit_pairs(system):
    sums, right, a, b = system
    got_a, got_b = inv.pair_system(sums, right, 6, 9, 0.1)
    want = a + 0.1 * np.trace(a) / 9 * np.eye(9)
    for row in got_a.collect():
        assert row.c1 <= row.c2 and row.a == pytest.approx(want[row.c1, row.c2])
    assert {r.cell: r.b for r in got_b.collect()} == pytest.approx(dict(enumerate(b)))


def test_conjugate_gradients_equal_direct_solution(system):
    sums, right, a, b = system
    x = inv.damped_solve(sums, inv.pair_right_side(sums, right, 6), ["station_id"], "cell", "s", 0.3, pairs_of=6)
    want = np.linalg.solve(a + 0.3 * np.eye(9), b)
    assert {r.cell: r.x for r in x.collect()} == pytest.approx(dict(enumerate(want)), rel=1e-6)


def test_rounds_of_the_solver_store_and_shuffle_no_rows(spark, system, monkeypatch):
    """Rows are stored once; beyond the cells that a driver keeps the rounds are joins, with the same solution."""
    sums, right, a, b = system
    stored, keep = [], inv.materialise
    monkeypatch.setattr(inv, "materialise", lambda df, label: stored.append(label) or keep(df, label))
    solve = lambda: inv.damped_solve(sums, inv.pair_right_side(sums, right, 6), ["station_id"], "cell", "s", 0.3, pairs_of=6)
    want = pytest.approx(dict(enumerate(np.linalg.solve(a + 0.3 * np.eye(9), b))), rel=1e-6)
    assert {r.cell: r.x for r in solve().collect()} == want and stored == ["rows", "right"]
    with pytest.raises(RuntimeError):
        inv.damped_solve(sums, inv.pair_right_side(sums, right, 6), ["station_id"], "cell", "s", 0.3, pairs_of=6, max_rounds=2)
    monkeypatch.setattr(inv, "SENT_CELLS", 8)
    assert {r.cell: r.x for r in solve().collect()} == want and len(stored) > 6


def test_solver_with_gaps_in_cells_and_rows(spark):
    """A cell without a right side, one without rows, a missing value and an entry that comes twice."""
    g = spark.createDataFrame([(0, 10**12, 1.0), (0, 10**12, 0.5), (0, 7, -2.0), (1, 3, 3.0), (1, 7, 1.0), (2, 3, None)], "ray int, cell long, g double")
    right = spark.createDataFrame([(7, 2.0), (3, -1.0), (99, 4.0)], "cell long, b double")
    m = np.array([[0, -2.0, 1.5, 0], [3.0, 1.0, 0, 0]])
    want = np.linalg.solve(m.T @ m + 0.2 * np.eye(4), [-1.0, 2.0, 0, 4.0])
    got = {r.cell: r.x for r in inv.damped_solve(g, right, ["ray"], "cell", "g", 0.2).collect()}
    assert got == pytest.approx(dict(zip((3, 7, 10**12, 99), want)), rel=1e-6)


def test_sums_of_a_station_are_stored_once(spark, system, monkeypatch):
    sums, right, a, _ = system
    stored, keep = [], inv.materialise
    monkeypatch.setattr(inv, "materialise", lambda df, label: stored.append(label) or keep(df, label))
    made, _ = inv.pair_system(sums, right, 6, 9, 0.0)
    assert stored == ["vectors", "totals", "tiles"]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "station_id" not in plan
    assert all(r.a == pytest.approx(a[r.c1, r.c2]) for r in made.collect())


def test_pieces_of_rays_carry_their_weight_and_are_not_shuffled(spark, tb):
    from tremolite.registry import inversion as ri

    s, right = ri.sums(tb)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Exchange" not in plan[: plan.index("Generate")]
    want = {}
    for x in ri.segments(tb)[0].join(ri.lengths(tb), ["station_id", "ray"]).collect():
        at = x.station_id, (x.i * 5 + x.j) * 5 + x.k
        want[at] = want.get(at, 0.0) + x.weight * x.length
    assert {(x.station_id, x.cell): x.s for x in s.collect()} == pytest.approx(want)


def test_sparse_system(spark):
    rows = [(0, 0, 1.0), (0, 0, 0.5), (0, 2, -2.0), (1, 1, 3.0), (1, 2, 1.0)]
    g = spark.createDataFrame(rows, "ray int, cell long, g double")
    dt = spark.createDataFrame([(0, 2.0), (1, -1.0)], "ray int, dt double")
    m = np.array([[1.5, 0, -2.0], [0, 3.0, 1.0]])
    a, b = inv.sparse_system(g, dt, ["ray"], 3, 0.1)
    want = m.T @ m + 0.1 * np.eye(3)
    assert all(r.a == pytest.approx(want[r.c1, r.c2]) for r in a.collect())
    assert {r.cell: r.b for r in b.collect()} == pytest.approx(dict(enumerate(m.T @ [2.0, -1.0])))


def test_tiles_equal_explicit_pairs_beyond_any_tile(spark, monkeypatch):
    monkeypatch.setattr(inv, "OPEN_TILES", 3)
    rng = np.random.default_rng(4)
    rows = [(int(r), int(c), float(v), 1.0 + r % 3) for r in range(12) for c, v in zip(rng.choice(5000, 40, replace=False), rng.normal(size=40))]
    want = {}
    for r in range(12):
        mine = [(c, v, w) for q, c, v, w in rows if q == r]
        for c1, v1, w in mine:
            for c2, v2, _ in mine:
                if c1 <= c2:
                    want[c1, c2] = want.get((c1, c2), 0.0) + w * v1 * v2
    got = inv.gram(spark.createDataFrame(rows, "ray int, cell long, g double, w double"), ["ray"], "cell", "g", "w").collect()
    assert {(r.c1, r.c2): r.a for r in got} == pytest.approx(want)


def test_straight_ray_runs_from_quake_depth_to_surface(spark):
    ray = spark.createDataFrame([("r", -117.0, 33.0, 9000.0, -116.5, 33.4)], "ray string, event_lon double, event_lat double, event_depth double, station_lon double, station_lat double")
    pts = sorted(ry.straight_ray_samples(ray, 11).collect(), key=lambda p: p.sample)
    assert len(pts) == 100 and pts[0].depth == 9000.0 and pts[-1].depth == 0.0
    assert (pts[0].lon, pts[0].lat) == pytest.approx((-117.0, 33.0)) and (pts[-1].lon, pts[-1].lat) == pytest.approx((-116.5, 33.4))


def test_model_recovery_improves(spark):
    """Full coverage, known truth: one correction brings the modelled pair differences closer to the observed ones."""
    from tremolite.plans import tomography as tg

    n = F.col("id")
    cells = spark.range(32).select(F.floor(n / 8).cast("int").alias("i"), (F.floor(n / 2) % 4).cast("int").alias("j"), (n % 2).cast("int").alias("k"))
    truth = cells.withColumn("vp", F.lit(1000.0) + (F.col("i") * 7 + F.col("j") * 5 + F.col("k")) % 5 * 60)
    start = cells.withColumn("vp", F.lit(1100.0))
    stations = spark.createDataFrame([(s, float(x), float(y), 0.0) for s, (x, y) in enumerate([(50, 50), (350, 50), (50, 350), (350, 350), (250, 150)])], "station_id long, x double, y double, z double")
    s = tg.Settings(100.0, 4, 4, 2, lambda_reg=0.05)
    true_fields = tg.station_fields(truth, stations, s)
    observed = true_fields.filter("k = 1").select(
        (F.col("i") * 4 + F.col("j")).cast("long").alias("event_id"), F.col("source").alias("station_id"), (F.col("t") + 3.0).alias("t_obs")
    ).persist()

    def total(model):
        f = tg.station_fields(model, stations, s).select(F.col("source").alias("station_id"), "i", "j", "k", "t")
        return lo.best_cell(lo.pairwise_misfit(observed, f)).agg(F.sum("misfit")).first()[0]

    after = tg.run(start, observed, stations, s, 2)
    assert after.count() == 32
    assert total(after) < 0.7 * total(start)


def test_a_cycle_stores_no_residuals(spark, monkeypatch):
    """With one cell per quake residuals are summed per ray as they are made, in blocks no larger than the grid; joins give the same correction."""
    from tremolite.plans import tomography as tg

    n = F.col("id")
    model = spark.range(18).select(F.floor(n / 6).cast("int").alias("i"), (F.floor(n / 2) % 3).cast("int").alias("j"), (n % 2).cast("int").alias("k"))
    model = model.withColumn("vp", F.lit(1000.0) + (F.col("i") * 7 + F.col("j") * 5 + F.col("k")) % 5 * 60)
    stations = spark.createDataFrame([(s, float(x), float(y), 0.0) for s, (x, y) in enumerate([(50, 50), (250, 50), (50, 250), (150, 150)])], "station_id long, x double, y double, z double")
    s = tg.Settings(100.0, 3, 3, 2, lambda_reg=0.05)
    seen = tg.station_fields(model, stations, s).select(
        (F.col("i") * 9 + F.col("j") * 3 + F.col("k")).cast("long").alias("event_id"), F.col("source").alias("station_id"), (F.col("t") * 1.1 + F.col("source") * 0.01).alias("t_obs")
    ).persist()
    stored, keep = [], tg.materialise
    monkeypatch.setattr(tg, "materialise", lambda df, label: stored.append(label) or keep(df, label))
    assert tg.block_side(s) == 3
    done = tg.step(model, seen, stations, s)
    assert stored == ["fields", "rays", "sums"]
    assert done.residuals.count() == seen.count() and done.weights.count() == 18
    got = {r.cell: r.x for r in done.correction.collect()}
    monkeypatch.setattr(lo, "WHOLE", 1)
    assert got == pytest.approx({r.cell: r.x for r in tg.step(model, seen, stations, s).correction.collect()}, rel=1e-5, abs=1e-12) and any(got.values())


def test_the_log_of_a_cycle_makes_its_residuals_once(spark, tb, monkeypatch):
    from tremolite import registry
    from tremolite.registry import inversion as ri

    calls, keep = [], ri.residuals
    monkeypatch.setattr(ri, "residuals", lambda t: calls.append(1) or keep(t))
    registry.load()
    assert registry.QUERIES["append_run_log"](spark, tb.sf_dir).groupBy("table").count().count() == 6
    assert len(calls) == 1


def test_misfit_needs_every_station_and_a_time(spark):
    """A cell that one station only knows, and an observation without a time, must not win."""
    observed = spark.createDataFrame([(1, s, t) for s, t in ((1, 10.0), (2, 11.0), (3, 12.1), (4, None))], "event_id long, station_id long, t_obs double")
    cells = [(s, 0, 0, 0, t) for s, t in ((1, 1.0), (2, 2.0), (3, 3.0))] + [(1, 4, 4, 4, 46.0), (2, 4, 4, 4, None)]
    field = spark.createDataFrame(cells, "station_id long, i int, j int, k int, t double")
    got = lo.pairwise_misfit(observed, field).collect()
    assert [(r.i, r.misfit) for r in got] == [(0, pytest.approx(0.02))]
    w = lo.locate_events(observed, field, top_n=3).collect()
    assert [(r.i, r.weight) for r in w] == [(0, 1.0)]


def test_shared_folder_is_never_made_up():
    from types import SimpleNamespace

    from tremolite.session import shared_folder

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        shared_folder(bare)
