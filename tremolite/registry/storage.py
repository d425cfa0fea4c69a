"""Sources, sinks, stored models and run logs: each query writes to the shared folder and reads back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import catalogue as cat, location as lo
from ..plans import experiment as ex, tomography as tg
from ..session import scratch_path
from ..sources import runlog as rl, tables as tab
from . import r, register
from .catalogue import days
from .inversion import SUMS_SQL

ID = ["model_id", "i", "j", "k"]
GEOMETRY = {"lon": 161.0, "lat": 53.5, "height": 100.0, "azimuth": 0.0, "side_size": 500.0}


@register(
    "scan_catalogue",
    "select o_orderkey as event_id, o_totalprice as size, o_orderdate as event_dttm from orders where o_orderstatus = 'F' and o_orderdate >= timestamp '1997-01-01'",
)
def scan_catalogue(tb):
    """A parameterised query text; filter and columns reach the scan."""
    return tab.run_query(
        tb.spark,
        "select o_orderkey as event_id, o_totalprice as size, o_orderdate as event_dttm from orders_table where o_orderstatus = :status and o_orderdate >= cast(:since as timestamp_ntz)",
        {"orders_table": tb.table("orders")}, status="F", since="1997-01-01",
    )


@register(
    "append_table",
    "select event_id, depth, lon, lat, event_type_certainty from in_quakes",
    "quakes",
)
def append_table(tb):
    """Two appends that together make the whole table."""
    path = scratch_path(tb.spark, "quakes")
    cols = ["event_id", "depth", "lon", "lat", "event_type_certainty"]
    for certainty in ("known", "suspected"):
        tab.append_table(tb.quakes.select(*cols).filter(F.col("event_type_certainty") == certainty), path, ["event_type_certainty"])
    return tb.spark.read.parquet(path).select(*cols)


@register(
    "append_points",
    "select station_nm, network_nm, 'SRID=4326;POINT ('||cast(lon as varchar)||' '||cast(lat as varchar)||')' as geometry from in_stations",
    "stations",
)
def append_points(tb):
    path = scratch_path(tb.spark, "points")
    tab.append_points(tb.stations, path)
    return tb.spark.read.parquet(path)


EVENT_COLUMNS = {"event_id": "bigint", "pick_id": "bigint", "arrival_dttm": "timestamp_ntz", "model_s": "double", "deviation_fmm_x_mean": "double"}


def _event_tables(tb) -> str:
    path = scratch_path(tb.spark, "events")
    rows = tb.arrivals.filter("arrival_dttm is not null").select(
        "event_id", "pick_id", "arrival_dttm", (F.col("pick_id") % 1000 / 8).alias("model_s"),
        (F.col("pick_id") % 64 / 16 - 2).alias("deviation_fmm_x_mean"),
    )
    tab.write_event_tables(rows, path, ["arrival_dttm", "pick_id"])
    return path


EVENT_SQL = "select event_id, pick_id, arrival_dttm, (pick_id % 1000)/8.0e0 as model_s, (pick_id % 64)/16.0e0 - 2 as deviation_fmm_x_mean from in_arrivals where arrival_dttm is not null"


@register("write_event_tables", EVENT_SQL, "arrivals")
def write_event_tables(tb):
    path = _event_tables(tb)
    schema = ", ".join(f"{c} {t}" for c, t in EVENT_COLUMNS.items())
    return tb.spark.read.schema(schema).option("header", True).csv(path)


@register(
    "scan_event_tables",
    f"select event_id, count(*) n, min(arrival_dttm) first_dttm, round(sum(deviation_fmm_x_mean), 6) total, cast(1 as bigint) n_skipped from ({EVENT_SQL}) z group by 1",
    "arrivals",
)
def scan_event_tables(tb):
    """Tables with the required columns summarised per quake; a folder of other CSV files is skipped."""
    path = _event_tables(tb)
    other = tb.stations.select("station_nm", "lon").coalesce(1)
    other.write.mode("append").option("header", True).csv(path)
    rows, skipped = tab.scan_event_tables(tb.spark, path, EVENT_COLUMNS, ["arrival_dttm", "deviation_fmm_x_mean"])
    n = skipped.agg(F.count(F.lit(1)).alias("n_skipped"))
    per_event = rows.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("arrival_dttm").alias("first_dttm"), F.round(F.sum("deviation_fmm_x_mean"), 6).alias("total")
    )
    return per_event.join(F.broadcast(n), F.lit(True))


@register(
    "scan_run_jsonl",
    "select iter, elapsed_s, (select count(*) from in_run_iterations where elapsed_s > 90) as dropped from in_run_iterations",
    "run_iterations",
)
def scan_run_jsonl(tb):
    """Timing lines, of which some are torn."""
    path = scratch_path(tb.spark, "timing")
    rl.write_jsonl(tb.run_iterations.select("iter", "elapsed_s"), path)
    torn = tb.run_iterations.filter("elapsed_s > 90").select(F.concat(F.lit('{"iter": '), F.col("iter").cast("string"), F.lit(', "ela')).alias("value"))
    torn.write.mode("append").text(path)
    good, dropped = rl.scan_jsonl(tb.spark, path, rl.TIMING)
    return good.join(F.broadcast(dropped), F.lit(True)).select("iter", "elapsed_s", "dropped")


@register("model_json_to_cells", "select model_id, i, j, k, round(vp, 6) vp, round(vs, 6) vs from in_cells", "cells")
def model_json_to_cells(tb):
    """Cells to JSON documents and back."""
    docs = tab.cells_to_models(tb.cells, ["model_id"], GEOMETRY)
    return tab.models_to_cells(tab.parse_models(docs, "doc"), ["model_id"]).select(*ID, r("vp"), r("vs"))


@register(
    "cells_to_model_json",
    """select c.model_id, 161.0e0 lon, 500.0e0 side_size, 10 as n_x, 10 as n_y, max(k) + 1 n_z, round(max(case when i = 2 and j = 3 and k = 0 then vp end), 6) v230,
    count(*) n_cells from in_cells c group by 1""",
    "cells",
)
def cells_to_model_json(tb):
    """One document per model; single values are read back by path."""
    docs = tab.cells_to_models(tb.cells, ["model_id"], GEOMETRY)
    parsed = tab.parse_models(docs, "doc")
    size = F.size(F.flatten(F.flatten("data.vp"))).cast("long")
    return parsed.select(
        "model_id", "lon", "side_size", "n_x", "n_y", "n_z", r(F.col("data.vp")[2][3][0], 6, "v230"), size.alias("n_cells")
    )


@register(
    "model_snapshot",
    """select c.model_id, c.i, c.j, c.k, 2 as version, t.vp from in_cells c join in_true_cells t
      on t.model_id = c.model_id and t.i = c.i and t.j = c.j and t.k = c.k""",
    "cells true_cells",
)
def model_snapshot(tb):
    """Two saves of every model; loading gives the second."""
    path = scratch_path(tb.spark, "models")
    tab.save_model_version(tb.cells, path, "model_id")
    tab.save_model_version(tb.true_cells, path, "model_id")
    return tab.load_model(tb.spark, path, "model_id").select(*ID, "version", "vp")


FILE_SQL = "'models/m'||cast(o_custkey % 9 as varchar)||'/model_v'||cast(o_orderkey as varchar)||'.npz'"


@register(
    "latest_version",
    f"""select model, file from (select 'm'||cast(o_custkey % 9 as varchar) as model, {FILE_SQL} as file,
      row_number() over (partition by o_custkey % 9 order by o_orderkey desc) rn from orders) z where rn = 1""",
)
def latest_version(tb):
    model = F.concat(F.lit("m"), (F.col("o_custkey") % 9).cast("string"))
    files = tb.table("orders").select(
        model.alias("model"), F.concat(F.lit("models/"), model, F.lit("/model_v"), F.col("o_orderkey").cast("string"), F.lit(".npz")).alias("file")
    )
    other = files.withColumn("file", F.regexp_replace("file", "_v.*", "_draft.npz"))
    return tab.latest_file(files.unionByName(other), ["model"])


@register(
    "append_run_log",
    f"""with {SUMS_SQL}, mean as (select i % 5 i, j % 5 j, k, avg(vp) v from in_cells group by 1, 2, 3)
    select 'run_1' as run_id, 1 as iter, name as "table", a, cell, round(v, 5) as value from (
      select 'model' as name, null::bigint as a, (i*25+j*5+k)::bigint as cell, coalesce(v, 5000) as v from (select i, j, k from range(5) x(i), range(5) y(j), range(5) z(k)) g left join mean using (i, j, k)
      union all select distinct 'delta_s', null, cell, null from s union all select 'weights', event_id, (i*25+j*5+k)::bigint, misfit from bc
      union all select 'residuals', event_id, station_id, r from rs union all select 'ray_sums', station_id, cell, s from s union all select 'timing', null, null, null) u""",
    "observed lattice_times cells",
)
def append_run_log(tb):
    """A cycle on the stored fields that is logged twice, and the rows that count; of corrections and timings only their places."""
    from ..session import materialise
    from .inversion import lattice_model, residuals, solved, sums

    best = materialise(lo.best_cells(tb.observed, tb.lattice_times, decimals=9).withColumn("weight", F.lit(1.0)), "weights")
    rows = materialise(residuals(tb), "residuals")
    s, right = sums(tb, rows)
    s, right = materialise(s, "sums"), materialise(right, "right")
    cycle = tg.Step(tb.lattice_times, best, rows, s, right, materialise(solved(s, right), "delta"))
    log = rl.RunLog(tb.spark, scratch_path(tb.spark, "run"), "run_1")
    log.meta({"cycles": 1, "lambda_reg": 0.1}, {"coarse_cell_size": 500.0})
    broken = tg.Step(cycle.fields, best.limit(5), cycle.residuals.limit(7), s.limit(3), right, cycle.correction.limit(2))
    for done in (broken, cycle):
        log.cycle(1, lattice_model(tb), done)
    number, none = (F.col("i") * 25 + F.col("j") * 5 + F.col("k")).cast("long"), F.lit(None)
    parts = {
        "model": (none, number, F.col("vp")), "delta_s": (none, F.col("cell"), none), "weights": (F.col("event_id"), number, F.col("misfit")),
        "residuals": (F.col("event_id"), F.col("station_id"), F.col("r")), "ray_sums": (F.col("station_id"), F.col("cell"), F.col("s")), "timing": (none, none, none),
    }
    rows = [
        log.read(t).select("run_id", "iter", F.lit(t).alias("table"), a.cast("long").alias("a"), c.cast("long").alias("cell"), F.round(v.cast("double"), 5).alias("value"))
        for t, (a, c, v) in parts.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


@register(
    "append_experiment",
    f"select 'exp_all_1996-03-01_2000-09-30' as experiment_nm, count(*) as n_quakes, 2 as n_runs from in_quakes where {days('event_dttm')}",
    "quakes",
)
def append_experiment(tb):
    """Two registered runs whose nodes hold the number of quakes per node; read back by experiment."""
    from .nodes import EXPERIMENT

    folder = scratch_path(tb.spark, "experiments")
    q = tb.quakes.filter(cat.in_days("event_dttm", "1996-03-01", "2000-09-30"))
    at = F.floor(F.col("depth") / 10000).cast("int")
    nodes = q.groupBy(at.alias("ix"), (F.col("event_id") % 7).cast("int").alias("iy")).agg(F.count(F.lit(1)).alias("n_measurements"))
    nodes = nodes.select(F.lit(EXPERIMENT.name()).alias("experiment_nm"), "ix", "iy", F.lit(0).alias("it"), F.struct("n_measurements").alias("params"))
    for _ in range(2):
        ex.append_experiment(EXPERIMENT, nodes, folder)
    runs = tb.spark.read.parquet(f"{folder}/experiments").groupBy("experiment_nm").agg(F.count(F.lit(1)).cast("int").alias("n_runs"))
    stored = tb.spark.read.parquet(f"{folder}/experiment_nodes")
    counts = stored.groupBy("experiment_nm").agg(
        (F.sum(F.get_json_object("params", "$.n_measurements").cast("long")) / 2).cast("long").alias("n_quakes")
    )
    return counts.join(runs, "experiment_nm")
