"""Space-time node grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import json_path, nan_as_text
from ..operators import catalogue as cat, nodes as nd, ranking as rk
from ..plans import experiment as ex
from . import r, register, fine
from .catalogue import REGION_INPUTS, REGION_PAIRS
from .sqltext import haversine, fine as st

GRID = nd.NodeGrid(50.0, 57.0, 156.0, 166.0, 29, 36, "1995-01-01", "2001-08-01", 49)
# The same axes for the checking engine; one node row per combination.
LATS = "select i as ix, 50 + i*(7.0e0/28) as lat from range(29) t(i)"
LONS = "select i as iy, 156 + i*(10.0e0/35) as lon from range(36) t(i)"
SPAN_US = 207705600000000
TIMES = f"select i as it, 788918400000000 + i*{SPAN_US}.0e0/48 as us from range(49) t(i)"
WINDOW_US = 150 * 86400 * 1000000


def near(lat: str, lon: str, km: int) -> str:
    return (
        f"n.lat between {lat} - {km}/111.0e0 and {lat} + {km}/111.0e0 and n.lon between {lon} - {km}/(111.0e0*cos(radians({lat}))) "
        f"and {lon} + {km}/(111.0e0*cos(radians({lat}))) and {haversine(lat, lon, 'n.lat', 'n.lon')} <= {km}"
    )


NODES = f"(select * from ({LATS}) a cross join ({LONS}) b)"


@register(
    "make_grid",
    f"""select q.month, n.ix, n.iy, n.lat, n.lon from (select distinct cast(date_trunc('month', event_dttm) as date) as month from in_quakes) q
    cross join {NODES} n""",
    "quakes",
)
def make_grid(tb):
    """The spatial nodes of a frame series, one frame per month with a quake."""
    months = tb.quakes.select(F.trunc(F.col("event_dttm").cast("date"), "month").alias("month")).distinct()
    nodes = months.withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(GRID.n_lat - 1)))).withColumn(
        "iy", F.explode(F.sequence(F.lit(0), F.lit(GRID.n_lon - 1)))
    )
    return nodes.select("month", "ix", "iy", GRID.lat().alias("lat"), GRID.lon().alias("lon"))


STAMP = "make_timestamp(cast(round_even(us, 0) as bigint)) as dttm"


@register(
    "grid_node",
    f"""select o_orderkey as event_id, n.ix, n.iy, t.it, n.lat, n.lon, {STAMP} from orders join {NODES} n
      on n.ix = o_orderkey % 29 and n.iy = o_custkey % 36 join ({TIMES}) t on t.it = (o_orderkey + o_custkey) % 49""",
)
def grid_node(tb):
    """Position and time of the node named by each row's indices."""
    idx = tb.table("orders").select(
        F.col("o_orderkey").alias("event_id"), (F.col("o_orderkey") % 29).cast("int").alias("ix"),
        (F.col("o_custkey") % 36).cast("int").alias("iy"), ((F.col("o_orderkey") + F.col("o_custkey")) % 49).cast("int").alias("it"),
    )
    return GRID.locate(idx).select("event_id", "ix", "iy", "it", "lat", "lon", "dttm")


def _day_counts(tb):
    """Number of quakes per nearest-earlier time node."""
    at = F.floor((nd.epoch_micros("event_dttm") - GRID.start_us) / (GRID.span_us / 48)).cast("int")
    return tb.quakes.groupBy(at.alias("it")).agg(F.count(F.lit(1)).alias("n_quakes"))


def _counted(tb, nodes):
    """Every node with its number of quakes; 0 where its time has none."""
    return nodes.join(_day_counts(tb), "it", "left").withColumn("n_quakes", F.coalesce("n_quakes", F.lit(0)))


COUNTS = f"(select cast(floor((epoch_us(event_dttm) - 788918400000000)/({SPAN_US}.0e0/48)) as int) as it, count(*) n_quakes from in_quakes group by 1)"


@register(
    "grid_all",
    f"select coalesce(c.n_quakes, 0) as n_quakes, n.ix, n.iy, t.it, n.lat, n.lon, {STAMP} from {NODES} n cross join ({TIMES}) t left join {COUNTS} c on c.it = t.it",
    "quakes",
)
def grid_all(tb):
    return _counted(tb, GRID.nodes(tb.spark)).select("n_quakes", "ix", "iy", "it", "lat", "lon", "dttm")


@register(
    "grid_time_slice",
    f"select coalesce(c.n_quakes, 0) as n_quakes, n.ix, n.iy, t.it, n.lat, n.lon, {STAMP} from {NODES} n cross join ({TIMES}) t left join {COUNTS} c on c.it = t.it where t.it = 20",
    "quakes",
)
def grid_time_slice(tb):
    cols = ["n_quakes", "ix", "iy", "it", "lat", "lon", "dttm"]
    return _counted(tb, GRID.time_slice(tb.spark, 20)).select(*cols)


@register(
    "grid_point_series",
    f"select coalesce(c.n_quakes, 0) as n_quakes, t.it, n.lat, n.lon, {STAMP} from {NODES} n cross join ({TIMES}) t left join {COUNTS} c on c.it = t.it where n.ix = 4 and n.iy = 7",
    "quakes",
)
def grid_point_series(tb):
    return _counted(tb, GRID.point_series(tb.spark, 4, 7)).select("n_quakes", "it", "lat", "lon", "dttm")


@register(
    "radius_join_nodes",
    f"select q.event_id, n.ix, n.iy from in_quakes q join {NODES} n on {near('q.lat', 'q.lon', 70)}",
    "quakes",
)
def radius_join_nodes(tb):
    return nd.nodes_in_radius(tb.quakes, GRID, "lon", "lat", 70.0).select("event_id", "ix", "iy")


@register(
    "node_runs",
    f"""with hit as (select q.station_nm, q.network_nm, n.ix, n.iy from in_stations q join {NODES} n on {near('q.lat', 'q.lon', 200)})
    select station_nm, network_nm, ix, min(iy) iy_start, max(iy) iy_end from (select *, iy - row_number() over
      (partition by station_nm, network_nm, ix order by iy) g from hit) z group by station_nm, network_nm, ix, g""",
    "stations",
)
def node_runs(tb):
    stations = nd.dealt(tb.stations, cat.STATION_KEY)
    nodes = nd.nodes_in_radius(stations, GRID, "lon", "lat", 200.0)
    return nd.node_runs(nodes, ["station_nm", "network_nm"])


@register(
    "node_intersect",
    f"""with en as (select q.event_id, n.ix, n.iy from in_quakes q join {NODES} n on {near('q.lat', 'q.lon', 70)}),
    sn as (select q.station_nm, q.network_nm, n.ix, n.iy from in_stations q join {NODES} n on {near('q.lat', 'q.lon', 200)}),
    pr as (select distinct event_id, station_nm, network_nm from in_arrivals)
    select pr.event_id, pr.station_nm, pr.network_nm, count(*) n_nodes, sum(en.ix) sum_ix, sum(en.iy) sum_iy
    from pr join en on en.event_id = pr.event_id join sn on sn.station_nm = pr.station_nm and sn.network_nm = pr.network_nm
      and sn.ix = en.ix and sn.iy = en.iy group by all""",
    "quakes stations arrivals",
)
def node_intersect(tb):
    """Nodes shared by the quake's and the station's disk, counted per recorded pair."""
    pairs = tb.arrivals.select("event_id", *cat.STATION_KEY).distinct()
    s = tb.stations.dropna(subset=["lon", "lat"]).select(*cat.STATION_KEY, F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"))
    q = tb.quakes.dropna(subset=["lon", "lat"]).select("event_id", F.col("lon").alias("e_lon"), F.col("lat").alias("e_lat"))
    # The quake comes last: rows by quake stay where they are when a pair's grid rows are opened and counted.
    rows = nd.shared_rows(pairs.join(s, cat.STATION_KEY).join(q, "event_id"), GRID, 70.0, 200.0)
    width = (F.col("iy_end") - F.col("iy_start") + 1).cast("long")
    return rows.groupBy("event_id", *cat.STATION_KEY).agg(
        F.sum(width).alias("n_nodes"),
        F.sum(width * F.col("ix")).alias("sum_ix"),
        F.sum((width * (F.col("iy_start") + F.col("iy_end")) / 2).cast("long")).alias("sum_iy"),
    )


@register(
    "time_interval_join",
    f"""select q.event_id, t.it from in_quakes q join ({TIMES}) t
      on t.us between epoch_us(q.event_dttm) - {WINDOW_US} and epoch_us(q.event_dttm) + {WINDOW_US}""",
    "quakes",
)
def time_interval_join(tb):
    return nd.time_nodes(tb.quakes, GRID, "event_dttm", 150).select("event_id", "it")


SPREAD = f"""with pairs as ({REGION_PAIRS}),
  g as (select region_nm, min(x1) lon_min, max(x1) lon_max, min(y1) lat_min, max(y1) lat_max from in_region_edges group by 1),
  n as (select g.region_nm, a.i as ix, b.i as iy, g.lat_min + a.i*((g.lat_max-g.lat_min)/26) as lat,
          g.lon_min + b.i*((g.lon_max-g.lon_min)/35) as lon from g cross join range(27) a(i) cross join range(36) b(i)),
  t as (select i as it, 825638400000000 + round_even(i*144633600000000.0e0/47, 0) as us from range(48) z(i)),
  en as (select distinct q.region_nm, q.event_id, n.ix, n.iy, n.lat, n.lon from (select distinct region_nm, event_id, e_lon, e_lat from pairs) q
         join n on n.region_nm = q.region_nm and {near('q.e_lat', 'q.e_lon', 70)}),
  sn as (select distinct q.region_nm, q.station_nm, q.network_nm, n.ix, n.iy from (select distinct region_nm, station_nm, network_nm, s_lon, s_lat from pairs) q
         join n on n.region_nm = q.region_nm and {near('q.s_lat', 'q.s_lon', 200)}),
  m as (select p.region_nm, en.ix, en.iy, t.it, en.lat, en.lon, t.us, p.delta_t_p, p.delta_t_s from pairs p
        join en on en.region_nm = p.region_nm and en.event_id = p.event_id
        join sn on sn.region_nm = p.region_nm and sn.station_nm = p.station_nm and sn.network_nm = p.network_nm and sn.ix = en.ix and sn.iy = en.iy
        join t on t.us between epoch_us(p.event_dttm) - {WINDOW_US} and epoch_us(p.event_dttm) + {WINDOW_US})
"""
EXPERIMENT = ex.Experiment("1996-03-01", "2000-09-30", 27, 36, 48, 70.0, 200.0, 150.0)


def _moments(tb):
    return ex.node_moments(EXPERIMENT, tb.quakes, tb.arrivals, tb.stations, tb.regions)


@register(
    "spread_to_nodes",
    SPREAD
    + f"""select region_nm, ix, iy, it, count(*) n, sum(cast(round(delta_t_p*1e6) as bigint))::bigint sx, sum(cast(round(delta_t_s*1e6) as bigint))::bigint sy,
    min(delta_t_p) p_min, max(delta_t_s) s_max from m group by region_nm, ix, iy, it""",
    REGION_INPUTS,
)
def spread_to_nodes(tb):
    return _moments(tb).select("region_nm", "ix", "iy", "it", "n", "sx", "sy", "p_min", "s_max")


# Sums of whole microseconds and of their products are exact in both engines.
FIT = """select *, case when cxx > 0 then cxy/cxx end slope, case when cxx = 0 then null when cyy = 0 then 0.0e0 else rv*rv end r2,
  my - cxy/nullif(cxx, 0)*mx icpt from (select *, greatest(-1.0e0, least(1.0e0, cxy/sqrt(nullif(cxx*cyy, 0)))) rv from (
  select region_nm, ix, iy, it, lat, lon, us, n, sx::double/n/1e6 mx, sy::double/n/1e6 my, (n*sxx - sx*sx)::double/n/1e12 cxx, (n*syy - sy*sy)::double/n/1e12 cyy,
    (n*sxy - sx*sy)::double/n/1e12 cxy, p_min, p_max, s_min, s_max from (
  select region_nm, ix, iy, it, lat, lon, us, count(*) n, sum(x)::hugeint sx, sum(y)::hugeint sy, sum(x*x)::hugeint sxx, sum(y*y)::hugeint syy, sum(x*y)::hugeint sxy,
    min(delta_t_p) p_min, max(delta_t_p) p_max, min(delta_t_s) s_min, max(delta_t_s) s_max
  from (select *, round(delta_t_p*1e6)::bigint x, round(delta_t_s*1e6)::bigint y from m) w group by region_nm, ix, iy, it, lat, lon, us) z0) z1) z2"""


@register(
    "node_stats",
    SPREAD
    + f"""select region_nm, ix, iy, it, n n_measurements, {st('my', 5)} s_mean, {st('sqrt(greatest(cyy/n, 0))', 5)} s_std, s_min, s_max,
    {st('mx', 5)} p_mean, {st('sqrt(greatest(cxx/n, 0))', 5)} p_std, p_min, p_max from ({FIT}) f""",
    REGION_INPUTS,
)
def node_stats(tb):
    return nd.node_stats(_moments(tb)).select(
        "region_nm", "ix", "iy", "it", "n_measurements", fine("s_mean", 5), fine("s_std", 5), "s_min", "s_max",
        fine("p_mean", 5), fine("p_std", 5), "p_min", "p_max",
    )


@register(
    "node_regression",
    SPREAD
    + f"""select region_nm, ix, iy, it, n as n_measurements, {st('slope', 5)} slope, {st('icpt', 5)} intercept, {st('r2', 5)} r_squared,
    case when slope is null then null when n = 2 then 0.0e0 else {st('sqrt((1-r2)*cyy/cxx/(n-2))', 5)} end stderr,
    case when n < 2 then 'insufficient_data' when slope is null then 'identical_p_times' end error from ({FIT}) f""",
    REGION_INPUTS,
)
def node_regression(tb):
    fit = nd.node_regression(nd.node_stats(_moments(tb)))
    return fit.select(
        "region_nm", "ix", "iy", "it", "n_measurements", fine("slope", 5), fine("intercept", 5), fine("r_squared", 5),
        fine("stderr", 5), "error",
    )


# Student's t for whole degrees of freedom d is a finite sum of powers of cos(angle), angle = atan(t / sqrt(d)).
_TERM = "exp(lgamma(m + {a}e0) - lgamma(m + {b}e0)) * pow(c, 2*m + {s})"
P_VALUE = f"""case when slope is null then null when dof = 0 then case when flat then 1.0e0 else 0.0e0 end when r2 >= 1 then 0.0e0
  when dof % 2 = 0 then 1 - sn*coalesce(list_sum(list_transform(range(dof // 2), lambda m: {_TERM.format(a=0.5, b=1, s=0)} / sqrt(pi()))), 0)
  else 1 - 2/pi()*(an + sn*coalesce(list_sum(list_transform(range((dof - 1) // 2), lambda m: {_TERM.format(a=1, b=1.5, s=1)} * sqrt(pi())/2)), 0)) end"""


@register(
    "node_regression_pvalue",
    SPREAD
    + f"""select region_nm, ix, iy, it, dof, {st(P_VALUE, 4)} as p_value from (
      select *, atan(tt/sqrt(dof)) an, sin(atan(tt/sqrt(dof))) sn, cos(atan(tt/sqrt(dof))) c from (
      select region_nm, ix, iy, it, slope, n - 2 as dof, r2, cyy = 0 as flat, case when n > 2 and r2 < 1 then sqrt(r2)*sqrt((n-2)/(1-r2)) end tt from ({FIT}) f) g) h""",
    REGION_INPUTS,
)
def node_regression_pvalue(tb):
    fit = nd.regression_p_value(nd.node_regression(nd.node_stats(_moments(tb))))
    return fit.select("region_nm", "ix", "iy", "it", "dof", r("p_value"))


@register(
    "vp_vs_experiment",
    SPREAD
    + f"""select region_nm, ix, iy, it, round(lat,6) lat, round(lon,6) lon, make_timestamp(cast(round_even(us,0) as bigint)) dttm,
    n as n_measurements, {st('my', 5)} s_mean, {st('mx', 5)} p_mean, {st('slope', 5)} slope, {st('icpt', 5)} intercept from ({FIT}) f""",
    REGION_INPUTS,
)
def vp_vs_experiment(tb):
    """Flagship: travel times by region, spread over the node grid, regressed per node, in storage order."""
    fit = ex.fit_nodes(EXPERIMENT, tb.quakes, tb.arrivals, tb.stations, tb.regions, with_p=False)
    return (
        EXPERIMENT.grid()
        .locate(fit)
        .select(
            "region_nm", "ix", "iy", "it", r("lat"), r("lon"), "dttm", "n_measurements", fine("s_mean", 5),
            fine("p_mean", 5), fine("slope", 5), fine("intercept", 5),
        )
        .orderBy("region_nm", "it", "ix", "iy")
    )


# --- stored nodes ------------------------------------------------------------------------------------------------


@register(
    "sorted_nodes",
    "select it, ix, iy, experiment_nm from in_experiment_nodes",
    "experiment_nodes",
)
def sorted_nodes(tb):
    return tb.experiment_nodes.select("it", "ix", "iy", "experiment_nm").orderBy("it", "ix", "iy")


@register(
    "json_path",
    """select event_id, cast(props->>'$.k' as int) as k, props->>'$.missing.k' as missing, event_type from events""",
)
def json_path_query(tb):
    return tb.table("events").select(
        "event_id", json_path("props", "k").cast("int").alias("k"), json_path("props", "missing", "k").alias("missing"),
        "event_type",
    )


@register(
    "json_build",
    """select ix, iy, it, cast(params->>'$.lon' as double) lon, cast(params->>'$.n_measurements' as int) n,
    case when params->>'$.linear_regression.slope' = 'Nan' then 'NaN' else params->>'$.linear_regression.slope' end slope
    from in_experiment_nodes where experiment_nm = 'exp_2'""",
    "experiment_nodes",
)
def json_build(tb):
    """Build the nested document with NaN as text, and read the parts back."""
    nodes = cat.experiment_nodes(tb.experiment_nodes, "exp_2")
    slope = F.coalesce("slope", F.lit(float("nan")))
    doc = F.to_json(
        F.struct(
            "lon", "n_measurements",
            F.struct(nan_as_text(slope).alias("slope")).alias("linear_regression"),
        )
    )
    built = nodes.select("ix", "iy", "it", doc.alias("doc"))
    return built.select(
        "ix", "iy", "it", json_path("doc", "lon").cast("double").alias("lon"),
        json_path("doc", "n_measurements").cast("int").alias("n"), json_path("doc", "linear_regression", "slope").alias("slope"),
    )


@register(
    "frame_index",
    """select event_id, dense_rank() over (order by cast(ts as date)) - 1 as frame, cast(ts as date) as dt from events""",
)
def frame_index(tb):
    days = tb.table("events").select("event_id", F.col("ts").cast("date").alias("dt"))
    return rk.frame_index(days, "dt").select("event_id", "frame", "dt")


@register(
    "extent_margin",
    """select min(lon) - (max(lon)-min(lon))*0.1 lon_lo, max(lon) + (max(lon)-min(lon))*0.1 lon_hi,
    min(lat) - (max(lat)-min(lat))*0.1 lat_lo, max(lat) + (max(lat)-min(lat))*0.1 lat_hi, min(slope) vmin, max(slope) vmax
    from (select cast(params->>'$.lon' as double) lon, cast(params->>'$.lat' as double) lat,
      case when params->>'$.linear_regression.slope' <> 'Nan' then cast(params->>'$.linear_regression.slope' as double) end slope
      from in_experiment_nodes where experiment_nm = 'exp_1') z where slope is not null""",
    "experiment_nodes",
)
def extent_margin(tb):
    from ..operators.measures import extent

    return extent(cat.experiment_nodes(tb.experiment_nodes, "exp_1"), "slope")
