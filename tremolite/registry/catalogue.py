"""Catalogue queries, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import travel_seconds, wave_subtype
from ..operators import catalogue as cat, predicates as pre
from ..operators.predicates import Box
from . import r, register
from .sqltext import haversine, inside, mercator_distance, seconds

BOX = Box(164.0, 51.0, 158.0, 56.0)
DAYS = ("1996-03-01", "2000-09-30")
IN_BOX = "{lon} between 158 and 164 and {lat} between 51 and 56"
IN_DAYS = "cast({t} as date) between date '1996-03-01' and date '2000-09-30'"
PAIRED = "('P','S','Pg','Sg','Pn','Sn','Pb','Sb')"
SUBTYPE = (
    "case when a.arrival_type like '%g' then 'g' when a.arrival_type like '%n' then 'n' "
    "when a.arrival_type like '%b' then 'b' end"
)
TRAVEL = seconds("e.event_dttm", "a.arrival_dttm")
STAR = """in_quakes e join in_arrivals a on a.event_id = e.event_id
  join in_stations s on s.station_nm = a.station_nm and s.network_nm = a.network_nm"""


def box(prefix: str) -> str:
    return IN_BOX.format(lon=f"{prefix}lon", lat=f"{prefix}lat")


def days(t: str) -> str:
    return IN_DAYS.format(t=t)


@register(
    "arrivals_in_bbox",
    f"""select round(e.lon,6) event_lon, round(e.lat,6) event_lat, e.depth event_depth, a.arrival_type,
      round({TRAVEL},6) travel_s, round(s.lon,6) station_lon, round(s.lat,6) station_lat
    from {STAR} where {days('e.event_dttm')} and {box('e.')} and {box('s.')} and e.depth > 0
      and a.arrival_dttm is not null and a.arrival_type in ('P','S','Pg','Sg')""",
    "quakes arrivals stations",
)
def arrivals_in_bbox(tb):
    out = cat.arrivals_in_box(tb.quakes, tb.arrivals, tb.stations, *DAYS, BOX)
    interval_s = F.col("actual_time_diff").cast("interval second").cast("decimal(20,6)").cast("double")
    return out.select(
        r("event_lon"), r("event_lat"), "event_depth", "arrival_type", r(interval_s, 6, "travel_s"),
        r("station_lon"), r("station_lat"),
    )


@register(
    "event_lookup",
    """select e.event_id, e.depth, e.lon, e.lat from in_quakes e
    where e.event_id in (select event_id from in_travel_times where experiment_nm = 'exp_1')""",
    "quakes travel_times",
)
def event_lookup(tb):
    return cat.lookup_quakes(tb.quakes, cat.travel_times_of(tb.travel_times, "exp_1"))


@register(
    "station_lookup",
    """select station_nm, network_nm, 0.0e0 as depth, lon, lat from in_stations
    where (station_nm, network_nm) in (select station_nm, network_nm from in_arrivals where arrival_type = 'Sn')""",
    "stations arrivals",
)
def station_lookup(tb):
    return cat.lookup_stations(tb.stations, tb.arrivals.filter(F.col("arrival_type") == "Sn"))


@register(
    "arrivals_by_event",
    """select a.event_id, s.lon, s.lat, a.arrival_dttm from in_arrivals a join in_stations s
      on s.station_nm = a.station_nm and s.network_nm = a.network_nm""",
    "arrivals stations",
)
def arrivals_by_event(tb):
    """The per-quake lookup for all quakes at once, ordered within each quake."""
    out = cat.arrivals_with_stations(tb.arrivals, tb.stations).select("event_id", "lon", "lat", "arrival_dttm")
    return out.orderBy("event_id", "arrival_dttm")


CYLINDER = dict(lon=160.5, lat=53.5, depth=45000.0, radius=450000.0, min_mag=1.5, min_stations=2, year=1996)


@register(
    "events_in_cylinder",
    f"""select e.event_id, e.event_type, e.event_type_certainty, e.lon, e.lat, e.depth, e.event_dttm,
      count(distinct s.station_nm) as n_stations
    from {STAR} where e.depth < 45000 and e.event_type_certainty = 'known' and year(e.event_dttm) >= 1996
      and e.event_id in (select event_id from in_magnitudes where mag_value >= 1.5)
      and {mercator_distance('160.5e0', '53.5e0', 'e.lon', 'e.lat')} < 450000
      and {mercator_distance('160.5e0', '53.5e0', 's.lon', 's.lat')} < 450000
    group by all having count(distinct s.station_nm) >= 2""",
    "quakes magnitudes arrivals stations",
)
def events_in_cylinder(tb):
    return cat.quakes_in_cylinder(tb.quakes, tb.magnitudes, tb.arrivals, tb.stations, **CYLINDER)


@register(
    "events_in_bbox",
    f"""select lon event_lon, lat event_lat, depth event_depth, event_dttm from in_quakes
    where {days('event_dttm')} and {box('')}""",
    "quakes",
)
def events_in_bbox(tb):
    return cat.quakes_in_box(tb.quakes, *DAYS, BOX)


@register(
    "experiment_nodes",
    """select ix, iy, it, cast(params->>'$.lon' as double) lon, cast(params->>'$.lat' as double) lat,
      cast(cast(params->>'$.dttm' as timestamp) as date) dt, cast(params->>'$.n_measurements' as int) n_measurements,
      case when params->>'$.linear_regression.slope' <> 'Nan' then cast(params->>'$.linear_regression.slope' as double) end slope
    from in_experiment_nodes where experiment_nm = 'exp_1'""",
    "experiment_nodes",
)
def experiment_nodes(tb):
    return cat.experiment_nodes(tb.experiment_nodes, "exp_1")


@register(
    "travel_times_by_experiment",
    "select * from in_travel_times where experiment_nm = 'exp_2'",
    "travel_times",
)
def travel_times_by_experiment(tb):
    return cat.travel_times_of(tb.travel_times, "exp_2")


REGION_PAIRS = f"""select q.region_nm, e.event_id, s.station_nm, s.network_nm, e.lon e_lon, e.lat e_lat, s.lon s_lon, s.lat s_lat,
      {SUBTYPE} as wave_subtype, min(e.event_dttm) event_dttm,
      max(case when a.arrival_type like 'P%' then a.pick_id end) p_pick_id,
      max(case when a.arrival_type like 'S%' then a.pick_id end) s_pick_id,
      max(case when a.arrival_type like 'P%' then {TRAVEL} end) delta_t_p,
      max(case when a.arrival_type like 'S%' then {TRAVEL} end) delta_t_s
    from {STAR}
      join ({inside('in_quakes', 'lon', 'lat', 'p.event_id')}) q on q.event_id = e.event_id
      join ({inside('in_stations', 'lon', 'lat', 'p.station_nm, p.network_nm')}) w
        on w.station_nm = s.station_nm and w.network_nm = s.network_nm and w.region_nm = q.region_nm
    where a.arrival_type in {PAIRED} and {days('e.event_dttm')} and {TRAVEL} > 0
    group by all
    having max(case when a.arrival_type like 'P%' then a.pick_id end) is not null
       and max(case when a.arrival_type like 'S%' then a.pick_id end) is not null"""
REGION_INPUTS = "quakes arrivals stations region_edges"


@register("travel_times_by_region", REGION_PAIRS, REGION_INPUTS)
def travel_times_by_region(tb):
    return cat.travel_times_by_region(tb.quakes, tb.arrivals, tb.stations, tb.regions, *DAYS)


@register(
    "region_borders",
    """select g.region_nm, min(x1) lon_min, max(x1) lon_max, min(y1) lat_min, max(y1) lat_max, coalesce(min(n), 0) n_events
    from in_region_edges g left join (select region_nm, count(*) n from ("""
    + inside("in_quakes", "lon", "lat", "p.event_id")
    + """) z group by region_nm) c on c.region_nm = g.region_nm group by g.region_nm""",
    "region_edges quakes",
)
def region_borders(tb):
    """Borders, with the number of quakes inside."""
    q = cat.region_points(tb.quakes, tb.regions, "lon", "lat")
    counts = q.groupBy("region_nm").agg(F.count(F.lit(1)).alias("n_events"))
    out = cat.region_borders(tb.regions).join(counts, "region_nm", "left")
    return out.withColumn("n_events", F.coalesce("n_events", F.lit(0)))


BOX_PAIRS = f"""select e.event_id, s.station_nm, s.network_nm, {SUBTYPE} as wave_subtype, min(e.event_dttm) event_dttm,
      max(case when a.arrival_type like 'P%' then {TRAVEL} end) delta_t_p,
      max(case when a.arrival_type like 'S%' then {TRAVEL} end) delta_t_s
    from {STAR} where a.arrival_type in {PAIRED} and {days('e.event_dttm')}
      and e.lon > 158 and e.lon < 164 and e.lat > 51 and e.lat < 56
      and s.lon > 158 and s.lon < 164 and s.lat > 51 and s.lat < 56
    group by all"""


@register(
    "travel_times_bbox",
    f"select * from ({BOX_PAIRS}) p where delta_t_p >= 0 and delta_t_p < 500 and delta_t_s >= 0 and delta_t_s < 500",
    "quakes arrivals stations",
)
def travel_times_bbox(tb):
    return cat.travel_times_in_box(tb.quakes, tb.arrivals, tb.stations, *DAYS, BOX, 500.0)


RAW = f"""select e.event_id, e.lon event_lon, e.lat event_lat, e.depth event_depth, s.station_nm, s.network_nm,
      a.arrival_dttm, e.event_dttm, s.lon station_lon, s.lat station_lat, {TRAVEL} travel_time
    from {STAR} where e.lon is not null and s.lon is not null and a.arrival_dttm is not null and {days('e.event_dttm')}"""


@register("arrivals_raw", RAW, "quakes arrivals stations")
def arrivals_raw(tb):
    return cat.raw_arrivals(tb.quakes, tb.arrivals, tb.stations, *DAYS)


# --- filters -----------------------------------------------------------------------------------------------------


@register("bbox_filter", f"select event_id, lon, lat from in_quakes where {box('')}", "quakes")
def bbox_filter(tb):
    return tb.quakes.filter(BOX.touches("lon", "lat")).select("event_id", "lon", "lat")


@register("point_in_polygon", inside("in_stations", "lon", "lat", "p.station_nm, p.network_nm"), "stations region_edges")
def point_in_polygon(tb):
    out = cat.region_points(tb.stations, tb.regions, "lon", "lat")
    return out.select("station_nm", "network_nm", "region_nm")


@register("region_join", inside("in_quakes", "lon", "lat", "p.event_id, p.depth"), "quakes region_edges")
def region_join(tb):
    return cat.region_points(tb.quakes, tb.regions, "lon", "lat").select("event_id", "depth", "region_nm")


@register("date_range", f"select event_id, event_dttm from in_quakes where {days('event_dttm')}", "quakes")
def date_range(tb):
    return tb.quakes.filter(pre.in_days("event_dttm", *DAYS)).select("event_id", "event_dttm")


@register("year_floor", "select event_id, event_dttm from in_quakes where date_part('year', event_dttm) >= 1998", "quakes")
def year_floor(tb):
    return tb.quakes.filter(pre.since_year("event_dttm", 1998)).select("event_id", "event_dttm")


@register(
    "type_filter",
    f"""select a.pick_id, a.arrival_type, a.arrival_type like 'P%' as is_p, a.arrival_type like '%g' as is_g
    from in_arrivals a where a.arrival_type in ('P','S','Pg','Sg')""",
    "arrivals",
)
def type_filter(tb):
    t = F.col("arrival_type")
    return tb.arrivals.filter(t.isin(*cat.BOX_TYPES)).select(
        "pick_id", t, t.startswith("P").alias("is_p"), t.endswith("g").alias("is_g")
    )


@register(
    "positive_travel",
    f"""select a.event_id, a.pick_id, round({TRAVEL},6) as travel_s from in_quakes e
    join in_arrivals a on a.event_id = e.event_id where {TRAVEL} > 0""",
    "quakes arrivals",
)
def positive_travel(tb):
    both = tb.arrivals.join(tb.quakes.select("event_id", "event_dttm"), "event_id")
    return both.filter(pre.positive_travel("event_dttm", "arrival_dttm")).select(
        "event_id", "pick_id", r(travel_seconds("event_dttm", "arrival_dttm"), 6, "travel_s")
    )


@register(
    "not_null_rows",
    "select event_id, lon, lat, depth from in_quakes where lon is not null and lat is not null",
    "quakes",
)
def not_null_rows(tb):
    return tb.quakes.dropna(subset=["lon", "lat"]).select("event_id", "lon", "lat", "depth")


@register(
    "max_travel",
    "select event_id, pick_no, delta_t_p, delta_t_s from in_travel_times where delta_t_p >= 0 and delta_t_p < 40 and delta_t_s >= 0 and delta_t_s < 40",
    "travel_times",
)
def max_travel(tb):
    return tb.travel_times.filter(pre.travel_below(40.0, "delta_t_p", "delta_t_s")).select(
        "event_id", "pick_no", "delta_t_p", "delta_t_s"
    )


NODE_ROWS = """select ix, iy, it, cast(params->>'$.lon' as double) lon, cast(params->>'$.lat' as double) lat,
  cast(params->>'$.n_measurements' as int) n_measurements from in_experiment_nodes where experiment_nm = 'exp_0'"""


@register(
    "node_quality",
    f"select * from ({NODE_ROWS}) n where n_measurements >= 125 and it = 0",
    "experiment_nodes",
)
def node_quality(tb):
    nodes = cat.experiment_nodes(tb.experiment_nodes, "exp_0").drop("dt", "slope")
    return nodes.filter(pre.enough_measurements() & (F.col("it") == 0))


@register(
    "strip_filter",
    """select event_id, lon, lat from in_quakes where lon between 156 and 167 and lat between 48.5 and 58
      and lat - 0.86*lon >= -89 and lat - 0.86*lon <= -82""",
    "quakes",
)
def strip_filter(tb):
    keep = Box(156.0, 48.5, 167.0, 58.0).touches("lon", "lat") & pre.in_strip("lon", "lat")
    return tb.quakes.filter(keep).select("event_id", "lon", "lat")


@register(
    "unique_subset",
    """select event_id, station_nm, delta_t_p from (select *, row_number() over (partition by event_id
      order by station_nm, pick_no, delta_t_p, delta_t_s) rn from in_travel_times) t where rn = 1""",
    "travel_times",
)
def unique_subset(tb):
    return pre.first_per_key(
        tb.travel_times, ["event_id"], ["station_nm", "pick_no", "delta_t_p", "delta_t_s"],
        ["event_id", "station_nm", "delta_t_p"],
    )


# --- joins -------------------------------------------------------------------------------------------------------


@register(
    "star_join",
    f"select e.event_id, a.pick_id, a.arrival_type, e.depth, s.station_nm, s.network_nm, s.lon s_lon from {STAR}",
    "quakes arrivals stations",
)
def star_join(tb):
    s = tb.stations.select("station_nm", "network_nm", F.col("lon").alias("s_lon"))
    return cat.star_join(tb.quakes.select("event_id", "depth"), tb.arrivals, s).select(
        "event_id", "pick_id", "arrival_type", "depth", "station_nm", "network_nm", "s_lon"
    )


@register(
    "magnitude_semi",
    "select event_id, depth from in_quakes where event_id in (select event_id from in_magnitudes where mag_value >= 3)",
    "quakes magnitudes",
)
def magnitude_semi(tb):
    return cat.with_magnitude(tb.quakes, tb.magnitudes, 3.0).select("event_id", "depth")


@register(
    "radius_join_point",
    f"select event_id, lon, lat from in_quakes where {mercator_distance('160.5e0', '53.5e0', 'lon', 'lat')} < 300000",
    "quakes",
)
def radius_join_point(tb):
    near = cat.near_point("lon", "lat", 160.5, 53.5, 300000.0)
    return tb.quakes.filter(near).select("event_id", "lon", "lat")


@register(
    "having_distinct",
    f"""select a.event_id, count(distinct a.station_nm) n_stations from in_arrivals a
    group by a.event_id having count(distinct a.station_nm) >= 3""",
    "arrivals",
)
def having_distinct(tb):
    pairs = tb.arrivals.select("event_id", "station_nm").distinct()
    return pairs.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_stations")).filter("n_stations >= 3")


@register(
    "phase_pivot",
    f"""select a.event_id, a.station_nm, a.network_nm, {SUBTYPE} wave_subtype,
      max(case when a.arrival_type like 'P%' then a.pick_id end) p_pick_id,
      max(case when a.arrival_type like 'S%' then a.pick_id end) s_pick_id,
      round(max(case when a.arrival_type like 'P%' then {TRAVEL} end),6) delta_t_p,
      round(max(case when a.arrival_type like 'S%' then {TRAVEL} end),6) delta_t_s
    from in_arrivals a join in_quakes e on e.event_id = a.event_id group by all""",
    "arrivals quakes",
)
def phase_pivot(tb):
    picks = tb.arrivals.join(tb.quakes.select("event_id", "event_dttm"), "event_id")
    out = cat.phase_pivot(picks, ["event_id", "station_nm", "network_nm"], [])
    return out.withColumns({c: F.round(c, 6) for c in ("delta_t_p", "delta_t_s")})


ENTITY_PAIRS = f"with pairs as ({REGION_PAIRS}) "


@register(
    "distinct_entities",
    ENTITY_PAIRS
    + """select 'event' as type, cast(event_id as varchar) as id, e_lon as lon, e_lat as lat from pairs group by all
    union all select 'station', station_nm||'_'||network_nm, s_lon, s_lat from pairs group by all
    union all select 'edge', cast(event_id as varchar)||' '||station_nm||'_'||network_nm, null, null from pairs group by all""",
    REGION_INPUTS,
)
def distinct_entities(tb):
    pairs = travel_times_by_region(tb)
    q, s, edges = cat.distinct_entities(pairs)
    none = F.lit(None).cast("double")
    return (
        q.select(F.lit("event").alias("type"), F.col("event_id").cast("string").alias("id"), "lon", "lat")
        .unionByName(s.select(F.lit("station").alias("type"), F.col("station_id").alias("id"), "lon", "lat"))
        .unionByName(
            edges.select(
                F.lit("edge").alias("type"), F.concat_ws(" ", F.col("event_id").cast("string"), "station_id").alias("id"),
                none.alias("lon"), none.alias("lat"),
            )
        )
    )


@register(
    "edge_coords",
    ENTITY_PAIRS
    + "select event_id, station_nm||'_'||network_nm as station_id, e_lon, e_lat, s_lon, s_lat from pairs group by all",
    REGION_INPUTS,
)
def edge_coords(tb):
    q, s, edges = cat.distinct_entities(travel_times_by_region(tb))
    return cat.edge_coords(edges, q, s)


@register(
    "first_row",
    f"select lon, lat, arrival_dttm, pick_id from (select a.*, s.lon, s.lat from in_arrivals a join in_stations s on s.station_nm = a.station_nm and s.network_nm = a.network_nm) z where arrival_dttm is not null order by arrival_dttm, pick_id, lon, lat limit 1",
    "arrivals stations",
)
def first_row(tb):
    """The earliest pick of the catalogue in a stated order."""
    out = cat.arrivals_with_stations(tb.arrivals.filter("arrival_dttm is not null"), tb.stations)
    return out.select("lon", "lat", "arrival_dttm", "pick_id").orderBy("arrival_dttm", "pick_id", "lon", "lat").limit(1)


@register(
    "travel_seconds",
    f"select a.pick_id, a.arrival_type, {TRAVEL} as travel_s from in_quakes e join in_arrivals a on a.event_id = e.event_id",
    "quakes arrivals",
)
def travel_seconds_query(tb):
    both = tb.arrivals.join(tb.quakes.select("event_id", "event_dttm"), "event_id")
    return both.select("pick_id", "arrival_type", travel_seconds("event_dttm", "arrival_dttm").alias("travel_s"))


@register(
    "haversine_km",
    f"""select a.pick_id, round({haversine('e.lat', 'e.lon', 's.lat', 's.lon')}, 6) as km
    from {STAR} where e.lon is not null and s.lon is not null""",
    "quakes arrivals stations",
)
def haversine_query(tb):
    from ..functions.geodesy import haversine_km

    out = cat.star_join(cat.located_quakes(tb.quakes), tb.arrivals, cat.located_stations(tb.stations))
    return out.select("pick_id", r(haversine_km("e_lat", "e_lon", "s_lat", "s_lon"), 6, "km"))


@register(
    "wave_subtype_phase",
    f"select a.pick_id, {SUBTYPE} as wave_subtype, case when upper(substr(a.arrival_type,1,1)) = 'P' then 'vp' else 'vs' end as wave_phase from in_arrivals a",
    "arrivals",
)
def wave_subtype_phase(tb):
    from ..functions.scalars import wave_phase

    return tb.arrivals.select(
        "pick_id", wave_subtype("arrival_type").alias("wave_subtype"), wave_phase("arrival_type").alias("wave_phase")
    )
