"""Catalogue queries over quakes, arrivals, stations, magnitudes and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geodesy import mercator_box, mercator_distance
from ..functions.scalars import BOX_TYPES, PAIRED_TYPES, json_number, travel_seconds, wave_subtype
from ..session import materialise
from .cover import points_in_cover, quadtree_cover, region_points
from .predicates import DEFAULT_BOX, Box, in_days, positive_travel, since_year

STATION_KEY = ["station_nm", "network_nm"]


def located_stations(stations: DataFrame) -> DataFrame:
    """Stations with a position, coordinates renamed."""
    return stations.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(
        *STATION_KEY, F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat")
    )


def located_quakes(quakes: DataFrame) -> DataFrame:
    return quakes.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).withColumnsRenamed({"lon": "e_lon", "lat": "e_lat"})


def star_join(quakes: DataFrame, arrivals: DataFrame, stations: DataFrame) -> DataFrame:
    """Picks with their quake and station columns; station identity is (name, network). The small station side comes first."""
    return arrivals.join(stations, STATION_KEY).join(quakes, "event_id")


def arrivals_in_box(
    quakes: DataFrame, arrivals: DataFrame, stations: DataFrame, first: str, last: str, box: Box = DEFAULT_BOX
) -> DataFrame:
    """P and S picks whose quake and station both lie in the box, with the observed travel interval."""
    q = located_quakes(quakes).filter(
        in_days("event_dttm", first, last) & box.touches("e_lon", "e_lat") & (F.col("depth") > 0)
    )
    a = arrivals.filter(F.col("arrival_dttm").isNotNull() & F.col("arrival_type").isin(*BOX_TYPES))
    s = located_stations(stations).filter(box.touches("s_lon", "s_lat"))
    return star_join(q, a, s).select(
        F.col("e_lon").alias("event_lon"),
        F.col("e_lat").alias("event_lat"),
        F.col("depth").alias("event_depth"),
        "arrival_type",
        (F.col("arrival_dttm") - F.col("event_dttm")).alias("actual_time_diff"),
        F.col("s_lon").alias("station_lon"),
        F.col("s_lat").alias("station_lat"),
    )


def no_earlier(arrival: str, first: str) -> Column:
    """Picks from the first day on; with travel times above zero and quakes from that day on, no others count. Reaches the scan."""
    return F.col(arrival) >= F.lit(first).cast("timestamp_ntz")


def lookup_quakes(quakes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Depth and position of the listed quakes."""
    return quakes.join(wanted.select("event_id").distinct(), "event_id").select("event_id", "depth", "lon", "lat")


def quake(quakes: DataFrame, event_id: int) -> DataFrame:
    return quakes.filter(F.col("event_id") == event_id).select("depth", "lon", "lat").limit(1)


def lookup_stations(stations: DataFrame, wanted: DataFrame) -> DataFrame:
    """Surface position of the listed stations."""
    return stations.join(wanted.select(*STATION_KEY).distinct(), STATION_KEY).select(
        *STATION_KEY, F.lit(0.0).alias("depth"), "lon", "lat"
    )


def station(stations: DataFrame, station_nm: str, network_nm: str) -> DataFrame:
    hit = (F.col("station_nm") == station_nm) & (F.col("network_nm") == network_nm)
    return stations.filter(hit).select(F.lit(0.0).alias("depth"), "lon", "lat").limit(1)


def arrivals_with_stations(arrivals: DataFrame, stations: DataFrame) -> DataFrame:
    """Picks of any number of quakes with the station position."""
    return arrivals.join(stations.select(*STATION_KEY, "lon", "lat"), STATION_KEY)


def arrivals_of(arrivals: DataFrame, stations: DataFrame, event_id: int) -> DataFrame:
    """Picks of one quake in time order."""
    return (
        arrivals_with_stations(arrivals.filter(F.col("event_id") == event_id), stations)
        .select("lon", "lat", "arrival_dttm")
        .orderBy("arrival_dttm")
    )


def with_magnitude(quakes: DataFrame, magnitudes: DataFrame, min_mag: float) -> DataFrame:
    """Quakes having some magnitude of at least `min_mag`; one row each however many magnitudes match."""
    return quakes.join(magnitudes.filter(F.col("mag_value") >= min_mag), "event_id", "left_semi")


def near_point(lon, lat, at_lon: float, at_lat: float, radius: float) -> Column:
    """Closer than `radius` projected metres to a fixed point; the circle's own lon/lat box goes along as plain ranges."""
    west, east, south, north = mercator_box(at_lon, at_lat, radius)
    inside = F.col(lon).between(west, east) & F.col(lat).between(south, north)
    return inside & (mercator_distance(lon, lat, at_lon, at_lat) < radius)


def quakes_in_cylinder(
    quakes: DataFrame,
    magnitudes: DataFrame,
    arrivals: DataFrame,
    stations: DataFrame,
    lon: float,
    lat: float,
    depth: float,
    radius: float,
    min_mag: float,
    min_stations: int,
    year: int,
) -> DataFrame:
    """Well recorded, certain quakes in a vertical cylinder, in time order."""
    q = located_quakes(quakes).filter(
        (F.col("depth") < depth)
        & (F.col("event_type_certainty") == "known")
        & since_year("event_dttm", year)
        & near_point("e_lon", "e_lat", lon, lat, radius)
    )
    q = with_magnitude(q, magnitudes, min_mag)
    s = located_stations(stations).filter(near_point("s_lon", "s_lat", lon, lat, radius)).select(*STATION_KEY)
    # Reduce picks to (quake, station name) before meeting the quakes: a hot quake shrinks to its stations.
    picks = arrivals.join(q.select("event_id"), "event_id", "left_semi")
    recorded = picks.join(s, STATION_KEY).select("event_id", "station_nm").distinct()
    counts = recorded.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_stations"))
    return (
        q.join(counts.filter(F.col("n_stations") >= min_stations), "event_id")
        .select(
            "event_id",
            "event_type",
            "event_type_certainty",
            F.col("e_lon").alias("lon"),
            F.col("e_lat").alias("lat"),
            "depth",
            "event_dttm",
            "n_stations",
        )
        .orderBy("event_dttm", "event_id")
    )


def quakes_in_box(quakes: DataFrame, first: str, last: str, box: Box = DEFAULT_BOX) -> DataFrame:
    return quakes.filter(in_days("event_dttm", first, last) & box.touches("lon", "lat")).select(
        F.col("lon").alias("event_lon"),
        F.col("lat").alias("event_lat"),
        F.col("depth").alias("event_depth"),
        "event_dttm",
    )


NODE_PARAMS = (
    "lon string, lat string, dttm string, n_measurements string, linear_regression struct<slope string>"
)


def experiment_nodes(nodes: DataFrame, experiment_nm: str) -> DataFrame:
    """Typed node rows of one experiment in storage order; the JSON is parsed once per row."""
    p = F.col("_p")
    return (
        nodes.filter(F.col("experiment_nm") == experiment_nm)
        .withColumn("_p", F.from_json("params", NODE_PARAMS))
        .select(
            "ix",
            "iy",
            "it",
            p["lon"].cast("double").alias("lon"),
            p["lat"].cast("double").alias("lat"),
            F.to_date(F.left(p["dttm"], F.lit(10))).alias("dt"),
            p["n_measurements"].cast("int").alias("n_measurements"),
            json_number(p["linear_regression"]["slope"]).alias("slope"),
        )
        .orderBy("it", "ix", "iy")
    )


def travel_times_of(travel_times: DataFrame, experiment_nm: str) -> DataFrame:
    """Stored travel times of one experiment (a partition filter when stored by experiment)."""
    return travel_times.filter(F.col("experiment_nm") == experiment_nm)


def region_borders(regions: DataFrame) -> DataFrame:
    """Bounding box per region."""
    corner = regions.select("region_nm", F.explode("ring").alias("p"))
    return corner.groupBy("region_nm").agg(
        F.min("p.lon").alias("lon_min"),
        F.max("p.lon").alias("lon_max"),
        F.min("p.lat").alias("lat_min"),
        F.max("p.lat").alias("lat_max"),
    )


def phase_pivot(picks: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """One row per key and wave subtype with the latest P and S travel time and the largest pick ids.

    `carried` columns depend on the keys. NULL is a subtype of its own.
    """
    is_p, is_s = F.col("arrival_type").startswith("P"), F.col("arrival_type").startswith("S")
    travel = travel_seconds("event_dttm", "arrival_dttm")
    return (
        picks.withColumn("wave_subtype", wave_subtype("arrival_type"))
        .withColumn("_travel", travel)
        .groupBy(*keys, "wave_subtype")
        .agg(
            F.max(F.when(is_p, F.col("pick_id"))).alias("p_pick_id"),
            F.max(F.when(is_s, F.col("pick_id"))).alias("s_pick_id"),
            F.max(F.when(is_p, F.col("_travel"))).alias("delta_t_p"),
            F.max(F.when(is_s, F.col("_travel"))).alias("delta_t_s"),
            *[F.min(c).alias(c) for c in carried],
        )
    )


def travel_times_by_region(
    quakes: DataFrame,
    arrivals: DataFrame,
    stations: DataFrame,
    regions: DataFrame,
    first: str,
    last: str,
    region_nm: str | None = None,
) -> DataFrame:
    """Paired P and S travel times of quakes and stations within the same region.

    All regions in one plan, or one if `region_nm` is given.
    """
    if region_nm is not None:
        regions = regions.filter(F.col("region_nm") == region_nm)
    q = located_quakes(quakes.filter(in_days("event_dttm", first, last))).select(
        "event_id", "e_lon", "e_lat", "event_dttm"
    )
    cover = materialise(quadtree_cover(regions), "cover")
    q = points_in_cover(q, cover, "e_lon", "e_lat")
    s = points_in_cover(located_stations(stations), cover, "s_lon", "s_lat")
    a = arrivals.filter(F.col("arrival_type").isin(*PAIRED_TYPES) & no_earlier("arrival_dttm", first))
    picks = a.join(q, "event_id").filter(positive_travel("event_dttm", "arrival_dttm"))
    picks = picks.join(s, [*STATION_KEY, "region_nm"])
    pairs = phase_pivot(
        picks, ["region_nm", "event_id", *STATION_KEY], ["e_lon", "e_lat", "s_lon", "s_lat", "event_dttm"]
    )
    return pairs.filter(F.col("p_pick_id").isNotNull() & F.col("s_pick_id").isNotNull())


def travel_times_in_box(
    quakes: DataFrame, arrivals: DataFrame, stations: DataFrame, first: str, last: str, box: Box, limit_s: float
) -> DataFrame:
    """P and S travel times of quakes and stations strictly inside a box, both in [0, limit) seconds."""
    q = located_quakes(quakes).filter(in_days("event_dttm", first, last) & box.contains("e_lon", "e_lat"))
    s = located_stations(stations).filter(box.contains("s_lon", "s_lat")).select(*STATION_KEY)
    # A pick before the first day precedes its quake and can't be the latest one of a pair that stays.
    a = arrivals.filter(F.col("arrival_type").isin(*PAIRED_TYPES) & no_earlier("arrival_dttm", first))
    picks = star_join(q.select("event_id", "event_dttm"), a, s)
    pairs = phase_pivot(picks, ["event_id", *STATION_KEY], ["event_dttm"]).drop("p_pick_id", "s_pick_id")
    keep = F.col("delta_t_p").between(0, limit_s) & F.col("delta_t_s").between(0, limit_s)
    return pairs.filter(keep & (F.col("delta_t_p") < limit_s) & (F.col("delta_t_s") < limit_s))


def raw_arrivals(quakes: DataFrame, arrivals: DataFrame, stations: DataFrame, first: str, last: str) -> DataFrame:
    """Every located pick between two days with its travel time."""
    q = located_quakes(quakes).filter(in_days("event_dttm", first, last))
    a = arrivals.filter(F.col("arrival_dttm").isNotNull())
    return star_join(q, a, located_stations(stations)).select(
        "event_id",
        F.col("e_lon").alias("event_lon"),
        F.col("e_lat").alias("event_lat"),
        F.col("depth").alias("event_depth"),
        *STATION_KEY,
        "arrival_dttm",
        "event_dttm",
        F.col("s_lon").alias("station_lon"),
        F.col("s_lat").alias("station_lat"),
        travel_seconds("event_dttm", "arrival_dttm").alias("travel_time"),
    )


def distinct_entities(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct quakes, stations (with a joined id) and quake-station edges of a travel-time table."""
    named = pairs.withColumn("station_id", F.concat_ws("_", *STATION_KEY))
    quakes = pairs.select("event_id", F.col("e_lon").alias("lon"), F.col("e_lat").alias("lat")).distinct()
    stations = named.select(
        "station_id", *STATION_KEY, F.col("s_lon").alias("lon"), F.col("s_lat").alias("lat")
    ).distinct()
    return quakes, stations, named.select("event_id", "station_id").distinct()


def edge_coords(edges: DataFrame, quakes: DataFrame, stations: DataFrame) -> DataFrame:
    """Both end points of every quake-station edge."""
    e = quakes.select("event_id", F.col("lon").alias("e_lon"), F.col("lat").alias("e_lat"))
    s = stations.select("station_id", F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"))
    return edges.join(e, "event_id").join(s, "station_id")

