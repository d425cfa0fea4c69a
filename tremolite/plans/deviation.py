"""Travel-time deviation tables of all quakes inside a model, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import catalogue as cat, cells as ce, fields as fd, measures as ms


def cylinder_of(m: ce.Lattice) -> dict[str, float]:
    """Search cylinder that stays inside a lattice."""
    return dict(lon=m.top.lon, lat=m.top.lat, depth=m.n_depth * m.cube_side * 0.9, radius=m.half[0] * m.cube_side)


def quakes_in_model(m: ce.Lattice, quakes, magnitudes, arrivals, stations, min_mag, min_stations, year=1970) -> DataFrame:
    return cat.quakes_in_cylinder(
        quakes, magnitudes, arrivals, stations, **cylinder_of(m), min_mag=min_mag, min_stations=min_stations, year=year
    )


def deviation_table(
    m: ce.Lattice, chosen: DataFrame, arrivals: DataFrame, stations: DataFrame, field: DataFrame, field_key: Column
) -> DataFrame:
    """Per pick: modelled time from the quake's to the station's cell, implied origin, deviation from the quake's mean.

    `field` holds (field key, i, j, k, t); `field_key` names the field of a pick.
    """
    start = ce.locate_cells(chosen.select("event_id", "lon", "lat", "depth"), m).dropna(subset=["z"]).select(
        "event_id", F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("z").alias("ez")
    )
    placed = ce.add_cell_coords(stations.dropna(subset=["lon", "lat"]), m).select(*cat.STATION_KEY, "lon", "lat", "z", "x", "y")
    picks = arrivals.join(start, "event_id").join(placed, cat.STATION_KEY).withColumn("_field", field_key)
    named = field.withColumnRenamed("station_id", "_field")
    timed = fd.field_difference(picks, named, "_field", ["ex", "ey", "ez"], ["x", "y", "z"], "model_s")
    return ms.origin_deviation(timed.drop("_field"), "event_id", "arrival_dttm", "model_s")


def arrival_deviation(
    m: ce.Lattice, arrivals: DataFrame, stations: DataFrame, field: DataFrame
) -> DataFrame:
    """Modelled minus observed seconds per pick, by phase.

    `arrivals` comes from a catalogue query and has event and station coordinates, arrival_type and travel_time;
    `field` has (station_nm, network_nm, phase, i, j, k, t) with phase vp or vs.
    """
    from ..functions.scalars import wave_phase

    at = ce.locate_cells(arrivals, m, "event_lat", "event_lon", "event_depth").withColumn("phase", wave_phase("arrival_type"))
    on = [*cat.STATION_KEY, "phase"]
    f = field.select(*on, *[F.col(c).alias(d) for c, d in zip(ce.CELL, ("x", "y", "z"))], F.col("t").alias("model_s"))
    return at.join(fd.shuffled(f), [*on, "x", "y", "z"]).withColumn("deviation_s", F.col("model_s") - F.col("travel_time"))
