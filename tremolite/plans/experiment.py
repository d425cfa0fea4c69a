"""The Vp/Vs experiment: travel times of a region spread over a space-time grid, regressed per node."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.catalogue import region_borders, travel_times_by_region
from ..operators.nodes import (
    NodeGrid, node_params, node_regression, node_stats, regression_p_value, spread_to_nodes,
)


@dataclass(frozen=True)
class Experiment:
    first: str
    last: str
    n_lat: int
    n_lon: int
    n_time: int
    r_events_km: float
    r_stations_km: float
    r_time_days: float
    region_nm: str | None = None

    def grid(self) -> NodeGrid:
        """A grid whose borders are the region columns of the rows it is applied to."""
        return NodeGrid(
            "lat_min", "lat_max", "lon_min", "lon_max", self.n_lat, self.n_lon, self.first, self.last, self.n_time
        )

    def name(self) -> str:
        return "_".join(str(p) for p in ("exp", self.region_nm or "all", self.first, self.last))


def node_moments(x: Experiment, quakes, arrivals, stations, regions) -> DataFrame:
    """Moments per region and node, with the region's borders attached again for locating nodes."""
    pairs = travel_times_by_region(quakes, arrivals, stations, regions, x.first, x.last, x.region_nm)
    borders = region_borders(regions)
    keyed = pairs.join(borders, "region_nm")
    spread = spread_to_nodes(keyed, x.grid(), x.r_events_km, x.r_stations_km, x.r_time_days, ["region_nm"])
    return spread.join(borders, "region_nm")


def fit_nodes(x: Experiment, quakes, arrivals, stations, regions, with_p: bool = True) -> DataFrame:
    """Statistics and regression per node."""
    fit = node_regression(node_stats(node_moments(x, quakes, arrivals, stations, regions)))
    return regression_p_value(fit) if with_p else fit.withColumn("p_value", F.lit(None).cast("double"))


def run_experiment(x: Experiment, quakes, arrivals, stations, regions) -> DataFrame:
    """Node rows (ix, iy, it, params) of the experiment, in storage order."""
    stored = node_params(fit_nodes(x, quakes, arrivals, stations, regions), x.grid())
    return stored.select(F.lit(x.name()).alias("experiment_nm"), "region_nm", "ix", "iy", "it", "params").orderBy(
        "region_nm", "it", "ix", "iy"
    )


def append_experiment(x: Experiment, nodes: DataFrame, folder: str) -> None:
    """Append the run's parameters and its nodes (params as JSON text)."""
    spark = nodes.sparkSession
    log = spark.range(1).select(
        F.lit(x.name()).alias("experiment_nm"), F.lit(json.dumps(asdict(x))).alias("initial_params")
    )
    log.write.mode("append").parquet(f"{folder}/experiments")
    (
        nodes.withColumn("params", F.to_json("params"))
        .write.mode("append")
        .partitionBy("experiment_nm")
        .parquet(f"{folder}/experiment_nodes")
    )
