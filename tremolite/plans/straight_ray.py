"""Damped straight-ray tomography on an irregular grid."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..operators import cells as ce, inversion as inv, rays as ry

RAY = ["ray"]


def node_number(axes: dict[str, list[float]]):
    """Number of a grid node from its three indices."""
    n = [len(a) for a in axes.values()]
    return (F.col("i").cast("long") * n[1] + F.col("j")) * n[2] + F.col("k")


def vectors(rays: DataFrame, values: DataFrame, axes: dict[str, list[float]], zone: int, n: int = 100) -> DataFrame:
    """One row per ray: observed minus modelled time `dt`, and its sensitivity as lists `cells` and `g`.

    Rays (column `ray`) are different. On grids of up to SENT_CELLS nodes a ray's points live inside a task only; larger grids take a row per point.
    """
    if len(axes) == 3 and math.prod(map(len, axes.values())) <= ce.SENT_CELLS:
        made = ry.ray_vectors(rays, [*RAY, "travel_time"], values, axes, zone, n)
    else:
        points = ce.interpolate_points(ry.straight_ray_samples(rays, zone, n), values, axes, "v", "v_at")
        per_cell = ry.ray_sensitivity(points, [*RAY, "travel_time"], axes, "v_at").withColumn("cell", node_number(axes))
        lists = per_cell.groupBy(*RAY, "travel_time").agg(F.sort_array(F.collect_list(F.struct("cell", "g"))).alias("_e"))
        times = ry.ray_times(points, RAY, "v_at")
        made = lists.join(times, RAY).select(*RAY, "travel_time", "t_model", F.col("_e.cell").alias("cells"), F.col("_e.g").alias("g"))
    return made.select(*RAY, (F.col("travel_time") - F.col("t_model")).alias("dt"), "cells", "g")


def sensitivity(made: DataFrame) -> DataFrame:
    """Sparse rows (ray, cell, g)."""
    return made.select(*RAY, F.explode(F.arrays_zip("cells", "g")).alias("_e")).select(*RAY, F.col("_e.cells").alias("cell"), F.col("_e.g").alias("g"))


def iterate(
    rays: DataFrame, values: DataFrame, axes: dict[str, list[float]], zone: int, rounds: int = 3, base_damping: float = 0.1
) -> tuple[DataFrame, list[float]]:
    """Updated node velocities (i, j, k, v) and the RMS delay per round; damping grows by base_damping each round."""
    from ..session import materialise

    misfits = []
    for step in range(rounds):
        made = materialise(vectors(rays, values, axes, zone), "vectors")
        misfits.append(made.agg(F.sqrt(F.avg(F.col("dt") * F.col("dt")))).first()[0])
        x = inv.damped_solve(sensitivity(made), inv.right_side(made), RAY, "cell", "g", base_damping * (step + 1))
        numbered = values.withColumn("cell", node_number(axes))
        values = materialise(
            numbered.join(x, "cell", "left").select(*ce.CELL, (F.col("v") + F.coalesce("x", F.lit(0.0))).alias("v")), "model"
        )
    return values, misfits
