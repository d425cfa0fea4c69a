"""Alternating quake location and model correction on a lattice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import SoftLimit, apply_slowness, bound_velocity, exponential, power
from ..operators import cells as ce, fronts as fr, inversion as inv, location as lo
from ..session import materialise

SHAPE = ("n_x", "n_y", "n_z")


@dataclass(frozen=True)
class Settings:
    side: float
    n_x: int
    n_y: int
    n_z: int
    subdivision: int = 1
    temperature: float = 1.0
    top_n: int = 1
    lambda_reg: float = 1e-3
    v_bounds: tuple[float, float] | None = None
    v_strength: float = 0.0
    tolerance: float = 1e-8

    @property
    def fine_side(self) -> float:
        return self.side / self.subdivision

    @property
    def fine_shape(self) -> tuple[int, int, int]:
        return tuple(getattr(self, n) * self.subdivision for n in SHAPE)


def cell_number(i="i", j="j", k="k", shape=(1, 1, 1)):
    return (F.col(i).cast("long") * shape[1] + F.col(j)) * shape[2] + F.col(k)


def station_fields(model: DataFrame, stations: DataFrame, s: Settings) -> DataFrame:
    """Travel-time field per station on the refined grid. `stations` has station_id and metric x, y, z."""
    fine = ce.refine(model, s.subdivision, [], ["vp"]).withColumn("model", F.lit(0))
    n = s.fine_shape
    at = ce.metric_to_cell(stations, {"i": ("x", n[0]), "j": ("y", n[1]), "k": ("z", n[2])}, s.fine_side)
    sources = at.filter(F.col("error").isNull()).select(F.col("station_id").alias("source"), F.lit(0).alias("model"), *ce.CELL)
    cost = F.when(F.col("vp") > 0, s.fine_side / F.nullif(F.col("vp"), F.lit(0.0)))
    return fr.travel_fields(fine, sources, cost, block=block_side(s))


def block_side(s: Settings) -> int:
    """Side of the blocks of fields and paths: no larger than the grid, since every cell of a block is stored."""
    return min(16, max(s.fine_shape))


@dataclass
class Step:
    fields: DataFrame
    weights: DataFrame
    residuals: DataFrame
    sums: DataFrame
    right: DataFrame
    correction: DataFrame


def step(model: DataFrame, observed: DataFrame, stations: DataFrame, s: Settings) -> Step:
    """One correction: fields, weighted locations, ray sums per station and cell, damped solution.

    A ray depends on its station and candidate cell only, so weights are summed over quakes first and each distinct
    ray is traced once. Residuals are taken about each quake's mean, which drops the origin time and leaves all pair
    differences as they are. With every quake recorded everywhere this is the pair system of the sums.
    """
    fields = materialise(station_fields(model, stations, s), "fields")
    times = fields.select(F.col("source").alias("station_id"), *ce.CELL, "t")
    weights = lo.locate_events(observed, times, s.temperature, s.top_n)
    if s.top_n > 1:
        weights = materialise(weights, "weights")
        res = lo.residuals_at(weights.select("event_id", *ce.CELL, "weight"), observed, times)
        mean = res.groupBy("event_id", *ce.CELL).agg(F.avg("r").alias("_m"))
        res = materialise(
            res.join(mean, ["event_id", *ce.CELL]).withColumn("r", F.col("r") - F.col("_m")).drop("_m"), "residuals"
        )
    else:
        # Made where the quake is located, and summed at once: residuals are not stored.
        res = lo.best_residuals(observed, times, about="mean").withColumn("weight", F.lit(float(s.top_n == 1)))
    ray = cell_number(shape=s.fine_shape)
    per_ray = materialise(
        res.groupBy("station_id", *ce.CELL).agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("r")).alias("r")), "rays"
    )
    # A lattice path pays one cell side in every cell it enters, which is all but the station's own; these go along with its rays.
    own = fields.filter("t <= 0").groupBy("source", "model").agg(F.collect_set(F.struct(*ce.CELL)).alias("own"))
    rays = per_ray.select(F.col("station_id").alias("source"), F.lit(0).alias("model"), "weight", ray.alias("ray"), *ce.CELL)
    paths = fr.trace_back(rays.join(own, ["source", "model"], "left"), fields, block_side(s))
    entered = paths.filter(~F.coalesce(F.array_contains("own", F.struct(*ce.CELL)), F.lit(False)))
    coarse = [F.floor(F.col(c) / s.subdivision).cast("int").alias(c) for c in ce.CELL]
    numbered = entered.select(F.col("source").alias("station_id"), "weight", *coarse).withColumn(
        "cell", cell_number(shape=(s.n_x, s.n_y, s.n_z))
    )
    # The weight goes along the path, so lengths need not be stored per ray and met with weights again.
    sums = materialise(numbered.groupBy("station_id", "cell").agg((F.sum("weight") * s.fine_side).alias("s")), "sums")
    right = per_ray.groupBy("station_id").agg(F.sum("r").alias("r"))
    n_stations = sums.select("station_id").unionByName(right.select("station_id")).distinct().count()
    trace = pair_trace(sums, n_stations).first()[0] or 0.0
    damping = s.lambda_reg * trace / (s.n_x * s.n_y * s.n_z)
    b = inv.pair_right_side(sums, right, n_stations)
    x = inv.damped_solve(sums, b, ["station_id"], "cell", "s", damping, pairs_of=n_stations, tolerance=s.tolerance)
    return Step(fields, weights, res, sums, right, x)


def pair_trace(sums: DataFrame, n_stations: int) -> DataFrame:
    """Trace of the pair-form normal matrix, cell by cell: n sum(S^2) - (sum S)^2."""
    per_cell = sums.groupBy("cell").agg(F.sum(F.col("s") * F.col("s")).alias("_q"), F.sum("s").alias("_s"))
    return per_cell.agg(F.sum(n_stations * F.col("_q") - F.col("_s") * F.col("_s")).alias("trace"))


def corrected(model: DataFrame, correction: DataFrame, s: Settings) -> DataFrame:
    """Model after a slowness correction and the optional velocity bounds."""
    numbered = model.withColumn("cell", cell_number(shape=(s.n_x, s.n_y, s.n_z)))
    v = apply_slowness("vp", F.coalesce("x", F.lit(0.0)))
    out = numbered.join(correction, "cell", "left").withColumn("vp", v).drop("cell", "x")
    if s.v_bounds and s.v_strength > 0:
        out = out.withColumn("vp", bound_velocity("vp", *s.v_bounds, SoftLimit(exponential(6.0), s.v_strength), SoftLimit(power(2.0), s.v_strength)))
    return out


def run(model: DataFrame, observed: DataFrame, stations: DataFrame, s: Settings, cycles: int, log=None) -> DataFrame:
    """Repeat `step`; `log` (see sources.runlog) gets each cycle's tables."""
    for i in range(cycles):
        done = step(model, observed, stations, s)
        new = materialise(corrected(model, done.correction, s), "model")
        if log is not None:
            log.cycle(i, model, done)
        model = new
    return model
