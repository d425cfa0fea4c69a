"""Locating quakes on a lattice: misfit, soft weights, best cells, residuals."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import materialise
from . import pyramid
from .buckets import WHOLE, box_of, foremost, misfits, rows_of, soft_weights
from .cells import CELL
from .fields import shuffled
from .selection import quantile


def pairwise_misfit(observed: DataFrame, field: DataFrame, station: str = "station_id", event: str = "event_id") -> DataFrame:
    """Sum of squared pair differences of residuals per quake and cell, without forming pairs.

    `observed` has one t_obs per quake and station; rows without a time don't count, and quakes with fewer than two
    stations drop out. Observations are centred per quake first (the misfit does not depend on the origin time). A cell
    counts only where every station of the quake has a time: sums over fewer stations would not compare.
    """
    timed = observed.filter(F.col("t_obs").isNotNull()).select(event, station, "t_obs")
    base = timed.groupBy(event).agg(F.avg("t_obs").alias("_base"), F.count(F.lit(1)).alias("_all")).filter("_all > 1")
    centred = timed.join(base, event).select(event, station, "_all", (F.col("t_obs") - F.col("_base")).alias("_o"))
    r = F.col("_o") - F.col("t")
    times = field.filter(F.col("t").isNotNull()).select(station, *CELL, "t")
    sums = centred.join(shuffled(times), station).groupBy(event, *CELL).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_all").alias("_all"), F.sum(r).alias("_s"), F.sum(r * r).alias("_q")
    ).filter("_n = _all")
    misfit = F.greatest(F.col("_n") * F.col("_q") - F.col("_s") * F.col("_s"), F.lit(0.0))
    return sums.select(event, *CELL, misfit.alias("misfit"))


def best_cell(misfit: DataFrame, event: str = "event_id") -> DataFrame:
    """Cell of least misfit per quake, the smallest cell on a tie."""
    best = F.min_by(F.struct(*CELL, "misfit"), F.struct("misfit", *CELL))
    return misfit.groupBy(event).agg(best.alias("_b")).select(event, "_b.*")


def best_cells(observed: DataFrame, field: DataFrame, n: int = 1, decimals: int | None = None, edge: int = pyramid.EDGE) -> DataFrame:
    """The n cells of least misfit per quake (ties by cell): event_id, i, j, k, misfit.

    A lattice of up to two blocks of `edge` cells along each axis is searched whole; a larger one through the pyramid of
    times. Both give the same rows. With `decimals`, misfits that agree to so many places are ties.
    """
    if n < 1:
        raise ValueError("n must be positive")
    box = box_of(field)
    if box is None or max(box.sides) > 2 * edge or box.n_cells > WHOLE:
        return pyramid.best_cells(observed, field, n, decimals=decimals, edge=edge)

    def best(quakes, cells, m):
        m = m if decimals is None else np.round(m, decimals)
        return rows_of("event_id", quakes, cells, foremost(m, n), misfit=m)

    return misfits(observed, field, box, best, _schema(observed, "misfit"), "station_id", "event_id")


def _schema(observed: DataFrame, *values: str) -> str:
    return ", ".join([f"event_id {dict(observed.dtypes)['event_id']}", *[f"{c} int" for c in CELL], *[f"{v} double" for v in values]])


def cell_weights(
    observed: DataFrame, field: DataFrame, temperature: float = 1.0, threshold: float | None = None, decimals: int | None = None, top_n: int | None = None,
    normalise: bool = False,
) -> DataFrame:
    """`softmin_weights` of the misfits of all cells, or of the `top_n` of them by weight: event_id, i, j, k, misfit, weight.

    Cells that take no part are left out; with `normalise` the `top_n` weights are scaled to a sum of 1. On lattices of up to `buckets.WHOLE` cells all of it happens inside the buckets of quakes.
    """
    if temperature <= 0 or (threshold is not None and threshold < 0):
        raise ValueError("temperature must be positive and the threshold not negative")
    box = box_of(field)
    if box is None or box.n_cells > WHOLE:
        misfit = pairwise_misfit(observed, field)
        misfit = misfit if decimals is None else misfit.withColumn("misfit", F.round("misfit", decimals))
        out = softmin_weights(misfit, temperature, threshold)
        out = out if threshold is None else out.filter((F.abs("misfit") <= threshold) | (F.col("weight") > 0))
        return out if top_n is None else top_weights(out, top_n, normalise, decimals=decimals)

    def weighed(quakes, cells, m):
        m = m if decimals is None else np.round(m, decimals)
        w, kept = soft_weights(m, temperature, threshold)
        if top_n is not None:
            by = w if decimals is None else np.round(w, decimals)
            kept &= foremost(np.where(kept, -by, np.nan), top_n)
            if normalise:
                total = np.where(kept, w, 0.0).sum(axis=1, keepdims=True)
                w = np.where(total > 0, w / np.where(total > 0, total, 1.0), w)
        return rows_of("event_id", quakes, cells, kept, misfit=m, weight=w)

    return misfits(observed, field, box, weighed, _schema(observed, "misfit", "weight"), "station_id", "event_id")


def softmin_weights(
    misfit: DataFrame, temperature: float = 1.0, threshold: float | None = None, event: str = "event_id"
) -> DataFrame:
    """Weights exp(-(m - min)/(T * scale)) summing to 1 per quake; scale is the median positive excess.

    With a threshold only cells up to it take part; a quake with none gets all its weight at its best cell. The misfits are
    stored once. Everything per quake is an aggregate joined back; the median comes from bisected counts, so neither
    all misfits nor a large lattice of one quake are ever sorted.
    """
    if temperature <= 0 or (threshold is not None and threshold < 0):
        raise ValueError("temperature must be positive and the threshold not negative")
    m = F.col("misfit")
    inside = F.lit(True) if threshold is None else F.abs(m) <= threshold
    misfit = materialise(misfit.select(event, *CELL, "misfit"), "misfit")
    ends = misfit.groupBy(event).agg(
        F.min(F.when(inside, m)).alias("_min"), F.min(F.struct(m, *CELL)).alias("_best")
    )
    ends = materialise(ends, "ends")
    shifted = misfit.join(ends, event).withColumn("_d", F.when(inside, m - F.col("_min")))
    medians = quantile(shifted.filter("_d > 0").select(event, "_d"), [event], "_d", 0.5, "_median")
    scale = F.greatest(F.coalesce("_median", F.lit(1.0)), F.lit(1e-12))
    raw = F.coalesce(F.exp(-F.col("_d") / (temperature * scale)), F.lit(0.0))
    scaled = misfit.join(ends.join(medians, event, "left"), event).withColumn("_d", F.when(inside, m - F.col("_min"))).withColumn("_raw", raw)
    totals = scaled.groupBy(event).agg(F.sum("_raw").alias("_sum"))
    weight = F.col("_raw") / F.nullif(F.col("_sum"), F.lit(0.0))
    if threshold is not None:
        alone = (F.struct(m, *CELL) == F.col("_best")).cast("double")
        weight = F.when(F.col("_min").isNull(), alone).otherwise(weight)
    return scaled.join(totals, event).select(event, *CELL, "misfit", weight.alias("weight"))


def top_weights(weights: DataFrame, n: int, normalise: bool = False, event: str = "event_id", decimals: int | None = None) -> DataFrame:
    """The n largest weights per quake (ties by cell); all others count as zero and are left out.

    With `decimals`, weights that agree to so many places are a tie. Spark cuts each task's rows to n per quake before the shuffle.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    by = F.col("weight") if decimals is None else F.round("weight", decimals)
    order = W.partitionBy(event).orderBy(by.desc(), *CELL)
    kept = weights.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn")
    if normalise:
        total = F.sum("weight").over(W.partitionBy(event))
        kept = kept.withColumn("weight", F.when(total > 0, F.col("weight") / F.nullif(total, F.lit(0.0))).otherwise(F.col("weight")))
    return kept


def locate_events(
    observed: DataFrame, field: DataFrame, temperature: float = 1.0, top_n: int = 1, decimals: int | None = None
) -> DataFrame:
    """Weighted candidate cells per quake: event_id, i, j, k, misfit, weight; the best cell alone, with weight 0, if top_n is 0.

    One cell is found through the pyramid of times, without the misfits of all cells; more cells need the scale of all of them.
    With `decimals`, misfits and weights that agree to so many places are ties.
    """
    if top_n <= 1:
        weight = F.lit(float(top_n == 1))
        return best_cells(observed, field, decimals=decimals).select("event_id", *CELL, "misfit", weight.alias("weight"))
    return cell_weights(observed, field, temperature, None, decimals, top_n, normalise=True)


def best_residuals(observed: DataFrame, field: DataFrame, decimals: int | None = None, about: str | None = None) -> DataFrame:
    """Observed minus modelled time of every observation of a quake in the quake's best cell: event_id, i, j, k, station_id, r.

    `about` = "mean" takes r about the quake's mean; "first" adds `station_0` and `d`, as `basis_differences` does. On lattices of up to
    `buckets.WHOLE` cells residuals are made where the best cell is found, and observations are not joined with anything.
    """
    if about not in (None, "mean", "first"):
        raise ValueError(f"residuals about {about}")
    box = box_of(field)
    if box is None or box.n_cells > WHOLE:
        out = residuals_at(best_cells(observed, field, decimals=decimals).drop("misfit"), observed, field).select("event_id", *CELL, "station_id", "r")
        if about == "first":
            return basis_differences(out, ["event_id"])
        if about == "mean":
            mean = out.groupBy("event_id").agg(F.avg("r").alias("_m"))
            out = out.join(mean, "event_id").withColumn("r", F.col("r") - F.col("_m")).drop("_m")
        return out

    def of(quakes, cells, m, seen):
        best = foremost(m if decimals is None else np.round(m, decimals), 1)
        cell = best.argmax(axis=1)
        t = seen.modelled(cell)
        kept = best.any(axis=1)[seen.quake] & ~np.isinf(t)
        q, r = seen.quake[kept], (seen.t_obs - t)[kept]
        out = {"event_id": quakes[q], **{k: v[cell[q]] for k, v in cells.items()}, "station_id": seen.station[kept]}
        if about == "mean":
            some = ~np.isnan(r)
            sums, n = (np.bincount(q, x, len(quakes)) for x in (np.where(some, r, 0.0), some))
            r = r - (sums / np.maximum(n, 1))[q]
        out["r"] = r
        if about == "first":
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
            each = np.repeat(first, np.diff(np.r_[first, len(q)]))
            out |= {"station_0": out["station_id"][each], "d": r - r[each]}
        return pd.DataFrame(out)

    key = f"station_id {dict(observed.dtypes)['station_id']}"
    schema = f"{_schema(observed)}, {key}, r double" + (f", {key.replace('station_id', 'station_0', 1)}, d double" if about == "first" else "")
    return misfits(observed, field, box, of, schema, "station_id", "event_id", rows=True)


def residuals_at(cells: DataFrame, observed: DataFrame, field: DataFrame) -> DataFrame:
    """Observed minus modelled time per quake, chosen cell and station."""
    return (
        cells.join(observed, "event_id")
        .join(shuffled(field.select("station_id", *CELL, "t")), ["station_id", *CELL])
        .withColumn("r", F.col("t_obs") - F.col("t"))
        .drop("t_obs", "t")
    )


def basis_differences(residuals: DataFrame, keys: list[str]) -> DataFrame:
    """Residual differences to each group's first station.

    The matrix of all pair differences has this single column as its basis (R_ij = d_i - d_j), so it is stored in
    this form and never as pairs.
    """
    first = residuals.groupBy(*keys).agg(F.min_by("r", "station_id").alias("_r0"), F.min("station_id").alias("station_0"))
    return residuals.join(first, keys).withColumn("d", F.col("r") - F.col("_r0")).drop("_r0")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
