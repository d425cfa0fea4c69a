"""Straight rays and polylines through cell grids."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.geodesy import evaluate_once, utm_forward, utm_inverse, utm_inverse_arrays
from .cells import CELL, CORNERS, SENT_CELLS, nearest_index

# Rays whose points are held at once by a task.
RAYS = 512


def _ends(rays: DataFrame, zone: int) -> DataFrame:
    ends = utm_forward(rays, "event_lon", "event_lat", zone, "_ex", "_ey")
    return utm_forward(ends, "station_lon", "station_lat", zone, "_sx", "_sy")


def straight_ray_samples(rays: DataFrame, zone: int, n: int = 100) -> DataFrame:
    """n points per ray from the quake (at its depth) to the station (at the surface), spaced evenly in UTM metres.

    Adds lon, lat, depth per point and ds, the horizontal length per point.
    """
    ends = _ends(rays, zone)
    dx, dy = F.col("_sx") - F.col("_ex"), F.col("_sy") - F.col("_ey")
    points = ends.withColumn("ds", F.sqrt(dx * dx + dy * dy) / n).withColumn(
        "sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    )
    t = F.col("sample") / F.lit(float(n - 1))
    points = points.withColumns(
        {"_x": F.col("_ex") + t * dx, "_y": F.col("_ey") + t * dy, "depth": (1 - t) * F.col("event_depth")}
    )
    return utm_inverse(points, "_x", "_y", zone).drop("_x", "_y", "_ex", "_ey", "_sx", "_sy")


Digest = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list]


def along_rays(rays: DataFrame, zone: int, keep: list[str], digest: Digest, schema: str, n: int = 100) -> DataFrame:
    """What `digest` makes of the points of `straight_ray_samples`: one row per ray, no row per point.

    `digest` gets lon, lat, depth (rays x n) and ds (one per ray) of a few hundred rays, NaN for null, and returns the columns of `schema`;
    NaN is written as null. The columns `keep` go in front.
    """
    ends = _ends(rays, zone).select(*keep, *[F.col(c).cast("double") for c in ("_ex", "_ey", "_sx", "_sy", "event_depth")])
    made = T._parse_datatype_string(schema)
    t = np.arange(n) / float(n - 1)
    places = range(len(keep), len(keep) + 5)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, RAYS):
                part = batch.slice(a, RAYS)
                ex, ey, sx, sy, depth = (part.column(p).to_numpy(zero_copy_only=False)[:, None] for p in places)
                dx, dy = sx - ex, sy - ey
                lon, lat = utm_inverse_arrays(ex + t * dx, ey + t * dy, zone)
                with np.errstate(invalid="ignore"):
                    columns = digest(lon, lat, (1 - t) * depth, (np.sqrt(dx * dx + dy * dy) / n)[:, 0])
                columns = [c if isinstance(c, pa.Array) else pa.array(c, from_pandas=True) for c in columns]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns], names=[*part.schema.names[: len(keep)], *made.names])

    return ends.mapInArrow(run, T.StructType([*[ends.schema[k] for k in keep], *made.fields]))


def _bracketed(x: np.ndarray, axis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`cells.bracket` of an array, and the place within the interval."""
    b = np.searchsorted(axis[1:-1], x, side="right")
    return b, (x - axis[b]) / (axis[b + 1] - axis[b])


def _nearest(x: np.ndarray, axis: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(np.abs(axis[b] - x) <= np.abs(axis[b + 1] - x), b, b + 1)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, from_pandas=True))


def ray_vectors(rays: DataFrame, keep: list[str], values: DataFrame, axes: dict[str, list[float]], zone: int, n: int = 100, v: str = "v") -> DataFrame:
    """Per ray the modelled time `t_model` and the sensitivity at its nearest nodes, as lists `cells` (node numbers, rising) and `g`.

    Velocities are trilinear in `values` (i, j, k, v) on the axes lon, lat, depth. The node table, whose size is that of the given axes, goes
    to every task, for up to SENT_CELLS nodes.
    """
    nodes = [np.asarray(a, dtype=float) for a in axes.values()]
    shape = tuple(len(a) for a in nodes)
    if np.prod(shape) > SENT_CELLS:
        raise ValueError(f"more than {SENT_CELLS} nodes")
    grid, known = np.full(shape, np.nan), np.zeros(shape, dtype=bool)
    for row in values.select(*CELL, F.col(v).cast("double")).collect():
        at = tuple(row[:3])
        if all(0 <= p < s for p, s in zip(at, shape)):
            known[at], grid[at] = True, np.nan if row[3] is None else row[3]
    if not known.all():
        raise ValueError(f"cells missing: {np.argwhere(~known)[:8].tolist()}")

    def digest(lon, lat, depth, ds):
        at, part = zip(*[_bracketed(x, a) for x, a in zip((lon, lat, depth), nodes)])
        speed = 0.0
        for corner in CORNERS:
            weight = 1.0
            for bit, f in zip(corner, part):
                weight = weight * (f if bit else 1 - f)
            speed = speed + grid[at[0] + corner[0], at[1] + corner[1], at[2] + corner[2]] * weight
        if (speed == 0).any():
            raise ZeroDivisionError("velocity 0 on a ray")
        have = ~np.isnan(speed)
        spent = ds[:, None] / speed
        times = np.where(have.any(axis=1), np.where(have, spent, 0.0).sum(axis=1), np.nan)
        near = [_nearest(x, a, b) for x, a, b in zip((lon, lat, depth), nodes, at)]
        number = (near[0] * shape[1] + near[1]) * shape[2] + near[2]
        # Points of one ray and node mostly follow one another: stretches are added up first, then the few that meet again.
        key = (np.arange(len(ds))[:, None] * int(np.prod(shape)) + number).ravel()
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sums = np.add.reduceat(np.where(have, -spent / speed, 0.0).ravel(), starts)
        some = np.add.reduceat(have.ravel().astype(np.int64), starts)
        one, place = np.unique(key[starts], return_inverse=True)
        g = np.bincount(place, sums)
        g[np.bincount(place, some) == 0] = np.nan
        row, cell = np.divmod(one, int(np.prod(shape)))
        sizes = np.bincount(row, minlength=len(ds))
        return [times, _lists(cell.astype(np.int64), sizes), _lists(g, sizes)]

    return along_rays(rays, zone, keep, digest, "t_model double, cells array<long>, g array<double>", n)


def ray_times(samples: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """Travel time per ray: sum of ds / v."""
    return samples.groupBy(*keys).agg(F.sum(F.col("ds") / F.col(v)).alias("t_model"))


def ray_sensitivity(samples: DataFrame, keys: list[str], axes: dict[str, list[float]], v: str = "v") -> DataFrame:
    """Sum of -ds / v^2 per ray and nearest grid node."""
    node = {c: nearest_index(name, axis) for c, (name, axis) in zip(CELL, axes.items())}
    value = -F.col("ds") / (F.col(v) * F.col(v))
    return samples.withColumns(node).groupBy(*keys, *CELL).agg(F.sum(value).alias("g"))


def _clip(a: Column, d: Column, hi: float) -> tuple[Column, Column, Column]:
    """Parameter interval of a segment inside [0, hi] on one axis, and whether a level segment lies outside."""
    flat = F.abs(d) < 1e-12
    near, far = (0.0 - a) / F.nullif(d, F.lit(0.0)), (hi - a) / F.nullif(d, F.lit(0.0))
    lo = F.when(flat, 0.0).otherwise(F.least(near, far))
    up = F.when(flat, 1.0).otherwise(F.greatest(near, far))
    return lo, up, flat & ((a < 0) | (a > hi))


def _crossings(planes: Column, a: Column, d: Column) -> Column:
    return F.transform(planes, lambda m: (m - a) / F.nullif(d, F.lit(0.0)))


def cell_lengths(
    segments: DataFrame, keys: list[str], shape: tuple[int, int, int], size: tuple[float, float, float] = (1.0, 1.0, 1.0)
) -> DataFrame:
    """Length of each ray in each cell."""
    return cell_pieces(segments, keys, shape, size).groupBy(*keys, *CELL).agg(F.sum("length").alias("length"))


def cell_pieces(
    segments: DataFrame, keys: list[str], shape: tuple[int, int, int], size: tuple[float, float, float] = (1.0, 1.0, 1.0)
) -> DataFrame:
    """Pieces of each ray in cells, with their lengths; nothing is shuffled.

    Segments are rows with end points a0..a2, b0..b2 in cell units. Each is clipped to the grid and cut where it
    crosses a cell face; a piece belongs to the cell of its midpoint.
    """
    a = [F.col(f"a{x}") for x in range(3)]
    d = [F.col(f"_d{x}") for x in range(3)]
    cut = segments.withColumns({f"_d{x}": F.col(f"b{x}") - F.col(f"a{x}") for x in range(3)})
    clips = [_clip(a[x], d[x], shape[x] - 1e-9) for x in range(3)]
    cut = evaluate_once(
        cut,
        {
            "_t0": F.greatest(F.lit(0.0), *[c[0] for c in clips]),
            "_t1": F.least(F.lit(1.0), *[c[1] for c in clips]),
            "_off": clips[0][2] | clips[1][2] | clips[2][2],
            "_len": F.sqrt(sum((d[x] * size[x]) * (d[x] * size[x]) for x in range(3))),
        },
    ).filter(~F.col("_off") & (F.col("_t0") < F.col("_t1")))
    marks = [F.array("_t0", "_t1")]
    for x in range(3):
        first = F.ceil(F.least(a[x], F.col(f"b{x}")))
        last = F.floor(F.greatest(a[x], F.col(f"b{x}")))
        planes = F.when((F.abs(d[x]) >= 1e-12) & (first <= last), F.sequence(first, last)).otherwise(
            F.array().cast("array<bigint>")
        )
        marks.append(F.filter(_crossings(planes, a[x], d[x]), lambda t: (t > F.col("_t0")) & (t < F.col("_t1"))))
    cut = evaluate_once(cut, {"_marks": F.sort_array(F.concat(*marks))})
    pieces = F.zip_with(
        F.slice("_marks", F.lit(1), F.size("_marks") - 1),
        F.slice("_marks", F.lit(2), F.size("_marks") - 1),
        lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")),
    )
    rows = cut.withColumn("_p", F.explode(pieces)).filter(F.col("_p.hi") > F.col("_p.lo"))
    mid = (F.col("_p.lo") + F.col("_p.hi")) / 2
    rows = rows.withColumns({c: F.floor(a[x] + mid * d[x]).cast("int") for x, c in enumerate(CELL)})
    return rows.select(*keys, *CELL, ((F.col("_p.hi") - F.col("_p.lo")) * F.col("_len")).alias("length"))


def ray_count(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Rays with a positive length per cell."""
    return lengths.groupBy(*keys, *CELL).agg(F.sum(F.when(F.col("length") > 0, 1).otherwise(0)).alias("rays"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
