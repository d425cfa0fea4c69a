"""Adaptive quadtree cover of polygons and the join of points with it.

A region becomes leaf cells of a fixed global quadtree, small where its border is dense. A leaf inside the region has no edges and needs no test; a leaf on
the border holds only the edges that touch it and one reference point whose side is known. A point of that leaf is inside if the way from it to the
reference point crosses an even number of these edges and the reference lies inside, or an odd number and it lies outside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise

# The quadtree's root: a square of 512 degrees from -256, which holds all longitudes and latitudes.
_ORIGIN, _SPAN = -256.0, 512.0
# Edges of a leaf, levels below a region's own size that are always used, and levels that are used at most.
EDGES = 8
LEAST = 3
MOST = 16
# The reference point of a cell, as shares of its size; no round numbers, so that it lies on no border in practice.
_AT = (0.41421356, 0.73205081)

COVER = "level int, cx long, cy long, rx double, ry double, inside boolean, edges array<struct<x1:double,y1:double,x2:double,y2:double>>"


def _crossings(px: float, py: float, qx: float, qy: float, e: np.ndarray) -> int:
    """Edges that the way from p to q crosses; an edge is a row x1, y1, x2, y2."""
    x1, y1, x2, y2 = e.T
    a = (qx - px) * (y1 - py) - (qy - py) * (x1 - px) > 0
    b = (qx - px) * (y2 - py) - (qy - py) * (x2 - px) > 0
    p = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) > 0
    q = (x2 - x1) * (qy - y1) - (y2 - y1) * (qx - x1) > 0
    return int(np.count_nonzero((a != b) & (p != q)))


def _touching(x: float, y: float, size: float, e: np.ndarray) -> np.ndarray:
    """The edges that touch a cell, a hair's breadth around it included."""
    pad = size * 1e-9
    lo_x, lo_y, hi_x, hi_y = x - pad, y - pad, x + size + pad, y + size + pad
    x1, y1, x2, y2 = e.T
    near = (np.minimum(x1, x2) <= hi_x) & (np.maximum(x1, x2) >= lo_x) & (np.minimum(y1, y2) <= hi_y) & (np.maximum(y1, y2) >= lo_y)
    side = [(x2 - x1) * (cy - y1) - (y2 - y1) * (cx - x1) for cx in (lo_x, hi_x) for cy in (lo_y, hi_y)]
    return e[near & (np.min(side, axis=0) <= 0) & (np.max(side, axis=0) >= 0)]


def leaves(ring: list[tuple[float, float]], edges: int = EDGES, least: int = LEAST, most: int = MOST) -> Iterator[tuple]:
    """Leaf cells of one ring of corners (closed or not): level, cx, cy, reference point, its side, and the leaf's edges."""
    corners = np.array(ring, dtype=float).reshape(-1, 2)
    e = np.hstack([corners, np.roll(corners, -1, axis=0)])
    e = e[(e[:, 0] != e[:, 2]) | (e[:, 1] != e[:, 3])]
    if not len(e):
        return
    low, high = corners.min(axis=0), corners.max(axis=0)
    wide = max(high - low)
    first = int(np.clip(np.floor(np.log2(_SPAN / max(wide, 1e-9))), 0, 24))
    size = _SPAN / 2**first
    ref = lambda x, y, s: (x + _AT[0] * s, y + _AT[1] * s)
    away = (low[0] - 0.37 * size, low[1] - 0.61 * size)
    todo = []
    for cx in range(int((low[0] - _ORIGIN) // size), int((high[0] - _ORIGIN) // size) + 1):
        for cy in range(int((low[1] - _ORIGIN) // size), int((high[1] - _ORIGIN) // size) + 1):
            x, y = _ORIGIN + cx * size, _ORIGIN + cy * size
            todo.append((first, cx, cy, _crossings(*away, *ref(x, y, size), e) % 2 == 1, _touching(x, y, size, e)))
    while todo:
        level, cx, cy, inside, own = todo.pop()
        size = _SPAN / 2**level
        x, y = _ORIGIN + cx * size, _ORIGIN + cy * size
        if not len(own) or level >= first + most or (level >= first + least and len(own) <= edges):
            if len(own) or inside:
                yield (level, cx, cy, *ref(x, y, size), inside, own)
            continue
        half = size / 2
        for dx in (0, 1):
            for dy in (0, 1):
                at = x + dx * half, y + dy * half
                side = inside ^ (_crossings(*ref(x, y, size), *ref(*at, half), own) % 2 == 1)
                todo.append((level + 1, 2 * cx + dx, 2 * cy + dy, side, _touching(*at, half, own)))


def quadtree_cover(regions: DataFrame, edges: int = EDGES) -> DataFrame:
    """Leaves of every region (region_nm, ring of lon and lat): region_nm and the columns of `COVER`. A region is one row, and is cut by one task."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in COVER.split(", ")]
        for frame in frames:
            for name, ring in zip(frame["region_nm"], frame["ring"], strict=True):
                corners = [(p["lon"], p["lat"]) for p in ring]
                rows = [(name, *leaf[:-1], [dict(zip(("x1", "y1", "x2", "y2"), e, strict=True)) for e in leaf[-1].tolist()]) for leaf in leaves(corners, edges)]
                yield pd.DataFrame(rows, columns=["region_nm", *names])

    kind = regions.schema["region_nm"].dataType.simpleString()
    return regions.where(F.col("ring").isNotNull()).select("region_nm", "ring").mapInPandas(cut, f"region_nm {kind}, {COVER}")


def _inside(x: Column, y: Column) -> Column:
    """Whether a point of a leaf lies strictly inside."""
    rx, ry = F.col("rx"), F.col("ry")

    def crosses(e: Column) -> Column:
        a = (rx - x) * (e["y1"] - y) - (ry - y) * (e["x1"] - x) > 0
        b = (rx - x) * (e["y2"] - y) - (ry - y) * (e["x2"] - x) > 0
        p = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]) > 0
        q = (e["x2"] - e["x1"]) * (ry - e["y1"]) - (e["y2"] - e["y1"]) * (rx - e["x1"]) > 0
        return (a != b) & (p != q)

    def touches(e: Column) -> Column:
        area = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (area == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    odd = F.size(F.filter("edges", crosses)) % 2 == 1
    return (F.size("edges") == 0) | ((F.col("inside") != odd) & ~F.exists("edges", touches))


def points_in_cover(points: DataFrame, cover: DataFrame, lon: str, lat: str) -> DataFrame:
    """Points joined with every region that strictly contains them: the points' columns and region_nm.

    A point has one key per level that has leaves (at most 25 + `MOST`, and few in practice). The cover is small next to the points and is broadcast by
    Spark while it is; beyond that a crowded cell is split by the adaptive skew join.
    """
    levels = sorted(r["level"] for r in cover.select("level").distinct().collect())
    sizes = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(_SPAN / 2**n).alias("size")) for n in levels]) if levels else F.array().cast("array<struct<level:int,size:double>>")
    x, y = F.col(lon), F.col(lat)
    cell = lambda c: F.floor((c - F.lit(_ORIGIN)) / F.col("_at.size")).cast("long")
    keyed = points.where(x.isNotNull() & y.isNotNull()).withColumn("_at", F.explode(sizes))
    keyed = keyed.select(*points.columns, F.col("_at.level").alias("_level"), cell(x).alias("_cx"), cell(y).alias("_cy"))
    named = cover.select("region_nm", F.col("level").alias("_level"), F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), "rx", "ry", "inside", "edges")
    met = keyed.join(named, ["_level", "_cx", "_cy"]).where(_inside(x, y))
    return met.select(*points.columns, "region_nm")


def region_points(points: DataFrame, regions: DataFrame, lon: str, lat: str) -> DataFrame:
    """Points joined to every region strictly containing them, through a quadtree cover that is made once and stored."""
    return points_in_cover(points, materialise(quadtree_cover(regions), "cover"), lon, lat)
