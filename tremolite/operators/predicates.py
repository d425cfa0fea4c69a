"""Row filters of the catalogue."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geodesy import col
from ..functions.scalars import travel_seconds


@dataclass(frozen=True)
class Box:
    """A lon/lat rectangle; corners may be given in any order."""

    lon_a: float
    lat_a: float
    lon_b: float
    lat_b: float

    def _sides(self):
        lons, lats = sorted((self.lon_a, self.lon_b)), sorted((self.lat_a, self.lat_b))
        return lons, lats

    def touches(self, lon, lat) -> Column:
        """Edges included."""
        lons, lats = self._sides()
        return col(lon).between(*lons) & col(lat).between(*lats)

    def contains(self, lon, lat) -> Column:
        """Edges excluded."""
        lons, lats = self._sides()
        lon, lat = col(lon), col(lat)
        return (lon > lons[0]) & (lon < lons[1]) & (lat > lats[0]) & (lat < lats[1])


# The default search box of the catalogue queries.
DEFAULT_BOX = Box(-120.5, 31.0, -113.5, 36.5)


def in_days(ts, first: str, last: str) -> Column:
    """Whole days, both ends included. The cast is unwrapped into a timestamp range at the scan."""
    day = col(ts).cast("date")
    return (day >= F.lit(date.fromisoformat(first))) & (day <= F.lit(date.fromisoformat(last)))


def since_year(ts, year: int) -> Column:
    """Calendar year >= `year`, written on the raw column so that it reaches the scan."""
    return col(ts) >= F.lit(date(year, 1, 1)).cast("timestamp_ntz")


def positive_travel(start, end) -> Column:
    return travel_seconds(start, end) > 0


def travel_below(seconds: float, *travel) -> Column:
    """All travel times within [0, seconds)."""
    keep = F.lit(True)
    for t in travel:
        keep = keep & (col(t) >= 0) & (col(t) < seconds)
    return keep


def enough_measurements(n="n_measurements", minimum: int = 125) -> Column:
    return col(n) >= minimum


def in_strip(lon, lat, slope: float = 0.86, lower: float = -89.0, upper: float = -82.0) -> Column:
    """Band between two parallel lines lat = slope * lon + offset, edges included."""
    line = col(lat) - slope * col(lon)
    return (line >= lower) & (line <= upper)


def wavefront(field: DataFrame, t0: float, dt: float, t: str = "t") -> DataFrame:
    """Cells reached within dt of t0, with the time scaled to [0, 1]."""
    lo, hi = t0 - dt, t0 + dt
    return field.filter(col(t).between(lo, hi)).withColumn("norm_time", (col(t) - lo) / (2 * dt))


def ring_edges(regions: DataFrame, ring: str = "ring") -> DataFrame:
    """Add `edges` (segments between consecutive ring corners, closed) and the bounding box."""
    n = F.size(ring)
    nxt = F.concat(F.slice(ring, F.lit(2), n - 1), F.slice(ring, F.lit(1), F.lit(1)))
    edges = F.zip_with(
        ring,
        nxt,
        lambda a, b: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")),
    )
    lons, lats = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return regions.withColumns(
        {
            "edges": edges,
            "lon_min": F.array_min(lons),
            "lon_max": F.array_max(lons),
            "lat_min": F.array_min(lats),
            "lat_max": F.array_max(lats),
        }
    )


def inside_edges(lon, lat, edges) -> Column:
    """Ray-cast parity over an edge array; points on the boundary are outside."""
    x, y, edges = col(lon), col(lat), col(edges)

    def crosses(e):
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < at)

    def touches(e):
        area = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (
            (area == 0)
            & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )

    return (F.size(F.filter(edges, crosses)) % 2 == 1) & ~F.exists(edges, touches)


def first_per_key(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One stated row per key: the smallest by `order`. An aggregate, so a hot key is reduced before the shuffle."""
    picked = F.min_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("_row")).select("_row.*")
