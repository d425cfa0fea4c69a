"""WGS84 geodesy, map projections and distances as Column expressions."""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

# WGS84 ellipsoid, mean Earth radius (km), metres per degree, UTM scale and false easting.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
EARTH_RADIUS_KM = 6371.0088
METRES_PER_DEGREE = 111320.0
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0

WGS84_B = WGS84_A * (1 - WGS84_F)
E_SQ = WGS84_F * (2 - WGS84_F)

Triple = tuple[Column, Column, Column]


def col(c: Column | str | float) -> Column:
    """A column from a name, a number or a column."""
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(float(c))


def _prime_vertical(sin_lat: Column) -> Column:
    return F.lit(WGS84_A) / F.sqrt(1 - E_SQ * sin_lat * sin_lat)


def evaluate_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add long expressions so that they are computed once per row.

    A filter or join condition on a plain projected column is pushed below the projection and repeats the whole
    expression there; a generator's output is not.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.withColumn("_once", made).select(*df.columns, "_once.*")


def geodetic_to_ecef(lat, lon, h) -> Triple:
    """Geodetic degrees and metres to Earth-centred metres."""
    phi, lam, h = F.radians(col(lat)), F.radians(col(lon)), col(h)
    n = _prime_vertical(F.sin(phi))
    across = (n + h) * F.cos(phi)
    return across * F.cos(lam), across * F.sin(lam), (n * (1 - E_SQ) + h) * F.sin(phi)


def ecef_to_geodetic(x, y, z) -> Triple:
    """Earth-centred metres to (lat, lon, height), one Bowring pass."""
    x, y, z = col(x), col(y), col(z)
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * WGS84_A, p * WGS84_B)
    second_e = E_SQ / (1.0 - E_SQ)
    phi = F.atan2(
        z + second_e * WGS84_B * F.pow(F.sin(theta), F.lit(3.0)),
        p - E_SQ * WGS84_A * F.pow(F.cos(theta), F.lit(3.0)),
    )
    height = p / F.cos(phi) - _prime_vertical(F.sin(phi))
    return F.degrees(phi), F.degrees(F.atan2(y, x)), height


def ecef_to_enu(x, y, z, ref_lat, ref_lon, ref_h) -> Triple:
    """Earth-centred metres to east, north, up about a reference point."""
    x0, y0, z0 = geodetic_to_ecef(ref_lat, ref_lon, ref_h)
    dx, dy, dz = col(x) - x0, col(y) - y0, col(z) - z0
    phi, lam = F.radians(col(ref_lat)), F.radians(col(ref_lon))
    radial = F.cos(lam) * dx + F.sin(lam) * dy
    east = F.cos(lam) * dy - F.sin(lam) * dx
    return east, F.cos(phi) * dz - F.sin(phi) * radial, F.cos(phi) * radial + F.sin(phi) * dz


def enu_to_ecef(east, north, up, ref_lat, ref_lon, ref_h) -> Triple:
    """East, north, up about a reference point to Earth-centred metres."""
    east, north, up = col(east), col(north), col(up)
    x0, y0, z0 = geodetic_to_ecef(ref_lat, ref_lon, ref_h)
    phi, lam = F.radians(col(ref_lat)), F.radians(col(ref_lon))
    radial = F.cos(phi) * up - F.sin(phi) * north
    return (
        x0 + F.cos(lam) * radial - F.sin(lam) * east,
        y0 + F.sin(lam) * radial + F.cos(lam) * east,
        z0 + F.cos(phi) * north + F.sin(phi) * up,
    )


def enu_to_geodetic(df: DataFrame, east, north, up, ref_lat, ref_lon, ref_h) -> DataFrame:
    """Add `lat`, `lon`, `depth` for ENU offsets. Staged so that each stage is evaluated once per row."""
    x, y, z = enu_to_ecef(east, north, up, ref_lat, ref_lon, ref_h)
    staged = df.withColumns({"_x": x, "_y": y, "_z": z})
    lat, lon, height = ecef_to_geodetic("_x", "_y", "_z")
    return staged.withColumns({"lat": lat, "lon": lon, "depth": -height}).drop("_x", "_y", "_z")


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in kilometres on the mean sphere."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    s_lat = F.sin((p2 - p1) / 2)
    s_lon = F.sin((F.radians(col(lon2)) - F.radians(col(lon1))) / 2)
    h = s_lat * s_lat + F.cos(p1) * F.cos(p2) * s_lon * s_lon
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def web_mercator(lon, lat) -> tuple[Column, Column]:
    """Spherical Mercator metres."""
    x = F.radians(col(lon)) * WGS84_A
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(col(lat)) / 2)) * WGS84_A
    return x, y


def mercator_distance(lon1, lat1, lon2, lat2) -> Column:
    """Planar distance of two points in spherical Mercator metres."""
    x1, y1 = web_mercator(lon1, lat1)
    x2, y2 = web_mercator(lon2, lat2)
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def mercator_box(lon: float, lat: float, radius: float) -> tuple[float, float, float, float]:
    """West, east, south and north border of a circle of projected metres, a hair wider than exact."""
    y = math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))
    south, north = (math.degrees(2 * math.atan(math.exp(y + d / WGS84_A)) - math.pi / 2) for d in (-radius, radius))
    reach = math.degrees(radius / WGS84_A)
    return lon - reach - 1e-9, lon + reach + 1e-9, south - 1e-9, north + 1e-9


def degrees_per_metre(lat) -> tuple[Column, Column]:
    """Degrees of latitude and of longitude covered by one metre."""
    return F.lit(1 / METRES_PER_DEGREE), 1 / (METRES_PER_DEGREE * F.cos(F.radians(col(lat))))


# Transverse Mercator series in the third flattening n. Rows: coefficients of n^j, n^(j+1), ... for term j.
_N = WGS84_F / (2 - WGS84_F)
_E = math.sqrt(E_SQ)
_RECTIFYING = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
# Published series coefficients (forward, then inverse), to sixth order.
FORWARD_SERIES = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
    [13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [49561 / 161280, -179 / 168, 6601661 / 7257600],
    [34729 / 80640, -3418889 / 1995840],
    [212378941 / 319334400],
]
INVERSE_SERIES = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800],
    [1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [4397 / 161280, -11 / 504, -830251 / 7257600],
    [4583 / 161280, -108847 / 3991680],
    [20648693 / 638668800],
]


def series_terms(rows: list[list[float]]) -> list[float]:
    """Evaluate the series rows at this ellipsoid's n."""
    return [sum(c * _N ** (j + p) for p, c in enumerate(row)) for j, row in enumerate(rows, start=1)]


def central_meridian(zone: int) -> float:
    return zone * 6.0 - 183.0


def _conformal(tau: Column) -> Column:
    sigma = F.sinh(_E * F.atanh(_E * tau / F.sqrt(1 + tau * tau)))
    return tau * F.sqrt(1 + sigma * sigma) - sigma * F.sqrt(1 + tau * tau)


def _series_sums(terms: list[float], xi: Column, eta: Column) -> tuple[Column, Column]:
    d_xi = d_eta = F.lit(0.0)
    for j, c in enumerate(terms, start=1):
        d_xi = d_xi + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        d_eta = d_eta + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return d_xi, d_eta


def utm_forward(df: DataFrame, lon, lat, zone: int, easting="easting", northing="northing") -> DataFrame:
    """Add UTM metres (northern hemisphere) for a zone. Intermediate columns keep the expressions small."""
    k = UTM_SCALE * _RECTIFYING
    tau, lam = F.col("_tau"), F.col("_lam")
    staged = df.withColumns(
        {"_tau": F.tan(F.radians(col(lat))), "_lam": F.radians(col(lon)) - math.radians(central_meridian(zone))}
    ).withColumn("_tau", _conformal(tau))
    staged = staged.withColumns(
        {
            "_xi": F.atan2(tau, F.cos(lam)),
            "_eta": F.asinh(F.sin(lam) / F.sqrt(tau * tau + F.cos(lam) * F.cos(lam))),
        }
    )
    d_xi, d_eta = _series_sums(series_terms(FORWARD_SERIES), F.col("_xi"), F.col("_eta"))
    return evaluate_once(
        staged, {easting: k * (F.col("_eta") + d_eta) + UTM_FALSE_EASTING, northing: k * (F.col("_xi") + d_xi)}
    ).drop("_tau", "_lam", "_xi", "_eta")


def utm_inverse(df: DataFrame, easting, northing, zone: int, lon="lon", lat="lat") -> DataFrame:
    """Add degrees for UTM metres (northern hemisphere) of a zone."""
    k = UTM_SCALE * _RECTIFYING
    xi, eta, tau = F.col("_xi"), F.col("_eta"), F.col("_tau")
    staged = df.withColumns({"_xi": col(northing) / k, "_eta": (col(easting) - UTM_FALSE_EASTING) / k})
    d_xi, d_eta = _series_sums(series_terms(INVERSE_SERIES), xi, eta)
    staged = staged.withColumns({"_xi": xi - d_xi, "_eta": eta - d_eta})
    staged = staged.withColumn(
        "_goal", F.sin(xi) / F.sqrt(F.sinh(eta) * F.sinh(eta) + F.cos(xi) * F.cos(xi))
    ).withColumn("_tau", F.col("_goal"))
    for _ in range(3):  # Newton steps on the conformal latitude
        staged = staged.withColumn("_now", _conformal(tau)).withColumn(
            "_tau",
            tau
            + (F.col("_goal") - F.col("_now"))
            / F.sqrt(1 + F.col("_now") * F.col("_now"))
            * (1 + (1 - E_SQ) * tau * tau)
            / ((1 - E_SQ) * F.sqrt(1 + tau * tau)),
        )
    return evaluate_once(
        staged,
        {
            lat: F.degrees(F.atan(tau)),
            lon: F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + central_meridian(zone),
        },
    ).drop("_xi", "_eta", "_tau", "_goal", "_now")


def _conformal_array(tau: np.ndarray) -> np.ndarray:
    root = np.sqrt(1 + tau * tau)
    sigma = np.sinh(_E * np.arctanh(_E * tau / root))
    return tau * np.sqrt(1 + sigma * sigma) - sigma * root


def utm_inverse_arrays(easting: np.ndarray, northing: np.ndarray, zone: int) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude as `utm_inverse` gives them, for arrays inside a task."""
    k = UTM_SCALE * _RECTIFYING
    xi, eta = northing / k, (easting - UTM_FALSE_EASTING) / k
    # The series in sin(2 j z), z = xi + i eta, summed by Clenshaw's recurrence: one sine for all terms.
    sin, cos, sinh, cosh = np.sin(2 * xi), np.cos(2 * xi), np.sinh(2 * eta), np.cosh(2 * eta)
    twice = 2 * (cos * cosh - 1j * sin * sinh)
    one = two = 0.0
    for c in reversed(series_terms(INVERSE_SERIES)):
        one, two = c + twice * one - two, one
    total = one * (sin * cosh + 1j * cos * sinh)
    xi, eta = xi - total.real, eta - total.imag
    across, along = np.sinh(eta), np.cos(xi)
    goal = np.sin(xi) / np.sqrt(across * across + along * along)
    tau = goal
    for _ in range(3):  # Newton steps on the conformal latitude
        now = _conformal_array(tau)
        tau = tau + (goal - now) / np.sqrt(1 + now * now) * (1 + (1 - E_SQ) * tau * tau) / ((1 - E_SQ) * np.sqrt(1 + tau * tau))
    return np.degrees(np.arctan2(across, along)) + central_meridian(zone), np.degrees(np.arctan(tau))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
