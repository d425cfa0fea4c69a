"""Small column functions of the catalogue and of the velocity grids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .geodesy import col

# Pick types taking part in the P/S pairing, and the ones kept by the box query.
PAIRED_TYPES = ("P", "S", "Pg", "Sg", "Pn", "Sn", "Pb", "Sb")
BOX_TYPES = ("P", "S", "Pg", "Sg")
SUBTYPES = ("g", "n", "b")


def epoch_micros(ts) -> Column:
    """Microseconds since 1970 of a zone-less timestamp (session zone is UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def travel_seconds(start, end) -> Column:
    """Seconds from `start` to `end`, microsecond resolution."""
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(1e6)


def wave_subtype(arrival_type) -> Column:
    """Trailing letter g, n or b of a pick type, otherwise NULL."""
    c = col(arrival_type)
    last = F.right(c, F.lit(1))
    return F.when(last.isin(*SUBTYPES), last)


def wave_phase(arrival_type) -> Column:
    """Velocity column a pick type travels with: vp for P picks, vs for the rest."""
    return F.when(F.upper(F.substring(col(arrival_type), 1, 1)) == "P", "vp").otherwise("vs")


def station_id(station_nm, network_nm) -> Column:
    return F.concat_ws("_", col(station_nm), col(network_nm))


def json_path(doc, *keys: str) -> Column:
    """Text at a key path of a JSON column, NULL if any key is missing."""
    return F.get_json_object(col(doc), "$" + "".join(f".{k}" for k in keys))


def json_number(text: Column) -> Column:
    """A number from JSON text; the text NaN (any case) counts as missing."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def nan_as_text(value) -> Column:
    """Legacy JSON export form of a double: the text NaN for NaN, digits otherwise."""
    c = col(value)
    return F.when(F.isnan(c), "NaN").otherwise(c.cast("string"))


def run_name(*parts, at: Column | None = None) -> Column:
    """Parts joined by underscores, with an optional yyyyMMddHHmmss stamp."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    if at is not None:
        cols.append(F.date_format(at, "yyyyMMddHHmmss"))
    return F.concat_ws("_", *cols)


def snap_surface_depth(depth, cube_side) -> Column:
    """Depths at most one cell above the surface become 0."""
    d = col(depth)
    return F.when((-d >= 0) & (-d <= col(cube_side)), 0.0).otherwise(d)


def relative_diff(a, b) -> Column:
    """Absolute difference over the mean magnitude; 0 where both are 0."""
    a, b = col(a), col(b)
    mean = (F.abs(a) + F.abs(b)) / 2
    return F.when(mean == 0, 0.0).otherwise(F.abs(a - b) / F.nullif(mean, F.lit(0.0)))


def ratio_diff(a, b) -> Column:
    """a / b, with 0/0 as 0 and x/0 as infinity."""
    a, b = col(a), col(b)
    return (
        F.when((a == 0) & (b == 0), 0.0)
        .when(b == 0, F.lit(float("inf")))
        .otherwise(a / F.nullif(b, F.lit(0.0)))
    )


@dataclass(frozen=True)
class SoftLimit:
    """How far beyond a bound a value may stay: an excess shrinks by 1 + strength * growth(excess / bound)."""

    growth: Callable[[Column], Column]
    strength: float

    def rest(self, excess: Column, bound: float) -> Column:
        return excess / (1.0 + self.strength * self.growth(excess / max(bound, 1e-12)))


def exponential(rate: float) -> Callable[[Column], Column]:
    return lambda x: F.expm1(F.least(rate * x, F.lit(50.0)))


def power(exponent: float) -> Callable[[Column], Column]:
    return lambda x: F.pow(x, F.lit(exponent))


def bound_velocity(v, v_min: float, v_max: float, below: SoftLimit, above: SoftLimit) -> Column:
    """Pull velocities outside [v_min, v_max] back towards the nearer bound; an empty interval changes nothing."""
    v = col(v)
    if v_min >= v_max:
        return v
    nearest = F.least(F.greatest(v, F.lit(float(v_min))), F.lit(float(v_max)))
    excess = F.abs(v - nearest)
    return F.when(v == nearest, v).when(v < nearest, nearest - below.rest(excess, v_min)).otherwise(nearest + above.rest(excess, v_max))


def apply_slowness(v, delta_s) -> Column:
    """Velocity after a slowness correction; slowness is kept at or above 1e-12."""
    return 1.0 / F.greatest(1.0 / col(v) + col(delta_s), F.lit(1e-12))


def biased_depth(u, z_max: float, bias: float) -> Column:
    """Map u in [0,1] to a depth in [0, z_max], denser with depth for bias > 0."""
    u = col(u)
    if bias == 0:
        return u * z_max
    import math

    z = (z_max / bias) * F.log(1.0 + u * (math.exp(bias) - 1.0))
    return F.greatest(F.lit(0.0), F.least(z, F.lit(float(z_max))))


def corner_distance(i, j, corner_i: float = 0.0, corner_j: float = 0.0, digits: int = 5) -> Column:
    """Rounded distance between cell centres, in cell units."""
    di, dj = col(i) - corner_i, col(j) - corner_j
    return F.round(F.sqrt((di * di + dj * dj).cast("double")), digits)
