"""SQL fragments for the checking engine."""

from __future__ import annotations

A = "6378137.0e0"
FLAT = "(1/298.257223563e0)"
ESQ = f"({FLAT}*(2-{FLAT}))"
B = f"({A}*(1-{FLAT}))"


def seconds(start: str, end: str) -> str:
    return f"((epoch_us({end}) - epoch_us({start}))/1e6)"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = (
        f"(pow(sin((radians({lat2})-radians({lat1}))/2),2) + cos(radians({lat1}))*cos(radians({lat2}))"
        f"*pow(sin((radians({lon2})-radians({lon1}))/2),2))"
    )
    return f"(2*6371.0088e0*asin(least(1.0e0, sqrt({h}))))"


def mercator(lon: str, lat: str) -> tuple[str, str]:
    return f"({A}*radians({lon}))", f"({A}*ln(tan(pi()/4 + radians({lat})/2)))"


def mercator_distance(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    (x1, y1), (x2, y2) = mercator(lon1, lat1), mercator(lon2, lat2)
    return f"sqrt(pow({x1}-{x2},2) + pow({y1}-{y2},2))"


def ecef(lat: str, lon: str, h: str) -> tuple[str, str, str]:
    phi, lam = f"radians({lat})", f"radians({lon})"
    n = f"({A}/sqrt(1-{ESQ}*pow(sin({phi}),2)))"
    return (
        f"(({n}+{h})*cos({phi})*cos({lam}))",
        f"(({n}+{h})*cos({phi})*sin({lam}))",
        f"(({n}*(1-{ESQ})+{h})*sin({phi}))",
    )


def enu(lat: str, lon: str, h: str, ref: tuple[str, str, str]) -> tuple[str, str, str]:
    (x, y, z), (x0, y0, z0) = ecef(lat, lon, h), ecef(*ref)
    p, q = f"radians({ref[0]})", f"radians({ref[1]})"
    dx, dy, dz = f"({x}-{x0})", f"({y}-{y0})", f"({z}-{z0})"
    return (
        f"(-sin({q})*{dx}+cos({q})*{dy})",
        f"(-sin({p})*cos({q})*{dx}-sin({p})*sin({q})*{dy}+cos({p})*{dz})",
        f"(cos({p})*cos({q})*{dx}+cos({p})*sin({q})*{dy}+sin({p})*{dz})",
    )


def from_enu(e: str, n: str, u: str, ref: tuple[str, str, str]) -> tuple[str, str, str]:
    """ECEF of ENU offsets."""
    x0, y0, z0 = ecef(*ref)
    p, q = f"radians({ref[0]})", f"radians({ref[1]})"
    return (
        f"({x0} - sin({q})*({e}) - sin({p})*cos({q})*({n}) + cos({p})*cos({q})*({u}))",
        f"({y0} + cos({q})*({e}) - sin({p})*sin({q})*({n}) + cos({p})*sin({q})*({u}))",
        f"({z0} + cos({p})*({n}) + sin({p})*({u}))",
    )


def geodetic(x: str, y: str, z: str) -> tuple[str, str, str]:
    """lat, lon, height of ECEF columns (single Bowring step)."""
    p = f"sqrt({x}*{x}+{y}*{y})"
    th = f"atan2({z}*{A}, {p}*{B})"
    lat = f"atan2({z} + ({ESQ}/(1-{ESQ}))*{B}*pow(sin({th}),3), {p} - {ESQ}*{A}*pow(cos({th}),3))"
    h = f"({p}/cos({lat}) - {A}/sqrt(1-{ESQ}*pow(sin({lat}),2)))"
    return f"degrees({lat})", f"degrees(atan2({y},{x}))", h


def inside(points: str, lon: str, lat: str, cols: str) -> str:
    """Points (a relation) strictly inside regions, by counting edge crossings."""
    return f"""select {cols}, g.region_nm from {points} p join in_region_edges g
      on (g.y1 > p.{lat}) <> (g.y2 > p.{lat}) and p.{lon} < (g.x2-g.x1)*(p.{lat}-g.y1)/(g.y2-g.y1)+g.x1
      group by {cols}, g.region_nm having count(*) % 2 = 1"""


def rnd(e: str, digits: int) -> str:
    """Rounding without a negative zero."""
    return f"case when round({e}, {digits}) = 0 then 0.0e0 else round({e}, {digits}) end"


def fine(e: str, digits: int) -> str:
    """Rounding two places finer than `digits`, exact halves upwards."""
    unit = f"1{'0' * (digits + 2)}.0e0"
    return f"(cast(floor(({e})*{unit} + 0.5e0) as bigint)/{unit})"
