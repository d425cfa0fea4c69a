"""Geodesy, lattices, velocity cells and stored fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geodesy as geo, scalars as sc
from ..operators import catalogue as cat, cells as ce, fields as fd
from . import r, register, fine
from . import sqltext as q
from .sqltext import fine as st

TOP = ce.TopPoint(161.0, 53.5, 0.0)
LATTICE = ce.Lattice(TOP, 150000.0, 5, 5, 5)
REF = ("53.5e0", "161.0e0", "0.0e0")
HERE = ("lat", "lon", "(-depth)")
KEYS = ["model_id"]
ID = ["model_id", "i", "j", "k"]
LOCATED = "from in_quakes where lon is not null"


def located(tb):
    return tb.quakes.dropna(subset=["lon", "lat"])


X, Y, Z = q.ecef(*HERE)


@register("geodetic_to_ecef", f"select event_id, round({X},2) x, round({Y},2) y, round({Z},2) z {LOCATED}", "quakes")
def geodetic_to_ecef(tb):
    x, y, z = geo.geodetic_to_ecef("lat", "lon", -F.col("depth"))
    return located(tb).select("event_id", r(x, 2, "x"), r(y, 2, "y"), r(z, 2, "z"))


GLAT, GLON, GH = q.geodetic("x", "y", "z")


@register(
    "ecef_to_geodetic",
    f"with p as (select event_id, {X} x, {Y} y, {Z} z {LOCATED}) select event_id, round({GLAT},7) lat, round({GLON},7) lon, {q.rnd(GH, 2)} h from p",
    "quakes",
)
def ecef_to_geodetic(tb):
    x, y, z = geo.geodetic_to_ecef("lat", "lon", -F.col("depth"))
    staged = located(tb).select("event_id", x.alias("x"), y.alias("y"), z.alias("z"))
    lat, lon, h = geo.ecef_to_geodetic("x", "y", "z")
    return staged.select("event_id", r(lat, 7, "lat"), r(lon, 7, "lon"), r(h, 2, "h"))


EE, EN, EU = q.enu(*HERE, REF)


@register(
    "ecef_to_enu", f"select event_id, {q.rnd(EE, 2)} east, {q.rnd(EN, 2)} north, {q.rnd(EU, 2)} up {LOCATED}", "quakes"
)
def ecef_to_enu(tb):
    x, y, z = geo.geodetic_to_ecef("lat", "lon", -F.col("depth"))
    staged = located(tb).withColumns({"x": x, "y": y, "z": z})
    e, n, u = geo.ecef_to_enu("x", "y", "z", TOP.lat, TOP.lon, -TOP.depth)
    return staged.select("event_id", r(e, 2, "east"), r(n, 2, "north"), r(u, 2, "up"))


FX, FY, FZ = q.from_enu("depth", "2*depth", "-depth", ("lat", "lon", "0"))


@register("enu_to_ecef", f"select event_id, round({FX},2) x, round({FY},2) y, round({FZ},2) z {LOCATED}", "quakes")
def enu_to_ecef(tb):
    d = F.col("depth")
    x, y, z = geo.enu_to_ecef(d, 2 * d, -d, "lat", "lon", 0.0)
    return located(tb).select("event_id", r(x, 2, "x"), r(y, 2, "y"), r(z, 2, "z"))


MX, MY = q.mercator("lon", "lat")


@register("web_mercator", f"select event_id, round({MX},3) x, round({MY},3) y {LOCATED}", "quakes")
def web_mercator(tb):
    x, y = geo.web_mercator("lon", "lat")
    return located(tb).select("event_id", r(x, 3, "x"), r(y, 3, "y"))


ZONE = 57


def _series(name: str, terms: list[float]) -> tuple[str, str]:
    xi = " + ".join(f"({c!r}::double)*sin({2 * j}*{name}x)*cosh({2 * j}*{name}e)" for j, c in enumerate(terms, 1))
    eta = " + ".join(f"({c!r}::double)*cos({2 * j}*{name}x)*sinh({2 * j}*{name}e)" for j, c in enumerate(terms, 1))
    return xi, eta


SX, SE = _series("a", geo.series_terms(geo.FORWARD_SERIES))
UTM_SQL = f"""a as (select *, tan(radians(lat)) tau, radians(lon - {geo.central_meridian(ZONE)}) lam {LOCATED}),
    b as (select *, sinh(sqrt({q.ESQ})*atanh(sqrt({q.ESQ})*tau/sqrt(1+tau*tau))) sg from a),
    c as (select *, tau*sqrt(1+sg*sg) - sg*sqrt(1+tau*tau) tc from b),
    d as (select *, atan2(tc, cos(lam)) ax, asinh(sin(lam)/sqrt(tc*tc + cos(lam)*cos(lam))) ae from c),
    u as (select event_id, lon, lat, 500000 + {geo.UTM_SCALE * geo._RECTIFYING!r}*(ae + {SE}) easting, {geo.UTM_SCALE * geo._RECTIFYING!r}*(ax + {SX}) northing from d)"""


@register(
    "utm_forward",
    f"with {UTM_SQL} select event_id, round(easting, 3) easting, round(northing, 3) northing from u",
    "quakes",
)
def utm_forward(tb):
    out = geo.utm_forward(located(tb), "lon", "lat", ZONE)
    return out.select("event_id", r("easting", 3), r("northing", 3))


@register("utm_inverse", "select event_id, round(lon, 8) lon, round(lat, 8) lat from in_quakes where lon is not null", "quakes")
def utm_inverse(tb):
    """Back from projected metres: must give the coordinates the metres were made from."""
    there = geo.utm_forward(located(tb), "lon", "lat", ZONE).select("event_id", "easting", "northing")
    return geo.utm_inverse(there, "easting", "northing", ZONE).select("event_id", r("lon", 8), r("lat", 8))


@register(
    "deg_per_metre",
    f"select event_id, 1/111320.0e0 as per_lat, round(1e6/(111320*cos(radians(lat))), 8) as per_lon_km {LOCATED}",
    "quakes",
)
def deg_per_metre(tb):
    a, b = geo.degrees_per_metre("lat")
    return located(tb).select("event_id", a.alias("per_lat"), r(b * 1e6, 8, "per_lon_km"))


@register(
    "station_id",
    "select station_nm||'_'||network_nm as station_id, lon, lat from in_stations",
    "stations",
)
def station_id(tb):
    return tb.stations.select(sc.station_id("station_nm", "network_nm").alias("station_id"), "lon", "lat")


@register(
    "run_name",
    """select event_id, 'table_fmm_'||cast(event_id as varchar)||'_'||strftime(event_dttm, '%Y%m%d%H%M%S') as name,
      'exp_'||event_type||'_'||cast(event_id as varchar) as plain from in_quakes""",
    "quakes",
)
def run_name(tb):
    return tb.quakes.select(
        "event_id",
        sc.run_name("table", "fmm", F.col("event_id"), at=F.col("event_dttm")).alias("name"),
        sc.run_name("exp", F.col("event_type"), F.col("event_id")).alias("plain"),
    )


@register(
    "snap_surface_depth",
    "select event_id, case when 3000 - depth >= 0 and 3000 - depth <= 2000 then 0.0e0 else depth - 3000 end as depth from in_quakes",
    "quakes",
)
def snap_surface_depth(tb):
    shifted = tb.quakes.select("event_id", (F.col("depth") - 3000).alias("d"))
    return shifted.select("event_id", sc.snap_surface_depth("d", 2000.0).alias("depth"))


PAIR_SQL = "from in_cells m join in_true_cells t on m.model_id = t.model_id and m.i = t.i and m.j = t.j and m.k = t.k"


def _pairs(tb):
    truth = tb.true_cells.select(*ID, F.col("vp").alias("b"))
    # Cells of zero velocity on either side exercise the zero rules.
    return tb.cells.select(*ID, F.when((F.col("i") + F.col("j") + 2 * F.col("k")) % 17 == 0, 0.0).otherwise(F.col("vp")).alias("a")).join(truth, ID)


A_SQL = "case when (m.i + m.j + 2*m.k) % 17 = 0 then 0.0e0 else m.vp end"


@register(
    "relative_diff",
    f"""select model_id, i, j, k, case when a = 0 and b = 0 then 0.0e0 else round(abs(a-b)/((abs(a)+abs(b))/2), 4) end diff,
    case when a = 0 and b = 0 then 0.0e0 when b = 0 then 'inf'::double else round(a/b, 3) end ratio
    from (select m.model_id, m.i, m.j, m.k, {A_SQL} a, t.vp b {PAIR_SQL}) z""",
    "cells true_cells",
)
def relative_diff(tb):
    return _pairs(tb).select(*ID, r(sc.relative_diff("a", "b"), 4, "diff"), F.when(sc.ratio_diff("a", "b") == float("inf"), sc.ratio_diff("a", "b")).otherwise(F.round(sc.ratio_diff("a", "b"), 3)).alias("ratio"))


@register(
    "bound_velocity",
    """select model_id, i, j, k, round(case
      when vp < 2500 then 2500 - (2500-vp)/(1 + 3*(exp(least(6*(2500-vp)/2500, 50)) - 1))
      when vp > 3500 then 3500 + (vp-3500)/(1 + 3*pow((vp-3500)/3500, 2)) else vp end, 6) vp from in_cells""",
    "cells",
)
def bound_velocity(tb):
    return tb.cells.select(*ID, r(sc.bound_velocity("vp", 2500.0, 3500.0, sc.SoftLimit(sc.exponential(6.0), 3.0), sc.SoftLimit(sc.power(2.0), 3.0)), 6, "vp"))


@register(
    "apply_slowness",
    "select model_id, i, j, k, round(1/greatest(1/vp + (i-5)*1e-4, 1e-12), 3) vp from in_cells",
    "cells",
)
def apply_slowness(tb):
    return tb.cells.select(*ID, r(sc.apply_slowness("vp", (F.col("i") - 5) * 1e-4), 3, "vp"))


@register(
    "normalise_depth_bias",
    "select event_id, round(greatest(0, least((40000/1.5e0)*ln(1 + (depth/61000)*(exp(1.5e0)-1)), 40000)), 5) z from in_quakes",
    "quakes",
)
def normalise_depth_bias(tb):
    return tb.quakes.select("event_id", r(sc.biased_depth(F.col("depth") / 61000, 40000.0, 1.5), 5, "z"))


@register(
    "distance_from_corner",
    "select model_id, i, j, k, round(sqrt(i*i + j*j), 5) d, round(sqrt((9-i)*(9-i) + j*j), 2) d_right from in_cells",
    "cells",
)
def distance_from_corner(tb):
    return tb.cells.select(*ID, sc.corner_distance("i", "j").alias("d"), sc.corner_distance("i", "j", 9.0, 0.0, 2).alias("d_right"))


# --- lattices ----------------------------------------------------------------------------------------------------

STEPS = "(select a.i dz, b.i - 2 dx, c.i - 2 dy from range(3) a(i) cross join range(5) b(i) cross join range(5) c(i)) s"
LX, LY, LZ = q.from_enu("dx*1000", "dy*1000", "dz*-1000", ("lat", "lon", "0"))


@register(
    "lattice_cells",
    f"""with p as (select station_nm, network_nm, dz, dx, dy, {LX} x, {LY} y, {LZ} z from in_stations cross join {STEPS} where lon is not null)
    select station_nm, network_nm, dz, dx, dy, round({GLAT},5) lat, round({GLON},5) lon, {q.rnd(f'-({GH})', 2)} as depth from p""",
    "stations",
)
def lattice_cells(tb):
    tops = tb.stations.dropna(subset=["lon", "lat"]).withColumn("depth", F.lit(0.0))
    out = ce.lattices_around(tops, 1000.0, 5, 5, 3)
    return out.select("station_nm", "network_nm", "dz", "dx", "dy", "lat", "lon", r("depth", 2))


@register(
    "lattice_cells_flat",
    """with p as (select station_nm, network_nm, a.i dz, b.i dx, c.i dy, lon, lat - c.i*100/111320.0e0 lat2
      from in_stations cross join range(4) a(i) cross join range(6) b(i) cross join range(5) c(i) where lon is not null)
    select station_nm, network_nm, dz, dx, -dy as dy, dz*100.0e0 as depth, round(lat2, 8) lat, round(lon + dx*100/(111320*cos(radians(lat2))), 8) lon from p""",
    "stations",
)
def lattice_cells_flat(tb):
    tops = tb.stations.dropna(subset=["lon", "lat"]).withColumn("depth", F.lit(0.0))
    out = ce.lattices_flat(tops, 100.0, 6, 5, 4)
    return out.select("station_nm", "network_nm", "dz", "dx", "dy", "depth", r("lat", 8), r("lon", 8))


CX, CY, CZ = q.from_enu("dx*30000", "dy*30000", "dz*-30000", ("lat", "lon", "0"))


@register(
    "lattice_cells_corner",
    f"""with p as (select station_nm, network_nm, a.i dz, b.i dx, -c.i dy, lat, lon from in_stations cross join range(3) a(i) cross join range(4) b(i) cross join range(5) c(i) where lon is not null),
    e as (select *, {CX} x, {CY} y, {CZ} z from p)
    select station_nm, network_nm, dz, dx, dy, round({GLAT},7) lat, round({GLON},7) lon, {q.rnd(f'-({GH})', 2)} as depth from e""",
    "stations",
)
def lattice_cells_corner(tb):
    tops = tb.stations.dropna(subset=["lon", "lat"]).withColumn("depth", F.lit(0.0))
    out = ce.lattices_from_corner(tops, 30000.0, 4, 5, 3)
    return out.select("station_nm", "network_nm", "dz", "dx", "dy", r("lat", 7), r("lon", 7), r("depth", 2))


@register(
    "offset_mesh",
    """select station_nm, network_nm, a.i as a, b.i as b, round(lat + (-500 + a.i*50)*(1/111320.0e0), 8) mesh_lat,
      round(lon + (-500 + b.i*50)*(1/(111320*cos(radians(lat)))), 8) mesh_lon from in_stations cross join range(21) a(i) cross join range(21) b(i) where lon is not null""",
    "stations",
)
def offset_mesh(tb):
    out = ce.offset_mesh(tb.stations.dropna(subset=["lon", "lat"]), 500.0, 50.0)
    return out.select("station_nm", "network_nm", "a", "b", r("mesh_lat", 8), r("mesh_lon", 8))


LOCATE = f"""select *, cast(round_even({EE}/150000, 0) as int) dx, cast(round_even({EN}/150000, 0) as int) dy,
    cast(round_even(-{EU}/150000, 0) as int) dz from """


@register(
    "locate_cell",
    f"""select event_id, case when ok then dz end z, case when ok then dx + 2 end x, case when ok then dy + 2 end y from
    (select *, abs(dx) <= 2 and abs(dy) <= 2 and dz between 0 and 4 as ok from ({LOCATE} in_quakes where lon is not null) a) b""",
    "quakes",
)
def locate_cell(tb):
    return ce.locate_cells(located(tb), LATTICE).select("event_id", "z", "x", "y")


ADD_CELLS = f"""select station_nm, network_nm, dz z, dx + 2 as x, dy + 2 as y from
    ({LOCATE} (select *, 0.0e0 as depth from in_stations where lon is not null) s) a where abs(dx) <= 2 and abs(dy) <= 2 and dz between 0 and 4"""


@register("add_cell_coords", ADD_CELLS, "stations")
def add_cell_coords(tb):
    return ce.add_cell_coords(tb.stations, LATTICE).select("station_nm", "network_nm", "z", "x", "y")


@register(
    "metric_to_cell",
    """select o_orderkey as event_id, case when x >= 0 then cast(least(floor(x/500), 9) as int) end i,
      case when x >= 0 then cast(least(floor(y/500), 7) as int) end j, case when x < 0 then 'negative coordinate' end error
    from (select *, o_totalprice/50 - 1000 as x, o_custkey*3.0e0 as y from orders) o""",
)
def metric_to_cell(tb):
    rows = tb.table("orders").select(
        F.col("o_orderkey").alias("event_id"), (F.col("o_totalprice") / 50 - 1000).alias("mx"), (F.col("o_custkey") * 3.0).alias("my")
    )
    return ce.metric_to_cell(rows, {"i": ("mx", 10), "j": ("my", 8)}, 500.0).drop("mx", "my")


@register(
    "fill_linear_gradient",
    "select model_id, i, j, k, 1000 + k*(4000.0e0/3) as vp, vs from in_cells",
    "cells",
)
def fill_linear_gradient(tb):
    return tb.cells.select(*ID, ce.linear_gradient(1000.0, 5000.0, 4).alias("vp"), "vs")


@register(
    "set_cells",
    """select m.model_id, m.i, m.j, m.k, case when t.vp > 3000 then t.vp else m.vp end vp, m.vs
    from in_cells m left join in_true_cells t on m.model_id = t.model_id and m.i = t.i and m.j = t.j and m.k = t.k""",
    "cells true_cells",
)
def set_cells(tb):
    return ce.set_cells(tb.cells, tb.true_cells.filter("vp > 3000"), ID, ["vp"]).select(*ID, "vp", "vs")


@register("set_all_cells", "select model_id, i, j, k, vp, vs from in_true_cells", "true_cells")
def set_all_cells(tb):
    return ce.set_all_cells(tb.cells, tb.true_cells, ID, ["vp", "vs"]).select(*ID, "vp", "vs")


@register(
    "get_cell",
    """select distinct model_id, i, j, k, vp from in_cells where (model_id, i, j, k) in
      (select cast(floor(l_partkey/400) as int), l_partkey % 10, cast(floor(l_partkey/10) as int) % 10, cast(floor(l_partkey/100) as int) % 4
       from lineitem where l_quantity > 45)""",
    "cells",
)
def get_cell(tb):
    p = F.col("l_partkey")
    part = lambda n: F.floor(p / n).cast("int")
    wanted = tb.table("lineitem").filter("l_quantity > 45").select(
        part(400).alias("model_id"), (p % 10).cast("int").alias("i"), (part(10) % 10).alias("j"), (part(100) % 4).alias("k")
    )
    return ce.get_cells(tb.cells, wanted, ID).select(*ID, "vp")


FINE = "cross join range(3) x(i) cross join range(3) y(i) cross join range(3) z(i)"


@register(
    "refine_grid",
    f"select model_id, cast(c.i*3 + x.i as int) i, cast(c.j*3 + y.i as int) j, cast(c.k*3 + z.i as int) k, vp, vs from in_cells c {FINE}",
    "cells",
)
def refine_grid(tb):
    return ce.refine(tb.cells, 3, KEYS, ["vp", "vs"])


def _corner_joins(value: str = "vp") -> str:
    """The eight corners by eight joins with clamped indices."""
    out = ["(select model_id, max(i) mi, max(j) mj, max(k) mk from in_cells group by 1) g on g.model_id = c.model_id"]
    for a, b, c in ce.CORNERS:
        t = f"c{a}{b}{c}"
        out.append(
            f"in_cells {t} on {t}.model_id = c.model_id and {t}.i = least(c.i+{a}, g.mi) and {t}.j = least(c.j+{b}, g.mj) and {t}.k = least(c.k+{c}, g.mk)"
        )
    return " join ".join(["in_cells c", *out])


def _lerp(di: str, dj: str, dk: str) -> str:
    w = lambda bit, f: f"({f})" if bit else f"(1-{f})"
    return " + ".join(f"c{a}{b}{c}.vp*{w(a, di)}*{w(b, dj)}*{w(c, dk)}" for a, b, c in ce.CORNERS)


@register(
    "refine_trilinear",
    f"""select c.model_id, cast(c.i*3 + x.i as int) i, cast(c.j*3 + y.i as int) j, cast(c.k*3 + z.i as int) k,
    round({_lerp('x.i/3.0e0', 'y.i/3.0e0', 'z.i/3.0e0')}, 5) vp from {_corner_joins()} {FINE}""",
    "cells",
)
def refine_trilinear(tb):
    return ce.refine(tb.cells, 3, KEYS, ["vp"], "trilinear").select(*ID, r("vp", 5))


GAUSS = "(exp(-pow(x.i/2.0e0-0.5,2)/0.5)*exp(-pow(y.i/2.0e0-0.5,2)/0.5)*exp(-pow(z.i/2.0e0-0.5,2)/0.5))"


@register(
    "refine_custom",
    f"""select c.model_id, cast(c.i*2 + x.i as int) i, cast(c.j*2 + y.i as int) j, cast(c.k*2 + z.i as int) k,
    round(c000.vp*{GAUSS} + c111.vp*(1-{GAUSS}), 5) vp from {_corner_joins()} cross join range(2) x(i) cross join range(2) y(i) cross join range(2) z(i)""",
    "cells",
)
def refine_custom(tb):
    """A caller's own interpolation: Gaussian weight between the near and the far corner."""

    def gaussian(corner, di, dj, dk):
        w = F.lit(1.0)
        for d in (di, dj, dk):
            w = w * F.exp(-(d - 0.5) * (d - 0.5) / 0.5)
        return corner(0, 0, 0) * w + corner(1, 1, 1) * (1 - w)

    return ce.refine(tb.cells, 2, KEYS, ["vp"], gaussian).select(*ID, r("vp", 5))


@register(
    "coarsen_sum",
    """select model_id, cast(floor(i/2) as int) i, cast(floor(j/2) as int) j, cast(floor(k/2) as int) k, round(sum(vp), 5) vp
    from in_cells group by all""",
    "cells",
)
def coarsen_sum(tb):
    out = ce.coarsen_sum(tb.cells, 2, KEYS, "vp", (10, 10, 4))
    return out.select(*ID, r("vp", 5))


# Irregular axes; the value grid on them is summed up from the velocity cells of all models.
AXES = {"lon": [156.0, 157.5, 160.0, 161.0, 164.5], "lat": [50.5, 52.0, 53.0, 56.0], "depth": [0.0, 5000.0, 20000.0]}


def _node_values(tb):
    """Mean velocity over all models at the nodes of the irregular grid."""
    return tb.cells.groupBy((F.col("i") % 5).alias("i"), (F.col("j") % 4).alias("j"), ((F.col("i") + F.col("j")) % 3).alias("k")).agg(
        F.round(F.avg("vp"), 3).alias("vp")
    )


def _bracket_sql(c: str, axis: list[float]) -> str:
    inner = axis[1:-1]
    return "(" + " + ".join(f"case when {c} >= {a}e0 then 1 else 0 end" for a in inner) + ")" if inner else "0"


def _at(axis: list[float], idx: str) -> str:
    return f"(case {idx} " + " ".join(f"when {n} then {a}e0" for n, a in enumerate(axis)) + " end)"


VALUES_SQL = "v as (select i % 5 i, j % 4 j, (i + j) % 3 k, round(avg(vp),3) vp from in_cells group by 1,2,3)"
BRACKETS = ", ".join(f"{_bracket_sql(n, a)} b{c}" for (n, a), c in zip(AXES.items(), "ijk"))
FRACTIONS = ", ".join(
    f"({n} - {_at(a, 'b' + c)})/({_at(a, f'(b{c}+1)')} - {_at(a, 'b' + c)}) f{c}" for (n, a), c in zip(AXES.items(), "ijk")
)


def _interp_sql(source: str) -> str:
    """CTEs giving `ip(source columns, bi, bj, bk, val)` for a relation with lon, lat, depth."""
    joins = " ".join(
        f"join v c{a}{b}{c} on c{a}{b}{c}.i = p.bi+{a} and c{a}{b}{c}.j = p.bj+{b} and c{a}{b}{c}.k = p.bk+{c}"
        for a, b, c in ce.CORNERS
    )
    return f"""{VALUES_SQL}, pb as (select *, {BRACKETS} from {source}), p as (select *, {FRACTIONS} from pb),
    ip as (select p.*, {_lerp('p.fi', 'p.fj', 'p.fk')} as val from p {joins})"""


@register(
    "interpolate_points",
    f"with {_interp_sql('(select event_id, lon, lat, depth from in_quakes where lon is not null)')} select event_id, {st('val', 4)} as vp from ip",
    "quakes cells",
)
def interpolate_points(tb):
    out = ce.interpolate_points(located(tb), _node_values(tb), AXES, "vp", "val")
    return out.select("event_id", fine("val", 4, "vp"))


def _nearest_sql(c: str, axis: list[float]) -> str:
    best = [f"abs({a}e0-{c})" for a in axis]
    return "case " + " ".join(
        f"when {d} <= least({', '.join(best)}) then {n}" for n, d in enumerate(best)
    ) + " end"


@register(
    "nearest_node",
    "select event_id, " + ", ".join(f"{_nearest_sql(n, a)} {c}" for (n, a), c in zip(AXES.items(), "ijk")) + " from in_quakes where lon is not null",
    "quakes",
)
def nearest_node(tb):
    return located(tb).select(
        "event_id", *[ce.nearest_index(n, a).alias(c) for (n, a), c in zip(AXES.items(), "ijk")]
    )


FE = ("dx*20000", "dy*20000", "dz*-20000")
EX_, EY_, EZ_ = q.from_enu(*FE, ("lat", "lon", "0"))


@register(
    "model_from_event",
    f"""with p as (select event_id, a.i dz, b.i - 1 dx, c.i - 1 dy, lat, lon from in_quakes cross join range(8) a(i) cross join range(3) b(i) cross join range(3) c(i)
      where lon is not null and a.i < cast(floor(1.2e0*depth/20000) as int)), e as (select *, {EX_} x, {EY_} y, {EZ_} z from p),
    g as (select event_id, {GLAT} la, {GLON} lo, {GH} h from e)
    select event_id, count(*) n_cells, round(min(round(la,5)),5) lat_lo, round(max(round(lo,5)),5) lon_hi, {q.rnd('max(-h)', 1)} depth_hi from g group by 1""",
    "quakes",
)
def model_from_event(tb):
    """One lattice per quake, as deep as 1.2 times the quake; its size and reach."""
    tops = located(tb).select("event_id", "lat", "lon", F.floor(1.2 * F.col("depth") / 20000).cast("int").alias("n_depth"), F.lit(0.0).alias("depth"))
    out = ce.lattices_around(tops, 20000.0, 3, 3, F.col("n_depth"))
    return out.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.min("lat").alias("lat_lo"), F.max("lon").alias("lon_hi"),
        F.round(F.max("depth"), 1).alias("depth_hi"),
    )


@register(
    "grid_info",
    """select model_id, max(i)+1 n_i, max(j)+1 n_j, max(k)+1 n_k, 500.0e0 coarse_cell_size, 100.0e0 fine_cell_size,
      (max(i)+1)*5 fine_n_i, (max(j)+1)*5 fine_n_j, (max(k)+1)*5 fine_n_k, (max(i)+1)*500.0e0 side_i_m, (max(j)+1)*500.0e0 side_j_m,
      (max(k)+1)*500.0e0 side_k_m, max(j)+1 coarse_ny, (max(j)+1)*5 fine_ny from in_cells group by 1""",
    "cells",
)
def grid_info(tb):
    return ce.grid_info(tb.cells, KEYS, 500.0, 5)


@register(
    "y_slice",
    """with c as (select c.* from in_cells c join (select model_id, max(j) t from in_cells group by 1) g on g.model_id = c.model_id where c.j = least(99, g.t))
    select model_id, i, k, vp, min(vp) over (partition by model_id) vmin, max(vp) over (partition by model_id) vmax from c""",
    "cells",
)
def y_slice(tb):
    cut, ends = ce.y_slice(tb.cells, KEYS, 99, "vp")
    return cut.select(*KEYS, "i", "k", "vp").join(ends, KEYS)


DIFF = """case when lag(t) over {w} is not null and lead(t) over {w} is not null then (lead(t) over {w} - lag(t) over {w})/2
    when lead(t) over {w} is not null then lead(t) over {w} - t else t - lag(t) over {w} end"""


@register(
    "field_gradient",
    "select station_id, i, j, k, "
    + ", ".join(
        f"round({DIFF.format(w=f'(partition by station_id, {o} order by {c})')}, 8) g{c}"
        for c, o in (("i", "j, k"), ("j", "i, k"), ("k", "i, j"))
    )
    + " from in_lattice_times",
    "lattice_times",
)
def field_gradient(tb):
    out = ce.gradient(tb.lattice_times, ["station_id"], "t")
    return out.select("station_id", "i", "j", "k", *[r(f"g{c}", 8) for c in "ijk"])


# --- stored fields -----------------------------------------------------------------------------------------------

CELL_OF = f"""ec as (select event_id, dx + 2 ex, dy + 2 ey, dz ez from ({LOCATE} in_quakes where lon is not null) a where abs(dx) <= 2 and abs(dy) <= 2 and dz between 0 and 4),
    sc as ({ADD_CELLS}),
    df as (select a.event_id, a.pick_id, a.station_nm, a.arrival_type, a.arrival_dttm, round(t1.t - t0.t, 2) model_s from in_arrivals a join ec on ec.event_id = a.event_id
      join sc on sc.station_nm = a.station_nm and sc.network_nm = a.network_nm
      join in_lattice_times t0 on 'ST'||cast(t0.station_id as varchar) = a.station_nm and t0.i = ex and t0.j = ey and t0.k = ez
      join in_lattice_times t1 on t1.station_id = t0.station_id and t1.i = sc.x and t1.j = sc.y and t1.k = sc.z)"""


def model_differences(tb):
    """Per pick: the station field at the station's cell minus at the quake's cell."""
    q_cells = ce.locate_cells(located(tb), LATTICE).dropna(subset=["z"]).select(
        "event_id", F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("z").alias("ez")
    )
    s_cells = ce.add_cell_coords(tb.stations.dropna(subset=["lon", "lat"]), LATTICE).select(*cat.STATION_KEY, "x", "y", "z")
    picks = tb.arrivals.join(q_cells, "event_id").join(s_cells, cat.STATION_KEY)
    picks = picks.withColumn("station_id", F.expr("cast(substr(station_nm, 3) as bigint)"))
    return fd.field_difference(picks, tb.lattice_times, "station_id", ["ex", "ey", "ez"], ["x", "y", "z"], "model_s")


@register(
    "cell_lookup_join",
    f"with {CELL_OF} select event_id, pick_id, model_s from df",
    "quakes stations arrivals lattice_times",
)
def cell_lookup_join(tb):
    return model_differences(tb).select("event_id", "pick_id", "model_s")


@register(
    "missing_fields",
    """select distinct station_nm, case when arrival_type like 'P%' then 'P' else 'S' end phase from in_arrivals
    except select station_nm, 'P' from in_travel_times where experiment_nm = 'exp_1'""",
    "arrivals travel_times",
)
def missing_fields(tb):
    """Fields needed for the recorded phases but not stored yet."""
    required = tb.arrivals.select("station_nm", F.left("arrival_type", F.lit(1)).alias("phase"))
    stored = cat.travel_times_of(tb.travel_times, "exp_1").select("station_nm", F.lit("P").alias("phase"))
    return fd.missing_fields(required, stored, ["station_nm", "phase"])


FIELD_PAIRS = "(select s_suppkey as pair_id, s_suppkey as source, 1 + (s_suppkey * 7 + 3) % (select max(s_suppkey) from supplier) as receiver from supplier) fp"


@register(
    "fat_ray",
    f"""with f as materialized (select * from in_lattice_times), c as materialized (select station_id, i, j, k from (select *, row_number() over (partition by station_id order by t, i, j, k) rn from f) z where rn = 1),
    d as materialized (select pair_id, source, receiver, (a.t + b.t)/2 tt from {FIELD_PAIRS} join c cs on cs.station_id = source join c cr on cr.station_id = receiver
      join f a on a.station_id = source and a.i = cr.i and a.j = cr.j and a.k = cr.k
      join f b on b.station_id = receiver and b.i = cs.i and b.j = cs.j and b.k = cs.k)
    select pair_id, sx.i, sx.j, sx.k from d join f sx on sx.station_id = source join f rx on rx.station_id = receiver
      and rx.i = sx.i and rx.j = sx.j and rx.k = sx.k where sx.t + rx.t - tt <= 0.1234567""",
    "lattice_times",
)
def fat_ray(tb):
    """Each station paired with another one of the whole list."""
    s = F.col("s_suppkey")
    n = tb.table("supplier").agg(F.max("s_suppkey")).first()[0]
    pairs = tb.table("supplier").select(s.alias("pair_id"), s.alias("source"), (1 + (s * 7 + 3) % n).alias("receiver"))
    return fd.fat_rays(pairs, tb.lattice_times, "station_id", 0.1234567).select("pair_id", "i", "j", "k")
