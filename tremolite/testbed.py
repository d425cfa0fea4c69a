"""Catalogue-shaped inputs derived from the supplied tables.

Each input is one SELECT over whole supplied tables (and earlier inputs), written once and rendered for Spark or
for the checking engine; only time and array syntax differ. Coordinates and times come from integer arithmetic, so
both engines see the same bits.

orders -> quakes, lineitem -> picks, supplier -> stations, nation -> networks, region -> regions, part -> velocity
cells (boxes of 10 x 10 x 4 cells, one box per 400 parts). Quakes are located on a lattice of 5 x 5 x 5 cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@dataclass(frozen=True)
class Dialect:
    name: str

    def add_ms(self, ts: str, ms: str) -> str:
        if self.name == "spark":
            return f"timestampadd(MILLISECOND, {ms}, {ts})"
        return f"({ts} + to_milliseconds({ms}))"

    def stamp(self, text: str) -> str:
        return f"TIMESTAMP_NTZ '{text}'" if self.name == "spark" else f"TIMESTAMP '{text}'"

    def each(self, name: str, n: int) -> str:
        """A FROM item repeating each row n times, with `name` from 0 to n - 1."""
        if self.name == "spark":
            return f"lateral view explode(sequence(0, {n - 1})) num as {name}"
        return f"cross join (select cast(unnest(range({n})) as int) as {name}) num"

    def idiv(self, a: str, b: int) -> str:
        return f"cast(floor({a}/{b}) as int)"


SPARK, DUCK = Dialect("spark"), Dialect("duck")


def _origin_ms(k: str) -> str:
    """Origin time of quake `k` in milliseconds after the start of 1995 (2,400 days)."""
    return f"(({k}*138239) % 207360000)*1000 + {k} % 1000"


def _origin(d: Dialect, k: str) -> str:
    return d.add_ms(d.stamp("1995-01-01 00:00:00"), _origin_ms(k))


def stations(d: Dialect) -> str:
    return """select 'ST'||cast(s_suppkey as varchar(20)) as station_nm, n_name as network_nm,
      case when s_suppkey % 53 = 52 then null else 156 + ((s_suppkey*7919) % 1000)/100.0e0 end as lon,
      case when s_suppkey % 53 = 52 then null else 50 + ((s_suppkey*104729) % 700)/100.0e0 end as lat
    from {supplier} join {nation} on s_nationkey = n_nationkey"""


def quakes(d: Dialect) -> str:
    return f"""select o_orderkey as event_id, 'earthquake' as event_type,
      case when o_orderstatus = 'F' then 'known' else 'suspected' end as event_type_certainty,
      case when o_orderkey % 97 = 0 then null else 156 + ((o_orderkey*37) % 1000)/100.0e0 end as lon,
      case when o_orderkey % 97 = 0 then null else 50 + ((o_orderkey*101) % 700)/100.0e0 end as lat,
      (o_orderkey % 61)*1000.0e0 as depth, {_origin(d, 'o_orderkey')} as event_dttm
    from {{orders}}"""


def magnitudes(d: Dialect) -> str:
    return """select o_orderkey as event_id, 1 + o_totalprice/100000 as mag_value from {orders}
    union all
    select o_orderkey, 0.9e0*(1 + o_totalprice/100000) from {orders} where o_orderpriority = '1-URGENT'"""


def arrivals(d: Dialect) -> str:
    """Two picks per line item; missing picks have no arrival time, a few come before the origin."""
    travel = """(case when l_partkey % 89 = 0 then -1 else 1 end) *
      (case w when 0 then 100 else 173 end * (50 + (l_orderkey*31 + l_suppkey*17) % 400)
       + (l_partkey % 7)*5 + w*(l_linenumber % 5)*2)"""
    return f"""select l_orderkey as event_id, 'ST'||cast(l_suppkey as varchar(20)) as station_nm, n_name as network_nm,
      (l_orderkey*100000 + l_partkey)*2 + w as pick_id,
      case w when 0 then 'P' else 'S' end ||
      case l_linenumber % 4 when 0 then '' when 1 then 'g' when 2 then 'n' else 'b' end as arrival_type,
      case when (w = 0 and l_partkey % 11 = 0) or (w = 1 and l_partkey % 13 = 0) then null
           else {d.add_ms(_origin(d, 'l_orderkey'), travel)} end as arrival_dttm
    from {{lineitem}} join {{supplier}} on l_suppkey = s_suppkey join {{nation}} on s_nationkey = n_nationkey
      {d.each('w', 2)}"""


_REGION_BOX = """select r_name as region_nm, 156.005e0 + r_regionkey*0.5e0 as lon_min, 163.005e0 + r_regionkey*0.5e0 as lon_max,
      50.005e0 + r_regionkey*0.2e0 as lat_min, 56.005e0 + r_regionkey*0.2e0 as lat_max from {region}"""


def regions(d: Dialect) -> str:
    """Diamond-shaped polygons as closed rings of corner points, in storage form."""
    corners = [
        ("(lon_min+lon_max)/2", "lat_min"),
        ("lon_max", "(lat_min+lat_max)/2"),
        ("(lon_min+lon_max)/2", "lat_max"),
        ("lon_min", "(lat_min+lat_max)/2"),
    ]
    if d.name == "spark":
        ring = "array(" + ", ".join(f"named_struct('lon', {x}, 'lat', {y})" for x, y in corners) + ")"
    else:
        ring = "[" + ", ".join("{'lon': " + x + ", 'lat': " + y + "}" for x, y in corners) + "]"
    ring = ring.replace("{", "{{").replace("}", "}}")
    return f"select region_nm, {ring} as ring from ({_REGION_BOX}) boxes"


def region_edges(d: Dialect) -> str:
    return f"""select region_nm, (lon_min+lon_max)/2 as x1, lat_min as y1, lon_max as x2, (lat_min+lat_max)/2 as y2 from ({_REGION_BOX}) b0
    union all select region_nm, lon_max, (lat_min+lat_max)/2, (lon_min+lon_max)/2, lat_max from ({_REGION_BOX}) b1
    union all select region_nm, (lon_min+lon_max)/2, lat_max, lon_min, (lat_min+lat_max)/2 from ({_REGION_BOX}) b2
    union all select region_nm, lon_min, (lat_min+lat_max)/2, (lon_min+lon_max)/2, lat_min from ({_REGION_BOX}) b3"""


def cells(d: Dialect) -> str:
    i, j, k = "p_partkey % 10", f"({d.idiv('p_partkey', 10)} % 10)", f"({d.idiv('p_partkey', 100)} % 4)"
    mix = f"(({i})*7 + {j}*13 + {k}*3 + p_size) % 11"
    vp = f"2000 + {k}*750 + ({mix})*10.0e0"
    return f"""select {d.idiv('p_partkey', 400)} as model_id, cast({i} as int) as i, {j} as j, {k} as k,
      {vp} as vp, ({vp})*0.58e0 as vs from {{part}}"""


def true_cells(d: Dialect) -> str:
    return """select model_id, i, j, k,
      case when (i + j + k) % 19 = 0 then 0.0e0 else vp + ((i*31 + j*7 + k*3) % 17 - 8)*5.0e0 end as vp, vs
    from ({cells}) c"""


def lattice_times(d: Dialect) -> str:
    """Travel time from every station to every cell of the location lattice."""
    i, j, k = "(c % 5)", f"({d.idiv('c', 5)} % 5)", d.idiv("c", 25)
    dx, dy = f"(10*{i} - (s_suppkey*7) % 50)", f"(10*{j} - (s_suppkey*13) % 50)"
    return f"""select s_suppkey as station_id, {i} as i, {j} as j, {k} as k,
      0.02e0*sqrt({dx}*{dx} + {dy}*{dy} + 100*{k}*{k}) as t from {{supplier}} {d.each('c', 125)}"""


def observed(d: Dialect) -> str:
    """One observed travel time per quake and recording station, near a lattice cell."""
    i, j, k = "(l_orderkey % 5)", f"({d.idiv('l_orderkey', 5)} % 5)", "((l_orderkey*3) % 5)"
    dx, dy = f"(10*{i} - (l_suppkey*7) % 50)", f"(10*{j} - (l_suppkey*13) % 50)"
    return f"""select distinct l_orderkey as event_id, l_suppkey as station_id,
      0.02e0*sqrt({dx}*{dx} + {dy}*{dy} + 100*{k}*{k}) + ((l_orderkey*5 + l_suppkey*11) % 7 - 3)*0.01e0 as t_obs
    from {{lineitem}}"""


def experiment_nodes(d: Dialect) -> str:
    n = "(o_orderkey*31 + o_custkey*17) % 300"
    text = "varchar(20)"
    body = f"""'{{"lon": '||cast(150 + o_orderkey % 135 as {text})||'.5, "lat": '||cast(40 + {d.idiv('o_orderkey', 135)} % 40 as {text})
      ||'.25, "dttm": "2007-0'||cast(1 + o_orderkey % 9 as {text})||'-01T00:00:00", "n_measurements": '
      ||cast({n} as {text})||', "linear_regression": {{"slope": '
      ||case when {n} < 2 then '"Nan"' else '1.'||cast(50 + o_custkey % 50 as {text}) end||'}}}}'"""
    body = body.replace("{", "{{").replace("}", "}}")
    return f"""select 'exp_'||cast(o_custkey % 3 as varchar(20)) as experiment_nm, cast(o_orderkey % 135 as int) as ix,
      {d.idiv('o_orderkey', 135)} % 180 as iy, {d.idiv('o_orderkey', 24300)} as it, {body} as params from {{orders}}"""


def travel_times(d: Dialect) -> str:
    """Stored P/S pairs of past experiments."""
    ms = "(50 + (l_orderkey*31 + l_suppkey*17) % 400)"
    return f"""select 'exp_'||cast(l_suppkey % 3 as varchar(20)) as experiment_nm, l_orderkey as event_id,
      'ST'||cast(l_suppkey as varchar(20)) as station_nm, l_linenumber as pick_no,
      (100*{ms} + (l_partkey % 7)*5)/1000.0e0 as delta_t_p, (173*{ms} + (l_partkey % 5)*9)/1000.0e0 as delta_t_s
    from {{lineitem}}"""


def run_residuals(d: Dialect) -> str:
    return f"""select 'run_'||cast(event_id % 3 as varchar(20)) as run_id, c as iter, event_id, station_id,
      (((event_id*13 + station_id*29 + c*5) % 101) - 50)*0.01e0/(c + 1) as r
    from ({{observed}}) o {d.each('c', 5)}"""


def run_iterations(d: Dialect) -> str:
    return """select 'run_'||cast(o_custkey % 7 as varchar(20)) as run_id, o_orderkey as iter,
      ((o_orderkey*37) % 1000)/10.0e0 as elapsed_s, ((o_orderkey*53) % 700)/100.0e0 as avg_abs_pct_dev
    from {orders}"""


INPUTS: dict[str, Callable[[Dialect], str]] = {
    f.__name__: f
    for f in (
        stations, quakes, magnitudes, arrivals, regions, region_edges, cells, true_cells, lattice_times, observed,
        experiment_nodes, travel_times, run_residuals, run_iterations,
    )
}


def _render(name: str, d: Dialect, table: Callable[[str], str]) -> str:
    text = INPUTS[name](d)
    nested = {k: _render(k, d, table) for k in INPUTS if "{" + k + "}" in text}
    return text.format(**{t: table(t) for t in TABLES}, **nested)


class Testbed:
    """Lazy DataFrames of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in INPUTS:
            return self.spark.sql(_render(name, SPARK, lambda t: f"parquet.`{self.sf_dir}/{t}.parquet`"))
        raise AttributeError(name)


def with_inputs(names: Iterable[str], body: str) -> str:
    """Checking SQL: the named inputs as common table expressions (prefix `in_`) in front of `body`."""
    ctes = [f"in_{n} as ({_render(n, DUCK, lambda t: t)})" for n in names]
    body = body.strip()
    if not ctes:
        return body
    joined = ",\n".join(ctes)
    if body.lower().startswith("with "):
        return f"with {joined},\n{body[5:]}"
    return f"with {joined}\n{body}"
