"""Regular latitude x longitude x time node grids and the spreading of measurements over them."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.geodesy import EARTH_RADIUS_KM, col, evaluate_once
from ..functions.scalars import epoch_micros

# Fixed value: kilometres per degree used for the search rectangle around a point.
KM_PER_DEGREE = 111.0
DAY_US = 86_400_000_000


def _parse_day(value: str | datetime) -> datetime:
    return value if isinstance(value, datetime) else datetime.strptime(value, "%Y-%m-%d")


@dataclass(frozen=True)
class NodeGrid:
    """Evenly spaced nodes; ix counts latitudes, iy longitudes, it times.

    The spatial borders are numbers or column names, so one plan can serve a different grid per region.
    """

    lat_min: float | str
    lat_max: float | str
    lon_min: float | str
    lon_max: float | str
    n_lat: int
    n_lon: int
    first: str | datetime
    last: str | datetime
    n_time: int

    def __post_init__(self):
        if min(self.n_lat, self.n_lon) < 1 or self.n_time < 2:
            raise ValueError("a grid needs at least one node per axis and two in time")

    def _step(self, lo, hi, n: int) -> Column:
        return (col(hi) - col(lo)) / (n - 1) if n > 1 else F.lit(1.0)

    @property
    def lat_step(self) -> Column:
        return self._step(self.lat_min, self.lat_max, self.n_lat)

    @property
    def lon_step(self) -> Column:
        return self._step(self.lon_min, self.lon_max, self.n_lon)

    @property
    def start_us(self) -> int:
        return int((_parse_day(self.first) - datetime(1970, 1, 1)).total_seconds() * 1_000_000)

    @property
    def span_us(self) -> int:
        return int((_parse_day(self.last) - _parse_day(self.first)).total_seconds() * 1_000_000)

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.n_lat, self.n_lon, self.n_time

    def lat(self, ix="ix") -> Column:
        return col(self.lat_min) + col(ix) * self.lat_step

    def lon(self, iy="iy") -> Column:
        return col(self.lon_min) + col(iy) * self.lon_step

    def time(self, it="it") -> Column:
        offset = F.rint(col(it) * float(self.span_us) / (self.n_time - 1)).cast("long")
        return F.timestamp_micros(F.lit(self.start_us) + offset).cast("timestamp_ntz")

    def check(self, ix, iy, it) -> Column:
        """True for indices inside the grid."""
        bounds = ((ix, self.n_lat), (iy, self.n_lon), (it, self.n_time))
        out = F.lit(True)
        for c, n in bounds:
            out = out & (col(c) >= 0) & (col(c) < n)
        return out

    def axis_nodes(self, spark: SparkSession) -> DataFrame:
        """Every node, generated from one distributed counter."""
        total = self.n_lat * self.n_lon * self.n_time
        plane = self.n_lat * self.n_lon
        n = F.col("id")
        return spark.range(total).select(
            F.floor(n / plane).cast("int").alias("it"),
            F.floor((n % plane) / self.n_lon).cast("int").alias("ix"),
            (n % self.n_lon).cast("int").alias("iy"),
        )

    def nodes(self, spark: SparkSession) -> DataFrame:
        """All nodes with position and time."""
        return self.locate(self.axis_nodes(spark))

    def time_slice(self, spark: SparkSession, it: int) -> DataFrame:
        """The nodes of one time, generated alone."""
        n = F.col("id")
        plane = spark.range(self.n_lat * self.n_lon).select(
            F.lit(it).alias("it"), F.floor(n / self.n_lon).cast("int").alias("ix"), (n % self.n_lon).cast("int").alias("iy")
        )
        return self.locate(plane)

    def point_series(self, spark: SparkSession, ix: int, iy: int) -> DataFrame:
        """All times of one place, generated alone."""
        line = spark.range(self.n_time).select(F.col("id").cast("int").alias("it"), F.lit(ix).alias("ix"), F.lit(iy).alias("iy"))
        return self.locate(line)

    def locate(self, df: DataFrame) -> DataFrame:
        """Add lat, lon and dttm to rows holding ix, iy, it; rows outside the grid raise."""
        ok = self.check("ix", "iy", "it")
        guarded = df.withColumn(
            "ix", F.when(ok, F.col("ix")).otherwise(F.raise_error(F.lit("node index outside the grid")).cast("int"))
        )
        return guarded.withColumns({"lat": self.lat(), "lon": self.lon(), "dttm": self.time()})


def _ceil(c: Column) -> Column:
    return F.ceil(c).cast("int")


def _floor(c: Column) -> Column:
    return F.floor(c).cast("int")


def row_bounds(grid: NodeGrid, lat, radius_km: float) -> tuple[Column, Column]:
    """First and last ix of the search rectangle."""
    reach = radius_km / KM_PER_DEGREE
    lo = F.greatest(_ceil((col(lat) - reach - col(grid.lat_min)) / grid.lat_step), F.lit(0))
    hi = F.least(_floor((col(lat) + reach - col(grid.lat_min)) / grid.lat_step), F.lit(grid.n_lat - 1))
    return lo, hi


def column_bounds(grid: NodeGrid, lon, lat, radius_km: float, ix="ix") -> tuple[Column, Column]:
    """First and last iy within the radius on grid row ix (first > last if none).

    The great-circle condition is solved for the longitude difference, so no distance per node is needed.
    """
    phi = F.radians(col(lat))
    room = _room(grid, phi, F.cos(phi), radius_km, ix)
    lo, hi = _around(grid, lon, _reach(room, F.cos(phi), radius_km))
    return F.when(room < 0, F.lit(1)).otherwise(lo), F.when(room < 0, F.lit(0)).otherwise(hi)


def _room(grid: NodeGrid, phi: Column, cos_phi: Column, radius_km: float, ix="ix") -> Column:
    """Squared sine of half the longitude difference at which grid row ix leaves the disk; negative off the disk."""
    phi_n = F.radians(grid.lat(ix))
    half = F.sin((phi_n - phi) / 2)
    return (math.sin(radius_km / (2 * EARTH_RADIUS_KM)) ** 2 - half * half) / (cos_phi * F.cos(phi_n))


def _reach(room: Column, cos_phi: Column, radius_km: float) -> Column:
    reach = F.degrees(2 * F.asin(F.sqrt(F.least(F.greatest(room, F.lit(0.0)), F.lit(1.0)))))
    return F.least(reach, F.when(cos_phi > 0, radius_km / (KM_PER_DEGREE * cos_phi)).otherwise(180.0))


def _around(grid: NodeGrid, lon, reach: Column) -> tuple[Column, Column]:
    lo = F.greatest(_ceil((col(lon) - reach - col(grid.lon_min)) / grid.lon_step), F.lit(0))
    hi = F.least(_floor((col(lon) + reach - col(grid.lon_min)) / grid.lon_step), F.lit(grid.n_lon - 1))
    return lo, hi


def _spread(df: DataFrame, lo: str, hi: str, out: str) -> DataFrame:
    """One row per integer in [lo, hi]; rows with an empty range vanish."""
    return df.filter(F.col(lo) <= F.col(hi)).withColumn(out, F.explode(F.sequence(lo, hi))).drop(lo, hi)


def disk_rows(points: DataFrame, grid: NodeGrid, lon: str, lat: str, radius_km: float) -> DataFrame:
    """Node runs (ix, iy_start, iy_end) within the radius of each point."""
    lo, hi = row_bounds(grid, lat, radius_km)
    rows = _spread(points.dropna(subset=[lon, lat]).withColumns({"_lo": lo, "_hi": hi}), "_lo", "_hi", "ix")
    start, end = column_bounds(grid, lon, lat, radius_km)
    runs = rows.withColumns({"iy_start": start, "iy_end": end})
    return runs.filter(F.col("iy_start") <= F.col("iy_end"))


def nodes_in_radius(points: DataFrame, grid: NodeGrid, lon: str, lat: str, radius_km: float) -> DataFrame:
    """Points times the nodes within the radius, by index arithmetic instead of a join."""
    return _spread(disk_rows(points, grid, lon, lat, radius_km), "iy_start", "iy_end", "iy")


def time_bounds(grid: NodeGrid, ts, days: float) -> tuple[Column, Column]:
    """First and last it within +-days of a time, both ends included; first > last if none."""
    per_step = float(grid.span_us) / (grid.n_time - 1)
    at = epoch_micros(ts) - F.lit(grid.start_us)
    lo = F.greatest(_ceil((at - days * DAY_US) / per_step), F.lit(0))
    hi = F.least(_floor((at + days * DAY_US) / per_step), F.lit(grid.n_time - 1))
    return lo, hi


def time_nodes(events: DataFrame, grid: NodeGrid, ts: str, days: float) -> DataFrame:
    """Events times the time nodes within +-days."""
    lo, hi = time_bounds(grid, ts, days)
    return _spread(events.withColumns({"_lo": lo, "_hi": hi}), "_lo", "_hi", "it")


def node_runs(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Collapse node rows into maximal runs of consecutive iy per key and ix.

    Along a run the node's place on its line grows as iy does; a node that comes twice keeps its place, so nothing is made distinct
    beforehand. One (key, ix) line holds at most the grid's number of columns.
    """
    from pyspark.sql import Window as W

    line = W.partitionBy(*keys, "ix").orderBy("iy")
    marked = nodes.select(*keys, "ix", "iy").withColumn("_g", F.col("iy") - F.dense_rank().over(line))
    return marked.groupBy(*keys, "ix", "_g").agg(F.min("iy").alias("iy_start"), F.max("iy").alias("iy_end")).drop("_g")


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key over the configured number of partitions, also when they are few: each is about to become many rows.

    A small table is read by one task, and a partition count that Spark chooses by size would leave its rows in one.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# --- moments -----------------------------------------------------------------------------------------------------

_PRODUCTS = ("sxx", "syy", "sxy")
_ADDITIVE = ("n", "sx", "sy", *_PRODUCTS)
_MICRO = 1e6


def moments(p="delta_t_p", s="delta_t_s") -> list[Column]:
    """Aggregates of paired times: counts, sums, sums of products and extremes.

    Times count in whole microseconds, the catalogue's resolution, and products are summed as whole numbers of up to 38 digits. So sums can be
    merged in any order without an error, and what is left after subtracting the means' part is exact, however small.
    """
    x, y = (F.round(col(c) * _MICRO).cast("long") for c in (p, s))
    times = lambda a, b: F.sum(a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast("decimal(38,0)")
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(x).alias("sx"),
        F.sum(y).alias("sy"),
        times(x, x).alias("sxx"),
        times(y, y).alias("syy"),
        times(x, y).alias("sxy"),
        F.min(p).alias("p_min"),
        F.max(p).alias("p_max"),
        F.min(s).alias("s_min"),
        F.max(s).alias("s_max"),
    ]


def merge_moments(additive=_ADDITIVE) -> list[Column]:
    """Aggregates that add up rows made by `moments`."""
    return [F.sum(c).alias(c) for c in additive] + [
        (F.min if c.endswith("min") else F.max)(c).alias(c) for c in ("p_min", "p_max", "s_min", "s_max")
    ]


_HALF = 31


def _products(name: str, a: Column, b: Column) -> list[Column]:
    """Sum of a * b as three whole sums, worth 2^62, 2^31 and 1: exact, and far cheaper than decimals.

    The low part of a product is below 2^31, so 2^32 rows fit; the others fit unless times of many days are the rule, and
    raise an error where they don't.
    """
    high, low = lambda c: F.shiftright(c, _HALF), lambda c: c.bitwiseAND(F.lit((1 << _HALF) - 1))
    small = low(a) * low(b)
    parts = high(a) * high(b), high(small) + high(a) * low(b) + low(a) * high(b), low(small)
    return [F.sum(c).alias(f"{name}_{n}") for n, c in zip((2, 1, 0), parts)]


def part_moments(p="delta_t_p", s="delta_t_s") -> list[Column]:
    """`moments` with the sums of products in parts; `whole_products` puts them together after all merging."""
    x, y = (F.round(col(c) * _MICRO).cast("long") for c in (p, s))
    return [
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        *_products("sxx", x, x), *_products("syy", y, y), *_products("sxy", x, y),
        F.min(p).alias("p_min"), F.max(p).alias("p_max"), F.min(s).alias("s_min"), F.max(s).alias("s_max"),
    ]


def merge_parts() -> list[Column]:
    """Aggregates that add up rows made by `part_moments`."""
    return merge_moments(("n", "sx", "sy", *[f"{name}_{n}" for name in _PRODUCTS for n in (2, 1, 0)]))


def whole_products(m: DataFrame) -> DataFrame:
    """Rows of `part_moments` as rows of `moments`."""
    part = lambda name, n: F.col(f"{name}_{n}").cast("decimal(19,0)")
    base = F.lit(1 << _HALF).cast("decimal(10,0)")
    whole = lambda name: (part(name, 2) * base + part(name, 1)) * base + part(name, 0)
    made = m.withColumns({name: whole(name).cast("decimal(38,0)") for name in _PRODUCTS})
    return made.drop(*[f"{name}_{n}" for name in _PRODUCTS for n in (0, 1, 2)])


def centred(products: str, a: str, b: str) -> Column:
    """Sum of products about the means, in square seconds: n sum(ab) - sum(a) sum(b) without rounding, then one division."""
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    exact = whole("n") * F.col(products) - whole(a) * whole(b)
    return exact.cast("double") / F.col("n") / (_MICRO * _MICRO)


def shared_rows(pairs: DataFrame, grid: NodeGrid, r_events_km: float, r_stations_km: float) -> DataFrame:
    """Per pair the node runs (ix, iy_start, iy_end) that lie in both the quake's and the station's disk."""
    e_lo, e_hi = row_bounds(grid, "e_lat", r_events_km)
    s_lo, s_hi = row_bounds(grid, "s_lat", r_stations_km)
    phi = {f"_{w}p": F.radians(F.col(f"{w}_lat")) for w in "es"}
    near = pairs.withColumns({"_lo": F.greatest(e_lo, s_lo), "_hi": F.least(e_hi, s_hi)} | phi).withColumns({f"_{w}c": F.cos(f"_{w}p") for w in "es"})
    rows = _spread(near, "_lo", "_hi", "ix")
    radius = {"e": r_events_km, "s": r_stations_km}
    # Sines and roots once per row: the filters on what is made of them would repeat them.
    rows = evaluate_once(rows, {f"_{w}r": _room(grid, F.col(f"_{w}p"), F.col(f"_{w}c"), radius[w]) for w in "es"})
    rows = evaluate_once(rows.filter("_er >= 0 and _sr >= 0"), {f"_{w}d": _reach(F.col(f"_{w}r"), F.col(f"_{w}c"), radius[w]) for w in "es"})
    ev, st = (_around(grid, f"{w}_lon", F.col(f"_{w}d")) for w in "es")
    runs = rows.withColumns({"iy_start": F.greatest(ev[0], st[0]), "iy_end": F.least(ev[1], st[1])})
    return runs.filter(F.col("iy_start") <= F.col("iy_end")).drop(*[f"_{w}{c}" for w in "es" for c in "pcrd"])


def spread_to_nodes(
    pairs: DataFrame,
    grid: NodeGrid,
    r_events_km: float,
    r_stations_km: float,
    r_time_days: float,
    keys: list[str] | None = None,
) -> DataFrame:
    """Moments per node (ix, iy, it) of all travel-time pairs close to it in space and time.

    A node takes a pair if it lies within both the quake's and the station's disk and within +-days of the quake.
    Each pair becomes one row per grid row (the overlap of two intervals); equal overlaps are summed before they are
    opened into nodes, so from there on the row count is bounded by the grid and not by the number of pairs.
    """
    keys = keys or []
    t_lo, t_hi = time_bounds(grid, "event_dttm", r_time_days)
    bounded = pairs.withColumns({"it_start": t_lo, "it_end": t_hi}).filter(F.col("it_start") <= F.col("it_end"))
    runs = shared_rows(bounded, grid, r_events_km, r_stations_km)
    per_run = runs.groupBy(*keys, "ix", "iy_start", "iy_end", "it_start", "it_end").agg(*part_moments())
    per_place = (
        _spread(per_run, "iy_start", "iy_end", "iy")
        .groupBy(*keys, "ix", "iy", "it_start", "it_end")
        .agg(*merge_parts())
    )
    return whole_products(_spread(per_place, "it_start", "it_end", "it").groupBy(*keys, "ix", "iy", "it").agg(*merge_parts()))


def node_stats(m: DataFrame) -> DataFrame:
    """Mean, population deviation and extremes of both times from moments."""
    n = F.col("n")
    deviation = lambda products, a: F.sqrt(F.greatest(centred(products, a, a) / n, F.lit(0.0)))
    return m.withColumns(
        {
            "n_measurements": n,
            "s_mean": F.col("sy") / n / _MICRO,
            "s_std": deviation("syy", "sy"),
            "p_mean": F.col("sx") / n / _MICRO,
            "p_std": deviation("sxx", "sx"),
        }
    )


def node_regression(m: DataFrame) -> DataFrame:
    """Least squares of S on P from moments: slope, intercept, r, r squared, stderr, t, degrees of freedom.

    All NULL with `error` set where fewer than two pairs or no spread in P exist.
    """
    n = F.col("n")
    vary_x, vary_y = F.col("p_min") < F.col("p_max"), F.col("s_min") < F.col("s_max")
    cxx = F.when(vary_x, centred("sxx", "sx", "sx"))
    cyy = F.when(vary_y, centred("syy", "sy", "sy")).otherwise(0.0)
    cxy = F.when(vary_y, centred("sxy", "sx", "sy")).otherwise(0.0)
    staged = m.withColumns({"_cxx": cxx, "_cyy": cyy, "_cxy": cxy})
    slope = F.col("_cxy") / F.nullif(F.col("_cxx"), F.lit(0.0))
    r = F.when(F.col("_cxx").isNull(), None).when(F.col("_cyy") <= 0, 0.0).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_cxy") / F.sqrt(F.nullif(F.col("_cxx") * F.col("_cyy"), F.lit(0.0)))))
    )
    staged = staged.withColumns({"slope": slope, "r_value": r})
    r2 = F.col("r_value") * F.col("r_value")
    dof = F.nullif(n - 2, F.lit(0))
    stderr = F.when(n == 2, F.col("_cxx") * 0).otherwise(F.sqrt((1 - r2) * F.col("_cyy") / F.nullif(F.col("_cxx"), F.lit(0.0)) / dof))
    t = F.col("r_value") * F.sqrt(dof / F.nullif((1 - r2), F.lit(0.0)))
    return staged.withColumns(
        {
            "intercept": F.col("sy") / n / _MICRO - F.col("slope") * (F.col("sx") / n / _MICRO),
            "r_squared": r2,
            "stderr": stderr,
            "t_stat": t,
            "dof": n - 2,
            "error": F.when(n < 2, "insufficient_data").when(~vary_x, "identical_p_times"),
        }
    ).drop("_cxx", "_cyy", "_cxy")


def regression_p_value(fit: DataFrame) -> DataFrame:
    """Add the two-sided p-value of the slope; exact two-point fits give 0 (or 1 when S does not vary)."""
    from ..functions.pvalues import t_test_p

    flat = F.col("s_min") == F.col("s_max")
    return fit.withColumn(
        "p_value",
        F.when(F.col("slope").isNull(), None)
        .when(F.col("dof") == 0, F.when(flat, 1.0).otherwise(0.0))
        .when(F.col("r_squared") >= 1, 0.0)
        .otherwise(t_test_p(F.col("t_stat"), F.col("dof").cast("double"))),
    )


def node_params(fit: DataFrame, grid: NodeGrid) -> DataFrame:
    """Storage form of node results: one nested struct per node."""
    located = grid.locate(fit)
    stats = lambda w: F.struct(
        F.col(f"{w}_mean").alias("mean"), F.col(f"{w}_std").alias("std"),
        F.col(f"{w}_min").alias("min"), F.col(f"{w}_max").alias("max"),
    )
    return located.withColumn(
        "params",
        F.struct(
            "lon", "lat", F.date_format("dttm", "yyyy-MM-dd'T'HH:mm:ss").alias("dttm"), "n_measurements",
            stats("s").alias("delta_t_s"), stats("p").alias("delta_t_p"),
            F.struct("slope", "intercept", "r_value", "r_squared", "p_value", "stderr", "error").alias("linear_regression"),
        ),
    )
