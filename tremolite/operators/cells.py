"""Velocity grids as cell tables keyed by (i, j, k): lattices, location, refinement, interpolation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.geodesy import col, degrees_per_metre, ecef_to_enu, enu_to_geodetic, evaluate_once, geodetic_to_ecef

CELL = ["i", "j", "k"]
CORNERS = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]


# --- lattices ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TopPoint:
    """Centre of a model's upper face."""

    lon: float
    lat: float
    depth: float = 0.0


@dataclass(frozen=True)
class Lattice:
    """A box of cubes below a top mid point; north and east counts must be odd."""

    top: TopPoint
    cube_side: float
    n_north: int
    n_east: int
    n_depth: int

    def __post_init__(self):
        if self.n_north % 2 == 0 or self.n_east % 2 == 0:
            raise ValueError("n_north and n_east must be odd")

    @property
    def half(self) -> tuple[int, int]:
        return (self.n_north - 1) // 2, (self.n_east - 1) // 2


def _placed(df: DataFrame, side, lat, lon, depth) -> DataFrame:
    """Coordinates of cells given as ENU steps dx (east), dy (north), dz (down)."""
    side = col(side)
    at = enu_to_geodetic(
        df.withColumnsRenamed({"lat": "_lat", "lon": "_lon", "depth": "_depth"}),
        F.col("dx") * side, F.col("dy") * side, -F.col("dz") * side, lat, lon, -col(depth),
    )
    return at.withColumns({c: F.round(c, 5) for c in ("lat", "lon", "depth")})


def lattice_cells(spark: SparkSession, m: Lattice) -> DataFrame:
    """All cells of one lattice (any size), from a distributed counter; order depth, east, north."""
    north, east = m.half
    n = F.col("id")
    steps = spark.range(m.n_depth * m.n_east * m.n_north).select(
        F.floor(n / (m.n_east * m.n_north)).cast("int").alias("dz"),
        (F.floor(n / m.n_north) % m.n_east - east).cast("int").alias("dx"),
        (n % m.n_north - north).cast("int").alias("dy"),
    )
    return _placed(steps, m.cube_side, m.top.lat, m.top.lon, m.top.depth)


def _steps(df: DataFrame, dx: tuple[int, int], dy: tuple[int, int], n_depth: Column | int) -> DataFrame:
    n_depth = F.lit(n_depth) if isinstance(n_depth, int) else n_depth
    last = n_depth.cast("int") - 1
    return (
        df.withColumn("_last", last)
        .filter("_last >= 0")
        .withColumn("dz", F.explode(F.sequence(F.lit(0), F.col("_last"))))
        .withColumn("dx", F.explode(F.sequence(F.lit(dx[0]), F.lit(dx[1]))))
        .withColumn("dy", F.explode(F.sequence(F.lit(dy[0]), F.lit(dy[1]))))
        .drop("_last")
    )


def lattices_around(tops: DataFrame, cube_side, n_north: int, n_east: int, n_depth) -> DataFrame:
    """One lattice per row of `tops` (lat, lon, depth of the top mid point)."""
    if n_north % 2 == 0 or n_east % 2 == 0:
        raise ValueError("n_north and n_east must be odd")
    hn, he = (n_north - 1) // 2, (n_east - 1) // 2
    return _placed(_steps(tops, (-he, he), (-hn, hn), n_depth), cube_side, "_lat", "_lon", "_depth").drop(
        "_lat", "_lon", "_depth"
    )


def lattices_from_corner(corners: DataFrame, cube_side, n_east: int, n_south: int, n_depth) -> DataFrame:
    """Lattices growing east, south and down from a corner point, on the ellipsoid."""
    steps = _steps(corners, (0, n_east - 1), (-(n_south - 1), 0), n_depth)
    at = enu_to_geodetic(
        steps.withColumnsRenamed({"lat": "_lat", "lon": "_lon", "depth": "_depth"}),
        F.col("dx") * col(cube_side), F.col("dy") * col(cube_side), -F.col("dz") * col(cube_side),
        "_lat", "_lon", -F.col("_depth"),
    )
    return at.drop("_lat", "_lon", "_depth")


def lattices_flat(corners: DataFrame, cube_side, n_east: int, n_south: int, n_depth) -> DataFrame:
    """As `lattices_from_corner`, with constant metres per degree."""
    side = col(cube_side)
    steps = _steps(corners, (0, n_east - 1), (-(n_south - 1), 0), n_depth)
    per_lat, _ = degrees_per_metre("lat")
    moved = steps.withColumns({"lat": F.col("lat") + F.col("dy") * side * per_lat, "depth": F.col("depth") + F.col("dz") * side})
    _, per_lon = degrees_per_metre("lat")
    return moved.withColumn("lon", F.col("lon") + F.col("dx") * side * per_lon)


def offset_mesh(centres: DataFrame, radius_m: float, step_m: float) -> DataFrame:
    """A square mesh of offsets in metres around each centre, ends included."""
    n = int(round(2 * radius_m / step_m))
    axis = F.sequence(F.lit(0), F.lit(n))
    mesh = centres.withColumn("a", F.explode(axis)).withColumn("b", F.explode(axis))
    per_lat, per_lon = degrees_per_metre("lat")
    off = lambda c: F.lit(-float(radius_m)) + F.col(c) * float(step_m)
    return mesh.withColumns({"mesh_lat": F.col("lat") + off("a") * per_lat, "mesh_lon": F.col("lon") + off("b") * per_lon})


# --- location ----------------------------------------------------------------------------------------------------


def locate_cells(df: DataFrame, m: Lattice, lat="lat", lon="lon", depth="depth", as_index: bool = True) -> DataFrame:
    """Add z, x, y of the cell holding each point; NULL outside the lattice. Rounding is half-even."""
    hn, he = m.half
    x, y, z = geodetic_to_ecef(lat, lon, -col(depth))
    staged = df.withColumns({"_x": x, "_y": y, "_z": z})
    east, north, up = ecef_to_enu("_x", "_y", "_z", m.top.lat, m.top.lon, -m.top.depth)
    staged = evaluate_once(
        staged, {"_dx": F.rint(east / m.cube_side), "_dy": F.rint(north / m.cube_side), "_dz": F.rint(-up / m.cube_side)}
    )
    inside = (F.abs("_dx") <= he) & (F.abs("_dy") <= hn) & F.col("_dz").between(0, m.n_depth - 1)
    shift = (he, hn) if as_index else (0, 0)
    return staged.withColumns(
        {
            "z": F.when(inside, F.col("_dz").cast("int")),
            "x": F.when(inside, F.col("_dx").cast("int") + shift[0]),
            "y": F.when(inside, F.col("_dy").cast("int") + shift[1]),
        }
    ).drop("_x", "_y", "_z", "_dx", "_dy", "_dz")


def add_cell_coords(df: DataFrame, m: Lattice) -> DataFrame:
    """Cells of surface points; points outside are dropped."""
    return locate_cells(df.withColumn("_surface", F.lit(0.0)), m, depth="_surface").drop("_surface").dropna(
        subset=["z", "x", "y"]
    )


def metric_to_cell(df: DataFrame, axes: dict[str, tuple[str, int]], size: float) -> DataFrame:
    """Cell index per axis (`out -> (metric column, cells)`), clamped; negative metres give an error text, no index."""
    if size <= 0:
        raise ValueError("cell size must be positive")
    negative = reduce(lambda a, b: a | b, [F.col(c) < 0 for c, _ in axes.values()])
    index = lambda c, n: F.least(F.greatest(F.floor(F.col(c) / size), F.lit(0)), F.lit(n - 1)).cast("int")
    return df.withColumns(
        {**{out: F.when(~negative, index(c, n)) for out, (c, n) in axes.items()},
         "error": F.when(negative, "negative coordinate")}
    )


# --- values ------------------------------------------------------------------------------------------------------


def linear_gradient(top: float, bottom: float, n_z: int, k="k") -> Column:
    """Value per depth index, evenly spaced from top to bottom."""
    if n_z == 1:
        return F.lit(float(top))
    return top + col(k) * ((bottom - top) / (n_z - 1))


def get_cells(cells: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return cells.join(wanted.select(*keys).distinct(), keys)


def set_cells(cells: DataFrame, updates: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Overwrite listed cells; cells without an update keep their value."""
    new = updates.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    joined = cells.join(new, keys, "left")
    return joined.withColumns({v: F.coalesce(f"_{v}", v) for v in values}).drop(*[f"_{v}" for v in values])


def set_all_cells(cells: DataFrame, values: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Replace every value; a missing or a surplus cell raises."""
    new = values.select(*keys, *[F.col(v).alias(f"_{v}") for v in names], F.lit(True).alias("_new"))
    both = cells.withColumn("_old", F.lit(True)).join(new, keys, "full")
    whole = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    wrong = F.raise_error(F.lit("new values do not match the grid shape")).cast("double")
    return both.withColumns({v: F.when(whole, F.col(f"_{v}")).otherwise(wrong) for v in names}).drop(
        "_old", "_new", *[f"_{v}" for v in names]
    )


def corner_values(
    cells: DataFrame, keys: list[str], values: list[str], shape: tuple[int, int, int] | None = None
) -> DataFrame:
    """Each cell with its 8 forward corners as <value>_abc, clamped at the far edges.

    The edges are those of `shape`, or the greatest indices per key; inside them a missing cell raises an error. A value
    that is null in its own cell stays null.

    Every cell is sent to the up to eight cells it is a corner of and collected by one grouped aggregate: one
    shuffle, no chain of joins.
    """
    sent = F.explode(
        F.array(*[F.struct(*[F.lit(o).alias(n) for o, n in zip(c, ("_a", "_b", "_c"))]) for c in CORNERS])
    )
    rows = cells.select(*keys, *CELL, *values, sent.alias("_o"))
    rows = rows.select(
        *keys, *values, "_o",
        (F.col("i") - F.col("_o._a")).alias("i"), (F.col("j") - F.col("_o._b")).alias("j"), (F.col("k") - F.col("_o._c")).alias("k"),
    ).filter((F.col("i") >= 0) & (F.col("j") >= 0) & (F.col("k") >= 0))

    def slot(a, b, c):
        return (F.col("_o._a") == a) & (F.col("_o._b") == b) & (F.col("_o._c") == c)

    here = lambda c: f"_has_{c[0]}{c[1]}{c[2]}"
    grouped = rows.groupBy(*keys, *CELL).agg(
        *[F.max(F.when(slot(*c), F.col(v))).alias(f"{v}_{c[0]}{c[1]}{c[2]}") for v in values for c in CORNERS],
        *[F.max(slot(*c)).alias(here(c)) for c in CORNERS],
    )
    if shape:
        grouped = grouped.withColumns({f"_top_{c}": F.lit(n - 1) for c, n in zip(CELL, shape)})
    else:
        tops = cells.groupBy(*keys).agg(*[F.max(c).alias(f"_top_{c}") for c in CELL])
        grouped = grouped.join(tops, keys) if keys else grouped.crossJoin(F.broadcast(tops))  # one row
    beyond = [F.col(c) >= F.col(f"_top_{c}") for c in CELL]
    whole = F.lit(True)
    for c in CORNERS:
        over = reduce(lambda a, b: a | b, [beyond[x] for x in range(3) if c[x]], F.lit(False))
        whole = whole & (over | F.coalesce(here(c), F.lit(False)))
    hole = F.raise_error(F.concat(F.lit("cell missing near "), F.concat_ws(" ", *[F.col(c).cast("string") for c in CELL])))
    grouped = grouped.withColumn("i", F.when(whole, F.col("i")).otherwise(hole.cast("int")))
    for axis in range(3):  # beyond the far edge the corner repeats the edge value
        fills = {}
        for v in values:
            for c in CORNERS:
                if c[axis] == 1:
                    near = list(c)
                    near[axis] = 0
                    name = lambda t: f"{v}_{t[0]}{t[1]}{t[2]}"
                    fills[name(c)] = F.when(beyond[axis], F.col(name(near))).otherwise(F.col(name(c)))
        grouped = grouped.withColumns(fills)
    return grouped.drop(*[here(c) for c in CORNERS], *[f"_top_{c}" for c in CELL])


Interpolation = Callable[[Callable[[int, int, int], Column], Column, Column, Column], Column]


def trilinear(corner: Callable[[int, int, int], Column], di: Column, dj: Column, dk: Column) -> Column:
    """Weighted sum of the eight corners at fractions di, dj, dk."""
    weight = lambda bit, f: f if bit else 1 - f
    return reduce(
        lambda s, t: s + t,
        [corner(a, b, c) * weight(a, di) * weight(b, dj) * weight(c, dk) for a, b, c in CORNERS],
    )


def _fine(df: DataFrame, sub: int) -> DataFrame:
    for c in CELL:
        df = df.withColumn(f"_{c}", F.explode(F.sequence(F.lit(0), F.lit(sub - 1))))
    return df


def refine(
    cells: DataFrame, sub: int, keys: list[str], values: list[str], method: str | Interpolation = "nearest"
) -> DataFrame:
    """Split each cell into sub^3; values by nearest, trilinear or a column function of corners and fractions."""
    if sub < 1:
        raise ValueError("subdivision must be at least 1")
    if isinstance(method, str) and method not in ("nearest", "trilinear"):
        raise ValueError(f"unknown interpolation: {method}")
    index = [(F.col(c) * sub + F.col(f"_{c}")).cast("int").alias(c) for c in CELL]
    if method == "nearest":
        return _fine(cells, sub).select(*keys, *index, *values)
    fn = trilinear if method == "trilinear" else method
    fine = _fine(corner_values(cells, keys, values), sub)
    part = [F.col(f"_{c}") / F.lit(float(sub)) for c in CELL]
    made = [fn(lambda a, b, c, v=v: F.col(f"{v}_{a}{b}{c}"), *part).alias(v) for v in values]
    return fine.select(*keys, *index, *made)


def coarsen_sum(cells: DataFrame, sub: int, keys: list[str], value: str, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Sum over sub^3 blocks."""
    if sub < 1 or (shape and any(n % sub for n in shape)):
        raise ValueError("grid shape is not divisible by the subdivision")
    block = [F.floor(F.col(c) / sub).cast("int").alias(c) for c in CELL]
    return cells.groupBy(*keys, *block).agg(F.sum(value).alias(value))


def bracket(c, axis: list[float]) -> Column:
    """Index of the axis interval holding a value; the end intervals also serve values beyond them."""
    if len(axis) < 2:
        raise ValueError("an axis needs two nodes")
    inner = F.array(*[F.lit(float(a)) for a in axis[1:-1]]) if len(axis) > 2 else F.array().cast("array<double>")
    return F.size(F.filter(inner, lambda a: a <= col(c)))


def _axis_at(axis: list[float], index: Column) -> Column:
    return F.get(F.array(*[F.lit(float(a)) for a in axis]), index)


def nearest_index(c, axis: list[float]) -> Column:
    """Closest axis node, the lower one on a tie."""
    b = bracket(c, axis)
    lo, hi = _axis_at(axis, b), _axis_at(axis, b + 1)
    return F.when(F.abs(lo - col(c)) <= F.abs(hi - col(c)), b).otherwise(b + 1)


# Grid cells whose corner table may be broadcast (8 values and 3 indices each: 6 MB), and rows of a table repeated per salt.
SENT_CELLS = 65_536
REPEATED = 4_000_000


def at_cells(points: DataFrame, corners: DataFrame, n_cells: int, sent: int = SENT_CELLS, repeated: int = REPEATED) -> DataFrame:
    """Points (i, j, k and more) left-joined with one row per cell, also where most points share a cell.

    A table of up to `sent` cells goes to every task and points stay where they are. A larger one is repeated under salts, points draw theirs by
    their own hash, so a crowded cell is dealt to as many keys; beyond `repeated` rows it isn't repeated, and crowded cells
    are left to the adaptive skew join.
    """
    if n_cells <= sent:
        return points.join(F.broadcast(corners), CELL, "left")
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, min(4 * parts, repeated // n_cells))
    if salts == 1:
        return points.join(corners, CELL, "left")
    salted = points.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int"))
    copies = corners.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*CELL, "_salt"], "left").drop("_salt")


def interpolate_points(
    points: DataFrame, cells: DataFrame, axes: dict[str, list[float]], value: str, out: str, sent: int = SENT_CELLS
) -> DataFrame:
    """Trilinear value at points on irregular axes (`column -> nodes`, in order i, j, k); linear beyond the edges."""
    names = list(axes)
    staged = evaluate_once(points, {c: bracket(n, axes[n]) for c, n in zip(CELL, names)})
    parts = {}
    for c, n in zip(CELL, names):
        lo, hi = _axis_at(axes[n], F.col(c)), _axis_at(axes[n], F.col(c) + 1)
        parts[f"_f{c}"] = (F.col(n) - lo) / (hi - lo)
    staged = staged.withColumns(parts)
    shape = tuple(len(axes[n]) for n in names)
    corners = corner_values(cells, [], [value], shape)
    made = trilinear(lambda a, b, c: F.col(f"{value}_{a}{b}{c}"), F.col("_fi"), F.col("_fj"), F.col("_fk"))
    extra = [f"{value}_{a}{b}{c}" for a, b, c in CORNERS]
    # Points without a cell stay, and fail.
    met = at_cells(staged, corners.withColumn("_met", F.lit(True)), shape[0] * shape[1] * shape[2], sent)
    lost = F.raise_error(F.lit("point in a cell that the grid lacks")).cast("double")
    made = F.when(F.col("_met"), made).when(F.col(names[0]).isNotNull(), lost)
    return met.withColumn(out, made).drop("_met").drop(*CELL, *parts, *extra)


def gradient(field: DataFrame, keys: list[str], value: str, block: int = 8) -> DataFrame:
    """Central differences per axis, one-sided where a neighbour is missing (null without any), unit spacing.

    Cells are dealt to blocks of `block` cells an axis, and each face cell also to the block beyond its face: one shuffle serves the three axes,
    and a window holds one line of one block.
    """
    here = F.struct(*[F.lit(0).alias(c) for c in CELL])
    beyond = []
    for c in CELL:
        for step, face in ((-1, 0), (1, block - 1)):
            at = F.struct(*[F.lit(step if o == c else 0).alias(o) for o in CELL])
            beyond.append(F.when(F.pmod(F.col(c), F.lit(block)) == face, at))
    names = field.columns
    sent = field.withColumn("_to", F.explode(F.array_compact(F.array(here, *beyond))))
    blocks = [f"_b{c}" for c in CELL]
    sent = sent.withColumns({b: F.floor(F.col(c) / block).cast("int") + F.col(f"_to.{c}") for b, c in zip(blocks, CELL, strict=True)})
    dealt = sent.withColumn("_own", F.col("_to") == here).drop("_to").repartition(*keys, *blocks)
    for c in CELL:
        line = W.partitionBy(*keys, *blocks, *[o for o in CELL if o != c]).orderBy(c)
        before = F.when(F.lag(c).over(line) == F.col(c) - 1, F.lag(value).over(line))
        after = F.when(F.lead(c).over(line) == F.col(c) + 1, F.lead(value).over(line))
        diff = F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).when(after.isNotNull(), after - F.col(value)).when(before.isNotNull(), F.col(value) - before)
        dealt = dealt.withColumn(f"g{c}", diff)
    return dealt.where("_own").select(*names, *[f"g{c}" for c in CELL])


def y_slice(cells: DataFrame, keys: list[str], y: int, value: str) -> tuple[DataFrame, DataFrame]:
    """Cells with j = y (clamped to the grid) and the finite extremes per key (0 and 1 where none are finite)."""
    finite = ~F.isnan(value) & F.col(value).isNotNull() & (F.abs(value) != float("inf"))
    top = cells.groupBy(*keys).agg(F.max("j").alias("_top"))
    cut = cells.join(top, keys).filter(F.col("j") == F.greatest(F.lit(0), F.least(F.lit(y), F.col("_top")))).drop("_top")
    ends = cut.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(finite, F.col(value))), F.lit(0.0)).alias("vmin"),
        F.coalesce(F.max(F.when(finite, F.col(value))), F.lit(1.0)).alias("vmax"),
    )
    return cut, ends


def grid_info(cells: DataFrame, keys: list[str], side: float, sub: int) -> DataFrame:
    """Coarse and fine cell size, shape and side lengths per model, and the number of y slices."""
    n = cells.groupBy(*keys).agg(*[(F.max(c) + 1).alias(f"n_{c}") for c in CELL])
    out = n.withColumns({"coarse_cell_size": F.lit(float(side)), "fine_cell_size": F.lit(side / sub)})
    for c in CELL:
        out = out.withColumns(
            {f"fine_n_{c}": F.col(f"n_{c}") * sub, f"side_{c}_m": F.col(f"n_{c}") * float(side)}
        )
    return out.withColumns({"coarse_ny": F.col("n_j"), "fine_ny": F.col("n_j") * sub})
