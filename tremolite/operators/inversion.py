"""Weighted ray sums, normal equations and damped least squares on sparse rows (row, cell, value)."""

from __future__ import annotations

import itertools
import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .cells import SENT_CELLS

# Cells of a tile: a row's vector is cut into tiles, and products are formed tile by tile.
TILE = 256
# Tile products a task holds at once, 0.5 MB each.
OPEN_TILES = 64


# Rows of a block product, 2 MB a side.
BLOCK_ROWS = 1024


def _dense(places: pd.Series, values: pd.Series, tile: int) -> np.ndarray:
    """Rows of a tile as a full matrix; each row lists its places and values."""
    out = np.zeros((len(places), tile))
    out[np.repeat(np.arange(len(places)), places.map(len)), np.concatenate(places.to_list())] = np.concatenate(values.to_list())
    return out


def _entries(sums: dict[tuple[int, int], np.ndarray], tile: int):
    for (t1, t2), total in sums.items():
        a, b = np.nonzero(np.triu(total) if t1 == t2 else total)
        yield pd.DataFrame({"c1": t1 * tile + a, "c2": t2 * tile + b, "a": total[a, b]})


def _tile_products(tile: int):
    """Sum of weight * left^T right per pair of tiles; sums are given out when too many are open, and added up later."""

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for (t1, t2), part in batch.groupby(["t1", "t2"]):
                if (t1, t2) not in sums:
                    if len(sums) >= OPEN_TILES:
                        yield from _entries(sums, tile)
                        sums = {}
                    sums[t1, t2] = np.zeros((tile, tile))
                for a in range(0, len(part), BLOCK_ROWS):
                    rows = part.iloc[a : a + BLOCK_ROWS]
                    left = _dense(rows["at1"], rows["v1"], tile) * rows["weight"].to_numpy()[:, None]
                    sums[t1, t2] += left.T @ _dense(rows["at2"], rows["v2"], tile)
        yield from _entries(sums, tile)

    return run


def gram(rows: DataFrame, row_keys: list[str], cell: str, value: str, weight: str | None = None) -> DataFrame:
    """Upper triangle (c1 <= c2) of sum over rows of weight * g g^T, for numbered cells, however many.

    A row's cells are grouped into tiles, the tiles of a row meet by a join on the row, and their products are summed inside the
    tasks: what is shuffled is a row's tile once per partner tile, and partial sums, not a pair of cells per row.
    """
    w = F.max(weight) if weight else F.lit(1.0)
    at = F.col(cell) % TILE
    # Entries of the same row and cell add up before a tile is put together.
    tiles = (
        rows.groupBy(*row_keys, cell)
        .agg(F.sum(value).alias("_v"), w.cast("double").alias("_w"))
        .groupBy(*row_keys, F.floor(F.col(cell) / TILE).alias("tile"))
        .agg(F.collect_list(F.struct(at.cast("int").alias("at"), F.col("_v").alias("v"))).alias("_e"), F.max("_w").alias("weight"))
    )
    side = lambda n, *more: tiles.select(
        *row_keys, F.col("tile").alias(f"t{n}"), F.col("_e.at").alias(f"at{n}"), F.col("_e.v").alias(f"v{n}"), *more
    )
    met = side(1, "weight").join(side(2), row_keys).filter("t1 <= t2").select("t1", "t2", "at1", "v1", "at2", "v2", "weight")
    parts = met.mapInPandas(_tile_products(TILE), "c1 long, c2 long, a double")
    return parts.groupBy("c1", "c2").agg(F.sum("a").alias("a"))


def _vector_products(tile: int):
    """The same of rows that list all their cells: a row's tiles meet inside the task."""

    def add(sums, cells, values):
        sizes = np.fromiter(map(len, cells), np.int64, len(cells))
        row, cell, value = np.repeat(np.arange(len(cells)), sizes), np.concatenate(cells), np.concatenate(values)
        have = ~np.isnan(value)
        order = np.lexsort((cell[have], row[have]))
        row, cell, value = (x[have][order] for x in (row, cell, value))
        at, number = cell % tile, row * (1 << 40) + cell // tile
        first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(number)))
        parts = pd.DataFrame({"row": row[first], "t": cell[first] // tile, "first": first, "size": size})

        def dense(first, size):
            out = np.zeros((len(first), tile))
            flat = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            out[np.repeat(np.arange(len(first)), size), at[flat]] = value[flat]
            return out

        met = parts.merge(parts, on="row", suffixes=("1", "2"))
        for key, pair in met[met["t1"] <= met["t2"]].groupby(["t1", "t2"]):
            if key not in sums:
                if len(sums) >= OPEN_TILES:
                    yield from _entries(sums, tile)
                    sums.clear()
                sums[key] = np.zeros((tile, tile))
            left, right = (dense(pair[f"first{n}"].to_numpy(), pair[f"size{n}"].to_numpy()) for n in (1, 2))
            sums[key] += left.T @ right

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for a in range(0, len(batch), BLOCK_ROWS):
                rows = batch.iloc[a : a + BLOCK_ROWS]
                yield from add(sums, rows["cells"].to_list(), rows["g"].to_list())
        yield from _entries(sums, tile)

    return run


def gram_of_vectors(vectors: DataFrame) -> DataFrame:
    """`gram` of rows that hold their lists `cells` (each cell once) and `g`: no row of the matrix is shuffled, only sums are."""
    parts = vectors.select("cells", "g").mapInPandas(_vector_products(TILE), "c1 long, c2 long, a double")
    return parts.groupBy("c1", "c2").agg(F.sum("a").alias("a"))


def right_side(vectors: DataFrame) -> DataFrame:
    """G^T dt of rows that hold `dt` and their lists `cells` and `g`."""
    entries = vectors.select("dt", F.explode(F.arrays_zip("cells", "g")).alias("_e"))
    return entries.groupBy(F.col("_e.cells").alias("cell")).agg(F.sum(F.col("_e.g") * F.col("dt")).alias("b"))


def vector_system(vectors: DataFrame, n_cells: int, damping: float):
    """`sparse_system` of rows (dt, cells, g)."""
    return _damped(gram_of_vectors(vectors), n_cells, damping), right_side(vectors)


def rank_one(totals: DataFrame, value: str, factor: float) -> DataFrame:
    """Upper triangle of factor * t t^T of a vector (cell, value), which has as many entries as the full matrix.

    The vector is cut into tiles; each tile goes to its partners and one task multiplies one pair, so no row of all cells ever
    meets itself.
    """
    place = (F.col("cell") % TILE).cast("int")
    tiles = totals.groupBy(F.floor(F.col("cell") / TILE).alias("tile")).agg(F.collect_list(F.struct(place.alias("at"), F.col(value).alias("v"))).alias("_e"))
    tiles = materialise(tiles.select("tile", F.col("_e.at").alias("at"), F.col("_e.v").alias("v")), "tiles")
    last = tiles.agg(F.max("tile")).first()[0]
    if last is None:
        return totals.select(F.col("cell").cast("long").alias("c1"), F.col("cell").cast("long").alias("c2"), F.lit(0.0).alias("a")).limit(0)
    left = tiles.select(F.col("tile").alias("t1"), F.col("at").alias("at1"), F.col("v").alias("v1"), F.explode(F.sequence("tile", F.lit(last))).alias("t2"))
    right = tiles.select(F.col("tile").alias("t2"), F.col("at").alias("at2"), F.col("v").alias("v2"), F.lit(factor).alias("weight"))
    met = left.join(right, "t2").select("t1", "t2", "at1", "v1", "at2", "v2", "weight")
    return met.mapInPandas(_tile_products(TILE), "c1 long, c2 long, a double")


def station_sums(pieces: DataFrame, station: str = "station_id") -> DataFrame:
    """S(station, cell) = sum over rays of weight * length.

    A piece carries its ray's weight, summed over the quakes that share the ray, so lengths are not joined with weights.
    """
    return pieces.groupBy(station, "cell").agg(F.sum(F.col("weight") * F.col("length")).alias("s"))


def packed(rows: DataFrame, row_keys: list[str], cell: str, value: str) -> DataFrame:
    """Sparse rows (row keys, cell, value) as lists `cells` and `g`, one row per row of the matrix."""
    entries = F.collect_list(F.struct(F.col(cell).alias("cell"), F.col(value).cast("double").alias("g"))).alias("_e")
    return rows.groupBy(*row_keys).agg(entries).select(*row_keys, F.col("_e.cell").alias("cells"), F.col("_e.g").alias("g"))


def pair_system(s: DataFrame, r: DataFrame, n_stations: int, n_cells: int, lambda_reg: float, station: str = "station_id"):
    """Normal matrix and right side of all station-pair differences, with the diagonal raised by lambda * trace / n.

    Uses A = n sum(S_i^T S_i) - (sum S)^T (sum S) and the like for b; no pairs are formed. A station's sums are stored once, as lists, and
    their products are summed inside the tasks.
    """
    one_each = s.groupBy(station, "cell").agg(F.sum("s").alias("s"))
    vectors = materialise(packed(one_each, [station], "cell", "s"), "vectors")
    entries = vectors.select(station, F.explode(F.arrays_zip("cells", "g")).alias("_e")).select(station, F.col("_e.cells").alias("cell"), F.col("_e.g").alias("s"))
    totals = materialise(entries.groupBy("cell").agg(F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s")).alias("q")), "totals")
    a = gram_of_vectors(vectors).withColumn("a", n_stations * F.col("a"))
    a = a.unionByName(rank_one(totals, "s", -1.0)).groupBy("c1", "c2").agg(F.sum("a").alias("a"))
    trace = totals.agg(F.sum(n_stations * F.col("q") - F.col("s") * F.col("s")).alias("_tr"))
    raised = F.col("a") + F.when(F.col("c1") == F.col("c2"), lambda_reg * F.col("_tr") / n_cells).otherwise(0.0)
    a = a.join(F.broadcast(trace), F.lit(True)).select("c1", "c2", raised.alias("a"))
    return a, pair_right_side(entries, r, n_stations, station)


def pair_right_side(s: DataFrame, r: DataFrame, n_stations: int, station: str = "station_id") -> DataFrame:
    """b = n sum(S_i R_i) - (sum S)(sum R)."""
    everything = r.agg(F.sum("r").alias("_all"))
    centred = r.join(F.broadcast(everything), F.lit(True)).select(station, (n_stations * F.col("r") - F.col("_all")).alias("_r"))
    return s.join(centred, station).groupBy("cell").agg(F.sum(F.col("s") * F.col("_r")).alias("b"))


def _damped(a: DataFrame, n_cells: int, damping: float) -> DataFrame:
    eye = a.sparkSession.range(n_cells).select(F.col("id").alias("c1"), F.col("id").alias("c2"), F.lit(damping).alias("a"))
    return a.unionByName(eye).groupBy("c1", "c2").agg(F.sum("a").alias("a"))


def sparse_system(g: DataFrame, dt: DataFrame, row_keys: list[str], n_cells: int, damping: float):
    """G^T G + damping * I and G^T dt of sparse ray rows (row keys, cell, g)."""
    a = _damped(gram(g, row_keys, "cell", "g"), n_cells, damping)
    b = g.join(dt, row_keys).groupBy("cell").agg(F.sum(F.col("g") * F.col("dt")).alias("b"))
    return a, b


def _products(numbers: np.ndarray, p: np.ndarray):
    """Batch function: sum over packed rows of g (g . p) per cell, and the sum of all g . p under the number -1."""

    def run(batches):
        total, all_q = np.zeros(len(p)), 0.0
        for batch in batches:
            lists = batch.column("cells")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            at = np.searchsorted(numbers, lists.flatten().to_numpy(zero_copy_only=False))
            g = np.nan_to_num(batch.column("g").flatten().to_numpy(zero_copy_only=False), nan=0.0)
            q = np.bincount(row, g * p[at], batch.num_rows)
            total += np.bincount(at, g * q[row], len(p))
            all_q += q.sum()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1].astype(np.int64)), pa.array(np.r_[total[some], all_q])], names=["at", "v"])

    return run


def damped_solve(
    rows: DataFrame, right: DataFrame, row_keys: list[str], cell: str, value: str, damping: float,
    pairs_of: int | None = None, tolerance: float = 1e-10, max_rounds: int | None = None,
) -> DataFrame:
    """Solve (M + damping I) x = b by conjugate gradients; rows of cells that are whole numbers.

    M is G^T G, or with `pairs_of` = n rows the pair form n G^T G - (1^T G)^T (1^T G). The matrix is never formed. `right` has (cell, b). With
    `max_rounds`, raises if the tolerance is not met by then. The uniform damping already groups the eigenvalues; scaling by the diagonal was tried
    and needed more rounds. Rows are stored once, as lists; a round reads them once and shuffles one partial vector per task. Vectors of up
    to `SENT_CELLS` cells are kept by the driver and sent to the tasks; beyond that a round is made of joins.
    """
    vectors = materialise(packed(rows, row_keys, cell, value), "rows")
    listed = vectors.select(F.explode("cells").alias("cell")).distinct()
    known = materialise(listed.join(right, "cell", "full").select("cell", F.coalesce("b", F.lit(0.0)).cast("double").alias("b")), "right")
    if known.count() > SENT_CELLS:
        entries = vectors.select(*row_keys, F.explode(F.arrays_zip("cells", "g")).alias("_e"))
        entries = entries.select(*row_keys, F.col("_e.cells").alias("cell"), F.col("_e.g").alias("g"))
        x = _solve_by_joins(entries, known, row_keys, "cell", "g", damping, pairs_of, tolerance, max_rounds)
        return x.withColumnRenamed("cell", cell)
    b = known.orderBy("cell").toPandas()
    numbers, r = b["cell"].to_numpy(np.int64), b["b"].to_numpy(np.float64).copy()

    def times(p: np.ndarray) -> tuple[np.ndarray, float]:
        made = vectors.select("cells", "g").mapInArrow(_products(numbers, p), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
        out, at = np.zeros(len(p) + 1), made["at"].to_numpy(np.int64)
        out[at] = made["v"].to_numpy(np.float64)
        return out[:-1], out[-1]

    if pairs_of:
        entries = vectors.select(F.explode(F.arrays_zip("cells", "g")).alias("_e"))
        sums = entries.groupBy(F.col("_e.cells").alias("cell")).agg(F.sum("_e.g").alias("s")).toPandas()
        ones = np.zeros(len(r))
        ones[np.searchsorted(numbers, sums["cell"].to_numpy(np.int64))] = np.nan_to_num(sums["s"].to_numpy(np.float64))
    x, p, rr = np.zeros(len(r)), r.copy(), float(r @ r)
    goal = rr * tolerance * tolerance
    for _ in itertools.count() if max_rounds is None else range(max_rounds):
        if not rr or rr <= goal:
            break
        mp, all_q = times(p)
        ap = (pairs_of * mp - all_q * ones if pairs_of else mp) + damping * p
        step = rr / float(p @ ap)
        x, r = x + step * p, r - step * ap
        rr, before = float(r @ r), rr
        p = r + (rr / before) * p
        if rr <= goal:
            break
    else:
        raise RuntimeError(f"no solution within {max_rounds} rounds (residual {math.sqrt(rr)})")
    solved = known.sparkSession.createDataFrame(pd.DataFrame({"cell": numbers, "x": x}), "cell long, x double")
    return solved.select(F.col("cell").cast(dict(rows.dtypes)[cell]).alias(cell), "x")


def _solve_by_joins(
    rows: DataFrame, right: DataFrame, row_keys: list[str], cell: str, value: str, damping: float,
    pairs_of: int | None = None, tolerance: float = 1e-10, max_rounds: int | None = None,
) -> DataFrame:
    """`damped_solve` for many cells: M x is two joins and sums over the sparse rows, and only a few sums per round reach the driver."""
    g = materialise(rows.select(*row_keys, F.col(cell).alias("cell"), F.col(value).alias("g")), "rows")
    known = g.select("cell").distinct().join(right, "cell", "full").select("cell", F.coalesce("b", F.lit(0.0)).alias("r"))
    state = materialise(known.select("cell", F.lit(0.0).alias("x"), "r", F.col("r").alias("p")), "cg")
    r, p, ap = F.col("r"), F.col("p"), F.col("ap")
    goal = rr = None
    for _ in itertools.count() if max_rounds is None else range(max_rounds):
        q = g.join(state.select("cell", "p"), "cell").groupBy(*row_keys).agg(F.sum(F.col("g") * p).alias("q"))
        if pairs_of:
            q = q.join(F.broadcast(q.agg(F.sum("q").alias("_q"))), F.lit(True)).select(
                *row_keys, (pairs_of * F.col("q") - F.col("_q")).alias("q")
            )
        mp = g.join(q, row_keys).groupBy("cell").agg(F.sum(F.col("g") * F.col("q")).alias("_mp"))
        done = materialise(
            state.join(mp, "cell", "left").withColumn("ap", F.coalesce("_mp", F.lit(0.0)) + damping * p).drop("_mp"), "cg"
        )
        rr, pap, rap, apap = done.agg(F.sum(r * r), F.sum(p * ap), F.sum(r * ap), F.sum(ap * ap)).first()
        goal = rr * tolerance * tolerance if goal is None and rr is not None else goal
        if not rr or rr <= goal:
            break
        step = rr / pap
        next_rr = max(rr - 2 * step * rap + step * step * apap, 0.0)
        x, res = F.col("x") + step * p, r - step * ap
        state = done.select("cell", x.alias("x"), res.alias("r"), (res + (next_rr / rr) * p).alias("p"))
        if next_rr <= goal:
            break
    else:
        raise RuntimeError(f"no solution within {max_rounds} rounds (residual {math.sqrt(rr)})")
    return state.select(F.col("cell").alias(cell), "x")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
