"""Best cells of quakes by branch and bound over a pyramid of travel times.

Per block of cells and station the pyramid holds the least and the greatest time. For a quake they bound the misfit of all cells of
the block from below and from above; level by level, from large blocks to single cells, only blocks that can hold one of the
n best cells are opened. Rows of (observation, block) are formed for opened blocks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialise
from .cells import CELL
from .fields import shuffled

# Cells along an edge of a block, in units of the next finer level.
EDGE = 4
# Rounding of sums must not close a block that holds a tie.
_SLACK = 1e-6


def _blocks(size: int) -> list[Column]:
    """Columns of the block that holds a cell."""
    return [F.floor(F.col(c) / size).cast("int").alias(f"b_{c}") for c in CELL]


BLOCK = [f"b_{c}" for c in CELL]


def time_pyramid(field: DataFrame, station: str = "station_id", edge: int = EDGE) -> dict[int, DataFrame]:
    """By block size, coarsest last: station, block, least and greatest time, number of times, number of cells of the block."""
    timed = materialise(field.where(F.col("t").isNotNull()).select(station, *CELL, "t"), "field")
    reach = timed.agg(*[F.min(c).alias(f"lo_{c}") for c in CELL], *[F.max(c).alias(f"hi_{c}") for c in CELL]).first()
    levels = {1: timed.select(station, *_blocks(1), F.col("t").alias("lo"), F.col("t").alias("hi"), F.lit(1).cast("long").alias("times"), F.lit(1).cast("long").alias("cells"))}
    if reach["lo_i"] is None:
        return levels
    size = edge
    while True:
        # Cells of a block that any station has.
        known = timed.select(*CELL).distinct().groupBy(*_blocks(size)).agg(F.count(F.lit(1)).alias("cells"))
        ends = timed.groupBy(station, *_blocks(size)).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("times"))
        levels[size] = materialise(ends.join(known, BLOCK).select(station, *BLOCK, "lo", "hi", "times", "cells"), "pyramid")
        if all(reach[f"hi_{c}"] // size - reach[f"lo_{c}"] // size <= 1 for c in CELL):
            return levels
        size *= edge


def bounds(opened: DataFrame, observed: DataFrame, level: DataFrame, event: str, station: str) -> DataFrame:
    """Per quake and opened block: least and greatest misfit that a cell of it can have, and how many cells surely have all times.

    With c the middle of a block's residuals and w half their width, the misfit over n stations is n |P r|^2 for the centring P, so its root
    differs from that of c by at most |w|. Where the intervals of residuals have no point in common, their gap is a bound as well.
    """
    middle = F.col("_o") - (F.col("lo") + F.col("hi")) / 2
    half = (F.col("hi") - F.col("lo")) / 2
    met = opened.select(event, *BLOCK).join(observed, event).join(shuffled(level), [station, *BLOCK])
    sums = met.groupBy(event, *BLOCK).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_all").alias("_all"), F.sum(middle).alias("_s"), F.sum(middle * middle).alias("_q"), F.sum(half * half).alias("_w"),
        (F.max(F.col("_o") - F.col("hi")) - F.min(F.col("_o") - F.col("lo"))).alias("_gap"), F.min("times").alias("_least"), F.max("cells").alias("_cells"),
    ).where("_n = _all")
    n = F.col("_n")
    centre = F.sqrt(F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / n, F.lit(0.0)))
    width = F.sqrt("_w")
    low = F.greatest(centre - width, F.greatest(F.col("_gap"), F.lit(0.0)) / F.sqrt(F.lit(2.0)), F.lit(0.0))
    high = centre + width
    exact = F.greatest(n * F.col("_q") - F.col("_s") * F.col("_s"), F.lit(0.0))
    return sums.select(
        event, *BLOCK, (n * low * low).alias("low"), (n * high * high).alias("high"), exact.alias("misfit"),
        F.when(F.col("_least") == F.col("_cells"), F.col("_cells")).otherwise(F.lit(0)).alias("sure"),
    )


def opened_blocks(
    observed: DataFrame, field: DataFrame, n: int = 1, station: str = "station_id", event: str = "event_id", edge: int = EDGE
) -> dict[int, DataFrame]:
    """By block size, coarsest first: the bounds of every block that was looked at; at size 1 these are cells and their misfits.

    A way straight down to one small block per quake (`edge` cubed rows a level) gives the first limit.
    """
    timed = observed.where(F.col("t_obs").isNotNull()).select(event, station, "t_obs")
    base = timed.groupBy(event).agg(F.avg("t_obs").alias("_base"), F.count(F.lit(1)).alias("_all")).where("_all > 1")
    centred = materialise(timed.join(base, event).select(event, station, "_all", (F.col("t_obs") - F.col("_base")).alias("_o")), "centred")
    levels = time_pyramid(field, station, edge)
    sizes = sorted(levels, reverse=True)
    # The coarsest level has eight blocks at most.
    top = levels[sizes[0]].select(*BLOCK).distinct()
    blocks = centred.select(event).distinct().join(F.broadcast(top), F.lit(True)) if len(sizes) > 1 else centred.select(event).distinct().join(top, F.lit(True))
    bounded = lambda blocks, size: materialise(bounds(blocks, centred, levels[size], event, station), "blocks")

    def inner(held: DataFrame, at: int) -> DataFrame:
        """The blocks of the next finer level inside the held ones."""
        step = sizes[at] // sizes[at + 1]
        finer = levels[sizes[at + 1]].select(*BLOCK).distinct()
        parts = finer.select(*[F.col(b).alias(f"_{b}") for b in BLOCK], *[F.floor(F.col(b) / step).cast("int").alias(b) for b in BLOCK])
        return held.select(event, *BLOCK).join(parts, BLOCK).select(event, *[F.col(f"_{b}").alias(b) for b in BLOCK])

    out: dict[int, DataFrame] = {}
    first = bounded(blocks, sizes[0])
    # One way down, always into the block with the least misfit in its middle: its cells' n-th misfit is a limit for the search.
    down = first
    for at in range(len(sizes) - 1):
        held = down.groupBy(event).agg(F.min_by(F.struct(*BLOCK), F.struct("misfit", *BLOCK)).alias("_b")).select(event, "_b.*")
        down = bounded(inner(held, at), sizes[at + 1])
    nth = F.try_element_at(F.sort_array(F.collect_list("misfit")), F.lit(n))
    ceiling = down.groupBy(event).agg(nth.alias("_limit"))
    for at, size in enumerate(sizes):
        seen = out[size] = bounded(blocks, size) if at else first
        if size == 1:
            return out
        # The n best cells lie no higher than the greatest misfit of a block that surely has n cells.
        limit = seen.groupBy(event).agg(F.min(F.when(F.col("sure") >= n, F.col("high"))).alias("_here"))
        ceiling = materialise(limit.join(ceiling, event, "left").select(event, F.least("_limit", "_here").alias("_limit")), "limits")
        held = seen.join(ceiling, event).where(F.col("_limit").isNull() | (F.col("low") <= F.col("_limit") * (1 + _SLACK) + _SLACK * _SLACK))
        blocks = inner(held, at)
    return out


def best_cells(
    observed: DataFrame, field: DataFrame, n: int = 1, station: str = "station_id", event: str = "event_id", decimals: int | None = None, edge: int = EDGE
) -> DataFrame:
    """The n cells of least misfit per quake (ties by cell): event, i, j, k, misfit. The same rows as a search over all cells.

    With `decimals`, misfits are rounded to so many places first. Quakes with fewer than two timed stations, and cells that lack the time of one of
    a quake's stations, drop out.
    """
    cells = opened_blocks(observed, field, n, station, event, edge)[1]
    misfit = F.col("misfit") if decimals is None else F.round("misfit", decimals)
    named = cells.select(event, *[F.col(b).alias(c) for b, c in zip(BLOCK, CELL, strict=True)], misfit.alias("misfit"))
    return least(named, n, event)


def least(misfit: DataFrame, n: int, event: str = "event_id") -> DataFrame:
    """The n cells of least misfit per quake, ties by cell."""
    if n == 1:
        best = F.min_by(F.struct(*CELL, "misfit"), F.struct("misfit", *CELL))
        return misfit.groupBy(event).agg(best.alias("_b")).select(event, "_b.*")
    order = W.partitionBy(event).orderBy("misfit", *CELL)
    return misfit.select(event, *CELL, "misfit").withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")
