"""First-arrival times on a lattice for many sources at once, and the paths behind them.

T(cell) = min over the six neighbours of T(neighbour) + cost(cell), 0 at the source. The lattice is cut into blocks;
(source, block) rows are the unit of work. A round settles the inside of every block that received news and sends
improved face values to the neighbouring blocks, so the number of rounds is the number of blocks along a path and
not the number of cells, and quiet blocks cost nothing.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialise
from .cells import CELL

BLOCK = ["bi", "bj", "bk"]
# The six face neighbours.
STEPS = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]
_NEWS = T.ArrayType(T.StructType([
    T.StructField("bi", T.IntegerType()), T.StructField("bj", T.IntegerType()), T.StructField("bk", T.IntegerType()),
    T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("t", T.ArrayType(T.DoubleType())),
]))


def settle(cost: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Relax one block until no cell improves; `cost` is infinite where no wave passes."""
    padded = np.full(tuple(n + 2 for n in t.shape), np.inf)
    inner = (slice(1, -1),) * 3
    while True:
        padded[inner] = t
        near = np.minimum.reduce([
            padded[:-2, 1:-1, 1:-1], padded[2:, 1:-1, 1:-1], padded[1:-1, :-2, 1:-1],
            padded[1:-1, 2:, 1:-1], padded[1:-1, 1:-1, :-2], padded[1:-1, 1:-1, 2:],
        ])
        new = np.minimum(t, near + cost)
        if np.array_equal(new, t):
            return t
        t = new


def _face(step: tuple[int, int, int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat positions of a block's face cells in one direction and of the cells they touch next door."""
    axis = [x for x, s in enumerate(step) if s][0]
    grid = np.arange(n**3).reshape(n, n, n)
    here, there = [slice(None)] * 3, [slice(None)] * 3
    here[axis], there[axis] = (n - 1, 0) if step[axis] > 0 else (0, n - 1)
    return grid[tuple(here)].ravel(), grid[tuple(there)].ravel()


# Blocks that a task holds as arrays at once.
ROWS = 128


def _round(n: int, schema: pa.Schema):
    """Batch function settling one (source, block) row after another; rows are opened and given out a few at a time."""

    def run(batches):
        faces = [(s, *_face(s, n)) for s in STEPS]
        for batch in (whole.slice(a, ROWS).to_pandas() for whole in batches for a in range(0, whole.num_rows, ROWS)):
            times, news, tops = [], [], []
            for row in batch.itertuples(index=False):
                cost = np.full(n**3, np.inf)
                cost[np.asarray(row.cell_at)] = row.cell_cost
                old = np.full(n**3, np.inf) if row.t is None else np.array(row.t, dtype=float)
                start, at = old.copy(), np.asarray(row.at)
                # A source cell starts at its own value; everything else pays to enter the cell.
                entry = np.asarray(row.news_t) + np.where(np.asarray(row.is_source), 0.0, cost[at])
                np.minimum.at(start, at, entry)
                t = settle(cost.reshape(n, n, n), start.reshape(n, n, n)).ravel()
                out = []
                for (di, dj, dk), here, there in faces:
                    better = t[here] < old[here]
                    if better.any():
                        out.append({"bi": row.bi + di, "bj": row.bj + dj, "bk": row.bk + dk,
                                    "at": there[better].tolist(), "t": t[here][better].tolist()})
                # Latest arrival at an open cell: once every wave still under way is later, the block is final.
                tops.append(float(np.max(np.where(np.isfinite(cost), t, 0.0))))
                times.append(t)
                news.append(out)
            made = pd.DataFrame({"source": batch["source"], "model": batch["model"], "bi": batch["bi"], "bj": batch["bj"],
                                 "bk": batch["bk"], "t": times, "top": tops, "out": news})
            yield pa.RecordBatch.from_pandas(made, schema, preserve_index=False)

    return run


def travel_fields(
    cells: DataFrame,
    sources: DataFrame,
    edge_cost: Column,
    block: int = 16,
    max_rounds: int | None = None,
    compact_every: int = 4,
) -> DataFrame:
    """Travel time from every source to every cell of its model: (source, model, i, j, k, t).

    `cells` has model, i, j, k and whatever `edge_cost` reads; `sources` has source, model, i, j, k. Cells with a
    missing or infinite cost are impassable; unreached cells are left out. `max_rounds` raises when it is exceeded.
    Every few rounds blocks behind the front are set aside, so a round reads the blocks near the front only.
    """
    b, n = block, block
    local = ((F.col("i") % b) * b + F.col("j") % b) * b + F.col("k") % b
    blocks_of = [F.floor(F.col(c) / b).cast("int").alias(o) for c, o in zip(CELL, BLOCK)]
    # A block row holds at most block^3 costs.
    open_cells = cells.select("model", *blocks_of, local.cast("int").alias("_at"), edge_cost.cast("double").alias("_cost")).filter(
        F.col("_cost").isNotNull() & ~F.isnan("_cost") & (F.col("_cost") < float("inf")) & (F.col("_cost") >= 0)
    )
    grid = materialise(
        open_cells.groupBy("model", *BLOCK)
        .agg(F.sort_array(F.collect_list(F.struct("_at", "_cost"))).alias("_c"))
        .select("model", *BLOCK, F.col("_c._at").alias("cell_at"), F.col("_c._cost").alias("cell_cost")),
        "blocks",
    )
    first = sources.select(
        "source", "model", *blocks_of, local.cast("int").alias("_at"), F.lit(0.0).alias("_t"), F.lit(True).alias("_src")
    )
    key = ["source", "model", *BLOCK]
    types = dict(sources.dtypes)
    schema = f"source {types['source']}, model {types['model']}, bi int, bj int, bk int, t array<double>, top double, out {_NEWS.simpleString()}"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    news, history, settled, closed, rounds = first, None, [], None, 0
    while True:
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"fields not settled after {max_rounds} rounds")
        # Best value per entered cell first, then one short list per (source, block): at most six faces.
        if closed is not None:
            # A final block cannot improve; what still arrives for it is an echo from its neighbours.
            news = news.join(closed, key, "left_anti")
        best = news.groupBy(*key, "_at", "_src").agg(F.min("_t").alias("_t"))
        inbox = best.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_at", "_t", "_src"))).alias("_m"))
        work = inbox.select(
            *key, F.col("_m._at").alias("at"), F.col("_m._t").alias("news_t"), F.col("_m._src").alias("is_source")
        ).join(grid, ["model", *BLOCK])
        if history is None:
            work = work.withColumn("t", F.lit(None).cast("array<double>"))
        else:
            latest = history.groupBy(*key).agg(F.max_by("t", "_round").alias("t"))
            work = work.join(latest, key, "left")
        done = materialise(work.mapInArrow(_round(n, arrow), schema), "front")
        stamped = done.select(*key, F.lit(rounds).alias("_round"), "t", "top")
        history = stamped if history is None else history.unionByName(stamped)
        sent = done.select("source", "model", F.explode("out").alias("o")).select(
            "source", "model", *[F.col(f"o.{c}").alias(c) for c in BLOCK], F.explode(F.arrays_zip("o.at", "o.t")).alias("z")
        )
        news = sent.select(
            "source", "model", *BLOCK, F.col("z.at").alias("_at"), F.col("z.t").alias("_t"), F.lit(False).alias("_src")
        ).join(grid.select("model", *BLOCK), ["model", *BLOCK], "left_semi")
        rounds += 1
        if done.filter(F.size("out") > 0).isEmpty() or news.isEmpty():
            break
        if rounds % compact_every == 0:
            # No later value can be below the earliest one still to be delivered for the source.
            edge = news.groupBy("source", "model").agg(F.min("_t").alias("_edge"))
            latest = F.max_by(F.struct("_round", "t", "top"), "_round").alias("_l")
            current = history.groupBy(*key).agg(latest).select(*key, "_l.*")
            tagged = materialise(
                current.join(edge, ["source", "model"], "left").select(
                    "*", F.coalesce(F.col("top") <= F.col("_edge"), F.lit(True)).alias("_final")
                ),
                "state",
            )
            settled.append(tagged.filter("_final").select(*key, "t"))
            history = tagged.filter("not _final").select(*key, "_round", "t", "top")
            closed = tagged.filter("_final").select(*key) if closed is None else closed.unionByName(tagged.filter("_final").select(*key))
    final = history.groupBy(*key).agg(F.max_by("t", "_round").alias("t"))
    for part in settled:
        final = final.unionByName(part)
    rows = final.select("source", "model", *BLOCK, F.posexplode("t").alias("_pos", "t")).filter(F.col("t") < float("inf"))
    pos = F.col("_pos")
    return rows.select(
        "source", "model",
        (F.col("bi") * b + F.floor(pos / (b * b))).cast("int").alias("i"),
        (F.col("bj") * b + F.floor(pos / b) % b).cast("int").alias("j"),
        (F.col("bk") * b + pos % b).cast("int").alias("k"),
        "t",
    )


# Cells of paths that a task gives out at once.
PATH_CELLS = 200_000


def _walk(side: int):
    """Batch function following all paths of one (source, block) row after another, up to the source or the first cell beyond the block."""
    m = side + 2
    place = np.arange(m**3).reshape(m, m, m)
    inner = (slice(1, -1),) * 3
    # The smallest cell comes first, so it wins a tie.
    order = sorted(STEPS)
    shift = np.array([(i * m + j) * m + k for i, j, k in order])
    beyond = np.ones((m, m, m), dtype=bool)
    beyond[inner] = False
    beyond = beyond.ravel()

    def paths(row):
        t = np.full(m**3, np.inf)
        t[np.asarray(row.at)] = row.t
        t = t.reshape(m, m, m)
        near = np.stack([t[tuple(slice(1 + d, m - 1 + d) for d in s)] for s in order])
        first = near.argmin(axis=0)
        ahead = (near.min(axis=0) < t[inner]) & np.isfinite(t[inner])
        jump = np.full(m**3, -1)
        jump[place[inner][ahead]] = (place[inner] + shift[first])[ahead]
        start = np.asarray(row.entry)
        at, steps = jump[start], []
        while (at >= 0).any():
            steps.append(at)
            at = np.where(at >= 0, jump[at], -1)
        onward = np.array(steps, dtype=np.int64).reshape(len(steps), len(start)).T
        sizes = (onward >= 0).sum(axis=1)
        some = sizes > 0
        return start[some], onward[onward >= 0], sizes[some]

    def cells(row, flat):
        ij, k = np.divmod(flat, m)
        i, j = np.divmod(ij, m)
        return [(x - 1 + b * side).astype(np.int32) for x, b in zip((i, j, k), (row.bi, row.bj, row.bk))]

    def given(held, types):
        joined = lambda n: np.concatenate([h[n] for h in held])
        start, path = ([np.concatenate([h[n][x] for h in held]) for x in range(3)] for n in (2, 4))
        offsets = pa.array(np.concatenate([[0], np.cumsum(joined(5))]).astype(np.int32))
        listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x) for x in path], names=CELL))
        keys = [pa.array(joined(n), types[n]) for n in (0, 1)]
        return pa.RecordBatch.from_arrays([*keys, *[pa.array(x) for x in start], listed, pa.array(joined(3))], names=["source", "model", *CELL, "path", "goes_on"])

    def run(batches):
        for whole in batches:
            held, total = [], 0
            types = [whole.schema.field(n).type for n in ("source", "model")]
            for part in (whole.slice(a, ROWS).to_pandas() for a in range(0, whole.num_rows, ROWS)):
                for row in part.itertuples(index=False):
                    start, flat, sizes = paths(row)
                    if not len(start):
                        continue
                    keys = [np.full(len(start), x) for x in (row.source, row.model)]
                    held.append((*keys, cells(row, start), beyond[flat[np.cumsum(sizes) - 1]], cells(row, flat), sizes))
                    total += len(flat)
                    if total > PATH_CELLS:
                        yield given(held, types)
                        held, total = [], 0
            if held:
                yield given(held, types)

    return run


def trace_back(rays: DataFrame, fields: DataFrame, block: int = 16) -> DataFrame:
    """Cells of each ray from its end cell back to the source: (ray columns, step, i, j, k).

    `rays` has source, model, i, j, k. A cell's predecessor is the neighbour the wave came from (earliest, smallest cell on a tie). A field is packed
    once into blocks with one layer of neighbours; a round follows the paths from all cells where rays enter a block, each once for all its
    rays, to the first cell beyond it. So a path of any length takes as many rounds as it crosses blocks, and cells without a ray cost nothing.
    """
    ids = [c for c in rays.columns if c not in CELL]
    here, key, m = ["source", "model", *CELL], ["source", "model", *BLOCK], block + 2
    own = {o: F.floor(F.col(c) / block).cast("int") for c, o in zip(CELL, BLOCK)}
    local = ((F.col("i") - F.col("bi") * block + 1) * m + F.col("j") - F.col("bj") * block + 1) * m + F.col("k") - F.col("bk") * block + 1
    front = rays.select(*ids, F.lit(0).cast("long").alias("step"), *CELL)
    ends = fields.agg(*[f(c).alias(f"{n}_{c}") for c in CELL for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if ends["lo_i"] is None:
        return front
    low, high = ({o: ends[f"{n}_{c}"] // block for c, o in zip(CELL, BLOCK)} for n in ("lo", "hi"))
    beside = lambda step: F.struct(*[F.lit(d).alias(o) for d, o in zip(step, BLOCK)])
    faces = [F.when(F.pmod(F.col(c), F.lit(block)) == at, beside([d if o == c else 0 for o in CELL])) for c in CELL for d, at in ((-1, 0), (1, block - 1))]
    sent = fields.select(*here, "t", F.explode(F.array_compact(F.array(beside((0, 0, 0)), *faces))).alias("_to"))
    sent = sent.select(*here, "t", *[(own[o] + F.col(f"_to.{o}")).alias(o) for o in BLOCK])
    for o in BLOCK:
        sent = sent.filter(F.col(o).between(low[o], high[o]))
    packed = sent.groupBy(*key).agg(F.collect_list(F.struct(local.cast("int").alias("at"), "t")).alias("_c")).select(*key, F.col("_c.at").alias("at"), F.col("_c.t").alias("t"))
    if low != high:
        packed = materialise(packed, "packed")
    types = dict(fields.dtypes)
    schema = f"source {types['source']}, model {types['model']}, i int, j int, k int, path array<struct<i:int,j:int,k:int>>, goes_on boolean"
    done = front
    while True:
        entered = front.select(*here).distinct().withColumns(own).groupBy(*key).agg(F.collect_list(local.cast("int")).alias("entry"))
        found = entered.join(packed, key).mapInArrow(_walk(block), schema)
        met = materialise(front.join(found, here).select(*ids, "step", "path", "goes_on"), "paths")
        steps = met.select(*ids, "step", F.posexplode("path").alias("_pos", "_c"))
        done = done.unionByName(steps.select(*ids, (F.col("step") + 1 + F.col("_pos")).alias("step"), *[F.col(f"_c.{c}").alias(c) for c in CELL]))
        last = F.element_at("path", -1)
        front = met.filter("goes_on").select(*ids, (F.col("step") + F.size("path")).alias("step"), *[last[c].alias(c) for c in CELL])
        if low == high or front.isEmpty():
            return done


cloudpickle.register_pickle_by_value(sys.modules[__name__])
